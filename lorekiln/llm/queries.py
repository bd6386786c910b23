"""The query op<N>_<name> of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import bpe, fim, licenses, line_dedup, mixing, near_dedup, ogg, packing, prefix_trie, quality, shared, token_files, url_filter, warc_zip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.deduped(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"))
    return mix.select(F.col("i").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.demuxed(ogg.with_media(_table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    parts = token_files.write(_table(spark, sf_dir, "documents"), tokenizer, shared.shared_dir(spark, "tokens"))
    return token_files.read(spark, parts, tokens=False)


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = warc_zip.write(_table(spark, sf_dir, "pages"), shared.shared_dir(spark, "warc"))
    return warc_zip.read(spark, paths, payload=False)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, _table(spark, sf_dir, "labels")).drop("text")


def op11_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)
    whole = bpe.decoded(ids, tokenizer)
    return whole.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restored(fim.transformed(_table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ogg": op2_ogg,
    "op3_mixing": op3_mixing,
    "op4_licenses": op4_licenses,
    "op5_token_files": op5_token_files,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_warc_zip": op8_warc_zip,
    "op9_near_dedup": op9_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_bpe": op11_bpe,
    "op12_fim": op12_fim,
    "op13_prefix_trie": op13_prefix_trie,
}

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(list_zip(l, range(len(l)))) AS x
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, x[1] AS line, x[2] AS p, {ASCII_LOWER.format(f"trim(x[1], {WHITE})")} AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, line, p, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP3_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS words, 2.0::DOUBLE * sum(size) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM sized GROUP BY source
), filled AS (
  SELECT *, 1.5::DOUBLE * sum(words) OVER () AS b, coalesce(sum(cap) OVER p, 0) AS c, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS r
  FROM by_source WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (SELECT *, w * (b - c) / r >= cap AS is_full FROM filled
), targets AS (
  SELECT source, words, CASE WHEN is_full THEN cap ELSE
    w * (b - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) / sum(w) FILTER (NOT is_full) OVER () END AS target FROM judged
), needs AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS repeats FROM targets
), run AS (
  SELECT s.*, words, target, repeats, target - repeats * words AS need,
         sum(size) OVER (PARTITION BY s.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY s.source, h) AS own
  FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, words AS source_size, target,
       (size * (repeats + CASE WHEN upto <= need OR (upto - own <= need AND need - (upto - own) >= own / 2) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""

WORDS = r"[^\x20\x09-\x0D]+"

OP9_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '{WORDS}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b
    ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
), comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c, s.doc_id) AS component_id, coalesce(c, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN comp USING (doc_id)
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"


def _host(rest: str) -> str:
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"


def _path(rest: str) -> str:
    return f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def _vertex(rest: str) -> str:
    host, path = f"regexp_replace({_host(rest)}, ':(80|443)$', '')", _path(rest)
    return f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || '?' || regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1) END"


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op10_sql() -> str:
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{a} {h}{p}'" for a, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])))
    links = lambda tag, attribute: f"list_transform(regexp_extract_all(html, {_quote(tag)}), lambda x: regexp_extract(x, {_quote(attribute)}, 1))"
    return f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html, {_rest("coalesce(url, '')")} AS rest FROM pages
), urls AS (
  SELECT page_id, html, {_host("rest")} AS host, {_path("rest")} AS path, {_vertex("rest")} AS node FROM parsed
), ruled AS (
  SELECT *, CASE {fits} END AS hit FROM urls
), linked AS (
  SELECT node, host, path, replace(unnest(list_concat({links(url_filter.CANONICAL, url_filter.HREF)}, {links(url_filter.REFRESH, url_filter.TARGET)})), '&amp;', '&') AS l FROM urls WHERE regexp_matches(html, '(?i)canonical|http-equiv')
), resolved AS (
  SELECT node AS a, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN starts_with(l, '//') THEN 'http:' || l WHEN starts_with(l, '/') THEN 'http://' || host || l
    ELSE 'http://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || l END AS u FROM linked WHERE l <> ''
), targets AS (SELECT a, {_rest("u")} AS rest FROM resolved
), edges AS (SELECT DISTINCT a, {_vertex("rest")} AS b, {_host("rest")} AS host, {_path("rest")} AS path FROM targets
), named AS (SELECT node, hit FROM ruled UNION SELECT b, CASE {fits} END FROM edges
), both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
), reach AS (
  SELECT node, node AS r FROM urls WHERE node IS NOT NULL UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
), said AS (
  SELECT reach.node, bool_or(starts_with(hit, 'allow')) AS good, bool_or(starts_with(hit, 'block')) AS bad FROM reach JOIN named ON named.node = reach.r GROUP BY reach.node
)
SELECT page_id, host, path, string_split(hit, ' ')[2] AS rule, coalesce(string_split(hit, ' ')[1], CASE WHEN bad AND NOT coalesce(good, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN said USING (node)
"""


OP12_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM drawn
), formed AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

#: The CRC-32 of a string of ASCII characters, bit by bit.
CRC32_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({s}) + 1), lambda k: ascii(substr({s}, k, 1))::BIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""

OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ranked AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text)) - 1 AS i FROM turns
), convs AS (
  SELECT c, count(*) AS own, c - c % 5 AS b, {CRC32_SQL.format(s="c::VARCHAR")} % 9 AS h FROM turns GROUP BY c
), taken AS (
  SELECT v.*, least(v.h, coalesce(w.own, 0)) AS taken FROM convs v LEFT JOIN convs w ON w.c = v.b
), rebuilt AS (
  SELECT v.c, r.i, r.role, r.text FROM taken v JOIN ranked r ON r.c = v.b AND r.i < v.h
  UNION ALL SELECT v.c, r.i - v.h + v.taken, r.role, r.text FROM taken v JOIN ranked r ON r.c = v.c AND r.i >= v.h
), whole AS (
  SELECT c, coalesce(list({{'role': role, 'text': text}} ORDER BY i) FILTER (i IS NOT NULL), []) AS s FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c
), prefixes AS (
  SELECT c, len(s) AS l, s, unnest(range(0, len(s) + 1)) AS d FROM whole
), nodes AS (
  SELECT d, s[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (l = d), '') AS ends FROM prefixes GROUP BY d, s[1:d]
), below AS (
  SELECT *, unnest(range(0, d + 1)) AS ad FROM nodes
), kin AS (
  SELECT a.conv_id AS ac, a.d AS ad, b.conv_id, b.d, (b.n_convs - 1) * coalesce(octet_length(encode(b.p[b.d].text)), 0) AS saved
  FROM below b JOIN nodes a ON a.d = b.ad AND a.p = b.p[1:b.ad]
), children AS (
  SELECT ac AS conv_id, ad AS d, count(*) AS n FROM kin WHERE ad = d - 1 GROUP BY ac, ad
), sums AS (
  SELECT k.ac AS conv_id, k.ad AS d, count(*) FILTER (c.n IS NULL) AS n_leaves, sum(k.saved)::BIGINT AS saved_tokens
  FROM kin k LEFT JOIN children c ON c.conv_id = k.conv_id AND c.d = k.d GROUP BY k.ac, k.ad
)
SELECT n.conv_id, n.d AS depth, k.ac AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.conv_id = n.conv_id AND s.d = n.d LEFT JOIN children c ON c.conv_id = n.conv_id AND c.d = n.d
  LEFT JOIN kin k ON k.conv_id = n.conv_id AND k.d = n.d AND k.ad = n.d - 1
"""

ORACLES: dict[str, str] = {"op12_fim": OP12_SQL, "op13_prefix_trie": OP13_SQL, "op1_line_dedup": OP1_SQL, "op3_mixing": OP3_SQL, "op9_near_dedup": OP9_SQL, "op10_url_filter": op10_sql()}
