import re
from collections import defaultdict

from pyspark.sql import functions as F

from lorekiln.llm import queries, url_filter

RULES = url_filter.RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fit = [(len(h + p), a, h + p) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


ROWS = [
    (1, "http://a.example.net/x", '<link rel="canonical" href="https://www.example.org/en/1/deep">'),
    (2, "https://M.a.example.net/x/?utm_source=feed#top", None),
    (3, "http://b.example.net/y.html", "<META HTTP-EQUIV='refresh' CONTENT='0; URL=/z'>"),
    (4, "http://b.example.net/z", '<link href="http://c.example.net/q?b=2&a=1" rel=canonical>'),
    (5, "http://c.example.net/q/?a=1&b=2&ref=x", '<link rel="canonical" href="//www.site.com/de/page">'),
    (6, "http://c.example.net/q?a=1", ""),
    (7, "http://d.example.net/1", '<link rel="canonical" href="http://good.org/1">'),
    (8, "http://d.example.net/2", '<link rel="canonical" href="http://d.example.net/1">'),
    (9, "http://www.site.com/de/other", '<link rel="canonical" href="http://d.example.net/1">'),
    (10, "http://x.com/fr/de", ""),
    (11, "http://notexample.org/es/", ""),
    (12, "https://sub.example.org/es/p", ""),
    (13, "http://example.org/en/2", ""),
    (14, None, "<link rel=canonical href='http://example.org/es/1'>"),
    (15, "no scheme", None),
    (16, "http://", ""),
    (17, "http://ORG?x", ""),
    (17, "http://ORG/?x", ""),
    (None, "HTTP://Example.org/en/1#f", "x"),
    (18, "http://alias.example.net/from", ""),
    (19, "http://f.example.net/a/b", "<link rel='canonical' href='c'>"),
    (20, "http://f.example.net/a/c", "<meta http-equiv=refresh content='5;url=http://example.org/es/2'>"),
    (21, "http://www.good.org/1", ""),
]
#: Pages whose own rule doesn't say what becomes of them, and what their aliases do.
BY_ALIAS = {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 14: "allow", 15: "allow", 16: "allow", 18: "block", 19: "block", 20: "block"}


def test_rules_and_aliases(spark):
    df = spark.createDataFrame([(*r, "rule", "node") for r in ROWS], "page_id long, url string, html string, rule string, node string")
    redirects = spark.createDataFrame([("http://alias.example.net/from", "http://example.org/es/9"), (None, "x"), ("http://example.org/es/9", "http://alias.example.net/from/")], "from_url string, to_url string")
    out = url_filter.judged(df.repartition(3), redirects=redirects, spellings=True).collect()
    assert len(out) == len(ROWS)
    urls = defaultdict(set)
    for i, u, _ in ROWS:
        urls[i].add(parts(u))
    for r in out:
        assert (r.host, r.path) in urls[r.page_id]
        action, name = rule_of(r.host, r.path)
        assert r.rule == name, r
        if action:
            assert r.verdict == action
        else:
            assert r.verdict == BY_ALIAS.get(r.page_id, "allow"), r


def test_blocked_components_without_an_allowed_member(spark):
    rows = [(1, "http://a.net/1", "<link rel=canonical href='http://b.com/de/1'>"), (2, "http://b.com/de/1", ""), (3, "http://c.net/3", "<link rel=canonical href='http://a.net/1'>"), (4, "http://www.c.net/3/", ""), (5, "http://c.net/4", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judged(df, spellings=True).collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
    # one explicitly allowed alias goes before the block of the others, but not before a page's own rule
    df = df.union(spark.createDataFrame([(6, "http://ok.org/x", "<link rel=canonical href='http://c.net/3'>")], df.schema))
    assert {r.page_id: r.verdict for r in url_filter.judged(df, spellings=True).collect()} == {1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}
    assert url_filter.judged(df.limit(0)).count() == 0


def test_spellings_of_one_address(spark):
    same = ["http://x.net/a", "https://www.x.net/a/", "http://m.X.net:80/a.html#f", "http://x.net/a/index.html?utm_medium=1&ref=2", "x://x.net/a?"]
    other = ["http://x.net/b", "http://x.net/a?page=2", "http://y.x.net/a"]
    df = spark.createDataFrame([(u,) for u in same + other], "u string")
    out = [r.v for r in df.select(url_filter.vertex(df.u, spellings=True).alias("v")).collect()]
    assert len(set(out[: len(same)])) == 1 and len(set(out)) == 1 + len(other)


def test_rules_apply_to_addresses_that_are_no_pages(spark):
    rows = [
        (1, "http://a.net/1", "<link rel=canonical href='http://example.org/es/9'>"), (2, "http://b.net/2", "<meta http-equiv=refresh content='0; url=http://b.com/de/2'>"),
        (3, "http://c.net/3", "<link rel=canonical href='http://b.com/de/3'>"), (4, "http://d.net/4", "<link rel=canonical href='http://c.net/3'><meta http-equiv=refresh content='0;url=http://ok.org/4'>"),
        (5, "http://e.net/5", ""), (6, "http://f.net/6", ""), (7, "http://b.com:8080/fr/x", ""), (8, "http://b.com:80/de/y", "<link rel=canonical href='http://b.com/de/y'>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://e.net/5", "http://example.org/es/10"), ("http://example.org/en/1", "http://f.net/6")], "from_url string, to_url string")
    out = {r.page_id: r.verdict for r in url_filter.judged(df, redirects=redirects, spellings=True).collect()}
    assert out == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "block"}


def test_all_links_of_a_page_and_entities_in_them(spark):
    rows = [
        (1, "http://a.net/1", "<link rel=canonical href='http://a.net/x'><link rel=canonical href='http://b.com/de/1'>"),
        (2, "http://c.net/q?a=1&b=2", ""), (3, "http://d.com/de/2", '<link rel="canonical" href="http://c.net/q?b=2&amp;a=1">'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judged(df, spellings=True).collect()} == {1: "block", 2: "block", 3: "block"}


def test_the_query_equals_its_sql_on_pages_with_links(spark, tmp_path):
    """Canonical links, chains of refreshes, a hub of aliases and targets outside the table, which the test tables don't have."""
    import random

    import duckdb

    rnd = random.Random(12)
    hosts = ["a.net", "b.com", "www.b.com", "example.org", "x.example.org", "ok.org", "c.fr.com"]
    address = lambda: f"http://{rnd.choice(hosts)}{rnd.choice(['/de/', '/es/', '/en/1', '/fr/', '/'])}{rnd.randint(0, 40)}{rnd.choice(['', '.html', '?a=1&b=2', '?utm_source=x'])}"
    rows = []
    for i in range(400):
        html = "".join(
            rnd.choice(["", "<p>text</p>", f"<link rel='canonical' href='{address()}'>", f'<META http-equiv="refresh" content="0; url={address()}">', "<link rel=canonical href=/hub>", f"<link rel=canonical href='{rnd.randint(0, 40)}'>"])
            for _ in range(rnd.randint(0, 2))
        )
        rows.append((i, rnd.choice([None, "none", address(), address(), address(), f"http://chain.net/{i}"]), html if i % 9 else None))
    rows += [(1000 + i, f"http://chain.net/{i}", f"<link rel=canonical href='http://chain.net/{i + 1}'>") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries.op10_url_filter(spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = sorted(db.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.op10_sql()})").fetchall())
    assert [tuple(str(x) for x in r) for r in got] == [tuple(str(x) for x in r) for r in want]
    assert {r[4] for r in got} == {"allow", "block"} and sum(r[4] == "block" and r[3] is None for r in got) > 10


def test_only_links_join_addresses(spark):
    rows = [
        (1, "http://m.net/p", "<link rel=canonical href='http://b.com/de/1'>"), (2, "http://net/p", ""), (3, "http://c.net/x.html?ref=1", "<link rel=canonical href='http://b.com/de/1'>"), (4, "http://c.net/x/index.html", ""),
        (5, "https://M.NET:443/p#top", ""), (6, "http://m.net/p?", ""), (7, "http://m.net/p?a=1", ""), (8, "http://www.m.net/p", ""), (9, "http://d.net", "<link rel=canonical href='http://b.com/de/1'>"), (10, "http://d.net/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id for r in url_filter.judged(df).collect() if r.verdict == "block"} == {1, 3, 5, 6, 9, 10}
    odd = [r.v for r in spark.createDataFrame([("http://m.net/p",), ("http://net/p",), ("http://m.x.net/p",), ("http://x.net/p/",)], "u string").select(url_filter.vertex(F.col("u"), spellings=True).alias("v")).collect()]
    assert odd[0] != odd[1] and odd[2] == odd[3]
