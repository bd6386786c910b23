import re

import pytest
from pyspark.sql import functions as F

from lorekiln.functions import patterns as P
from lorekiln.functions import text as T


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


SECRETS = [
    "key AKIA" + "A1" * 8, "AKIA123", "aws my secret = " + "a" * 40, "ghp_" + "x" * 36, "ghp_" + "x" * 10, "glpat-" + "a-" * 10, "xoxb-1-a", "sk-" + "b" * 20, "sk-ant-" + "c-" * 10, "api_key = '" + "d" * 20 + "'",
    "Authorization: Bearer ab.cd==", "-----BEGIN RSA PRIVATE KEY-----", "postgresql://u:p@h/db", "http://user:pw@host", "password=hunter22 rest", "password=short", "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10,
    "token: " + "0a" * 16, "a\x85b password: x yyyyyyyyy", "", "nothing here",
]


def test_redaction_equals_the_patterns_in_order(spark):
    def plain(s):
        for p in P.SECRETS:
            s = re.sub(p, P.REDACTED, s)
        return s

    got = each(spark, SECRETS, T.redact)
    for s, g in zip(SECRETS[:-3], got[:-3]):
        assert g == plain(s), s
    assert got[-1] == "nothing here" and got[5] == P.REDACTED


def test_sensitive_paths(spark):
    assert each(spark, ["/a/.env", "/a/.env.local", "x.environment", "MY.PEM", "id.key", "a/Credentials.json", "service-account.json", "readme.md"], T.is_sensitive_path) == [True, True, False, True, True, True, True, False]


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 7, 10])
def test_utf8_truncation(spark, limit):
    def plain(s):
        raw = s.encode()
        if len(raw) <= limit:
            return s
        cut = raw[:limit]
        while cut and cut[-1] & 0xC0 == 0x80:
            cut = cut[:-1]
        return f"{cut.decode(errors='ignore')}\n\n*[truncated — {len(raw) - len(cut)} bytes omitted; full content in the store]*"

    values = ["abcdefghijk", "aé", "ééééééé", "日本語テキスト", "a😀b😀c", "x日y😀z", ""]
    assert each(spark, values, lambda c: T.utf8_truncate(c, limit)) == [plain(v) for v in values]


def test_code_blocks(spark):
    code = "a\n```py\n1\n2\n3\n4\n5\n6\n```\nb"
    out = each(spark, [code, "```\n1\n```", "```\n1\n2\n3\n4\n5", "none", "  ``` \n1\n2\n3\n4\n5\n\t```"], T.truncate_code)
    assert out == ["a\n```py\n1\n2\n3\n4\n  ... (truncated)\n```\nb", "```\n1\n```", "```\n1\n2\n3\n4", "none", "  ``` \n1\n2\n3\n4\n  ... (truncated)\n\t```"]


def test_noise_and_squeeze(spark):
    text = "[Tools used: Read]\nkeep\n**Assistant**: [Used tools: x]\n  [Used tools: ]\n[tool: no]\nx\n\n\n\ny \n"
    assert each(spark, [text], T.optimized) == ["keep\nx\n\ny"]


def test_small_functions(spark):
    assert each(spark, [0, None, 1_700_000_000_000, 1_700_000_000_123], T.epoch_ms_iso, "long") == ["", "", "2023-11-14T22:13:20+00:00", "2023-11-14T22:13:20.123000+00:00"]
    assert each(spark, ["a b", "..x/y..", "é-1.2", ".."], T.sanitized) == ["a_b", "x_y", "é-1.2", ""]
    assert each(spark, ["/w/a/b.py", "/other/c.py", "/w"], lambda c: T.relative_path(c, F.lit("/w"))) == ["a/b.py", "c.py", "/w"]
    assert each(spark, ["/a/b/", "c", "/x/y.py"], T.basename) == ["b", "c", "y.py"]
    assert each(spark, ["  A \n b  c "], T.dedup_key) == ["a b c"]
    assert each(spark, ["[head]\nshort\nthis line is long enough", "[x]\nno"], T.preview) == ["this line is long enough", ""]
    assert each(spark, ["x" * 5, "a\nb"], lambda c: T.snippet(c, 3)) == ["xxx…", "a b"]
    assert each(spark, [0.25, None], T.relevance, "double") == ["75%", "?"]
    assert each(spark, ["Café foo_bar ÅNGSTRÖM ß jwt.py"], T.terms, "string") == [["cafe", "foo", "bar", "angstrom", "ß", "jwt", "py"]]
    assert each(spark, ["the Parser_1 parser_1 an ox fixing"], lambda c: T.words(c, P.TODO_STOPWORDS)) == [["fixing", "parser_1"]]
    assert each(spark, ["a\r\nb\x0bc\x85d e\x1cf"], T.lines) == [["a", "b", "c", "d", "e", "f"]]
    assert each(spark, ["redis cache redis queue cache redis of"], lambda c: T.top_words(T.keyword_tokens(c), 2)) == [["redis", "cache"]]


def test_word_list_sizes():
    assert [len(set(x)) for x in (P.RULE_STOPWORDS, P.TODO_STOPWORDS, P.PROBLEM_STOPWORDS, P.SUMMARY_STOPWORDS)] == [85, 88, 115, 148]
    assert len(P.SKIPPED_FOLDERS) == 37
