r"""URL filters with redirect equivalence; DataFrame operations only.

A rule is (action, host, path): it fits its host and all subdomains, if the URL's path starts with the rule's; the
longest rule that fits wins. URLs that no rule fits are judged by their aliases. An address is a vertex: host without a default port, path
and parameters; scheme and fragment say nothing. With `spellings`, which is off, www. or m. before a host of two labels at least, tracking parameters and the order of
parameters, .html, index.html and slashes at the end say nothing either. All canonical links and meta refreshes in
the pages (&amp; in them is &), and any redirect table given, are edges between vertices. Connected components over
the edges are taken by distributed contraction. A component with an explicitly allowed member
is allowed, else one with a blocked member is blocked; a page's own rule always stands. All members
decide, also addresses that only links or redirects name.

Only vertices, edges and one row a component move; the html doesn't leave its scan. What rules say is aggregated by vertex and by component; an address that a
third of the pages have is one key of the last join, which adaptive execution splits.

Defined cases: a null URL or one without :// has an empty host and path, no rule and no alias, and is allowed;
null html has no links; repeated rows are judged each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import shared
from lorekiln.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'>\s]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'>\s]+)"
TRACKING = r"^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def vertex(url: Column, spellings: bool = False) -> Column:
    """One string for an address, or for all its spellings; null without a host."""
    h = F.regexp_replace(host(url), r":(?:80|443)$", "")
    p, query = path(url), F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    if spellings:
        h = F.regexp_replace(h, r"^(?:www|m)\.(?=[^.]+\.[^.])", "")
        p = F.regexp_replace(p, r"(?:(?:/index)?\.html?)?/*$", "")
        query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    else:
        p = F.when(p == "", "/").otherwise(p)
    return F.when(h != "", F.concat(h, p, F.lit("?"), query))


def resolved(link: Column, base: Column) -> Column:
    """A link as an absolute URL."""
    root = F.concat(F.lit("http://"), host(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def rule_of(h: Column, p: Column, rules=RULES) -> Column:
    """action, name of the longest rule that fits, else null."""
    out = None
    for action, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        value = F.struct(F.lit(action).alias("action"), F.lit(rule_host + rule_path).alias("name"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<action:string,name:string>")


def links(pages: DataFrame, rules=RULES, url_col: str = "url", html_col: str = "html", spellings: bool = False) -> DataFrame:
    """a, b: vertices that a canonical link or a refresh joins; action: what the rules say of the address linked to."""
    html, url = F.col(html_col), F.col(url_col)
    every = lambda tag, attribute: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, attribute, 1))
    to = F.concat(every(CANONICAL, HREF), every(REFRESH, TARGET))
    linked = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select(url.alias("u"), F.explode(to).alias("l")).where("l <> ''")
    linked = linked.select(F.col("u"), resolved(F.replace(F.col("l"), F.lit("&amp;"), F.lit("&")), F.col("u")).alias("t"))
    return linked.select(vertex(F.col("u"), spellings).alias("a"), vertex(F.col("t"), spellings).alias("b"), _action(F.col("t"), rules)).distinct()


def _action(url: Column, rules) -> Column:
    return rule_of(host(url), path(url), rules)["action"].alias("action")


def judged(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", spellings: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict; redirects (optional): from_url, to_url."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), vertex(url, spellings).alias("node"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    rows = shared.cut(shared.compact(rows.select("page_id", "host", "path", "node", F.col("hit.name").alias("rule"), F.col("hit.action").alias("action"))), "urls")
    edges = shared.cut(links(pages, rules, url_col, html_col, spellings), "links")
    named = rows.select("node", "action").unionByName(edges.select(F.col("b").alias("node"), "action"))
    edges = edges.select("a", "b")
    if redirects is not None:
        ends = [F.col("from_url").cast("string"), F.col("to_url").cast("string")]
        edges = edges.unionByName(redirects.select(vertex(ends[0], spellings).alias("a"), vertex(ends[1], spellings).alias("b")))
        for end in ends:
            named = named.unionByName(redirects.select(vertex(end, spellings).alias("node"), _action(end, rules)))
    comps = components(edges)
    # what rules say of each vertex, page or not, then of each component
    said = named.where("node IS NOT NULL AND action IS NOT NULL").groupBy("node").agg(F.max(F.col("action") == "allow").alias("good"), F.max(F.col("action") == "block").alias("bad"))
    of_node = said.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_comp = of_node.groupBy("comp").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    blocked = of_comp.where("bad AND NOT good").select("comp")
    # only vertices without a rule's word that stand in a blocked component are still to be named
    members = comps.join(blocked, "comp", "left_semi").select("node").unionByName(blocked.select(F.col("comp").alias("node"))).distinct()
    members = members.withColumn("by_alias", F.lit(True))
    out = rows.join(shared.cut(members, "blocked-urls"), "node", "left")
    verdict = F.coalesce("action", F.when(F.col("by_alias"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
