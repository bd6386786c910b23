"""Text functions over columns: redaction, estimates, word sets, trimming of output."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekiln.functions import patterns as P


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: Letters that an expression without regard to case takes for others, and those.
_FOLD = ("ıİſ\u212a", "iisk")


def folded(c: Column) -> Column:
    """In lower case, as expressions without regard to case see it."""
    odd = reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in _FOLD[0]])
    return F.lower(F.when(odd, F.translate(c, *_FOLD)).otherwise(c))


def literal_tree(words) -> str:
    """One expression that finds any of the words; what begins alike is looked at once."""
    tree: dict = {}
    for word in words:
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}

    def spelled(node: dict) -> str:
        if "" in node:
            return ""  # what is longer begins with it
        parts = [re.escape(x) + spelled(rest) for x, rest in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return spelled(tree)


def may_match(c: Column, literals) -> Column:
    """Whether a text has one of the literals of any of the groups: without it none of their expressions matches."""
    return folded(c).rlike(literal_tree(sorted({x for group in literals for x in group})))


def literals_in(c: Column, literals) -> Column:
    """The literals that a text has, looked for once at every place; of one that begins with another only the shorter is told."""
    every = sorted({x for group in literals for x in group})
    return F.array_distinct(F.regexp_extract_all(folded(c), F.lit(f"(?=({literal_tree(every)}))"), F.lit(1)))


def has_any(found: Column, group, literals) -> Column:
    """Whether `literals_in` told of one of a group's literals."""
    every = {x for g in literals for x in g}
    keys = sorted({min((x for x in every if word.startswith(x)), key=len) for word in group})
    return F.arrays_overlap(found, F.array(*map(F.lit, keys)))


def redact(c: Column) -> Column:
    """Every secret pattern in turn, over texts that have one of the literals without which none of them matches; others are as they were."""
    small = F.lower(c)
    may = reduce(lambda a, b: a | b, [c.contains(x) for x in P.SECRET_MARKS] + [small.contains(x) for x in P.SECRET_MARKS_ANY_CASE])
    return F.when(may, reduce(lambda x, p: F.regexp_replace(x, p, P.REDACTED.replace("$", r"\$")), P.SECRETS, c)).otherwise(c)


def is_sensitive_path(c: Column) -> Column:
    return F.lower(c).rlike("|".join(f"(?:{p})" for p in P.SENSITIVE_PATHS))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def exchange_text(role: Column, content: Column, tools: Column) -> Column:
    """**Role**: redacted content, and the tools' names on a line of their own."""
    name = F.when(role == "human", "User").when(role == "assistant", "Assistant").otherwise(F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.substring(role, 2, 1 << 30))))
    used = F.when(F.size(tools) > 0, F.concat(F.lit("\n[Tools used: "), F.array_join(tools, ", "), F.lit("]"))).otherwise("")
    return F.concat(F.lit("**"), name, F.lit("**: "), redact(content), used)


def lines(c: Column) -> Column:
    return F.split(c, P.LINE_ENDS)


def words(c: Column, stopwords: tuple[str, ...]) -> Column:
    """The content words of a text: distinct, in lower case, sorted."""
    found = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z0-9_]+"), F.lit(0)), F.lower)
    stop = F.array(*map(F.lit, stopwords))
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def drop_similar(items: Column, kind: str, threshold: float) -> Column:
    """Of structs with `tokens`, in order, those unlike every one kept before. kind: their type."""
    none = F.array().cast(f"array<{kind}>")
    return F.aggregate(items, none, lambda kept, x: F.when(F.exists(kept, lambda k: jaccard(k["tokens"], x["tokens"]) >= threshold), kept).otherwise(F.concat(kept, F.array(x))))


def latin_words(c: Column) -> Column:
    """All words of a text that may be keywords, in their order, repeats and stop words included."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z][a-zA-Z0-9_-]{2,}"), F.lit(0))


def keyword_tokens(c: Column) -> Column:
    """All keywords of a text in their order, repeats included."""
    stop = F.array(*map(F.lit, P.SUMMARY_STOPWORDS))
    return F.filter(latin_words(c), lambda w: ~F.array_contains(stop, w))


def top_words(tokens: Column, n: int) -> Column:
    """The n most frequent items of an array; among equals the earlier."""
    counted = F.transform(F.array_distinct(tokens), lambda w: F.struct((-F.size(F.filter(tokens, lambda x: x == w))).alias("c"), F.array_position(tokens, w).alias("p"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(counted), 1, n), lambda x: x["w"])


def strip_tool_noise(c: Column) -> Column:
    kept = F.filter(F.split(c, "\n"), lambda x: ~strip(x).rlike(r"^\[(?:Used )?[Tt]ools?(?: used)?:") & ~strip(x).rlike(r"^\*\*Assistant\*\*: \[Used tools:") & ~strip(x).isin("[Tools used: ]", "[Used tools: ]"))
    return F.array_join(kept, "\n")


def truncate_code(c: Column, most: int = 4) -> Column:
    """Of each fenced block the first lines; a mark before the fence that closes one that was cut."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        fence = strip(line).startswith("```")
        closing = F.when(s["n"] > most, F.array(F.lit("  ... (truncated)"), line)).otherwise(F.array(line))
        add = F.when(fence & s["inside"], closing).when(fence | ~s["inside"] | (s["n"] < most), F.array(line)).otherwise(F.array().cast("array<string>"))
        n = F.when(fence, 0).when(s["inside"], s["n"] + 1).otherwise(s["n"])
        return F.struct((s["inside"] != fence).alias("inside"), n.alias("n"), F.concat(s["out"], add).alias("out"))

    return F.array_join(F.aggregate(F.split(c, "\n"), start, step, lambda s: s["out"]), "\n")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def optimized(c: Column) -> Column:
    return squeeze(truncate_code(strip_tool_noise(c)))


def snippet(c: Column, most: int, mark: str = "…") -> Column:
    flat = strip(F.translate(c, "\n", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit(mark))).otherwise(flat)


def relevance(distance: Column) -> Column:
    return F.when(distance.isNull(), "?").otherwise(F.format_string("%.0f%%", F.bround((1 - distance) * 100)))


def epoch_ms_iso(ms: Column) -> Column:
    """ISO time in UTC, "" for null and 0."""
    text = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(ms % 1000 != 0, F.date_format(F.timestamp_millis(ms), ".SSSSSS")).otherwise("")
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "").otherwise(F.concat(text, fraction, F.lit("+00:00")))


def basename(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def sanitized(c: Column) -> Column:
    """A name that can be one part of a path."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\-.]", "_"), r"^\.+|\.+$", "")


def relative_path(c: Column, folder: Column) -> Column:
    under = (F.length(folder) > 0) & c.startswith(folder)
    rest = F.regexp_replace(F.substring(c, F.length(folder) + 1, F.length(c)), "^/+", "")
    return F.when(under, F.when(rest == "", c).otherwise(rest)).otherwise(basename(c))


def compact_metadata(project: Column, source: Column, branch: Column, timestamp: Column) -> Column:
    known = lambda c: F.coalesce(c, F.lit("?"))
    return F.concat_ws(" | ", known(project), known(source), F.when(branch != "", branch), known(F.substring(timestamp, 1, 10)))


def dedup_key(c: Column, most: int = 100) -> Column:
    return F.substring(F.regexp_replace(strip(F.lower(c)), r"(?U)\s+", " "), 1, most)


def preview(c: Column, most: int = 120) -> Column:
    """The first line that isn't a header and has more than ten characters."""
    good = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: ~x.startswith("[") & (F.length(x) > 10))
    return F.substring(F.coalesce(F.get(good, F.lit(0)), F.lit("")), 1, most)


def utf8_truncate(c: Column, most: int) -> Column:
    """At most `most` bytes of UTF-8, and how many were left out. A character that the cut meets goes, and so does one that just fits."""
    raw = F.encode(c, "UTF-8")
    size = F.octet_length(c)
    # back over continuation bytes at the cut; the lead byte before them goes as well, and counts as kept
    tail = F.hex(F.substring(raw, F.greatest(F.lit(most - 3), F.lit(1)), F.least(F.lit(4), F.lit(most))))
    back = F.length(F.regexp_extract(tail, "((?:[89AB][0-9A-F])*)$", 1)) / 2
    end = (F.lit(most) - back).cast("int")
    lead = F.conv(F.hex(F.substring(raw, end, F.lit(1))), 16, 10).cast("int") >= 0xC0
    kept = F.decode(F.substring(raw, F.lit(1), end - F.when(lead, 1).otherwise(0)), "UTF-8")
    return F.when(size <= most, c).otherwise(F.concat(kept, F.lit("\n\n*[truncated — "), (size - end).cast("string"), F.lit(" bytes omitted; full content in the store]*")))


def _accents() -> tuple[str, str]:
    """Latin letters with marks and their base letters, by decomposition."""
    pairs = [(chr(x), unicodedata.normalize("NFD", chr(x))[0]) for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00)) for x in range(lo, hi)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def terms(c: Column) -> Column:
    """Search terms: letters and digits of any script, in lower case, Latin accents folded."""
    accented, plain = _accents()
    return F.regexp_extract_all(F.lower(F.translate(c, accented, plain)), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))
