"""Text rules as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect import config

#: White space as Python sees it: Unicode space and the four separators.
WS = r"(?U)[\s\x1c-\x1f]"
NOT_WS = r"(?U)[^\s\x1c-\x1f]"
#: Runs of it other than a single blank, which needs no change to be collapsed.
RUNS = r"(?U)(?: [\s\x1c-\x1f]+|[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*)"
# A year or span of years; a number with or without unit.
YEAR = r"(?i)^(19|20)\d{2}(\s*[-–—/to]+\s*((19|20)\d{2}\+?|present|now|\+))?$"
NUMERIC = r"(?i)^[-+]?\$?\d[\d,.]*\s*(%|percent|kw|kv|mw|kg|tco2e?|tons?)?\+?$"


def computed(rows: DataFrame, **cols: Column) -> DataFrame:
    """``rows`` with columns that are computed once, however often later expressions use them.

    The optimizer would put the expressions in place of their names, and a list function's body would compute them
    for each member; it does not do so across a generator.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, RUNS, " "))


def words(c: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.array_remove(F.split(c, f"{WS}+"), "")


def first_words(c: Column, n: int) -> Column:
    """The first n ``words``; what follows them in the text is neither split nor copied."""
    return words(F.regexp_extract(c, f"^{WS}*+(?:{NOT_WS}++{WS}++){{0,{n - 1}}}{NOT_WS}*+", 0))


def clean_name(c: Column) -> Column:
    """White space collapsed, and space, quotes and Markdown marks cut at both ends; null gives ''."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), RUNS, " "), F.lit(" \"'`*_#"))


def norm_key(c: Column) -> Column:
    """Lower case with every run of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def norm_type(c: Column) -> Column:
    t = F.initcap(F.lower(strip(F.coalesce(c, F.lit("")))))
    return F.when(t.isin(config.ENTITY_TYPES), t).otherwise(F.lit("Concept"))


def looks_like_sentence(c: Column) -> Column:
    n = strip(c)
    return F.lower(n).rlike("^(" + "|".join(config.CAPTIONS) + ")") | (F.size(words(n)) >= 10)


def refine_type(name: Column, type_: Column) -> Column:
    n = strip(name)
    return F.when(n.rlike(YEAR), F.lit("Milestone")).when(n.rlike(NUMERIC), F.lit("Metric")).otherwise(type_)


def is_junk(name: Column) -> Column:
    k = norm_key(name)
    return (k == "") | k.isin(config.JUNK_NAMES) | k.startswith(config.MARK) | looks_like_sentence(name)


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_-]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def stem_key(file: Column) -> Column:
    """Directory and name without its last two suffixes, in lower case; a leading dot is no suffix."""
    cut = lambda c: F.regexp_replace(c, r"(?<=[^/])\.[^./]+$", "")
    return F.lower(cut(cut(file)))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def body_fingerprint(body: Column) -> Column:
    """md5 of the lower-cased text without provenance comments, white space collapsed."""
    return F.md5(normal_body(body))


def normal_body(body: Column) -> Column:
    return collapse(F.lower(F.regexp_replace(body, rf"<!--\s*{config.MARK}-.*?-->", "")))


def node_text(name: Column, type_: Column, description: Column, aliases: Column, facts: Column) -> Column:
    """What of a node is embedded."""
    blank = lambda c: F.when(c != "", c)
    also = F.when(F.size(aliases) > 0, F.concat(F.lit("Also known as: "), F.array_join(F.slice(aliases, 1, 4), ", ")))
    return F.concat_ws(" ", F.concat(name, F.lit(" ("), F.coalesce(type_, F.lit("")), F.lit(").")), blank(description), also, F.when(F.size(facts) > 0, F.array_join(F.slice(facts, 1, 5), " ")))


def html_safe_json(c: Column) -> Column:
    """JSON text that cannot leave a script element."""
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def version_key(tag: Column) -> Column:
    """The first three integers of a version, with zeros for those it lacks."""
    found = F.transform(F.regexp_extract_all(F.coalesce(tag, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("bigint"))
    return F.slice(F.concat(found, F.array(*[F.lit(0).cast("bigint")] * 3)), 1, 3)


def context_window(ram_gb: Column) -> Column:
    return F.when(F.coalesce(ram_gb, F.lit(0)) == 0, 8192).when(ram_gb <= 8, 4096).when(ram_gb <= 16, 8192).otherwise(16384)


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def parse_json(text: Column) -> Column:
    """JSON text in a model's answer, or null: as it is, without a code fence, or its outermost braces or brackets."""
    t = strip(text)
    bare = strip(F.regexp_replace(F.regexp_replace(t, "^`+|`+$", ""), r"^[^\n]*\n", ""))
    t = F.when(t.startswith("```"), bare).otherwise(t)
    good = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(good(blank(t)), good(blank(F.regexp_extract(t, r"(?s)\{.*\}", 0))), good(blank(F.regexp_extract(t, r"(?s)\[.*\]", 0))))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it: also inside a list function's lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalise(v: Column) -> Column:
    """Unit vector in double; a zero vector stays as it is."""
    wide = lambda x: x.cast("double")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + wide(x) * wide(x)))
    return bound(norm, lambda n: F.transform(v, lambda x: F.when(n == 0, wide(x)).otherwise(wide(x) / n)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return dot(a, b) / F.when(na == 0, 1.0).otherwise(na) / F.when(nb == 0, 1.0).otherwise(nb)
