"""Text normalisation, identifiers and multi-pattern matching as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import may_match
from .patterns import LINEAGE_STOP, LINEAGE_TOKEN, any_of, portable


def normalize(c: Column) -> Column:
    """Lower case; null becomes empty."""
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def clean(c: Column) -> Column:
    """White space runs become one space; none at either end."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\s\x{0B}\x{85}\x{A0}]+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def excerpt(c: Column, limit: int = 160) -> Column:
    return F.substring(clean(c), 1, limit)


def text_hash(c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, 16)


def stable_id(prefix: str, *parts: Column, length: int = 10) -> Column:
    joined = F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha1(joined), 1, length)))


def matches(c: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs, ignoring case: one alternation, compiled once, tried only where a literal of one stands."""
    text = F.coalesce(c, F.lit(""))
    return may_match(F.lower(text), patterns) & text.rlike("(?i)" + any_of(patterns))


def matching(c: Column, patterns: list[str]) -> Column:
    """The patterns that occur, in pack order; tried one by one only where the alternation hits."""
    each = F.array_compact(F.array(*[F.when(c.rlike("(?i)" + portable(p)), F.lit(p)) for p in patterns]))
    return F.when(matches(c, patterns), each).otherwise(F.array().cast("array<string>"))


def first_match(c: Column, patterns: list[str]) -> Column:
    """The first pattern, in pack order, that occurs."""
    out = F.when(c.rlike("(?i)" + portable(patterns[0])), F.lit(patterns[0]))
    for p in patterns[1:]:
        out = out.when(c.rlike("(?i)" + portable(p)), F.lit(p))
    return out


def contains_any(c: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def lineage_tokens(c: Column) -> Column:
    """Distinct tokens of three or more characters, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({LINEAGE_TOKEN})"), F.lit(1))), F.array(*map(F.lit, LINEAGE_STOP)))


def strip_tags(c: Column) -> Column:
    """Text of an HTML fragment: scripts, styles and tags removed, common entities decoded."""
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return clean(c)
