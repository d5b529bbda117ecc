"""Match keys and small domain expressions, all inside the JVM."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU_DAYS, VOLUME_BASE = 60.0, 11.0
EVIDENCE_TEXT = 200
# What somebody types for nothing.
NO_VALUE = frozenset(["", "n/a", "none", "null", "nil", "nan", "unknown", "tbd", "tba", "not available", "not known", "not specified", "not provided", "(blank)", "blank", "(none)", "(null)", "(unknown)", "undefined", "empty", "missing", "not applicable", "unspecified"])


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def term_key(c: str | Column) -> Column:
    """Letters and digits only, lower case; null gives the empty key."""
    return F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9]", "")


def term_key_of(text: str | None) -> str:
    return re.sub("[^a-z0-9]", "", (text or "").lower())


def place_key(c: str | Column) -> Column:
    """Lower case with single spaces."""
    return F.regexp_replace(F.lower(F.trim(_c(c))), r"\s+", " ")


def place_key_of(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip().lower())


def title_norm(c: str | Column) -> Column:
    return F.lower(F.trim(F.coalesce(_c(c), F.lit(""))))


def query_key(c: str | Column) -> Column:
    """A query by which retypings of it are the same: case and spaces don't count, null is empty."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"^\s+|\s+$", "")), r"\s+", " ")


def term_tokens(c: str | Column) -> Column:
    """The different tokens of a text, as technologies are written: ``c++``, ``.net`` gives ``net``, ``s/4hana`` is one."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("([a-z0-9][a-z0-9+#./-]*)"), 1))


def whole_word(c: str | Column, needle: str) -> Column:
    """``needle`` occurs in the text and is not part of a longer word; null text never matches."""
    found = F.lower(_c(c)).rlike("(?<![a-z0-9])" + re.escape(needle.strip().lower()).replace("\\ ", " ") + "(?![a-z0-9])")
    return F.coalesce(found, F.lit(False))


def overlap(c: str | Column, values: list[str]) -> Column:
    """The array shares an element with ``values``; null arrays and null elements never match."""
    if not values:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(F.filter(F.coalesce(_c(c), F.array().cast("array<string>")), lambda x: x.isNotNull()), F.array(*[F.lit(v) for v in values])), F.lit(False))


def contains_all(c: str | Column, values: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(v) for v in values]), F.coalesce(_c(c), F.array().cast("array<string>")))) == 0


def bucket_bounds(c: str | Column) -> tuple[Column, Column]:
    """Employee bucket to (low, high): ``1600``, ``201-500 employees``, ``10,001+``, ``1.5K``; anything else is null.

    The second bound has to follow its dash at once: ``201 - 500`` has a low bound only.
    """
    t = F.trim(F.regexp_replace(F.lower(_c(c)), ",", ""))
    thousands = F.round(F.expr("double(1000)") * F.try_to_number(F.regexp_extract(t, r"^(\d+(?:\.\d+)?)k", 1), F.lit("99999999.999")).cast("double"))
    first = F.regexp_extract(t, r"^(\d+)", 1).try_cast("bigint")
    second = F.regexp_extract(t, r"^\d+\s*-(\d+)", 1).try_cast("bigint")
    is_k, bare, ranged, open_ = t.rlike(r"^\d+(\.\d+)?k"), t.rlike(r"^\d+$"), t.rlike(r"^\d+\s*-"), t.rlike(r"^\d+\+")
    low = F.when(is_k, thousands.cast("bigint")).when(bare | ranged | open_, first)
    high = F.when(is_k, thousands.cast("bigint")).when(bare, first).when(ranged, second)
    return low, high


def days_since(c: str | Column, now: Column) -> Column:
    """Whole elapsed days, never negative; null for a null date."""
    return F.when(_c(c).isNotNull(), F.greatest(F.lit(0), F.timestamp_diff("DAY", _c(c), now)))


def recency(days: Column) -> Column:
    return F.coalesce(F.exp(-days.cast("double") / F.lit(TAU_DAYS)), F.lit(0.0))


def volume(n: Column) -> Column:
    """Grows with the logarithm and is not clamped."""
    return F.log1p(n.cast("double")) / F.lit(math.log(VOLUME_BASE))
