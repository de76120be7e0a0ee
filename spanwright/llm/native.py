"""Column helpers for the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanwright.llm.common import SPACE


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` or a lambda in it uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != "")


def match_spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, also: str | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, kind) in code points.

    Splitting by the pattern gives what stands between the matches, extracting gives the matches; their lengths in turn
    add up to positions.  Of the matches those stay whose ``group`` has ``least`` characters and,
    if given, fits ``also``.  Most texts have no match and pay for one search only.
    """
    kind_of = "array<struct<start:int,end:int,kind:int>>"
    none = F.array().cast(kind_of)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def located(parts: Column) -> Column:
        def add(state: Column, k: Column) -> Column:
            start = state["at"] + F.length(F.get(parts["between"], k))
            end = start + F.length(F.get(parts["found"], k))
            value = F.get(parts["held"], k)
            good = F.length(value) >= least
            if also:
                good &= value.rlike(also)
            span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
            return F.struct(
                end.alias("at"),
                F.when(good, F.concat(state["spans"], span.cast(kind_of))).otherwise(state["spans"]).alias("spans"),
            )

        first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(parts["found"]) - 1), first, add, lambda s: s["spans"])

    pieces = F.struct(F.split(text, pattern, -1).alias("between"), found.alias("found"), held.alias("held"))
    return F.when(text.rlike(pattern), let(pieces, located)).otherwise(none)
