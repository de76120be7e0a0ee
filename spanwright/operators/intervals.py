"""Runs, gaps and overlaps of spans: DataFrame in, DataFrame out.

Spans have video_id, idx, start_ms and end_ms.  Windows are per video and always end their order with idx, so that
equal spans keep one order; nulls stand last, as in SQL.  A video's spans are the unit of work: they sort within one task and spill if they must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["start_ms", "end_ms", "idx"]


def by_video(*more: str) -> Window:
    return Window.partitionBy("video_id", *more).orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])


def earlier(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def overlap_ms(a: str = "", b: str = "other_") -> Column:
    """Length of what two spans share; never negative."""
    return F.greatest(
        F.least(F.col(f"{a}end_ms"), F.col(f"{b}end_ms")) - F.greatest(F.col(f"{a}start_ms"), F.col(f"{b}start_ms")), F.lit(0)
    )


def tiou(a: str = "", b: str = "other_") -> Column:
    """Temporal intersection over union; 0 where the union is empty."""
    shared = overlap_ms(a, b)
    length = lambda p: F.greatest(F.col(f"{p}end_ms") - F.col(f"{p}start_ms"), F.lit(0))
    union = length(a) + length(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def overlap_join(left: DataFrame, right: DataFrame, bin_ms: int, how_long: str = "other_") -> DataFrame:
    """All pairs of one video that overlap: each starts before the other ends; ``right``'s columns get the prefix ``how_long``.

    An empty span overlaps what it lies inside of, with a shared length of 0, but no span that it only borders on.
    Both sides are cut into bins of ``bin_ms``, so the join has (video, bin) as its key and a long stream is not
    quadratic in itself.  A pair that meets in several bins counts in the first bin of the later start.
    """
    other = right.select(*[F.col(c).alias(how_long + c) for c in right.columns if c != "video_id"], F.col("video_id"))
    bins = lambda p: F.explode(
        F.sequence(F.floor(F.col(f"{p}start_ms") / bin_ms), F.floor(F.col(f"{p}end_ms") / bin_ms))
    ).alias("bin")
    a = left.select("*", bins(""))
    b = other.select("*", bins(how_long))
    meet = F.floor(F.greatest("start_ms", how_long + "start_ms") / bin_ms) == F.col("bin")
    touch = (F.col("start_ms") < F.col(how_long + "end_ms")) & (F.col(how_long + "start_ms") < F.col("end_ms"))
    return a.join(b, ["video_id", "bin"]).where(meet & touch).drop("bin")


def touched_spans(units: DataFrame, events: DataFrame, bin_ms: int) -> DataFrame:
    """(video_id, start_ms, end_ms), once each, of the units that an event overlaps; ids play no role, as they may repeat or be null."""
    return overlap_join(units.select("video_id", "start_ms", "end_ms"), events, bin_ms).select("video_id", "start_ms", "end_ms").distinct()


def chunks(units: DataFrame, gap_ms: int) -> DataFrame:
    """Number the runs of units whose gaps are at most ``gap_ms``; an unreliable unit ends the run before it and after it."""
    w = by_video()
    reliable = F.col("reliable") if "reliable" in units.columns else F.lit(True)
    before = F.lag("end_ms").over(w)
    trusted_before = F.lag(reliable).over(w)
    breaks = before.isNull() | ~trusted_before | ~reliable | (F.col("start_ms") - before > gap_ms)
    return units.withColumn("chunk", F.sum(breaks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def untrusted_gaps(units: DataFrame, least_ms: int, length: DataFrame | None = None) -> DataFrame:
    """Stretches strictly longer than ``least_ms`` that no unit covers; with ``length`` (video_id, total_ms) also at either end."""
    w = by_video()
    reached = F.max("end_ms").over(earlier(w))
    gaps = units.withColumn("gap_start", reached).select("video_id", "gap_start", F.col("start_ms").alias("gap_end"))
    gaps = gaps.where("gap_start is not null")
    if length is not None:
        ends = units.groupBy("video_id").agg(F.min("start_ms").alias("first"), F.max("end_ms").alias("last"))
        ends = length.join(ends, "video_id", "left")
        gaps = gaps.union(ends.select("video_id", F.lit(0).cast("long"), F.coalesce("first", "total_ms"))).union(
            ends.where("last is not null").select("video_id", "last", "total_ms")
        )
    return gaps.where(F.col("gap_end") - F.col("gap_start") > least_ms)


def merged_runs(spans: DataFrame, gap_ms: int = 0) -> DataFrame:
    """Unions of spans that overlap or lie at most ``gap_ms`` apart."""
    w = by_video()
    reached = F.max("end_ms").over(earlier(w))
    fresh = (reached.isNull() | (F.col("start_ms") - reached > gap_ms)).cast("int")
    numbered = spans.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("video_id", "run").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_spans")
    )


def clamp_overlaps(units: DataFrame, most_ms: int) -> DataFrame:
    """Start each unit where those before it have ended.

    A unit that is all covered is swallowed.  Units of the result are unreliable if they overlapped the units before by
    more than ``most_ms``, if a later swallowed unit lay in them, or if a later unit that overlapped too much
    did so in them.
    """
    w = by_video()
    rank = F.row_number().over(w)
    seen = units.withColumns({"reached": F.max("end_ms").over(earlier(w)), "rank": rank})
    start = F.greatest("start_ms", F.coalesce("reached", "start_ms"))
    seen = seen.withColumns({"raw_start": F.col("start_ms"), "start_ms": start})
    seen = seen.withColumn("swallowed", F.col("end_ms") <= F.col("start_ms"))
    seen = seen.withColumn("disputed", F.coalesce(F.col("reached") - F.col("raw_start") > most_ms, F.lit(False)))
    bad = seen.where("swallowed or disputed").select(
        "video_id",
        F.col("rank").alias("bad_rank"),
        F.col("raw_start").alias("bad_start"),
        F.when(F.col("swallowed"), F.col("end_ms")).otherwise(F.col("reached")).alias("bad_end"),
    )
    kept = seen.where("not swallowed")
    hit = (
        kept.join(bad, "video_id")
        .where("bad_rank > rank and bad_start < end_ms and bad_end > start_ms")
        .select("video_id", F.col("rank"), F.lit(True).alias("hit"))
        .distinct()
    )
    out = kept.join(hit, ["video_id", "rank"], "left")
    reliable = ~F.col("disputed") & F.col("hit").isNull()
    return out.select("video_id", "idx", "start_ms", "end_ms", reliable.alias("reliable"))


def drop_quarantined(events: DataFrame, zones: DataFrame, bin_ms: int) -> DataFrame:
    """Events of which at most half lies in zones; overlaps with several zones add up."""
    inside = overlap_join(events, zones, bin_ms).groupBy("video_id", "idx").agg(F.sum(overlap_ms()).alias("inside_ms"))
    joined = events.join(inside, ["video_id", "idx"], "left")
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    return joined.where(2 * F.coalesce("inside_ms", F.lit(0)) <= length).drop("inside_ms")


def tiles(streams: DataFrame, tile_ms: int) -> DataFrame:
    """Cut each stream (video_id, total_ms) into tiles; the last is clipped."""
    count = F.greatest(F.lit(1), F.ceil(F.col("total_ms") / tile_ms)).cast("long")
    at = streams.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    start = F.col("idx") * tile_ms
    return at.select("video_id", "idx", start.alias("start_ms"), F.least(start + tile_ms, F.col("total_ms")).alias("end_ms"))


def asof_nearest(points: DataFrame, marks: DataFrame) -> DataFrame:
    """Each point (video_id, idx, at_ms) with the mark of its video that is nearest in time: mark, mark_ms; null without marks.

    Ties go to the earlier mark, then the lower id.  One sort of both sides together, no pairs.
    """
    asked = points.select("video_id", "at_ms", F.col("idx").alias("point"), F.lit(None).cast("long").alias("mark"))
    both = asked.unionByName(marks.select("video_id", "at_ms", F.lit(None).cast("long").alias("point"), F.col("idx").alias("mark")))
    # of marks at one time the lowest id stands last before a point and first after it
    seen = F.when(F.col("mark").isNotNull(), F.struct(F.col("at_ms").alias("t"), F.col("mark").alias("id")))
    down = Window.partitionBy("video_id").orderBy("at_ms", F.col("point").isNotNull(), F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("video_id").orderBy("at_ms", F.col("point").isNull(), "mark").rowsBetween(0, Window.unboundedFollowing)
    placed = both.withColumn("m", seen).withColumns({"before": F.last("m", True).over(down), "after": F.first("m", True).over(up)}).where("point is not null")
    left, right = F.col("at_ms") - F.col("before.t"), F.col("after.t") - F.col("at_ms")
    best = F.when(F.col("after").isNull() | (left <= right), F.col("before")).otherwise(F.col("after"))
    return placed.withColumn("m", best).select("video_id", F.col("point").alias("idx"), F.col("m.id").alias("mark"), F.col("m.t").alias("mark_ms"))


def holding_segment(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Each point (video_id, idx, at_ms) with the start of the disjoint segment [seg_start, seg_end) that holds it; null outside all."""
    asked = points.select("video_id", "at_ms", "idx", F.lit(None).cast("long").alias("end_ms"))
    both = asked.unionByName(segments.select("video_id", F.col("seg_start").alias("at_ms"), F.lit(None).cast("long").alias("idx"), F.col("seg_end").alias("end_ms")))
    w = Window.partitionBy("video_id").orderBy("at_ms", F.col("idx").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("end_ms").isNotNull(), F.struct(F.col("at_ms").alias("a"), F.col("end_ms").alias("b")))
    placed = both.withColumn("s", F.last(opened, True).over(w)).where("idx is not null")
    return placed.select("video_id", "idx", F.when(F.col("at_ms") < F.col("s.b"), F.col("s.a")).alias("seg_start"))
