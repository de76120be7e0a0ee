"""Units seen from windows: visibility, runs that share a target, stitched windows, window edges, clocks of cut streams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.operators import intervals as iv

RUN = "struct<start_ms:bigint,end_ms:bigint,texts:array<string>>"


def visibility(a: str, b: str) -> Column:
    """How much of a span the window [a, b) shows: complete, only its start (right cut), only its end (left cut), its middle (both), outside."""
    starts = (F.col("start_ms") >= F.col(a)) & (F.col("start_ms") < F.col(b))
    ends = (F.col("end_ms") > F.col(a)) & (F.col("end_ms") < F.col(b))
    middle = (F.col("start_ms") < F.col(a)) & (F.col("end_ms") > F.col(b))
    return F.when(starts & ends, "complete").when(starts, "right").when(ends, "left").when(middle, "both").otherwise("outside")


def is_complete(a: str, b: str, tail_ms: int, least_ms: int) -> Column:
    """A trusted span of at least ``least_ms`` that ends ``tail_ms`` or more before its window does."""
    inside = (F.col("start_ms") >= F.col(a)) & (F.col("end_ms") + tail_ms <= F.col(b))
    return F.col("reliable") & (F.col("end_ms") - F.col("start_ms") >= least_ms) & inside


def join_runs(units: DataFrame, gap_ms: int, most_ms: int | None, separator: str) -> DataFrame:
    """Runs of trusted units that may share one text target, as one span each.

    The next unit starts at most ``gap_ms`` after the one before ends, no other unit, trusted or not, starts before it and
    ends after the one before, and a run spans at most ``most_ms``.  The first two rules look at neighbours only, so windows
    cut a video into chains; only the last needs a fold, over a chain.  A run ends where its last unit does.  A null text is empty.
    """
    started = Window.partitionBy("video_id").orderBy("start_ms").rangeBetween(Window.unboundedPreceding, -1)
    whole = units.withColumn("reached", F.max("end_ms").over(started)).where("reliable")
    w = iv.by_video()
    before = F.lag("end_ms").over(w)
    breaks = before.isNull() | (F.col("start_ms") - before > gap_ms) | F.coalesce(F.col("reached") > before, F.lit(False))
    chained = whole.withColumn("fresh", breaks.cast("int")).withColumn("chain", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.coalesce("text", F.lit("")).alias("text")
    grouped = chained.groupBy("video_id", "chain").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "idx", text))).alias("units"))

    def step(done: Column, u: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start_ms"].alias("start_ms"), u["end_ms"].alias("end_ms"), F.concat(last["texts"], F.array(u["text"])).alias("texts"))
        new = F.struct(u["start_ms"].alias("start_ms"), u["end_ms"].alias("end_ms"), F.array(u["text"]).alias("texts"))
        fits = F.size(done) > 0
        if most_ms is not None:
            fits = fits & (u["end_ms"] - last["start_ms"] <= most_ms)
        kept = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(fits, F.concat(kept, F.array(longer))).otherwise(F.concat(done, F.array(new))).cast(f"array<{RUN}>")

    runs = grouped.select("video_id", F.explode(F.aggregate("units", F.array().cast(f"array<{RUN}>"), step)).alias("r"))
    return runs.select("video_id", "r.start_ms", "r.end_ms", F.array_join("r.texts", f" {separator} ").alias("text"), F.size("r.texts").cast("long").alias("n_units"))


def stitched_windows(streams: DataFrame, size: int) -> DataFrame:
    """Windows that advance by half their size over each stream (video_id, n_frames), and the frames that each one decides.

    A window keeps its inner half; the last is moved back to end with the stream.  A stream without frames has none.
    """
    stride = max(1, size // 2)
    margin = (size - stride) // 2
    last = F.greatest(F.ceil((F.col("n_frames") - size) / stride), F.lit(0)).cast("long")
    each = streams.where("n_frames > 0").withColumn("last", last).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    final = F.col("k") == F.col("last")
    kept = lambda k: k * stride + size - margin
    first = F.when(final, F.greatest(F.col("n_frames") - size, F.lit(0))).otherwise(F.col("k") * stride)
    return each.select(
        "video_id",
        first.alias("first_frame"),
        F.when(final, F.col("n_frames")).otherwise(F.col("k") * stride + size).alias("end_frame"),
        F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(kept(F.col("k") - 1)).alias("write_from"),
        F.when(final, F.col("n_frames")).otherwise(kept(F.col("k"))).alias("write_to"),
    )


def band_frames(radius_s: float, fps: float, slack_s: float = 1e-4) -> int:
    """How many frames away a band of this radius reaches."""
    return math.floor((radius_s + slack_s) * fps)


def band_radius_s(reach_frames: int, depth: int, horizon_s: float, fps: float, slack: float = 1e-6) -> float:
    """The widest band of whole frames with which ``depth`` layers after ``reach_frames`` look no further ahead than the horizon."""
    band = math.floor((horizon_s * fps - reach_frames + slack) / depth)
    if band < 1:
        raise ValueError(f"at {fps:g} frames a second no band fits a horizon of {horizon_s:g} s")
    return band / fps


def edge_reach(times: Column, reach: int, radius_ms: int, depth: int) -> Column:
    """(lo, hi): frames up to lo and from hi on depend on what lies beyond the window; ``times`` ascends.  -1 and 0 without frames."""
    n = F.size(times)
    lo, hi = F.least(F.lit(reach), n - 1), F.greatest(n - 1 - reach, F.lit(0))
    near = lambda at: F.size(F.filter(times, lambda t: t - at <= radius_ms)) - 1
    far = lambda at: F.size(F.filter(times, lambda t: at - t > radius_ms))
    for _ in range(depth):
        lo, hi = near(F.get(times, lo)), far(F.get(times, hi))
    return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def to_source(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Events on the clocks of the segments (video_id, seg_start) they lie in, on their video's clock; each video keeps a row."""
    moved = events.select(
        "video_id", "idx", (F.col("start_ms") + F.col("seg_start")).alias("start_ms"), (F.col("end_ms") + F.col("seg_start")).alias("end_ms")
    )
    return segments.select("video_id").distinct().join(moved, "video_id", "left")


def unreferenced(units: DataFrame, streams: DataFrame, least_ms: int) -> DataFrame:
    """Stretches that no text covers, on the source's clock: long gaps, and units that are not trusted.

    ``streams`` has video_id, total_ms and offset_ms, at which a stream starts in its source.
    """
    gaps = iv.untrusted_gaps(units, least_ms, streams.select("video_id", "total_ms")).toDF("video_id", "start_ms", "end_ms")
    bad = units.where("not reliable").select("video_id", "start_ms", "end_ms")
    at = lambda c: (F.col(c) + F.col("offset_ms")).alias(c)
    return gaps.unionByName(bad).join(streams.select("video_id", "offset_ms"), "video_id").select("video_id", at("start_ms"), at("end_ms"))


def attainable_recall(units: DataFrame, floors: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold, the recall that a system with a least duration (video_id, floor_ms) can reach: shorter units match too little."""
    grid = units.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    short = (F.col("end_ms") - F.col("start_ms")).cast("double") < F.col("threshold") * F.col("floor_ms")
    lost = units.join(floors, "video_id").crossJoin(F.broadcast(grid)).groupBy("threshold").agg(F.count_if(short).alias("unreachable"), F.count("*").alias("n_units"))
    return lost.withColumn("most_recall", 1 - F.col("unreachable") / F.greatest("n_units", F.lit(1)))
