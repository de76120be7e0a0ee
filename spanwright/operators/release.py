"""Coordinates relative to the shoulders, their table of means and deviations, velocities, and frames that repeat others."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.operators import intervals as iv
from spanwright.operators.poses import SEEN

#: Frequencies, in cycles a frame, off every line that a pulldown makes; most frames in one pattern of repeats.
QUIET = (0.137, 0.233, 0.271, 0.311, 0.371, 0.429, 0.457)
MOST_PATTERN = 12


def by_shoulders(frames: DataFrame, clip: int, parts: list[tuple[list[int], int]], hidden: list[int], aspect: float | None = None) -> DataFrame:
    """(stream_id, frame, xy): points 0 and 1 are the shoulders; every point relative to their mean place and mean distance in its clip.

    Points of a part are relative to its root in the same frame, hidden points are 0.  Unseen points are null, as is a part whose
    root is unseen, and every point of a clip that never shows both shoulders.  ``aspect`` divides y first.
    """
    place = lambda p: F.when(p["c"] > SEEN, F.struct(p["x"].alias("x"), (p["y"] / (aspect or 1.0)).alias("y")))
    seen = frames.select("stream_id", "frame", F.floor(F.col("frame") / clip).alias("_clip"), F.transform("kp", place).alias("_p"))
    a, b = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    both = lambda c: F.when(a.isNotNull() & b.isNotNull(), c)
    whole = Window.partitionBy("stream_id", "_clip")
    wide = F.avg(both(F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2)))).over(whole)
    mid = {f"_m{c}": F.avg(both((a[c] + b[c]) / 2)).over(whole) for c in "xy"}
    scaled = seen.withColumns(mid | {"_wide": wide}).withColumn("_wide", F.when(F.col("_wide") > 0, F.col("_wide")).when(F.col("_wide") == 0, 1.0))
    root_of = {i: root for at, root in parts for i in at}

    def point(p: Column, i: Column) -> Column:
        root = F.lit(None).cast("int")
        for k, r in root_of.items():
            root = F.when(i == k, r).otherwise(root)
        off = F.get("_p", root)
        value = lambda c: F.when(i.isin(hidden), 0.0).when(root.isNull(), (p[c] - F.col(f"_m{c}")) / F.col("_wide")).otherwise((p[c] - off[c]) / F.col("_wide"))
        made = F.struct(value("x").alias("x"), value("y").alias("y"))
        return F.when(F.col("_wide").isNotNull() & made["x"].isNotNull(), made)

    return scaled.select("stream_id", "frame", F.transform("_p", point).alias("xy"))


def point_table(shaped: DataFrame) -> DataFrame:
    """(point, mx, my, sx, sy): mean and deviation of each point over all frames that show it; a row a point."""
    flat = shaped.select(F.posexplode("xy").alias("point", "p")).where("p is not null")
    spread = lambda c: F.sqrt(F.greatest(F.avg(c * c) - F.avg(c) * F.avg(c), F.lit(0.0)))
    x, y = F.col("p.x"), F.col("p.y")
    return flat.groupBy("point").agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), spread(x).alias("sx"), spread(y).alias("sy"))


def standardised(shaped: DataFrame, stats: DataFrame) -> DataFrame:
    """(stream_id, frame, xy) by the table ``stats``, one small row a point; points without a place are 0, a deviation of 0 divides by 1."""
    packed = stats.agg(F.map_from_entries(F.collect_list(F.struct("point", F.struct("mx", "my", "sx", "sy")))).alias("_stats"))
    div = lambda s: F.when(s > 1e-6, s).otherwise(1.0)

    def point(p: Column, i: Column) -> Column:
        s = F.col("_stats")[i]
        value = lambda c: F.coalesce((p[c] - s[f"m{c}"]) / div(s[f"s{c}"]), F.lit(0.0)).alias(c)
        return F.struct(value("x"), value("y"))

    return shaped.crossJoin(F.broadcast(packed)).select("stream_id", "frame", F.transform("xy", point).alias("xy"))


def with_velocity(coords: DataFrame, fps: float) -> DataFrame:
    """Adds ``v``: the change of each point since the frame before, a second; 0 in a stream's first frame."""
    w = Window.partitionBy("stream_id").orderBy("frame")
    step = F.greatest((F.col("frame") - F.col("_at")) / fps, F.lit(1e-6))
    still = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    moved = F.zip_with("xy", "_before", lambda p, q: F.struct(((p["x"] - q["x"]) / step).alias("x"), ((p["y"] - q["y"]) / step).alias("y")))
    seen = coords.withColumns({"_before": F.lag("xy").over(w), "_at": F.lag("frame").over(w)})
    return seen.withColumn("v", F.when(F.col("_at").isNull(), F.transform("xy", lambda p: still)).otherwise(moved)).drop("_before", "_at")


def patterns(stored_fps: float, rates: list[float]) -> list[tuple[float, int, int]]:
    """(rate, n, m): m of n stored frames are repeats where content of that rate fills the stored one; to a tenth of a frame."""
    found = []
    for rate in rates:
        near = [(n, round(n * (1 - rate / stored_fps))) for n in range(1, MOST_PATTERN + 1)]
        fits = [(n, m) for n, m in near if m >= 1 and abs(n * (1 - rate / stored_fps) - m) < 0.1]
        found += [(rate, *fits[0])] if rate < stored_fps and fits else []
    return found


def content_frames(motion: DataFrame, stored_fps: float, rates: list[float], line_ratio: float, most_share: float) -> DataFrame:
    """(stream_id, frame) of the frames with new content, for streams that repeat frames to fill their rate; no row for others.

    ``motion`` has the motion into each frame, null where unknown.  Repeats make it periodic: a rate's line in its spectrum has to
    exceed ``line_ratio`` times the median of quiet frequencies, and the strongest line names the pattern.  In each window of
    the pattern the stillest frames go, if in the median they move at most ``most_share`` times as much as those that stay;
    one that moves more than that stays in any case.
    """
    known = patterns(stored_fps, rates)
    if not known:
        return motion.select("stream_id", "frame").limit(0)
    typical = motion.groupBy("stream_id").agg(F.median("motion").alias("_typical"), F.count("motion").alias("_n"), F.sum("motion").alias("_sum"))
    filled = motion.join(typical.where("_n >= 2 and _sum > 0").select("stream_id", "_typical"), "stream_id").withColumn("_x", F.coalesce("motion", "_typical"))

    def line(cycles: float) -> Column:
        turn = 2 * math.pi * cycles * F.col("frame")
        return F.sqrt(F.pow(F.sum(F.col("_x") * F.cos(turn)), 2) + F.pow(F.sum(F.col("_x") * F.sin(turn)), 2)) / F.sum("_x")

    folded = lambda rate: min(rate / stored_fps % 1, 1 - rate / stored_fps % 1)
    floor = F.sort_array(F.array(*[line(q) for q in QUIET]))[len(QUIET) // 2]
    best = F.array_max(F.array(*[F.struct(line(folded(rate)).alias("line"), F.lit(n).alias("n"), F.lit(m).alias("m")) for rate, n, m in known]))
    named = filled.groupBy("stream_id").agg(floor.alias("_floor"), best.alias("_best")).where(F.col("_best.line") > line_ratio * F.col("_floor"))
    cut = motion.join(named.select("stream_id", "_best.n", "_best.m").toDF("stream_id", "_n", "_m"), "stream_id").withColumn("_win", F.floor(F.col("frame") / F.col("_n")))
    window = Window.partitionBy("stream_id", "_win")
    place = F.row_number().over(window.orderBy(F.asc_nulls_last("motion"), "frame"))
    size = F.count("*").over(window)
    marked = cut.withColumn("_goes", place <= F.rint(size * F.col("_m") / F.col("_n")))
    moved = marked.groupBy("stream_id").agg(
        F.median(F.when(~F.col("_goes"), F.col("motion"))).alias("_stay"), F.median(F.when(F.col("_goes"), F.col("motion"))).alias("_go")
    )
    sure = moved.select("stream_id", (F.col("_stay") * most_share).alias("_limit"), "_go").where("_go <= _limit")
    stays = ~F.col("_goes") | F.col("motion").isNull() | (F.col("motion") > F.col("_limit"))
    return marked.join(sure, "stream_id").where(stays).select("stream_id", "frame")


def grid_runs(runs: DataFrame, stored: DataFrame, source_fps: int, fps: int) -> DataFrame:
    """(stream_id, a, b): half-open runs of stored frames as runs on a grid of another whole rate.

    A grid frame is inside if the stored frame nearest to it is, the last one for grid frames past the end.  ``stored``
    has stream_id, stored and grid (frames of each).  In whole numbers, without a row a frame; runs that touch on the grid are one.
    """
    first = lambda c: F.greatest(F.ceil((2 * F.col(c) - 1) * fps / F.lit(2 * source_fps)), F.lit(0))
    end = F.when(F.col("b") >= F.col("stored"), F.col("grid")).otherwise(F.least(first("b"), F.col("grid")))
    start = F.when(F.col("a") >= F.col("stored"), F.col("grid")).otherwise(F.least(first("a"), F.col("grid")))
    moved = runs.join(stored, "stream_id").select(F.col("stream_id").alias("video_id"), start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), F.col("a").alias("idx"))
    whole = iv.merged_runs(moved.where("end_ms > start_ms"))
    return whole.select(F.col("video_id").alias("stream_id"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
