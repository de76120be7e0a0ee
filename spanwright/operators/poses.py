"""Key points frame by frame: boxes, normalisation, motion, runs of empty frames, resampling.

A frame has stream_id, frame and kp, an array of structs (x, y, c); all expressions stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a point counts as seen above this confidence.
SEEN = 0.3
#: Fixed value: seconds that differ by less than this part of a frame are the same.
SLACK = 0.01


def seconds_to_frames(seconds: Column, fps: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(seconds * fps - SLACK)).cast("long")


def window_frames(start_s: Column, end_s: Column, fps: Column) -> Column:
    """Half-open frames of a window, as a struct (a, b)."""
    return F.struct(F.floor(start_s * fps + SLACK).alias("a"), F.ceil(end_s * fps - SLACK).alias("b"))


def grid_length(stored: Column, fps: Column, source_fps: Column) -> Column:
    """Frames of a stream of ``stored`` frames on another rate's grid."""
    return F.greatest(F.lit(0), F.ceil((stored - 0.5) * fps / source_fps)).cast("long")


def stored_frame(k: Column, stored: Column, fps: Column, source_fps: Column) -> Column:
    """The stored frame that a grid frame shows."""
    return F.least(F.floor(k * source_fps / fps + 0.5), stored - 1).cast("long")


def resample(frames: DataFrame, streams: DataFrame, fps: float) -> DataFrame:
    """Frames on a grid of ``fps``; ``streams`` has stream_id, stored and source_fps.  Grid frames look their stored ones up."""
    n = grid_length(F.col("stored"), F.lit(fps), F.col("source_fps"))
    grid = streams.where("stored > 0").withColumn("grid", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    grid = grid.withColumn("frame", stored_frame(F.col("grid"), F.col("stored"), F.lit(fps), F.col("source_fps")))
    return grid.join(frames, ["stream_id", "frame"]).select("stream_id", F.col("grid").alias("frame"), "kp")


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))


def clean_points(frames: DataFrame) -> DataFrame:
    """Numbers that are null or not finite become 0, and so unseen."""
    point = lambda p: F.struct(_finite(p["x"]).alias("x"), _finite(p["y"]).alias("y"), _finite(p["c"]).alias("c"))
    return frames.withColumn("kp", F.transform("kp", point))


def visible_body(kp: Column, edge: float = 0.25) -> Column:
    """Points that are not seen, or lie further than ``edge`` outside the picture, become zeros."""
    inside = lambda v: v.between(-edge, 1 + edge)
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("c"))
    return F.transform(kp, lambda p: F.when((p["c"] > SEEN) & inside(p["x"]) & inside(p["y"]), p).otherwise(zero))


def body_boxes(frames: DataFrame, window: int, least: int = 4) -> DataFrame:
    """(stream_id, window, left, top, scale): the square around all seen points of each window of frames; scale 0 if too few."""
    at = F.floor(F.col("frame") / window).cast("long").alias("window")
    points = frames.select("stream_id", at, F.explode("kp").alias("p")).where(F.col("p.c") > SEEN)
    lo, hi = lambda c: F.min(f"p.{c}"), lambda c: F.max(f"p.{c}")
    box = points.groupBy("stream_id", "window").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{s}") for c in "xy" for f, s in ((lo, "0"), (hi, "1"))])
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    scale = F.when(F.col("n") >= least, side).otherwise(0.0)
    return box.select("stream_id", "window", ((F.col("x0") + F.col("x1") - side) / 2).alias("left"), ((F.col("y0") + F.col("y1") - side) / 2).alias("top"), scale.alias("scale"))


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))


def normalise(frames: DataFrame, window: int, body: list[int], parts: list[tuple[list[int], int]], least: int = 4) -> DataFrame:
    """Body points scaled into their window's square, then each part about its anchor point and by the body's scale.

    All is clipped to [-1, 1]; unseen points and windows without a body are zeros.  ``body`` and the parts list positions
    in ``kp``; an anchor is a position in ``kp`` too.
    """
    clean = clean_points(frames)
    pick = lambda at: F.array(*[F.get("kp", F.lit(i)) for i in at])
    boxes = body_boxes(clean.withColumn("kp", pick(body)), window, least)
    placed = clean.withColumn("window", F.floor(F.col("frame") / window).cast("long")).join(boxes, ["stream_id", "window"], "left")
    there = F.coalesce(F.col("scale") > 0, F.lit(False))

    def point(p: Column, x: Column, y: Column) -> Column:
        seen = there & (p["c"] > SEEN)
        value = lambda v: F.when(seen, _clip(v)).otherwise(0.0)
        return F.struct(value(x).alias("x"), value(y).alias("y"), value(p["c"]).alias("c"))

    square = lambda v, edge: ((v - F.col(edge)) / F.col("scale") - 0.5) * 2
    made = [F.transform(pick(body), lambda p: point(p, square(p["x"], "left"), square(p["y"], "top")))]


    def about(a: Column):
        return lambda p: point(p, (p["x"] - a["x"]) / F.col("scale"), (p["y"] - a["y"]) / F.col("scale"))

    made += [F.transform(pick(at), about(F.get("kp", F.lit(anchor)))) for at, anchor in parts]
    return placed.select("stream_id", "frame", F.concat(*made).alias("kp"))


def motion(frames: DataFrame) -> DataFrame:
    """(stream_id, frame, motion): median way of the points seen in this frame and the one before; null where there is none."""
    w = Window.partitionBy("stream_id").orderBy("frame")
    seen = frames.withColumn("before", F.lag("kp").over(w))
    way = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))
    steps = F.zip_with("kp", "before", lambda p, q: F.when((p["c"] > SEEN) & (q["c"] > SEEN), way(p, q)))
    sorted_ = F.array_sort(F.filter(steps, lambda x: x.isNotNull()))
    n = F.size("steps")
    middle = (F.get("steps", F.floor((n - 1) / 2).cast("int")) + F.get("steps", F.floor(n / 2).cast("int"))) / 2
    return seen.withColumn("steps", sorted_).select("stream_id", "frame", F.when(n > 0, middle).alias("motion"))


def moving_mean(values: DataFrame, column: str, width: int) -> DataFrame:
    """Centred mean of what is there in ``width`` frames; null where at most half of the window is."""
    left = width // 2
    w = Window.partitionBy("stream_id").orderBy("frame").rowsBetween(-left, width - 1 - left)
    enough = F.count(column).over(w) > width / 2
    return values.withColumn("mean", F.when(enough, F.avg(column).over(w)))


def flag_runs(flags: DataFrame, gap: int, least: int) -> DataFrame:
    """(stream_id, a, b): half-open runs of flagged frames; runs less than ``gap`` apart merge, then short ones go."""
    w = Window.partitionBy("stream_id").orderBy("frame")
    on = flags.where("flag")
    fresh = F.coalesce(F.col("frame") - F.lag("frame").over(w) - 1 >= F.greatest(F.lit(gap), F.lit(1)), F.lit(True)).cast("int")
    numbered = on.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("stream_id", "run").agg(F.min("frame").alias("a"), (F.max("frame") + 1).alias("b"))
    return runs.where(F.col("b") - F.col("a") >= least).select("stream_id", "a", "b")


def drawn(a: Column, b: Column, seed: int) -> Column:
    """A number in [0, 1) that looks random but follows from two ids and a seed alone, on any partitioning."""
    mixed = (a * 7919 + b * 104_729 + seed * 15_485_863) % 2_147_483_648
    for _ in range(2):
        mixed = (mixed * 1_103_515_245 + 12_345) % 2_147_483_648
    return mixed / 2_147_483_648.0


def thinned(frames: DataFrame, streams: DataFrame, target_fps: float) -> DataFrame:
    """Evenly fewer frames of streams (stream_id, stored, source_fps) that run over 5 % faster than the target; their times stay.

    The first and the last frame stay too, halves go to the even frame, and ``place`` is the place in the result.
    """
    n = F.greatest(F.lit(1), F.bround(F.col("stored") * target_fps / F.col("source_fps")).cast("long"))
    faster = F.col("source_fps") > target_fps * 1.05
    places = streams.where("stored > 0").withColumn("n", F.when(faster, n).otherwise(F.col("stored")))
    places = places.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = F.bround(F.col("place") * (F.col("stored") - 1) / F.greatest(F.lit(1), F.col("n") - 1)).cast("long")
    return places.select("stream_id", "place", F.when(faster, at).otherwise(F.col("place")).alias("frame")).join(frames, ["stream_id", "frame"])


def drop_frames(frames: DataFrame, most: float, seed: int) -> DataFrame:
    """Without a drawn share, below ``most``, of each stream's inner frames; both ends stay."""
    whole = Window.partitionBy("stream_id")
    inner = (F.col("frame") > F.min("frame").over(whole)) & (F.col("frame") < F.max("frame").over(whole))
    seen = frames.withColumn("inner", inner).withColumn("n_inner", F.count_if("inner").over(whole))
    n_drop = F.floor(F.col("n_inner") * most * drawn(F.col("stream_id"), F.lit(0), seed))
    order = Window.partitionBy("stream_id", "inner").orderBy(drawn(F.col("stream_id"), F.col("frame") + 1, seed), "frame")
    ranked = seen.withColumn("place", F.row_number().over(order))
    return ranked.where(~F.col("inner") | (F.col("place") > n_drop)).select(*frames.columns)


def drop_parts(frames: DataFrame, parts: list[list[int]], probability: float, seed: int) -> DataFrame:
    """Each part (places in ``kp``) of a stream goes unseen throughout with this probability."""
    kp = F.col("kp")
    for i, at in enumerate(parts):
        gone = drawn(F.col("stream_id"), F.lit(i + 1), seed) < probability
        unseen = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("c"))
        kp = F.when(gone, F.transform(kp, _masked(at, unseen))).otherwise(kp)
    return frames.withColumn("kp", kp)


def _masked(at: list[int], unseen):
    return lambda p, k: F.when(k.isin(at), unseen(p)).otherwise(p)
