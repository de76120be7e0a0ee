"""Hands of a signer: which found hand belongs to which wrist, and how much the hands move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.operators.poses import moving_mean


def claimed(left: Column, right: Column, hands: Column, gate: float) -> Column:
    """``left`` and ``right``: the index of the hand of each wrist, null where none lies nearer than ``gate``.

    Points are structs of x and y.  Most wrists with a hand first, then the least way in sum, then the lower indices; a hand
    has one wrist, an unseen wrist (null) has no hand.  All pairs of one picture's hands are weighed, within the row.
    """
    way = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))

    def near(wrist: Column) -> Column:
        offers = F.transform(hands, lambda h, i: F.struct(i.alias("at"), way(wrist, h).alias("way")))
        none = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0.0).alias("way"))
        return F.concat(F.filter(offers, lambda o: o["way"] < gate), F.array(none))

    def weigh(a: Column, b: Column) -> Column:
        n = a["at"].isNotNull().cast("int") + b["at"].isNotNull().cast("int")
        return F.struct((-n).alias("n"), (a["way"] + b["way"]).alias("way"), a["at"].alias("left"), b["at"].alias("right"))

    pairs = F.flatten(F.transform(near(left), lambda a: F.transform(near(right), lambda b: weigh(a, b))))
    best = F.array_min(F.filter(pairs, lambda p: ~F.coalesce(p["left"] == p["right"], F.lit(False))))
    return F.struct(best["left"].alias("left"), best["right"].alias("right"))


def activity(frames: DataFrame, fps: float, most: float, widths: list[int]) -> DataFrame:
    """(stream_id, frame, activity): the way of the faster hand a second, in widths of the shoulders, at most ``most``, smoothed.

    ``frames`` has a row for every frame: ``hands``, an array of two structs x, y and kind, null where a hand is absent, and
    ``width``, that of the shoulders or null.  A hand whose kind of point changes has not moved.  A stream's width is its median;
    without one above 0 its activity is unknown, as it is where a mean has too few steps.
    """
    w = Window.partitionBy("stream_id").orderBy("frame")
    size = frames.groupBy("stream_id").agg(F.median("width").alias("_size"))
    seen = frames.withColumns({"_before": F.lag("hands").over(w), "_at": F.lag("frame").over(w)}).join(size, "stream_id")
    way = lambda p, q: F.when(p["kind"] == q["kind"], F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2)))
    faster = F.greatest(*[way(F.get("hands", F.lit(k)), F.get("_before", F.lit(k))) for k in range(2)])
    speed = F.when((F.col("_size") > 0) & (F.col("frame") - F.col("_at") == 1) & faster.isNotNull(), F.least(faster * fps / F.col("_size"), F.lit(most)))
    out = seen.select("stream_id", "frame", speed.alias("activity"))
    for width in widths:
        out = moving_mean(out, "activity", width).select("stream_id", "frame", F.col("mean").alias("activity"))
    return out
