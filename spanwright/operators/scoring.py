"""Scores of matches on two levels: per video, then over videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_scores(matches: DataFrame, events: DataFrame, units: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold, and their average row (threshold null).

    The match was made once at the lowest threshold; a higher one filters it.  Precision is a mean over videos with
    events, recall over videos with units, and F1 is that of the two means.
    """
    grid = events.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    n_events = events.groupBy("video_id").agg(F.count("*").alias("n_events"))
    n_units = units.groupBy("video_id").agg(F.count("*").alias("n_units"))
    hits = (
        matches.join(F.broadcast(grid), F.col("tiou") >= F.col("threshold"))
        .groupBy("video_id", "threshold")
        .agg(F.count("*").alias("tp"), F.sum(F.col("last_unit") - F.col("first_unit") + 1).alias("covered"))
    )
    videos = n_events.join(n_units, "video_id", "full").crossJoin(F.broadcast(grid))
    cells = videos.join(hits, ["video_id", "threshold"], "left").select(
        "threshold",
        (F.coalesce("tp", F.lit(0)) / F.col("n_events")).alias("p"),
        (F.coalesce("covered", F.lit(0)) / F.col("n_units")).alias("r"),
    )
    rows = cells.groupBy("threshold").agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"))
    mean = rows.agg(F.lit(None).cast("double").alias("threshold"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    return rows.union(mean).select(
        "threshold", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round(f1, 9).alias("f1")
    )


#: Stands for no limit on edges: no edge is off by more.
NO_LIMIT = (1 << 63) - 1


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def edge_grid(counted: DataFrame, events: DataFrame, units: DataFrame, taus_ms: list[int], thresholds: list[float]) -> DataFrame:
    """(scope, tau_ms, threshold, precision, recall, f1): the cells of edge limit and overlap, and their margins.

    ``counted`` comes from ``matching.with_edges``.  Scopes are cell, by_tau, by_tiou and avg over the limits, and free_cell and free_avg
    without a limit.  A margin takes the means of precision and recall and the F1 of these.  A match adds its share of
    its video's events and units to each cell it counts in, so videos without matches need no rows; they are in the counts.
    """
    spark = events.sparkSession
    grid = F.broadcast(spark.createDataFrame([(t, float(h)) for t in [*taus_ms, NO_LIMIT] for h in thresholds], "tau_ms long, threshold double"))
    n_events = events.groupBy("video_id").agg(F.count("*").alias("n_events"))
    n_units = units.groupBy("video_id").agg(F.count("*").alias("n_units"))
    videos = F.broadcast(n_events.agg(F.count("*").alias("v_events")).crossJoin(n_units.agg(F.count("*").alias("v_units"))))
    parts = counted.join(n_events, "video_id").join(n_units, "video_id").select("tiou", "edge_ms", (1 / F.col("n_events")).alias("p"), (F.col("run") / F.col("n_units")).alias("r"))
    counts = (F.col("tiou") >= F.col("threshold")) & (F.col("edge_ms") <= F.col("tau_ms"))
    summed = parts.crossJoin(grid).where(counts).groupBy("tau_ms", "threshold").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    share = lambda c, n: F.coalesce(F.col(c) / F.nullif(F.col(n), F.lit(0)), F.lit(0.0)).alias(c)
    # the sums have at most a row a cell, so the cells without a match join them and not the matches
    summed = grid.join(F.broadcast(summed), ["tau_ms", "threshold"], "left").crossJoin(videos).select("tau_ms", "threshold", share("p", "v_events"), share("r", "v_units"))
    limited = F.col("tau_ms") < NO_LIMIT
    means = [F.avg("p").alias("p"), F.avg("r").alias("r")]
    names = lambda *each: F.element_at(F.array(*[F.lit(n) for n in each]), F.grouping_id().cast("int") + 1)
    # the grouping id has a bit for each column that a row sums over: 0 none, 1 thresholds, 2 limits, 3 both
    inner = summed.where(limited).groupingSets([["tau_ms", "threshold"], ["tau_ms"], ["threshold"], []], "tau_ms", "threshold").agg(names("cell", "by_tau", "by_tiou", "avg").alias("scope"), *means)
    free = summed.where(~limited).groupingSets([["threshold"], []], "threshold").agg(names("free_cell", "free_avg").alias("scope"), *means).withColumn("tau_ms", F.lit(None).cast("long"))
    rounded = [F.round(F.col(c), 9).alias(n) for c, n in (("p", "precision"), ("r", "recall"))]
    return inner.unionByName(free).select("scope", "tau_ms", "threshold", *rounded, F.round(_f1(F.col("p"), F.col("r")), 9).alias("f1"))


def class_cells(counted: DataFrame, units: DataFrame, touched: DataFrame, taus_ms: list[int], thresholds: list[float]) -> DataFrame:
    """Per ``class`` of unit: units, the mean over the cells of the share that a counted match holds, and units that no event touches.

    ``units`` have video_id, unit and class; ``touched`` the video_id and unit of those that an event overlaps.
    Matches of an event whose id stands for several add up.
    """
    cells = [(t, float(h)) for t in taus_ms for h in thresholds]
    grid = F.array(*[F.struct(F.lit(t).cast("long").alias("tau"), F.lit(h).alias("threshold")) for t, h in cells])
    within = F.size(F.filter(grid, lambda g: (F.col("tiou") >= g["threshold"]) & (F.col("edge_ms") <= g["tau"])))
    held = counted.select("video_id", F.explode(F.sequence("first_unit", "last_unit")).alias("unit"), within.alias("cells"))
    held = held.groupBy("video_id", "unit").agg((F.sum("cells") / len(cells)).alias("part"))
    seen = units.join(held, ["video_id", "unit"], "left").join(touched.withColumn("touched", F.lit(True)), ["video_id", "unit"], "left")
    return seen.groupBy("class").agg(
        F.count("*").alias("units"), F.round(F.avg(F.coalesce("part", F.lit(0.0))), 9).alias("matched_share"), F.count_if(F.col("touched").isNull()).alias("uncaptioned")
    )


def flips(a: DataFrame, b: DataFrame, margin: float) -> DataFrame:
    """One row: units that only a or only b locates, and of those both locate the ones whose score differs by over ``margin``.

    Both sides have video_id, unit and score, one row for each unit that the system locates.
    """
    both = a.withColumnRenamed("score", "sa").join(b.withColumnRenamed("score", "sb"), ["video_id", "unit"], "full")
    rise = F.col("sa") - F.col("sb")
    return both.agg(
        F.count_if(F.col("sb").isNull()).alias("fixed"), F.count_if(F.col("sa").isNull()).alias("broken"), F.count_if(rise > margin).alias("better"), F.count_if(rise < -margin).alias("worse")
    )


def segment_scores(matches: DataFrame, events: DataFrame, units: DataFrame, thresholds: list[float]) -> DataFrame:
    """One row a threshold: two-level precision, recall and F1 of single spans, what stayed alone, and the overlaps of the matches.

    ``matches`` were made once at the lowest threshold; as the best overlap goes first, those above a higher one are the same.
    """
    spark = events.sparkSession
    grid = F.broadcast(spark.createDataFrame([(float(h),) for h in thresholds], "threshold double"))
    n_events = events.groupBy("video_id").agg(F.count("*").alias("n_events"))
    n_units = units.groupBy("video_id").agg(F.count("*").alias("n_units"))
    sizes = n_events.agg(F.count("*").alias("v_events"), F.sum("n_events").alias("n_events")).crossJoin(n_units.agg(F.count("*").alias("v_units"), F.sum("n_units").alias("n_units")))
    parts = matches.join(n_events, "video_id").join(n_units, "video_id").select("tiou", (1 / F.col("n_events")).alias("p"), (1 / F.col("n_units")).alias("r"))
    found = parts.join(grid, F.col("tiou") >= F.col("threshold")).groupBy("threshold").agg(
        F.count("*").alias("n"), F.sum("p").alias("p"), F.sum("r").alias("r"), F.round(F.avg("tiou"), 9).alias("mean_tiou"),
        *[F.round(F.percentile("tiou", F.lit(q)), 9).alias(f"p{round(100 * q)}_tiou") for q in (0.0, 0.25, 0.5, 0.75, 1.0)],
    )
    whole = grid.join(F.broadcast(found), "threshold", "left").crossJoin(F.broadcast(sizes))
    p, r = (F.coalesce(F.col(c) / F.col(n), F.lit(0.0)) for c, n in (("p", "v_events"), ("r", "v_units")))
    n = F.coalesce("n", F.lit(0))
    return whole.select(
        "threshold", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(_f1(p, r), 9).alias("f1"),
        (F.col("n_events") - n).alias("unmatched_events"), (F.col("n_units") - n).alias("missed_units"), "mean_tiou", *[f"p{q}_tiou" for q in (0, 25, 50, 75, 100)],
    )


def held_latency(holders: DataFrame) -> DataFrame:
    """Median, mean and nearest-rank 90 % of commit minus end of unit, in seconds; rank by half-even rounding."""
    values = holders.where("commit_ms is not null").select(((F.col("commit_ms") - F.col("end_ms")) / 1000.0).alias("x"))
    n = values.count()
    at = min(n - 1, round(0.9 * (n - 1))) if n else 0  # Python rounds halves to even
    share = at / (n - 1) if n > 1 else 0.0
    return values.agg(
        F.count("*").alias("n"),
        F.round(F.percentile("x", F.lit(0.5)), 6).alias("median_s"),
        F.round(F.avg("x"), 6).alias("mean_s"),
        F.round(F.percentile("x", F.lit(share)), 6).alias("p90_s"),
    )
