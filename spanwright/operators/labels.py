"""Frame tags: decoding, spans by two automata, frame scores.  Tags are 0 unknown, 1 outside, 2 begin, 3 inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.operators import matching

UNK, O, B, I = 0, 1, 2, 3  # noqa: E741


def argmax_tags(logits: DataFrame) -> DataFrame:
    """(stream_id, frame, tag) from (stream_id, frame, scores); the first of equal scores wins."""
    return logits.select("stream_id", "frame", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("tag"))


def complete_spans(tags: DataFrame) -> DataFrame:
    """Spans with a terminator: open on B, or on I after O; close on O, B or unknown.

    While one is open no other can open before it closes, so each opening pairs with the next closing tag.
    """
    w = Window.partitionBy("stream_id").orderBy("frame")
    back = Window.partitionBy("stream_id").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, -1)
    closes = F.when(F.col("tag") != I, F.col("frame"))
    opens = (F.col("tag") == B) | ((F.col("tag") == I) & (F.lag("tag").over(w) == O))
    seen = tags.select("stream_id", "frame", opens.alias("opens"), F.min(closes).over(back).alias("end_frame"))
    return seen.where("opens and end_frame is not null").select("stream_id", F.col("frame").alias("start_frame"), "end_frame")


def signing_runs(tags: DataFrame) -> DataFrame:
    """Runs of B and I, inclusive ends, split at each B; an I with nothing before it opens too, and the tail is kept."""
    w = Window.partitionBy("stream_id").orderBy("frame")
    before = F.lag("tag").over(w)
    fresh = (F.col("tag") == B) | ((F.col("tag") == I) & ~F.coalesce(before.isin(B, I), F.lit(False)))
    numbered = tags.withColumn("fresh", fresh.cast("int"))
    numbered = numbered.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("tag").isin(B, I))
    return numbered.groupBy("stream_id", "run").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame")).drop("run")


def frame_metrics(pairs: DataFrame) -> DataFrame:
    """Signing precision, recall, F1, accuracy and B rates over (gold, pred) tags; frames of unknown gold are left out."""
    valid = F.col("gold") != UNK
    of = lambda c: F.count_if(valid & c)
    gold, pred = F.col("gold").isin(B, I), F.col("pred").isin(B, I)
    counted = pairs.agg(
        F.count_if(valid).alias("n"),
        of(gold & pred).alias("tp"),
        of(gold).alias("g"),
        of(pred).alias("p"),
        of(F.col("gold") == F.col("pred")).alias("same"),
        of(F.col("pred") == B).alias("pb"),
        of(F.col("gold") == B).alias("gb"),
    )
    one = F.lit(1)
    share = lambda x, y: F.col(x) / F.greatest(F.col(y), one)
    p, r = share("tp", "p"), share("tp", "g")
    return counted.select(
        F.round(p, 9).alias("precision"),
        F.round(r, 9).alias("recall"),
        F.round(2 * p * r / F.greatest(p + r, F.lit(1e-8)), 9).alias("f1"),
        F.round(share("same", "n"), 9).alias("frame_acc"),
        F.col("n").alias("valid_frames"),
        F.round(share("pb", "n"), 9).alias("pred_b_rate"),
        F.round(share("gb", "n"), 9).alias("gold_b_rate"),
    )


def frame_labels(units: DataFrame, gaps: DataFrame, streams: DataFrame, frame_ms: int) -> DataFrame:
    """(stream_id, frame, tag) on a grid of ``frame_ms``: outside, unknown in ``gaps``, then the units in order, later ones on top.

    A reliable unit is B on its first frame and I on the rest, all I if it began before the stream; an unreliable one is
    unknown throughout.  Painters meet the grid in one aggregation, without a join.
    """
    at = lambda c: F.ceil(F.col(c) / frame_ms)
    n = F.greatest(F.lit(1), F.round(F.col("total_ms") / frame_ms).cast("long"))
    frames = lambda a, b: F.explode(F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))).alias("frame")
    spine = streams.select("video_id", F.lit(-2).cast("long").alias("rank"), F.lit(O).alias("tag"), frames(F.lit(0).cast("long"), n))
    sized = streams.select("video_id", n.alias("n"))
    first = F.greatest(at("gap_start"), F.lit(0))
    unknown = gaps.join(sized, "video_id").select(
        "video_id", F.lit(-1).cast("long").alias("rank"), F.lit(UNK).alias("tag"), frames(first, F.least(at("gap_end"), F.col("n")))
    )
    w = Window.partitionBy("video_id").orderBy("start_ms", "end_ms", "idx")
    ranked = units.withColumn("rank", F.row_number().over(w).cast("long")).join(sized, "video_id")
    painted = ranked.select(
        "video_id", "rank", "reliable", "start_ms", at("start_ms").alias("opens"), frames(F.greatest(at("start_ms"), F.lit(0)), F.least(at("end_ms"), F.col("n")))
    )
    begins = (F.col("start_ms") >= 0) & (F.col("frame") == F.col("opens"))
    tag = F.when(~F.col("reliable"), UNK).when(begins, B).otherwise(I)
    every = spine.unionByName(unknown).unionByName(painted.select("video_id", "rank", tag.alias("tag"), "frame"))
    return every.groupBy(F.col("video_id").alias("stream_id"), "frame").agg(F.max_by("tag", "rank").alias("tag"))


def class_weights(tags: DataFrame) -> DataFrame:
    """(tag, n, weight): inverse root of each known tag's share, with mean weight 1 over the known frames; unknown weighs 0."""
    counted = tags.groupBy("tag").agg(F.count("*").alias("n"))
    known = F.when(F.col("tag") != UNK, F.col("n"))
    every = Window.partitionBy()
    share = known / F.sum(known).over(every)
    raw = counted.withColumn("raw", 1 / F.sqrt(share))
    scale = F.sum(known).over(every) / F.sum(F.col("raw") * known).over(every)
    return raw.select("tag", "n", F.coalesce(F.col("raw") * scale, F.lit(0.0)).alias("weight"))


def macro_frame_f1(pairs: DataFrame) -> DataFrame:
    """(stream_id, frame_f1) of (stream_id, gold, pred): mean F1 over the known tags that occur; unknown gold is left out."""
    known = pairs.where(F.col("gold") != UNK)
    parts, n = F.lit(0.0), F.lit(0)
    counts = []
    for k in (O, B, I):
        counts += [F.count_if((F.col("gold") == k) & (F.col("pred") == k)).alias(f"both{k}"), (F.count_if(F.col("gold") == k) + F.count_if(F.col("pred") == k)).alias(f"any{k}")]
        parts = parts + F.when(F.col(f"any{k}") > 0, 2 * F.col(f"both{k}") / F.col(f"any{k}")).otherwise(0.0)
        n = n + (F.col(f"any{k}") > 0).cast("int")
    return known.groupBy("stream_id").agg(*counts).select("stream_id", F.when(n > 0, parts / n).otherwise(0.0).alias("frame_f1"))


def run_scores(pairs: DataFrame, thresholds: list[float], bin_frames: int) -> DataFrame:
    """(threshold, n_streams, precision, recall, f1, n_matches, n_pred, n_gold): runs of both sides matched in each stream.

    Frames of unknown gold are unknown on both sides, so they split runs alike; a stream without a known frame is left
    out, one with no run on either side scores 1.  Runs match once at the lowest threshold.
    """
    masked = pairs.withColumn("pred", F.when(F.col("gold") == UNK, UNK).otherwise(F.col("pred")))
    known = pairs.where(F.col("gold") != UNK).select(F.col("stream_id").alias("video_id")).distinct()

    def runs(side: str) -> DataFrame:
        found = signing_runs(masked.select("stream_id", "frame", F.col(side).alias("tag")))
        w = Window.partitionBy("stream_id").orderBy("start_frame")
        return found.select(
            F.col("stream_id").alias("video_id"),
            F.row_number().over(w).cast("long").alias("idx"),
            F.col("start_frame").cast("long").alias("start_ms"),
            (F.col("end_frame") + 1).cast("long").alias("end_ms"),
        )

    gold, pred = runs("gold"), runs("pred")
    met = matching.match_segments(pred, gold, min(thresholds), bin_frames)
    grid = F.broadcast(pairs.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double"))
    counts = known.join(gold.groupBy("video_id").agg(F.count("*").alias("g")), "video_id", "left").join(
        pred.groupBy("video_id").agg(F.count("*").alias("p")), "video_id", "left"
    )
    hits = met.join(grid, F.col("tiou") >= F.col("threshold")).groupBy("video_id", "threshold").agg(F.count("*").alias("m"))
    rows = counts.crossJoin(grid).join(hits, ["video_id", "threshold"], "left").fillna(0, ["g", "p", "m"])
    empty = (F.col("g") == 0) & (F.col("p") == 0)
    share = lambda n: F.when(empty, 1.0).when(F.col(n) > 0, F.col("m") / F.col(n)).otherwise(0.0)
    f1 = F.when(empty, 1.0).when(F.col("m") > 0, 2 * F.col("m") / (F.col("p") + F.col("g"))).otherwise(0.0)
    return rows.groupBy("threshold").agg(
        F.count("*").alias("n_streams"),
        F.avg(share("p")).alias("precision"),
        F.avg(share("g")).alias("recall"),
        F.avg(f1).alias("f1"),
        *[F.sum(c).alias(name) for c, name in (("m", "n_matches"), ("p", "n_pred"), ("g", "n_gold"))],
    )
