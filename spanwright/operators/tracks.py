"""Which caption track of a video counts, and which videos are fit for use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions import text as tx

#: What a track of word times or a flattened transcript looks like.
HEAD_CHARS = 20_000
FLAT_CUES, FLAT_CHARS, FLAT_RATE = 2, 500, 120.0
#: Names of the caption files of one video, the best first; {} is the code of the language.
NATIVE, MACHINE = "english.en.native.vtt", "english.en.nllb.vtt"
END_TOLERANCE_MS = 1000


def word_timed(raw: Column) -> Column:
    """True for a track with times of single words near its start; false for null."""
    return F.coalesce(F.substring(raw, 1, HEAD_CHARS).rlike(tx.TIMING), F.lit(False))


def track_facts(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Cues, characters and the highest rate of characters a second of each track; ``flat`` for a transcript in one or two cues."""
    rate = F.length("text") * 1000.0 / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    facts = cues.groupBy(*keys).agg(F.count("*").alias("n_cues"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.max(rate).alias("rate"))
    flat = (F.col("n_cues") <= FLAT_CUES) & (F.col("n_chars") >= FLAT_CHARS) & F.coalesce(F.col("rate") >= FLAT_RATE, F.lit(False))
    return facts.withColumn("flat", flat).drop("rate")


def best_track(tracks: DataFrame, preferred: list[str], rejected: list[str], least_chars: int = 2, exclude_rejected: bool = False) -> DataFrame:
    """One track (video_id, name) for each video that has a fit one.

    ``tracks`` has word_timed, flat and n_chars.  The suffix that is preferred most wins, then the longest text, then the
    name; rejected suffixes lose to all others or are never read.
    """
    bad = F.lit(False)
    for suffix in rejected:
        bad = bad | F.col("name").endswith(suffix)
    rank = F.when(bad, 10_000)
    for place, suffix in enumerate(preferred):
        rank = rank.when(F.col("name").endswith(suffix), place)
    fit = tracks.where(~F.col("word_timed") & ~F.col("flat") & (F.col("n_chars") >= least_chars))
    if exclude_rejected:
        fit = fit.where(~bad)
    ranked = fit.withColumn("rank", rank.otherwise(len(preferred) + 100))
    first = Window.partitionBy("video_id").orderBy("rank", F.desc("n_chars"), "name")
    return ranked.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "rank")


def pick_caption(files: DataFrame) -> DataFrame:
    """The caption file of each video in its ``target`` language (files: video_id, target, name) and whether people wrote it."""
    english = F.col("target") == "en"
    manual = F.startswith(F.col("name"), F.concat(F.lit("original."), "target")) & F.col("name").endswith(".manual.vtt")
    rank = F.when(english & (F.col("name") == NATIVE), 0).when(manual, 1).when(english & (F.col("name") == MACHINE), 2)
    best = Window.partitionBy("video_id").orderBy("rank", "name")
    ranked = files.withColumn("rank", rank).where("rank is not null").withColumn("n", F.row_number().over(best)).where("n = 1")
    return ranked.select("video_id", "name", F.when(F.col("rank") == 2, "mt").otherwise("human").alias("caption_source"))


def cue_coverage(cues: DataFrame, streams: DataFrame) -> DataFrame:
    """(video_id, covered): the share of a video's cues that lie inside its poses (video_id, pose_ms), with a second's grace at the end."""
    inside = (F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("pose_ms")) & (F.col("end_ms") <= F.col("pose_ms") + END_TOLERANCE_MS)
    counted = cues.join(streams, "video_id").groupBy("video_id").agg((F.count_if(inside) / F.count("*")).alias("covered"))
    return streams.select("video_id").join(counted, "video_id", "left").select("video_id", F.coalesce("covered", F.lit(0.0)).alias("covered"))


def drop_reasons(videos: DataFrame, human_only: list[str], excluded: list[str], least_covered: float) -> DataFrame:
    """``status`` of each video: the first rule that drops it, or ``kept``.  Every video has exactly one.

    ``videos`` has split, caption_source, covered, n_reliable and copy_of: for checked training videos the held-out video
    that they copy or an empty text.  A training video that was not checked, or a held-out one with a value, is an error.
    """
    train = F.col("split") == "train"
    unchecked = train & F.col("copy_of").isNull()
    moved = ~train & F.col("copy_of").isNotNull()
    machine = F.col("split").isin(human_only) & F.coalesce(F.col("caption_source").isin(excluded), F.lit(False))
    status = (
        F.when(unchecked, F.raise_error(F.lit("a training video was never checked for copies")).cast("string"))
        .when(moved, F.raise_error(F.lit("a held-out video holds a result of the copy check")).cast("string"))
        .when(machine, "machine captions")
        .when(F.col("covered") < least_covered, "uncovered")
        .when(F.col("n_reliable") < 1, "all quarantined")
        .when(train & (F.col("copy_of") != ""), "copy")
        .otherwise("kept")
    )
    return videos.withColumn("status", status)


def tally(statuses: DataFrame) -> DataFrame:
    """Videos by split and status, with the split's total beside each; the parts sum to it by construction."""
    counted = statuses.groupBy("split", "status").agg(F.count("*").alias("n"))
    return counted.withColumn("n_split", F.sum("n").over(Window.partitionBy("split")))


def reconciled(rows: DataFrame, key: str, buckets: dict[str, Column]) -> DataFrame:
    """(status, n, n_ambiguous, n_total): every id in the first of ``buckets`` that holds for one of its rows, else in ``unaccounted``.

    The counts add up to n_total, the number of ids; ``n_ambiguous`` of a bucket's ids also fit a later one.
    """
    holds = {f"_{k}": F.coalesce(F.bool_or(c), F.lit(False)) for k, c in enumerate(buckets.values())}
    ids = rows.groupBy(key).agg(*[c.alias(name) for name, c in holds.items()])
    first = F.lit("unaccounted")
    for k, status in reversed(list(enumerate(buckets))):
        first = F.when(F.col(f"_{k}"), status).otherwise(first)
    n = sum((F.col(name).cast("int") for name in holds), F.lit(0))
    counts = ids.select(first.alias("status"), (n > 1).alias("_more")).groupBy("status").agg(F.count("*").alias("n"), F.count_if("_more").alias("n_ambiguous"))
    return counts.withColumn("n_total", F.sum("n").over(Window.partitionBy()))  # a row a status
