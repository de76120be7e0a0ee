"""Writers: sidecar tables, score files, report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "array<struct<a:bigint,b:bigint>>"
RUN_COLUMNS = ["empty_runs", "handless_runs", "switch_runs", "default_signing_runs"]
SIDECAR = "video_id string, duration_s string, width string, height string, caption_source string, undetected_ratio string, " + ", ".join(
    f"{c} string" for c in [*RUN_COLUMNS, "copy_of", "unreliable_spans"]
)


def _pairs(cell: Column, kind: str) -> Column:
    """Pairs ``[[a, b], ...]``; a blank cell is null, not known, and ``[]`` is empty, known to be none."""
    rows = F.from_json(cell, f"array<array<{kind}>>")
    return F.transform(rows, lambda r: F.struct(F.get(r, F.lit(0)).alias("a"), F.get(r, F.lit(1)).alias("b")))


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """One row a video with its size, source of captions and runs of frames; rows without an id or a duration go."""
    raw = spark.read.schema(SIDECAR).options(header=True, enforceSchema=False, escape='"').csv(path)
    cell = lambda c: F.nullif(F.trim(c), F.lit(""))
    number = lambda c, t: F.expr(f"try_cast(trim({c}) as {t})").alias(c)
    kept = raw.where(cell("video_id").isNotNull() & cell("duration_s").isNotNull())
    return kept.select(
        F.trim("video_id").alias("video_id"),
        number("duration_s", "double"),
        number("width", "int"),
        number("height", "int"),
        cell("caption_source").alias("caption_source"),
        number("undetected_ratio", "double"),
        *[_pairs(cell(c), "bigint").alias(c) for c in RUN_COLUMNS],
        F.from_json(cell("copy_of"), "array<string>").alias("copy_of"),
        _pairs(cell("unreliable_spans"), "double").alias("unreliable_spans"),
    )


def write_sidecar(rows: DataFrame, path: str) -> None:
    """The same table as CSV in order of the ids, which :func:`read_sidecar` reads back; the committer makes it whole or not at all."""
    pairs = lambda c: F.when(F.col(c).isNotNull(), F.to_json(F.transform(c, lambda r: F.array(r["a"], r["b"])))).alias(c)
    flat = rows.select(
        "video_id", "duration_s", "width", "height", "caption_source", "undetected_ratio", *map(pairs, RUN_COLUMNS), F.to_json("copy_of").alias("copy_of"), pairs("unreliable_spans")
    )
    flat.orderBy("video_id").write.mode("overwrite").options(header=True, escape='"').csv(path)


def upsert(old: DataFrame, new: DataFrame, key: str, dependent: list[str] = ()) -> DataFrame:
    """Rows of ``new`` over those of ``old``: its values where it has some, and nulls in the ``dependent`` columns of changed rows."""
    fresh = new.select(key, *[F.col(c).alias(f"new_{c}") for c in new.columns if c != key], F.lit(True).alias("changed"))
    joined = old.join(fresh, key, "full")

    def value(c: str) -> Column:
        was = F.when(F.col("changed").isNull(), F.col(c)) if c in dependent else F.col(c)
        return (F.coalesce(f"new_{c}", was) if c in new.columns else was).alias(c)

    return joined.select(key, *[value(c) for c in old.columns if c != key])


def write_report(scores: DataFrame, path: str, row: list[str], column: str, value: str, columns: list) -> None:
    """A CSV table with one line for each of ``row`` and one column for each of the given values of ``column``."""
    scores.groupBy(*row).pivot(column, columns).agg(F.first(value)).orderBy(*row).write.mode("overwrite").option("header", True).csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Long-form scores (system, block, metric, value) as JSON, one object a system, blocks and metrics in order."""
    metrics = F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))
    blocks = scores.groupBy("system", "block").agg(metrics.alias("metrics"))
    whole = blocks.groupBy("system").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("block", F.to_json("metrics"))))).alias("b"))
    whole.select("system", F.transform_values("b", lambda k, v: F.from_json(v, "map<string,double>")).alias("scores")).write.mode("overwrite").json(path)
