"""The driver's tables seen as timed spans.

All span algebra runs in whole milliseconds, so no comparison with a threshold ever hangs on how a float was rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The events table starts here; its values are stretched so that spans of one user overlap at times.
EPOCH_MS = 1_704_067_200_000
STRETCH = 100
GOLD_KINDS = ("view", "click")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out over all cores if it comes as fewer pieces than there are, as one small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, idx, kind, start_ms and end_ms: each event as a span of its user's stream."""
    events = table(spark, sf_dir, "events")
    # from the parts of the wall clock, so that the session's time zone plays no role
    start = F.expr(
        "datediff(cast(ts as date), date'2024-01-01') * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L"
        " + cast(floor(extract(second from ts) * 1000) as bigint)"
    )
    return events.select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("idx"),
        F.col("event_type").alias("kind"),
        start.alias("start_ms"),
        (start + F.round(F.col("value") * STRETCH * 1000).cast("long")).alias("end_ms"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).where(F.col("kind").isin(*GOLD_KINDS)).drop("kind")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).where(~F.col("kind").isin(*GOLD_KINDS))


#: The same views for the SQL twins.
SPANS_SQL = f"""spans as (
  select user_id as video_id, event_id as idx, event_type as kind,
    epoch_us(ts) // 1000 - {EPOCH_MS} as start_ms,
    epoch_us(ts) // 1000 - {EPOCH_MS} + cast(round(value * {STRETCH} * 1000) as bigint) as end_ms
  from events),
gold as (select video_id, idx, start_ms, end_ms from spans where kind in ('view', 'click')),
pred as (select * from spans where kind not in ('view', 'click'))"""
