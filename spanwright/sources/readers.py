"""Readers and writers of caption tracks, split files, sidecars and event files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.text import clean_caption, is_noise

#: The time line of a cue, and the candidate columns of split files.
TIMING = r"(?s)^.*?(\d{1,2}:\d{2}:\d{2}[.,]\d{3})[ \t]*-->[ \t]*(\d{1,2}:\d{2}:\d{2}[.,]\d{3})[^\n]*\n?"
ID_COLUMNS = ["video_id", "youtube_id", "id", "video", "source_video"]
SPLIT_COLUMNS = ["split", "subset", "partition"]
SPLITS = ["train", "dev", "test"]
EVENTS = "struct<events:map<string,array<struct<start_s:double,end_s:double,text:string,flagged_partial:boolean,commit_time_s:double,cap_cut:boolean>>>>"


def clock_ms(stamp: Column) -> Column:
    """Milliseconds of ``HH:MM:SS.mmm``, with a comma or a full stop."""
    parts = F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":")
    seconds = F.round(F.get(parts, F.lit(2)).cast("decimal(10,3)") * 1000).cast("long")
    return F.get(parts, F.lit(0)).cast("long") * 3_600_000 + F.get(parts, F.lit(1)).cast("long") * 60_000 + seconds


def parse_vtt(tracks: DataFrame, drop_noise: bool = False) -> DataFrame:
    """video_id, idx, start_ms, end_ms and cleaned text of the cues of (video_id, content).

    A cue is a block with a time line and the text up to the next empty line; cues without text, or that do not end after
    they begin, go.  ``drop_noise`` also drops those that only name sounds.
    """
    blocks = tracks.select("video_id", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), r"\n[ \t]*\n", -1)).alias("idx", "block"))
    timed = blocks.where(F.col("block").rlike(TIMING))
    body = F.regexp_replace("block", TIMING, "")
    lines = F.array_join(F.filter(F.transform(F.split(body, "\n", -1), F.trim), lambda x: x != ""), " ")
    if drop_noise:
        timed = timed.where(~is_noise(lines))
    return timed.select(
        "video_id",
        F.col("idx").cast("long").alias("idx"),
        clock_ms(F.regexp_extract("block", TIMING, 1)).alias("start_ms"),
        clock_ms(F.regexp_extract("block", TIMING, 2)).alias("end_ms"),
        clean_caption(lines).alias("text"),
    ).where("text != '' and end_ms > start_ms")


def read_vtt(spark: SparkSession, path: str) -> DataFrame:
    """Tracks from files; a video's id is its file name up to the first full stop."""
    files = spark.read.text(path, wholetext=True).withColumn("video_id", F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1))
    return parse_vtt(files.withColumnRenamed("value", "content"))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, split) from a CSV with one of the known id and split columns; ``val`` is dev, and other values go.

    Of several rows of one id the last one's split counts, by file name and then by place in the file.  Without a known id
    or split column no video has a split.
    """
    raw = spark.read.option("header", True).csv(path)
    ids, splits = [c for c in ID_COLUMNS if c in raw.columns], [c for c in SPLIT_COLUMNS if c in raw.columns]
    if not ids or not splits:
        return spark.createDataFrame([], "video_id string, split string")
    name = F.lower(F.trim(F.col(splits[0])))
    rows = raw.select(F.trim(F.col(ids[0])).alias("video_id"), F.when(name == "val", "dev").otherwise(name).alias("split"))
    rows = rows.withColumn("row", F.struct(F.input_file_name(), F.monotonically_increasing_id())).where(F.col("split").isin(SPLITS) & (F.col("video_id") != ""))
    return rows.groupBy("video_id").agg(F.max_by("split", "row").alias("split"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Predicted events of a JSON file ``{"events": {video: [row]}}``; a file without ``events`` is refused.

    A missing text stays null (segmentation only), which is not an empty one.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.from_json("value", EVENTS).alias("x"))
    checked = files.select(F.when(F.col("x.events").isNull(), F.raise_error(F.lit("no events in the file"))).otherwise(F.col("x.events")).alias("e"))
    rows = checked.select(F.explode("e").alias("video_id", "rows")).select("video_id", F.posexplode("rows").alias("idx", "r"))
    flag = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(False)).alias(c)
    return rows.select("video_id", F.col("idx").cast("long").alias("idx"), "r.start_s", "r.end_s", "r.text", flag("flagged_partial"), "r.commit_time_s", flag("cap_cut"))


def write_events(events: DataFrame, path: str, provenance: dict[str, str] | None = None, parts: int = 1) -> None:
    """Files of one object ``{"events": {video: [row]}, "provenance": {...}}`` each, which :func:`read_events` reads back.

    A video's events are in one file, in order of start; ``parts`` files share the videos out by hash.
    """
    fields = [c for c in ("start_s", "end_s", "text", "flagged_partial", "commit_time_s", "cap_cut") if c in events.columns]
    listed = F.sort_array(F.collect_list(F.struct("start_s", "idx", F.struct(*fields).alias("row"))))
    videos = events.groupBy(F.col("video_id").cast("string").alias("video_id")).agg(F.transform(listed, lambda x: x["row"]).alias("rows"))
    whole = videos.groupBy(F.pmod(F.xxhash64("video_id"), F.lit(parts)).alias("part")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("video_id", "rows")))).alias("events")
    )
    if provenance:
        whole = whole.withColumn("provenance", F.create_map(*[F.lit(x) for kv in sorted(provenance.items()) for x in kv]))
    whole.write.partitionBy("part").json(path)
