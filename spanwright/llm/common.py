"""What several corpus operators share: scratch tables, words and row keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that end a word.
SPACE = r"\x20\x09-\x0D"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_spanwright_scratch", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="spanwright-")
        spark.sparkContext._spanwright_scratch = own
    return own


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
TEXT_ROWS = 1000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, to be deleted by :func:`release`."""
    path = f"{shared_dir(spark)}/spanwright/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor then costs the tasks that read the table, never the steps before it, and every later
    step sees the same rows even if ``df`` itself would come out in another order.  The shuffle files of the write go when it
    ends, not whenever the driver next collects garbage.  ``batch_rows`` go to a Python worker at a
    time; for whole texts ``TEXT_ROWS`` keep the buffers on both sides small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = {k: spark.conf.get(k) for k in (BATCH_ROWS, SHUFFLE_CLEANUP)}
    spark.conf.set(BATCH_ROWS, batch_rows or before[BATCH_ROWS])
    spark.conf.set(SHUFFLE_CLEANUP, True)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def give_back() -> None:
    """Hand a worker's free memory back to the system: workers live on between tasks, and so does what they hold."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there is none outside glibc
    if trim is not None:
        trim(0)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind what :func:`written` gave; everything that reads it must have run."""
    spark, path = df.sparkSession, df.scratch_path
    _written.remove((spark, path))
    _delete(spark, path)


def release() -> None:
    """Delete the scratch tables that are left; their readers must be done."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session may have ended before the interpreter
            return


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bitmap(ids: DataFrame, column: str, bits: int = 1 << 24):
    """A broadcast bitmap of hashed ids, of ``bits`` bits (2 MB) however many ids there are, and the place of an id in it.

    All of ``ids`` are in it, and few others; when there are very many ids it lets more pass.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = (
        ids.select(place(F.col(column)).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("word_bits"))
        .toPandas()
    )
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["word_bits"].to_numpy(np.int64)
    return ids.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8)), place


def in_bitmap(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    at = places.astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def id_filter(ids: DataFrame, column: str, bits: int = 1 << 24):
    """A test for columns of ids that lets all of ``ids`` pass and few others, for use before a join shuffles wide rows."""
    shared, place = id_bitmap(ids, column, bits)

    @F.pandas_udf("boolean")
    def known(places: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, places.to_numpy()))

    return lambda c: known(place(c))


def held_out(doc_id) -> "F.Column":
    """True where crc32 of the id as text leaves remainder 0 modulo 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
