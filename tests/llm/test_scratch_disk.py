"""What scratch tables leave on disk."""

import time

from pyspark.sql import functions as F

from spanwright.llm import set_relation_join as sr
from spanwright.llm.common import SHUFFLE_CLEANUP, discard, written


def shuffled(spark) -> int:
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return sum(name.startswith("shuffle_") for name in str(env.blockManager().diskBlockManager().getAllBlocks().mkString(" ")).split())


def settled(spark, most: int) -> int:
    for _ in range(50):
        if shuffled(spark) <= most:
            break
        time.sleep(0.2)
    return shuffled(spark)


def test_shuffle_files_go_with_the_write(spark):
    before, setting = shuffled(spark), spark.conf.get(SHUFFLE_CLEANUP)
    made = written(spark.range(1000).repartition(8, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert settled(spark, before) <= before
    assert made.count() == 7 and spark.conf.get(SHUFFLE_CLEANUP) == setting
    discard(made)


def test_passes_shuffle_the_first_sets_once(spark, monkeypatch):
    monkeypatch.setattr(sr, "ENTRIES_A_PASS", 10)
    plans, real = [], sr.written

    def seen(df, name, *more):
        if name == "forest":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name, *more)

    monkeypatch.setattr(sr, "written", seen)
    rows = [(i, " ".join(f"w{i // 2}_{k}" for k in range(60))) for i in range(12)]
    got = {r.doc_id: r.component_id for r in sr.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {i: i - i % 2 for i in range(12)}
    assert len(plans) > 1 and not [p for p in plans if "LeftOuter, (rep" in p]
