"""What must not grow out of hand: rows with texts times policies, and tables sent through the driver."""

from pyspark.sql import functions as F

from spanwright.operators import textmetrics as tm
from spanwright.streaming import display


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_replay_sorts_texts_by_track_only(spark):
    hyps = spark.createDataFrame([(1, 0, 0, ["a"], [0.9], False), (1, 1, 9, ["a", "b"], [0.9, 0.4], True)], "track long, seq long, at_ms long, tokens array<string>, conf array<double>, committed boolean")
    screens = display.replay(hyps)
    assert not [line for line in plan(screens).split("\n") if "Window [" in line and "policy" in line]
    got = {r.policy: (r.shown, r.own, r.wrong, r.kept, r.shown_before, r.last) for r in screens.where("seq = 1").collect()}
    assert set(got) == set(display.policy_names())
    assert got["mask_k0"] == (2, 2, 0, 1, 1, True) and got["commit_only"] == (2, 2, 0, 0, 0, True)


def test_cider_sends_no_ngrams_through_the_driver(spark, tmp_path):
    words = F.array(F.lit("a"), F.col("id").cast("string"), F.lit("b"))
    spark.range(50).select(F.col("id").alias("pair"), words.alias("hyp"), words.alias("ref")).write.parquet(f"{tmp_path}/pairs")
    assert "BroadcastHashJoin" not in plan(tm.cider(spark.read.parquet(f"{tmp_path}/pairs")))
