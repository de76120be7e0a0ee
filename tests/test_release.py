"""Shoulder coordinates, repeated frames and runs on another grid against plain loops."""

import math
import random

from pyspark.sql import functions as F

from spanwright.operators import release

FRAME = "stream_id long, frame long, kp array<struct<x:double,y:double,c:double>>"


def frames(spark, points):
    return spark.createDataFrame([(1, t, p) for t, p in enumerate(points)], FRAME)


def test_shoulders_hands_hidden_and_unseen(spark):
    seen = frames(spark, [[(0.0, 0.0, 1.0), (2.0, 0.0, 1.0), (1.0, 4.0, 1.0), (3.0, 3.0, 1.0), (9.0, 9.0, 0.1)], [(0.0, 0.0, 0.1), (2.0, 0.0, 1.0), (1.0, 4.0, 1.0), (3.0, 3.0, 0.0), (9.0, 9.0, 1.0)]])
    got = [[None if p is None else (p["x"], p["y"]) for p in r["xy"]] for r in release.by_shoulders(seen, 8, [([3, 4], 3)], [2], aspect=2.0).orderBy("frame").collect()]
    assert got[0] == [(-0.5, 0.0), (0.5, 0.0), (0.0, 0.0), (0.0, 0.0), None]
    assert got[1] == [None, (0.5, 0.0), (0.0, 0.0), None, None]
    blind = frames(spark, [[(0.0, 0.0, 0.0), (2.0, 0.0, 1.0), (1.0, 4.0, 1.0)]])
    assert release.by_shoulders(blind, 8, [], [2]).first()["xy"] == [None, None, None]


def test_standardised_points_have_mean_zero_and_lost_ones_are_zero(spark):
    rows = spark.createDataFrame([(1, t, [(float(t), 5.0), None if t == 2 else (t * 2.0, 0.0)]) for t in range(4)], "stream_id long, frame long, xy array<struct<x:double,y:double>>")
    made = release.standardised(rows, release.point_table(rows)).orderBy("frame").collect()
    assert abs(sum(r["xy"][0]["x"] for r in made)) < 1e-9 and all(r["xy"][0]["y"] == 0 for r in made)
    assert made[2]["xy"][1]["x"] == 0
    speed = release.with_velocity(rows.withColumn("xy", F.slice("xy", 1, 1)), 10.0).orderBy("frame").collect()
    assert [r["v"][0]["x"] for r in speed] == [0.0, 10.0, 10.0, 10.0]


def test_patterns_of_repeats():
    assert release.patterns(30.0, [24.0, 25.0]) == [(24.0, 5, 1), (25.0, 6, 1)]
    assert release.patterns(60.0, [24.0, 30.0]) == [(24.0, 5, 3), (30.0, 2, 1)]
    assert release.patterns(25.0, [24.0, 25.0, 30.0]) == []


def test_repeats_go_and_real_motion_stays(spark):
    draw = random.Random(3)
    filled = [(1, t, None if t == 0 else 0.001 if t % 5 == 4 else 1 + draw.random()) for t in range(200)]
    real = [(2, t, 1 + draw.random()) for t in range(200)]
    beat = [(3, t, 0.6 if t % 5 == 4 else 1 + draw.random() / 10) for t in range(200)]
    rows = spark.createDataFrame([*filled, *real, *beat, (4, 0, None)], "stream_id long, frame long, motion double")
    got = release.content_frames(rows, 30.0, [24.0, 25.0], 8.0, 0.25).collect()
    assert sorted((r["stream_id"], r["frame"]) for r in got) == [(1, t) for t in range(200) if t % 5 != 4]
    assert release.content_frames(rows, 25.0, [24.0], 8.0, 0.25).count() == 0


def test_runs_on_the_grid_hold_the_frames_that_read_them(spark):
    draw = random.Random(5)
    for source, fps in ((30, 24), (24, 30), (50, 25), (60, 25)):
        stored, rows = 97, []
        for s in range(12):
            edges = sorted(draw.sample(range(stored + 1), 4))
            rows += [(s, edges[0], edges[1]), (s, edges[2], edges[3])]
        grid = math.ceil(stored * fps / source)
        sizes = spark.range(12).select(F.col("id").alias("stream_id"), F.lit(stored).alias("stored"), F.lit(grid).alias("grid"))
        got = release.grid_runs(spark.createDataFrame(rows, "stream_id long, a long, b long"), sizes, source, fps).collect()
        inside = {(r["stream_id"], k) for r in got for k in range(r["a"], r["b"])}
        reads = [min(math.floor(k * source / fps + 0.5), stored - 1) for k in range(grid)]
        assert inside == {(s, k) for s, a, b in rows for k, at in enumerate(reads) if a <= at < b}
        assert sum(r["b"] - r["a"] for r in got) == len(inside)
