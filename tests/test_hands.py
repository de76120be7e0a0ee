"""Hands claimed by wrists, hand activity, ids in buckets and names, by hand."""

import itertools
import math
import random

from pyspark.sql import functions as F

from spanwright.functions import levels
from spanwright.operators import hands, tracks

POINT = "struct<x:double,y:double>"


def test_claims_are_the_best_of_all_pairings(spark):
    draw = random.Random(11)
    point = lambda: (draw.randint(0, 8) / 8, draw.randint(0, 8) / 8)
    rows = [(i, point() if i % 5 else None, point() if i % 7 else None, [point() for _ in range(i % 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, f"id int, a {POINT}, b {POINT}, h array<{POINT}>")
    got = {r["id"]: (r["c"]["left"], r["c"]["right"]) for r in df.select("id", hands.claimed(F.col("a"), F.col("b"), F.col("h"), 0.4).alias("c")).collect()}
    for i, a, b, found in rows:
        way = lambda p, k: 0.0 if k is None else math.dist(p, found[k]) if p else math.inf
        options = [(x, y) for x, y in itertools.product([None, *range(len(found))], repeat=2) if (x is None or x != y) and way(a, x) < 0.4 and way(b, y) < 0.4]
        rank = lambda o: (-(o[0] is not None) - (o[1] is not None), way(a, o[0]) + way(b, o[1]))
        assert rank(got[i]) == min(map(rank, options))


def test_activity_of_a_hand_whose_kind_changes(spark):
    schema = "stream_id int, frame long, hands array<struct<x:double,y:double,kind:int>>, width double"
    rows = [(1, 0, [(0.0, 0.0, 1), None], 2.0), (1, 1, [(1.0, 0.0, 1), None], 2.0), (1, 2, [(9.0, 0.0, 2), (0.0, 0.0, 1)], None), (1, 3, [(9.0, 0.0, 2), (0.0, 90.0, 1)], 2.0), (2, 0, [None, None], None)]
    got = hands.activity(spark.createDataFrame(rows, schema), 10.0, 7.0, []).orderBy("stream_id", "frame").collect()
    assert [r["activity"] for r in got] == [None, 5.0, None, 7.0, None]


def test_buckets_add_up(spark):
    rows = spark.createDataFrame([(1, 5), (1, 50), (2, 5), (3, 20), (None, None)], "id int, n int")
    got = {r["status"]: tuple(r)[1:] for r in tracks.reconciled(rows, "id", {"big": F.col("n") > 40, "small": F.col("n") < 10}).collect()}
    assert got == {"big": (1, 1, 4), "small": (1, 0, 4), "unaccounted": (2, 0, 4)}
    assert tracks.reconciled(rows.limit(0), "id", {"big": F.col("n") > 40}).count() == 0


def test_names(spark):
    row = spark.createDataFrame([("a/b/vid.x_segment_12.npz", "--BLEU @ 0.5 (é)!", " one|two |  three", ".hidden")], "p string, l string, t string, q string")
    got = row.select(levels.base_id(F.col("p")), levels.slug(F.col("l")), levels.unit_text(F.col("t"), "|"), levels.base_id(F.col("q"))).first()
    assert tuple(got) == ("vid.x", "bleu___0_5__é", "one two three", ".hidden")
