"""Seeded draws, slices and batches against plain loops over small tables."""

from pyspark.sql import functions as F

from spanwright.operators import sampling


def test_places_are_those_of_one_sort(spark):
    rows = spark.range(500).withColumn("h", sampling.draw(7, "id")).withColumn("w", F.col("id") % 5)
    got = sampling.places(rows, "h", ["id"], F.col("w"), buckets=16).collect()
    before = 0
    for n, r in enumerate(sorted(got, key=lambda r: (r["h"], r["id"]))):
        assert (r["place"], r["before"]) == (n, before)
        before += r["w"]


def test_ties_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, 3, None), (None, 3, 4), ("a", 3, 5), ("a", 4_294_967_295, 6)], "g string, h long, id long").withColumn("w", F.lit(None).cast("long"))
    got = sampling.places(rows, "h", ["id"], F.col("w"), ["g"], buckets=4).collect()
    assert sorted((str(r["g"]), r["place"], r["before"]) for r in got) == [("None", 0, 0), ("None", 1, 0), ("a", 0, 0), ("a", 1, 0)]
    assert sampling.places(rows.limit(0), "h", ["id"]).count() == 0


def test_splits_have_their_shares(spark):
    got = {r["split"]: r["count"] for r in sampling.splits(spark.range(105), "id").groupBy("split").count().collect()}
    assert got == {"train": 84, "dev": 10, "test": 11}


def test_every_row_comes_once_a_cycle(spark):
    rows = spark.range(400).select(F.when(F.col("id") < 300, "big").otherwise("small").alias("pool"), "id", F.lit(10).alias("len"))
    cycle = {r["pool"]: r for r in sampling.cycle_epochs(rows, "pool", "len").collect()}
    assert cycle["small"]["epochs"] == 1 and cycle["big"]["epochs"] == 2
    seen = [{r["id"] for r in sampling.epoch_slice(rows, "pool", "id", "len", e).where("pool = 'big'").collect()} for e in range(2)]
    assert seen[0] | seen[1] == set(range(300)) and seen[0] != seen[1]
    assert sampling.epoch_slice(rows, "pool", "id", "len", 5).where("pool = 'small'").count() == 100


def test_batches_hold_every_row_once_and_ranks_share(spark):
    rows = spark.range(83).withColumn("len", F.col("id") % 7)
    got = sampling.length_batches(rows, "id", "len", 8, 2, ranks=3).collect()
    assert sorted(r["id"] for r in got) == list(range(83)) and {r["batch"] for r in got} == set(range(11))
    for b in range(11):
        mine = sorted((r["slot"], r["rank"]) for r in got if r["batch"] == b)
        assert [s for s, _ in mine] == list(range(len(mine)))
        assert [k for _, k in mine] == sorted(k for _, k in mine)
        sizes = [sum(1 for _, k in mine if k == r) for r in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_padding(spark):
    clips = spark.createDataFrame([(1, [1.0, 2.0], [3, 3]), (1, [5.0], [1]), (1, None, None), (2, [], [])], "b int, f array<double>, y array<int>")
    got = [(r["f"], r["y"], r["mask"]) for r in sampling.padded(clips, "b", "f", "y", 0).collect()]
    assert ([1.0, 2.0], [3, 3], [True, True]) in got and ([5.0, 5.0], [1, 0], [True, False]) in got
    assert got.count(([], [], [])) == 2


def test_stamps_hang_on_content_alone(spark):
    rows = spark.range(50).select(F.lit("x").alias("g"), (F.col("id") % 5).alias("v"), F.col("id").alias("s"))
    stamp = lambda df: sampling.fingerprints(df, "g", "v", F.col("s").cast("string"), ["s"], "p").first()["stamp"]
    assert stamp(rows) == stamp(rows.orderBy(F.desc("s")).repartition(3))
    assert stamp(rows) != stamp(rows.where("s < 49"))


def test_equal_contents(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, ""), (5, ""), (6, None), (7, "a")], "id int, t string")
    assert sorted(tuple(r) for r in sampling.equal_contents(rows, "id", "t").collect()) == [(3, 1), (7, 1)]
