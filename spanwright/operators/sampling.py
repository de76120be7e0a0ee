"""Seeded splits, rotating epoch slices, batches of like lengths, padded batches, and stamps of what was read.

Draws are hashes of a seed and a row's id, so a row's place does not depend on partitions or on the order of files.  Places
among all rows come from counts of hash buckets: no window runs over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASHES = 1 << 32
BUCKETS = 1024


def draw(seed: int, *ids: str) -> Column:
    """A whole number in [0, 2^32) from a seed and a row's ids."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def places(rows: DataFrame, by: str, ties: list[str], weight: Column | None = None, within: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``place`` (rows before it) and ``before`` (weight before it), in the order of ``by``, then ``ties``.

    ``by`` is evenly spread over [0, 2^32), as hashes are, so that its high bits cut each group of ``within`` into buckets of about
    equal size.  A window orders one bucket at a time; only the buckets' totals, at most ``buckets`` a group, are summed up in order.
    A null weight counts as none.
    """
    within = within or []
    w = F.coalesce((F.lit(1) if weight is None else weight).cast("long"), F.lit(0).cast("long"))
    cut = rows.withColumns({"_bucket": F.floor(F.col(by) * buckets / HASHES).cast("int"), "_weight": w})
    key = [*within, "_bucket"]
    totals = cut.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("_weight").alias("_w"))
    earlier = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = totals.select(*key, F.coalesce(F.sum("_n").over(earlier), zero).alias("_n"), F.coalesce(F.sum("_w").over(earlier), zero).alias("_w"))
    order = Window.partitionBy(*key).orderBy(by, *ties)
    inside = cut.withColumns(
        {
            "place": (F.row_number().over(order) - 1).cast("long"),
            "before": F.coalesce(F.sum("_weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero),
        }
    )
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    joined = inside.alias("a").join(starts.alias("b"), same[0] if len(same) == 1 else same[0] & same[1])
    kept = [F.col(f"a.{c}") for c in rows.columns]
    return joined.select(*kept, (F.col("a.place") + F.col("b._n")).alias("place"), (F.col("a.before") + F.col("b._w")).alias("before"))


def splits(ids: DataFrame, key: str, seed: int = 42, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """(key, split): a seeded shuffle cut into rounded shares, the rest is test."""
    placed = places(ids.select(key).withColumn("_draw", draw(seed, key)), "_draw", [key])
    total = F.broadcast(ids.agg(F.count("*").alias("_total")))
    n_train, n_dev = F.rint(F.col("_total") * train), F.rint(F.col("_total") * dev)
    split = F.when(F.col("place") < n_train, "train").when(F.col("place") < n_train + n_dev, "dev").otherwise("test")
    return placed.crossJoin(total).select(key, split.alias("split"))


def targets(pools: DataFrame, temperature: float) -> DataFrame:
    """Pools (pool, total) with ``target``: shares go with total ** temperature, and no pool gives more than it has."""
    every = Window.partitionBy()  # a row a pool
    weight = F.pow(F.col("total").cast("double"), F.lit(temperature))
    return pools.withColumn("_w", weight).withColumn("target", F.floor(F.round(F.col("_w") * F.min(F.col("total") / F.col("_w")).over(every), 6))).drop("_w")


def epoch_slice(rows: DataFrame, pool: str, key: str, length: str, epoch: int, seed: int = 42, temperature: float = 0.5) -> DataFrame:
    """The rows of one epoch: each pool lies on a circle of its own length, and the epoch takes the rows that start in its window.

    A pool whose target is its total gives every row every epoch; the others have given every row once after
    ceil(total / target) epochs.  Pools without length give nothing.
    """
    pools = targets(rows.groupBy(F.col(pool).alias("pool")).agg(F.sum(length).alias("total")).where("total > 0"), temperature)
    placed = places(rows.withColumn("_draw", draw(seed, pool, key)), "_draw", [key], F.col(length), [pool])
    met = placed.alias("a").join(pools.alias("p"), F.col(f"a.{pool}").eqNullSafe(F.col("p.pool")))
    total, target, at = F.col("p.total"), F.col("p.target"), F.col("a.before")
    lo = target * epoch % total
    taken = ((at >= lo) & (at < lo + target)) | (at + total < lo + target)
    return met.where(taken).select(*[F.col(f"a.{c}") for c in rows.columns])


def cycle_epochs(rows: DataFrame, pool: str, length: str, temperature: float = 0.5) -> DataFrame:
    """Pools with total, target and after how many epochs each has given all its rows."""
    pools = targets(rows.groupBy(F.col(pool).alias("pool")).agg(F.sum(length).alias("total")).where("total > 0"), temperature)
    return pools.withColumn("epochs", F.ceil(F.col("total") / F.col("target")))


def length_batches(rows: DataFrame, key: str, length: str, batch: int, pool_batches: int = 32, seed: int = 0, epoch: int = 0, ranks: int = 1) -> DataFrame:
    """(key, batch, slot, rank): a shuffle cut into pools, each pool ordered by length and cut into batches, batches in random order.

    ``batch`` numbers batches as they are read, ``slot`` is the place in one; ranks share a batch in order, sizes within one of
    each other.  Every row has one slot.
    """
    pool = batch * pool_batches
    placed = places(rows.select(key, length).withColumn("_draw", draw(seed + epoch, key)), "_draw", [key]).withColumn("_pool", F.floor(F.col("place") / pool))
    by_length = Window.partitionBy("_pool").orderBy(F.asc_nulls_first(length), "place")
    cut = placed.withColumn("_at", F.row_number().over(by_length) - 1).withColumn("_in", F.col("_pool") * pool_batches + F.floor(F.col("_at") / batch))
    made = cut.groupBy("_in").agg(F.count("*").alias("_n")).withColumn("_draw", draw(seed + 7919 + epoch, "_in"))
    order = places(made, "_draw", ["_in"]).select("_in", "_n", F.col("place").alias("batch"))
    slot = (F.col("_at") % batch).cast("long")
    big, small = F.col("_n") % ranks, F.floor(F.col("_n") / ranks)
    edge = big * (small + 1)
    rank = F.when(F.col("_n") < ranks, F.lit(0)).when(slot < edge, F.floor(slot / (small + 1))).otherwise(big + F.floor((slot - edge) / F.greatest(small, F.lit(1))))
    return cut.join(order, "_in").select(key, F.col("batch"), slot.alias("slot"), rank.cast("int").alias("rank"))


def padded(clips: DataFrame, batch: str, frames: str, labels: str, unknown: int) -> DataFrame:
    """Clips padded to the longest of their batch: the last frame repeats, labels are unknown, ``mask`` tells real frames.

    A clip without frames stays without; null arrays count as empty.
    """
    kind = dict(clips.dtypes)
    filled = clips.withColumns({c: F.coalesce(c, F.array().cast(kind[c])) for c in (frames, labels)})
    longest = filled.groupBy(F.col(batch).alias("_batch")).agg(F.max(F.size(frames)).alias("_most"))
    joined = filled.join(longest, F.col(batch).eqNullSafe(F.col("_batch")))
    n = F.size(frames)
    pad = F.when(n > 0, F.col("_most") - n).otherwise(0)
    last = F.try_element_at(F.col(frames), F.lit(-1))
    return joined.withColumns(
        {
            "mask": F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), pad)),
            labels: F.concat(F.col(labels), F.array_repeat(F.lit(unknown).cast(kind[labels][6:-1]), pad)),
            frames: F.concat(F.col(frames), F.array_repeat(last, pad)),
        }
    ).drop("_batch", "_most")


def fingerprints(units: DataFrame, group: str, video: str, row: Column, order: list[str], protocol: str) -> DataFrame:
    """(group, stamp): a hash over a group's annotations that depends on nothing but them.

    Units hash in order within a video, videos within one of 256 shards, shards within the group: no task sees more than a
    shard's hashes.
    """
    sha = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    inner = F.sort_array(F.collect_list(F.struct(*order, row.alias("_row"))))
    videos = units.groupBy(group, video).agg(sha(F.transform(inner, lambda u: u["_row"])).alias("_units"))
    marked = videos.select(group, F.sha2(F.concat_ws("\n", F.col(video).cast("string"), "_units"), 256).alias("_video"))
    shards = marked.groupBy(group, F.substring("_video", 1, 2).alias("_shard")).agg(sha(F.sort_array(F.collect_list("_video"))).alias("_hash"))
    whole = sha(F.transform(F.sort_array(F.collect_list(F.struct("_shard", "_hash"))), lambda s: s["_hash"]))
    return shards.groupBy(group).agg(F.concat(F.lit(protocol + ":"), whole).alias("stamp"))


def equal_contents(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, origin) of rows whose content equals that of a row with a lesser key; empty and null contents have no origin."""
    hashed = rows.where(F.length(content) > 0).select(key, F.sha2(F.col(content), 256).alias("_hash"))
    origins = hashed.groupBy("_hash").agg(F.min(key).alias("origin"), F.count("*").alias("_n")).where("_n > 1")
    return hashed.join(origins, "_hash").where(F.col(key) != F.col("origin")).select(key, "origin")
