"""What went wrong with each predicted span and each gold unit, and which gold edges were hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.operators import intervals as iv
from spanwright.operators import matching


def numbered_units(chunked: DataFrame) -> DataFrame:
    """Chunked units with ``unit``, their place in the video."""
    return chunked.withColumn("unit", (F.row_number().over(iv.by_video()) - 1).cast("long"))


def _depth(at: str) -> Column:
    """How far an edge of a unit (``other_``) lies from the nearer edge of the unit; negative outside."""
    return F.least(F.col(at) - F.col("other_start_ms"), F.col("other_end_ms") - F.col(at))


def _first_fit(alone: str) -> Column:
    """The first rule that fits a row of ``_cells``."""
    counts = (F.col("tiou") >= F.col("threshold")) & (F.col("edge_ms") <= F.col("tau_ms"))
    return (
        F.when(counts & (F.col("run") == 1), "matched")
        .when(counts, "joined")
        .when(F.col("depth") > F.col("tau_ms"), "cut")
        .when(F.col("bridged"), "bridged")
        .when(F.col("held"), "offset")
        .otherwise(alone)
    )


def error_types(
    events: DataFrame, units: DataFrame, matches: DataFrame, taus_ms: list[int], thresholds: list[float], cover: float, bin_ms: int
) -> DataFrame:
    """(side, tau_ms, threshold, type, n, share): every caption and every unit under the first type that fits, per cell.

    ``units`` are numbered and chunked, ``matches`` were made once at the lowest threshold; an event and a unit are in at
    most one of them, so a cell is a filter on columns of its row and the grid needs no further shuffle.  A share is
    taken in each video and averaged over the videos that have captions (units).
    """
    spark = events.sparkSession
    grid = F.broadcast(spark.createDataFrame([(t, float(h)) for t in taus_ms for h in thresholds], "tau_ms long, threshold double"))
    length = F.greatest(F.col("other_end_ms") - F.col("other_start_ms"), F.lit(1))
    touching = iv.overlap_join(events, units.drop("idx"), bin_ms).select(
        "video_id",
        "idx",
        F.col("other_unit").alias("unit"),
        F.greatest(_depth("start_ms"), _depth("end_ms")).alias("depth"),
        F.when(iv.overlap_ms() >= F.lit(cover) * length, F.col("other_chunk")).alias("chunk"),
    )
    of_event = Window.partitionBy("video_id", "idx")
    touching = touching.withColumn("bridging", F.min("chunk").over(of_event) < F.max("chunk").over(of_event))

    def facts(key: str, bridged: Column) -> DataFrame:
        return touching.groupBy("video_id", key).agg(
            F.max("depth").alias("depth"), F.coalesce(F.bool_or(bridged), F.lit(False)).alias("bridged"), (F.count("chunk") > 0).alias("held")
        )

    counted = matching.with_edges(events, units, matches)
    by_unit = counted.withColumn("unit", F.explode(F.sequence("first_unit", "last_unit"))).drop("idx")

    def side(name: str, rows: DataFrame, key: str, found: DataFrame, bridged: Column, alone: str) -> DataFrame:
        total = F.count("*").over(Window.partitionBy("video_id"))
        whole = (
            rows.select("video_id", key)
            .join(facts(key, bridged), ["video_id", key], "left")
            .join(found.drop("first_unit", "last_unit"), ["video_id", key], "left")
            .withColumn("part", 1 / total)
            .crossJoin(grid)
        )
        kinds = whole.groupBy("tau_ms", "threshold", _first_fit(alone).alias("type")).agg(F.count("*").alias("n"), F.sum("part").alias("parts"))
        cell = Window.partitionBy("tau_ms", "threshold")
        share = F.round(F.col("parts") / F.round(F.sum("parts").over(cell)), 9)
        return kinds.select(F.lit(name).alias("side"), "tau_ms", "threshold", "type", "n", share.alias("share"))

    captions = side("caption", events, "idx", counted, F.col("bridging"), "phantom")
    return captions.unionByName(side("unit", units, "unit", by_unit, F.col("bridging") & F.col("chunk").isNotNull(), "missed"))


def edge_classes(units: DataFrame, streams: DataFrame, gap_ms: int) -> DataFrame:
    """(video_id, idx, side, at_ms, class) of both edges of each reliable unit, by what lies beyond the edge.

    The neighbour before is the one that ends last of those that start earlier, the first such among equals.  ``streams``
    holds video_id and total_ms.
    """
    w = iv.by_video()
    rank = F.struct("end_ms", -F.row_number().over(w))
    seen = units.withColumn("rank", rank)
    seen = seen.withColumns(
        {
            "before": F.max_by(F.struct("end_ms", "reliable"), "rank").over(iv.earlier(w)),
            "after": F.lead(F.struct("start_ms", "reliable")).over(w),
        }
    ).join(streams, "video_id")

    def klass(other: str, gap: Column, edge: Column) -> Column:
        there = F.col(other).isNotNull()
        far = F.when(there, gap).otherwise(edge) > gap_ms
        return F.when(far, "pause").when(~there, "stream").when(F.col(other)["reliable"], "abutting").otherwise("quarantine")

    start = klass("before", F.col("start_ms") - F.col("before")["end_ms"], F.col("start_ms"))
    end = klass("after", F.col("after")["start_ms"] - F.col("end_ms"), F.col("total_ms") - F.col("end_ms"))
    sides = F.explode(
        F.array(
            F.struct(F.lit("start").alias("side"), F.col("start_ms").alias("at_ms"), start.alias("class")),
            F.struct(F.lit("end").alias("side"), F.col("end_ms").alias("at_ms"), end.alias("class")),
        )
    ).alias("x")
    return seen.where("reliable").select("video_id", "idx", sides).select("video_id", "idx", "x.*")


def boundary_hits(events: DataFrame, edges: DataFrame, taus_ms: list[int]) -> DataFrame:
    """(side, tau_ms, class, gold_edges, hit_edges, hit_rate, caption_edges, edge_precision); class ``all`` pools a side.

    Gold and caption edges pair one to one, the nearest first, ties by gold time, then caption time, then the indices.
    One pass at the largest tau serves every tau: what pairs within a smaller one does so within a larger one.
    """
    most = max(taus_ms)
    sides = F.explode(
        F.array(
            F.struct(F.lit("start").alias("side"), F.col("start_ms").alias("caption_ms")),
            F.struct(F.lit("end").alias("side"), F.col("end_ms").alias("caption_ms")),
        )
    ).alias("x")
    captions = events.select("video_id", F.col("idx").alias("event"), sides).select("video_id", "event", "x.*")
    width = max(most, 1)
    place = F.floor(F.col("caption_ms") / width)
    near = captions.withColumn("bin", F.explode(F.sequence(place - 1, place + 1)))
    pairs = edges.withColumn("bin", F.floor(F.col("at_ms") / width)).join(near, ["video_id", "side", "bin"])
    distance = F.abs(F.col("at_ms") - F.col("caption_ms"))
    candidates = pairs.withColumn("distance", distance).where(F.col("distance") <= most)
    candidates = candidates.withColumns({"first_unit": F.col("idx"), "last_unit": F.col("idx")})
    order = F.struct("distance", "at_ms", "caption_ms", "first_unit", "event")
    reach = {"from_ms": F.least("at_ms", "caption_ms"), "to_ms": F.greatest("at_ms", "caption_ms")}
    split = matching.islands(candidates.withColumns(reach), ["video_id", "side"], "from_ms", "to_ms")
    paired = matching.greedy(split, ["video_id", "side", "island"], order, ["event", "first_unit", "last_unit", "distance"])
    found = edges.join(paired.select("video_id", "side", F.col("first_unit").alias("idx"), "distance"), ["video_id", "side", "idx"], "left")
    spark = events.sparkSession
    grid = F.broadcast(spark.createDataFrame([(t,) for t in taus_ms], "tau_ms long"))
    counted = (
        found.crossJoin(grid)
        .groupingSets([["side", "tau_ms", "class"], ["side", "tau_ms"]], "side", "tau_ms", "class")
        .agg(F.count("*").alias("gold_edges"), F.count_if(F.col("distance") <= F.col("tau_ms")).alias("hit_edges"))
    )
    totals = F.broadcast(captions.groupBy("side").agg(F.count("*").alias("caption_edges")))
    pooled = F.col("class").isNull()
    return counted.join(totals, "side").select(
        "side",
        "tau_ms",
        F.coalesce("class", F.lit("all")).alias("class"),
        "gold_edges",
        "hit_edges",
        F.round(F.col("hit_edges") / F.col("gold_edges"), 9).alias("hit_rate"),
        F.when(pooled, F.col("caption_edges")).alias("caption_edges"),
        F.when(pooled, F.round(F.col("hit_edges") / F.col("caption_edges"), 9)).alias("edge_precision"),
    )


def chunk_classes(chunked: DataFrame, blocked: DataFrame, streams: DataFrame, gap_ms: int, most_ms: int) -> DataFrame:
    """(video_id, chunk, start_ms, end_ms, class): the first rule that fits each chunk of reliable units.

    ``blocked`` are the quarantined units, ``streams`` has video_id and total_ms.  What a chunk starts after or ends
    before within the gap is looked up by bins of the gap, so a video's chunks never meet all its quarantined units.
    """
    last = F.when(F.col("end_ms").isNotNull(), F.struct("start_ms", "end_ms", "idx"))
    chunk = chunked.groupBy("video_id", "chunk").agg(F.min("start_ms").alias("start_ms"), F.max_by("end_ms", last).alias("end_ms"))
    width = max(gap_ms, 1)

    def beside(mine: str, other: str, gap: Column, name: str) -> DataFrame:
        place = F.floor(F.col(other) / width)
        there = blocked.select("video_id", F.col("start_ms").alias("q_start"), F.col("end_ms").alias("q_end"))
        there = there.withColumn("bin", F.explode(F.sequence(place - 1, place + 1)))
        hits = chunk.withColumn("bin", F.floor(F.col(mine) / width)).join(there, ["video_id", "bin"]).where(gap.between(0, gap_ms))
        return hits.groupBy("video_id", "chunk").agg(F.bool_or(F.col("q_start") < 0).alias(f"{name}_cut"), F.lit(True).alias(name))

    before = beside("start_ms", "q_end", F.col("start_ms") - F.col("q_end"), "after")
    after = beside("end_ms", "q_start", F.col("q_start") - F.col("end_ms"), "before")
    known = chunk.join(before, ["video_id", "chunk"], "left").join(after, ["video_id", "chunk"], "left").join(streams, "video_id")
    klass = (
        F.when(F.col("end_ms") - F.col("start_ms") > most_ms, "over_cap")
        .when(F.col("start_ms") <= gap_ms, "video_start")
        .when(F.col("after_cut"), "cut_start")
        .when(F.col("after"), "after_quarantine")
        .when((F.col("total_ms") - F.col("end_ms") <= gap_ms) | F.col("before"), "end_blocked")
        .otherwise("free")
    )
    return known.select("video_id", "chunk", "start_ms", "end_ms", klass.alias("class"))


def cue_edges(events: DataFrame, units: DataFrame, junctions: DataFrame, taus_ms: list[int], bin_ms: int) -> DataFrame:
    """(tau_ms, inside_edges, at_cue_break): caption edges more than tau inside a unit, and those within tau of a junction.

    ``junctions`` (video_id, a, b) are the end of a display cue and the start of the next; only those strictly inside the
    unit count.  Equal junctions and equal edges each count; ``units`` has ``unit`` as its id.
    """
    spark = events.sparkSession
    grid = F.broadcast(spark.createDataFrame([(t,) for t in taus_ms], "tau_ms long"))
    place = lambda c: F.floor(F.col(c) / bin_ms)
    binned = units.withColumn("bin", F.explode(F.sequence(place("start_ms"), place("end_ms"))))
    points = events.select("video_id", "idx", F.explode(F.array("start_ms", "end_ms")).alias("at_ms")).withColumn("bin", place("at_ms"))
    deep = binned.join(points, ["video_id", "bin"]).crossJoin(grid)
    deep = deep.where((F.col("at_ms") > F.col("start_ms") + F.col("tau_ms")) & (F.col("at_ms") < F.col("end_ms") - F.col("tau_ms")))
    x, y = F.least("a", "b"), F.greatest("a", "b")
    at = junctions.select("video_id", x.alias("x"), y.alias("y")).withColumn("bin", place("x"))
    inner = binned.join(at, ["video_id", "bin"]).where("x > start_ms and y < end_ms")
    inner = inner.groupBy("video_id", "unit").agg(F.collect_set(F.struct("x", "y")).alias("breaks"))
    joined = deep.join(inner, ["video_id", "unit"], "left")
    tau, t = F.col("tau_ms"), F.col("at_ms")
    hit = F.coalesce(F.exists("breaks", lambda j: (t >= j["x"] - tau) & (t <= j["y"] + tau)), F.lit(False))
    return joined.groupBy("tau_ms").agg(F.count("*").alias("inside_edges"), F.count_if(hit).alias("at_cue_break"))
