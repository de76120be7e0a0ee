"""One-to-one matching of predicted spans and gold items by temporal overlap, greedy in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.operators import intervals as iv


def chunk_items(chunked: DataFrame, most_units: int | None = None) -> DataFrame:
    """Every run of neighbouring units of a chunk as one item: its span, its first and last unit.

    Units are numbered in a video; an item blocks exactly the units from ``first_unit`` to ``last_unit``.
    """
    order = iv.by_video()
    numbered = chunked.withColumn("unit", F.row_number().over(order) - 1)
    last = numbered.select("video_id", "chunk", F.col("unit").alias("last_unit"), F.col("end_ms").alias("item_end"))
    pairs = numbered.join(last, ["video_id", "chunk"]).where("last_unit >= unit")
    if most_units:
        pairs = pairs.where(F.col("last_unit") - F.col("unit") < most_units)
    return pairs.select(
        "video_id",
        F.col("unit").alias("first_unit"),
        "last_unit",
        "start_ms",
        F.col("item_end").alias("end_ms"),
        (F.col("last_unit") - F.col("unit") + 1).alias("n_units"),
    )


def _taken(state: Column, c: Column) -> Column:
    """Whether a candidate's event or one of its units is already in a match."""
    return F.exists(
        state,
        lambda m: (m["event"] == c["event"]) | ((m["first_unit"] <= c["last_unit"]) & (c["first_unit"] <= m["last_unit"])),
    )


def islands(candidates: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Candidates with ``island``: runs of those whose spans [start, end] touch, numbered in each group.

    Give a candidate the span of its event and its units together: then two that share any of them are on one island.
    """
    w = Window.partitionBy(*key).orderBy(start, end)
    fresh = F.col(start) > F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = candidates.withColumn("_fresh", F.coalesce(fresh, F.lit(False)).cast("long"))
    return marked.withColumn("island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def greedy(candidates: DataFrame, key: list[str], order: Column, fields: list[str]) -> DataFrame:
    """Walk each group's candidates in ``order`` and keep those whose event and units are free.

    ``order`` is a struct; the candidates of a group are sorted by it and folded by one higher-order function, all in
    the JVM.  Prune candidates by the lowest threshold before and split groups by ``islands``: a group's candidates are held in one row.
    """
    sorted_ = F.sort_array(F.collect_list(F.struct(order.alias("by"), *fields)))
    kind = "array<struct<" + ",".join(f"{f}:{dict(candidates.dtypes)[f]}" for f in fields) + ">>"
    walked = F.aggregate(
        F.col("sorted"),
        F.array().cast(kind),
        lambda s, c: F.when(_taken(s, c), s).otherwise(F.concat(s, F.array(F.struct(*[c[f].alias(f) for f in fields])).cast(kind))),
    )
    grouped = candidates.groupBy(*key).agg(sorted_.alias("sorted"))
    return grouped.select(*key, F.explode(walked).alias("m")).select(*key, "m.*")


def _reach() -> list[Column]:
    """The span of both sides of a joined pair."""
    return [F.least("start_ms", "other_start_ms").alias("from_ms"), F.greatest("end_ms", "other_end_ms").alias("to_ms")]


def match_items(events: DataFrame, items: DataFrame, least: float, bin_ms: int) -> DataFrame:
    """Best temporal overlap first, ties to the lower event, then the lower item; an item blocks all its units.

    An event without an id matches nothing; events that share an id have one match between them, wherever they lie.
    """
    pairs = iv.overlap_join(events, items, bin_ms).withColumn("tiou", iv.tiou()).where(F.col("tiou") >= least)
    candidates = pairs.select(
        "video_id",
        F.col("idx").alias("event"),
        F.col("other_first_unit").alias("first_unit"),
        F.col("other_last_unit").alias("last_unit"),
        "tiou",
        *_reach(),
    ).where("event is not null")
    return _best_first(candidates)


def _best_first(candidates: DataFrame) -> DataFrame:
    """Walk candidates of events and runs of units, the candidates of one event on one island wherever they lie."""
    one = Window.partitionBy("video_id", "event")
    candidates = candidates.repartition("video_id").withColumns({"from_ms": F.min("from_ms").over(one), "to_ms": F.max("to_ms").over(one)})
    order = F.struct(-F.col("tiou"), F.col("event"), F.col("first_unit"), F.col("last_unit"))
    split = islands(candidates, ["video_id"], "from_ms", "to_ms")
    return greedy(split, ["video_id", "island"], order, ["event", "first_unit", "last_unit", "tiou"]).drop("island")


def run_candidates(events: DataFrame, units: DataFrame, least: float, bin_ms: int) -> DataFrame:
    """Events with every run of neighbouring units of a chunk, of any length, that overlaps them by ``least`` or more (over 0).

    ``units`` are numbered and chunked.  The union of such a pair is at most the event's length over ``least``, so a run starts and ends
    within that of the event: only units that do are paired up, by bins, and no list of all runs of a chunk is made.
    """
    asked = events.where("idx is not null and end_ms > start_ms").select("video_id", F.col("idx").alias("event"), "start_ms", "end_ms").distinct()
    # a millisecond more, as the quotient may be rounded
    asked = asked.withColumn("reach", F.ceil((F.col("end_ms") - F.col("start_ms")) / F.lit(least)) + 1)
    place = lambda c: F.floor(c / bin_ms)

    def edges(point: str, low: Column, high: Column, unit: str, to: str) -> DataFrame:
        at = units.select("video_id", "chunk", F.col("unit").alias(unit), F.col(point).alias(to), F.col("start_ms").alias(f"{unit}_start"))
        at = at.withColumn("bin", place(F.col(to)))
        near = asked.withColumn("bin", F.explode(F.sequence(place(low), place(high))))
        return near.join(at, ["video_id", "bin"]).where(F.col(to).between(low, high)).drop("bin", "reach")

    s, e, reach = F.col("start_ms"), F.col("end_ms"), F.col("reach")
    firsts = edges("start_ms", e - reach, e, "first_unit", "other_start_ms")
    lasts = edges("end_ms", s, s + reach, "last_unit", "other_end_ms")
    pairs = firsts.join(lasts, ["video_id", "event", "start_ms", "end_ms", "chunk"]).where("first_unit <= last_unit")
    pairs = pairs.withColumn("tiou", iv.tiou()).where(F.col("tiou") >= least)
    # a last unit that ends before it starts still is one of the run's
    within = F.least("start_ms", "other_start_ms"), F.greatest("end_ms", "other_end_ms", "last_unit_start")
    return pairs.select("video_id", "event", "first_unit", "last_unit", "tiou", within[0].alias("from_ms"), within[1].alias("to_ms"))


def match_runs(events: DataFrame, units: DataFrame, least: float, bin_ms: int) -> DataFrame:
    """As :func:`match_items` with every run of a chunk as an item, however many units it has."""
    return _best_first(run_candidates(events, units, least, bin_ms))


def match_segments(events: DataFrame, gold: DataFrame, least: float, bin_ms: int) -> DataFrame:
    """Plain one-to-one matching; among equal overlaps the higher event and the higher gold index go first."""
    pairs = iv.overlap_join(events, gold, bin_ms).withColumn("tiou", iv.tiou()).where(F.col("tiou") >= least)
    candidates = pairs.select(
        "video_id", F.col("idx").alias("event"), F.col("other_idx").alias("first_unit"), F.col("other_idx").alias("last_unit"), "tiou", *_reach()
    )
    order = F.struct(-F.col("tiou"), -F.col("event"), -F.col("first_unit"))
    split = islands(candidates, ["video_id"], "from_ms", "to_ms")
    made = greedy(split, ["video_id", "island"], order, ["event", "first_unit", "last_unit", "tiou"])
    return made.select("video_id", "event", F.col("first_unit").alias("gold"), "tiou")


def with_edges(events: DataFrame, units: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches with ``idx`` for their event, ``run`` for how many units they hold, and how far the farther edge is off (``edge_ms``).

    ``units`` have ``unit``, their place in the video.
    """
    first = units.select("video_id", F.col("unit").alias("first_unit"), F.col("start_ms").alias("run_start"))
    last = units.select("video_id", F.col("unit").alias("last_unit"), F.col("end_ms").alias("run_end"))
    spans = events.select("video_id", F.col("idx").alias("event"), "start_ms", "end_ms")
    off = F.greatest(F.abs(F.col("start_ms") - F.col("run_start")), F.abs(F.col("end_ms") - F.col("run_end")))
    held = F.col("last_unit") - F.col("first_unit") + 1
    joined = matches.join(spans, ["video_id", "event"]).join(first, ["video_id", "first_unit"]).join(last, ["video_id", "last_unit"])
    return joined.select("video_id", F.col("event").alias("idx"), "first_unit", "last_unit", "tiou", held.alias("run"), off.alias("edge_ms"))


def first_holder(events: DataFrame, units: DataFrame, cover: float, bin_ms: int) -> DataFrame:
    """For each unit the event that holds at least ``cover`` of it and was committed first; no commit time counts as last."""
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    held = iv.overlap_join(units, events, bin_ms).where(iv.overlap_ms() >= F.lit(cover) * length)
    rank = F.struct(F.coalesce("other_commit_ms", F.lit((1 << 62))), F.col("other_idx"))
    return held.groupBy("video_id", "idx").agg(
        F.min_by("other_idx", rank).alias("holder"),
        F.min_by("other_commit_ms", rank).alias("commit_ms"),
        F.first("end_ms").alias("end_ms"),
    )
