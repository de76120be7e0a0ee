"""Queries over timed spans, each beside its SQL twin.

Thresholds are those of the reference semantics stretched to the events table's scale: gaps of minutes to hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.operators import intervals as iv
from spanwright.operators import matching, scoring
from spanwright.sources.tables import SPANS_SQL, gold, predicted, spans, table

HOUR = 3_600_000
#: Fixed values of the scoring rules.
THRESHOLDS = [0.5, 0.7, 0.9]
CHUNK_GAP = 4 * HOUR
TRUSTED_GAP = 24 * HOUR
DELTA = 2 * HOUR
MOST_UNITS = 6
BIN = 24 * HOUR

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with recursive {SPANS_SQL}" + sql
        return f

    return add


TIOU_SQL = """case when greatest(p.end_ms - p.start_ms, 0) + greatest(g.end_ms - g.start_ms, 0)
    - greatest(least(p.end_ms, g.end_ms) - greatest(p.start_ms, g.start_ms), 0) > 0
  then greatest(least(p.end_ms, g.end_ms) - greatest(p.start_ms, g.start_ms), 0)::double
    / (greatest(p.end_ms - p.start_ms, 0) + greatest(g.end_ms - g.start_ms, 0)
       - greatest(least(p.end_ms, g.end_ms) - greatest(p.start_ms, g.start_ms), 0)) else 0 end"""

CHUNKS_SQL = f""",
marked as (select *, case when lag(end_ms) over w is null or start_ms - lag(end_ms) over w > {CHUNK_GAP} then 1 else 0 end as fresh
  from gold window w as (partition by video_id order by start_ms, end_ms, idx)),
chunked as (select video_id, idx, start_ms, end_ms,
    sum(fresh) over (partition by video_id order by start_ms, end_ms, idx rows unbounded preceding) as chunk
  from marked)"""

ITEMS_SQL = f"""{CHUNKS_SQL},
numbered as (select *, row_number() over (partition by video_id order by start_ms, end_ms, idx) - 1 as unit from chunked),
items as (select a.video_id, a.unit as first_unit, b.unit as last_unit, a.start_ms, b.end_ms
  from numbered a join numbered b on a.video_id = b.video_id and a.chunk = b.chunk
   and b.unit >= a.unit and b.unit - a.unit < {MOST_UNITS})"""


@query(f"{CHUNKS_SQL} select video_id, idx, cast(chunk as bigint) as chunk from chunked")
def gold_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.chunks(gold(spark, sf_dir), CHUNK_GAP).select("video_id", "idx", F.col("chunk").cast("long").alias("chunk"))


@query(f"""{ITEMS_SQL} select video_id, count(*) as n_items, max(last_unit - first_unit + 1) as longest, max(end_ms - start_ms) as widest_ms
from items group by video_id""")
def chunk_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = matching.chunk_items(iv.chunks(gold(spark, sf_dir), CHUNK_GAP), MOST_UNITS)
    return items.groupBy("video_id").agg(
        F.count("*").alias("n_items"),
        F.max("n_units").cast("long").alias("longest"),
        F.max(F.col("end_ms") - F.col("start_ms")).alias("widest_ms"),
    )


@query(f""", pairs as (select p.video_id, {TIOU_SQL} as tiou from pred p join gold g on p.video_id = g.video_id
  and p.start_ms < g.end_ms and g.start_ms < p.end_ms)
select t.threshold, count(*) as n_pairs, count(distinct video_id) as n_videos
from pairs join (values (0.1::double), (0.3), (0.5), (0.7)) t(threshold) on tiou >= t.threshold group by 1""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs over a threshold, many to many."""
    pairs = iv.overlap_join(predicted(spark, sf_dir), gold(spark, sf_dir), BIN).select("video_id", iv.tiou().alias("tiou"))
    grid = spark.createDataFrame([(0.1,), (0.3,), (0.5,), (0.7,)], "threshold double")
    joined = pairs.join(F.broadcast(grid), F.col("tiou") >= F.col("threshold"))
    return joined.groupBy("threshold").agg(F.count("*").alias("n_pairs"), F.countDistinct("video_id").alias("n_videos"))


def _matches(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    items = matching.chunk_items(iv.chunks(gold(spark, sf_dir), CHUNK_GAP), MOST_UNITS)
    return matching.match_items(predicted(spark, sf_dir), items, least, BIN)


MATCH_SQL = ITEMS_SQL + f""",
ranked as (select p.video_id, p.idx as event, g.first_unit, g.last_unit, {TIOU_SQL} as tiou
  from pred p join items g on p.video_id = g.video_id and p.start_ms < g.end_ms and g.start_ms < p.end_ms),
queue as (select *, row_number() over (partition by video_id order by -tiou, event, first_unit, last_unit) as n
  from ranked where tiou >= 0.3),
walk as (
  select video_id, 0::bigint as n, []::bigint[] as used_events, []::bigint[] as used_units, false as won, null::bigint as event,
    null::bigint as first_unit, null::bigint as last_unit, null::double as tiou
  from (select distinct video_id from queue)
  union all
  select q.video_id, q.n,
    case when ok then list_append(used_events, q.event) else used_events end,
    case when ok then list_concat(used_units, range(q.first_unit, q.last_unit + 1)) else used_units end,
    ok, q.event, q.first_unit, q.last_unit, q.tiou
  from (select w.used_events, w.used_units, q.*,
      not list_contains(w.used_events, q.event) and not list_has_any(w.used_units, range(q.first_unit, q.last_unit + 1)) as ok
    from walk w join queue q on q.video_id = w.video_id and q.n = w.n + 1) q),
matches as (select video_id, event, first_unit, last_unit, tiou from walk where won)"""
#: The same with runs of any number of units.
WHOLE_MATCH_SQL = MATCH_SQL.replace(f" and b.unit - a.unit < {MOST_UNITS}", "")


@query(f"{MATCH_SQL} select video_id, event, first_unit, last_unit, round(tiou, 9) as tiou from matches")
def edge_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one matches of predicted spans with runs of gold units."""
    found = _matches(spark, sf_dir, 0.3)
    return found.select(
        "video_id", "event", *[F.col(c).cast("long").alias(c) for c in ("first_unit", "last_unit")], F.round("tiou", 9).alias("tiou")
    )


@query(f"""{MATCH_SQL},
grid(threshold) as (values (0.3::double), (0.5), (0.7), (0.9)),
ne as (select video_id, count(*) as n_events from pred group by 1),
nu as (select video_id, count(*) as n_units from gold group by 1),
videos as (select coalesce(ne.video_id, nu.video_id) as video_id, n_events, n_units from ne full join nu on ne.video_id = nu.video_id),
hits as (select video_id, threshold, count(*) as tp, sum(last_unit - first_unit + 1) as covered from matches, grid where tiou >= threshold group by 1, 2),
rows as (select g.threshold, avg(coalesce(tp, 0)::double / n_events) as p, avg(coalesce(covered, 0)::double / n_units) as r
  from videos v cross join grid g left join hits h on h.video_id = v.video_id and h.threshold = g.threshold group by 1),
everything as (select * from rows union all select null, avg(p), avg(r) from rows)
select threshold, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as f1
from everything""")
def edge_match_main_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main score: match once at the lowest threshold, then two-level precision, recall and F1."""
    found = _matches(spark, sf_dir, 0.3)
    return scoring.grid_scores(found, predicted(spark, sf_dir), gold(spark, sf_dir), [0.3, *THRESHOLDS])


@query(f""", ranked as (select p.video_id, p.idx as event, g.idx as gold, {TIOU_SQL} as tiou
  from pred p join gold g on p.video_id = g.video_id and p.start_ms < g.end_ms and g.start_ms < p.end_ms),
queue as (select *, row_number() over (partition by video_id order by tiou desc, event desc, gold desc) as n from ranked where tiou >= 0.2),
walk as (
  select video_id, 0::bigint as n, []::bigint[] as ue, []::bigint[] as ug, false as won, null::bigint as event, null::bigint as gold, null::double as tiou
  from (select distinct video_id from queue)
  union all
  select q.video_id, q.n, case when ok then list_append(ue, q.event) else ue end, case when ok then list_append(ug, q.gold) else ug end,
    ok, q.event, q.gold, q.tiou
  from (select w.ue, w.ug, q.*, not list_contains(w.ue, q.event) and not list_contains(w.ug, q.gold) as ok
    from walk w join queue q on q.video_id = w.video_id and q.n = w.n + 1) q)
select video_id, event, gold, round(tiou, 9) as tiou from walk where won""")
def segment_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matches of single spans, ties to the higher indices."""
    found = matching.match_segments(predicted(spark, sf_dir), gold(spark, sf_dir), 0.2, BIN)
    return found.withColumn("tiou", F.round("tiou", 9))


@query(f""", seen as (select *, max(end_ms) over (partition by video_id order by start_ms, end_ms, idx rows between unbounded preceding and 1 preceding) as gap_start from gold)
select video_id, gap_start, start_ms as gap_end from seen where start_ms - gap_start > {TRUSTED_GAP}""")
def untrusted_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.untrusted_gaps(gold(spark, sf_dir), TRUSTED_GAP)


RUNS_SQL = f""", seen as (select *, max(end_ms) over (partition by video_id order by start_ms, end_ms, idx rows between unbounded preceding and 1 preceding) as reached from spans),
numbered as (select *, sum(case when reached is null or start_ms - reached > {DELTA} then 1 else 0 end)
  over (partition by video_id order by start_ms, end_ms, idx rows unbounded preceding) as run from seen),
runs as (select video_id, cast(run as bigint) as run, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as n_spans from numbered group by 1, 2)"""


@query(f"{RUNS_SQL} select * from runs")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = iv.merged_runs(spans(spark, sf_dir), DELTA)
    return runs.withColumn("run", F.col("run").cast("long"))


@query(f"""{RUNS_SQL.replace(f'> {DELTA}', '> 0')} select video_id, count(*) as n_runs, cast(sum(least(end_ms, 1296000000) - greatest(start_ms, 432000000)) as bigint) as covered_ms
from runs where start_ms < 1296000000 and end_ms > 432000000 group by 1""")
def covered_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a window, day 5 to day 15, the union of a stream's spans covers."""
    lo, hi = 432_000_000, 1_296_000_000
    runs = iv.merged_runs(spans(spark, sf_dir)).where((F.col("start_ms") < hi) & (F.col("end_ms") > lo))
    inside = F.least("end_ms", F.lit(hi)) - F.greatest("start_ms", F.lit(lo))
    return runs.groupBy("video_id").agg(F.count("*").alias("n_runs"), F.sum(inside).alias("covered_ms"))


@query(f""", seen as (select *, max(end_ms) over (w rows between unbounded preceding and 1 preceding) as reached, row_number() over w as rank
  from gold window w as (partition by video_id order by start_ms, end_ms, idx)),
cut as (select *, greatest(start_ms, coalesce(reached, start_ms)) as s, end_ms <= greatest(start_ms, coalesce(reached, start_ms)) as swallowed,
  coalesce(reached - start_ms > {DELTA}, false) as disputed from seen),
bad as (select video_id, rank, start_ms as a, case when swallowed then end_ms else reached end as b from cut where swallowed or disputed)
select video_id, idx, s as start_ms, end_ms, not disputed and not exists (select 1 from bad where bad.video_id = cut.video_id
  and bad.rank > cut.rank and bad.a < cut.end_ms and bad.b > cut.s) as reliable from cut where not swallowed""")
def clamped_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.clamp_overlaps(gold(spark, sf_dir), DELTA)


@query(""", zones as (select * from spans where kind = 'error'),
inside as (select p.video_id, p.idx, sum(least(p.end_ms, z.end_ms) - greatest(p.start_ms, z.start_ms)) as ms
  from gold p join zones z on p.video_id = z.video_id and p.start_ms < z.end_ms and z.start_ms < p.end_ms group by 1, 2)
select p.video_id, p.idx from gold p left join inside i on i.video_id = p.video_id and i.idx = p.idx
where 2 * coalesce(ms, 0) <= greatest(p.end_ms - p.start_ms, 1)""")
def outside_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = spans(spark, sf_dir).where("kind = 'error'")
    return iv.drop_quarantined(gold(spark, sf_dir), zones, BIN).select("video_id", "idx")


@query("""select video_id, idx from gold g where not exists (select 1 from pred p where p.video_id = g.video_id
  and p.start_ms < g.end_ms and g.start_ms < p.end_ms)""")
def uncaptioned_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that no predicted span touches."""
    touched = iv.overlap_join(gold(spark, sf_dir), predicted(spark, sf_dir), BIN).select("video_id", "idx").distinct()
    return gold(spark, sf_dir).join(touched, ["video_id", "idx"], "left_anti").select("video_id", "idx")


HOLD_SQL = """, committed as (select *, case when idx % 10 = 0 then null else end_ms + (idx % 7) * 600000 end as commit_ms from pred),
held as (select g.video_id, g.idx, g.end_ms, p.idx as holder, p.commit_ms,
    row_number() over (partition by g.video_id, g.idx order by coalesce(p.commit_ms, 4611686018427387904), p.idx) as n
  from gold g join committed p on p.video_id = g.video_id and p.start_ms < g.end_ms and g.start_ms < p.end_ms
  where least(g.end_ms, p.end_ms) - greatest(g.start_ms, p.start_ms) >= 0.5 * greatest(g.end_ms - g.start_ms, 1))"""


def _holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = F.when(F.col("idx") % 10 != 0, F.col("end_ms") + (F.col("idx") % 7) * 600_000)
    return matching.first_holder(predicted(spark, sf_dir).withColumn("commit_ms", delay), gold(spark, sf_dir), 0.5, BIN)


@query(f"{HOLD_SQL} select video_id, idx, holder, coalesce(commit_ms, -1) as commit_ms from held where n = 1")
def unit_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first holder of each unit; -1 stands for no commit time."""
    return _holders(spark, sf_dir).select("video_id", "idx", "holder", F.coalesce("commit_ms", F.lit(-1)).alias("commit_ms"))


@query(f"""{HOLD_SQL}, x as (select (commit_ms - end_ms) / 1000.0::double as x from held where n = 1 and commit_ms is not null),
r as (select x, row_number() over (order by x) - 1 as k, count(*) over () as n from x)
select count(*) as n, round(quantile_cont(x, 0.5), 6) as median_s, round(avg(x), 6) as mean_s,
  round(max(x) filter (where k = least(n - 1, round_even(0.9 * (n - 1), 0)::bigint)), 6) as p90_s from r""")
def held_unit_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.held_latency(_holders(spark, sf_dir))


@query(f"""select video_id, count(*) as n, count(*) filter (where nxt < end_ms) as n_early, coalesce(count(*) filter (where nxt < end_ms)::double / nullif(count(nxt), 0), 0) > 0.5 and count(*) >= 5 as scrolling
from (select *, lead(start_ms) over (partition by video_id order by start_ms, end_ms, idx) as nxt from spans) group by 1""")
def scrolling_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams most of whose spans begin before the span before has ended."""
    seen = spans(spark, sf_dir).withColumn("next", F.lead("start_ms").over(iv.by_video()))
    early = F.count_if(F.col("next") < F.col("end_ms"))
    n, following = F.count("*"), F.count("next")
    return seen.groupBy("video_id").agg(
        n.alias("n"),
        early.alias("n_early"),
        ((n >= 5) & F.coalesce(early / F.nullif(following, F.lit(0)) > 0.5, F.lit(False))).alias("scrolling"),
    )


@query(f""", judged as (select *, case when end_ms - start_ms < 1800000 then 'too short' when end_ms > 2505600000 then 'outside' when idx % 13 = 0 then 'no letter' end as reason,
  lag(end_ms) over w as before_ms, lead(start_ms) over w as after_ms from gold window w as (partition by video_id order by start_ms, end_ms, idx))
select video_id, idx, reason, case when reason = 'too short' then coalesce(before_ms, start_ms) else start_ms end as unk_start,
  case when reason = 'too short' then coalesce(after_ms, end_ms) else end_ms end as unk_end from judged""")
def unit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a unit breaks; the span of one that is too short widens to its neighbours."""
    w = iv.by_video()
    reason = (
        F.when(F.col("end_ms") - F.col("start_ms") < HOUR // 2, "too short")
        .when(F.col("end_ms") > 29 * 24 * HOUR, "outside")
        .when(F.col("idx") % 13 == 0, "no letter")
    )
    seen = gold(spark, sf_dir).withColumns({"reason": reason, "before": F.lag("end_ms").over(w), "after": F.lead("start_ms").over(w)})
    short = F.coalesce(F.col("reason") == "too short", F.lit(False))
    return seen.select(
        "video_id",
        "idx",
        "reason",
        F.when(short, F.coalesce("before", "start_ms")).otherwise(F.col("start_ms")).alias("unk_start"),
        F.when(short, F.coalesce("after", "end_ms")).otherwise(F.col("end_ms")).alias("unk_end"),
    )


@query("""select kind, count(*) as n, round(avg(d), 6) as mean_s, round(quantile_cont(d, 0.01), 6) as p1_s, round(quantile_cont(d, 0.5), 6) as median_s,
  max(d) as max_s from (select kind, (end_ms - start_ms) / 1000.0::double as d from spans) group by 1""")
def caption_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = spans(spark, sf_dir).select("kind", ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("d"))
    return lengths.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.round(F.avg("d"), 6).alias("mean_s"),
        F.round(F.percentile("d", F.lit(0.01)), 6).alias("p1_s"),
        F.round(F.percentile("d", F.lit(0.5)), 6).alias("median_s"),
        F.max("d").alias("max_s"),
    )


@query("""select count(*) as n, round(avg(ln(greatest(d, 0.001))), 6) as mu_log_s, round(stddev_pop(ln(greatest(d, 0.001))), 6) as sd_log_s,
  round(quantile_cont(d, 0.99), 6) as tail_start_s from (select (end_ms - start_ms) / 1000.0::double as d from gold)""")
def duration_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lognormal fit of unit durations with the population deviation, and where the tail starts."""
    d = gold(spark, sf_dir).select(((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("d"))
    log = F.log(F.greatest("d", F.lit(0.001)))
    return d.agg(
        F.count("*").alias("n"),
        F.round(F.avg(log), 6).alias("mu_log_s"),
        F.round(F.stddev_pop(log), 6).alias("sd_log_s"),
        F.round(F.percentile("d", F.lit(0.99)), 6).alias("tail_start_s"),
    )


@query(""", streams as (select video_id, max(end_ms) as total_ms from spans group by 1),
t as (select cast(quantile_disc(end_ms - start_ms, 0.5) as bigint) as tile from gold)
select video_id, k as idx, k * tile as start_ms, least((k + 1) * tile, total_ms) as end_ms
from streams, t, unnest(range(0, greatest(1, cast(ceil(total_ms / tile) as bigint)))) u(k)""")
def chance_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile every stream with the median unit duration: the floor that any segmenter must beat."""
    streams = spans(spark, sf_dir).groupBy("video_id").agg(F.max("end_ms").alias("total_ms"))
    lengths = gold(spark, sf_dir).select((F.col("end_ms") - F.col("start_ms")).alias("d"))
    tile = lengths.agg(F.expr("percentile_disc(0.5) within group (order by d)").cast("long")).first()[0]
    return iv.tiles(streams, int(tile))


@query(""", hours as (select video_id, sum(end_ms - start_ms) as ms from gold group by 1),
a as (select kind, count(*) as n from spans group by 1),
w as (select kind, pow(n, 0.5) as w from a), s as (select kind, w / sum(w) over () as share from w)
select s.kind, round(share, 9) as share, cast(floor(round(share * (select min(n / share) from a join s using (kind)), 6)) as bigint) as target from s""")
def pool_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that go with the root of each pool's size, and the largest total that repeats nothing."""
    pools = spans(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    weight = F.pow("n", F.lit(0.5))
    shares = pools.withColumn("share", weight / F.sum(weight).over(Window.partitionBy()))
    most = F.min(F.col("n") / F.col("share")).over(Window.partitionBy())
    return shares.select("kind", F.round("share", 9).alias("share"), F.floor(F.round(F.col("share") * most, 6)).alias("target"))


@query(f"""{MATCH_SQL},
outcome as (select n.video_id, n.unit, max(m.tiou) as tiou, max(case when m.last_unit > m.first_unit then 1 else 0 end) as joined
  from numbered n left join matches m on m.video_id = n.video_id and n.unit between m.first_unit and m.last_unit group by 1, 2)
select case when tiou is null then 'missed' when joined = 1 then 'joined' when tiou >= 0.7 then 'tight' else 'loose' end as outcome,
  count(*) as n_units, count(distinct video_id) as n_videos from outcome group by 1""")
def unit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each gold unit: missed, joined with neighbours, matched tightly or loosely."""
    found = _matches(spark, sf_dir, 0.3)
    numbered = gold(spark, sf_dir).withColumn("unit", F.row_number().over(iv.by_video()) - 1).select("video_id", "unit")
    hit = found.select("video_id", F.explode(F.sequence("first_unit", "last_unit")).alias("unit"), "tiou", (F.col("last_unit") > F.col("first_unit")).alias("joined"))
    seen = numbered.join(hit, ["video_id", "unit"], "left")
    outcome = F.when(F.col("tiou").isNull(), "missed").when(F.col("joined"), "joined").when(F.col("tiou") >= 0.7, "tight").otherwise("loose")
    return seen.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n_units"), F.countDistinct("video_id").alias("n_videos"))


@query(f"""{CHUNKS_SQL}, edges as (select *, lag(chunk) over w as pc, lead(chunk) over w as nc, lag(end_ms) over w as pe, lead(start_ms) over w as ns
  from chunked window w as (partition by video_id order by start_ms, end_ms, idx)),
sides as (select case when pc is null or pc <> chunk then 'chunk edge' when start_ms - pe > 0 then 'pause' when start_ms = pe then 'touching' else 'overlap' end as class, 'start' as side from edges
  union all select case when nc is null or nc <> chunk then 'chunk edge' when ns - end_ms > 0 then 'pause' when ns = end_ms then 'touching' else 'overlap' end, 'end' from edges)
select side, class, count(*) as n from sides group by grouping sets ((side, class), (side))""")
def gold_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of unit edges by what lies beyond them, with a margin over all classes of a side."""
    w = iv.by_video()
    seen = iv.chunks(gold(spark, sf_dir), CHUNK_GAP).withColumns(
        {"pc": F.lag("chunk").over(w), "nc": F.lead("chunk").over(w), "pe": F.lag("end_ms").over(w), "ns": F.lead("start_ms").over(w)}
    )

    def klass(other, gap):
        inside = F.coalesce(F.col(other) == F.col("chunk"), F.lit(False))
        return F.when(~inside, "chunk edge").when(gap > 0, "pause").when(gap == 0, "touching").otherwise("overlap")

    sides = F.explode(
        F.array(
            F.struct(F.lit("start").alias("side"), klass("pc", F.col("start_ms") - F.col("pe")).alias("class")),
            F.struct(F.lit("end").alias("side"), klass("nc", F.col("ns") - F.col("end_ms")).alias("class")),
        )
    ).alias("x")
    flat = seen.select(sides).select("x.*")
    return flat.groupingSets([["side", "class"], ["side"]], "side", "class").agg(F.count("*").alias("n"))
