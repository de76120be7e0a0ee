"""The main score on its whole grid, by class of chunk, without capped captions and against another system, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import intervals as iv
from spanwright.operators import errors, matching, scoring
from spanwright.plans import span_queries
from spanwright.plans.score_queries import CLASSES_SQL, COVER, GRID, TAUS, _captions, _classes
from spanwright.plans.span_queries import BIN, CHUNK_GAP, CHUNKS_SQL, HOUR, MATCH_SQL, MOST_UNITS, WHOLE_MATCH_SQL
from spanwright.sources.tables import SPANS_SQL, gold, predicted

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with recursive {SPANS_SQL}" + sql
        return f

    return add


#: The walk over single spans, without its last line.
ORACLE_SEGMENTS = span_queries.ORACLE_SQL["segment_matches"].removeprefix(f"with recursive {SPANS_SQL}").rsplit("select video_id, event", 1)[0].replace("tiou >= 0.2", "tiou >= 0.3")
CELLS_SQL = f"""values ({TAUS[0]}::bigint), ({TAUS[1]})"""
COUNTED_SQL = """,
counted as (select m.*, m.last_unit - m.first_unit + 1 as run, greatest(abs(p.start_ms - a.start_ms), abs(p.end_ms - b.end_ms)) as edge_ms
  from matches m join pred p on p.video_id = m.video_id and p.idx = m.event
    join numbered a on a.video_id = m.video_id and a.unit = m.first_unit join numbered b on b.video_id = m.video_id and b.unit = m.last_unit)"""
GRID_SQL = f""",
grid as (select tau_ms, threshold from ({CELLS_SQL}, (9223372036854775807)) a(tau_ms), (values (0.3::double), (0.5), (0.7)) b(threshold)),
per_video as (select coalesce(e.video_id, u.video_id) as video_id, n_events, n_units from (select video_id, count(*) as n_events from pred group by 1) e full join (select video_id, count(*) as n_units from gold group by 1) u on e.video_id = u.video_id),
hits as (select video_id, tau_ms, threshold, count(*) as tp, sum(run) as covered from counted, grid where tiou >= threshold and edge_ms <= tau_ms group by 1, 2, 3),
cells as (select g.tau_ms, g.threshold, avg(coalesce(tp, 0)::double / n_events) as p, avg(coalesce(covered, 0)::double / n_units) as r
  from per_video v cross join grid g left join hits h on h.video_id = v.video_id and h.tau_ms = g.tau_ms and h.threshold = g.threshold group by 1, 2),
limited as (select * from cells where tau_ms < 9223372036854775807), free as (select * from cells where tau_ms = 9223372036854775807),
margins as (select 'cell' as scope, tau_ms, threshold, p, r from limited
  union all select 'by_tau', tau_ms, null, avg(p), avg(r) from limited group by tau_ms
  union all select 'by_tiou', null, threshold, avg(p), avg(r) from limited group by threshold
  union all select 'avg', null, null, avg(p), avg(r) from limited
  union all select 'free_cell', null, threshold, p, r from free
  union all select 'free_avg', null, null, avg(p), avg(r) from free)"""
SCORES_SQL = "select scope, tau_ms, threshold, round(p, 9) as precision, round(r, 9) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as f1 from margins"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.numbered_units(iv.chunks(gold(spark, sf_dir), CHUNK_GAP))


def _counted(units: DataFrame, events: DataFrame) -> DataFrame:
    found = matching.match_items(events, matching.chunk_items(units.drop("unit"), MOST_UNITS), 0.3, BIN)
    return matching.with_edges(events, units, found)


@query(f"{MATCH_SQL}{COUNTED_SQL}{GRID_SQL} {SCORES_SQL}")
def edge_score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main score by edge limit and overlap, with all margins."""
    units, events = _units(spark, sf_dir), predicted(spark, sf_dir)
    return scoring.edge_grid(_counted(units, events), events, units, TAUS, GRID)


#: Every fourth caption plays one that the cap on open spans cut.
CUT = "idx % 4 = 0"
REST_SQL = MATCH_SQL.replace("from pred p", "from rest p") + COUNTED_SQL + GRID_SQL.replace("from pred ", "from rest ")


@query(f", rest as (select * from pred where not {CUT}){REST_SQL} {SCORES_SQL}")
def scores_without_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid once the captions that the cap cut are gone; the others are matched anew."""
    units, events = _units(spark, sf_dir), predicted(spark, sf_dir).where(f"not {CUT}")
    return scoring.edge_grid(_counted(units, events), events, units, TAUS, GRID)


@query(f"""{MATCH_SQL}{COUNTED_SQL}, grid as (select tau_ms, threshold from ({CELLS_SQL}) a(tau_ms), (values (0.3::double), (0.5), (0.7)) b(threshold)),
cut as (select * from pred where {CUT}),
whole as (select count(*) as captions, (select count(*) from cut c join gold g on c.video_id = g.video_id and c.start_ms < g.end_ms and g.start_ms < c.end_ms where least(c.end_ms, g.end_ms) - greatest(c.start_ms, g.start_ms) >= {COVER} * greatest(g.end_ms - g.start_ms, 1)) as units_held,
  round(count(*) / (select sum(n) / {HOUR}::double from (select max(end_ms) as n from spans group by video_id)), 9) as per_hour from cut),
per as (select tau_ms, threshold, count(c.event) as matched, coalesce(sum(run), 0)::bigint as matched_units from grid left join (select * from counted where event % 4 = 0) c on tiou >= threshold and edge_ms <= tau_ms group by 1, 2)
select * from per, whole""")
def capped_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that the cap cut: how many, by the hour, the units they hold, and what they add to each cell."""
    units, events = _units(spark, sf_dir), predicted(spark, sf_dir)
    cut = events.where(CUT)
    grid = spark.createDataFrame([(t, h) for t in TAUS for h in GRID], "tau_ms long, threshold double")
    counts = (F.col("tiou") >= F.col("threshold")) & (F.col("edge_ms") <= F.col("tau_ms"))
    sums = _counted(units, events).where(CUT).crossJoin(F.broadcast(grid)).where(counts).groupBy("tau_ms", "threshold").agg(F.count("*").alias("matched"), F.sum("run").cast("long").alias("matched_units"))
    cells = grid.join(F.broadcast(sums), ["tau_ms", "threshold"], "left").fillna(0)
    length = F.greatest(F.col("other_end_ms") - F.col("other_start_ms"), F.lit(1))
    held = iv.overlap_join(cut, gold(spark, sf_dir), BIN).where(iv.overlap_ms() >= F.lit(COVER) * length).agg(F.count("*").alias("units_held"))
    ends = predicted(spark, sf_dir).drop("kind").unionByName(gold(spark, sf_dir)).groupBy("video_id").agg(F.max("end_ms").alias("total"))
    hours = ends.agg((F.sum("total") / HOUR).alias("hours"))
    whole = cut.agg(F.count("*").alias("captions")).crossJoin(held).crossJoin(hours).select("captions", "units_held", F.round(F.col("captions") / F.col("hours"), 9).alias("per_hour"))
    return cells.crossJoin(F.broadcast(whole))


@query(f"""{CLASSES_SQL}{WHOLE_MATCH_SQL[len(CHUNKS_SQL):].replace("from chunked)", "from chunked where reliable)").replace("from pred p", "from captions p")}{COUNTED_SQL.replace("join pred p", "join captions p")},
cells as (select tau_ms, threshold from ({CELLS_SQL}) a(tau_ms), (values (0.3::double), (0.5), (0.7)) b(threshold)),
part as (select n.video_id, n.unit, count(c.event)::double / 6 as part from numbered n left join (counted join cells on tiou >= threshold and edge_ms <= tau_ms) c on c.video_id = n.video_id and n.unit between c.first_unit and c.last_unit group by 1, 2),
judged as (select k.class, part, exists (select 1 from captions p where p.video_id = n.video_id and p.start_ms < n.end_ms and n.start_ms < p.end_ms) as touched
  from numbered n join part using (video_id, unit) join classes k on k.video_id = n.video_id and k.chunk = n.chunk)
select class, count(*) as units, round(avg(part), 9) as matched_share, count(*) filter (where not touched) as uncaptioned from judged group by 1""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by the class of their chunk: the share that counts, averaged over the cells, and those that no caption touches."""
    chunked, classes = _classes(spark, sf_dir)
    units, events = errors.numbered_units(chunked), _captions(spark, sf_dir)
    touched = iv.overlap_join(units, events, BIN).select("video_id", "unit").distinct()
    named = units.join(classes.select("video_id", "chunk", "class"), ["video_id", "chunk"]).select("video_id", "unit", "class")
    counted = matching.with_edges(events, units, matching.match_runs(events, units, GRID[0], BIN))
    return scoring.class_cells(counted, named, touched, TAUS, GRID)


@query(f"""{MATCH_SQL}, rest as (select * from pred where not {CUT}),
{MATCH_SQL[MATCH_SQL.index("ranked as"):].replace("from pred p", "from rest p").replace("ranked", "ranked_b").replace("queue", "queue_b").replace("walk", "walk_b").replace("matches as", "matches_b as")},
a as (select n.video_id, n.unit, m.tiou from numbered n join matches m on m.video_id = n.video_id and n.unit between m.first_unit and m.last_unit),
b as (select n.video_id, n.unit, m.tiou from numbered n join matches_b m on m.video_id = n.video_id and n.unit between m.first_unit and m.last_unit)
select count(*) filter (where b.tiou is null) as fixed, count(*) filter (where a.tiou is null) as broken, count(*) filter (where a.tiou - b.tiou > 0.01) as better, count(*) filter (where a.tiou - b.tiou < -0.01) as worse from a full join b on a.video_id = b.video_id and a.unit = b.unit""")
def unit_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All captions against those that no cap cut: which units only one side locates, and where one overlaps better."""
    units, events = _units(spark, sf_dir), predicted(spark, sf_dir)
    rows = lambda e: _counted(units, e).select("video_id", F.explode(F.sequence("first_unit", "last_unit")).alias("unit"), F.col("tiou").alias("score"))
    return scoring.flips(rows(events), rows(events.where(f"not {CUT}")), 0.01)


@query(ORACLE_SEGMENTS + """, m as (select threshold, tiou, w.video_id from walk w, (values (0.3::double), (0.5), (0.7)) t(threshold) where won and tiou >= threshold),
ne as (select video_id, count(*) as k from pred group by 1), nu as (select video_id, count(*) as k from gold group by 1),
r as (select threshold, (select avg(coalesce(c, 0)::double / ne.k) from ne left join (select video_id, count(*) as c from m where m.threshold = t.threshold group by 1) x using (video_id)) as p,
  (select avg(coalesce(c, 0)::double / nu.k) from nu left join (select video_id, count(*) as c from m where m.threshold = t.threshold group by 1) x using (video_id)) as r from (values (0.3::double), (0.5), (0.7)) t(threshold))
select r.threshold, round(any_value(p), 9) as precision, round(any_value(r), 9) as recall, round(case when any_value(p + r) > 0 then 2 * any_value(p * r) / any_value(p + r) else 0 end, 9) as f1,
  (select count(*) from pred) - count(tiou) as unmatched_events, (select count(*) from gold) - count(tiou) as missed_units, round(avg(tiou), 9) as mean_tiou, round(min(tiou), 9) as p0_tiou, round(quantile_cont(tiou, 0.25), 9) as p25_tiou,
  round(quantile_cont(tiou, 0.5), 9) as p50_tiou, round(quantile_cont(tiou, 0.75), 9) as p75_tiou, round(max(tiou), 9) as p100_tiou
from r left join m using (threshold) group by r.threshold""")
def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of single spans matched one to one, by threshold."""
    units, events = gold(spark, sf_dir), predicted(spark, sf_dir)
    return scoring.segment_scores(matching.match_segments(events, units, 0.3, BIN), events, units, GRID)
