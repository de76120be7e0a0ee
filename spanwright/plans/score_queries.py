"""Queries that explain scores: error types, boundary hits, classes of edges and chunks, each beside its SQL twin.

Error events play quarantined units here, so the captions are signups and purchases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import errors, matching
from spanwright.operators import intervals as iv
from spanwright.plans.span_queries import BIN, CHUNK_GAP, HOUR, WHOLE_MATCH_SQL
from spanwright.sources.tables import SPANS_SQL, gold, predicted, spans

TAUS = [HOUR, 4 * HOUR]
GRID = [0.3, 0.5, 0.7]
COVER = 0.5
MOST_SPAN = 36 * HOUR

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with recursive {SPANS_SQL}" + sql
        return f

    return add


def _all_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold units, with the error events among them as unreliable ones."""
    units = spans(spark, sf_dir).where(F.col("kind").isin("view", "click", "error"))
    return units.withColumn("reliable", F.col("kind") != "error").drop("kind")


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).where(F.col("kind").isin("signup", "purchase")).drop("kind")


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).groupBy("video_id").agg(F.max("end_ms").alias("total_ms"))


ALL_SQL = """,
units as (select video_id, idx, start_ms, end_ms, kind <> 'error' as reliable from spans where kind in ('view', 'click', 'error')),
captions as (select video_id, idx, start_ms, end_ms from spans where kind in ('signup', 'purchase')),
streams as (select video_id, max(end_ms) as total_ms from spans group by 1)"""

TYPE_SQL = """case when tiou >= threshold and edge_ms <= tau_ms then case when run = 1 then 'matched' else 'joined' end
  when depth > tau_ms then 'cut' when bridged then 'bridged' when held then 'offset' else '{alone}' end"""


def _side_sql(side: str, alone: str) -> str:
    return f"""select '{side}' as side, tau_ms, threshold, type, n, round(parts / round(sum(parts) over (partition by tau_ms, threshold)), 9) as share
  from (select tau_ms, threshold, {TYPE_SQL.format(alone=alone)} as type, count(*) as n, sum(part) as parts from {side}s, grid group by 1, 2, 3)"""


@query(f"""{WHOLE_MATCH_SQL},
grid as (select tau_ms, threshold from (values ({TAUS[0]}::bigint), ({TAUS[1]})) a(tau_ms), (values (0.3::double), (0.5), (0.7)) b(threshold)),
touching as (select p.video_id, p.idx, u.unit, greatest(least(p.start_ms - u.start_ms, u.end_ms - p.start_ms), least(p.end_ms - u.start_ms, u.end_ms - p.end_ms)) as depth,
    case when least(p.end_ms, u.end_ms) - greatest(p.start_ms, u.start_ms) >= {COVER} * greatest(u.end_ms - u.start_ms, 1) then u.chunk end as chunk
  from pred p join numbered u on p.video_id = u.video_id and p.start_ms < u.end_ms and u.start_ms < p.end_ms),
bridges as (select *, min(chunk) over w < max(chunk) over w as bridging from touching window w as (partition by video_id, idx)),
counted as (select m.*, m.last_unit - m.first_unit + 1 as run, greatest(abs(p.start_ms - a.start_ms), abs(p.end_ms - b.end_ms)) as edge_ms
  from matches m join pred p on p.video_id = m.video_id and p.idx = m.event
    join numbered a on a.video_id = m.video_id and a.unit = m.first_unit join numbered b on b.video_id = m.video_id and b.unit = m.last_unit),
ef as (select video_id, idx, max(depth) as depth, coalesce(bool_or(bridging), false) as bridged, count(chunk) > 0 as held from bridges group by 1, 2),
uf as (select video_id, unit, max(depth) as depth, coalesce(bool_or(bridging and chunk is not null), false) as bridged, count(chunk) > 0 as held from bridges group by 1, 2),
captions as (select p.video_id, depth, bridged, held, tiou, run, edge_ms, 1.0::double / count(*) over (partition by p.video_id) as part
  from pred p left join ef on ef.video_id = p.video_id and ef.idx = p.idx left join counted c on c.video_id = p.video_id and c.event = p.idx),
units as (select p.video_id, depth, bridged, held, tiou, run, edge_ms, 1.0::double / count(*) over (partition by p.video_id) as part
  from numbered p left join uf on uf.video_id = p.video_id and uf.unit = p.unit left join counted c on c.video_id = p.video_id and p.unit between c.first_unit and c.last_unit)
{_side_sql("caption", "phantom")} union all {_side_sql("unit", "missed")}""")
def edge_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six types of captions and of units for each cell of edge limit and overlap threshold."""
    chunked = errors.numbered_units(iv.chunks(gold(spark, sf_dir), CHUNK_GAP))
    events = predicted(spark, sf_dir)
    found = matching.match_runs(events, chunked, GRID[0], BIN)
    return errors.error_types(events, chunked, found, TAUS, GRID, COVER, BIN)


EDGES_SQL = f"""{ALL_SQL},
ranked as (select *, row_number() over (partition by video_id order by start_ms, end_ms, idx) as k from units),
beside as (select u.*, (select arg_max(struct_pack(e := b.end_ms, r := b.reliable), b.end_ms * 1048576 - b.k) from ranked b where b.video_id = u.video_id and b.k < u.k) as before,
    (select struct_pack(s := b.start_ms, r := b.reliable) from ranked b where b.video_id = u.video_id and b.k = u.k + 1) as after
  from ranked u),
edges as (select b.video_id, idx, 'start' as side, start_ms as at_ms, case when case when before is null then start_ms else start_ms - before.e end > {CHUNK_GAP} then 'pause'
    when before is null then 'stream' when before.r then 'abutting' else 'quarantine' end as class from beside b where reliable
  union all
  select b.video_id, idx, 'end', end_ms, case when case when after is null then total_ms - end_ms else after.s - end_ms end > {CHUNK_GAP} then 'pause'
    when after is null then 'stream' when after.r then 'abutting' else 'quarantine' end from beside b join streams using (video_id) where reliable)"""


@query(f"{EDGES_SQL} select * from edges")
def edge_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.edge_classes(_all_units(spark, sf_dir), _streams(spark, sf_dir), CHUNK_GAP)


@query(f"""{EDGES_SQL},
sides as (select video_id, idx as event, 'start' as side, start_ms as caption_ms from captions union all select video_id, idx, 'end', end_ms from captions),
near as (select e.video_id, e.side, e.idx as gold, s.event, abs(at_ms - caption_ms) as distance, row_number() over (partition by e.video_id, e.side order by abs(at_ms - caption_ms), at_ms, caption_ms, e.idx, s.event) as n
  from edges e join sides s on s.video_id = e.video_id and s.side = e.side and abs(at_ms - caption_ms) <= {TAUS[1]}),
walk as (
  select video_id, side, 0::bigint as n, []::bigint[] as ue, []::bigint[] as ug, false as won, null::bigint as gold, null::bigint as distance from (select distinct video_id, side from near)
  union all
  select q.video_id, q.side, q.n, case when ok then list_append(ue, q.event) else ue end, case when ok then list_append(ug, q.gold) else ug end, ok, q.gold, q.distance
  from (select w.ue, w.ug, q.*, not list_contains(w.ue, q.event) and not list_contains(w.ug, q.gold) as ok
    from walk w join near q on q.video_id = w.video_id and q.side = w.side and q.n = w.n + 1) q),
found as (select e.*, distance from edges e left join walk w on w.won and w.video_id = e.video_id and w.side = e.side and w.gold = e.idx),
counted as (select side, tau_ms, class, count(*) as gold_edges, count(*) filter (where distance <= tau_ms) as hit_edges
  from found, (values ({TAUS[0]}::bigint), ({TAUS[1]})) t(tau_ms) group by grouping sets ((side, tau_ms, class), (side, tau_ms))),
totals as (select side, count(*) as caption_edges from sides group by 1)
select side, tau_ms, coalesce(class, 'all') as class, gold_edges, hit_edges, round(hit_edges::double / gold_edges, 9) as hit_rate,
  case when class is null then caption_edges end as caption_edges, case when class is null then round(hit_edges::double / caption_edges, 9) end as edge_precision
from counted join totals using (side)""")
def boundary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many gold edges have a caption edge of their own within each limit, by what lies beyond the edge."""
    edges = errors.edge_classes(_all_units(spark, sf_dir), _streams(spark, sf_dir), CHUNK_GAP)
    return errors.boundary_hits(_captions(spark, sf_dir), edges, TAUS)


CLASSES_SQL = f"""{ALL_SQL},
marked as (select *, case when lag(end_ms) over w is null or not lag(reliable) over w or not reliable or start_ms - lag(end_ms) over w > {CHUNK_GAP} then 1 else 0 end as fresh
  from units window w as (partition by video_id order by start_ms, end_ms, idx)),
chunked as (select *, sum(fresh) over (partition by video_id order by start_ms, end_ms, idx rows unbounded preceding) as chunk from marked),
chunks as (select video_id, chunk, min(start_ms) as a, arg_max(end_ms, (start_ms, end_ms, idx)) as b from chunked where reliable group by 1, 2),
classes as (select c.video_id, cast(chunk as bigint) as chunk, a as start_ms, b as end_ms, case when b - a > {MOST_SPAN} then 'over_cap' when a <= {CHUNK_GAP} then 'video_start'
  when exists (select 1 from units q where q.video_id = c.video_id and not reliable and a - q.end_ms between 0 and {CHUNK_GAP} and q.start_ms < 0) then 'cut_start'
  when exists (select 1 from units q where q.video_id = c.video_id and not reliable and a - q.end_ms between 0 and {CHUNK_GAP}) then 'after_quarantine'
  when total_ms - b <= {CHUNK_GAP} or exists (select 1 from units q where q.video_id = c.video_id and not reliable and q.start_ms - b between 0 and {CHUNK_GAP}) then 'end_blocked'
  else 'free' end as class from chunks c join streams using (video_id))"""


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = _all_units(spark, sf_dir)
    chunked = iv.chunks(every, CHUNK_GAP).where("reliable")
    return chunked, errors.chunk_classes(chunked, every.where("not reliable"), _streams(spark, sf_dir), CHUNK_GAP, MOST_SPAN)


@query(f"{CLASSES_SQL} select * from classes")
def chunk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir)[1].withColumn("chunk", F.col("chunk").cast("long"))


@query(f"""{CLASSES_SQL}, judged as (select c.class, exists (select 1 from captions p where p.video_id = u.video_id and p.start_ms < u.end_ms and u.start_ms < p.end_ms) as touched
  from chunked u join classes c on c.video_id = u.video_id and c.chunk = u.chunk where u.reliable)
select class, count(*) as units, count(*) filter (where not touched) as uncaptioned from judged group by 1""")
def chunk_class_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and units that no caption touches, by the class of their chunk."""
    chunked, classes = _classes(spark, sf_dir)
    touched = iv.touched_spans(chunked, _captions(spark, sf_dir), BIN).withColumn("touched", F.lit(True))
    judged = chunked.join(classes.select("video_id", "chunk", "class"), ["video_id", "chunk"]).join(touched, ["video_id", "start_ms", "end_ms"], "left")
    return judged.groupBy("class").agg(F.count("*").alias("units"), F.count_if(F.col("touched").isNull()).alias("uncaptioned"))


@query(f"""{ALL_SQL}, w as (select video_id, start_ms, end_ms from units where reliable),
cues as (select video_id, end_ms as a, lead(start_ms) over (partition by video_id order by start_ms, end_ms, idx) as b from spans where kind = 'error'),
inner_ as (select w.video_id, w.start_ms, w.end_ms, least(a, b) as x, greatest(a, b) as y from w join cues c on c.video_id = w.video_id and b is not null and least(a, b) > w.start_ms and greatest(a, b) < w.end_ms),
ce as (select video_id, unnest([start_ms, end_ms]) as at_ms from captions),
inside as (select t.tau_ms, w.video_id, w.start_ms, w.end_ms, at_ms from w join ce on ce.video_id = w.video_id cross join (values ({TAUS[0]}::bigint), ({TAUS[1]})) t(tau_ms)
  where at_ms > w.start_ms + tau_ms and at_ms < w.end_ms - tau_ms)
select tau_ms, count(*) as inside_edges, count(*) filter (where exists (select 1 from inner_ i where i.video_id = n.video_id and i.start_ms = n.start_ms and i.end_ms = n.end_ms and n.at_ms between x - tau_ms and y + tau_ms)) as at_cue_break
from inside n group by 1""")
def cue_edge_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption edges deep inside a unit, and those of them that lie at a junction of display cues inside the unit."""
    units = gold(spark, sf_dir).withColumnRenamed("idx", "unit")
    cues = spans(spark, sf_dir).where("kind = 'error'")
    junctions = cues.select("video_id", F.col("end_ms").alias("a"), F.lead("start_ms").over(iv.by_video()).alias("b")).where("b is not null")
    return errors.cue_edges(_captions(spark, sf_dir), units, junctions, TAUS, BIN)
