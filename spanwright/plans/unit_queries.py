"""Queries from cues to units and from units to frames, each beside its SQL twin.  An event's kind plays its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.operators import captions as cp
from spanwright.operators import intervals as iv
from spanwright.operators import labels
from spanwright.plans.score_queries import ALL_SQL, _all_units, _captions, _streams
from spanwright.plans.span_queries import BIN, HOUR, TRUSTED_GAP
from spanwright.sources.tables import SPANS_SQL, spans, table
from spanwright.streaming.commit_gate import Config, replay

SHORTEST, LONGEST = 8 * HOUR, 40 * HOUR

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with recursive {SPANS_SQL}" + sql
        return f

    return add


@query(""", queue as (select *, row_number() over (partition by video_id order by start_ms, end_ms, idx) as n from spans),
walk as (
  select video_id, n, 1 as grp, start_ms as s, end_ms as e, kind as t from queue where n = 1
  union all
  select q.video_id, q.n, case when ok then grp else grp + 1 end, case when ok then s else q.start_ms end, case when ok then greatest(e, q.end_ms) else q.end_ms end,
    case when ok and length(q.kind) < length(t) then t else q.kind end
  from (select w.grp, w.s, w.e, w.t, q.*, q.start_ms < w.e and (contains(q.kind, w.t) or contains(w.t, q.kind)) as ok from walk w join queue q on q.video_id = w.video_id and q.n = w.n + 1) q)
select video_id, arg_max(s, n) as start_ms, arg_max(e, n) as end_ms, arg_max(t, n) as text from walk group by video_id, grp""")
def merged_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.merge_rolling(spans(spark, sf_dir).withColumnRenamed("kind", "text"))


CUE_WORDS = 12
RUNNING_SQL = rf""", w as (select conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from conversations where text is not null),
cues as (select conv_id as video_id, turn * 600000 + k * 4000 as s, turn * 600000 + k * 4000 + 3500 as e, array_to_string(w[k * {CUE_WORDS} + 1:k * {CUE_WORDS} + {CUE_WORDS}], ' ') as text from w, unnest(range(0, ceil(len(w) / {CUE_WORDS}.0)::bigint)) t(k)),
cased as (select video_id, bool_or(regexp_matches(text, '\p{{Lu}}')) and bool_or(regexp_matches(text, '\p{{Ll}}')) as cased from cues group by 1),
near as (select cues.*, cased, lag(text) over w as before, s - lag(e) over w as gap, regexp_matches(regexp_extract(text, '\p{{L}}'), '^\p{{Ll}}') as small, regexp_matches(regexp_extract(text, '[A-Za-z][\p{{L}}\p{{N}}_'']*'), '^I($|'')') as me
  from cues join cased using (video_id) window w as (partition by video_id order by s)),
runs as (select *, sum(case when coalesce(gap <= 8000 and (gap <= 500 or not cased or small or me) and case when regexp_matches(before, '(?i)(^|[^a-z])(dr|mr|mrs|ms|st|prof|rev|sen|gen|gov|lt|col|capt|sgt|mt)\.$') then true
  when regexp_matches(before, '\.\.[")\]'']*$') then small or starts_with(text, '..') when regexp_matches(before, '[.!?][")\]'']*$') then cased and small else true end, false) then 0 else 1 end) over (partition by video_id order by s rows unbounded preceding) as run from near),
joined as (select video_id, run, min(s) as s, max(e) as e, count(*) as n, string_agg(text, ' ' order by s) as j, list_filter(string_split(string_agg(text, ' ' order by s), ' '), lambda x: x <> '') as words from runs group by 1, 2),
judged as (select *, regexp_matches(j, '[.!?][")\]'']*$') and list_max(list_transform(string_split_regex(j, '[.!?]+[")\]'']*\s+'), lambda x: len(list_filter(string_split(x, ' '), lambda y: y <> '')))) <= 60 as ended,
  len(words) / greatest((e - s) / 1000.0::double, 0.001) >= 0.3 and not (len(words) <= 2.5::double * n and len(list_filter(words, lambda x: regexp_matches(x, '^\P{{L}}*\p{{Lu}}'))) >= 0.6::double * len(words)) as prose from joined)
select video_id, s as start_ms, e as end_ms, case when ended then regexp_replace(j, '([^.])\.([")\]'']*)[ \t]+([^ \t])', '\1,\2 \3', 'g') else j end as text, n as n_cues from judged where n = 1 or (ended and prose)
union all select r.video_id, r.s, r.e, r.text, 1 from runs r join judged g on g.video_id = r.video_id and g.run = r.run where not (n = 1 or (ended and prose))"""


@query(RUNNING_SQL)
def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues of twelve words, half a second apart within a turn, so that sentences run over cues."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").withColumn("w", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    cut = turns.where(F.size("w") > 0).select("*", F.posexplode(F.sequence(F.lit(1), F.size("w"), F.lit(CUE_WORDS))).alias("k", "at"))
    start = (F.col("turn") * 600_000 + F.col("k") * 4000).cast("long")
    words = F.array_join(F.slice("w", F.col("at"), F.lit(CUE_WORDS)), " ")
    cues = cut.select(F.col("conv_id").alias("video_id"), (F.col("turn") * 1000 + F.col("k")).alias("idx"), start.alias("start_ms"), (start + 3500).alias("end_ms"), words.alias("text"))
    return cp.group_sentences(cues, 8000, 500)


@query(f"""{ALL_SQL}, w as (select * from units where reliable), marks as (select * from units where not reliable)
select video_id, idx, start_ms, end_ms, not exists (select 1 from marks m where m.video_id = w.video_id and m.start_ms < w.end_ms and w.start_ms < m.end_ms) as reliable from w
union all select video_id, idx, start_ms, end_ms, false from marks""")
def marked_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _all_units(spark, sf_dir)
    return cp.mark_unreliable(every.where("reliable"), every.where("not reliable"), BIN)


CAPTION_RUNS_SQL = """
cr as (select video_id, idx, floor(start_ms / 3600000.0)::bigint as a, ceil(end_ms / 3600000.0)::bigint as b from captions),
cs as (select *, max(b) over (partition by video_id order by a, b, idx rows between unbounded preceding and 1 preceding) as reached from cr),
cn as (select *, sum(case when reached is null or a - reached > 0 then 1 else 0 end) over (partition by video_id order by a, b, idx rows unbounded preceding) as run from cs),
flat as (select video_id, run, min(a) as a, max(b) as b from cn group by 1, 2)"""


@query(f"""{ALL_SQL}, {CAPTION_RUNS_SQL},
framed as (select video_id, idx, reliable, start_ms, end_ms, greatest(floor(start_ms / 3600000.0)::bigint, 0) as a, ceil(end_ms / 3600000.0)::bigint as b from units),
inside as (select f.video_id, f.idx, sum(least(f.b, r.b) - greatest(f.a, r.a)) as frames from framed f join flat r on r.video_id = f.video_id and f.a < r.b and r.a < f.b group by 1, 2)
select f.video_id, f.idx, f.reliable and coalesce(frames, 0) < 0.5 * (b - a) as reliable from framed f left join inside i on i.video_id = f.video_id and i.idx = f.idx""")
def quarantined_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units at least half of whose hours lie in runs of other events."""
    hour = lambda f, c: f(F.col(c) / HOUR)
    runs = _captions(spark, sf_dir).select("video_id", "idx", hour(F.floor, "start_ms").alias("a"), hour(F.ceil, "end_ms").alias("b"))
    return cp.quarantine_units(_all_units(spark, sf_dir), runs, 0.5, HOUR, 24).select("video_id", "idx", "reliable")


SEGMENTS_SQL = f"""{ALL_SQL},
er as (select *, max(end_ms) over (partition by video_id order by start_ms, end_ms, idx rows between unbounded preceding and 1 preceding) as reached from units where not reliable),
en as (select *, sum(case when reached is null or start_ms - reached > {2 * HOUR - 1} then 1 else 0 end) over (partition by video_id order by start_ms, end_ms, idx rows unbounded preceding) as run from er),
em as (select video_id, run, min(start_ms) as s, max(end_ms) as e from en group by 1, 2),
cuts as (select em.video_id, total_ms, case when s < {2 * HOUR} then 0 else s end as a, case when total_ms - e < {2 * HOUR} then total_ms else e end as b from em join streams using (video_id)),
segments as (select * from (
  select video_id, coalesce(lag(b) over (partition by video_id order by a), 0) as seg_start, a as seg_end from cuts
  union all select s.video_id, coalesce(max(b), 0), any_value(s.total_ms) from streams s left join cuts c on c.video_id = s.video_id group by 1) where seg_end > seg_start)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.clean_segments(_all_units(spark, sf_dir).where("not reliable").drop("reliable"), _streams(spark, sf_dir), 2 * HOUR)


@query(f"{SEGMENTS_SQL} select video_id, seg_start, seg_end from segments")
def clean_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


@query(f"""{SEGMENTS_SQL} select u.video_id, seg_start, idx, start_ms - seg_start as start_ms, end_ms - seg_start as end_ms,
  start_ms >= seg_start and (seg_end = total_ms or end_ms <= seg_end) as reliable
from units u join segments s on s.video_id = u.video_id and u.end_ms > seg_start and u.start_ms < seg_end join streams t on t.video_id = u.video_id where u.reliable""")
def segment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _all_units(spark, sf_dir).where("reliable")
    return cp.split_units(units, _segments(spark, sf_dir), _streams(spark, sf_dir), BIN)


def _labels_sql(name: str, units: str) -> str:
    """Tags of an hour each; the painters in order, the last on top."""
    return f""",
{name}_r as (select *, row_number() over (partition by video_id order by start_ms, end_ms, idx) as rank, max(end_ms) over (partition by video_id order by start_ms, end_ms, idx rows between unbounded preceding and 1 preceding) as reached from {units}),
{name}_g as (select video_id, reached as a, start_ms as b from {name}_r where reached is not null
  union all select s.video_id, 0, coalesce(min(start_ms), any_value(total_ms)) from streams s left join {name}_r r using (video_id) group by 1
  union all select s.video_id, max(end_ms), any_value(total_ms) from streams s join {name}_r r using (video_id) group by 1),
{name}_p as (select video_id, unnest(range(0, greatest(1, round(total_ms / 3600000.0)::bigint))) as frame, -2 as rank, 1 as tag from streams
  union all select video_id, unnest(range(ceil(a / 3600000.0)::bigint, ceil(b / 3600000.0)::bigint)), -1, 0 from {name}_g where b - a > {TRUSTED_GAP}
  union all select video_id, frame, rank, case when not reliable then 0 when frame = ceil(start_ms / 3600000.0) then 2 else 3 end
    from (select *, unnest(range(ceil(start_ms / 3600000.0)::bigint, ceil(end_ms / 3600000.0)::bigint)) as frame from {name}_r)),
{name} as (select p.video_id as stream_id, frame, arg_max(tag, rank)::integer as tag from {name}_p p join streams s on s.video_id = p.video_id and frame < greatest(1, round(total_ms / 3600000.0)) group by 1, 2)"""


def _labels(spark: SparkSession, sf_dir: str, units: DataFrame) -> DataFrame:
    streams = _streams(spark, sf_dir)
    return labels.frame_labels(units, iv.untrusted_gaps(units, TRUSTED_GAP, streams), streams, HOUR)


LABELS_SQL = ALL_SQL + _labels_sql("gold_tags", "units")
PAIRS_SQL = LABELS_SQL + ", caps as (select *, true as reliable from captions)" + _labels_sql("pred_tags", "caps") + """,
pairs as (select g.stream_id, g.frame, g.tag as gold, case when q.tag = 0 then 1 else q.tag end as pred from gold_tags g join pred_tags q using (stream_id, frame))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold tags beside those of the captions; a prediction knows no unknown."""
    gold = _labels(spark, sf_dir, _all_units(spark, sf_dir)).withColumnRenamed("tag", "gold")
    pred = _labels(spark, sf_dir, _captions(spark, sf_dir).withColumn("reliable", F.lit(True)))
    tag = F.when(F.col("tag") == labels.UNK, labels.O).otherwise(F.col("tag"))
    return gold.join(pred.select("stream_id", "frame", tag.alias("pred")), ["stream_id", "frame"])


@query(f"{LABELS_SQL} select * from gold_tags")
def frame_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir, _all_units(spark, sf_dir))


@query(f"""{LABELS_SQL}, c as (select tag, count(*) as n from gold_tags group by 1), k as (select sum(n) as total from c where tag <> 0),
r as (select tag, n, case when tag <> 0 then 1 / sqrt(n::double / total) end as raw from c, k)
select tag, n, round(coalesce(raw * (select total from k) / (select sum(raw * n) from r where tag <> 0), 0), 9) as weight from r""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.class_weights(_labels(spark, sf_dir, _all_units(spark, sf_dir))).withColumn("weight", F.round("weight", 9))


@query(f"""{LABELS_SQL}, x as (select *, lag(tag) over w as prev, count(*) filter (where tag <> 3) over (w rows unbounded preceding) as closed from gold_tags window w as (partition by stream_id order by frame)),
closers as (select stream_id, closed, frame as restart from x where tag in (1, 2))
select x.stream_id, x.frame as opened_at, restart from x join closers c on c.stream_id = x.stream_id and c.closed = x.closed + 1 where x.tag = 2 or (x.tag = 3 and x.prev = 1)""")
def restart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames where a complete span ends on a known tag: a stream may start anew there."""
    tags = _labels(spark, sf_dir, _all_units(spark, sf_dir))
    ends = labels.complete_spans(tags).select("stream_id", F.col("start_frame").alias("opened_at"), F.col("end_frame").alias("restart"))
    known = tags.where(F.col("tag").isin(labels.O, labels.B)).select("stream_id", F.col("frame").alias("restart"))
    return ends.join(known, ["stream_id", "restart"]).select("stream_id", "opened_at", "restart")


@query(f"""{PAIRS_SQL}, c as (select stream_id, k, count(*) filter (where gold = k and pred = k) as both_, count(*) filter (where gold = k) + count(*) filter (where pred = k) as any_
  from pairs, (values (1), (2), (3)) t(k) where gold <> 0 group by 1, 2)
select stream_id, round(avg(2.0::double * both_ / any_) filter (where any_ > 0), 9) as frame_f1 from c group by 1""")
def macro_frame_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.macro_frame_f1(_pairs(spark, sf_dir)).withColumn("frame_f1", F.round("frame_f1", 9))


def _runs_sql(side: str) -> str:
    return f""", {side}_x as (select stream_id, frame, t, case when t = 2 or (t = 3 and coalesce(lag(t) over (partition by stream_id order by frame) not in (2, 3), true)) then 1 else 0 end as fresh
  from (select stream_id, frame, case when gold = 0 then 0 else {side} end as t from pairs)),
{side}_y as (select *, sum(fresh) over (partition by stream_id order by frame rows unbounded preceding) as run from {side}_x),
{side}_runs as (select stream_id, row_number() over (partition by stream_id order by min(frame)) as idx, min(frame) as a, max(frame) + 1 as b from {side}_y where t in (2, 3) group by stream_id, run)"""


@query(f"""{PAIRS_SQL}{_runs_sql("gold")}{_runs_sql("pred")},
met as (select p.stream_id, p.idx as event, g.idx as unit, (least(p.b, g.b) - greatest(p.a, g.a))::double / (greatest(p.b, g.b) - least(p.a, g.a)) as tiou from pred_runs p join gold_runs g on p.stream_id = g.stream_id and p.a < g.b and g.a < p.b),
near as (select *, row_number() over (partition by stream_id order by tiou desc, event desc, unit desc) as n from met where tiou >= 0.3),
walk as (
  select stream_id, 0::bigint as n, []::bigint[] as ue, []::bigint[] as ug, false as won, null::double as tiou from (select distinct stream_id from near)
  union all
  select q.stream_id, q.n, case when ok then list_append(ue, q.event) else ue end, case when ok then list_append(ug, q.unit) else ug end, ok, q.tiou
  from (select w.ue, w.ug, q.*, not list_contains(w.ue, q.event) and not list_contains(w.ug, q.unit) as ok from walk w join near q on q.stream_id = w.stream_id and q.n = w.n + 1) q),
rows_ as (select s.stream_id, threshold, (select count(*) from walk w where w.stream_id = s.stream_id and won and tiou >= threshold) as m,
    (select count(*) from pred_runs r where r.stream_id = s.stream_id) as p, (select count(*) from gold_runs r where r.stream_id = s.stream_id) as g
  from (select distinct stream_id from pairs where gold <> 0) s, (values (0.3::double), (0.5), (0.7)) t(threshold))
select threshold, count(*) as n_streams, round(avg(case when p + g = 0 then 1 when p > 0 then m::double / p else 0 end), 9) as precision, round(avg(case when p + g = 0 then 1 when g > 0 then m::double / g else 0 end), 9) as recall,
  round(avg(case when p + g = 0 then 1 else 2.0::double * m / (p + g) end), 9) as f1, sum(m)::bigint as n_matches, sum(p)::bigint as n_pred, sum(g)::bigint as n_gold from rows_ group by 1""")
def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.run_scores(_pairs(spark, sf_dir), [0.3, 0.5, 0.7], 24)
    return found.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def _length(video, k):
    """A length that looks random but follows from the ids alone, in plain whole numbers."""
    return SHORTEST + ((video * 7919 + k * 104_729) % 2_147_483_648 * 1_103_515_245 + 12_345) % 2_147_483_648 % (LONGEST - SHORTEST + 1)


@query(f"""{ALL_SQL}, drawn as (select video_id, total_ms, k, {SHORTEST} + ((video_id * 7919 + k * 104729) % 2147483648 * 1103515245 + 12345) % 2147483648 % {LONGEST - SHORTEST + 1} as len
  from streams, unnest(range(0, total_ms // {SHORTEST} + 2)) t(k)),
placed as (select *, sum(len) over (partition by video_id order by k rows unbounded preceding) - max(case when k = 0 then len // 2 end) over (partition by video_id) as e from drawn)
select video_id, k as idx, greatest(e - len, 0)::bigint as start_ms, least(e, total_ms)::bigint as end_ms from placed where e - len < total_ms and e > 0""")
def drawn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile each stream with chunks of drawn lengths; the first is half over when the stream starts."""
    streams = _streams(spark, sf_dir)
    drawn = streams.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total_ms") / SHORTEST) + 1)))
    drawn = drawn.withColumn("len", _length(F.col("video_id"), F.col("idx")))
    w = Window.partitionBy("video_id").orderBy("idx")
    phase = F.max(F.when(F.col("idx") == 0, F.floor(F.col("len") / 2))).over(Window.partitionBy("video_id"))
    placed = drawn.withColumn("e", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - phase)
    start = F.col("e") - F.col("len")
    return placed.where((start < F.col("total_ms")) & (F.col("e") > 0)).select(
        "video_id", "idx", F.greatest(start, F.lit(0)).alias("start_ms"), F.least("e", "total_ms").alias("end_ms")
    )


@query(None)
def committed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the commit gate emits when it reads each stream's gold tags, an hour a frame; tests replay small streams by hand."""
    tags = _labels(spark, sf_dir, _all_units(spark, sf_dir))
    return replay(tags, Config(stride=6, delta=2, votes=3, cap=96))
