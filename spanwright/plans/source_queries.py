"""Queries over tracks, usable videos, windows and clocks, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.functions import levels
from spanwright.operators import intervals as iv
from spanwright.operators import captions as cp
from spanwright.operators import tracks, windows
from spanwright.plans.score_queries import ALL_SQL, _all_units, _streams
from spanwright.plans.span_queries import BIN, HOUR, MATCH_SQL, TRUSTED_GAP, _matches
from spanwright.plans.unit_queries import SEGMENTS_SQL, _labels_sql, _segments
from spanwright.sources.tables import SPANS_SQL, gold, predicted, spans, spread, table
from spanwright.streaming import display

DAYS5 = 120 * HOUR
RUN_GAP, MOST_RUN = 12 * HOUR, 72 * HOUR
SEPARATOR = "|"
SUFFIXES = [".en-GB.vtt", ".en.vtt", ".en-orig.vtt", ".en-US.vtt", ".vtt", ".de.vtt"]
PREFERRED, REJECTED = [".en.vtt", ".en-GB.vtt"], [".en-orig.vtt"]
WINDOW = 64

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None, plain: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql if plain else f"with recursive {SPANS_SQL}" + sql
        return f

    return add


@query(f"""{ALL_SQL}, q as (select *, row_number() over (partition by video_id order by start_ms, end_ms, idx) as n from units where reliable),
j as (select a.*, b.end_ms as before, exists (select 1 from units u where u.video_id = a.video_id and u.start_ms < a.start_ms and u.end_ms > b.end_ms) as between_
  from q a left join q b on b.video_id = a.video_id and b.n = a.n - 1),
walk as (select video_id, n, 1 as run, start_ms as s, end_ms as e, idx::varchar as t, 1::bigint as k from j where n = 1
  union all select x.video_id, x.n, case when ok then run else run + 1 end, case when ok then s else x.start_ms end, x.end_ms, case when ok then t || ' {SEPARATOR} ' || x.idx else x.idx::varchar end, case when ok then k + 1 else 1 end
  from (select w.run, w.s, w.t, w.k, j.*, j.start_ms - j.before <= {RUN_GAP} and not between_ and j.end_ms - w.s <= {MOST_RUN} as ok from walk w join j on j.video_id = w.video_id and j.n = w.n + 1) x)
select video_id, any_value(s) as start_ms, arg_max(e, n) as end_ms, arg_max(t, n) as text, max(k) as n_units from walk group by video_id, run""")
def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted units joined into runs that one text target may cover; a unit's id plays its text."""
    return windows.join_runs(_all_units(spark, sf_dir).withColumn("text", F.col("idx").cast("string")), RUN_GAP, MOST_RUN, SEPARATOR)


@query(f"""{ALL_SQL}, w as (select video_id, k * {DAYS5} as a, least((k + 1) * {DAYS5}, total_ms) as b from streams, unnest(range(0, greatest(1, ceil(total_ms / {DAYS5}.0)::bigint))) t(k)),
m as (select *, case when start_ms >= a and start_ms < b then case when end_ms > a and end_ms < b then 'complete' else 'right' end when end_ms > a and end_ms < b then 'left' when start_ms < a and end_ms > b then 'both' else 'outside' end as seen
  from units join w using (video_id) where start_ms < b and end_ms > a and least(end_ms, b) > greatest(start_ms, a))
select seen, count(*) as n, count(*) filter (where reliable and end_ms - start_ms >= {HOUR} and start_ms >= a and end_ms + 60000 <= b) as n_complete from m group by 1""")
def unit_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How windows of five days show the units that touch them, and how many they hold whole."""
    met = iv.overlap_join(_all_units(spark, sf_dir), iv.tiles(_streams(spark, sf_dir), DAYS5), BIN, "win_").where(iv.overlap_ms("", "win_") > 0)
    seen = met.withColumn("seen", windows.visibility("win_start_ms", "win_end_ms"))
    return seen.groupBy("seen").agg(F.count("*").alias("n"), F.count_if(windows.is_complete("win_start_ms", "win_end_ms", 60_000, HOUR)).alias("n_complete"))


@query(f""", x as (select threshold, (end_ms - start_ms)::double < threshold * ({HOUR}::bigint * (1 + video_id % 8)) as short from gold, (values (0.3::double), (0.5), (0.7), (0.9)) t(threshold))
select threshold, count(*) filter (where short) as unreachable, count(*) as n_units, round(1 - count(*) filter (where short)::double / count(*), 9) as most_recall from x group by 1""")
def attainable_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best recall under a least duration of one to eight hours, by stream."""
    floors = _streams(spark, sf_dir).select("video_id", (HOUR * (1 + F.col("video_id") % 8)).alias("floor_ms"))
    return windows.attainable_recall(gold(spark, sf_dir), floors, [0.3, 0.5, 0.7, 0.9]).withColumn("most_recall", F.round("most_recall", 9))


@query("""with f as (select doc_id // 4 as video_id, first(lang) over (partition by doc_id // 4 order by doc_id) as target, case doc_id % 4 when 0 then 'english.en.native.vtt' when 1 then 'english.en.nllb.vtt' when 2 then 'original.' || lang || '.manual.vtt' else 'original.' || lang || '.auto.vtt' end as name, doc_id from documents),
r as (select *, case when target = 'en' and name = 'english.en.native.vtt' then 0 when starts_with(name, 'original.' || target) and suffix(name, '.manual.vtt') then 1 when target = 'en' and name = 'english.en.nllb.vtt' then 2 end as rank from f where doc_id % 7 > 1)
select video_id, name, case when rank = 2 then 'mt' else 'human' end as caption_source from r where rank is not null qualify row_number() over (partition by video_id order by rank, name) = 1""", plain=True)
def picked_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents play the caption files of a video in the language of the first; some are missing."""
    w = Window.partitionBy("video_id").orderBy("doc_id")
    place = F.col("doc_id") % 4
    manual = F.concat(F.lit("original."), "lang", F.when(place == 2, ".manual.vtt").otherwise(".auto.vtt"))
    name = F.when(place == 0, tracks.NATIVE).when(place == 1, tracks.MACHINE).otherwise(manual)
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("video_id"), "doc_id", "lang", name.alias("name"))
    files = docs.withColumn("target", F.first("lang").over(w)).where("doc_id % 7 > 1")
    return tracks.pick_caption(files.select("video_id", "target", "name"))


@query(f"""with t as (select doc_id, doc_id // 6 as video_id, (doc_id // 6)::varchar || {SUFFIXES}[doc_id % 6 + 1] as name, case when doc_id % 11 = 0 then '<00:00:01.000>' else '' end || text as raw, string_split(text, chr(10)) as lines from documents),
f as (select *, len(lines) as n_cues, list_sum(list_transform(lines, lambda x: length(x)))::bigint as n_chars, list_max(list_transform(lines, lambda x: length(x) / (1.0::double + doc_id % 20))) as rate from t),
g as (select *, regexp_matches(raw[1:20000], '<[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}[.,][0-9]{{3}}>') as word_timed, n_cues <= 2 and n_chars >= 500 and rate >= 120 as flat from f),
h as (select *, case when suffix(name, '.en-orig.vtt') then 10000 when suffix(name, '.en.vtt') then 0 when suffix(name, '.en-GB.vtt') then 1 else 102 end as rank from g where not word_timed and not flat and n_chars >= 2)
select video_id, name, n_cues, n_chars from h qualify row_number() over (partition by video_id order by rank, n_chars desc, name) = 1""", plain=True)
def best_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six documents play the tracks of a video, their lines the cues; some are word-timed or whole transcripts in a cue."""
    docs = spread(table(spark, sf_dir, "documents"))
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 6).cast("int"))
    video = F.floor(F.col("doc_id") / 6)
    raw = F.concat(F.when(F.col("doc_id") % 11 == 0, "<00:00:01.000>").otherwise(""), "text")
    named = docs.select("doc_id", video.alias("video_id"), F.concat(video.cast("string"), suffix).alias("name"), "text", tracks.word_timed(raw).alias("word_timed"))
    cues = named.select("video_id", "name", "word_timed", F.explode(F.split("text", "\n", -1)).alias("text"), F.lit(0).alias("start_ms"), (1000 * (1 + F.col("doc_id") % 20)).alias("end_ms"))
    facts = tracks.track_facts(cues, ["video_id", "name", "word_timed"])
    return tracks.best_track(facts, PREFERRED, REJECTED).select("video_id", "name", "n_cues", "n_chars")


@query(f"""{SEGMENTS_SQL}, e as (select u.video_id, u.idx, start_ms, end_ms from units u join segments s on s.video_id = u.video_id and u.end_ms > seg_start and u.start_ms < seg_end join streams t on t.video_id = u.video_id
  where u.reliable and start_ms >= seg_start and (seg_end = total_ms or end_ms <= seg_end))
select v.video_id, idx, start_ms, end_ms from (select distinct video_id from segments) v left join e using (video_id)""")
def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted units of the clean segments, back on the clock of their video; a video without any keeps a row."""
    segments = _segments(spark, sf_dir)
    local = cp.split_units(_all_units(spark, sf_dir).where("reliable"), segments, _streams(spark, sf_dir), BIN)
    return windows.to_source(local.where("reliable"), segments)


@query(f"""{ALL_SQL}{_labels_sql("z", "units")}, x as (select video_id, a, b from z_g where b - a > {TRUSTED_GAP} union all select video_id, start_ms, end_ms from units where not reliable)
select video_id, a + video_id % 4 * {HOUR} as start_ms, b + video_id % 4 * {HOUR} as end_ms from x""")
def unreferenced_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a long-form score has no reference, for streams that start up to three hours into their source."""
    streams = _streams(spark, sf_dir).withColumn("offset_ms", F.col("video_id") % 4 * HOUR)
    return windows.unreferenced(_all_units(spark, sf_dir), streams, TRUSTED_GAP)


@query(f""", s as (select video_id, max(end_ms) // {HOUR} as n from spans group by 1),
walk as (select video_id, n, 0::bigint as k, 0::bigint as a, least(n, {WINDOW}) as b, 0::bigint as w, case when n <= {WINDOW} then n else {WINDOW - WINDOW // 4} end as kept from s where n > 0
  union all select video_id, n, k + 1, case when (k + 1) * {WINDOW // 2} + {WINDOW} >= n then greatest(0, n - {WINDOW}) else (k + 1) * {WINDOW // 2} end, least(n, (k + 1) * {WINDOW // 2} + {WINDOW}), kept,
    case when (k + 1) * {WINDOW // 2} + {WINDOW} >= n then n else (k + 1) * {WINDOW // 2} + {WINDOW - WINDOW // 4} end from walk where kept < n)
select video_id, a as first_frame, b as end_frame, w as write_from, kept as write_to from walk""")
def stitched_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of an hour a frame under windows of 64 frames."""
    return windows.stitched_windows(_streams(spark, sf_dir).select("video_id", F.floor(F.col("total_ms") / HOUR).alias("n_frames")), WINDOW)


@query(f""", t as (select video_id, list(start_ms order by start_ms) as ts from spans group by 1), z as (select *, least(2, len(ts) - 1) as l0, greatest(len(ts) - 3, 0) as h0 from t),
y as (select *, len(list_filter(ts, lambda x: x - ts[l0 + 1] <= {6 * HOUR})) - 1 as l1, len(list_filter(ts, lambda x: ts[h0 + 1] - x > {6 * HOUR})) as h1 from z)
select video_id, len(list_filter(ts, lambda x: x - ts[l1 + 1] <= {6 * HOUR})) - 1 as lo, len(list_filter(ts, lambda x: ts[h1 + 1] - x > {6 * HOUR})) as hi from y""")
def edge_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The starts of a stream's events as frames: those that two layers of six hours, after two frames, tie to an edge."""
    times = spans(spark, sf_dir).groupBy("video_id").agg(F.sort_array(F.collect_list("start_ms")).alias("times"))
    return times.select("video_id", windows.edge_reach(F.col("times"), 2, 6 * HOUR, 2).alias("r")).select("video_id", "r.lo", "r.hi")


@query("""with t as (select conv_id, turn, case when conv_id % 3 = 0 then 'zh_CN' when conv_id % 3 = 1 then 'en_XX' end as lang, translate(text, ',eo', '，中文') as text from conversations)
select conv_id, turn, coalesce(lang = 'zh_CN', false) as per_character,
  case when lang = 'zh_CN' then array_to_string(regexp_extract_all(replace(replace(replace(lower(text), ' ', ''), chr(10), ''), '，', ','), '(?s).'), ' ') else lower(text) end as scored,
  trim(regexp_replace(regexp_replace(text, '([中文])', '\\1 ', 'g'), '([^ ])([中文])', '\\1 \\2', 'g'), ' ' || chr(10) || chr(9)) as spaced from t""", plain=True)
def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with some ideographs, as the scores read them: per character where the language asks for it."""
    conv = F.col("conv_id") % 3
    lang = F.when(conv == 0, "zh_CN").when(conv == 1, "en_XX")
    turns = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", lang.alias("lang"), F.translate("text", ",eo", "，中文").alias("text"))
    char = levels.by_character(F.col("lang"))
    return turns.select("conv_id", "turn", char.alias("per_character"), levels.scored(F.col("text"), char, True).alias("scored"), levels.spaced_ideographs(F.col("text")).alias("spaced"))


@query("""with t as (select conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from conversations),
b as (select *, list_filter(list_transform(w, lambda x: trim(x, '.,!?-"''')), lambda x: x <> '') as bare from t),
g as (select conv_id, turn, lower(array_to_string(w[i:i + 2], ' ')) as gram, count(*) as k from t, unnest(range(1, len(w) - 1)) u(i) group by 1, 2, 3),
l as (select conv_id, turn, max(k) >= 4 as loops from g group by 1, 2)
select conv_id, sum(len(list_filter(bare, lambda x: regexp_matches(x, '^\\p{L}$'))))::bigint as n_single, sum(len(bare))::bigint as n_tokens, count(*) filter (where loops) as n_loops from b left join l using (conv_id, turn) group by 1""", plain=True)
def caption_habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: tokens that are one letter, all tokens, and turns that say one run of three words four times."""
    single, every = levels.letters_alone(F.col("text"))
    turns = spread(table(spark, sf_dir, "conversations")).select("conv_id", single.alias("single"), every.alias("every"), levels.loops(F.col("text")).alias("loops"))
    return turns.groupBy("conv_id").agg(F.sum("single").alias("n_single"), F.sum("every").alias("n_tokens"), F.count_if("loops").alias("n_loops"))


@query("""with t as (select conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from conversations),
p as (select *, list_min([i for i in range(1, len(w) + 1) if w[i] in ('and', 'in')]) as stop from t)
select conv_id, turn, array_to_string(case when stop is null then w else w[1:stop - 1] end, ' ') as shown from p""", plain=True)
def shown_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a screen shows of each turn when two words play the end of a text."""
    words = levels.tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(levels.shown_prefix(words, ["and", "in"]), " ").alias("shown"))


STATUS_SQL = f"""{ALL_SQL}, poses as (select video_id, max(end_ms) filter (where kind = 'view') as pose_ms from spans group by 1),
cov as (select p.video_id, count(*) filter (where start_ms >= 0 and start_ms < pose_ms and end_ms <= pose_ms + 1000)::double / count(*) as covered from pred p join poses using (video_id) group by 1),
rel as (select video_id, count(*) filter (where reliable and start_ms > {240 * HOUR}) as n_reliable from units group by 1),
status as (select video_id, case video_id % 5 when 0 then 'test' when 1 then 'dev' else 'train' end as split,
  case when video_id % 5 = 0 and video_id % 3 = 0 then 'machine captions' when coalesce(covered, 0) < 0.9 then 'uncovered' when coalesce(n_reliable, 0) < 4 then 'all quarantined'
    when video_id % 5 > 1 and video_id % 7 = 0 then 'copy' else 'kept' end as status from streams left join cov using (video_id) left join rel using (video_id))"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams as videos: poses end with the last view, and only views and clicks after ten days count as trusted (three too few)."""
    every = spans(spark, sf_dir)
    poses = every.groupBy("video_id").agg(F.max(F.when(F.col("kind") == "view", F.col("end_ms"))).alias("pose_ms"))
    trusted = _all_units(spark, sf_dir).groupBy("video_id").agg((F.count_if(F.col("reliable") & (F.col("start_ms") > 240 * HOUR)) >= 4).cast("long").alias("n_reliable"))
    place = F.col("video_id") % 5
    split = F.when(place == 0, "test").when(place == 1, "dev").otherwise("train")
    copy = F.when(split == "train", F.when(F.col("video_id") % 7 == 0, (F.col("video_id") + 1).cast("string")).otherwise(""))
    videos = tracks.cue_coverage(predicted(spark, sf_dir), poses).join(trusted, "video_id", "left").fillna(0, ["n_reliable"])
    videos = videos.withColumns({"split": split, "caption_source": F.when(F.col("video_id") % 3 == 0, "mt").otherwise("human"), "copy_of": copy})
    return tracks.drop_reasons(videos, ["test"], ["mt"], 0.9)


@query(f"{STATUS_SQL} select video_id, split from status where status = 'kept'")
def usable_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).where("status = 'kept'").select("video_id", "split")


@query(f"{STATUS_SQL} select split, status, count(*) as n, (select count(*) from status x where x.split = s.split) as n_split from status s group by 1, 2")
def drop_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream in exactly one bucket; the buckets of a split sum to its size."""
    return tracks.tally(_statuses(spark, sf_dir))


OUTCOME_SQL = f"""{MATCH_SQL}, o as (select n.video_id, n.unit, n.idx, n.end_ms - n.start_ms as length_ms,
  case when max(m.tiou) is null then 'missed' when max(m.last_unit - m.first_unit) > 0 then 'joined' else 'matched' end as outcome
  from numbered n left join matches m on m.video_id = n.video_id and n.unit between m.first_unit and m.last_unit group by 1, 2, 3, 4)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = gold(spark, sf_dir).select("video_id", "idx", (F.col("end_ms") - F.col("start_ms")).alias("length_ms"), (F.row_number().over(iv.by_video()) - 1).alias("unit"))
    hits = _matches(spark, sf_dir, 0.3).select("video_id", F.explode(F.sequence("first_unit", "last_unit")).alias("unit"), F.when(F.col("last_unit") > F.col("first_unit"), "joined").otherwise("matched").alias("hit"))
    return units.join(hits, ["video_id", "unit"], "left").withColumn("outcome", F.coalesce("hit", F.lit("missed"))).drop("hit")


@query(f"{OUTCOME_SQL} select outcome, video_id, idx, length_ms from o qualify row_number() over (partition by outcome order by length_ms desc, video_id, idx) <= 5")
def longest_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest units of each outcome."""
    w = Window.partitionBy("outcome").orderBy(F.desc("length_ms"), "video_id", "idx")
    return _outcomes(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 5").select("outcome", "video_id", "idx", "length_ms")


@query(f"""{OUTCOME_SQL}, e as (select unnest([0, 2, 4, 8, 16]) as lo, unnest([2, 4, 8, 16, 10000]) as hi)
select lo as from_h, count(o.idx) as n, round(avg(case when outcome <> 'missed' then 1.0::double else 0 end) filter (where o.idx is not null), 9) as located from e left join o on length_ms >= lo * {HOUR}::bigint and length_ms < hi * {HOUR}::bigint group by 1""")
def outcome_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of units located, by how long they are; a bin without units is null."""
    bins = spark.createDataFrame([(0, 2), (2, 4), (4, 8), (8, 16), (16, 10_000)], "from_h int, to_h int")
    inside = (F.col("length_ms") >= F.col("from_h") * F.lit(HOUR).cast("long")) & (F.col("length_ms") < F.col("to_h") * F.lit(HOUR).cast("long"))
    counted = _outcomes(spark, sf_dir).join(F.broadcast(bins), inside).groupBy("from_h").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("outcome") != "missed").cast("double")), 9).alias("located")
    )
    return bins.select("from_h").join(counted, "from_h", "left").fillna(0, ["n"])


@query(""", p as (select video_id, idx, start_ms as at_ms from pred)
select p.video_id, p.idx, (select arg_min(g.idx, (abs(g.start_ms - p.at_ms), g.start_ms, g.idx)) from gold g where g.video_id = p.video_id) as mark from p""")
def nearest_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold unit that starts nearest to each predicted span's start."""
    at = lambda d: d.select("video_id", "idx", F.col("start_ms").alias("at_ms"))
    return iv.asof_nearest(at(predicted(spark, sf_dir)), at(gold(spark, sf_dir))).drop("mark_ms")


@query(f"""{SEGMENTS_SQL} select p.video_id, p.idx, s.seg_start from captions p left join segments s on s.video_id = p.video_id and p.start_ms >= s.seg_start and p.start_ms < s.seg_end""")
def caption_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean segment in which each caption starts."""
    points = spans(spark, sf_dir).where(F.col("kind").isin("signup", "purchase")).select("video_id", "idx", F.col("start_ms").alias("at_ms"))
    return iv.holding_segment(points, _segments(spark, sf_dir))


WORDS_SQL = "'[A-Za-z][\\p{L}\\p{N}_'']*'"


@query(f"""with l as (select doc_id as video_id, unnest(string_split(text, chr(10))) as text from documents), w as (select video_id, regexp_extract_all(lower(text), {WORDS_SQL}) as w from l),
known as (select array_to_string(w, ' ') as said from w where video_id % 5 <> 0 and len(w) >= 4 group by 1 having count(distinct video_id) <= 20)
select video_id, count(k.said) as n from w left join known k on k.said = array_to_string(w.w, ' ') where video_id % 5 = 0 group by 1""", plain=True)
def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every fifth document that a line of the others says, too."""
    lines = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("video_id"), F.explode(F.split("text", "\n", -1)).alias("text"))
    return cp.repeated_texts(lines.where("video_id % 5 = 0"), lines.where("video_id % 5 <> 0"), 4, 20)


@query(f"""with t as (select conv_id, turn, text, regexp_extract_all(text, {WORDS_SQL}) as w from conversations),
lex as (select lower(x) as word from (select unnest(regexp_extract_all(text, {WORDS_SQL})) as x from conversations) where regexp_matches(x, '^[a-z]') group by 1 having count(*) > 3),
j as (select t.*, l.word is not null and regexp_matches(w[1], '^[A-Z]') and length(w[1]) > 1 and w[1] <> upper(w[1]) and not regexp_matches(w[1], '^I($|'')') and not coalesce(regexp_matches(w[2], '^[A-Z]') and not regexp_matches(w[2], '^I($|'')'), false) as folds from t left join lex l on l.word = lower(w[1]))
select conv_id, turn, case when folds then text[1:instr(text, w[1]) - 1] || lower(w[1][1]) || text[instr(text, w[1]) + 1:] else text end as part from j""", plain=True)
def folded_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their first word in lower case where turns write it so over three times elsewhere."""
    turns = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("text").alias("part"))
    each = turns.select(F.explode(cp.tx.words(F.col("part"))).alias("x")).where(F.col("x").rlike("^[a-z]"))
    return cp.fold_sentence_starts(turns, each.groupBy(F.lower("x").alias("word")).count().where("count > 3"))


@query("""with w as (select conv_id * 1000 + turn as track, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from conversations),
h as (select track, k as seq, [case when (length(w[i]) + (case when i > 4 * k - 4 then k else 0 end)) % 5 = 0 then '|' else w[i] end for i in range(1, 4 * k + 1)] as tokens from w, unnest(range(1, len(w) // 4 + 1)) u(k)),
p as (select track, seq, list_transform(string_split(array_to_string([case when t = '|' then chr(10) else t end for t in tokens], ' '), chr(10)), lambda x: trim(x)) as parts from h),
q as (select *, lag(parts) over (partition by track order by seq) as was from p)
select track, count(*) filter (where was is not null and (len(parts) <> len(was) or len(list_filter(range(1, len(parts)), lambda j: parts[j] <> was[j] and parts[j + 1] <> was[j + 1])) > 0)) as n_flips from q group by 1""", plain=True)
def boundary_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screens that show four words more each time, with separators that move among the newest."""
    words = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("track"), levels.tokens(F.col("text")).alias("w"))
    grown = words.where(F.size("w") >= 4).withColumn("seq", F.explode(F.sequence(F.lit(1), F.floor(F.size("w") / 4).cast("int"))))
    shown = F.transform(F.slice("w", F.lit(1), 4 * F.col("seq")), lambda x, i: F.when((F.length(x) + F.when(i > 4 * F.col("seq") - 5, F.col("seq")).otherwise(0)) % 5 == 0, "|").otherwise(x))
    return display.boundary_flips(grown.select("track", "seq", shown.alias("tokens")), "|")


@query("""select page_id, regexp_replace(regexp_replace(regexp_replace(url || '_segment_' || page_id || '.en.npz', '^.*/', ''), '\\.npz$', ''), '_segment_[0-9]+', '', 'g') as base, lower(trim(regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g'), '_')) as slug,
  trim(regexp_replace(replace(url, '/', ' '), '\\s+', ' ', 'g')) as words from pages""", plain=True)
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as the names of segment files, as labels, and as texts of units."""
    name = F.concat("url", F.lit("_segment_"), F.col("page_id").cast("string"), F.lit(".en.npz"))
    return table(spark, sf_dir, "pages").select("page_id", levels.base_id(name).alias("base"), levels.slug(F.col("url")).alias("slug"), levels.unit_text(F.col("url"), "/").alias("words"))


@query("""with i as (select lang, source, bool_or(n_chars > 4000) as a, bool_or(n_chars < 200) as b, bool_or(doc_id % 7 = 0) as c from documents group by 1, 2),
s as (select source, bool_or(a) as a, bool_or(b) as b, bool_or(c) as c from i group by 1)
select case when a then 'long' when b then 'short' when c then 'seventh' else 'unaccounted' end as status, count(*) as n, count(*) filter (where a::int + b::int + c::int > 1) as n_ambiguous, (sum(count(*)) over ())::bigint as n_total from s group by 1""", plain=True)
def reconciled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source in the first bucket that one of its documents fits."""
    docs = table(spark, sf_dir, "documents")
    return tracks.reconciled(docs, "source", {"long": F.col("n_chars") > 4000, "short": F.col("n_chars") < 200, "seventh": F.col("doc_id") % 7 == 0})
