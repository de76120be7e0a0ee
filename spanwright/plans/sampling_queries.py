"""Splits, epochs, batches and stamps over the driver tables, each beside its SQL twin; documents play videos, their characters hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators import sampling
from spanwright.sources.tables import SPANS_SQL, gold, predicted, spans, table

EPOCH, RANKS, BATCH, POOL = 3, 3, 8, 4
UNKNOWN = 0
PROTOCOL = "units-1"

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _draw(seed: int, *ids: str) -> str:
    return f"('0x' || md5(concat_ws(':', '{seed}', {', '.join(ids)}))[1:8])::bigint"


@query(f"""with r as (select doc_id, row_number() over (order by {_draw(42, "doc_id")}, doc_id) - 1 as place, count(*) over () as n from documents)
select doc_id, case when place < round_even(n * 0.8, 0) then 'train' when place < round_even(n * 0.8, 0) + round_even(n * 0.1, 0) then 'dev' else 'test' end as split from r""")
def random_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.splits(table(spark, sf_dir, "documents"), "doc_id")


POOLS_SQL = """p as (select lang, sum(n_chars)::bigint as total from documents group by 1 having sum(n_chars) > 0), w as (select *, pow(total::double, 0.5) as w from p),
t as (select lang, total, floor(round(w * (select min(total / w) from w), 6))::bigint as target from w)"""


@query(f"""with {POOLS_SQL}, s as (select doc_id, lang, n_chars, coalesce(sum(n_chars) over (partition by lang order by {_draw(42, "lang", "doc_id")}, doc_id rows between unbounded preceding and 1 preceding), 0) as s from documents),
x as (select s.*, target, total, (target * {EPOCH}) % total as lo from s join t using (lang))
select doc_id, lang, n_chars from x where (s >= lo and s < lo + target) or s + total < lo + target""")
def epoch_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of one epoch, each language cut to its tempered share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sampling.epoch_slice(docs, "lang", "doc_id", "n_chars", EPOCH)


@query(f"with {POOLS_SQL} select lang as pool, total, target, ceil(total / target::double)::bigint as epochs from t")
def cycle_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cycle_epochs(table(spark, sf_dir, "documents"), "lang", "n_chars")


@query(f"""with r as (select doc_id, n_chars, row_number() over (order by {_draw(0, "doc_id")}, doc_id) - 1 as place from documents),
c as (select *, place // {BATCH * POOL} as pool, row_number() over (partition by place // {BATCH * POOL} order by n_chars nulls first, place) - 1 as at_ from r),
b as (select *, pool * {POOL} + at_ // {BATCH} as made, at_ % {BATCH} as slot from c),
o as (select made, count(*) as n, row_number() over (order by {_draw(7919, "made")}, made) - 1 as batch from b group by 1),
d as (select made, n, batch, r as rank, sum(n // {RANKS} + case when r < n % {RANKS} then 1 else 0 end) over (partition by made order by r) as upto from o, unnest(range(0, {RANKS})) t(r))
select doc_id, d.batch, slot, (case when n < {RANKS} then 0 else rank end)::int as rank from b join d on d.made = b.made and slot < upto and slot >= upto - (n // {RANKS} + case when rank < n % {RANKS} then 1 else 0 end)""")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of documents of like length, shared out over ranks."""
    return sampling.length_batches(table(spark, sf_dir, "documents"), "doc_id", "n_chars", BATCH, POOL, ranks=RANKS)


@query(f"""with c as (select vec_id, vec_id // 4 as batch, embedding[1:1 + vec_id % 32] as f from embeddings), m as (select *, max(len(f)) over (partition by batch) as most from c),
p as (select vec_id, k, case when k <= len(f) then f[k]::double else f[-1]::double end as x, k <= len(f) as real from m, unnest(range(1, most + 1)) t(k))
select vec_id, count(*)::int as n_frames, (count(*) filter (where real))::int as n_real, (count(*) filter (where not real))::int as n_unknown, round(sum(x * k), 5) as total from p group by 1""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a vector's first numbers, padded four by four, in sums."""
    clip = F.slice("embedding", F.lit(1), (1 + F.col("vec_id") % 32).cast("int"))
    clips = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.floor(F.col("vec_id") / 4).alias("batch"), clip.alias("frames"))
    made = sampling.padded(clips.withColumn("labels", F.transform("frames", lambda x: F.lit(1))), "batch", "frames", "labels", UNKNOWN)
    total = F.aggregate(F.transform("frames", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    count = lambda a, f: F.size(F.filter(a, f))
    return made.select(
        "vec_id",
        F.size("frames").alias("n_frames"),
        count("mask", lambda m: m).alias("n_real"),
        count("labels", lambda v: v == UNKNOWN).alias("n_unknown"),
        F.round(total, 5).alias("total"),
    )


@query(f"""with {SPANS_SQL}, v as (select kind, video_id, sha256(string_agg(concat_ws('|', start_ms, end_ms, idx), chr(10) order by start_ms, end_ms, idx)) as u from spans group by 1, 2),
h as (select kind, sha256(concat_ws(chr(10), video_id, u)) as v from v), s as (select kind, v[1:2] as shard, sha256(string_agg(v, chr(10) order by v)) as h from h group by 1, 2)
select kind, '{PROTOCOL}:' || sha256(string_agg(h, chr(10) order by shard)) as stamp from s group by 1""")
def annotation_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp of each kind's spans."""
    row = F.concat_ws("|", "start_ms", "end_ms", "idx")
    return sampling.fingerprints(spans(spark, sf_dir), "kind", "video_id", row, ["start_ms", "end_ms", "idx"], PROTOCOL)


@query("""with h as (select doc_id, sha256(text) as h from documents where length(text) > 0)
select a.doc_id, min(b.doc_id) as origin from h a join h b on a.h = b.h group by 1 having min(b.doc_id) < a.doc_id""")
def equal_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.equal_contents(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""with {SPANS_SQL}, k as (select video_id, round_even(start_ms / 3600000.0, 0) as s, round_even(end_ms / 3600000.0, 0) as e, max(idx) as idx from pred group by all),
j as (select g.video_id, g.idx, k.idx as caption from gold g left join k on k.video_id = g.video_id and k.s = round_even(g.start_ms / 3600000.0, 0) and k.e = round_even(g.end_ms / 3600000.0, 0))
select video_id, count(*) as n_units, count(caption) as n_found, count(*) - count(caption) as n_missing, max(caption) as last_caption from j group by 1""")
def rounded_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units met by the caption of equal rounded edges, the last where there are several; how many of a video have none."""
    key = [F.rint(F.col(c) / 3_600_000).alias(c[0]) for c in ("start_ms", "end_ms")]
    captions = predicted(spark, sf_dir).select("video_id", *key, "idx").groupBy("video_id", "s", "e").agg(F.max("idx").alias("caption"))
    met = gold(spark, sf_dir).select("video_id", *key).join(captions, ["video_id", "s", "e"], "left")
    found = F.count("caption")
    return met.groupBy("video_id").agg(
        F.count("*").alias("n_units"), found.alias("n_found"), (F.count("*") - found).alias("n_missing"), F.max("caption").alias("last_caption")
    )


@query("""select lang, arg_max(doc_id, len(string_split(text, ' ')) * 1000000000::bigint - doc_id) as doc_id, max(len(string_split(text, ' '))) as n_words, (max(strlen(text)) + 2)::bigint as most_bound from documents where text is not null group by 1""")
def longest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest text of each language in words, the first of equals, beside the bound that its bytes give."""
    n = F.size(F.split("text", " "))
    texts = table(spark, sf_dir, "documents").where("text is not null").select("lang", "doc_id", n.alias("n"), (F.octet_length("text") + 2).cast("long").alias("bound"))
    return texts.groupBy("lang").agg(F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("doc_id"), F.max("n").cast("long").alias("n_words"), F.max("bound").alias("most_bound"))
