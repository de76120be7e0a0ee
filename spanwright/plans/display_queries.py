"""Display replay: the turns of a conversation, laid end to end, play the growing hypotheses of one sentence.

Each hypothesis has the role instead of its last word, so that every new turn rewrites a little.  Longer words are surer.
Two of three conversations are committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.functions import text as tx
from spanwright.sources.tables import spread, table
from spanwright.streaming import display

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = tx.words(F.coalesce("text", F.lit("")))
    turns = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", words.alias("w"))
    grown = F.flatten(F.collect_list("w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seen = turns.select("conv_id", "turn", "role", grown.alias("g"), F.lead("turn").over(w).isNull().alias("last"))
    tokens = F.concat(F.slice("g", F.lit(1), F.greatest(F.size("g") - 1, F.lit(0))), F.array("role"))
    done = F.col("last") & (F.col("conv_id") % 3 != 0)
    made = seen.select(F.col("conv_id").alias("track"), F.col("turn").alias("seq"), (F.col("turn") * 1000).alias("at_ms"), tokens.alias("tokens"), done.alias("committed"))
    return made.withColumn("conf", F.transform("tokens", lambda t: 1 - 1 / (F.length(t) + 1)))


WORDS = "'" + tx.WORD.replace("'", "''") + "'"


def _lcp(a: str, b: str) -> str:
    return f"coalesce(list_min(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] <> {b}[i])) - 1, least(len({a}), len({b})))"


def _sure(tau: float) -> str:
    return f"coalesce(list_min(list_filter(range(1, len(tokens) + 1), lambda i: conf[i] < {tau})) - 1, len(tokens))"


def _sure_twice(tau: float) -> str:
    bad = f"conf[i] < {tau} or coalesce(conf_1[i] < {tau} or tokens_1[i] <> tokens[i], true)"
    return f"case when tokens_1 is null then 0 else coalesce(list_min(list_filter(range(1, len(tokens) + 1), lambda i: {bad})) - 1, len(tokens)) end"


def _policy_sql() -> str:
    """Each policy as its name, its reveal length, whether that length only grows, and its frozen text."""
    rows = [("commit_only", "0", False, "null")]
    for n in display.AGREEMENT:
        rows += [(f"agreement_n{n}", f"coalesce(agreed_{n}, 0)", True, "null"), (f"frozen_agreement_n{n}", "0", False, f"frozen_{n}")]
    for tau in display.TAUS:
        at = round(100 * tau)
        rows += [(f"confidence_n1_tau{at}", _sure(tau), True, "null"), (f"confidence_n2_tau{at}", _sure_twice(tau), True, "null")]
        rows += [(f"agreement_n{n}_confidence_tau{at}", f"coalesce(case when agreed_{n} is not null then least(agreed_{n}, {_sure(tau)}) end, 0)", True, "null") for n in display.AGREEMENT]
    rows += [(f"mask_k{k}", f"greatest(len(tokens) - {k}, 0)", False, "null") for k in display.HELD_BACK]
    return " union all ".join(
        f"select track, seq, at_ms, committed, is_done, tokens, final, '{p}' as policy, {k} as k, {str(grows).lower()} as grows, {f}::varchar[] as frozen from f" for p, k, grows, f in rows
    )


def _frozen_sql(n: int) -> str:
    agreed = f"list(case when agreed_{n} is not null then tokens[1:agreed_{n}] end) over (partition by track order by seq rows unbounded preceding)"
    fold = f"list_reduce(list_prepend([]::varchar[], list_filter({agreed}, lambda x: x is not null)), lambda f, a: case when len(a) > len(f) and a[1:len(f)] = f then a else f end)"
    return f"case when committed then tokens else {fold} end as frozen_{n}"


TRACE_SQL = f"""with w as (select conv_id, turn, role, regexp_extract_all(coalesce(text, ''), {WORDS}) as w from conversations),
g as (select conv_id, turn, role, flatten(list(w) over (partition by conv_id order by turn rows unbounded preceding)) as g, lead(turn) over (partition by conv_id order by turn) is null as last from w),
t as (select conv_id as track, turn as seq, turn * 1000 as at_ms, list_append(g[1:greatest(len(g) - 1, 0)], role) as tokens, last and conv_id % 3 <> 0 as committed from g),
c as (select *, list_transform(tokens, lambda x: 1 - 1.0::double / (length(x) + 1)) as conf from t),
b as (select *, lag(tokens) over q as tokens_1, lag(tokens, 2) over q as tokens_2, lag(conf) over q as conf_1,
    last_value(tokens) over (partition by track order by seq rows between unbounded preceding and unbounded following) as final, bool_or(committed) over (partition by track) as is_done
  from c window q as (partition by track order by seq)),
a as (select *, case when tokens_1 is not null then {_lcp("tokens", "tokens_1")} end as agreed_2, case when tokens_2 is not null then least({_lcp("tokens", "tokens_1")}, {_lcp("tokens", "tokens_2")}) end as agreed_3 from b),
f as (select *, {_frozen_sql(2)}, {_frozen_sql(3)} from a),
p as ({_policy_sql()}),
n as (select *, case when committed then len(tokens) when grows then least(max(k) over (partition by track, policy order by seq rows unbounded preceding), len(tokens)) else k end as n from p),
s as (select *, coalesce(frozen, tokens[1:n]) as screen from n),
x as (select *, coalesce(lag(screen) over (partition by track, policy order by seq), []::varchar[]) as prior from s),
screens as (select track, policy, seq, at_ms, is_done, len(screen) as shown, {_lcp("screen", "final")} as own, len(final) as n_final, len(prior) as shown_before, {_lcp("prior", "screen")} as kept,
    len(list_filter(range(1, least(len(screen), len(final)) + 1), lambda i: screen[i] <> final[i])) + greatest(len(screen) - len(final), 0) as wrong,
    lead(seq) over (partition by track, policy order by seq) is null as last, at_ms < max(at_ms) over (partition by track, policy) as early from x)"""


@query(f"""{TRACE_SQL},
per as (select track, policy, any_value(is_done) as done, max(n_final) as n_final, sum(shown_before - kept + case when last and not is_done then shown else 0 end) as erased, min(case when shown > 0 then at_ms end) as first_ms, max(at_ms) as commit_ms,
    coalesce(max(shown) filter (where early), 0) as most, coalesce(max(own) filter (where early), 0) as own, coalesce(max(wrong) filter (where early), 0) as wrong from screens group by 1, 2),
z as (select policy, count(*) filter (where done) as n_tracks, sum(erased) as n_erased, sum(case when done then n_final else 0 end) as n_final, count(*) filter (where not done and first_ms is not null) as n_phantoms,
    avg((coalesce(first_ms, commit_ms) - commit_ms) / 1000.0::double) filter (where done) as l, avg(own::double / greatest(n_final, 1)) filter (where done) as r,
    avg(case when most > 0 then wrong::double / most else 0 end) filter (where done) as e, avg(case when wrong > 0 then 1.0::double else 0 end) filter (where done) as c, avg(case when most > n_final then 1.0::double else 0 end) filter (where done) as v
  from per group by 1)
select policy, n_tracks, round(l, 6) as first_token_latency_s, round(r, 6) as revealed_fraction, round(e, 6) as frozen_prefix_error, round(c, 6) as contradicted_rate, round(v, 6) as vanished_rate,
  round(n_phantoms::double / n_tracks, 6) as phantom_rate, round(n_erased::double / n_final, 6) as normalized_erasure from z""")
def reveal_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 policies' latency, rewriting and erasure, merged from partial sums by the length of the track."""
    scores = display.track_scores(display.replay(trace(spark, sf_dir)))
    parts = display.totals(scores.withColumn("part", F.col("track") % 7), "part")
    return display.rates(display.totals(parts))


@query(f"""{TRACE_SQL}, u as (select track, min(at_ms) as a, max(at_ms) - 1000 as b from screens group by 1),
lows as (select *, min(own) over (partition by track, policy order by seq rows between current row and unbounded following) as low from screens where is_done),
tok as (select track, policy, n_final, j, min(at_ms) filter (where low > j) as t from lows, unnest(range(0, n_final)) y(j) group by all),
d as (select k.track, policy, j, n_final, greatest(t - a, 0)::double as d, (b - a)::double as dur from tok k join u on u.track = k.track),
tau as (select track, policy, coalesce(min(j + 1) filter (where d >= dur), max(j) + 1) as tau from d group by 1, 2)
select d.track, d.policy, round(sum(d - j * (dur / greatest(n_final, 10, 1))) / any_value(tau) / 1000, 6) as laal_s from d join tau using (track, policy) where j < tau group by 1, 2""")
def average_lagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the text lags behind a unit that ends a second before the commit, by track and policy."""
    screens = display.replay(trace(spark, sf_dir))
    units = trace(spark, sf_dir).groupBy("track").agg(F.min("at_ms").alias("start_ms"), (F.max("at_ms") - 1000).alias("end_ms")).withColumn("n_words", F.lit(10).cast("long"))
    return display.lagging(screens, units).withColumn("laal_s", F.round("laal_s", 6))
