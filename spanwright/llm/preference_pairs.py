"""Preference formatting: the turns that chosen and rejected conversations share are the prompt, rendered once.

The longest common prefix of turns is found by comparing turn by turn, with counts and hashes that combine before the
shuffle, and taking the first turn that differs; no conversation is ever gathered in one row.  The result has one row
for each rendered turn: segment ``prompt`` once for both, then ``chosen`` and ``rejected``, in
order of ``turn``.  The mask is per turn: ``trained`` marks the turns of a completion that the assistant wrote, and of such a
turn the code points from ``train_from`` on (the content and its end mark, not the role's header).

Where the data name no pairs, :func:`all_sides` makes them.  Conversations with an equal first turn are alternatives to
each other (:func:`pair_by_opening`: in order of id, first within blocks of ids, then those left over; the smaller id is the chosen
one).  For any other conversation the alternative is itself with its last reply exchanged for that of its
neighbour (an even id and the odd one after it): the reply that belongs is chosen, the foreign one rejected, and all turns before it are the
prompt.  A conversation that has no reply to exchange is rendered alone, as segment ``single``.  :func:`pair_by_id`
pairs whole neighbours instead.

Defined results: rows without conv_id belong to no conversation.  Turns are placed by their number, a null one before all
others; several rows of one turn are compared as a bag and rendered in order of role and text.  A null role or text
is rendered as empty, and differs from an empty one.  If one conversation of a pair is missing the pair has no prompt and the
other conversation is its completion.  With an exchanged reply equal to the own one all is prompt.  Where one conversation is the beginning of the other its completion is empty and has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import written

BLOCK = 1024
FIRST = -(1 << 63)


def _content(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def pair_by_id(conversations: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): every even id with the odd one after it, if either is there."""
    chosen = F.col("conv_id") - F.pmod("conv_id", F.lit(2))
    pairs = conversations.where("conv_id is not null").select(chosen.alias("chosen_id")).distinct()
    return pairs.withColumn("rejected_id", F.col("chosen_id") + 1)


def pair_by_opening(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(chosen_id, rejected_id) of conversations with an equal first turn."""
    place = F.coalesce("turn", F.lit(FIRST))
    opening = conversations.where("conv_id is not null").groupBy("conv_id").agg(
        F.min(F.struct(place.alias("place"), _content(1).alias("a"), _content(2).alias("b"))).alias("first")
    )
    opening = opening.select("conv_id", "first.a", "first.b")

    def paired(rows: DataFrame, keys: list) -> tuple[DataFrame, DataFrame]:
        order = Window.partitionBy(*keys).orderBy("conv_id")
        ranked = rows.withColumns({"rank": F.row_number().over(order) - 1, "next_id": F.lead("conv_id").over(order)})
        first = ranked.where("rank % 2 = 0")
        pairs = first.where("next_id is not null").select(F.col("conv_id").alias("chosen_id"), F.col("next_id").alias("rejected_id"))
        return pairs, first.where("next_id is null").select("conv_id", "a", "b")

    near, left = paired(opening, ["a", "b", F.floor(F.col("conv_id") / block)])
    return near.union(paired(left, ["a", "b"])[0])


KEY = ["chosen_id", "rejected_id"]


def sides_of(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, side, turn, role, text): the turns of both conversations of every pair."""
    pairs = pairs.select(*KEY)
    sides = pairs.select(*KEY, F.lit("chosen").alias("side"), F.col("chosen_id").alias("of")).union(
        pairs.select(*KEY, F.lit("rejected"), F.col("rejected_id"))
    )
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    return turns.join(sides, turns["conv_id"] == sides["of"]).select(*KEY, "side", "turn", "role", "text")


def all_sides(conversations: DataFrame) -> DataFrame:
    """The sides of every conversation, as alternatives by opening, with an exchanged reply, or alone (side ``single``)."""
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    opened = written(pair_by_opening(turns), "openings")
    paired = opened.select(F.explode(F.array(*KEY)).alias("conv_id"))
    rest = turns.join(paired, "conv_id", "left_anti").withColumn("place", F.coalesce("turn", F.lit(FIRST)))
    replies = (
        turns.where("role = 'assistant'")
        .groupBy("conv_id")
        .agg(F.max(F.struct(F.coalesce("turn", F.lit(FIRST)).alias("place"), "text")).alias("reply"))
    )
    other = replies.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply.text").alias("foreign"))
    exchange = replies.join(other, "conv_id").select("conv_id", F.col("reply.place").alias("reply_place"), "foreign")
    placed = rest.join(exchange, "conv_id", "left")
    alone = F.col("reply_place").isNull()
    own = F.struct(F.when(alone, "single").otherwise("chosen").alias("side"), "text")
    before = F.struct(F.lit("rejected").alias("side"), "text")
    instead = F.struct(F.lit("rejected").alias("side"), F.col("foreign").alias("text"))
    is_reply = (F.col("place") == F.col("reply_place")) & F.col("role").eqNullSafe("assistant")
    made = F.when(alone, F.array(own)).when(F.col("place") < F.col("reply_place"), F.array(own, before))
    made = made.when(is_reply, F.array(own, instead)).otherwise(F.array(own))
    exploded = placed.select("conv_id", "turn", "role", alone.alias("alone"), F.explode(made).alias("made"))
    other_id = F.when(~F.col("alone"), F.col("conv_id").bitwiseXOR(F.lit(1)))
    exchanged = exploded.select(F.col("conv_id").alias("chosen_id"), other_id.alias("rejected_id"), "made.side", "turn", "role", "made.text")
    return sides_of(turns, opened).unionByName(exchanged)


def format_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rendered turns of the prompt and both completions of every pair."""
    return format_sides(sides_of(conversations, pairs))


def format_sides(sides: DataFrame) -> DataFrame:
    """Rendered turns of the prompt and both completions of every pair of sides, and of single conversations."""
    rows = sides.where("side != 'single'")
    digests = {"a": _content(1), "b": _content(2)}
    of = lambda side, c: F.sum(F.when(F.col("side") == side, c).cast("decimal(20,0)"))
    compared = (
        rows.withColumns(digests)
        .withColumn("place", F.coalesce("turn", F.lit(FIRST)))
        .groupBy(*KEY, "place")
        .agg(
            *[
                of("chosen", c).eqNullSafe(of("rejected", c)).alias(name)
                for name, c in (("n", F.lit(1)), ("a", F.col("a")), ("b", F.col("b")))
            ]
        )
    )
    differs = compared.groupBy(*KEY).agg(F.min(F.when(~(F.col("n") & F.col("a") & F.col("b")), F.col("place"))).alias("parts_at"))
    shared = F.col("parts_at").isNull() | (F.coalesce("turn", F.lit(FIRST)) < F.col("parts_at"))
    placed = rows.join(differs, KEY).withColumn("shared", shared).drop("parts_at")
    alone = sides.where("side = 'single'").withColumn("shared", F.lit(False))
    header = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"))
    trained = ~F.col("shared") & F.coalesce(F.col("role") == "assistant", F.lit(False))
    return (
        placed.where(~F.col("shared") | (F.col("side") == "chosen"))
        .unionByName(alone)
        .select(
            *KEY,
            F.when(F.col("shared"), "prompt").otherwise(F.col("side")).alias("segment"),
            "turn",
            "role",
            F.concat(header, F.coalesce("text", F.lit("")), F.lit("<|end|>\n")).alias("rendered"),
            trained.alias("trained"),
            F.length(header).cast("long").alias("train_from"),
        )
    )


def assemble(formatted: DataFrame) -> DataFrame:
    """One row per pair with prompt, chosen and rejected as strings, for conversations that fit in a row."""
    ordered = lambda name: F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("segment") == name, F.struct("turn", "role", "rendered")))),
            lambda x: x["rendered"],
        ),
        "",
    ).alias(name)
    return formatted.groupBy("chosen_id", "rejected_id").agg(*[ordered(n) for n in ("prompt", "chosen", "rejected")])


#: The same in DuckDB, for tables without repeated turns or turns without a number.
ORACLE_SQL = """
with t as (select conv_id, turn, role, text from conversations where conv_id is not null),
first as (select conv_id, arg_min({'r': role, 'x': text}, turn) as o from t group by 1),
once as (select *, row_number() over w - 1 as k, lead(conv_id) over w as other from first
  window w as (partition by o, floor(conv_id / 1024) order by conv_id)),
twice as (select *, row_number() over w - 1 as k2, lead(conv_id) over w as other2 from once where k % 2 = 0 and other is null
  window w as (partition by o order by conv_id)),
opened as (
  select conv_id as chosen_id, other as rejected_id from once where k % 2 = 0 and other is not null
  union all select conv_id, other2 from twice where k2 % 2 = 0 and other2 is not null),
last as (select conv_id, max(turn) as reply_turn, arg_max(coalesce(text, chr(0)), turn) as reply from t where role = 'assistant' group by 1),
exchange as (
  select a.conv_id, a.reply_turn, b.conv_id as other_id, nullif(b.reply, chr(0)) as reply from last a join last b on b.conv_id = xor(a.conv_id, 1)),
rest as (
  select t.*, e.reply_turn, e.other_id, e.reply from t left join exchange e using (conv_id)
  where conv_id not in (select chosen_id from opened union all select rejected_id from opened)),
c as (
  select p.*, t.turn, t.role, t.text from opened p join t on t.conv_id = p.chosen_id
  union all select conv_id, other_id, turn, role, text from rest where other_id is not null),
r as (
  select p.*, t.turn, t.role, t.text from opened p join t on t.conv_id = p.rejected_id
  union all select conv_id, other_id, turn, role, case when turn = reply_turn then reply else text end from rest where turn <= reply_turn),
parts as (
  select coalesce(c.chosen_id, r.chosen_id) as chosen_id, coalesce(c.rejected_id, r.rejected_id) as rejected_id,
         min(coalesce(c.turn, r.turn)) filter (where c.turn is null or r.turn is null
           or c.role is distinct from r.role or c.text is distinct from r.text) as parts_at
  from c full join r on c.chosen_id = r.chosen_id and c.rejected_id = r.rejected_id and c.turn = r.turn group by 1, 2),
rows as (
  select c.*, 'chosen' as side from c union all select r.*, 'rejected' from r),
placed as (
  select rows.*, parts_at is null or turn < parts_at as shared from rows join parts using (chosen_id, rejected_id)
  union all select conv_id, null, turn, role, text, 'single', false from rest where other_id is null)
select chosen_id, rejected_id, case when shared then 'prompt' else side end as segment, turn, role,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as rendered,
  not shared and coalesce(role = 'assistant', false) as trained,
  length(coalesce(role, '')) + 5 as train_from
from placed where not shared or side = 'chosen' or side = 'single'
"""
