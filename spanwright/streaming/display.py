"""What a viewer would have seen: reveal policies over successive hypotheses of one sentence, and their scores.

A hypothesis has track, seq (order), at_ms, tokens, conf and committed; a committed one is the last of its track.
Everything is windows over one track, so one shuffle by track serves all policies.  Policies are told apart by
lengths of prefixes, so that no text is copied for each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.text import common_prefix

#: The grids that the policies are named from.
TAUS = [0.3, 0.5, 0.7, 0.9]
AGREEMENT = [2, 3]
CONFIDENCE = [1, 2]
HELD_BACK = [0, 1, 2, 3]


def policy_names() -> list[str]:
    names = ["commit_only"] + [f"{p}_n{n}" for n in AGREEMENT for p in ("agreement", "frozen_agreement")]
    for tau in TAUS:
        at = round(100 * tau)
        names += [f"confidence_n{n}_tau{at}" for n in CONFIDENCE] + [f"agreement_n{n}_confidence_tau{at}" for n in AGREEMENT]
    return names + [f"mask_k{k}" for k in HELD_BACK]


def _prefix_where(flags: Column) -> Column:
    """How many flags hold from the first on; null counts as not."""
    first = F.array_position(F.transform(flags, lambda x: F.coalesce(x, F.lit(False))), False)
    return F.when(first == 0, F.size(flags)).otherwise(first - 1).cast("long")


def _agreed(n: int) -> Column:
    """Length of the prefix that the last n hypotheses share; null before there are n."""
    shared = [common_prefix(F.col("tokens"), F.col(f"tokens_{d}")) for d in range(1, n)]
    return F.when(F.col(f"tokens_{n - 1}").isNotNull(), F.least(*shared) if n > 2 else shared[0])


def _held(n: int, tau: float) -> Column:
    """Length of the prefix whose tokens were sure and unchanged in the last n hypotheses."""
    sure = F.transform("conf", lambda c: c >= tau)
    for d in range(1, n):
        same = F.zip_with("tokens", f"tokens_{d}", lambda a, b: a == b)
        before = F.zip_with(same, F.transform(f"conf_{d}", lambda c: c >= tau), lambda a, b: a & b)
        sure = F.zip_with(sure, before, lambda a, b: a & b)
    # positions that an older, longer hypothesis had do not count
    return F.least(_prefix_where(sure), F.size("tokens").cast("long"))


def replay(hyps: DataFrame) -> DataFrame:
    """(track, policy, seq, at_ms, commit, shown, own, wrong, kept, shown_before, n_final, last): each screen of each policy in counts.

    ``shown`` tokens are on screen, ``own`` of them as a prefix of the last hypothesis, ``wrong`` disagree with it or exceed
    it, ``kept`` remain from the screen before.  Of hypotheses at one time only the last makes a screen.
    """
    w = Window.partitionBy("track").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    most = max(AGREEMENT + CONFIDENCE) - 1
    back = {f"{c}_{d}": F.lag(c, d).over(w) for c in ("tokens", "conf") for d in range(1, most + 1)}
    seen = hyps.withColumns(
        back | {"final": F.last("tokens").over(whole), "commit": F.bool_or("committed").over(whole), "next_ms": F.lead("at_ms").over(w)}
    )
    seen = seen.withColumns({f"agreed_{n}": _agreed(n) for n in AGREEMENT})

    def frozen(n: int) -> Column:
        agreed_now = F.when(F.col(f"agreed_{n}").isNotNull(), F.slice("tokens", F.lit(1), F.col(f"agreed_{n}").cast("int")))
        extends = lambda f, a: (F.size(a) > F.size(f)) & (F.slice(a, F.lit(1), F.size(f)) == f)
        return F.aggregate(F.collect_list(agreed_now).over(so_far), F.array().cast("array<string>"), lambda f, a: F.when(extends(f, a), a).otherwise(f))

    seen = seen.withColumns({f"frozen_{n}": F.when(F.col("committed"), F.col("tokens")).otherwise(frozen(n)) for n in AGREEMENT})
    visible = F.col("next_ms").isNull() | (F.col("next_ms") != F.col("at_ms"))
    size = F.size("tokens").cast("long")
    none = None
    zero = F.lit(0).cast("long")
    reveals = [("commit_only", zero, False, none)]
    for n in AGREEMENT:
        reveals += [(f"agreement_n{n}", F.coalesce(f"agreed_{n}", zero), True, none), (f"frozen_agreement_n{n}", none, False, f"frozen_{n}")]
    for tau in TAUS:
        at = round(100 * tau)
        reveals += [(f"confidence_n{n}_tau{at}", _held(n, tau) if n == 1 else F.when(F.col(f"tokens_{n - 1}").isNotNull(), _held(n, tau)).otherwise(zero), True, none) for n in CONFIDENCE]
        reveals += [
            (f"agreement_n{n}_confidence_tau{at}", F.coalesce(F.least(F.when(F.col(f"agreed_{n}").isNotNull(), _held(1, tau)), F.col(f"agreed_{n}")), zero), True, none)
            for n in AGREEMENT
        ]
    reveals += [(f"mask_k{k}", F.greatest(size - k, zero), False, none) for k in HELD_BACK]
    lengths, is_frozen = [], {}
    for at, (_, k, grows, frozen_text) in enumerate(reveals):
        if frozen_text is not None:
            is_frozen[at] = frozen_text
            lengths.append(F.size(frozen_text).cast("long"))
        else:
            lengths.append(F.when(F.col("committed"), size).otherwise(F.least(F.max(k).over(so_far), size) if grows else k))
    # a screen is the first tokens of a hypothesis, so its length says it all; texts are never multiplied by the policies
    seen = seen.withColumn("shown", F.array(*lengths)).where(visible)
    none_yet = F.array().cast("array<string>")
    was = {f"was_{c}": F.lag(c).over(w) for c in ["tokens", "shown", *(f"frozen_{n}" for n in AGREEMENT)]}
    seen = seen.withColumns(was | {"last": F.lead("seq").over(w).isNull()})
    unlike = F.zip_with("tokens", "final", lambda a, b: F.coalesce(a != b, F.lit(False)))
    unlike = F.filter(F.transform(unlike, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    seen = seen.withColumns(
        {
            "agrees": common_prefix(F.col("tokens"), F.col("final")),
            "stays": common_prefix(F.coalesce("was_tokens", none_yet), F.col("tokens")),
            "unlike": unlike,
            "n_final": F.size("final").cast("long"),
        }
    )

    def counts(at: int, policy: str) -> Column:
        shown, before = F.col("shown")[at], F.coalesce(F.col("was_shown")[at], zero)
        if at in is_frozen:
            screen = F.col(is_frozen[at])
            own, kept = common_prefix(screen, F.col("final")), common_prefix(F.coalesce("was_" + is_frozen[at], none_yet), screen)
            differs = F.size(F.filter(F.zip_with(screen, "final", lambda a, b: a != b), lambda x: x))
        else:
            own, kept = F.least(shown, "agrees"), F.least(before, shown, F.col("stays"))
            differs = F.size(F.filter("unlike", lambda i: i < shown))
        wrong = differs + F.greatest(shown - F.col("n_final"), zero)
        named = {"shown": shown, "own": own, "wrong": wrong, "kept": kept, "shown_before": before}
        return F.struct(F.lit(policy).alias("policy"), *[c.cast("long").alias(k) for k, c in named.items()])

    rows = F.explode(F.array(*[counts(at, p) for at, (p, _, _, _) in enumerate(reveals)])).alias("r")
    flat = seen.select("track", "seq", "at_ms", "commit", "n_final", "last", rows)
    return flat.select("track", "r.policy", "seq", "at_ms", "commit", "r.shown", "r.own", "r.wrong", "r.kept", "r.shown_before", "n_final", "last")


def track_scores(screens: DataFrame) -> DataFrame:
    """One row a track and policy, in whole numbers and sums, so that rows of any groups of tracks add up."""
    whole = Window.partitionBy("track", "policy")
    early = F.col("at_ms") < F.max("at_ms").over(whole)
    seen = screens.withColumn("early", early)
    of_early = lambda c: F.coalesce(F.max(F.when(F.col("early"), F.col(c))), F.lit(0))
    leaves = F.when(F.col("last") & ~F.col("commit"), F.col("shown")).otherwise(0)
    per = seen.groupBy("track", "policy").agg(
        F.first("commit").alias("commit"),
        F.max("n_final").alias("n_final"),
        F.sum(F.col("shown_before") - F.col("kept") + leaves).alias("n_erased"),
        F.min(F.when(F.col("shown") > 0, F.col("at_ms"))).alias("first_ms"),
        F.max("at_ms").alias("commit_ms"),
        of_early("shown").alias("most"),
        of_early("own").alias("own"),
        of_early("wrong").alias("wrong"),
    )
    done = F.col("commit")
    part = lambda c: F.when(done, c)
    return per.select(
        "track",
        "policy",
        done.cast("long").alias("n_tracks"),
        "n_erased",
        F.when(done, F.col("n_final")).otherwise(0).alias("n_final_tokens"),
        (~done & F.col("first_ms").isNotNull()).cast("long").alias("n_phantoms"),
        part((F.coalesce("first_ms", "commit_ms") - F.col("commit_ms")) / 1000).alias("latency_s"),
        part(F.col("own") / F.greatest("n_final", F.lit(1))).alias("revealed"),
        part(F.when(F.col("most") > 0, F.col("wrong") / F.col("most")).otherwise(0.0)).alias("prefix_error"),
        part((F.col("wrong") > 0).cast("double")).alias("contradicted"),
        part((F.col("most") > F.col("n_final")).cast("double")).alias("vanished"),
    )


def without_separator(tokens: Column, separator: str) -> Column:
    return F.filter(tokens, lambda t: t != separator)


def boundary_flips(hypotheses: DataFrame, separator: str) -> DataFrame:
    """(track, n_flips): screens (track, seq, tokens) whose separators are not those of the screen before.

    One came or went, or one moved, so that the texts on both of its sides changed; a change within one text is none.
    Tokens hold no spaces.
    """
    marked = F.array_join(F.transform("tokens", lambda t: F.when(t == separator, "\n").otherwise(t)), " ")
    parts = F.transform(F.split(marked, "\n", -1), F.trim)
    w = Window.partitionBy("track").orderBy("seq")
    seen = hypotheses.withColumn("parts", parts).withColumn("was", F.lag("parts").over(w))
    changed = F.zip_with("parts", "was", lambda a, b: ~a.eqNullSafe(b))
    moved = F.exists(F.zip_with("changed", F.slice("changed", 2, F.greatest(F.size("changed") - 1, F.lit(0))), lambda a, b: a & F.coalesce(b, F.lit(False))), lambda x: x)
    flip = F.col("was").isNotNull() & ((F.size("parts") != F.size("was")) | moved)
    return seen.withColumn("changed", changed).groupBy("track").agg(F.count_if(flip).alias("n_flips"))


SUMS = ["n_tracks", "n_erased", "n_final_tokens", "n_phantoms", "latency_s", "revealed", "prefix_error", "contradicted", "vanished"]


def totals(scores: DataFrame, *keys: str) -> DataFrame:
    """Partial sums by ``keys``; totals of totals are totals."""
    return scores.groupBy(*keys, "policy").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])


def rates(sums: DataFrame) -> DataFrame:
    """Means over committed tracks and rates from summed counts; null where there is nothing to divide by."""
    over = lambda c, n: F.round(F.when(F.col(n) > 0, F.col(c) / F.col(n)), 6)
    return sums.select(
        "policy",
        "n_tracks",
        over("latency_s", "n_tracks").alias("first_token_latency_s"),
        over("revealed", "n_tracks").alias("revealed_fraction"),
        over("prefix_error", "n_tracks").alias("frozen_prefix_error"),
        over("contradicted", "n_tracks").alias("contradicted_rate"),
        over("vanished", "n_tracks").alias("vanished_rate"),
        over("n_phantoms", "n_tracks").alias("phantom_rate"),
        over("n_erased", "n_final_tokens").alias("normalized_erasure"),
    )


def lagging(screens: DataFrame, units: DataFrame) -> DataFrame:
    """(track, policy, laal_s) against units (track, start_ms, end_ms, n_words): length-adaptive average lagging.

    A token counts as shown from the time on at which every later screen shows the last hypothesis through it.  As the
    delays of one screen are equal, a screen stands for all tokens that become stable on it, and no row is per token.
    """
    w = Window.partitionBy("track", "policy").orderBy("seq")
    later = w.rowsBetween(0, Window.unboundedFollowing)
    low = screens.where("commit").withColumn("low", F.min("own").over(later))
    step = low.withColumn("was", F.coalesce(F.lag("low").over(w), F.lit(0))).where("low > was").join(units, "track")
    duration = (F.col("end_ms") - F.col("start_ms")).cast("double")
    delay = F.greatest(F.col("at_ms") - F.col("start_ms"), F.lit(0)).cast("double")
    rate = duration / F.greatest("n_final", "n_words", F.lit(1))
    step = step.withColumns({"delay": delay, "rate": rate, "over": delay >= duration})
    # of the screens past the unit's end only the first token of the first one counts
    ended = F.coalesce(F.max(F.col("over").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.when(F.col("over"), 1).otherwise(F.col("low") - F.col("was"))
    used = step.withColumn("ended", ended).where("ended = 0").withColumn("n", n)
    ranks = F.col("n") * F.col("was") + F.col("n") * (F.col("n") - 1) / 2
    per = used.groupBy("track", "policy").agg(F.sum(F.col("n") * F.col("delay") - F.col("rate") * ranks).alias("total"), F.sum("n").alias("tau"))
    return per.select("track", "policy", (F.col("total") / F.col("tau") / 1000).alias("laal_s"))


#: Starts of tracks are joined by bins of so many frames.
START_BIN = 1024


def group_tracks(trace: DataFrame) -> DataFrame:
    """Give every hypothesis of a stream its sentence, ``track``: a number in order of the tracks' first hypotheses.

    ``trace`` has stream_id, seq, at_ms, track_id (the gate's, null for none), start_frame, delta_frames, committed and
    open_span.  Closed hypotheses of one id make a track until one of them commits; one without an id is its own.  An open
    one joins the track that started nearest to it, at most delta frames away, and goes on after it, but not that of
    another unit which the same pass closed; without one it joins or makes a track of open hypotheses.

    Closed tracks are told apart by how often their id has committed before, open ones find them by a join on bins of the start;
    only the open ones that find none are folded in turn, as the tracks that they make depend on the order.
    """
    stream = ["stream_id"]
    lives = Window.partitionBy("stream_id", "track_id", F.when(F.col("track_id").isNull(), F.col("seq")), "open_span").orderBy("seq")
    before = F.coalesce(F.count_if("committed").over(lives.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.when(F.col("track_id").isNull(), F.concat(F.lit("seq "), "seq")).otherwise(F.concat_ws(" ", F.lit("id"), "track_id", before))
    named = trace.withColumn("closed_track", F.when(~F.col("open_span"), own))
    after = Window.partitionBy(*stream).orderBy("seq")
    rival = F.lead(F.struct("closed_track", "at_ms", "start_frame")).over(after)
    named = named.withColumn("rival", rival)
    tracks = named.where("not open_span").groupBy(*stream, F.col("closed_track").alias("name")).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("start_frame", "seq").alias("track_start")
    )
    bin_of = lambda c: F.floor(c / START_BIN)
    reach = F.sequence(bin_of(F.col("start_frame") - F.col("delta_frames")), bin_of(F.col("start_frame") + F.col("delta_frames")))
    asking = named.where("open_span and delta_frames >= 0").select(*stream, "seq", "at_ms", "start_frame", "delta_frames", "rival", F.explode(reach).alias("start_bin"))
    gap = F.abs(F.col("track_start") - F.col("start_frame"))
    closed_by_pass = (F.col("rival.at_ms") == F.col("at_ms")) & (F.col("rival.start_frame") != F.col("start_frame")) & (F.col("rival.closed_track") == F.col("name"))
    near = (gap <= F.col("delta_frames")) & (F.col("last_seq") > F.col("seq")) & ~F.coalesce(closed_by_pass, F.lit(False))
    met = asking.join(tracks.withColumn("start_bin", bin_of(F.col("track_start"))), [*stream, "start_bin"]).where(near)
    found = met.groupBy(*stream, "seq").agg(F.min(F.struct(gap, "first_seq", "name"))["name"].alias("found"))
    placed = named.join(found, [*stream, "seq"], "left")
    lone = placed.where("open_span and found is null").groupBy(*stream).agg(
        F.sort_array(F.collect_list(F.struct("seq", F.col("start_frame").cast("long").alias("start"), F.col("delta_frames").cast("long").alias("delta")))).alias("rows")
    )

    def fold(state, row):
        gaps = F.transform(state["starts"], lambda s, k: F.struct(F.abs(s - row["start"]).alias("gap"), k.alias("k")))
        nearest = F.array_min(F.filter(gaps, lambda g: g["gap"] <= row["delta"]))
        owner = F.coalesce(nearest["k"], F.size(state["starts"]))
        starts = F.when(nearest.isNull(), F.concat(state["starts"], F.array(row["start"]))).otherwise(state["starts"])
        return F.struct(starts.alias("starts"), F.concat(state["owners"], F.array(owner)).alias("owners"))

    none = F.struct(F.array().cast("array<bigint>").alias("starts"), F.array().cast("array<int>").alias("owners"))
    owners = F.aggregate("rows", none, fold, lambda s: s["owners"])
    dealt = lone.select(*stream, F.explode(F.arrays_zip(F.transform("rows", lambda r: r["seq"]).alias("seq"), owners.alias("owner"))).alias("x"))
    dealt = dealt.select(*stream, "x.seq", F.concat(F.lit("open "), "x.owner").alias("opened"))
    whole = placed.join(dealt, [*stream, "seq"], "left").withColumn("name", F.coalesce("closed_track", "found", "opened"))
    first = F.min("seq").over(Window.partitionBy(*stream, "name"))
    number = F.dense_rank().over(Window.partitionBy(*stream).orderBy("first_of_track")) - 1
    return whole.withColumn("first_of_track", first).select(*trace.columns, number.cast("long").alias("track"))
