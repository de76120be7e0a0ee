"""From display cues to trusted units: rolling duplicates, sentence grouping, quarantine, cuts at runs without poses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions import text as tx
from spanwright.operators import intervals as iv

CUE = "struct<start_ms:bigint,end_ms:bigint,text:string>"
#: Titles after which no sentence ends; a mark that ends one; what ends a whole unit; an ellipsis.
TITLE_END = r"(?i)(^|[^A-Za-z])(dr|mr|mrs|ms|st|prof|rev|sen|gen|gov|lt|col|capt|sgt|mt)\.$"
STOP_END = r"(^|[^.])[.!?][\"')\]]*$"
ELLIPSIS_END = r"\.{2,}[\"')\]]*$"
FINAL = r"[.!?][\"')\]]*$"
INNER_STOP = r"([^.])\.([\"')\]]*)[ \t]+([^ \t])"


def merge_rolling(cues: DataFrame) -> DataFrame:
    """Fuse cues that show one text twice: the next overlaps the last and its text equals, holds or is part of the last one's.

    The longer text stays, the new one among equals.  Only cues of one island of overlaps can fuse, so an island is the
    unit of the fold, not a video.  A null text fuses with nothing.
    """
    w = iv.by_video()
    reached = F.max("end_ms").over(iv.earlier(w))
    fresh = (reached.isNull() | (F.col("start_ms") >= reached)).cast("int")
    islands = cues.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = islands.groupBy("video_id", "island").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "idx", "text"))).alias("cues"))

    def step(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        same = F.coalesce(F.contains(c["text"], last["text"]) | F.contains(last["text"], c["text"]), F.lit(False))
        new = F.struct(c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), c["text"].alias("text"))
        fused = F.struct(
            last["start_ms"].alias("start_ms"),
            F.greatest(last["end_ms"], c["end_ms"]).alias("end_ms"),
            F.when(F.length(c["text"]) >= F.length(last["text"]), c["text"]).otherwise(last["text"]).alias("text"),
        )
        joins = (F.size(done) > 0) & (c["start_ms"] < last["end_ms"]) & same
        all_but_last = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(all_but_last, F.array(fused))).otherwise(F.concat(done, F.array(new))).cast(f"array<{CUE}>")

    folded = F.aggregate("cues", F.array().cast(f"array<{CUE}>"), step)
    return grouped.select("video_id", F.explode(folded).alias("m")).select("video_id", "m.*")


def _starts_small(text: Column) -> Column:
    return F.regexp_extract(text, r"[\p{L}]", 0).rlike(r"^\p{Ll}")


def group_sentences(cues: DataFrame, trusted_gap_ms: int, pause_ms: int | None, most_words: int = 60) -> DataFrame:
    """Units of whole cues: a junction is crossed where the text runs on and the times allow it.

    A sentence ends at a final mark at the end of a cue unless a lower-case word follows in a video that has both cases; a
    title or, before a lower-case word or further dots, an ellipsis ends none.  Gaps over ``trusted_gap_ms`` are never
    crossed, those over ``pause_ms`` only where the next cue shows that the sentence goes on.  A run of several cues
    becomes one unit if it ends with a final mark, reads as prose and holds no sentence of over ``most_words``; inner
    full stops become commas.  Otherwise its cues stay as they are.  A null text counts as empty.
    """
    w = iv.by_video()
    cues = cues.withColumn("text", F.coalesce("text", F.lit("")))
    case = cues.groupBy("video_id").agg((F.bool_or(F.col("text").rlike(r"\p{Lu}")) & F.bool_or(F.col("text").rlike(r"\p{Ll}"))).alias("cased"))
    seen = cues.join(case, "video_id").withColumns({"before": F.rtrim(F.lag("text").over(w)), "before_end": F.lag("end_ms").over(w)})
    next_, before = F.ltrim("text"), F.col("before")
    small = _starts_small(next_)
    crosses = (
        F.when(before.rlike(TITLE_END), True)
        .when(before.rlike(ELLIPSIS_END), small | next_.startswith(".."))
        .when(before.rlike(STOP_END), F.col("cased") & small)
        .otherwise(True)
    )
    gap = F.col("start_ms") - F.col("before_end")
    crosses = crosses & (gap <= trusted_gap_ms)
    if pause_ms is not None:
        pronoun = F.regexp_extract(next_, tx.WORD, 0).rlike("^I($|')")
        crosses = crosses & ((gap <= pause_ms) | ~F.col("cased") | small | pronoun)
    seen = seen.withColumn("fresh", (~F.coalesce(crosses, F.lit(False))).cast("int"))
    seen = seen.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = seen.groupBy("video_id", "run").agg(F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "idx", "text"))).alias("cues"))
    joined = F.trim(F.array_join(F.transform("cues", lambda c: c["text"]), " "))
    runs = runs.withColumns({"joined": joined, "n": F.size("cues"), "end_ms": F.array_max(F.transform("cues", lambda c: c["end_ms"]))})
    runs = runs.withColumn("start_ms", F.get("cues", F.lit(0))["start_ms"])
    words = F.filter(F.split("joined", r"\s+", -1), lambda x: x != "")
    longest = F.array_max(F.transform(F.split("joined", r"[.!?]+[\"')\]]*\s+", -1), lambda s: F.size(F.filter(F.split(s, r"\s+", -1), lambda x: x != ""))))
    seconds = F.greatest((F.col("end_ms") - F.col("start_ms")) / 1000, F.lit(0.001))
    upper = F.size(F.filter(words, lambda x: x.rlike(r"^\P{L}*\p{Lu}")))
    gloss = (F.size(words) <= 2.5 * F.col("n")) & (upper >= 0.6 * F.size(words))
    prose = (F.size(words) / seconds >= 0.3) & ~gloss
    whole = (F.col("n") == 1) | (F.col("joined").rlike(FINAL) & prose & (longest <= most_words))
    rendered = F.regexp_replace("joined", INNER_STOP, "$1,$2 $3")
    unit = F.struct("start_ms", "end_ms", F.when(F.col("joined").rlike(FINAL) & (longest <= most_words), rendered).otherwise(F.col("joined")).alias("text"), F.col("n").cast("long").alias("n_cues"))
    alone = F.transform("cues", lambda c: F.struct(c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), c["text"].alias("text"), F.lit(1).cast("long").alias("n_cues")))
    return runs.select("video_id", F.explode(F.when(whole, F.array(unit)).otherwise(alone)).alias("u")).select("video_id", "u.*")


def fold_sentence_starts(parts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``part`` with its first word in lower case where only its place gave it a capital: the word is in ``lexicon`` (word).

    Words of one letter or in capitals throughout, the pronoun I, and a word before another capital one (a name) stay.
    """
    pronoun = "^I($|')"
    found = tx.words(F.col("part"))
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    named = F.coalesce(second.rlike(r"^\p{Lu}") & ~second.rlike(pronoun), F.lit(False))
    folds = first.rlike(r"^\p{Lu}") & (F.length(first) > 1) & first.rlike(r"\p{Ll}") & ~first.rlike(pronoun) & ~named
    judged = parts.withColumn("word", F.when(folds, F.lower(first)))
    known = lexicon.select("word").distinct().withColumn("known", F.lit(True))
    at = F.instr("part", first)
    small = F.concat(F.substring("part", F.lit(1), at - 1), F.lower(F.substring(first, 1, 1)), F.substring("part", at + 1, F.length("part")))
    return judged.join(known, "word", "left").withColumn("part", F.when(F.col("known"), small).otherwise(F.col("part"))).drop("word", "known")


def repeated_texts(units: DataFrame, train: DataFrame, least_words: int, most_videos: int) -> DataFrame:
    """(video_id, n): how many units of each video say what a training unit (video_id, text) says, word for word.

    Only units of ``least_words`` or more count, and texts of more than ``most_videos`` training videos are no evidence.
    """
    said = F.array_join(tx.words(F.lower("text")), " ").alias("said")
    known = train.select("video_id", said).where(F.size(F.split("said", " ")) >= least_words)
    known = known.groupBy("said").agg(F.count_distinct("video_id").alias("videos")).where(F.col("videos") <= most_videos).select("said", F.lit(1).alias("hit"))
    asked = units.select("video_id", said)
    return asked.join(known, "said", "left").groupBy("video_id").agg(F.count("hit").alias("n"))


def mark_unreliable(units: DataFrame, marks: DataFrame, bin_ms: int) -> DataFrame:
    """Units (with ``reliable``) that overlap a mark become unreliable, and each mark becomes an unreliable unit without a text."""
    hit = iv.touched_spans(units, marks, bin_ms).withColumn("hit", F.lit(True))
    kept = units.join(hit, ["video_id", "start_ms", "end_ms"], "left")
    kept = kept.withColumn("reliable", F.col("reliable") & F.col("hit").isNull()).select("video_id", "idx", "start_ms", "end_ms", "reliable")
    return kept.unionByName(marks.select("video_id", "idx", "start_ms", "end_ms", F.lit(False).alias("reliable")))


def quarantine_units(units: DataFrame, runs: DataFrame, share: float, frame_ms: int, bin_frames: int) -> DataFrame:
    """Units become unreliable when at least ``share`` of their frames lie in ``runs`` (video_id, idx, a, b: half-open frames)."""
    flat = iv.merged_runs(runs.select("video_id", "idx", F.col("a").alias("start_ms"), F.col("b").alias("end_ms")))
    first = F.greatest(F.floor(F.col("start_ms") / frame_ms), F.lit(0))
    framed = units.select("video_id", "idx", first.alias("start_ms"), F.ceil(F.col("end_ms") / frame_ms).alias("end_ms"))
    inside = iv.overlap_join(framed, flat.select("video_id", "start_ms", "end_ms"), bin_frames).groupBy("video_id", "idx").agg(
        F.sum(iv.overlap_ms()).alias("frames"), F.first(F.col("end_ms") - F.col("start_ms")).alias("n")
    )
    bad = inside.where(F.col("frames") >= F.lit(share) * F.col("n")).select("video_id", "idx", F.lit(True).alias("bad"))
    joined = units.join(bad, ["video_id", "idx"], "left")
    return joined.withColumn("reliable", F.col("reliable") & F.col("bad").isNull()).drop("bad")


def clean_segments(runs: DataFrame, streams: DataFrame, least_ms: int) -> DataFrame:
    """(video_id, seg_start, seg_end): what is left of each stream (video_id, total_ms) between ``runs`` (video_id, idx, spans).

    Runs closer than ``least_ms`` merge and reach a stream's end that is closer than that, so no segment is shorter.
    """
    merged = iv.merged_runs(runs, least_ms - 1).join(streams, "video_id")
    a = F.when(F.col("start_ms") < least_ms, F.lit(0)).otherwise(F.col("start_ms"))
    b = F.when(F.col("total_ms") - F.col("end_ms") < least_ms, F.col("total_ms")).otherwise(F.col("end_ms"))
    cut = merged.select("video_id", "total_ms", a.alias("a"), b.alias("b"))
    w = Window.partitionBy("video_id").orderBy("a")
    before = cut.select("video_id", F.coalesce(F.lag("b").over(w), F.lit(0)).alias("seg_start"), F.col("a").alias("seg_end"))
    tail = streams.join(cut.groupBy("video_id").agg(F.max("b").alias("last")), "video_id", "left")
    tail = tail.select("video_id", F.coalesce("last", F.lit(0)).alias("seg_start"), F.col("total_ms").alias("seg_end"))
    return before.unionByName(tail).where("seg_end > seg_start").select("video_id", F.col("seg_start").cast("long").alias("seg_start"), F.col("seg_end").cast("long").alias("seg_end"))


def split_units(units: DataFrame, segments: DataFrame, streams: DataFrame, bin_ms: int) -> DataFrame:
    """Units on the clocks of the segments they touch; one that crosses an edge is unreliable, but for the stream's own end."""
    there = segments.join(streams, "video_id").select("video_id", F.col("seg_start").alias("start_ms"), F.col("seg_end").alias("end_ms"), "total_ms")
    met = iv.overlap_join(units, there, bin_ms, "seg_")
    whole = (F.col("start_ms") >= F.col("seg_start_ms")) & ((F.col("seg_end_ms") == F.col("seg_total_ms")) | (F.col("end_ms") <= F.col("seg_end_ms")))
    return met.select(
        "video_id",
        F.col("seg_start_ms").alias("seg_start"),
        "idx",
        (F.col("start_ms") - F.col("seg_start_ms")).alias("start_ms"),
        (F.col("end_ms") - F.col("seg_start_ms")).alias("end_ms"),
        (F.col("reliable") & whole).alias("reliable"),
    )
