"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from spanwright.functions import text as tx
from spanwright.operators import dedup, labels, matching, scoring, textmetrics
from spanwright.operators import intervals as iv
from spanwright.streaming.commit_gate import CommitGate, Config, replay

SPAN = "video_id long, idx long, start_ms long, end_ms long"


def spans(spark, *rows):
    return spark.createDataFrame([(1, i, int(a * 1000), int(b * 1000)) for i, (a, b) in enumerate(rows)], SPAN)


def edges(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tiou(spark):
    got = iv.overlap_join(spans(spark, (0, 10)), spans(spark, (5, 15)), 3000).select(iv.tiou()).collect()
    assert got[0][0] == pytest.approx(1 / 3) and len(got) == 1


def test_plain_match_takes_the_higher_index(spark):
    got = matching.match_segments(spans(spark, (0, 10), (0, 10)), spans(spark, (0, 10)), 0.5, 60_000)
    assert edges(got, "event", "gold") == [(1, 0)]


def test_item_match_takes_the_lower_index_and_blocks_units(spark):
    units = spans(spark, (0, 2), (2, 4))
    items = matching.chunk_items(iv.chunks(units, 500))
    assert edges(matching.match_items(spans(spark, (0, 4)), items, 0.5, 60_000), "event", "first_unit", "last_unit") == [(0, 0, 1)]
    both = spans(spark, (0, 4), (0, 2))
    found = matching.match_items(both, items, 0.5, 60_000)
    assert edges(found, "event", "first_unit", "last_unit") == [(0, 0, 1)]
    row = scoring.grid_scores(found, both, units, [0.5]).where("threshold = 0.5").first()
    assert (row.precision, row.recall) == (0.5, 1.0)


def test_clamp(spark):
    got = iv.clamp_overlaps(spans(spark, (0, 5), (1, 2), (4, 6)), 500)
    assert edges(got, "start_ms", "end_ms", "reliable") == [(0, 5000, False), (5000, 6000, False)]
    got = iv.clamp_overlaps(spans(spark, (0, 5), (4.7, 6)), 500)
    assert edges(got, "start_ms", "end_ms", "reliable") == [(0, 5000, True), (5000, 6000, True)]


def test_gap_of_the_limit_is_trusted(spark):
    length = spark.createDataFrame([(1, 12000)], "video_id long, total_ms long")
    assert iv.untrusted_gaps(spans(spark, (0, 2), (10, 12)), 8000, length).count() == 0
    assert edges(iv.untrusted_gaps(spans(spark, (0, 2), (10.001, 12)), 8000, length), "gap_start", "gap_end") == [(2000, 10001)]


def test_half_in_quarantine_stays(spark):
    assert iv.drop_quarantined(spans(spark, (0, 2)), spans(spark, (1, 3)), 60_000).count() == 1
    assert iv.drop_quarantined(spans(spark, (0, 2)), spans(spark, (0.9, 3)), 60_000).count() == 0


def test_tiles(spark):
    streams = spark.createDataFrame([(1, 10000)], "video_id long, total_ms long")
    assert edges(iv.tiles(streams, 4000), "start_ms", "end_ms") == [(0, 4000), (4000, 8000), (8000, 10000)]


@pytest.mark.parametrize("tags,complete,runs", [([3, 3, 1, 3, 3, 1], [(3, 5)], [(0, 1), (3, 4)]), ([2, 3, 2, 3, 1], [(0, 2), (2, 4)], [(0, 1), (2, 3)]), ([2, 3], [], [(0, 1)])])
def test_automata(spark, tags, complete, runs):
    frame = spark.createDataFrame([(7, i, t) for i, t in enumerate(tags)], "stream_id long, frame int, tag int")
    assert edges(labels.complete_spans(frame), "start_frame", "end_frame") == complete
    assert edges(labels.signing_runs(frame), "start_frame", "end_frame") == runs


def test_copies(spark):
    cue = lambda k: f"one two three cue{k}"
    rows = [(1, [cue(k) for k in range(4)]), (2, [cue(0), cue(1), cue(2), *[f"quite another line {k}" for k in range(7)]])]
    frame = spark.createDataFrame(rows, "key long, cues array<string>")
    assert edges(dedup.duplicate_pairs(frame), "a", "b", "score") == [(1, 2, 0.75)]
    many = spark.createDataFrame([(i, [*rows[0][1], *[f"only in number {i} w{j}" for j in range(30)]]) for i in range(21)], "key long, cues array<string>")
    assert dedup.duplicate_pairs(many).count() == 0


def test_short_texts_have_no_shingles(spark):
    row = spark.range(1).select(tx.shingles(F.array(*[F.lit(str(k)) for k in range(5)]), 8).alias("s")).first()
    assert row.s == []


def test_clean_caption(spark):
    cases = {"&lt;i&gt;Hello&lt;/i&gt; there !": "Hello there!", "♪ la la ♪": "la la", "JOHN: [music] Yes": "Yes", "(Pfizer) a (soft) b": "(Pfizer) a (soft) b", "(gentle piano music) Hi": "Hi", "A&amp;lt;B": "A&lt;B"}
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in frame.select("t", tx.clean_caption(F.col("t"))).collect()} == cases


def test_bleu_of_equal_texts(spark):
    pairs = spark.createDataFrame([(1, list("abcde"), list("abcde")), (2, list("xyzw"), list("xyzw"))], "pair long, hyp array<string>, ref array<string>")
    row = textmetrics.corpus_bleu(pairs).first()
    assert row.bleu == 100 and (row.m1, row.m4) == (9, 3)


def test_gate_commits_after_stable_votes():
    gate = CommitGate(Config(delta=12, votes=3))
    for end in (100, 106, 112):
        gate.vote([(50, end)])
    assert gate.stable((50, 112))
    gate.vote([(50, 125)])
    assert not gate.stable((50, 125))
    gate.vote([])
    assert not gate.stable((50, 125))


def test_replay_equals_itself_by_stream(spark):
    tags = [1] * 4 + [2] + [3] * 8 + [1] * 10 + [2] + [3] * 5 + [1] * 12
    frame = spark.createDataFrame([(s, i, t) for s in (1, 2) for i, t in enumerate(tags)], "stream_id long, frame int, tag int").repartition(3)
    got = edges(replay(frame, Config(stride=2, delta=1, votes=3, cap=40)), "stream_id", "start_frame", "end_frame")
    assert got == [(s, a, b) for s in (1, 2) for a, b in ((4, 13), (23, 29))]


def test_clean_caption_brackets_entities_and_quotes(spark):
    cases = {
        "a (music video) b": "a (music video) b", "a (music b": "a (music b", "(♪♪♪) x (laughter) y": "x y", "caf&eacute; &#8217;s &#x41; &#150; &nosuch; &#0;": "café 's A - &nosuch; �",
        '"Hello there."': "Hello there.", "'It is.'": "It is.", "'cause students'": "'cause students'", 'He said "no."': 'He said "no.', "(AUDIENCE: applause)": "(AUDIENCE: applause)",
        "(" + "music " * 2000: "(" + "music " * 1999 + "music", "word (music) " * 20000: "word " * 19999 + "word",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in frame.select("t", tx.clean_caption(F.col("t"))).collect()}
    assert {k[:40]: v for k, v in got.items()} == {k[:40]: v for k, v in cases.items()}
    noise = spark.createDataFrame([("AUDIENCE: (APPLAUSE)",), ("[♪]",), ("(rock music)",), ("",), ("Hi",)], "t string")
    assert [r[0] for r in noise.select(tx.is_noise(F.col("t"))).collect()] == [True, True, False, True, False]


def test_gate_takes_the_nearest_free_history_and_retires_by_the_last_end():
    gate = CommitGate(Config(delta=12, votes=3))
    gate.vote([(0, 5), (20, 30)])
    gate.vote([(8, 12), (9, 31)])
    assert gate.histories == [[(0, 5), (8, 12)], [(20, 30), (9, 31)]]
    gate = CommitGate(Config(delta=5, votes=3))
    gate.vote([(10, 60)])
    gate.vote([(10, 38)])
    gate.retire((100, 40))
    assert gate.histories == []
