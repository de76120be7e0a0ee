"""Hand-made cases of sentence grouping, text metrics, tracks, caps and sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanwright.operators import captions, poses, textmetrics
from spanwright.sources import sinks
from spanwright.streaming import display
from spanwright.streaming.commit_gate import Config, Machine

CUE = "video_id long, idx long, start_ms long, end_ms long, text string"


def grouped(spark, *cues, pause=500):
    rows = [(1, i, a, b, t) for i, (a, b, t) in enumerate(cues)]
    found = captions.group_sentences(spark.createDataFrame(rows, CUE), 8000, pause)
    return sorted((r.start_ms, r.end_ms, r.text) for r in found.collect())


def test_sentences_run_over_cues(spark):
    got = grouped(spark, (0, 1000, "We saw that"), (1100, 2000, "it went well. They left."), (2100, 3000, "Then more."))
    assert got == [(0, 2000, "We saw that it went well, They left."), (2100, 3000, "Then more.")]


def test_a_pause_a_gap_and_a_missing_stop_part(spark):
    assert len(grouped(spark, (0, 1000, "We saw that"), (3000, 4000, "They went home."))) == 2
    assert len(grouped(spark, (0, 1000, "We saw that"), (3000, 4000, "it was done."))) == 1
    assert len(grouped(spark, (0, 1000, "We saw that"), (9500, 10_000, "it was done."))) == 2
    assert len(grouped(spark, (0, 1000, "we saw that"), (1100, 2000, "It was done"))) == 2
    assert len(grouped(spark, (0, 1000, "we met Dr."), (1100, 2000, "Evans there."))) == 1
    assert grouped(spark, (0, 1000, None)) == [(0, 1000, "")]


def test_rouge_against_table(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for i in range(60)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
        return row[-1]

    frame = spark.createDataFrame(rows, "pair long, hyp array<string>, ref array<string>")
    got = {r.pair: r.rouge_l for r in textmetrics.rouge_l(frame).collect()}
    for i, a, b in rows:
        n = lcs(a, b)
        assert got[i] == pytest.approx(2 * n / (len(a) + len(b)) if n else 0.0)


def test_tracks(spark):
    schema = "stream_id long, seq long, at_ms long, track_id long, start_frame long, delta_frames long, committed boolean, open_span boolean"
    rows = [
        (1, 0, 1000, None, 10, 3, False, True),  # open, later closed as track 7
        (1, 1, 2000, 7, 11, 3, False, False),
        (1, 2, 2500, None, 30, 3, False, True),  # never closed
        (1, 3, 3000, 7, 11, 3, True, False),
        (1, 4, 4000, 7, 40, 3, False, False),  # the id begins anew after its commit
        (1, 5, 5000, None, 31, 3, False, True),
        (1, 6, 6000, None, 50, 3, True, False),  # no id: on its own
    ]
    got = display.group_tracks(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert [r.track for r in got] == [0, 0, 1, 0, 2, 1, 3]


def test_policies_are_25(spark):
    hyps = [(1, 0, 0, ["a"], [0.9], False), (1, 1, 1000, ["a", "b"], [0.9, 0.4], False), (1, 2, 2000, ["a", "c"], [0.9, 0.9], True)]
    frame = spark.createDataFrame(hyps, "track long, seq long, at_ms long, tokens array<string>, conf array<double>, committed boolean")
    screens = display.replay(frame).cache()
    assert {r.policy for r in screens.select("policy").distinct().collect()} == set(display.policy_names())
    assert len(display.policy_names()) == 25
    shown = lambda p: [r.shown for r in screens.where(F.col("policy") == p).orderBy("seq").collect()]
    assert shown("commit_only") == [0, 0, 2]
    assert shown("agreement_n2") == shown("frozen_agreement_n2") == [0, 1, 2]
    assert shown("confidence_n1_tau50") == [1, 1, 2]
    assert shown("mask_k0") == [1, 2, 2]
    scores = {r.policy: r for r in display.track_scores(screens).collect()}
    assert (scores["mask_k0"].n_erased, scores["commit_only"].n_erased) == (1, 0)
    assert scores["mask_k0"].latency_s == -2.0 and scores["mask_k0"].prefix_error == 0.5


def run(config, tags, inside=None):
    machine, out = Machine(config), []
    for k, tag in enumerate(tags):
        out += machine.push(tag, None if inside is None else inside[k])
    return out + machine.end()


def test_full_buffer_cuts_where_it_looks_least_inside():
    config = Config(stride=2, delta=1, votes=2, cap=12)
    inside = [1.0] * 30
    inside[8] = 0.2
    cut, *rest = run(config, [2] + [3] * 29, inside)
    assert cut == (0, 8, 12, False, True)
    assert not rest  # the rest of the cut unit has no certified start


def test_full_buffer_keeps_a_late_open_span_once():
    config = Config(stride=2, delta=1, votes=2, cap=12)
    assert run(config, [1] * 8 + [2] + [3] * 7 + [1] * 6) == [(8, 16, 19, True, False)]


def test_abutting_units_open_at_the_terminator():
    config = Config(stride=2, delta=1, votes=2, cap=40)
    got = run(config, [1, 2, 3, 3, 2, 3, 3, 1, 1, 1, 1, 1])
    assert [r[:2] for r in got] == [(1, 4), (4, 7)]


def test_sidecar_round_trip(spark, tmp_path):
    schema = "video_id string, duration_s double, width int, height int, caption_source string, undetected_ratio double, "
    schema += ", ".join(f"{c} {sinks.RUNS}" for c in sinks.RUN_COLUMNS) + ", copy_of array<string>, unreliable_spans array<struct<a:double,b:double>>"
    rows = [("b", 2.5, 640, None, 'hand "made", twice', 0.1, [(1, 5)], [], None, None, ["a", "0.9"], [(0.5, 1.25)]), ("a", 1.0, None, None, None, None, None, None, None, None, [], None)]
    frame = spark.createDataFrame(rows, schema)
    sinks.write_sidecar(frame, str(tmp_path / "s"))
    back = sinks.read_sidecar(spark, str(tmp_path / "s"))
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))


def test_upsert_blanks_what_depends_on_it(spark):
    old = spark.createDataFrame([(1, "x", "seen"), (2, "y", "seen")], "id long, a string, b string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id long, a string")
    assert sorted(map(tuple, sinks.upsert(old, new, "id", ["b"]).collect()), key=str) == [(1, "x", "seen"), (2, "z", None), (3, "w", None)]


def test_report_and_scores(spark, tmp_path):
    rows = [("s", "main", "f1", 0.5), ("s", "main", "recall", 0.25), ("s", "frame", "f1", 1.0)]
    frame = spark.createDataFrame(rows, "system string, block string, metric string, value double")
    sinks.write_scores(frame, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"system": "s", "scores": {"frame": {"f1": 1.0}, "main": {"f1": 0.5, "recall": 0.25}}}
    sinks.write_report(frame.where("block = 'main'"), str(tmp_path / "c"), ["system"], "metric", "value", ["f1", "recall"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == [("s", "0.5", "0.25")]


def test_runs_and_grid(spark):
    flags = spark.createDataFrame([(1, f, f in (2, 3, 5, 9)) for f in range(12)], "stream_id long, frame long, flag boolean")
    assert sorted(tuple(r)[1:] for r in poses.flag_runs(flags, 2, 2).collect()) == [(2, 6)]
    length = poses.grid_length(F.lit(10), F.lit(24.0), F.lit(30.0))
    row = spark.range(1).select(length.alias("n"), poses.seconds_to_frames(F.lit(0.5), F.lit(24.0)).alias("f")).first()
    assert (row.n, row.f) == (8, 12)
