"""Rules of windows, tracks and text levels on cases made by hand; odd rows and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from spanwright.functions import levels
from spanwright.operators import captions, poses, tracks, windows
from spanwright.operators import intervals as iv
from spanwright.streaming import display

UNITS = "video_id long, idx long, start_ms long, end_ms long, reliable boolean, text string"


def test_runs(spark):
    rows = [
        (1, 0, 0, 100, True, "a"), (1, 1, 150, 200, True, "b"), (1, 2, 210, 400, True, None),  # the third makes the run too long
        (2, 0, 0, 100, True, "a"), (2, 1, 110, 160, False, "x"), (2, 2, 150, 300, True, "b"),  # a bad unit lies between
        (3, 0, 0, 100, True, "a"), (3, 1, 201, 300, True, "b"),  # the gap is too long
    ]
    units = spark.createDataFrame(rows, UNITS)
    got = sorted(tuple(r) for r in windows.join_runs(units, 100, 300, "|").collect())
    assert got == [(1, 0, 200, "a | b", 2), (1, 210, 400, "", 1), (2, 0, 100, "a", 1), (2, 150, 300, "b", 1), (3, 0, 100, "a", 1), (3, 201, 300, "b", 1)]
    assert windows.join_runs(units.where("video_id = 1"), 100, None, "|").count() == 1
    assert windows.join_runs(units.where("false"), 100, 300, "|").count() == 0


def test_stitched_windows_cover_each_frame_once(spark):
    lengths = [0, 1, 5, 8, 9, 12, 13, 40, 41]
    for size in (1, 2, 7, 8):
        got = windows.stitched_windows(spark.createDataFrame(list(enumerate(lengths)), "video_id long, n_frames long"), size).collect()
        for video, n in enumerate(lengths):
            mine = sorted((r for r in got if r.video_id == video), key=lambda r: r.write_from)
            assert [f for r in mine for f in range(r.write_from, r.write_to)] == list(range(n))
            assert all(r.first_frame <= r.write_from and r.write_to <= r.end_frame <= n and r.end_frame - r.first_frame == min(size, n) for r in mine)


def test_edge_reach_against_a_walk(spark):
    rng = random.Random(1)
    for _ in range(5):
        times = sorted(rng.sample(range(1000), rng.randint(1, 40)))
        lo, hi = min(2, len(times) - 1), max(len(times) - 3, 0)
        for _ in range(2):
            lo = max(i for i, t in enumerate(times) if t - times[lo] <= 60)
            hi = min(i for i, t in enumerate(times) if times[hi] - t <= 60)
        frame = spark.createDataFrame([(times,)], "times array<long>")
        assert tuple(frame.select(windows.edge_reach(F.col("times"), 2, 60, 2).alias("r")).first().r) == (lo, hi)


def test_bands():
    assert windows.band_frames(0.5, 24) == 12
    assert windows.band_radius_s(4, 2, 1.0, 24) == 10 / 24
    with pytest.raises(ValueError):
        windows.band_radius_s(24, 2, 1.0, 24)


def test_odd_texts(spark):
    text = F.col("text")
    rows = [("中文a 中 b",), ("",), (None,), ("a b c " * 4,), ("a b c " * 3 + "end",), ("I 'm: a， b…",)]
    frame = spark.createDataFrame(rows, "text string")
    single, every = levels.letters_alone(text)
    got = frame.select(levels.spaced_ideographs(text), levels.scored(text, F.lit(True), True), levels.loops(text), single, every, levels.join_units(text, "c")).collect()
    assert tuple(got[0][:2]) == ("中 文 a 中  b", "中 文 a 中 b")
    assert tuple(got[1]) == ("", "", False, 0, 0, "")
    assert got[2][0] is None and got[2][1] is None
    assert got[3][2] is True and got[4][2] is False
    assert got[3][5] == "a b a b a b a b" and got[3][3] == 12
    assert got[5][1] == "i ' m : a , b . . ."
    one = spark.createDataFrame([("word " * 100_000,)], "text string").select(levels.loops(text)).first()
    assert one[0] is True


def test_tracks(spark):
    rows = [(1, "1.en.vtt", False, False, 50), (1, "1.en-GB.vtt", False, False, 900), (1, "1.en-orig.vtt", False, False, 5000),
            (2, "2.en-orig.vtt", False, False, 10), (3, "3.en.vtt", True, False, 10), (4, "4.vtt", False, False, 1), (5, "5.b.vtt", False, False, 9), (5, "5.a.vtt", False, False, 9)]
    frame = spark.createDataFrame(rows, "video_id long, name string, word_timed boolean, flat boolean, n_chars long")
    best = lambda **more: {r.video_id: r.name for r in tracks.best_track(frame, [".en.vtt", ".en-GB.vtt"], [".en-orig.vtt"], **more).collect()}
    assert best() == {1: "1.en.vtt", 2: "2.en-orig.vtt", 5: "5.a.vtt"}
    assert 2 not in best(exclude_rejected=True)


def test_copy_check_is_enforced(spark):
    made = lambda split, copy: spark.createDataFrame([(split, "human", 1.0, 1, copy)], "split string, caption_source string, covered double, n_reliable long, copy_of string")
    status = lambda frame: tracks.drop_reasons(frame, ["test"], ["mt"], 0.5).first().status
    assert (status(made("train", "")), status(made("train", "9")), status(made("dev", None))) == ("kept", "copy", "kept")
    for split, copy in (("train", None), ("dev", "9")):
        with pytest.raises(Exception, match="copies|copy check"):
            status(made(split, copy))


def test_asof(spark):
    points = spark.createDataFrame([(1, 0, 10), (1, 1, 15), (1, 2, 0), (1, 3, 99), (2, 4, 5)], "video_id long, idx long, at_ms long")
    marks = spark.createDataFrame([(1, 7, 10), (1, 6, 10), (1, 8, 20)], "video_id long, idx long, at_ms long")
    assert {r.idx: r.mark for r in iv.asof_nearest(points, marks).collect()} == {0: 6, 1: 6, 2: 6, 3: 8, 4: None}
    segments = spark.createDataFrame([(1, 0, 10), (1, 15, 50)], "video_id long, seg_start long, seg_end long")
    assert {r.idx: r.seg_start for r in iv.holding_segment(points, segments).collect()} == {0: None, 1: 15, 2: 0, 3: None, 4: None}
    assert iv.asof_nearest(points.where("false"), marks).count() == 0


def test_folded_starts(spark):
    parts = ["Well it is", "BYE now", "New Zealand is", "I'm here", "Deaf people", "I", "", None, "- Well, I know"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(parts)], "id long, part string")
    words = spark.createDataFrame([("well",), ("bye",), ("new",), ("i'm",), ("well",)], "word string")
    got = {r.id: r.part for r in captions.fold_sentence_starts(frame, words).collect()}
    assert [got[i] for i in range(9)] == ["well it is", "BYE now", "New Zealand is", "I'm here", "Deaf people", "I", "", None, "- well, I know"]


def test_boundary_flips(spark):
    screens = ["a b", "a | b", "a | c", "x | y", "x | y | z", "x y"]
    frame = spark.createDataFrame([(1, i, s.split()) for i, s in enumerate(screens)] + [(2, 0, [])], "track long, seq long, tokens array<string>")
    # a separator comes, one side changes, both sides change, another comes, both go
    assert {r.track: r.n_flips for r in display.boundary_flips(frame, "|").collect()} == {1: 4, 2: 0}


def test_repeated_texts(spark):
    train = [(1, "the same four words"), (2, "boiler plate said often"), (3, "boiler plate said often"), (1, "too short")]
    units = [(9, "The same, four words!"), (9, "boiler plate said often"), (8, "too short"), (8, None)]
    make = lambda rows: spark.createDataFrame(rows, "video_id long, text string")
    assert {r.video_id: r.n for r in captions.repeated_texts(make(units), make(train), 4, 1).collect()} == {9: 1, 8: 0}


def test_frames_that_stay(spark):
    frames = spark.range(100).selectExpr("1L as stream_id", "id as frame", "array(struct(0.5d as x, 0.5d as y, 1.0d as c), struct(0.1d as x, 0.1d as y, 1.0d as c)) as kp")
    streams = spark.createDataFrame([(1, 100, 30.0)], "stream_id long, stored long, source_fps double")
    got = sorted((r.place, r.frame) for r in poses.thinned(frames, streams, 15.0).collect())
    assert [p for p, _ in got] == list(range(50)) and got[0][1] == 0 and got[-1][1] == 99
    assert poses.thinned(frames, streams, 29.0).count() == 100
    left = [r.frame for r in poses.drop_frames(frames, 0.9, 3).collect()]
    assert {0, 99} <= set(left) and 10 <= len(left) < 100
    assert sorted(left) == sorted(r.frame for r in poses.drop_frames(frames.repartition(7), 0.9, 3).collect())
    assert {r.kp[1].c for r in poses.drop_parts(frames, [[1]], 1.0, 3).collect()} == {0.0}
