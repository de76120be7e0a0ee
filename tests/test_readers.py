import json

import pytest

from spanwright.operators.captions import merge_rolling
from spanwright.sources import readers as rd

VTT = """WEBVTT

00:00:01.000 --> 00:00:02,500 align:start
<i>Hello</i> there
 friend !

2
00:00:02.000 --> 00:00:05.000
Hello there friend! And more

00:00:09.000 --> 00:00:08.000
backwards

01:00:00.000 --> 01:00:01.000
[music]

note without time
"""


def test_vtt(spark, tmp_path):
    (tmp_path / "v1.en.vtt").write_text(VTT)
    cues = rd.read_vtt(spark, str(tmp_path))
    got = sorted((r.video_id, r.start_ms, r.end_ms, r.text) for r in cues.collect())
    assert got == [("v1", 1000, 2500, "Hello there friend!"), ("v1", 2000, 5000, "Hello there friend! And more")]
    merged = merge_rolling(cues).collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in merged] == [(1000, 5000, "Hello there friend! And more")]


def test_rolling_ties_take_the_new_text_and_gaps_part(spark):
    rows = [("a", 0, 1000, 5000, "HELLO WORLD"), ("a", 1, 4000, 8000, "HELLO WORLD"), ("a", 2, 8000, 9000, "HELLO WORLD")]
    frame = spark.createDataFrame(rows, "video_id string, idx long, start_ms long, end_ms long, text string")
    assert sorted((r.start_ms, r.end_ms) for r in merge_rolling(frame).collect()) == [(1000, 8000), (8000, 9000)]


def test_splits(spark, tmp_path):
    (tmp_path / "s.csv").write_text("youtube_id,subset\na,Train\nb,val\na,test\nc,other\n,train\n")
    assert sorted(map(tuple, rd.read_splits(spark, str(tmp_path / "s.csv")).collect())) == [("a", "test"), ("b", "dev")]


def test_events(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"events": {"v": [{"start_s": 1, "end_s": 2}, {"start_s": 3.5, "end_s": 4, "text": ""}], "w": []}}, indent=1))
    got = rd.read_events(spark, str(tmp_path / "e.json"))
    assert sorted((r.video_id, r.idx, r.start_s, r.text, r.cap_cut) for r in got.collect()) == [("v", 0, 1.0, None, False), ("v", 1, 3.5, "", False)]
    rd.write_events(got, str(tmp_path / "out"), {"decode": "argmax"}, parts=3)
    again = rd.read_events(spark, str(tmp_path / "out"))
    assert again.dtypes == got.dtypes and sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="no events"):
        rd.read_events(spark, str(tmp_path / "bad.json")).collect()
