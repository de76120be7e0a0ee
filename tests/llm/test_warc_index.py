import base64
import glob
import gzip
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from spanwright.llm import warc_index as wi

PAGES = [
    (3, "http://b.example.com/x?q=1#frag", "<p>é\r\n\r\nWARC/1.1</p>"),
    (1, "https://a.example.com:443/", "same"),
    (2, "https://a.example.com/", "same"),
    (9, None, None),
    (8, "http://z.org", ""),
    (None, "http://b.example.com/x?q=1", "same"),
    (None, "bad url\r\nWARC-Type: x", "alone"),
    (5, "http://a.example.com/", "long " * 40000),
    (5, "http://a.example.com/", "long " * 40000),
]


def index(spark, tmp_path, pages):
    frame = spark.createDataFrame([(*p, "d", 1) for p in pages], "page_id long, url string, html string, digest string, size int")
    path = str(tmp_path / "archives")
    wi.write_archives(frame.repartition(3), path)
    return path, wi.merge_index(spark, path).toPandas().sort_values(["merge_range", "merge_pos"])


def test_round_trip(spark, tmp_path):
    path, got = index(spark, tmp_path, PAGES)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        firsts = [p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None]
        revisit = firsts and min(firsts) != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", min(firsts) if revisit else None))
    none = lambda x: None if x is None or x != x else int(x)
    rows = [(none(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, none(r.refers_to)) for r in got.itertuples()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    keys = list(zip(got.url_key, got.captured))
    assert keys == sorted(keys) and "com,example,a)/" in set(got.url_key)
    for name in glob.glob(f"{path}/*.gz"):
        assert all(h["WARC-Type"] for *_, h, _ in wi.parse_archive(gzip.open(name).read()))


def test_many_ranges_keep_one_global_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wi, "RANGE_ROWS", 50)
    monkeypatch.setattr(wi, "RECORDS_PER_FILE", 40)
    rng = random.Random(1)
    pages = [(i, f"http://{'hot' if i % 3 else 'h' + str(rng.randint(0, 20))}.example.com/", f"p{i}") for i in range(600)]
    _, got = index(spark, tmp_path, pages)
    keys = list(zip(got.url_key, got.captured, got.page_id))
    assert len(keys) == 600 and keys == sorted(keys) and got.merge_range.nunique() > 5
    assert got.groupby("merge_range").size().max() <= 150
    assert got.capture_rank.tolist() == list(range(600))


def test_empty_table(spark, tmp_path):
    _, got = index(spark, tmp_path, [])
    assert len(got) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(wi.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)
