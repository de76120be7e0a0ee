import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanwright.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER, MEMORY = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH, cached_words=50)


def plain_ids(texts):
    made = TOKENIZER.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.asarray(e.ids + [0], "<u4") for e in made]


#: Letters that NFC takes apart, or that marks follow, before marks of their own.
DECOMPOSING = [
    "হয়, হয়. য়!? ড়.", "कक़, फ़. ख़ग़,", "\u0958, \u095f. \u09dc, \u09df.", "གྷ, \u0f43. \u0f4d,", "\ufb1d, \ufb2a. \ufb4e,", "\u0344, é, e\u0301. a\u0338,",
    "เก่า, ที่.", "i\u0307, I\u0307. \u0130, x\u0130.", "word,&&& don't, 's, it's. a's,b 'll. x_y, _a, a1, 1, a²,", "\u00a0, a\u00a0b, \u2003. a\u200d,", "\x00, a\x1f, \x7f. a\x85, ~~ ``,",
]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_word_memory_gives_the_tokenizers_ids(texts):
    texts = texts + ["It's THE end. ", "é É x", "a<|endoftext|>b", "İİ KK,don't.", "..", "a.b,c.", "", "Größe, naïve. straße ŁÓDŹ øre ǅ ª º µ ﬁ", "ſ ß", *DECOMPOSING]
    for _ in range(2):
        assert [m + packing.END_ID for m in MEMORY.encode(texts)] == [p.tobytes() for p in plain_ids(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], max_codepoint=0x1FFF), min_size=1, max_size=4), max_size=8), st.sampled_from([".", ",", "!?", "'", "&&&"]))
def test_words_before_marks(words, marks):
    text = " ".join(w + marks for w in words)
    assert [m + packing.END_ID for m in MEMORY.encode([text])] == [p.tobytes() for p in plain_ids([text])]


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=100, deadline=None)
def test_best_fit_fills_without_overlap(lengths):
    lengths = np.asarray(lengths, np.int64)
    bins, offsets, fill = packing.best_fit(lengths, 64)
    assert all(f <= 64 for f in fill) and sum(fill) == lengths.sum()
    for b in range(len(fill)):
        inside = sorted(zip(offsets[bins == b], lengths[bins == b]))
        at = 0
        for o, n in inside:
            assert o == at
            at += n


@pytest.mark.parametrize("partitions", [1, 20])
def test_round_trip(spark, partitions):
    texts = [None, "", "one two", "one two", "word " * 5000, "x", "a, b. c"] + [f"t{i} " * (i % 400) for i in range(300)]
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, bin string, offset int")
    rows = packing.pack(docs.repartition(partitions), PATH).toPandas()
    ids = plain_ids(texts)
    assert rows.length.sum() == sum(map(len, ids))
    for r in rows.itertuples():
        mine = ids[int(r.doc_id) if r.doc_id == r.doc_id and r.doc_id is not None else 0]
        part = mine[r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == r.piece * 2048
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.to_numpy() == np.concatenate([[0], seq.length.cumsum()[:-1]])).all() and seq.length.sum() <= 2048
    least = -(-rows.length.sum() // 2048)
    assert rows.sequence_id.nunique() <= 1.12 * least + 1


def test_levels_go_on_beyond_one_node(spark, monkeypatch):
    docs = spark.range(1200).selectExpr("id as doc_id", "repeat('word ', 30 + cast(id % 67 as int)) as text").repartition(12)
    whole = packing.pack(docs, PATH).select("sequence_id").distinct().count()
    monkeypatch.setattr(packing, "NODE_ITEMS", 5)
    rows = packing.pack(docs, PATH).toPandas()
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.to_numpy() == np.concatenate([[0], seq.length.cumsum()[:-1]])).all() and seq.length.sum() <= 2048
    assert len(rows) == 1200 and rows.sequence_id.nunique() <= 1.1 * whole + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0
