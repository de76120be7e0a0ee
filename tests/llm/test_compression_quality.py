import random
import zlib

from spanwright.llm import compression_quality as cq


def rows(n=600):
    rng = random.Random(3)
    words = ["the", "river", "stone", "walked", "under", "morning", "light", "of", "a", "quiet", "house", "and"]
    for i in range(n):
        good = i % 4 != 0
        text = " ".join(rng.choice(words) for _ in range(80))
        yield i, text if good else text.upper().replace(" ", "!! "), int(good)


def test_held_out_rows_are_told_apart(spark):
    data = list(rows())
    docs = spark.createDataFrame([(i, t, "q", 0.5) for i, t, _ in data], "doc_id long, text string, score string, predicted double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = cq.fit(docs, labels)
    got = cq.classify(docs, model).toPandas().set_index("doc_id")
    assert list(got.columns) == ["held_out", "score", "predicted"]
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in data]
    assert got.held_out.tolist() == held
    right = [got.predicted[i] == q for (i, _, q), h in zip(data, held) if h]
    assert sum(right) >= 0.95 * len(right)
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (3, "ab " * 50000)], "doc_id long, text string")
    for labelled in ([], [(1, 1)], [(1, 1), (3, 0)], [(i, i % 2) for i in range(40)]):
        labels = spark.createDataFrame(labelled, "doc_id long, quality int")
        got = cq.classify(docs, cq.fit(docs, labels)).toPandas()
        assert len(got) == 4 and got.score.notna().all()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert cq.classify(empty, cq.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_held_out_labels_never_change_the_model(spark):
    data = list(rows(200))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in data]
    a = cq.fit(docs, spark.createDataFrame([(i, q) for i, _, q in data], "doc_id long, quality int"))
    b = cq.fit(docs, spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert a == b
