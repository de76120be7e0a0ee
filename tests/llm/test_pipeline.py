from pyspark.sql import functions as F

import corpus_pipeline as cp
from spanwright.llm import secret_linking as sl

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    docs, ids = raw, None
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = cp.written(stage(spark, docs, SF), "test")
        assert docs.columns == raw.columns, name
        ids = {r[0] for r in docs.select("doc_id").collect()}
        assert ids <= {r[0] for r in before.select("doc_id").collect()}
        if name == "n-gram Jaccard join":
            again = cp.set_relation_join.jaccard_components(docs)
            assert again.where("doc_id != component_id").count() == 0
        if name == "secret scans":
            left = sl.find_secrets(docs).agg(F.sum(F.expr("n_access + n_hex"))).first()[0]
            assert left == 0 and docs.count() == before.count()
            assert docs.where("n_chars != length(text)").count() == before.where("n_chars != length(text)").count()
        if name == "mixing sources to target weights":
            assert ids == {r[0] for r in before.select("doc_id").collect()} and docs.count() >= before.count()
    pieces = cp.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").collect()} == ids


CLASHING = (
    "doc_id long, text string, lang string, source string, n_chars long, found_id long, found_key long, found_spans string, mix_rate double, "
    "rate string, row string, own_id string, own_key int, set_digest string, gone_id int, digest int, score double, quality string, part int, "
    "component_id string, n_shingles string, col string, key string, n_tokens string, length string, start string, sequence_id string, bin string"
)


def odd_rows(spark):
    rest = (1, 2, "f", 0.5, "r", "w", "o", 3, "s", 4, 5, 0.1, "q", 6, "c", "n", "l", "k", "t", "le", "st", "se", "b")
    secret, long = "my token=abcdefgh1 here", "und der lange Text geht weiter " * 8000
    texts = [(None, None), (None, None), (None, secret), (1, ""), (1, ""), (2, secret), (2, secret), (2, "another text of the same id"), (3, long), (4, " \n ")]
    return spark.createDataFrame([(i, t, None if i is None else "de", "s", None if t is None else len(t), *rest) for i, t in texts], CLASHING)


def test_every_stage_takes_odd_rows(spark):
    docs = odd_rows(spark)
    for name, stage in cp.STAGES[:-1]:
        made = cp.written(stage(spark, docs, SF), "test")
        assert made.columns == docs.columns and made.dtypes == docs.dtypes, name
        rows = made.collect()
        assert all(tuple(r)[5:] == tuple(docs.first())[5:] for r in rows), name
        texts = sorted([(r.doc_id, r.text) for r in rows], key=str)
        before = sorted([(r.doc_id, r.text) for r in docs.collect()], key=str)
        if name == "quality classifier":
            assert set(texts) <= set(before)
        if name == "n-gram Jaccard join":
            # the row without an id equals the rows of id 2, of which one stays; texts without words all stay
            gone = [(2, "my token=abcdefgh1 here"), (None, "my token=abcdefgh1 here")]
            assert texts == sorted([x for k, x in enumerate(before) if x not in gone or (x == gone[0] and before.index(x) == k)], key=str)
        if name == "secret scans":
            assert texts == sorted([(i, t and t.replace("token=abcdefgh1", "[SECRET]")) for i, t in before], key=str)
        if name == "mixing sources to target weights":
            assert set(texts) == set(before) and len(texts) >= len(before)
    pieces = cp.pack(spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {None, 1, 2, 3, 4} and max(r.length for r in pieces) == 2048
    assert sum(r.piece == 0 for r in pieces) == docs.count()


def test_every_stage_takes_an_empty_table(spark):
    empty = odd_rows(spark).where("false")
    for name, stage in cp.STAGES:
        made = stage(spark, empty, SF)
        assert made.count() == 0 and (made.columns == empty.columns or name == "best-fit packing"), name
