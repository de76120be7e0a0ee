import random
import zlib

import numpy as np

from spanwright.llm import toxicity_chain as tc


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        junk, bad = rng.random() < 0.2, rng.random() < 0.25
        text = [rng.choice(words) for _ in range(60)]
        if junk:
            text += ["BUY", "now", "CHEAP"]
        if bad:
            text += rng.sample(["vile", "Nasty!", "rotten,", "foul"], 2)
        severe = bad and junk
        rows.append((i, " ".join(text), int(junk), int(bad), int(severe)))
    return rows


def test_chain_on_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(r[0], r[1], 9, "z") for r in rows], "doc_id long, text string, p_toxic int, ids string")
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows] + [(None, 1, 1, 1), (3, None, 1, 0)], "doc_id long, low_quality int, toxic int, severe int")
    chain = ["low_quality", "toxic", "severe"]
    links = tc.fit(docs, labels, chain)
    assert [len(link.earlier) for link in links] == [0, 1, 2]
    assert links[2].earlier.min() > 0  # both earlier categories speak for the last
    got = tc.flag(tc.score(docs, links), "severe").toPandas().set_index("doc_id")
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    for k, category in enumerate(chain):
        p = got.loc[[r[0] for r in held], f"p_{category}"].to_numpy()
        assert np.mean((p >= 0.5) == np.array([r[2 + k] for r in held])) > 0.95, category
    assert (got.predicted == (got.score >= 0.5)).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "vile"), (3, "x " * 60000)], "doc_id long, text string")
    for labelled in ([], [(1, 1)], [(3, 0), (1, 1)], [(i, i % 2) for i in range(30)]):
        links = tc.fit(docs, spark.createDataFrame(labelled, "doc_id long, toxic int"), ["toxic"])
        got = tc.flag(tc.score(docs, links), "toxic").toPandas()
        assert len(got) == 4 and got.score.between(0, 1).all()
    assert tc.score(spark.createDataFrame([], "doc_id long, text string"), links).count() == 0
