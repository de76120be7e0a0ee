import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spanwright.llm import soft_mixing as sm


def corpus(n=800):
    rng = random.Random(1)
    words = {d: [f"{d}{i}" for i in range(60)] for d in ("en", "de", "fr")}
    rows = []
    for i in range(n):
        d = rng.choices(["en", "de", "fr"], [0.7, 0.2, 0.1])[0]
        other = rng.choice(["en", "de", "fr"])
        rows.append((i, " ".join(rng.choice(words[d if rng.random() < 0.9 else other]) for _ in range(rng.randint(20, 90))), d))
    return rows


def test_targets_are_met(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 3, "k") for r in rows], "doc_id long, text string, domain string, n_tokens int, key string")
    model = sm.fit_domains(docs, docs.select("doc_id", "domain"))
    want = {"en": 0.5, "de": 0.3, "fr": 0.2}
    mixed, mixture = sm.mix(docs, model, want)
    got = mixed.toPandas()
    truth = pd.Series({r[0]: r[2] for r in rows})
    assert (got.set_index("doc_id").domain.reindex(truth.index) == truth).mean() > 0.97
    mass = np.array(got.posteriors.tolist()) * (got.rate * got.n_tokens).to_numpy()[:, None]
    assert np.abs(mass.sum(0) / got.n_tokens.sum() - [want[d] for d in model.domains]).max() < 1e-3
    assert (got.rate >= 0).all() and abs(got.copies.sum() / got.rate.sum() - 1) < 0.05


def test_steps_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    tokens = rng.integers(1, 100, 200)
    goal = np.array([0.9, 0.1, 0.0]) * tokens.sum()
    members = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tokens, p)], "n_tokens long, p0 double, p1 double, p2 double")
    mixture = sm.fit_rates(members, ("a", "b", "c"), goal, steps=25)
    total = tokens.sum()
    pace = 1 / np.linalg.eigvalsh((p * tokens[:, None]).T @ p / total)[-1]
    r = np.ones(200)
    for _ in range(len(mixture.residuals)):
        r = np.maximum(0, r - pace * (p @ ((r * tokens) @ p - goal)) / total)
    mine = members.toPandas().assign(r=[x[0] for x in members.select(mixture.rate()).collect()])
    assert np.abs(mine.r - r).max() < 1e-9 and (r == 0).any()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en"), (1, None, "en"), (None, "a b", None), (4, "x " * 50000, "de")], "doc_id long, text string, domain string")
    for labelled in (docs, docs.where("false")):
        model = sm.fit_domains(docs, labelled.select("doc_id", "domain"))
        mixed, _ = sm.mix(docs, model)
        assert mixed.count() == 4 and mixed.where(F.col("rate") < 0).count() == 0
    assert sm.mix(docs.where("false"), model)[0].count() == 0
