"""Toxicity by a classifier chain: each category's linear model sees the probabilities of the categories before it.

The model of a category reads the presence of its ``features`` words and, for every earlier category of the chain, the
logit of its probability.  In training these probabilities are out-of-fold: the rows are dealt into ``FOLDS`` folds by
hash, and a row's probability comes from a model that has not seen its fold; probabilities of the model's own
training rows would be too sure, and later models would trust them too much.  In scoring, the models fitted on all
sampled rows run in the order of the chain.

The fit reads at most ``rows_per_stratum`` labelled rows of each combination of labels, weighted back to their
shares.  Scoring reads whole texts.

Defined results: a null text has no words and scores by the intercepts.  Null labels are left out; of several labels of one
id the largest counts.  A category with one class only has a constant probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import held_out
from spanwright.llm.linear_text import dense, hashed_words, labelled_sample, logistic, select_features, sigmoid

FOLDS = 4
FEATURES = 400
THRESHOLD = 0.5


@dataclass(frozen=True)
class Link:
    """One category: word weights, one weight for each earlier category's logit, and the intercept."""

    category: str
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit_link(ids, y, weight, before: np.ndarray, features: int) -> tuple:
    if len(set(y.tolist())) < 2:
        share = (float((weight * y).sum()) + 0.5) / (float(weight.sum()) + 1)
        return np.empty(0, np.int64), np.empty(0), np.zeros(before.shape[1]), float(_logit(np.array([share]))[0])
    words = select_features(ids, y, weight, features)
    x = np.column_stack([dense(ids, words), before]) if before.shape[1] else dense(ids, words)
    if not x.shape[1]:
        return words, np.empty(0), np.zeros(0), float(_logit(np.array([(weight * y).sum() / weight.sum()]))[0])
    beta, intercept = logistic(x, y, weight)
    return words, beta[: len(words)], beta[len(words) :], intercept


def _apply(link: tuple, ids, before: np.ndarray) -> np.ndarray:
    words, weights, earlier, intercept = link
    z = np.full(len(ids), intercept)
    if len(words):
        z = z + dense(ids, words) @ weights
    if before.shape[1]:
        z = z + before @ earlier
    return sigmoid(z)


def fit(
    documents: DataFrame, labels: DataFrame, chain: list[str], rows_per_stratum: int = 1500, features: int = FEATURES
) -> list[Link]:
    """``labels`` has doc_id and a 0/1 column for each category of the chain."""
    import xxhash

    sample, sizes = labelled_sample(documents, labels, chain, rows_per_stratum)
    if not len(sample):
        return [Link(c, np.empty(0, np.int64), np.empty(0), np.zeros(k), 0.0) for k, c in enumerate(chain)]
    ids = [np.asarray(x, np.int64) for x in sample["ids"]]
    strata = [tuple(int(v) for v in row) for row in sample[chain].itertuples(index=False)]
    taken = {s: strata.count(s) for s in set(strata)}
    weight = np.array([sizes[s] / taken[s] for s in strata], float)
    fold = np.array([xxhash.xxh32_intdigest(str(i).encode()) % FOLDS for i in sample["doc_id"]])
    before = np.empty((len(ids), 0))
    out = []
    for k, category in enumerate(chain):
        y = sample[category].to_numpy(float)
        whole = _fit_link(ids, y, weight, before, features)
        out.append(Link(category, whole[0], whole[1], whole[2], whole[3]))
        if k + 1 == len(chain):
            break
        unseen = np.empty(len(ids))
        for f in range(FOLDS):
            inside = np.flatnonzero(fold == f)
            rest = np.flatnonzero(fold != f)
            if not len(inside):
                continue
            link = _fit_link([ids[i] for i in rest], y[rest], weight[rest], before[rest], features) if len(rest) else whole
            unseen[inside] = _apply(link, [ids[i] for i in inside], before[inside])
        before = np.column_stack([before, _logit(unseen)])
    return out


def score(documents: DataFrame, links: list[Link]) -> DataFrame:
    """doc_id and p_<category> of every row, by whole texts."""

    def run(batches):
        tables = []
        for link in links:
            tables.append(dict(zip(link.words.tolist(), link.weights.tolist(), strict=True)))
        for frame in batches:
            words = [hashed_words(t)[0].tolist() for t in frame["text"]]
            before = np.empty((len(words), 0))
            out = {"doc_id": pd.array(frame["doc_id"], dtype="Int64")}
            for link, known in zip(links, tables, strict=True):
                z = np.array([sum(known[w] for w in row if w in known) for row in words], float) + link.intercept
                if before.shape[1]:
                    z = z + before @ link.earlier
                p = sigmoid(z)
                out[f"p_{link.category}"] = p
                before = np.column_stack([before, _logit(p)])
            yield pd.DataFrame(out)

    kind = "doc_id long, " + ", ".join(f"p_{link.category} double" for link in links)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, kind)


def flag(scored: DataFrame, category: str, threshold: float = THRESHOLD) -> DataFrame:
    """The scores with held_out, the last category's probability as ``score``, and the verdict."""
    p = F.col(f"p_{category}")
    return scored.withColumns(
        {"held_out": held_out("doc_id"), "score": p, "predicted": (p >= threshold).cast("int"), category: p >= threshold}
    )
