"""Linear models over hashed words, shared by the text classifiers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwright.llm.common import held_out

BITS = 20
WORD = re.compile(r"[^\W_]+")


def hashed_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words of a whole text, and how often each occurs."""
    import xxhash

    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    h = np.fromiter((xxhash.xxh32_intdigest(w.encode("utf-8", "replace")) >> (32 - BITS) for w in counts), np.int32, len(counts))
    ids, place = np.unique(h, return_inverse=True)
    return ids, np.bincount(place, np.fromiter(counts.values(), float, len(counts))).astype(np.int64)


def labelled_sample(documents: DataFrame, labelled: DataFrame, strata: list[str], rows_per_stratum: int) -> tuple[pd.DataFrame, dict]:
    """Hashed words of at most ``rows_per_stratum`` labelled rows of each stratum, and each stratum's size.

    ``labelled`` has doc_id and the strata.  Held-out ids are never used; of equal ids with different labels the largest labels
    count.  The rows with the smallest hash of their id are taken, so the sample is the same at every run.
    """
    marked = (
        labelled.select("doc_id", *strata)
        .where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .dropna(subset=strata)
        .groupBy("doc_id")
        .agg(*[F.max(s).alias(s) for s in strata])
    )
    counted = marked.groupBy(*strata).agg(F.count("*").alias("stratum_rows"))
    sizes = {tuple(r[:-1]): r[-1] for r in counted.collect()}
    columns = ["doc_id", *strata, "ids", "counts"]
    if not sizes:
        return pd.DataFrame(columns=columns), sizes
    # the least hashes of a stratum lie under this bound, so the window ranks little more than what is taken
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    near = share * F.col("stratum_rows") <= 1.25 * rows_per_stratum + 60
    order = Window.partitionBy(*strata).orderBy(share, "doc_id")
    kept = marked.join(F.broadcast(counted), strata).where(near).withColumn("place", F.row_number().over(order))
    picked = kept.where(F.col("place") <= rows_per_stratum).select("doc_id", *strata)

    def words(batches):
        for frame in batches:
            made = [hashed_words(t) for t in frame["text"]]
            out = frame.drop(columns="text")
            out["ids"], out["counts"] = [m[0] for m in made], [m[1] for m in made]
            yield out

    kinds = dict(marked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["doc_id", *strata]) + ", ids array<int>, counts array<long>"
    # at most rows_per_stratum rows of each stratum, which the caller gathers on the driver anyway
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", *strata, "text")
    return rows.mapInPandas(words, schema).toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True), sizes


def select_features(ids: list[np.ndarray], y: np.ndarray, weight: np.ndarray, most: int, least_rows: int = 3) -> np.ndarray:
    """The words whose presence tells the classes apart best, by the chi-square of their two-by-two table."""
    size = 1 << BITS
    lengths = [len(x) for x in ids]
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    w, wy = np.repeat(weight, lengths), np.repeat(weight * y, lengths)
    seen = np.bincount(flat, minlength=size)
    n1, n = np.bincount(flat, wy, size), np.bincount(flat, w, size)
    total, positive = weight.sum(), (weight * y).sum()
    expected = n * positive / max(total, 1e-9)
    chi = (n1 - expected) ** 2 / np.maximum(expected * (1 - positive / max(total, 1e-9)), 1e-9)
    chi[seen < least_rows] = 0
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(best[chi[best] > 0])


def dense(ids: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    """Presence of each feature in each row."""
    out = np.zeros((len(ids), len(features)), np.float32)
    for k, row in enumerate(ids):
        out[k, np.searchsorted(features, np.intersect1d(row, features))] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by accelerated gradient steps on standardised columns."""
    x = x.astype(np.float64)
    scale = np.maximum(x.std(axis=0), 0.05)
    z = x / scale
    weight = weight / weight.sum()
    beta, prior = np.zeros(x.shape[1] + 1), np.clip((weight * y).sum(), 1e-4, 1 - 1e-4)
    beta[-1] = np.log(prior / (1 - prior))
    # the largest eigenvalue of the weighted second moments bounds the curvature
    v = np.ones(x.shape[1] + 1)
    for _ in range(20):
        p = z @ v[:-1] + v[-1]
        v = np.append(z.T @ (weight * p), (weight * p).sum())
        v /= np.linalg.norm(v) or 1.0
    p = z @ v[:-1] + v[-1]
    rate = 1 / (0.25 * (weight * p * p).sum() / max((v * v).sum(), 1e-12) * 1.1 + ridge / len(y) + 1e-9)
    look, momentum = beta.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ look[:-1] + look[-1], -40, 40)))
        e = weight * (p - y)
        gradient = np.append(z.T @ e + ridge / len(y) * look[:-1], e.sum())
        new = look - rate * gradient
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / grown * (new - beta)
        beta, momentum = new, grown
    return beta[:-1] / scale, float(beta[-1])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
