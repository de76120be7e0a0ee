"""Quality classifier: zstandard dictionaries of good and of bad text, compared by compressed size.

Two dictionaries are trained, one on labelled good text and one on labelled bad text.  A text is cut into blocks
of ``BLOCK`` bytes and every block is compressed with either dictionary, so all of a long text counts, not
only the part for which a dictionary's content is still in the window.  The feature is

    (bytes with the bad dictionary - bytes with the good one) / bytes of the text

and a logistic curve fitted on labelled rows that no dictionary has seen turns it into a probability.

The fit reads a bounded sample: at most ``dictionary_rows`` and ``calibration_rows`` labelled rows of each class,
those with the smallest hash of their id.  Of these rows, as of those scored, the whole text counts.

Defined results: a null text scores as an empty one, whose feature is 0.  Labels that are null are left out; an id with
both labels counts as bad.  Without labelled rows of both classes the score is the share of good
labels (0.5 without any).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import held_out

BLOCK = 1024
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def probability(self, feature: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * feature + self.intercept, -40, 40)))


def _compressors(good: bytes, bad: bytes):
    import zstandard

    made = []
    for content in (good, bad):
        words = zstandard.ZstdCompressionDict(content)
        words.precompute_compress(level=LEVEL)
        made.append(
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        )
    return made


def _size_difference(raw: bytes, with_good, with_bad) -> float:
    difference = 0
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK]
        difference += len(with_bad.compress(block)) - len(with_good.compress(block))
    return difference / len(raw) if raw else 0.0


def feature_column(text: Column, good: bytes, bad: bytes) -> Column:
    """The normalised size difference of each whole text."""

    @F.pandas_udf("double")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with_good, with_bad = _compressors(good, bad)
        for texts in batches:
            yield pd.Series(
                [_size_difference((t or "").encode("utf-8", "replace"), with_good, with_bad) for t in texts], dtype="float64"
            )

    return sizes(text)


def _sampled_blocks(labelled: DataFrame) -> list[bytes]:
    def blocks(batches):
        for frame in batches:
            out = []
            for text in frame["text"]:
                raw = (text or "").encode("utf-8", "replace")
                out += [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
            yield pd.DataFrame({"block": out})

    return sorted(bytes(r[0]) for r in labelled.select("text").mapInPandas(blocks, "block binary").collect())


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted one-feature logistic regression by Newton steps, with a slight ridge on the slope."""
    centre, scale = float(np.average(x, weights=weight)), float(np.sqrt(np.cov(x, aweights=weight)) or 1.0)
    z = np.column_stack([(x - centre) / scale, np.ones_like(x)])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        gradient = z.T @ (weight * (y - p)) - np.array([1e-3, 0]) * beta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta[0] / scale, beta[1] - beta[0] * centre / scale


def fit(
    documents: DataFrame,
    labels: DataFrame,
    dictionary_rows: int = 1500,
    calibration_rows: int = 2500,
    dictionary_bytes: int = 64 << 10,
) -> CompressionModel:
    """Train on rows whose id is not held out; ``labels`` has doc_id and quality (1 good, 0 bad)."""
    import zstandard

    marked = (
        labels.select("doc_id", "quality")
        .where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    counts = {int(r[0]): r[1] for r in marked.groupBy("quality").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        p = (good + 1) / (good + bad + 2)
        return CompressionModel(b"", b"", 0.0, math.log(p / (1 - p)))
    parts = {}
    for quality in (0, 1):
        ranked = marked.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = [r[0] for r in ranked.select("doc_id").limit(dictionary_rows + calibration_rows).collect()]
        # a small class is shared out, so that neither part is empty
        cut = min(dictionary_rows, max(1, (len(ids) * 3) // 8))
        parts[quality] = (ids[:cut], ids[cut:] or ids)
    spark = documents.sparkSession
    picked = spark.createDataFrame(
        [(int(i), q, part) for q, both in parts.items() for part, ids in enumerate(both) for i in ids],
        "doc_id long, quality int, part int",
    )
    # at most 2 * (dictionary_rows + calibration_rows) ids, so this side is small by its parameters
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").persist()
    try:
        content = []
        for quality in (1, 0):
            samples = _sampled_blocks(rows.where((F.col("quality") == quality) & (F.col("part") == 0)))
            try:
                content.append(zstandard.train_dictionary(dictionary_bytes, samples).as_bytes())
            except zstandard.ZstdError:  # too little text to train on: the text itself serves
                content.append(b"".join(samples)[-dictionary_bytes:])
        seen = (
            rows.where("part = 1")
            .select("quality", feature_column(F.col("text"), *content).alias("x"))
            .toPandas()
        )
    finally:
        rows.unpersist()
    y, x = seen["quality"].to_numpy(float), seen["x"].to_numpy(float)
    if len(set(y)) < 2:
        p = (good + 1) / (good + bad + 2)
        return CompressionModel(*content, 0.0, math.log(p / (1 - p)))
    weight = np.where(y == 1, good / (y == 1).sum(), bad / (y == 0).sum()) * len(y) / (good + bad)
    return CompressionModel(*content, *_logistic(x, y, weight))


def score_column(text: Column, model: CompressionModel) -> Column:
    """Probability that the text is good, as a column; any other columns of the row stay as they are."""
    x = feature_column(text, model.good, model.bad)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(x * F.lit(model.slope) + F.lit(model.intercept))))


def classify(documents: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    scored = documents.select("doc_id", score_column(F.col("text"), model).alias("score"))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
