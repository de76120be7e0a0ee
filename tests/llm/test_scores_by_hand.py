"""Scores of the two classifiers against plain loops over the texts."""

import math
import re

import pytest
import xxhash
import zstandard

from spanwright.llm import compression_quality as cq
from spanwright.llm import toxicity_chain as tc

SF = "/root/testdata/sf0.001"


def test_compression_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "é" * 3001)], "doc_id long, text string")
    )
    model = cq.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    tools = [zstandard.ZstdCompressor(level=cq.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.bad, model.good)]
    got = {r.doc_id: r.score for r in cq.classify(docs, model).collect()}
    for doc_id, text in docs.collect():
        raw, sizes = (text or "").encode(), [0, 0]
        for k, tool in enumerate(tools):
            while raw:
                sizes[k] += len(tool.compress(raw[:1024]))
                raw = raw[1024:]
            raw = (text or "").encode()
        x = (sizes[0] - sizes[1]) / len(raw) if raw else 0.0
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.intercept))), rel=1e-9)


def test_chain_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, None)], "doc_id long, text string"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "1 - quality as low_quality", "toxic")
    links = tc.fit(docs, labels, ["low_quality", "toxic"])
    got = {r.doc_id: r for r in tc.score(docs, links).collect()}
    for doc_id, text in docs.collect():
        seen = {xxhash.xxh32_intdigest(w.encode()) >> 12 for w in re.findall(r"[^\W_]+", (text or "").lower())}
        logits = []
        for link in links:
            z = link.intercept + sum(w for word, w in zip(link.words.tolist(), link.weights.tolist()) if word in seen)
            z += sum(a * b for a, b in zip(link.earlier.tolist(), logits))
            p = 1 / (1 + math.exp(-max(-40, min(40, z))))
            assert got[doc_id][f"p_{link.category}"] == pytest.approx(p, rel=1e-9)
            p = min(max(p, 1e-4), 1 - 1e-4)
            logits.append(math.log(p / (1 - p)))
