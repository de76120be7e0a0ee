"""Embedding near-duplicates by a robust-pruned flat graph.

1. *Classes.*  Equal vectors of one label are one node with a weight.
2. *Overlapping cluster shards.*  Centroids from a bounded sample give each node its nearest cluster and a second one; a node is a
   member of both.  A cluster with over ``SHARD_ROWS`` members is split by hash into shards of about that size.
3. *Build.*  In each shard every node's nearest members are robust-pruned: a member stays a neighbour unless one that
   was chosen before it is nearer to it by the factor ``ALPHA``.  Back edges are added, and parts that cannot be reached get
   an edge from the medoid.  The adjacency lists of a node from all its shards are united, and the union is the graph.
4. *Search.*  A node is searched for in the shards of its ``PROBES`` nearest clusters, all of them if a cluster was split.
   A task walks the part of the graph between the members of one shard; edges that other shards have found between them
   count, edges that leave are walked where both their ends are members.  The greedy search starts at the shard's medoid and
   expands the best node known ``BEAM`` times; then the range grows: every node within ``SLACK`` of the threshold is
   expanded in turn until no new one is found.
5. *Audit and verify.*  Links are verified by the cosine in double precision.  A link is counted at both its ends, also where
   the search of one end does not reach the other's cluster.  For ``AUDIT_QUERIES`` nodes, half of them with links found, the links are
   counted by brute force too; below ``LEAST_RECALL`` the search is done again, wider, and in the end by comparing
   every node with every member of all clusters of its label, in blocks, without the graph.

A shard's links leave its task as counts and as a forest, never as pairs.  Clusters without end (one label and cluster with
a third of all rows) are dealt out as shards, each searched by blocks of at most ``QUERY_ROWS`` nodes, so
counting the links of one such group is quadratic in the group, spread over tasks.

Defined results: rows whose label or vector is null, whose vector is empty, zero, or holds null or non-finite components, and
rows without vec_id link with nothing.  Vectors of different lengths are never compared.  Repeated rows are separate vectors
that link with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import written
from spanwright.llm.components import Forest, connected

THRESHOLD = 0.98
SAMPLE_ROWS = 16384
CLUSTER_ROWS = 500
MOST_CLUSTERS = 4096
SHARD_ROWS = 1024
QUERY_ROWS = 2048
NEAREST = 64
DEGREE = 24
ALPHA = 1.2
PROBES = 3
BEAM = 24
SLACK = 0.03
AUDIT_QUERIES = 256
ATTEMPTS = 3
LEAST_RECALL = 0.9

SHARD = ["label", "dim", "cluster", "shard"]


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def classes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every row with its class's key or null, the classes with smallest id, weight and vector)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    moving = F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    good = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & moving, F.lit(False))
    rows = embeddings.select(
        "vec_id",
        "label",
        F.when(good, F.col("embedding")).alias("embedding"),
        *[F.when(good, F.xxhash64(F.lit(k), "label", "embedding")).alias(f"key{k}") for k in (1, 2)],
    )
    classes = (
        rows.where("key1 is not null")
        .groupBy("key1", "key2")
        .agg(
            F.min("vec_id").alias("rep"),
            F.count("*").alias("weight"),
            F.first("label").alias("label"),
            F.first("embedding").alias("embedding"),
        )
        .withColumn("dim", F.size("embedding"))
    )
    return rows.select("vec_id", "key1", "key2"), classes


def fit_centroids(classes: DataFrame) -> dict[int, np.ndarray]:
    """Unit centroids for each vector length, by k-means on at most ``SAMPLE_ROWS`` classes in all."""
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("dim", "embedding").toPandas()
    k = max(1, min(MOST_CLUSTERS, math.ceil(n / CLUSTER_ROWS)))
    out = {}
    for dim, part in sample.groupby("dim"):
        x = unit(part["embedding"])
        c = x[: max(1, min(k, len(x) // 4))].copy()
        for _ in range(10):
            near = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1)
            c[norm > 0] = sums[norm > 0] / norm[norm > 0][:, None]
        out[int(dim)] = c
    return out


def assign(classes: DataFrame, centroids: dict[int, np.ndarray], probes: int) -> DataFrame:
    """The nearest clusters of each class, best first."""

    def run(batches):
        for frame in batches:
            near = np.empty(len(frame), object)
            for dim, at in frame.groupby("dim").indices.items():
                c = centroids.get(int(dim))
                if c is None:  # a length that the sample has missed is one cluster
                    for i in at:
                        near[i] = [0]
                    continue
                sims = unit(frame["embedding"].iloc[at]) @ c.T
                best = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
                for i, row in zip(at, best.tolist(), strict=True):
                    near[i] = row
            frame["near"] = near
            yield frame[["rep", "weight", "label", "dim", "embedding", "near"]]

    kinds = dict(classes.dtypes)
    kind = f"rep long, weight long, label {kinds['label']}, dim int, embedding {kinds['embedding']}, near array<int>"
    return classes.select("rep", "weight", "label", "dim", "embedding").mapInPandas(run, kind)


def robust_prune(x: np.ndarray, nearest: int = NEAREST, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of every row of unit vectors: pruned lists, their back edges, and an edge to each part left apart."""
    n = len(x)
    if n == 1:
        return [np.empty(0, np.int64)]
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    width = min(nearest, n - 1)
    cand = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(sims, cand, 1), axis=1, kind="stable"), 1)
    far = 1 - np.take_along_axis(sims, cand, 1)
    alive, rows = np.ones(cand.shape, bool), np.arange(n)
    edges = []
    for _ in range(min(degree, width)):
        at = np.argmax(alive, axis=1)
        some = alive[rows, at]
        if not some.any():
            break
        chosen = cand[rows, at]
        edges.append(np.column_stack([rows, chosen])[some])
        between = 1 - sims[chosen[:, None], cand]
        alive &= ~(some[:, None] & (alpha * between <= far))
        alive[rows, at] = False
    # a node's very nearest always stay, for the range search
    kept = [np.column_stack([rows, cand[:, j]]) for j in range(min(4, width))]
    pairs = np.concatenate([*edges, *kept])
    forest = Forest()
    for a, b in pairs.tolist():
        forest.join(a, b)
    medoid = int(np.argmax(x @ x.sum(axis=0)))
    apart = {forest.root(i): i for i in range(n)}
    extra = [(medoid, i) for r, i in apart.items() if r != forest.root(medoid)]
    if extra:
        pairs = np.concatenate([pairs, np.array(extra)])
    both = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    cut = np.searchsorted(both[:, 0], np.arange(n + 1))
    return [both[cut[i] : cut[i + 1], 1] for i in range(n)]


def range_search(x: np.ndarray, adjacency: list[np.ndarray], y: np.ndarray, threshold: float, beam: int, slack: float) -> np.ndarray:
    """Pairs (query, node) of unit vectors that the search has met with a similarity of about the threshold or more."""
    n, q = len(x), len(y)
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    width = max(1, max(map(len, adjacency)))
    table = np.full((n, width), -1, np.int64)
    for i, a in enumerate(adjacency):
        table[i, : len(a)] = a
    sims = np.full((q, n), -2, np.float32)
    fresh = np.full((q, n), -2, np.float32)  # of nodes seen and not yet expanded
    medoid = int(np.argmax(x @ x.sum(axis=0)))
    sims[:, medoid] = fresh[:, medoid] = y32 @ x32[medoid]

    def expand(qs: np.ndarray, nodes: np.ndarray) -> None:
        for s in range(0, len(qs), 65536):
            a, b = qs[s : s + 65536], nodes[s : s + 65536]
            fresh[a, b] = -2
            flat_q, flat_n = np.repeat(a, width), table[b].reshape(-1)
            new = flat_n >= 0
            flat_q, flat_n = flat_q[new], flat_n[new]
            new = sims[flat_q, flat_n] == -2
            codes = np.unique(flat_q[new] * n + flat_n[new])
            for t in range(0, len(codes), 262144):
                c, d = np.divmod(codes[t : t + 262144], n)
                sims[c, d] = fresh[c, d] = np.einsum("ij,ij->i", y32[c], x32[d])

    every = np.arange(q)
    for _ in range(beam):
        best = np.argmax(fresh, axis=1)
        open_ = fresh[every, best] > -2
        if not open_.any():
            break
        expand(every[open_], best[open_])
    while True:
        qs, nodes = np.nonzero(fresh >= threshold - slack)
        if not len(qs):
            break
        expand(qs, nodes)
    return np.column_stack(np.nonzero(sims >= threshold - 1e-4))


def _build(members: DataFrame) -> DataFrame:
    def run(frame):
        lists = robust_prune(unit(frame["embedding"]))
        reps = frame["rep"].to_numpy(np.int64)
        return pd.DataFrame({"src": reps, "dst": [reps[a] for a in lists]})

    shards = members.groupBy(*SHARD).applyInPandas(run, "src long, dst array<long>")
    return shards.groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("dst"))).alias("neighbours"))


def _search(tasks: DataFrame, threshold: float, beam: int, slack: float, exact: bool) -> DataFrame:
    """found(u, v, n): v is null for a link count of u in this task, else the root of u among the task's links."""

    def run(frame):
        nodes, asking = frame[~frame["is_query"]], frame[frame["is_query"]]
        none = pd.DataFrame({"u": pd.array([], "Int64"), "v": pd.array([], "Int64"), "n": pd.array([], "Int64")})
        if not len(nodes) or not len(asking):
            return none
        rep = nodes["rep"].to_numpy(np.int64)
        place = {r: i for i, r in enumerate(rep.tolist())}
        adjacency = [np.array([place[d] for d in ds if d in place], np.int64) for ds in nodes["neighbours"]]
        x, y = unit(nodes["embedding"]), unit(asking["embedding"])
        own, weight = nodes["own"].to_numpy(bool), nodes["weight"].to_numpy(np.int64)
        who = asking["rep"].to_numpy(np.int64)
        if exact:
            met = np.concatenate([np.argwhere(y[k : k + 256] @ x.T >= threshold - 1e-9) + [k, 0] for k in range(0, len(y), 256)])
        else:
            met = range_search(x, adjacency, y, threshold, beam, slack)
        met = met[own[met[:, 1]] & (who[met[:, 0]] != rep[met[:, 1]])]
        cosine = np.concatenate([np.einsum("ij,ij->i", y[m[:, 0]], x[m[:, 1]]) for m in np.array_split(met, len(met) // 262144 + 1)])
        met = met[cosine >= threshold]
        count = np.bincount(met[:, 0], weight[met[:, 1]], len(who)).astype(np.int64)
        forest = Forest()
        for a, b in zip(who[met[:, 0]].tolist(), rep[met[:, 1]].tolist(), strict=True):
            forest.join(a, b)
        # a node that does not look into the asking one's own cluster learns of the link here
        home = asking["cluster_of"].to_numpy(np.int64)
        looks = [set(c) for c in nodes["near"]]
        back = np.array([home[a] not in looks[b] for a, b in met.tolist()], bool)
        met_back = met[back] if len(met) else met
        again = np.bincount(met_back[:, 1], asking["weight"].to_numpy(np.int64)[met_back[:, 0]], len(rep)).astype(np.int64)
        some = count > 0
        linked = [(a, forest.root(a), None) for a in forest.parent if forest.root(a) != a]
        rows = [(int(a), None, int(c)) for a, c in zip(who[some], count[some])]
        rows += [(int(rep[k]), None, int(again[k])) for k in np.flatnonzero(again)] + linked
        return pd.DataFrame(rows, columns=["u", "v", "n"]).astype("Int64") if rows else none

    return tasks.groupBy(*SHARD, "part").applyInPandas(run, "u long, v long, n long")


def graph_links(placed: DataFrame, threshold: float, beam: int, slack: float, exact: bool = False) -> DataFrame:
    """The search's counts and forests for classes placed by :func:`assign`."""
    spread = placed.select("rep", "weight", "label", "dim", "embedding", "near", F.posexplode("near").alias("rank", "cluster"))
    cluster = ["label", "dim", "cluster"]
    sizes = spread.groupBy(*cluster).agg(
        F.ceil(F.count_if(F.col("rank") < 2) / SHARD_ROWS).cast("int").alias("shards"),
        F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"),
    )
    sizes = written(sizes.withColumn("shards", F.greatest("shards", F.lit(1))), "cluster-sizes")
    spread = spread.join(sizes, cluster)
    members = spread.where("rank < 2").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    graph = written(_build(members), "graph")
    nodes = members.join(graph.withColumnRenamed("src", "rep"), "rep").select(
        *SHARD,
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        "rep",
        "weight",
        "embedding",
        "neighbours",
        (F.col("rank") == 0).alias("own"),
        "near",
        F.lit(None).cast("int").alias("cluster_of"),
        F.lit(False).alias("is_query"),
    )
    queries = spread.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(
        *SHARD,
        F.pmod(F.xxhash64(F.lit("part"), "rep"), F.col("parts")).cast("int").alias("part"),
        "rep",
        "weight",
        "embedding",
        F.lit(None).cast("array<long>").alias("neighbours"),
        F.lit(False).alias("own"),
        F.lit(None).cast("array<int>").alias("near"),
        F.get("near", F.lit(0)).alias("cluster_of"),
        F.lit(True).alias("is_query"),
    )
    return _search(nodes.union(queries), threshold, beam, slack, exact)


def audit(classes: DataFrame, counts: DataFrame, threshold: float) -> float:
    """Share of the links of up to ``AUDIT_QUERIES`` classes, by brute force against all, that were found."""
    by_chance = [F.xxhash64(F.lit("audit"), "rep"), "rep"]
    asked = classes.select("rep", "label", "dim", "embedding")
    linked = asked.join(counts.select(F.col("u").alias("rep")), "rep", "left_semi").orderBy(*by_chance).limit(AUDIT_QUERIES // 2)
    picked = linked.union(asked.orderBy(*by_chance).limit(AUDIT_QUERIES // 2)).toPandas().drop_duplicates("rep")
    if not len(picked):
        return 1.0

    def run(batches):
        for frame in batches:
            for key, asked in picked.groupby(["label", "dim"]):
                same = frame[(frame["label"] == key[0]) & (frame["dim"] == key[1])]
                if len(same):
                    near = unit(asked["embedding"]) @ unit(same["embedding"]).T >= threshold
                    near &= asked["rep"].to_numpy()[:, None] != same["rep"].to_numpy()[None, :]
                    yield pd.DataFrame({"rep": asked["rep"].to_numpy(), "there": near @ same["weight"].to_numpy(np.int64)})

    there = classes.select("rep", "weight", "label", "dim", "embedding").mapInPandas(run, "rep long, there long")
    there = there.groupBy("rep").agg(F.sum("there").alias("there"))
    both = there.join(counts.select(F.col("u").alias("rep"), "links"), "rep", "left")
    total, found = both.agg(F.sum("there"), F.sum(F.least("there", F.coalesce("links", F.lit(0))))).first()
    return 1.0 if not total else float(found) / float(total)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id and kept of every row, the audited recall)."""
    rows, classes = classes_of(embeddings)
    classes = written(classes, "classes")
    centroids = fit_centroids(classes)
    every = max(map(len, centroids.values()), default=1)
    for attempt in range(ATTEMPTS + 1):
        exact = attempt == ATTEMPTS
        placed = written(assign(classes, centroids, every if exact else PROBES + 2 * attempt), "placed")
        found = written(graph_links(placed, threshold, BEAM * (1 + attempt), SLACK * (1 + attempt), exact), "found")
        counts = written(found.where("v is null").groupBy("u").agg(F.sum("n").alias("links")), "counts")
        recall = audit(classes, counts, threshold)
        if recall >= LEAST_RECALL:
            break
    else:
        raise RuntimeError(f"only {recall:.2f} of the audited links were found")
    parts = connected(found.where("v is not null").select("u", "v"))
    named = (
        classes.select("key1", "key2", "rep", "weight")
        .join(counts, F.col("rep") == F.col("u"), "left")
        .join(parts, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("key1").alias("k1"),
            F.col("key2").alias("k2"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    joined = rows.join(named, (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")), "left")
    component = F.coalesce("component", "vec_id")
    return (
        joined.select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.col("vec_id").eqNullSafe(component).alias("kept"),
        ),
        recall,
    )
