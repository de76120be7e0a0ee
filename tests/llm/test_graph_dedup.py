import numpy as np
import pytest

from spanwright.llm import graph_dedup as gd


def brute(rows, threshold=0.98):
    good = {}
    for k, (i, e, label) in enumerate(rows):
        if i is not None and label is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.float32(e).astype(float)
            good[k] = (label, len(e), v / np.sqrt(v @ v))
    links = {k: [] for k in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and good[a][:2] == good[b][:2] and good[a][2] @ good[b][2] >= threshold:
                links[a].append(b)
                links[b].append(a)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for y in links[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[k][0], len(links[k]), min(ids) if ids else None))
    return out


def corpus(n=700, d=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base, label = rng.normal(size=d), int(rng.integers(0, 3))
        for _ in range(int(rng.choice([1, 1, 1, 3, 8, 90], p=[0.3, 0.3, 0.2, 0.1, 0.09, 0.01]))):
            e = base + rng.normal(size=d) * rng.choice([0, 0.02, 0.05])
            rows.append((len(rows), [float(np.float32(x)) for x in e], label))
    nan = float("nan")
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * d, 1), (5003, [nan] + [1.0] * (d - 1), 1), (5004, [None] + [1.0] * (d - 1), 1),
             (5005, [1.0] * d, None), (5006, [1.0] * d, 1), (5007, [2.0] * d, 1), (5008, [1.0] * 4, 1), (None, [1.0] * d, 1), (5006, [1.0] * d, 1)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, kept string, rep int"


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD_ROWS", 40), ("QUERY_ROWS", 50), ("CLUSTER_ROWS", 60)):
            monkeypatch.setattr(gd, name, value)
    rows = corpus()
    df, recall = gd.near_duplicates(spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(4))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert recall >= 0.9
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.97 * there <= found <= there
    assert sum(g != w for g, w in zip(got, want)) <= 0.03 * len(want)


def test_low_recall_is_never_accepted(spark, monkeypatch):
    # a search that finds nothing but one link of each node
    real = gd.range_search
    monkeypatch.setattr(gd, "PROBES", 1)
    monkeypatch.setattr(gd, "SHARD_ROWS", 30)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(25):
        base = rng.normal(size=16)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.02], 0) for k in range(8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    tried = []

    def poor(placed, threshold, beam, slack, exact=False):
        tried.append(exact)
        out = gd_links(placed, threshold, beam, slack, exact)
        return out if exact else out.where("v is not null").limit(5).union(out.where("v is null").selectExpr("u", "v", "cast(1 as long) as n"))

    gd_links = gd.graph_links
    monkeypatch.setattr(gd, "graph_links", poor)
    df, recall = gd.near_duplicates(frame)
    assert tried == [False, False, False, True] and recall == 1.0 and real is gd.range_search
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_links_are_counted_at_both_ends(spark, monkeypatch):
    monkeypatch.setattr(gd, "PROBES", 1)
    monkeypatch.setattr(gd, "CLUSTER_ROWS", 20)
    monkeypatch.setattr(gd, "LEAST_RECALL", 0.0)
    rows = corpus(400, seed=3)
    df, _ = gd.near_duplicates(spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(4))
    got = df.collect()
    linked = {r.component_id for r in got if r.vec_id != r.component_id}
    assert all(r.n_links > 0 for r in got if r.vec_id is not None and r.vec_id in linked)
    assert all(r.n_links > 0 for r in got if r.vec_id is not None and r.vec_id != r.component_id)


def test_one_very_large_group_of_equal_vectors(spark):
    rows = [(k, [1.0, 2.0, 3.0], 1) for k in range(3000)] + [(9000 + k, [1.0, 2.0, 3.001 + k / 1000], 1) for k in range(5)]
    df, _ = gd.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4))
    assert {(r.n_links, r.component_id) for r in df.collect()} == {(3004, 0)}


def test_empty_table(spark):
    df, recall = gd.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert df.count() == 0 and recall == 1.0


def test_every_node_can_be_reached():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[:150] = x[0] + rng.normal(size=(150, 8)) * 0.001
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = gd.robust_prune(x)
    seen, todo = {0}, [0]
    while todo:
        for y in lists[todo.pop()].tolist():
            if y not in seen:
                seen.add(y)
                todo.append(y)
    assert len(seen) == 300
    met = gd.range_search(x, lists, x, 0.98, gd.BEAM, gd.SLACK)
    there = np.argwhere(x @ x.T >= 0.98)
    assert len(met) >= 0.98 * len(there)
