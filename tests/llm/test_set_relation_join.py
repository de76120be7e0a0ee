import random

import numpy as np
import pytest

from spanwright.llm import common
from spanwright.llm import set_relation_join as sr


def brute(rows, width=3, percent=90):
    def shingled(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [(i, shingled(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n_groups=12, hot=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for g in range(n_groups):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([5, 30, 120, 200]))]
        if g % 3 == 0:
            body += passage
        for _ in range(hot if g == 0 else rng.randint(1, 6)):
            copy = list(body)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    out += [None, "", " \n", "one", "ONE", "one two", "One  Two", "a b c", "é É x", "x " * 3000, "x " * 3000]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed,cell_rows,list_rows", [(1, 4096, 8192), (2, 16, 8)])
def test_against_brute_force(spark, monkeypatch, seed, cell_rows, list_rows):
    monkeypatch.setattr(sr, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(sr, "LIST_ROWS", list_rows)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n int, digest string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sr.jaccard_components(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("hot_rows", [4, 20])
def test_hot_groups_against_brute_force(spark, monkeypatch, hot_rows):
    for name, value in (("CELL_ROWS", 16), ("LIST_ROWS", 8), ("HOT_ROWS", hot_rows)):
        monkeypatch.setattr(sr, name, value)
    rows = corpus(5, n_groups=9, hot=150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sr.jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_one_id_with_two_linked_texts(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, "q r s t")]
    got = sorted((r.doc_id, r.component_id) for r in sr.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "q r s"), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in sr.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 1, None), (7, 0, 7)], key=str)
    assert sr.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bitmaps_never_overstate_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 200, np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, 20, np.uint64)]))
        bits = [np.frombuffer(sr.parity_bitmap(x), np.uint64) for x in (a, b)]
        assert sr.popcount(bits[0] ^ bits[1]) <= len(np.setxor1d(a, b))


def test_derived_counts_equal_counted_ones():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 63, 150, np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) < p], rng.integers(0, 1 << 63, 8, np.uint64)])) for p in (1, 0.98, 0.97, 0.95, 0.9, 0.5) for _ in range(4)]
    forest, degree = sr._links_of_cell(sets, 90, None)
    for x, a in enumerate(sets):
        linked = [y for y, b in enumerate(sets) if y != x and 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))]
        assert degree[x] == len(linked) and all(forest.root(x) == forest.root(y) for y in linked)


def test_passes_against_brute_force_and_nothing_large_is_left_on_disk(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 16), ("LIST_ROWS", 8), ("ENTRIES_A_PASS", 60), ("SHINGLES_A_PASS", 500)):
        monkeypatch.setattr(sr, name, value)
    rows = corpus(3, n_groups=6, hot=20)
    before = {path for _, path in common._written}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sr.jaccard_components(docs).collect()}
    assert got == brute(rows)
    left = [path.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, path in common._written if path not in before]
    assert left.count("forest") > 1 and left.count("links") > 1
    assert not {"prefixes", "firsts", "cell-sets"} & set(left)
