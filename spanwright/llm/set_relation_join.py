"""N-gram Jaccard join that skips by the relations between sets.

A document's set holds its distinct shingles of ``width`` words as 64-bit hashes.  Two documents link when
100 * intersection >= percent * union.  Only the components of the links are returned, so no two copies are ever paired
up: the relations between sets stand in for the pairs.

1. *Equal sets* are one class (a 128-bit hash of the sorted shingles), kept by its smallest doc_id.
2. *Order.*  A table of ``SKETCH`` counters, filled from all documents, says how common a shingle is at most.  Sets are
   ordered from rare to common.  Two sets that link share a shingle among the first
   n - ceil(percent * n / 100) + 1 of either: these prefixes are the index lists.  Any order is exact; this
   one keeps passages that many documents share out of the lists.
3. *Hot groups.*  Sets are put in buckets by ``MINIMA`` least hashes each.  Where a bucket has over ``HOT_ROWS`` sets each is compared
   with the bucket's first one, in one linear pass; those that link get a common label.  Sets of one label are
   known to be connected, so from here on no two of them are ever compared.
4. *Lists* are read in order of set size.  An entry skips whole blocks of the list by size, and by the position of the
   shingle in either set, which bounds what can still be shared.  The surviving pairs must fit the sets' parity
   bitmaps, whose differing bits never outnumber the differing shingles.  Of the pairs of a list only a forest is kept.
5. *Cells* are the components of these forests, and contain all links.  In a cell the shared counts of one set with all
   others come from an inverted index; those of a set similar to it are derived from them, by the
   shingles in which the two differ.  The counts are exact, and so are the links.  A cell is left once all its sets are joined.

A list of over ``LIST_ROWS`` entries, counted exactly, and a cell of over ``CELL_ROWS`` sets are dealt out.  The sets of the commonest
label are cut into blocks that never meet each other; each meets the blocks of the other sets, and those meet
one another.  Lists and cells go in passes, whole ones each, so that disk holds a bounded part of the entries and sets
at a time whatever the corpus.  With one large group of near copies that is linear in the group; only for sets that no label joins it is
quadratic, in blocks.

Defined results: null text, and text without words, has the empty set and links with nothing; fewer than ``width`` words
make one shingle.  A row without doc_id takes the component of its equal sets, null if none of them has
an id, and links with nothing by itself.  Repeated rows get equal results.  Where one id has several texts, classes named by that id count as one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import TEXT_ROWS, discard, give_back, id_bitmap, in_bitmap, written
from spanwright.llm.components import Forest, connected

WIDTH = 3
PERCENT = 90
SKETCH = 1 << 20
SKETCH_PARTS = 64
BITMAP_WORDS = 8
MINIMA = 3
HOT_ROWS = 256
LIST_ROWS = 4096
CELL_ROWS = 2048
#: Index entries, and shingles of cells, that are on disk at a time: larger ones are done in as many passes as it takes.
ENTRIES_A_PASS = 1 << 26
SHINGLES_A_PASS = 1 << 27
BLOCK = 64

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes; bytes.split() splits at ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mixed(out * _MULTIPLY + h[k : k + n])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def least_shared(total: np.ndarray | int, percent: int):
    """The smallest intersection with which sets of together ``total`` shingles link."""
    return -((-percent * total) // (100 + percent))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def parity_bitmap(tokens: np.ndarray) -> bytes:
    bits = np.bincount((tokens % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def slices(frame: pd.DataFrame, rows: int = 1000):
    for at in range(0, len(frame), rows):
        yield frame.iloc[at : at + rows]


def sketch(documents: DataFrame, width: int) -> np.ndarray:
    """How often each counter's shingles occur; no more than ``SKETCH`` numbers, whatever the corpus."""

    def count(batches):
        from pyspark import TaskContext

        counts = np.zeros(SKETCH, np.int64)
        for frame in batches:
            texts = frame["text"].tolist()
            for at in range(0, len(texts), 500):
                found = np.concatenate([shingles(t, width) for t in texts[at : at + 500]])
                counts += np.bincount((found % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        if counts.any():
            pieces = counts.astype(np.int32).reshape(SKETCH_PARTS, -1)
            yield pd.DataFrame(
                {
                    "part": np.arange(SKETCH_PARTS, dtype=np.int32),
                    "salt": np.full(SKETCH_PARTS, TaskContext.get().partitionId() % 64, np.int32),
                    "counts": [p.tobytes() for p in pieces],
                }
            )

    def add(key, frame):
        total = np.sum([np.frombuffer(c, np.int32).astype(np.int64) for c in frame["counts"]], axis=0)
        made = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pd.DataFrame({"part": [key[0]], "salt": [0], "counts": [made.tobytes()]})

    kind = "part int, salt int, counts binary"
    local = documents.select("text").mapInPandas(count, kind)
    summed = local.groupBy("part", "salt").applyInPandas(add, kind).groupBy("part").applyInPandas(lambda k, f: add(k, f), kind)
    summed = written(summed, "sketch")
    out = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), np.int32)
    for part, _, counts in summed.collect():
        out[part] = np.frombuffer(counts, np.int32)
    discard(summed)
    return out.reshape(-1)


def least_hashes(mixed: np.ndarray) -> list[int]:
    """The least of a set's mixed tokens under ``MINIMA`` orders (rotations of their bits): similar sets share most of them."""
    turns = [np.uint64(64 * k // MINIMA) for k in range(MINIMA)]
    turned = [(mixed << t) | (mixed >> (np.uint64(64) - t)) if t else mixed for t in turns]
    return [int(x.min().astype(np.int64)) for x in turned] if len(mixed) else []


def prefixes(documents: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, set size, set hash, bitmap, least hashes and the rare end of the set, of every row."""
    common = documents.sparkSession.sparkContext.broadcast(counts)  # SKETCH numbers of four bytes

    def run(batches):
        import xxhash

        counts = common.value
        for frame in (part for whole in batches for part in slices(whole)):
            rows = []
            for key, text in zip(frame["doc_id"], frame["text"], strict=True):
                tokens = shingles(text, width)
                n = len(tokens)
                first = n + (-percent * n) // 100 + 1 if n else 0
                seen = counts[(tokens % np.uint64(SKETCH)).astype(np.int64)]
                # by count, then by hash, then by token: the same order in every set
                mixed = _mixed(tokens)
                rank = (np.minimum(seen, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (mixed >> np.uint64(24))
                order = np.argsort(rank, kind="stable")[:first]
                digest = xxhash.xxh3_128_digest(tokens.tobytes()) if n else b""
                minima = least_hashes(mixed)
                rows.append((key, n, digest, parity_bitmap(tokens), minima, tokens[order].view(np.int64), seen[order]))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "digest", "bitmap", "minima", "tokens", "seen"]).astype({"doc_id": "Int64"})
        give_back()

    kind = "doc_id long, n int, digest binary, bitmap binary, minima array<long>, tokens array<long>, seen array<int>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, kind)


def sets_of(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(rep, tokens as bytes) of the documents whose doc_id is among the column ``rep`` of ``ids``, and of a few others."""
    wanted, place = id_bitmap(ids, "rep")

    def run(batches):
        for whole in batches:
            for frame in slices(whole[in_bitmap(wanted.value, whole["place"].to_numpy())]):
                made = [shingles(t, width).tobytes() for t in frame["text"]]
                yield pd.DataFrame({"rep": frame["rep"], "tokens": made})
        give_back()

    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep is not null")
    texts = texts.select("rep", place(F.col("rep")).alias("place"), "text")
    return texts.mapInPandas(run, "rep long, tokens binary").where("length(tokens) > 0")


def hot_links(classes: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v) links between the sets of a hot bucket and its first set, in one pass over the bucket."""
    keys = classes.select("rep", F.posexplode("minima").alias("which", "key"))
    hot = keys.groupBy("which", "key").agg(F.count("*").alias("size"), F.min("rep").alias("leader")).where(F.col("size") > HOT_ROWS)
    hot = written(hot.select("which", "key", "leader"), "hot-buckets")
    asked = keys.join(hot, ["which", "key"]).where("rep != leader").select("rep", "leader").distinct()
    asked = written(asked, "hot-members")
    if asked.isEmpty():
        return asked.select(F.col("rep").alias("u"), F.col("leader").alias("v"))
    sets = written(sets_of(documents, asked.select("rep").union(asked.select("leader")), width), "hot-sets", TEXT_ROWS)
    # a leader's set goes to each part of its bucket once
    sizes = asked.groupBy("leader").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(F.lit("part"), "rep"), F.col("parts")).cast("int")
    members = asked.join(sizes, "leader").select("leader", part.alias("part"), "rep").join(sets, "rep")
    heads = sizes.select(F.col("leader").alias("head"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("head_part"))
    heads = heads.join(sets.select(F.col("rep").alias("head"), F.col("tokens").alias("head_tokens")), "head")

    def linked(members: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        firsts = [np.frombuffer(t, np.uint64) for t in heads["head_tokens"]]
        u = []
        for rep, tokens in zip(members["rep"], members["tokens"], strict=True):
            a = np.frombuffer(tokens, np.uint64)
            if any(shares_enough(a, b, percent) for b in firsts):
                u.append(rep)
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.repeat(heads["head"].to_numpy(np.int64)[:1], len(u))})

    both = members.groupBy("leader", "part").cogroup(heads.groupBy("head", "head_part"))
    links = written(both.applyInPandas(linked, "u long, v long"), "hot-links")
    discard(sets)
    return links


def shares_enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    least = least_shared(len(a) + len(b), percent)
    return min(len(a), len(b)) >= least and len(np.intersect1d(a, b, assume_unique=True)) >= least


def deal(rows: DataFrame, key: str, most: int, doubtful=None) -> DataFrame:
    """``rows`` (key, rep, label, ...) with the pair of blocks a, b in which each is to be met, and its own ``block``.

    Groups of at most ``most`` rows, and rows that are not ``doubtful``, are one block.  Of a larger group the rows of the commonest
    label are blocks -1, -2, ... that meet the others' blocks 0, 1, ... only; without others nothing is left to compare.
    """
    doubtful = F.lit(True) if doubtful is None else doubtful
    by_label = rows.where(doubtful).groupBy(key, "label").count().groupBy(key)
    large = by_label.agg(F.sum("count").alias("total"), F.max(F.struct("count", "label")).alias("top")).where(F.col("total") > most)
    blocks = lambda c: F.ceil(c / F.lit(most)).cast("int")
    large = large.select(
        key,
        F.col("top.label").alias("top_label"),
        blocks(F.col("top.count")).alias("n_top"),
        blocks(F.col("total") - F.col("top.count")).alias("n_other"),
    )
    large = written(large, "large")
    place = lambda n: F.pmod(F.xxhash64(F.lit("block"), "rep"), F.greatest(n, F.lit(1))).cast("int")
    kept = rows.columns
    simple = rows.where(~doubtful)
    placed = rows.where(doubtful).join(large, key, "left")
    small = simple.unionByName(placed.where("n_other is null").select(kept))
    small = small.withColumns({"a": F.lit(0), "b": F.lit(0), "block": F.lit(0)})
    split = placed.where("n_other > 0")
    own = F.when(F.col("label") == F.col("top_label"), -1 - place(F.col("n_top"))).otherwise(place(F.col("n_other")))
    split = split.withColumn("block", own)
    tops = F.when(F.col("block") < 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), "n_top"), lambda k: -k))
    split = split.withColumn("other", F.explode(F.concat(tops, F.sequence(F.lit(0), F.col("n_other") - 1))))
    split = split.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    return small.unionByName(split.select(small.columns))


def _runs(keys: list[np.ndarray]):
    """Start and end of the runs of equal keys in arrays that are sorted by them."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], n)


def _by_list(batches):
    """Whole index lists from a stream that is sorted by (token, a, b)."""
    kept = None
    for frame in batches:
        if kept is not None:
            frame = pd.concat([kept, frame], ignore_index=True)
        last = (frame[["token", "a", "b"]].to_numpy() == frame[["token", "a", "b"]].iloc[-1].to_numpy()).all(axis=1)
        cut = len(frame) - int(last.sum())
        kept = frame.iloc[cut:]
        if cut:
            yield frame.iloc[:cut]
    if kept is not None and len(kept):
        yield kept


def _candidates(n, pos, block, label, crossing: bool, percent: int):
    """Pairs (i, j) of one list, in order of set size, that size and position allow; by entry and block."""
    m = len(n)
    left = n - pos  # what may still be shared from the common shingle on
    most = np.array([left[s : s + BLOCK].max() for s in range(0, m, BLOCK)])
    for i in range(m - 1):
        end = int(np.searchsorted(n, (100 * n[i]) // percent, "right"))
        if end <= i + 1:
            continue
        first, last = (i + 1) // BLOCK, (end - 1) // BLOCK
        need = least_shared(2 * int(n[i]), percent)  # the least that any larger set could ask for
        if left[i] < need:
            continue
        for k in range(first, last + 1):
            if most[k] < need:  # no set of the block has enough left behind the common shingle
                continue
            s, e = max(i + 1, k * BLOCK), min(end, (k + 1) * BLOCK)
            j = np.arange(s, e)
            fit = np.minimum(left[i], left[s:e]) >= least_shared(n[i] + n[s:e], percent)
            fit &= label[s:e] != label[i]
            if crossing:
                fit &= block[s:e] != block[i]
            if fit.any():
                yield i, j[fit]


def _lists(members: DataFrame, percent: int, bitmaps: bool) -> DataFrame:
    """With bitmaps the forest of candidate pairs of each list; without, the entries that have any candidate."""

    def survivors(batches):
        for frame in _by_list(batches):
            keep = np.zeros(len(frame), bool)
            cols = [frame[c].to_numpy() for c in ("token", "a", "b")]
            n, pos, block, label = (frame[c].to_numpy(np.int64) for c in ("n", "pos", "block", "label"))
            for s, e in zip(*_runs(cols)):
                if e - s > 1:
                    crossing = cols[1][s] != cols[2][s]
                    if e - s == 2 and not crossing:
                        keep[s:e] = n[s] * 100 >= percent * n[s + 1] and label[s] != label[s + 1]
                        continue
                    for i, j in _candidates(n[s:e], pos[s:e], block[s:e], label[s:e], crossing, percent):
                        keep[s + i] = True
                        keep[s + j] = True
            if keep.any():
                yield frame.loc[keep, ["token", "a", "b", "rep", "label", "n", "pos", "block"]]

    def forests(batches):
        for frame in _by_list(batches):
            cols = [frame[c].to_numpy() for c in ("token", "a", "b")]
            n, pos, block, rep, label = (frame[c].to_numpy(np.int64) for c in ("n", "pos", "block", "rep", "label"))
            bits = np.frombuffer(b"".join(frame["bitmap"]), np.uint64).reshape(len(frame), -1)
            us, vs = [], []
            for s, e in zip(*_runs(cols)):
                if e - s < 2:
                    continue
                forest = Forest()
                for i, j in _candidates(n[s:e], pos[s:e], block[s:e], label[s:e], cols[1][s] != cols[2][s], percent):
                    size = n[s + i] + n[s + j]
                    fit = popcount(bits[s + j] ^ bits[s + i]) <= size - 2 * least_shared(size, percent)
                    for x in j[fit].tolist():
                        if forest.join(i, x):
                            us.append(s + i)
                            vs.append(s + x)
            if us:
                yield pd.DataFrame({"u": rep[us], "v": rep[vs]})

    if bitmaps:
        return members.mapInPandas(forests, "u long, v long")
    return members.mapInPandas(survivors, "token long, a int, b int, rep long, label long, n int, pos int, block int")


def _sorted_lists(entries: DataFrame) -> DataFrame:
    return entries.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "n", "rep")


def candidate_forest(classes: DataFrame, percent: int) -> list[DataFrame]:
    """(u, v) pairs of classes, a table for each pass; their components contain every link that the labels do not know of."""
    n = max(1, -(-(classes.agg(F.sum(F.size("tokens"))).first()[0] or 0) // ENTRIES_A_PASS))
    entry = classes.select("rep", "label", "n", F.posexplode(F.arrays_zip("tokens", "seen")).alias("pos", "t"))
    entry = entry.select("rep", "label", "n", "pos", F.col("t.tokens").alias("token"), F.col("t.seen").alias("seen"))
    own = F.pmod(F.xxhash64(F.lit("pass"), "token"), F.lit(n))
    return [written(_forest_of(entry.where(own == k) if n > 1 else entry, classes, percent), "forest") for k in range(n)]


def _forest_of(entry: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    # the sketch never counts too little, so only lists that it calls long are counted
    dealt = deal(entry, "token", LIST_ROWS, F.col("seen") > LIST_ROWS).select("token", "a", "b", "rep", "label", "n", "pos", "block")
    kept = _lists(_sorted_lists(dealt), percent, bitmaps=False)
    with_bits = kept.join(classes.select("rep", "bitmap"), "rep")
    return _lists(_sorted_lists(with_bits), percent, bitmaps=True)


def _links_of_cell(sets: list[np.ndarray], percent: int, crossing: np.ndarray | None, label: np.ndarray | None = None):
    """Forest and link counts among sets, by an inverted index and by deriving counts from a similar set's.

    ``crossing`` numbers the block of each set; only pairs of different blocks count then.  With ``label`` sets of one label are
    joined from the start, those of the commonest one are not asked about, and it ends when all are joined, with counts so far.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    token, owner = np.concatenate(sets), np.repeat(np.arange(m, dtype=np.int64), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    starts, ends = _runs([token])
    heads = token[starts]

    def shared(tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(heads, tokens)
        pieces = [owner[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        return np.bincount(np.concatenate(pieces), minlength=m) if pieces else np.zeros(m, np.int64)

    forest, degree = Forest(), np.zeros(m, np.int64)
    waiting, apart = set(range(m)), m
    if label is not None:
        _, first, group, sizes = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
        for x in np.flatnonzero(np.arange(m) != first[group]).tolist():
            apart -= forest.join(x, int(first[group[x]]))
        waiting = set(np.flatnonzero(group != np.argmax(sizes)).tolist())
    while waiting and apart > 1:
        pivot = min(waiting)
        counts = shared(sets[pivot])
        # sets that share most of their shingles with the pivot derive their counts from its counts
        similar = np.flatnonzero(4 * counts >= 3 * np.maximum(size, size[pivot]))
        for x in [pivot, *(int(s) for s in similar if s in waiting and s != pivot)]:
            own = counts
            if x != pivot:
                lost = np.setdiff1d(sets[pivot], sets[x], assume_unique=True)
                new = np.setdiff1d(sets[x], sets[pivot], assume_unique=True)
                own = counts - shared(lost) + shared(new)
            link = 100 * own >= percent * (size + size[x] - own)
            link[x] = False
            if crossing is not None:
                link &= crossing != crossing[x]
            linked = np.flatnonzero(link)
            degree[x] = len(linked)
            for y in linked.tolist():
                joined = forest.join(x, y)
                apart -= joined and label is not None
            waiting.discard(x)
    return forest, degree


def exact_links(cells: DataFrame, documents: DataFrame, width: int, percent: int) -> list[DataFrame]:
    """(u, v) edges with the components of the exact links within cells (rep, cell, label, n), a table for each pass."""
    n = max(1, -(-(cells.agg(F.sum("n")).first()[0] or 0) // SHINGLES_A_PASS))
    own = F.pmod(F.xxhash64(F.lit("pass"), "cell"), F.lit(n))
    found = []
    for k in range(n):
        part = cells.where(own == k) if n > 1 else cells
        sets = written(sets_of(documents, part, width), "cell-sets", TEXT_ROWS)
        found.append(written(_links_of_cells(part.select("rep", "cell", "label"), sets, percent), "links"))
        discard(sets)
    return found


def _links_of_cells(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    rows = sets.join(deal(cells, "cell", CELL_ROWS), "rep")

    def run(key, frame):
        sets = [np.frombuffer(t, np.uint64) for t in frame["tokens"]]
        rep = frame["rep"].to_numpy(np.int64)
        if len(sets) < 2:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        crossing = frame["block"].to_numpy() if key[1] != key[2] else None
        forest, _ = _links_of_cell(sets, percent, crossing, frame["label"].to_numpy(np.int64))
        pairs = [(rep[x], rep[forest.root(x)]) for x in forest.parent]
        return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["u", "v"], dtype="int64")

    return rows.groupBy("cell", "a", "b").applyInPandas(run, "u long, v long")


def set_digest(text, width: int):
    """The hash of a text's set as a column, empty for the empty set, as in :func:`jaccard_classes`."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        import xxhash

        made = [shingles(t, width) for t in texts]
        return pd.Series([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in made])

    return of(text)


def jaccard_classes(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and the digest of the set for every row."""
    whole = written(prefixes(documents, sketch(documents, width), width, percent), "prefixes", TEXT_ROWS)
    table = written(whole.select("doc_id", "n", "digest"), "sizes")
    classes = table.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    known = classes.where("rep is not null").select(F.col("rep"), F.col("digest").alias("own"))
    firsts = whole.join(known, (whole["doc_id"] == known["rep"]) & (whole["digest"] == known["own"]))
    # by the columns of the join, so that the sets are not shuffled again
    firsts = firsts.dropDuplicates(["doc_id", "digest"]).select("rep", "n", "bitmap", "minima", "tokens", "seen")
    firsts = written(firsts, "firsts")
    discard(whole)
    hot = hot_links(firsts, documents, width, percent)
    labels = written(connected(hot).select(F.col("node").alias("rep"), "component"), "labels")
    label = F.coalesce("component", "rep").alias("label")
    # once for all passes
    labelled = written(firsts.join(labels, "rep", "left").select("rep", label, "n", "bitmap", "tokens", "seen"), "labelled")
    discard(firsts)
    forest = reduce(DataFrame.union, candidate_forest(labelled, percent), hot)
    cells = connected(forest).select(F.col("node").alias("rep"), F.col("component").alias("cell"))
    sizes = labelled.groupBy("rep").agg(F.max("n").alias("n"))
    cells = written(cells.join(labels, "rep", "left").join(sizes, "rep").select("rep", "cell", label, "n"), "cells")
    discard(labelled)
    links = reduce(DataFrame.union, exact_links(cells, documents, width, percent), hot)
    found = connected(links)
    named = classes.join(found, classes["rep"] == found["node"], "left").select(
        F.col("digest").alias("own"), F.coalesce("component", "rep").alias("component")
    )
    joined = table.select("doc_id", "n", "digest").join(named, F.col("digest") == F.col("own"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "digest")


def jaccard_components(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for every row."""
    return jaccard_classes(documents, width, percent).select("doc_id", "n_shingles", "component_id")
