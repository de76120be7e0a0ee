"""Best-fit packing of token sequences, partition by partition and then up a tree.

Every partition tokenizes its documents, cuts those longer than a sequence into full pieces, and packs the
pieces best-fit in order of falling length.  A sequence that is nearly full is final.  The underfull ones go up a
tree as items of their own (their content stays together): at each level ``FAN_IN`` nodes of the level below are packed by
best fit again, and at the root whatever is left is packed and emitted.  Only lengths travel up the tree,
never ids.

A node takes at most ``NODE_ITEMS`` items.  Where more are left than one node takes, the levels go on with as many nodes as they
need and the bins are dealt among them anew, so that others meet; such levels end when one has joined fewer than
``WORTH_A_LEVEL`` of its bins.

Defined results: a null text is empty and still gives one piece, the end mark.  Repeated rows are
packed as often as they occur.  A null doc_id is carried along.
"""

from __future__ import annotations

import math
import zlib
from array import array
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import TEXT_ROWS, give_back, written

CAPACITY = 2048
NEARLY_FULL = 0.99
FAN_IN = 8
NODE_ITEMS = 200_000
CACHED_WORDS = 200_000
WORTH_A_LEVEL = 0.001
END_ID = b"\x00\x00\x00\x00"
#: ASCII characters that are neither letters, digits nor white space.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class _Words(dict):
    """Token ids of words; a word that is not there yet is learned when it is asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class WordTokenizer:
    """Token ids of whole texts as little-endian 32-bit bytes, with a bounded memory of words.

    The vocabulary's rules lower the case and never let a token cross white space, so ids of a text are the
    ids of its words one after the other.  Texts that may hold a special token's string are encoded whole.

    A run of letters is one unit to the vocabulary, and so is a run of ASCII marks; a word that is either, or letters and then
    marks, gets its tokens straight from the merge rules.  That holds for letters below U+0250 only: others may
    decompose, or hide marks that join those behind them.  All other words go through the whole chain of rules.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.most = cached_words
        self.known = _Words(self._learn)
        # the vocabulary names bytes by printable characters: those that print stand for themselves, the others follow from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.byte_names = {b: 256 + i for i, b in enumerate(rest)}

    def _learn(self, word: bytes) -> bytes:
        if word.isalpha() or not word.rstrip(MARKS):  # ASCII letters alone, or marks alone
            return array("I", [t.id for t in self.merge(word.decode())]).tobytes()
        stem = word.rstrip(MARKS)
        text = stem.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text:
            if len(stem) < len(word):
                return self.known[stem] + self.known[word[len(stem) :]]
            named = text.lower().encode().decode("latin-1").translate(self.byte_names)
            return array("I", [t.id for t in self.merge(named)]).tobytes()
        return array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.most:  # those met first are the frequent ones
            kept = _Words(self._learn)
            kept.update(islice(self.known.items(), self.most // 2))
            self.known = kept
        ids_of, out = self.known.__getitem__, []
        for text in texts:
            text = text or ""
            if "<|" in text:
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(ids_of, text.encode("utf-8", "replace").lower().split())))
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process: Spark gives its workers several tasks, and the words stay known."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit by falling length: for each item its bin and offset, and how full each bin is.

    Bins with room for r more are kept in list r; a bit set of the lists in use finds the tightest bin in one step.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, fill = 0, []
    for item, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            into = by_room[room].pop()
            if not by_room[room]:
                used &= ~(1 << room)
        else:
            room, into = capacity, len(fill)
            fill.append(0)
        bins[item], offsets[item] = into, fill[into]
        fill[into] += size
        left = room - size
        if left:
            by_room[left].append(into)
            used |= 1 << left
    return bins, offsets, fill


def pack_locally(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with their sequence within the partition."""

    def run(batches):
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        words = word_tokenizer(tokenizer_path)
        ids, pieces, starts, lengths, sums = [], [], [], [], []
        for frame in batches:
            texts, keys = frame["text"].tolist(), frame["doc_id"].tolist()
            for at in range(0, len(texts), 250):
                for key, content in zip(keys[at : at + 250], words.encode(texts[at : at + 250]), strict=True):
                    content += END_ID
                    for piece, start in enumerate(range(0, len(content), 4 * capacity)):
                        part = content[start : start + 4 * capacity]
                        ids.append(key)
                        pieces.append(piece)
                        starts.append(start // 4)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
        if not ids:
            return
        length = np.asarray(lengths, np.int64)
        bins, offsets, fill = best_fit(length, capacity)
        yield pd.DataFrame(
            {
                "doc_id": pd.array(ids, dtype="Int64"),
                "piece": np.asarray(pieces, np.int32),
                "start": np.asarray(starts, np.int64),
                "length": length,
                "ids_crc32": np.asarray(sums, np.int64),
                "bin": (np.int64(node) << 36) + bins,
                "bin_offset": offsets,
                "bin_fill": np.asarray(fill, np.int64)[bins],
                "node": np.full(len(ids), node, np.int64),
            }
        )
        give_back()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, bin_fill long, node long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def _merge_level(items: DataFrame, level: int, capacity: int) -> DataFrame:
    """Pack each node's items: bin -> (into, into_offset, into_fill, node)."""

    def run(key, frame):
        node = int(key[0])
        frame = frame.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        bins, offsets, fill = best_fit(frame["fill"].to_numpy(np.int64), capacity)
        into = (np.int64(level) << 58) + (np.int64(node) << 28) + bins
        return pd.DataFrame(
            {
                "bin": frame["bin"].to_numpy(),
                "into": into,
                "into_offset": offsets,
                "into_fill": np.asarray(fill, np.int64)[bins],
                "node": np.full(len(frame), node, np.int64),
            }
        )

    return items.groupBy("node").applyInPandas(run, "bin long, into long, into_offset long, into_fill long, node long")


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row."""
    pieces = written(pack_locally(documents, tokenizer_path, capacity), "pieces", TEXT_ROWS)
    enough = math.ceil(nearly_full * capacity)
    items = pieces.where((F.col("bin_offset") == 0) & (F.col("bin_fill") < enough)).select(
        "bin", F.col("bin_fill").alias("fill"), "node"
    )
    state = items.agg(F.count("*"), F.max("node")).first()
    left, nodes = state[0], (state[1] or 0) + 1
    moved, level = None, 0
    while left > 1:
        level += 1
        nodes_before, nodes = nodes, max(math.ceil(nodes / FAN_IN), math.ceil(left / NODE_ITEMS))
        again = F.pmod(F.xxhash64(F.lit(level), "bin"), F.lit(nodes)) if nodes == nodes_before else F.col("node") % nodes
        made = written(_merge_level(items.withColumn("node", again.cast("long")), level, capacity), "merged")
        step = made.select("bin", "into", "into_offset")
        if moved is None:
            moved = step
        else:
            step = step.select(F.col("bin").alias("into"), F.col("into").alias("then"), F.col("into_offset").alias("more"))
            moved = moved.join(step, "into", "left").select(
                "bin",
                F.coalesce("then", "into").alias("into"),
                (F.col("into_offset") + F.coalesce("more", F.lit(0))).alias("into_offset"),
            )
            moved = written(moved, "moved")
        if nodes == 1:
            break
        bins = made.where("into_offset = 0")
        items = bins.where(F.col("into_fill") < enough).select(F.col("into").alias("bin"), F.col("into_fill").alias("fill"), "node")
        count, open_ = bins.agg(F.count("*"), F.count_if(F.col("into_fill") < enough)).first()
        if nodes == nodes_before and left - count < WORTH_A_LEVEL * left:
            break
        left = open_
    out = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset")
    if moved is None:
        return out.withColumnsRenamed({"bin": "sequence_id", "bin_offset": "offset"})
    return out.join(moved, "bin", "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("bin_offset") + F.coalesce("into_offset", F.lit(0))).alias("offset"),
    )
