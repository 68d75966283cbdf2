"""Packing token ids into fixed windows by best-fit decreasing (operator 2).

Overlong documents are first cut into full windows; what is left of each
document is a piece shorter than a window. Pieces are dealt by a hash into
shards of a bounded number of pieces, so that a shard is a few small arrays
however long the texts are, and each shard is packed by itself: in order of
decreasing length, every piece goes into the open window with the least
remaining capacity that still holds it. A segment tree over the capacities
0..window, whose leaves count the open windows of that remaining capacity,
finds it in log(window) steps. A shard leaves only its last few windows partly
filled, so padding shrinks with the shard size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm import text as T
from telemill.llm.common import small_batches

WINDOW = 2048
END_ID = 1
SHARD = 50_000  # pieces per shard, on average
CACHE = 1_000_000  # encoded words a worker keeps, about 30 MB
SLICE = 1 << 19  # bytes of text encoded at a time
CASED = np.random.default_rng(0xCA5E).integers(1, 1 << 63, 256, dtype=np.uint64)


class WordEncoder:
    """Token ids of whole texts from the ids of their distinct words.

    The tokenizer lower-cases, drops white space and never joins what it
    separates, so the ids of a text are those of its white-space separated words
    in order. Words are told apart by a 64-bit hash; each distinct one is encoded
    once and kept in flat arrays (about 30 bytes a word, at most ``CACHE`` words).
    A full stop or comma after a letter is a token of its own. Strings that spell
    special tokens are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,"}
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size, self.flat = np.zeros(0, T.U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _places(self, keys: np.ndarray, word) -> np.ndarray:
        """Place of each key in the kept arrays; unknown words are encoded first. ``word(i)`` is the text of key i."""
        if len(self.keys) + len(keys) > CACHE:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        new = np.flatnonzero(~there)
        if len(new):
            found: list[list[int]] = []
            for k in range(0, len(new), 4096):  # the tokenizer's own result objects are large
                found += [e.ids for e in self.tokenizer.encode_batch_fast([word(i) for i in new[k : k + 4096]], add_special_tokens=False)]
            size = np.array([len(x) for x in found], np.int64)
            self.at = np.append(self.at, len(self.flat) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.flat = np.append(self.flat, np.array([i for x in found for i in x], np.uint32))
            both = np.append(self.keys, keys[new])
            order = np.argsort(both, kind="stable")  # two sorted runs
            self.keys, self.at, self.size = both[order], self.at[order], self.size[order]
            at = np.searchsorted(self.keys, keys)
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the bounds of each row's ids; null is empty."""
        data, bounds = T.buffers(texts)
        starts, ends = T.word_spans(data, bounds)
        to = np.searchsorted(starts, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), to
        wide = np.concatenate([[0], np.cumsum(data >= 0x80)])
        plain = wide[ends] == wide[starts]
        data = data.copy()
        upper = np.flatnonzero((data >= 0x41) & (data <= 0x5A))
        upper = upper[plain[np.searchsorted(starts, upper, "right") - 1]]
        data[upper] += 32  # words beyond ASCII keep their case: composing comes before lower-casing
        last = data[ends - 1]
        letter = data[np.maximum(ends - 2, starts)]
        marked = ((last == ord(".")) | (last == ord(","))) & (ends - starts > 1) & (letter >= 0x61) & (letter <= 0x7A)
        stop = ends - marked
        keys, first, word = np.unique(T.hash_spans(data, bounds, starts, stop, CASED), return_index=True, return_inverse=True)
        place = self._places(keys, lambda i: data[starts[first[i]] : stop[first[i]]].tobytes().decode())[word]
        size = self.size[place] + marked  # the marks' ids have one token each
        end = np.cumsum(size)
        total = int(end[-1])
        ids = self.flat[np.minimum(np.repeat(self.at[place] - (end - size), size) + np.arange(total), len(self.flat) - 1)]
        ids[end[marked] - 1] = np.where(last[marked] == ord("."), self.marks["."][0], self.marks[","][0])
        return ids, np.concatenate([[0], end])[to]


_encoders: dict[str, WordEncoder] = T.kept.setdefault("packing", {})


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so that tasks share its words until another operator runs there."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class CapacityTree:
    """Counts of open windows by remaining capacity, with search for the tightest fit."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """Least remaining capacity >= ``need`` of an open window, or -1."""
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:  # climb until a right sibling holds a window, then go down on its left
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; 0 < length <= window."""
    tree = CapacityTree(window)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        capacity = tree.tightest(need)
        if capacity < 0:
            capacity, b = window, used
            used += 1
        else:
            b = open_at[capacity].pop()
            tree.add(capacity, -1)
        bins[i], offsets[i] = b, window - capacity
        if capacity > need:
            open_at[capacity - need].append(b)
            tree.add(capacity - need, 1)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """One row per piece of each document: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    def run(batches):
        for batch in T.slices(batches, "text", SLICE, "packing"):
            rows: list[tuple] = []
            ids, to = encoder(tokenizer).encode(batch.column(1))
            raw = np.insert(ids, to[1:], end_id).astype("<u4").tobytes()
            begin = 0
            for i, n in zip(batch.column(0).to_pylist(), (np.diff(to) + 1).tolist()):
                for a in range(0, n, window):
                    length = min(window, n - a)
                    rows.append((i, a, length, zlib.crc32(raw[4 * (begin + a) : 4 * (begin + a + length)]), n))
                begin += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(cut_pieces: DataFrame, shards: Column, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; ``shards`` is the number of shards.

    Full windows need no partner and keep their own sequence. Sequence ids are
    unique: the shard number times 2^32 plus the window's number in the shard.
    Input columns are kept.
    """
    keyed = cut_pieces.withColumn("__shard", F.pmod(F.xxhash64(*cut_pieces.columns), shards))
    schema = cut_pieces.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def run(key, p):
        p = p.drop(columns="__shard").sort_values(list(p.columns[:4]), ignore_index=True)
        bins, offsets = best_fit_decreasing(p["length"].to_numpy(), window)
        return p.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return keyed.groupBy("__shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, shard: int = SHARD) -> DataFrame:
    """Pack all documents; one row per piece with its place in a sequence.

    A null or empty text is the end id alone. Rows that repeat an id are packed
    each; a null id stays null. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    cut_pieces = pieces(docs, tokenizer, id_col, text_col, window, end_id)
    chars = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # one piece per document and full window, a token has two bytes at least on average
    shards = chars.select((F.ceil((F.col("bytes") / (2 * window) + F.col("rows")) / shard)).cast("long").alias("n"))
    return pack(cut_pieces, F.greatest(shards.scalar(), F.lit(1)), window)
