"""Benchmark decontamination by size-partitioned MinHash containment search (operator 10).

A short item inside a long text has a tiny Jaccard similarity with the whole
text, so domains of like size are compared: items of more than ``BLOCK`` shingles
fall into size classes (up to 32, 64, ... shingles), and for every class the text
is seen as overlapping windows of two blocks of that size. Block minima of the
smallest size are computed once; a larger block is the minimum of two smaller
ones, a window the minimum of two neighbouring blocks.

A text that contains the share t of an item's shingles has windows whose Jaccard
similarities with the item sum to at least t / 3, so with bands of one row each
all of its ``PERMS`` minima miss with a chance below (1 - t/3)^PERMS, wherever
the shingles stand (5e-9 for t = 0.8; 2e-6 where they all stand in the first block,
which one window only holds). Windows are too long for items of up to ``BLOCK``
shingles: of these, one shingle more than a text may lack is looked up among all
shingles of the text, so none is missed.

Keys of a text are first held against a bitmap of fixed size with all item keys;
what passes meets the items in a join. Each candidate is verified by counting the
item's shingles in the whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm import text as T
from telemill.llm.common import FILTER_BITS, key_filter, only_possible, places, possible, salted_join
from telemill.session import cut

PERMS = 64
BLOCK = 16  # shingles in the smallest block, and of an item that is looked up by shingles
_MUL = np.random.default_rng(10).integers(0, 1 << 63, PERMS, dtype=np.uint64) | np.uint64(1)


def _class(n: np.ndarray) -> np.ndarray:
    """0 for up to BLOCK shingles, then one more per doubling."""
    return np.ceil(np.log2(np.maximum(n, BLOCK) / BLOCK)).astype(np.int64)


def _minima(columns: np.ndarray) -> np.ndarray:
    """PERMS x blocks minima of a (size x blocks) matrix of shingle hashes."""
    return np.stack([((columns * m) >> T.U(32)).min(axis=0) for m in _MUL]).astype(np.uint32)


def _keys(minima: np.ndarray, size_class) -> np.ndarray:
    """One 64-bit key per (class, permutation, minimum)."""
    tag = np.asarray(size_class, np.int64).astype(T.U) << T.U(40) | np.arange(PERMS, dtype=T.U)[:, None] << T.U(32)
    return T.mix(tag ^ minima.astype(T.U))


def _short(shingles: np.ndarray) -> np.ndarray:
    """Key of a single shingle."""
    return T.mix(shingles ^ T.U(0x5105_7A11))


def _place(keys: np.ndarray) -> np.ndarray:
    return (keys % T.U(FILTER_BITS)).astype(np.int64)


def item_keys(sets: DataFrame, percent: int) -> DataFrame:
    """Rows ``item, key, place`` of every item; ``sets`` has ``item, set`` (its distinct shingles)."""

    def run(batches):
        for batch in batches:
            for item, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = shingles.values.to_numpy().view(T.U)
                n = len(h)
                if n <= BLOCK:
                    keys = _short(np.sort(h)[: max(1, n + 1 + -percent * n // 100)])
                else:
                    keys = np.unique(_keys(_minima(h[:, None]), _class(np.array([n]))))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(keys), pa.int64()), pa.array(keys.view(np.int64)), pa.array(_place(keys))], ["item", "key", "place"])

    return sets.select("item", "set").mapInArrow(run, "item long, key long, place long")


def window_keys(docs: DataFrame, size: int, classes: list[int], bitmap: np.ndarray) -> DataFrame:
    """Distinct rows ``id, key`` of shingles and window minima that an item may share; ``docs`` has ``id, text``."""

    def run(batches):
        for batch in T.slices(batches, "text", 4 << 20):
            h, to = T.shingles(*T.words(batch.column(1)), size)
            n = np.diff(to)
            full = np.flatnonzero(n)
            if not len(full):
                continue
            blocks = -(-n[full] // BLOCK)
            first = np.concatenate([[0], np.cumsum(blocks)])
            at = np.arange(first[-1] * BLOCK).reshape(-1, BLOCK)
            at = np.minimum(at - np.repeat(first[:-1] * BLOCK - to[full], blocks)[:, None], np.repeat(to[full + 1] - 1, blocks)[:, None])
            low, row = _minima(h[at.T]), np.repeat(full, blocks)
            single = _short(h)
            at = np.flatnonzero(possible(bitmap, _place(single)))
            rows, keys = [np.searchsorted(to, at, "right") - 1], [single[at]]
            for c in range(max(classes, default=-1) + 1):
                if c:  # merge neighbouring blocks of a text; an odd last block stays
                    n = np.bincount(row, minlength=len(n))
                    order = np.arange(len(row)) - np.repeat((np.cumsum(n) - n)[n > 0], n[n > 0])
                    lead = np.flatnonzero(order % 2 == 0)
                    mate = np.minimum(lead + 1, len(row) - 1)
                    mate = np.where(row[mate] == row[lead], mate, lead)
                    low, row = np.minimum(low[:, lead], low[:, mate]), row[lead]
                if c in classes:
                    mate = np.minimum(np.arange(len(row)) + 1, len(row) - 1)
                    window = np.where(row[mate] == row, np.minimum(low, low[:, mate]), low)
                    k = _keys(window, c)
                    p, w = np.nonzero(possible(bitmap, _place(k)))
                    rows.append(row[w])
                    keys.append(k[p, w])
            rows, keys = np.concatenate(rows), np.concatenate(keys)
            if len(rows):
                pairs = np.unique(np.stack([rows.astype(T.U), keys]), axis=1)
                ids = batch.column(0).take(pa.array(pairs[0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(pairs[1].view(np.int64))], ["id", "key"])

    return docs.select("id", "text").mapInArrow(run, "id long, key long")


def contained_items(docs: DataFrame, items: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs ``doc_id, item_id, n_shingles, n_shared``: items of which a text holds the share ``threshold`` or more.

    Shingles of ``size`` words are counted as sets; an item with fewer words is
    one shingle, found in texts of the same few words only. Items without words
    and null or wordless texts match nothing. Texts of a repeated id are looked
    at together, items of a repeated id likewise; rows without id are left out.
    Other columns are not read.
    """
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    i = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))

    def sets(batches):
        for batch in T.slices(batches, "text"):
            h, to = T.shingles(*T.words(batch.column(1)), size)
            row = np.repeat(np.arange(len(to) - 1), np.diff(to))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], ["item", "shingle"])

    shingled = i.mapInArrow(sets, "item long, shingle long").distinct()
    sizes = cut(shingled.groupBy("item").agg(F.count(F.lit(1)).alias("n_shingles"), F.collect_list("shingle").alias("set")))
    percent = round(threshold * 100)
    keys = cut(item_keys(sizes, percent))
    # classes are few: one per doubling of the longest item
    longest = sizes.agg(F.max("n_shingles")).first()[0]
    classes = list(range(1, int(_class(np.array([longest or 1]))[0]) + 1))
    hits = window_keys(d, size, classes, key_filter(keys, "place"))
    few = keys.groupBy("key").agg(F.collect_set("item").alias("items"))
    pairs = salted_join(hits, few, "key", "id").select("id", F.explode("items").alias("item")).distinct()
    # a text meets all its candidate items at once; the sets of the items stay small
    wanted = cut(salted_join(pairs, sizes, "item", "id", salts=8).groupBy("id").agg(F.collect_list(F.struct("item", "set")).alias("w")))

    def verify(batches):
        for whole in batches:
            for batch in T.slices([whole], "text"):
                h, to = T.shingles(*T.words(batch.column(1)), size)
                out: list[tuple] = []
                for k, (doc, w) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                    own = np.unique(h[to[k] : to[k + 1]])
                    for x in w:
                        out.append((doc, x["item"], np.intersect1d(np.array(x["set"], np.int64).view(T.U), own).view(np.int64).tolist()))
                cols = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], ["doc_id", "item_id", "shared"])

    # only texts that have candidates are shuffled; no broadcast, or each task would hold two Python workers
    bitmap = key_filter(wanted.select(places("id").alias("p")), "p")
    few = only_possible(d, bitmap, "id")
    checked = few.join(wanted.hint("merge"), "id").select("id", "text", "w").mapInArrow(verify, "doc_id long, item_id long, shared array<long>")
    shared = checked.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).cast("long").alias("n_shared"))
    full = shared.join(sizes.select(F.col("item").alias("item_id"), "n_shingles"), "item_id")
    return full.where(100 * F.col("n_shared") >= percent * F.col("n_shingles")).select("doc_id", "item_id", "n_shingles", "n_shared")
