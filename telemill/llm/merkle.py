"""Merkle dataset manifest by bitmap ranks (operator 12).

Rows are leaves. Per group (source) they ascend by id; runs of ``ARITY``
neighbours become their hash, level by level, up to the group's subroot; the
subroots in order of their groups likewise up to the root.

1. Ids of a group are merged into a bitmap of 64-bit words (``bit_or`` in map
   tasks; absent words take no room). Word counts are summed by a popcount
   directory of four levels of 2^16 words, so no window sees more than 2^16 rows.
2. A leaf's position is its word's start plus the bits below its own: a join and
   a ``bit_count``, and no order of the rows. Only rows that share an id are
   ordered, by their digests, and only inside their word.
3. Positions key slot arrays of ``SLOTS`` leaves, each one row that a task
   reduces by ``LEVELS`` levels; the results are slots of the next arrays. Going
   down again, every array gets the siblings above it, so a leaf's whole proof is
   made where the leaf is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.common import numbered, salted_join
from telemill.operators.ordered import running
from telemill.session import cut

ARITY, LEVELS = 3, 6
SLOTS = ARITY**LEVELS
NO_ID = -(1 << 60)  # word of rows without an id, before all others
STEP = "array<struct<l: string, r: string>>"  # siblings left and right of a path, level by level


def _item(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (binary) of the columns' values, each ``-`` if null, else UTF-8 length, colon and text."""
    return F.unhex(F.sha2(F.concat(*[_item(c) for c in columns]), 256))


def leaves(docs: DataFrame, columns: Sequence[str], id_col: str, group_col: str, now: dict[str, Column] | None = None) -> DataFrame:
    """``grp, id, leaf, other``: a row's digest, and its digest with the columns of ``now`` replaced where that differs.

    Groups are texts with a mark ahead, so that null is one too and comes first.
    """
    now = now or {}
    changed = F.lit(False)
    for c, e in now.items():
        changed = changed | ~F.col(c).eqNullSafe(e)
    other = F.when(changed, digest([now.get(c, F.col(c)) for c in columns]))
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    return docs.select(group.alias("grp"), F.col(id_col).cast("long").alias("id"), digest([F.col(c) for c in columns]).alias("leaf"), other.alias("other"))


def bitmap(rows: DataFrame) -> DataFrame:
    """``grp, word, bits, n, start``: the words that hold ids, their rows and the number of rows before them."""
    words = cut(rows.groupBy("grp", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.count(F.lit(1)).alias("n")))
    level, totals = words, words.select("grp", F.col("word").alias("at"), "n")
    keys: list[str] = []
    for k in (1, 2, 3, 4):  # sums of 2^16 neighbours, then of 2^16 of those ...
        up = F.shiftright("at", 16) if k < 4 else F.lit(0).cast("long")
        parts = totals.withColumn("up", up)
        ahead = F.sum("n").over(Window.partitionBy("grp", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        keys.append(f"b{k}")
        level = level.withColumn("at", F.shiftright("word", 16 * (k - 1))).join(parts.select("grp", "at", F.coalesce(ahead, F.lit(0)).alias(f"b{k}")), ["grp", "at"]).drop("at")
        totals = parts.groupBy("grp", "up").agg(F.sum("n").alias("n")).withColumnRenamed("up", "at")
    return level.withColumn("start", sum((F.col(k) for k in keys), F.lit(0))).drop(*keys)


def positions(leaf_rows: DataFrame) -> DataFrame:
    """Add ``pos`` to stored ``grp, id, leaf, other``: rows without id first, then by id, rows of one id by their digest."""
    rows = leaf_rows.withColumns({"word": F.coalesce(F.shiftright("id", 6), F.lit(NO_ID)), "bit": F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int")})
    words = cut(bitmap(rows))
    single = F.col("n") == F.bit_count("bits")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit))")
    out = rows.join(words.where(single).drop("n"), ["grp", "word"]).select("grp", "id", "leaf", "other", (F.col("start") + below).alias("pos"))
    shared = words.where(~single).select(F.struct("grp", "word").alias("key"), "start")
    if not shared.limit(1).count():
        return out
    # several rows of an id: equal ones are counted per task, then numbered along their digests
    mixed = salted_join(rows.withColumn("key", F.struct("grp", "word")), shared, "key", "leaf")
    counted = cut(mixed.groupBy("grp", "word", "start", "bit", "id", "leaf", "other", F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("c")))
    chunk = F.col("bit").cast("long") * 65536 + F.conv(F.substring(F.hex("leaf"), 1, 4), 16, 10).cast("long")
    ahead = running(counted, ["grp", "word"], ["bit", "leaf", "task"], {"ahead": ("sum", F.col("c"))}, chunk, include_current=False)
    each = ahead.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    return out.unionByName(each.select("grp", "id", "leaf", "other", (F.col("start") + F.coalesce("ahead", F.lit(0)) + F.col("j")).alias("pos")))


def _arrays(nodes: DataFrame, sizes: DataFrame, fields: list[str]) -> DataFrame:
    """Slot arrays, one row each: ``grp, block, n, slots``; ``sizes`` is ``grp, n``."""
    block, slot = F.expr(f"pos div {SLOTS}"), F.col("pos") % SLOTS
    made = nodes.groupBy("grp", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(slot.cast("int").alias("slot"), *fields))).alias("slots"))
    return salted_join(made, sizes, "grp", "block")


def height(n: int) -> int:
    """Levels that a slot array of a group of ``n`` nodes is reduced by."""
    h = 0
    while h < LEVELS and ARITY**h < n:
        h += 1
    return h


def _hash(parts: Sequence[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def tree(slots: list[bytes], levels: int) -> list[list[bytes]]:
    """All levels of a slot array of hex digests, the last with one node."""
    out = [slots]
    for _ in range(levels):
        out.append([_hash(out[-1][i : i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


def path(levels: list[list[bytes]], slot: int) -> list[tuple[bytes, bytes]]:
    """Siblings left and right of a slot, level by level."""
    out = []
    for nodes in levels[:-1]:
        run = slot - slot % ARITY
        out.append((b"".join(nodes[run:slot]), b"".join(nodes[slot + 1 : run + ARITY])))
        slot //= ARITY
    return out


def _rows(batches, columns: list[str]):
    for batch in batches:
        for i in range(batch.num_rows):  # a slot array at a time
            row = batch.slice(i, 1)
            yield tuple(row.column(row.schema.get_field_index(c))[0].as_py() for c in columns)


def _levels(slots: list[dict], n: int) -> list[list[bytes]]:
    return tree([s["leaf"].hex().encode() for s in slots], height(n))


def _reduced(arrays: DataFrame) -> DataFrame:
    """The top node of every slot array: ``grp, pos, leaf, n``, with ``n`` nodes of that level in its group."""

    def run(batches):
        for grp, block, n, slots in _rows(batches, ["grp", "block", "n", "slots"]):
            top = _levels(slots, n)[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([block]), pa.array([bytes.fromhex(top.decode())]), pa.array([-(-n // SLOTS)])], ["grp", "pos", "leaf", "n"])

    return arrays.mapInArrow(run, "grp string, pos long, leaf binary, n long")


@dataclass
class Tree:
    """Slot arrays from the leaves up, and the top node of each group (``grp, leaf``)."""

    arrays: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame, sizes: DataFrame, fields: list[str]) -> Tree:
    """Reduce ``grp, pos, leaf`` (with ``fields`` to keep, ``leaf`` among them) group by group."""
    arrays, tops = [cut(_arrays(nodes, sizes, fields))], []
    while True:
        up = cut(_reduced(arrays[-1]))
        tops.append(up.where("n = 1").select("grp", "leaf"))
        rest = up.where("n > 1")
        if not rest.limit(1).count():
            break
        arrays.append(cut(_arrays(rest, rest.select("grp", "n").distinct(), ["leaf"])))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return Tree(arrays, out)


def _handed_down(arrays: DataFrame, above: DataFrame) -> DataFrame:
    """``grp, block, up``: for each slot of ``arrays`` the siblings on its way to the root; ``above`` has those of the arrays."""

    def run(batches):
        for grp, block, n, slots, up in _rows(batches, ["grp", "block", "n", "slots", "up"]):
            levels = _levels(slots, n)
            ups = [[{"l": a.decode(), "r": b.decode()} for a, b in path(levels, i)] + up for i in range(len(slots))]
            kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(slots)), pa.array([block * SLOTS + i for i in range(len(slots))], pa.int64()), pa.array(ups, kind)], ["grp", "block", "up"])

    return arrays.join(above, ["grp", "block"]).select("grp", "block", "n", "slots", "up").mapInArrow(run, f"grp string, block long, up {STEP}")


def _down(made: Tree, above: DataFrame) -> DataFrame:
    """``grp, block, up`` for the leaf arrays, given ``grp, up`` for the groups' top nodes.

    A group of fewer levels than others enters where it ended.
    """
    top = above.withColumn("block", F.lit(0).cast("long")).select("grp", "block", "up")
    now = None
    for arrays in reversed(made.arrays[1:]):
        enters = arrays.where(F.col("n") <= SLOTS).select("grp", "block").join(top, ["grp", "block"])
        here = enters if now is None else now.unionByName(enters)
        now = cut(_handed_down(arrays, here))
    enters = made.arrays[0].where(F.col("n") <= SLOTS).select("grp", "block").join(top, ["grp", "block"])
    return enters if now is None else now.unionByName(enters)


def proofs(leaf_rows: DataFrame) -> DataFrame:
    """Per leaf: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``leaf_rows`` is ``grp, id, leaf, other`` of :func:`leaves`. The proof is the
    hash of all siblings on the way to the root; ``folded_root`` follows from
    ``other``, or ``leaf`` where that is null, and the siblings. Rows without id
    come first in their group, rows of one id by their digest, equal rows are
    leaves of their own. An empty table has no root and no rows.
    """
    stored = cut(leaf_rows)
    sizes = cut(stored.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    groups = build(positions(stored), sizes, ["id", "leaf", "other"])
    subroots = cut(numbered(groups.tops, [F.col("grp")], "pos"))
    one = subroots.select(F.lit("").alias("grp"), "pos", "leaf", F.col("grp").alias("of"))
    total = one.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    whole = build(one, cut(total), ["leaf", "of"])
    root = whole.tops.first()
    if root is None:
        return stored.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean"))])
    root_hex = bytes(root["leaf"]).hex()
    start = whole.tops.select("grp", F.array().cast(STEP).alias("up"))

    def siblings(batches):
        kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
        for n, slots, up in _rows(batches, ["n", "slots", "up"]):
            levels = _levels(slots, n)
            ups = [[{"l": a.decode(), "r": b.decode()} for a, b in path(levels, i)] + up for i in range(len(slots))]
            yield pa.RecordBatch.from_arrays([pa.array([s["of"] for s in slots]), pa.array([s["leaf"].hex() for s in slots]), pa.array(ups, kind)], ["grp", "subroot", "up"])

    above = whole.arrays[0].join(_down(whole, start), ["grp", "block"]).select("n", "slots", "up")
    above = cut(above.mapInArrow(siblings, f"grp string, subroot string, up {STEP}"))

    def verify(batches):
        for n, slots, up, subroot in _rows(batches, ["n", "slots", "up", "subroot"]):
            levels = _levels(slots, n)
            rest = [(s["l"].encode(), s["r"].encode()) for s in up]
            out = []
            for i, s in enumerate(slots):
                node = s["leaf"] if s["other"] is None else s["other"]
                x, seen = node.hex().encode(), sha256()
                for a, b in path(levels, i) + rest:
                    seen.update(a + b)
                    x = _hash((a, x, b))
                folded = x.decode()
                out.append((s["id"], s["leaf"].hex(), subroot, root_hex, seen.hexdigest(), folded, folded == root_hex))
            names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.bool_() if k == 6 else pa.string()) for k, c in enumerate(zip(*out, strict=True))], names)

    full = salted_join(groups.arrays[0].join(_down(groups, above.select("grp", "up")), ["grp", "block"]), above.select("grp", "subroot"), "grp", "block")
    return full.select("n", "slots", "up", "subroot").mapInArrow(verify, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
