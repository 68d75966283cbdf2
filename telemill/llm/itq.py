"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables (operator 9).

1. On a bounded sample, PCA and a learned rotation give balanced binary codes.
2. Codes are cut into substrings, one Hamming table each. Every vector enters its
   bucket and the buckets one bit away, so two vectors meet whenever one of
   their substrings differs in at most two bits. Substring length follows the
   number of rows and the number of tables follows from the wanted recall.
3. Vectors within half the threshold angle of a bucket's first vector form a
   bundle around that pivot; all of a bundle are linked to each other by the
   triangle inequality, without listing their pairs. A vector without such a
   pivot is a bundle of its own.
4. Bundles that meet in a bucket are compared by their pivots' angle: far apart,
   linked throughout, or mixed. Only in mixed pairs single vectors are compared,
   again first with the other pivot, and one by one in what remains open.
"""

from __future__ import annotations

from math import acos, ceil, comb, cos, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import components, salted_join
from telemill.session import cut

SAMPLE = 10_000
MISS = 0.01  # chance that a pair exactly at the threshold meets in no table
EDGE = 1e-7  # radians; closer calls are settled by the cosine itself


def fit_rotations(x: np.ndarray, bits: int, codes: int, steps: int = 30) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mean and, per code, the projection of centred vectors whose signs are the bits."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    v = centred @ axes
    out = []
    for seed in range(codes):
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(steps):  # alternate between the nearest corners and the rotation that brings the data to them
            a, _, b = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (a @ b).T
        out.append(axes @ r)
    return mean, out


def plan(rows: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits per substring and number of tables."""
    bits = min(32, max(16, ceil(log2(max(rows, 2)))))
    flip = acos(threshold) / pi
    meets = sum(comb(bits, k) * flip**k * (1 - flip) ** (bits - k) for k in range(3))
    return bits, ceil(log(miss) / log(1 - meets))


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros, and which rows are valid."""
    out, valid = np.zeros((len(column), width)), np.zeros(len(column), bool)
    for i, v in enumerate(column):
        x = v.values if v.is_valid else None
        if x is not None and len(x) and not x.null_count:
            a = np.asarray(x, float)
            if np.isfinite(a).all():
                a = a / max(np.abs(a).max(), 1e-300)  # keeps squares in range
                n = np.linalg.norm(a)
                if n > 0.5:
                    out[i, : len(a)], valid[i] = a / n, True
    return out, valid


def _dots(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), float).reshape(len(c), -1) for c in (a, b))
    return np.einsum("ij,ij->i", x, y)


def _with_cosine(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Replace two binary vector columns by their cosine ``cos``."""
    kept = [c for c in pairs.columns if c not in (left, right)]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                of = lambda c: batch.column(batch.schema.get_field_index(c))
                yield pa.RecordBatch.from_arrays([*[of(c) for c in kept], pa.array(_dots(of(left), of(right)))], [*kept, "cos"])

    return pairs.select(*kept, left, right).mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in pairs.select(*kept).dtypes] + ["cos double"]))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE) -> DataFrame:
    """Per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared within equal non-null labels and equal length. Null and
    zero vectors and those with null or non-finite components link with nothing.
    A repeated id counts once, with its smallest (label, vector); a null id is
    left out. Other columns are not read.
    """
    limit = acos(threshold)
    src = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    one = src.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    rows, width = one.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    width = max(1, width)
    bits, tables = plan(rows, threshold)
    some = src.where(F.col("v").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    x, ok = _units(some, width)
    code_bits = min(width, 64)
    each = max(1, code_bits // bits)  # substrings per code
    bits = min(bits, code_bits)
    mean, axes = fit_rotations(x[ok], code_bits, ceil(tables / each))
    seed = np.random.default_rng(9).integers(1, 1 << 62, tables)

    def encode(batches):
        for batch in batches:
            u, valid = _units(batch.column(2), width)
            valid &= np.array(batch.column(1).is_valid().to_pylist(), bool)
            signs = [(u - mean) @ a >= 0 for a in axes]
            first = np.packbits(np.pad(signs[0], ((0, 0), (0, 64 - code_bits))), axis=1, bitorder="little").view(np.int64).ravel()
            keys = []
            for t in range(tables):
                part = signs[t // each][:, (t % each) * bits : (t % each + 1) * bits]
                value = part @ (1 << np.arange(bits, dtype=np.int64))
                near = np.concatenate([value[:, None], value[:, None] ^ (1 << np.arange(bits, dtype=np.int64))], axis=1)
                keys.append(near + seed[t])
            keys = np.stack(keys, axis=1).reshape(len(u), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            dims = np.array([len(v.values) if v.is_valid else 0 for v in batch.column(2)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims), pa.array(valid), pa.array([r.tobytes() for r in u], pa.binary()), pa.array(first), lists], ["id", "label", "dim", "valid", "unit", "code", "keys"])

    coded = cut(one.select("id", "label", "v").mapInArrow(encode, "id long, label string, dim long, valid boolean, unit binary, code long, keys array<long>"))
    live = coded.where("valid")
    bucket = lambda key: F.xxhash64("label", "dim", key)
    units = live.select("id", "unit")

    # bundles
    own = F.expr(f"transform(sequence(0, {tables - 1}), t -> keys[t * {bits + 1}])")
    placed = live.select("id", "label", "dim", F.explode(own).alias("key")).select("id", bucket("key").alias("bucket"))
    pivots = placed.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket", "pivot")
    near = salted_join(placed, pivots, "bucket", "id").where("pivot != id").select("id", "pivot").distinct()
    near = salted_join(near.join(units, "id"), units.select(F.col("id").alias("pivot"), F.col("unit").alias("pv")), "pivot", "id", salts=8)
    close = _with_cosine(near, "unit", "pv").where(F.col("cos") >= cos(limit / 2 - 10 * EDGE)).groupBy("id").agg(F.min(F.struct("pivot", "cos")).alias("p"))
    angle = F.acos(F.least(F.coalesce("p.cos", F.lit(1.0)), F.lit(1.0)))
    member = cut(live.select("id", "unit", "code").join(close, "id", "left").select("id", F.coalesce("p.pivot", "id").alias("bundle"), angle.alias("alpha"), "unit", "code"))
    bundle = cut(member.groupBy("bundle").agg(F.count(F.lit(1)).alias("size"), F.max("alpha").alias("eps")).join(units.select(F.col("id").alias("bundle"), F.col("unit").alias("pivot")), "bundle"))

    # bundles that meet in a bucket
    entry = live.select("id", "label", "dim", "code", F.explode("keys").alias("key")).select("id", "code", bucket("key").alias("bucket"))
    entry = entry.join(member.select("id", "bundle"), "id").groupBy("bucket", "bundle").agg(F.min("code").alias("code"), F.count_distinct("code").alias("many"))
    flip = limit / pi
    far = code_bits * flip + 5 * (code_bits * flip * (1 - flip)) ** 0.5
    a, b = (entry.select("bucket", F.col("bundle").alias(x), F.col("code").alias(f"c{x}"), F.col("many").alias(f"m{x}")) for x in "pq")
    # between two single codes the Hamming distance already tells; wider bundles are compared by angle
    meet = a.join(b, "bucket").where((F.col("p") < F.col("q")) & ((F.col("mp") > 1) | (F.col("mq") > 1) | (F.bit_count(F.col("cp").bitwiseXOR(F.col("cq"))) <= far))).select("p", "q").distinct()
    side = lambda x: bundle.select(F.col("bundle").alias(x), F.col("pivot").alias(f"v{x}"), F.col("eps").alias(f"e{x}"), F.col("size").alias(f"n{x}"))
    gamma = F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0)))
    pairs = _with_cosine(salted_join(salted_join(meet, side("p"), "p", "q", salts=8), side("q"), "q", "p", salts=8), "vp", "vq")
    pairs = cut(pairs.withColumn("g", gamma).where(F.col("g") <= limit + F.col("ep") + F.col("eq") + EDGE))
    single = (F.col("ep") == 0) & (F.col("eq") == 0)
    # two bundles without width are copies of their pivots: the cosine itself decides
    whole = pairs.where(F.when(single, F.col("cos") >= threshold).otherwise(F.col("g") + F.col("ep") + F.col("eq") <= limit - EDGE))
    mixed = pairs.where(~single & (F.col("g") + F.col("ep") + F.col("eq") > limit - EDGE))
    both = lambda df: df.select(F.col("p").alias("of"), F.col("q").alias("to"), F.col("nq").alias("n"), F.col("eq").alias("e")).unionByName(df.select(F.col("q").alias("of"), F.col("p").alias("to"), F.col("np").alias("n"), F.col("ep").alias("e")))
    by_bundle = both(whole).groupBy("of").agg(F.sum("n").alias("n"))

    # mixed pairs: members against the other pivot, then against what that leaves open
    one_by_one = both(mixed).join(member.select("id", F.col("bundle").alias("of"), "unit"), "of")
    one_by_one = one_by_one.join(bundle.select(F.col("bundle").alias("to"), F.col("pivot").alias("pv")), "to")
    beta = cut(_with_cosine(one_by_one.select("id", "of", "to", "n", "e", "unit", "pv"), "unit", "pv").withColumn("g", gamma).where(F.col("g") - F.col("e") <= limit + EDGE))
    sure = beta.where(F.col("g") + F.col("e") <= limit - EDGE)
    unsure = beta.where(F.col("g") + F.col("e") > limit - EDGE).join(units, "id").select("id", "of", "to", "g", "unit")
    other = member.select(F.col("bundle").alias("to"), F.col("id").alias("jd"), "alpha", F.col("unit").alias("ju"))
    open_ = unsure.join(other, "to").where(F.abs(F.col("g") - F.col("alpha")) <= limit + EDGE)
    tested = cut(_with_cosine(open_.select("id", "jd", "of", "to", "unit", "ju"), "unit", "ju").where(F.col("cos") >= threshold).groupBy("id", "of", "to").agg(F.count(F.lit(1)).alias("n")))
    links = sure.select("id", "n").unionByName(tested.select("id", "n")).groupBy("id").agg(F.sum("n").alias("extra"))
    joined = whole.select("p", "q").unionByName(sure.select(F.col("of").alias("p"), F.col("to").alias("q"))).unionByName(tested.select(F.col("of").alias("p"), F.col("to").alias("q")))
    label = components(joined, "p", "q")
    final = member.select("id", "bundle").join(bundle.select("bundle", "size"), "bundle").join(by_bundle.withColumnRenamed("of", "bundle"), "bundle", "left").join(label.withColumnRenamed("id", "bundle"), "bundle", "left")
    final = cut(final.select("id", F.coalesce("component_id", "bundle").alias("group"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n")).join(links, "id", "left").select("id", "group", (F.col("n") + F.coalesce("extra", F.lit(0))).alias("n")))
    lowest = final.groupBy("group").agg(F.min("id").alias("component_id"))
    out = coded.select("id").join(salted_join(final, lowest, "group", "id"), "id", "left")
    cid = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), (F.col("id") == cid).alias("kept"))
