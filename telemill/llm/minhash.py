"""MinHash near-duplicates with sequential Bayesian verification (operator 3).

1. Every text becomes a set of word shingles and a signature of ``PERMS``
   minima. Texts with equal sets form one class; only one of a class goes on.
2. Signatures are cut into bands; equal bands put classes into one bucket.
3. In a bucket every class is compared with the bucket's hub, not with all
   others. A second round compares what the hubs did not connect: members
   outside a bucket's largest component against all members of other ones,
   in tiles where the bucket is large.
4. A candidate pair is compared on batches of signature positions. With a
   uniform prior and m of n equal positions the similarity is distributed as
   Beta(m + 1, n - m + 1); a pair is dropped once the probability of reaching the
   threshold is below ``MISS``.
5. Survivors are confirmed on the full shingle sets of their whole texts.
6. Linked classes form components by their smallest id.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm import text as T
from telemill.llm.common import components, key_filter, only_possible, places, salted_join, small_batches
from telemill.session import cut

PERMS, BANDS, ROWS = 128, 25, 5  # a pair at 0.8 shares no band with a chance of 5e-5
BATCH = 16  # signature positions per verification step
MISS = 1e-6  # chance to drop a true pair in one step
SMALL, TILE = 64, 256  # members of a bucket compared in one row, members of a tile of larger ones
_MUL = (np.random.default_rng(3).integers(0, 1 << 32, PERMS, dtype=np.uint32) | 1).astype(np.uint32)
_ADD = np.random.default_rng(4).integers(0, 1 << 32, PERMS, dtype=np.uint32)


def signatures(shingles: np.ndarray, bounds: np.ndarray, perms: int = PERMS) -> np.ndarray:
    """Minima of ``perms`` hash functions per row; a row without shingles keeps the largest value."""
    n = np.diff(bounds)
    out = np.full((len(n), perms), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    width = 16  # rows are padded to blocks of this many shingles, so that minima run over whole columns
    blocks = -(-n[full] // width)
    to = np.concatenate([[0], np.cumsum(blocks)])
    at = np.arange(to[-1] * width).reshape(-1, width)
    at = np.minimum(at - np.repeat(to[:-1] * width - bounds[full], blocks)[:, None], np.repeat(bounds[full + 1] - 1, blocks)[:, None])
    h = shingles[at.T]  # width x blocks
    low, high = (h & T.U(0xFFFFFFFF)).astype(np.uint32), (h >> T.U(32)).astype(np.uint32)
    for k in range(perms):
        x = low * _MUL[k] + (high ^ _ADD[k])
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[full, k] = np.minimum.reduceat(x.min(axis=0), to[:-1])
    return out


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest equal positions of n with which P(similarity >= threshold) is at least ``miss``."""
    # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def plausible(a: np.ndarray, b: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Rows of two signature matrices that survive all sequential steps."""
    alive, same = np.arange(len(a)), np.zeros(len(a), np.int64)
    for start in range(0, a.shape[1], BATCH):
        end = min(start + BATCH, a.shape[1])
        same = same + (a[alive, start:end] == b[alive, start:end]).sum(axis=1)
        keep = same >= least_matches(end, threshold, miss)
        alive, same = alive[keep], same[keep]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes per row."""
    h, to = T.shingles(*T.words(texts), size)
    row = np.repeat(np.arange(len(to) - 1), np.diff(to))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(to)))


def profile(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Per row: id, set size, 128-bit digest of the set, signature and band keys."""

    def run(batches):
        for batch in T.slices(batches, "text"):
            h, to = _sets(batch.column(1), size)
            sig = signatures(h, to)
            keys = np.stack([T.mix(h), T.mix(h ^ T.BASE)], axis=1)
            total = np.concatenate([np.zeros((1, 2), T.U), np.cumsum(keys, axis=0, dtype=T.U)])
            digest = total[to[1:]] - total[to[:-1]]
            bands = np.zeros((len(sig), BANDS), T.U)
            for r in range(ROWS):
                bands = T.mix(bands * T.BASE + sig[:, r : BANDS * ROWS : ROWS])
            flat = pa.array(bands.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), pa.array(np.diff(to)), pa.array([x.tobytes() for x in digest], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS), flat),
                ],
                ["id", "n", "digest", "sig", "bands"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, n long, digest binary, sig binary, bands array<long>")


def _survivors(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) that keep a chance of reaching the threshold."""

    def run(batches):
        for x in batches:
            if x.num_rows:
                keep = plausible(_matrix(x.column(2)), _matrix(x.column(3)), threshold)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep))

    own = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    hub = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    sized = salted_join(pairs.join(own, "b"), hub, "a", "b", salts=8).where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _of(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` that may have one of ``ids`` (column ``id``): the texts of all others are not shuffled."""
    return only_possible(docs, key_filter(ids.select(places("id").alias("p")), "p"), id_col)


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold; ``pairs`` is a stored table.

    A hub's text is repeated once per 256 of its partners, so that no task gets
    all partners of a hub.
    """
    percent = round(threshold * 100)

    def run(batches):
        for whole in batches:
            for x in T.slices([whole], "ta", 4 << 20):
                sets = [_sets(x.column(i), size) for i in (2, 3)]
                keep = []
                for i in range(x.num_rows):
                    p, q = (h[to[i] : to[i + 1]] for h, to in sets)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    src = docs.select(F.col(id_col).cast("long").alias("b"), F.col(text_col).alias("tb"))
    texts, heads = (_of(src, pairs.select(F.col(c).alias("id")), "b") for c in ("b", "a"))
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("int").alias("fan"))
    dealt = salted_join(pairs, fan, "a", "b").select("a", "b", F.pmod(F.xxhash64("b", F.lit(7)), F.col("fan")).cast("int").alias("s"))
    hubs = dealt.select("a", "s").distinct().join(heads.select(F.col("b").alias("a"), F.col("tb").alias("ta")), "a")
    # no broadcast, or each task would hold a second Python worker for what it confirms
    full = dealt.join(texts, "b").join(hubs.hint("merge"), ["a", "s"]).select("a", "b", "ta", "tb")
    return full.mapInArrow(run, "a long, b long")


def _fields(members: list[dict]):
    sig = np.frombuffer(b"".join(r["sig"] for r in members), np.uint32).reshape(len(members), -1)
    return sig, *[np.array([r[k] for r in members]) for k in ("id", "n", "label")]


def _first_common_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = (a[:, : BANDS * ROWS] == b[:, : BANDS * ROWS]).reshape(len(a), BANDS, ROWS).all(axis=2)
    return same.argmax(axis=1)


def _open(p: list[dict], q: list[dict], threshold: float):
    """Pairs of members of different components that keep a chance: their places, and what ``_fields`` says."""
    x, y = _fields(p), _fields(q)
    ok = (x[3][:, None] != y[3]) & (np.minimum(x[2][:, None], y[2]) >= threshold * np.maximum(x[2][:, None], y[2]))
    i, j = np.nonzero(ok)
    keep = plausible(x[0][i], y[0][j], threshold)
    return i[keep], j[keep], x, y


def _leftover_small(live: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Surviving pairs between components in buckets of at most ``SMALL`` members."""

    def run(batches):
        for batch in batches:
            for m in batch.column(0).to_pylist():
                i, j, x, y = _open(m, m, threshold)
                a, b = x[1][i], y[1][j]
                yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], ["a", "b"])

    one = live.join(classes.select("id", "n", "sig"), "id").groupBy("bucket").agg(F.collect_list(F.struct("id", "n", "label", "sig")).alias("m"))
    return one.select("m").mapInArrow(run, "a long, b long").distinct()


def _leftover_large(live: DataFrame, classes: DataFrame, docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links between components in larger buckets, enough of them to join what belongs together.

    Members are dealt into tiles of bounded size that carry their texts. A task
    compares two tiles and confirms pairs at once, the likeliest first, until
    the components of a pair are joined; no list of pairs is made. A pair that
    meets in several buckets is looked at in the first.
    """
    weight = live.join(classes.select("id", "n", "sig"), "id")
    tiles = weight.groupBy("bucket").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / (TILE * 1000))).alias("tiles"))
    dealt = salted_join(weight, tiles, "bucket", "id").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    full = dealt.join(_of(docs.select("id", "text"), live.select("id"), "id"), "id")
    tile = cut(full.groupBy("bucket", "band", "tile", F.expr("label = main").alias("main")).agg(F.collect_list(F.struct("id", "n", "label", "sig", "text")).alias("m")))
    few = tile.where("not main").select("bucket", "band", F.col("tile").alias("t"), F.col("m").alias("p"))
    many = tile.select("bucket", F.col("tile").alias("u"), F.col("main").alias("um"), F.col("m").alias("q"))
    plan = few.select("bucket", "t").join(many.select("bucket", "u", "um"), "bucket").where("um or t <= u")
    work = plan.join(few, ["bucket", "t"]).join(many, ["bucket", "u", "um"]).select("band", "p", "q")
    percent = round(threshold * 100)

    def run(batches):
        for batch in batches:
            for band, p, q in zip(*(batch.column(k).to_pylist() for k in range(3))):
                i, j, x, y = _open(p, q, threshold)
                first = _first_common_band(x[0][i], y[0][j]) == band
                i, j = i[first], j[first]
                order = np.argsort(-(x[0][i] == y[0][j]).sum(axis=1), kind="stable") if len(i) else i
                joined: dict[int, int] = {}

                def root(v: int, joined=joined) -> int:
                    while v in joined:
                        v = joined[v]
                    return v

                sets: dict[int, np.ndarray] = {}

                def own(r: dict, sets=sets) -> np.ndarray:
                    if r["id"] not in sets:
                        sets[r["id"]] = _sets(pa.array([r["text"]], pa.string()), size)[0]
                    return sets[r["id"]]

                out = []
                for k in order:
                    r, t = p[i[k]], q[j[k]]
                    if root(r["label"]) == root(t["label"]):
                        continue
                    a, b = own(r), own(t)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        joined[root(r["label"])] = root(t["label"])
                        out.append(sorted((r["id"], t["id"])))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return work.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Null and wordless texts have no shingles and are linked with nothing. Rows
    that repeat an id count once: size and candidates are those of the text whose
    set has the smallest digest, and a link is confirmed if any of the id's texts
    reaches the threshold. A row without id is left out. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    one = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    seen = cut(profile(one, "id", "text", size))
    # a repeated id keeps one set; the texts are told apart by digest
    per_id = seen.groupBy("id").agg(F.min(F.struct("digest", "n")).alias("x"), F.count(F.lit(1)).alias("rows")).select("id", "x.digest", "x.n", "rows")
    reps = per_id.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = cut(reps.join(seen.select(F.col("id").alias("rep"), "digest", "sig", "bands"), ["rep", "digest"]).select(F.col("rep").alias("id"), "n", "digest", "sig", "bands").dropDuplicates(["id"]))
    buckets = classes.select("id", F.posexplode("bands").alias("band", "h")).select("id", "band", F.xxhash64("band", "h").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket", "hub")
    members = cut(salted_join(buckets, hubs, "bucket", "id"))
    pairs = cut(_survivors(members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), classes, threshold))
    links = cut(_confirmed(pairs, one, "id", "text", size, threshold))
    label = components(links)
    labelled = members.select("bucket", "band", "id").join(label.select("id", F.col("component_id").alias("label")), "id", "left").select("bucket", "band", "id", F.coalesce("label", "id").alias("label"))
    sizes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("c").alias("size")).where("labels > 1").drop("labels")
    live = cut(salted_join(labelled, mixed, "bucket", "id"))
    rest = cut(_leftover_small(live.where(F.col("size") <= SMALL), classes, threshold).join(pairs, ["a", "b"], "left_anti"))
    more = _confirmed(rest, one, "id", "text", size, threshold)
    more = cut(more.unionByName(_leftover_large(live.where(F.col("size") > SMALL), classes, one, size, threshold)))
    label = components(links.unionByName(more)) if more.take(1) else label
    of_class = reps.join(label.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select("digest", F.coalesce("component_id", "rep").alias("c"))
    out = salted_join(per_id, of_class, "digest", "id", how="left")
    cid = F.coalesce("c", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), cid.alias("component_id"), (F.col("id") == cid).alias("kept"))
