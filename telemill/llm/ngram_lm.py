"""Language-model scoring with a sharded Elias-Fano n-gram trie (operator 5).

1. Texts become blocks of word numbers (a few MB each), stored once.
2. Each block sends its distinct n-grams of every order, with their counts in
   training texts, to shards chosen by a hash of these bits. However
   frequent a word is, it reaches a shard once per block, so no shard is hot.
3. A shard sums the counts, builds its trie (contexts, pointers, children, and an
   8-bit code of the n-gram's probability), maps it from a file and answers the
   n-grams that the blocks asked for. Order 1 keeps exact counts.
4. Blocks meet their answers. One pass gathers, per order and size class of the
   context count, how often a training token's n-gram is seen elsewhere in
   training; these fractions are the interpolation weights.
5. A last pass scores: p(w | u v) = a * c(u v w)/c(u v) + (1 - a) * p(w | v), ending
   in the additively smoothed unigram; a depends on the class of c(u v).

The end token also stands before the first word. An n-gram of a higher order is
found under ``BITS`` bits: some of its context's hash and, below them, more of a hash
of the whole n-gram. Blocks send it with the latter above, since a shard is a range of
that: within it numbers are small and take fewer bits. An unseen n-gram is taken for a seen one with a chance of
k / 2^60 by k seen n-grams of other contexts, however many of them end in its word,
and of k / 2^40 by k seen ones of its own context.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm import elias_fano as ef
from telemill.llm import text as T
from telemill.session import fresh_table

U = np.uint64
BITS = (20, 40)  # of a context and of the whole n-gram below it
END = U(0x0E0F_0E0F_0E0F_0E0F)
BLOCK = 16 << 20  # bytes of text per block
PER_BUCKET = 4  # blocks per bucket of the stored tables
SHARD = 1_500_000  # tokens per shard
SLICE = 1 << 18  # tokens whose n-grams are hashed at a time
CLASSES = 44
_STEPS = np.concatenate([np.arange(129.0), 128 * 2 ** (np.arange(1, 127) / 4)])  # codebook: counts exact to 128, then quarter powers


def _squeeze(a: np.ndarray) -> bytes:
    return np.int64(a.nbytes).tobytes() + pa.compress(a.tobytes(), "zstd", asbytes=True)


def _expand(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int(np.frombuffer(b[:8], np.int64)[0]), "zstd", asbytes=True), dtype)


def _sequence(row: dict) -> np.ndarray:
    """Vocabulary places of all tokens of a block; stored byte plane by byte plane."""
    return np.ascontiguousarray(_expand(row["seq"], np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _packed(counts: np.ndarray) -> bytes:
    """Counts in one byte each if all fit."""
    small = not len(counts) or counts.max() < 256
    return bytes([1 if small else 4]) + _squeeze(counts.astype(np.uint8 if small else np.uint32))


def _numbers(b: bytes) -> np.ndarray:
    return _expand(b[1:], np.uint8 if b[0] == 1 else np.uint32)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Nearest code of each count on a log scale; 0 only for 0."""
    big = np.rint(128 + 4 * np.log2(np.maximum(counts, 1) / 128))
    return np.minimum(np.where(counts <= 128, counts, big), 254).astype(np.uint8)


def blocks(docs: DataFrame, id_col: str, text_col: str, training: Column) -> DataFrame:
    """One row per block: ids, training flags and lengths of its texts, its vocabulary, its tokens as vocabulary places."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in T.slices(batches, "text", BLOCK):
            h, to = T.words(batch.column(1))
            vocabulary, place, count = np.unique(np.append(h, END), return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            vocabulary, place = vocabulary[order], rank[place]
            n = np.diff(to)
            tokens = np.insert(place[:-1], to[1:], place[-1]).astype(np.uint32)
            flags = np.array(batch.column(2).to_pylist(), np.uint8)
            ids = batch.column(0).cast(pa.int64())
            known = np.array(ids.is_valid().to_pylist(), np.uint8)
            row = [number, int((n + 1).sum()), int((n + 1)[flags == 1].sum()), _squeeze(ids.fill_null(0).to_numpy()), _squeeze(known), _squeeze(flags), _squeeze(n + 1), _squeeze(vocabulary), _squeeze(np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T))]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", "tokens", "train", "ids", "known", "flags", "lengths", "words", "seq"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).cast("int").alias("t"))
    return src.mapInArrow(run, "block long, tokens long, train long, ids binary, known binary, flags binary, lengths binary, words binary, seq binary")


def _grams(words: np.ndarray, seq: np.ndarray, lengths: np.ndarray, order: int):
    """Key of the n-gram that ends at each token, and where the text is long enough for it."""
    real = np.ones(len(seq), bool)
    if order == 1:
        return words[seq], real
    starts = np.cumsum(lengths) - lengths
    for j in range(order - 2):
        real[starts[lengths > j] + j] = False
    first = [starts[lengths >= k] + k - 1 for k in range(1, order)]  # where the word k before is an end token
    out = np.empty(len(seq), U)

    def before(a: int, b: int, k: int) -> np.ndarray:
        w = np.full(b - a, END)
        w[max(0, k - a) :] = words[seq[max(0, a - k) : max(0, b - k)]]
        at = first[k - 1]
        w[at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a] = END
        return w

    c, b = BITS
    for i in range(0, len(seq), SLICE):
        j = min(i + SLICE, len(seq))
        context = before(i, j, 1)
        for k in range(2, order):
            context = T.mix(before(i, j, k) * T.BASE + context)
        context = T.mix(context)
        whole = T.mix(context * T.BASE + words[seq[i:j]])
        out[i:j] = (context >> U(64 - c) << U(b)) | (whole >> U(64 - b))
    return out, real


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them, in less memory than ``np.unique``."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], place


def _turned(keys: np.ndarray) -> np.ndarray:
    """Keys with the bits of the whole n-gram above those of its context."""
    c, b = BITS
    return (keys & U((1 << b) - 1)) << U(c) | keys >> U(b)


def _turned_back(keys: np.ndarray) -> np.ndarray:
    c, b = BITS
    return (keys & U((1 << c) - 1)) << U(b) | keys >> U(c)


def _bits(order: int) -> int:
    return 64 if order == 1 else sum(BITS)


def _starts(bits: int, shards: int) -> np.ndarray:
    """Least number of every shard: equal parts of all numbers of ``bits`` bits."""
    return np.array([-(-(s << bits) // shards) for s in range(shards)], U)


def _within(bits: int, shards: int) -> int:
    """Bits of a number in its shard, counted from the shard's start."""
    return bits - (shards.bit_length() - 1)


def _asked(row: dict, order: int, shards: int, counted: bool = True):
    """Distinct keys of a block, sorted, with training counts (if ``counted``); bounds of the shards; each token's place among the keys."""
    seq, lengths = _sequence(row), _expand(row["lengths"], np.int64)
    words = _expand(row["words"], np.uint64)
    if order == 1:
        real = np.ones(len(seq), bool)
        rank = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[rank] = np.arange(len(words))
        keys, place = words[rank], place[seq]
    else:
        key, real = _grams(words, seq, lengths, order)
        key = _turned(key if real.all() else key[real])
        keys, place = _distinct(key)
        del key
    counts = None
    if counted:
        flags = np.repeat(_expand(row["flags"], np.uint8), lengths)[real]
        counts = np.bincount(place, weights=flags, minlength=len(keys)).astype(np.int64)
    return keys, counts, np.append(np.searchsorted(keys, _starts(_bits(order), shards)), len(keys)), place, real


def _sent(row: dict, order: int, shards: int) -> tuple[list[int], list[tuple[bytes, bytes]]]:
    """Shards that a block asks, and its keys, counted from the shard's start, and counts for each."""
    keys, counts, to, _, _ = _asked(row, order, shards)
    starts, bits = _starts(_bits(order), shards), _within(_bits(order), shards)
    some = [s for s in range(shards) if to[s] < to[s + 1]]
    return some, [(ef.encode(keys[to[s] : to[s + 1]] - starts[s], bits), _packed(counts[to[s] : to[s + 1]])) for s in some]


def _row(table, i: int = 0) -> dict:
    return {n: table.column(n)[i].as_py() for n in table.schema.names}


def _answer_shard(order: int, shard: int, shards: int, asked: pa.Table) -> pa.Table:
    """Sum the counts of one shard, build and map its trie, and answer every block."""
    bits = _bits(order)
    start = _starts(bits, shards)[shard]
    keys = [ef.Sequence(b).all() + start for b in asked.column("keys").to_pylist()]
    if order > 1:
        keys = [_turned_back(k) for k in keys]
    kept, at = _distinct(np.concatenate(keys))
    total = np.zeros(len(kept), np.int64)
    for place, b in zip(np.split(at, np.cumsum([len(k) for k in keys])[:-1]), asked.column("counts").to_pylist()):
        total[place] += _numbers(b)  # a block's keys are distinct
    del at, place
    kept, total = kept[total > 0], total[total > 0]
    split = U(32 if order == 1 else BITS[1])
    mask = (U(1) << split) - U(1)
    if order == 1:  # the whole hash is split into two levels; codes are unused because exact counts are answered
        data = build = ef.build_trie(kept >> split, kept & mask, np.ones(len(kept)), 32, 32)
    else:
        data = build = ef.build_trie(kept >> split, kept & mask, quantise(total), bits - int(split), int(split))
    answers = []
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "levels")
        with open(path, "wb") as f:
            f.write(build)
        trie = ef.Trie(np.memmap(path, np.uint8, "r"))
        for k in keys:
            code = trie.lookup(k >> split, k & mask)
            if order == 1:
                place = np.minimum(np.searchsorted(kept, k), max(len(kept) - 1, 0))
                answers.append(_squeeze(np.where(code > 0, total[place] if len(kept) else 0, 0).astype(np.int64)))
            else:
                answers.append(_squeeze(code))
        del trie, data
    first = int(np.argmin(asked.column("block").to_numpy()))
    distinct = [len(kept) if order == 1 and i == first else 0 for i in range(len(keys))]
    return pa.table({"block": asked.column("block"), "gram": asked.column("gram"), "shard": asked.column("shard"), "answer": pa.array(answers, pa.binary()), "distinct": pa.array(distinct, pa.int64())})


def _token_counts(row: dict, parts: dict, order: int, shards: int):
    """Order by order, (count of the n-gram, count of its context) at every token; ``parts`` are the answers by (order, shard).

    One order's arrays are made when it is asked for, so only two orders are held.
    """
    seq, lengths = _sequence(row), _expand(row["lengths"], np.int64)
    words = _expand(row["words"], np.uint64)
    starts = np.cumsum(lengths) - lengths
    lower, ends = None, 0
    for k in range(1, order + 1):
        _, _, to, place, real = _asked(row, k, shards, counted=False)
        dtype = np.int64 if k == 1 else np.uint8
        flat = [_expand(parts[k, s], dtype) for s in range(shards) if to[s] < to[s + 1]]
        by_key = np.concatenate(flat) if flat else np.zeros(0, dtype)
        if k == 1:
            own, context = by_key[place].astype(float), None
            ends = by_key[np.searchsorted(np.sort(words), END)]
        else:
            own = np.zeros(len(seq))
            own[real] = _STEPS[by_key[place]]
            context = np.roll(lower, 1)
            context[starts] = ends if k == 2 else 0
            context[~real] = 0
        del place, real, flat, by_key
        yield own, context
        lower = own


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """Store ``df`` in the shared folder in buckets of ``block`` and read it back."""
    spark = df.sparkSession
    name, path = fresh_table(spark)
    df.write.bucketBy(buckets, "block").sortBy("block").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def score_documents(docs: DataFrame, training: Column, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    ``training`` marks the rows to learn from; null counts as false. A null or
    empty text is its end token alone. Repeated rows are learned and scored each;
    a null id stays null. Without training rows every word is unknown. Other
    columns are not read. The model has log10 probabilities.
    """
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    buckets = min(100_000, text_bytes // (PER_BUCKET * BLOCK) + 1)
    held = _bucketed(blocks(docs, id_col, text_col, training), buckets)
    size = held.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    shards, total = max(1, -(-size[0] // SHARD)), size[1]

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                for k in range(1, order + 1):
                    T.release()
                    some, part = _sent(row, k, shards)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]] * len(some), pa.int64()), pa.array([k] * len(some), pa.int32()), pa.array(some, pa.int64()), pa.array([p[0] for p in part], pa.binary()), pa.array([p[1] for p in part], pa.binary())],
                        ["block", "gram", "shard", "keys", "counts"],
                    )

    def answer(key, asked):
        T.release()
        return _answer_shard(key[0].as_py(), key[1].as_py(), shards, asked)

    def counted(own, answers):
        """A block's row with its text lengths, and the counts at every token, order by order."""
        T.release()
        row = _row(own)
        parts = {(g, s): a for g, s, a in zip(*(answers.column(c).to_pylist() for c in ("gram", "shard", "answer")))}
        return row, _expand(row["lengths"], np.int64), _token_counts(row, parts, order, shards)

    def gather(_, own, answers):
        row, lengths, counts = counted(own, answers)
        learned = np.repeat(_expand(row["flags"], np.uint8), lengths) == 1
        stats = np.zeros((order + 1, CLASSES, 2), np.int64)
        for k, (n, context) in enumerate(counts, 1):
            if k == 1:
                continue
            use = learned & (context >= 1.5)  # leave one out: the token's own occurrence does not count
            c = np.log2(context[use] - 1 + 1e-9).astype(np.int64).clip(0, CLASSES - 1)
            stats[k, :, 0] = np.bincount(c, minlength=CLASSES)
            stats[k, :, 1] = np.bincount(c, weights=n[use] >= 2, minlength=CLASSES)
        return pa.table({"i": pa.array(np.arange(stats.size)), "x": pa.array(stats.ravel())})

    asked = held.mapInArrow(ask, "block long, gram int, shard long, keys binary, counts binary")
    answers = asked.groupBy("gram", "shard").applyInArrow(answer, "block long, gram int, shard long, answer binary, distinct long")
    answers = _bucketed(answers.repartition(buckets, "block"), buckets)
    # both tables lie in buckets of the block number, so they meet without another shuffle
    met = held.groupBy("block").cogroup(answers.groupBy("block"))
    vocabulary = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    sums = dict(met.applyInArrow(gather, "i long, x long").groupBy("i").agg(F.sum("x")).collect())  # 88 numbers per order
    s = np.array([sums.get(i, 0) for i in range((order + 1) * CLASSES * 2)], float).reshape(order + 1, CLASSES, 2)
    weight = (s[..., 1] + 0.1) / (s[..., 0] + 1)
    below = float(total) + 0.5 * (vocabulary + 1)

    def score(_, own, answers):
        row, lengths, counts = counted(own, answers)
        start = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, start)  # noqa: E731  every text has its end token
        p, seen, plain = None, None, None
        for k, (n, context) in enumerate(counts, 1):
            if k == 1:
                p = (n + 0.5) / below
                seen, plain = add((n > 0).astype(np.int64)), add(np.log10(p))
                continue
            c = np.log2(np.maximum(context, 1)).astype(np.int64).clip(0, CLASSES - 1)
            a = np.where(context > 0, weight[k, c], 0.0)
            p = a * np.minimum(n / np.maximum(context, 1), 1.0) + (1 - a) * p
        ids, valid = _expand(row["ids"], np.int64), _expand(row["known"], np.uint8) == 1
        return pa.table(
            [pa.array(ids, mask=~valid), pa.array(lengths), pa.array(seen), pa.array(np.full(len(ids), total)), pa.array(plain), pa.array(add(np.log10(p)))],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return met.applyInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
