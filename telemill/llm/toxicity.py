"""Toxicity scores by gradient-boosted trees over dense features (operator 8).

Only the text is an input of a score. A lexicon of words and word beginnings is
learned from the training labels (beginnings catch inflected and compounded
insults), features are computed for every whole text in one pass, the trees are
fitted on a part of the labelled rows and isotonic regression on the rest maps
their output to a probability.

The classifier is fitted on at most ``SAMPLE`` labelled rows, those with the
smallest hash of their id; their ids and labels (16 bytes each) are broadcast.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm import text as T
from telemill.llm.common import small_batches
from telemill.session import cut

SAMPLE = 20_000
TREES, DEPTH = 30, 4
STARTS = (4, 5, 6)  # bytes of the word beginnings
SKETCHES = 4
LEAST_SHARE, LEAST_RATIO = 0.01, 10.0  # of the toxic training texts with an entry; of its frequencies in toxic and other texts
LEAST_G = 26.0  # likelihood-ratio statistic: chance below 1e-6 that an entry of no meaning reaches it
NEAR = 5  # words between an entry and a second-person word
YOU = "you your yours yourself u du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
NAMES = (
    "word_density", "word_count", "word_best", "start_density", "start_count", "start_best", "hidden_density", "you_density", "near_you", "capitals", "shouted", "punctuation",
    "exclaims", "mixed_words", "stretched", "length",
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_ALPHA = _LETTER.copy()
_ALPHA[0x30:0x3A] = False
_PUNCT = ~_LETTER & ~T.SPACE
# look-alike characters and the letters they stand for
_LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "l"}
_AS_LETTER = np.arange(256, dtype=np.uint8)
for _k, _v in _LOOKS.items():
    _AS_LETTER[ord(_k)] = ord(_v)
_KEEP = _LETTER | T.SPACE
_KEEP[[ord(k) for k in _LOOKS]] = True


def _runs(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal runs of ``inside`` bytes that stay in one row."""
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds[bounds <= len(data)]] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _tokens(data: np.ndarray, bounds: np.ndarray):
    """Hashes of letter runs and of their beginnings (0 where the run is no longer than that), with bounds per row."""
    starts, ends = _runs(data, bounds, _LETTER[data])
    whole = T.hash_spans(data, bounds, starts, ends)
    begin = []
    for n in STARTS:
        h = T.hash_spans(data, bounds, starts, np.minimum(starts + n, ends))
        begin.append(np.where(ends - starts > n, T.mix(h + T.U(n)), T.U(0)))
    return starts, ends, whole, begin, np.searchsorted(starts, bounds)


def _row_sum(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x, dtype=float)])
    return total[to[1:]] - total[to[:-1]]


def _row_max(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    out = np.zeros(len(to) - 1)
    full = np.flatnonzero(np.diff(to))
    if len(full):
        out[full] = np.maximum.reduceat(x, to[full])
    return out


class Lexicon:
    """Weights of hashed entries."""

    def __init__(self, entries: list[tuple[int, float]]):
        entries = sorted((h & 0xFFFFFFFFFFFFFFFF, w) for h, w in entries)
        self.keys = np.array([h for h, _ in entries], T.U)
        self.weights = np.array([w for _, w in entries], float)

    def weigh(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where((self.keys[at] == h) & (h != 0), self.weights[at], 0.0)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    data, bounds = T.buffers(texts)
    if not len(data):
        return np.zeros((len(texts), len(NAMES)))
    starts, ends, whole, begin, to = _tokens(data, bounds)
    n = np.maximum(np.diff(to), 1)
    word = lexicon.weigh(whole)
    start = np.maximum.reduce([lexicon.weigh(b) for b in begin])
    you = np.isin(whole, np.array(_YOU_HASHES, T.U))
    row = np.repeat(np.arange(len(to) - 1), np.diff(to))
    hit, yours = np.flatnonzero((word > 0) | (start > 0)), np.flatnonzero(you)
    near = np.zeros(len(whole))
    if len(hit) and len(yours):
        i = np.searchsorted(yours, hit)
        for j in (np.maximum(i - 1, 0), np.minimum(i, len(yours) - 1)):
            near[hit] = np.maximum(near[hit], (np.abs(yours[j] - hit) <= NEAR) & (row[yours[j]] == row[hit]))
    # the same text with look-alikes replaced and marks inside words removed
    keep = _KEEP[data]
    plain, at = _AS_LETTER[data[keep]], np.concatenate([[0], np.cumsum(keep)])[bounds]
    ps, pe = T.word_spans(plain, at)
    hidden = np.searchsorted(ps, at)
    found = _row_sum(lexicon.weigh(T.hash_spans(plain, at, ps, pe)) > 0, hidden)
    ws, we = T.word_spans(data, bounds)
    wto = np.searchsorted(ws, bounds)
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    upper, alpha, punct = total(_UPPER[data]), total(_ALPHA[data]), total(_PUNCT[data])
    per = lambda c: (c[bounds[1:]] - c[bounds[:-1]]).astype(float)
    letters = np.maximum(per(alpha), 1)
    shouted = (ends - starts >= 3) & (upper[ends] - upper[starts] == ends - starts)
    inner = punct[np.maximum(we - 1, ws)] - punct[ws]
    digits = (we - ws) - (alpha[we] - alpha[ws]) - (punct[we] - punct[ws])
    mixed = (alpha[we] - alpha[ws] >= 2) & ((inner > 0) | (digits > 0))
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & ~T.SPACE[data[2:]]
    same[bounds[:-1][bounds[:-1] < len(data)]] = False
    size = np.maximum(np.diff(bounds), 1)
    words = np.maximum(np.diff(wto), 1)
    out = [
        _row_sum(word > 0, to) / n, np.log1p(_row_sum(word > 0, to)), _row_max(word, to), _row_sum(start > 0, to) / n, np.log1p(_row_sum(start > 0, to)), _row_max(start, to),
        np.maximum(found - _row_sum(word > 0, to), 0) / words, _row_sum(you, to) / n, np.log1p(_row_sum(near, to)), per(upper) / letters, _row_sum(shouted, to) / n, per(punct) / size,
        per(total((data == ord("!")) | (data == ord("?")))) / words, _row_sum(mixed, wto) / words, per(total(same)) / size, np.log1p(np.diff(wto)),
    ]
    return np.column_stack(out)


_YOU_HASHES = [int(x) for x in T.words(pa.array([" ".join(YOU)]))[0]]


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Entries that are far more frequent in toxic texts; ``sample`` has ``text`` and ``toxic``."""

    def run(batches):
        for batch in T.slices(batches, "text"):
            data, bounds = T.buffers(batch.column(0))
            _, _, whole, begin, to = _tokens(data, bounds)
            row = np.repeat(np.arange(len(to) - 1), np.diff(to))
            h, r = np.concatenate([whole, *begin]), np.tile(row, 1 + len(begin))
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            first &= h != 0
            toxic = np.array(batch.column(1).to_pylist(), np.int64)[r[first]]
            keys, at = np.unique(h[first], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(np.bincount(at, toxic, len(keys)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(keys)))], ["h", "bad", "all"])

    bad, rows = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    counts = sample.select("text", "toxic").mapInArrow(run, "h long, bad long, all long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("all").alias("n"))
    good = F.col("n") - F.col("bad")
    ratio = (F.col("bad") + 0.1) / bad / ((good + 0.1) / (rows - bad))
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (F.col("n") * share))).otherwise(0.0)
    g = 2 * (part(F.col("bad"), bad / rows) + part(good, 1 - bad / rows))
    # at most (words of one text) / LEAST_SHARE entries, whatever the corpus
    chosen = counts.where((F.col("bad") >= LEAST_SHARE * bad) & (ratio >= LEAST_RATIO) & (g >= LEAST_G))
    return Lexicon([(x.h, log(x.r)) for x in chosen.select("h", ratio.alias("r")).collect()])


def sketched(rows: DataFrame) -> DataFrame:
    """Add ``s0, s1, ...``: least hashes of the texts' three-word shingles; near copies mostly share them. Wordless texts get their id."""

    def run(batches):
        for batch in T.slices(batches, "text"):
            h, to = T.shingles(*T.words(batch.column(batch.schema.get_field_index("text"))), 3)
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False).astype(np.int64)
            full = np.flatnonzero(np.diff(to))
            for k in range(SKETCHES):
                out = ids.copy()
                if len(full):
                    out[full] = np.minimum.reduceat(T.mix(h + T.U(k)), to[full]).view(np.int64)
                batch = batch.append_column(f"s{k}", pa.array(out))
            yield batch

    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1] + "".join(f",s{k}:bigint" for k in range(SKETCHES)))


def score_documents(docs: DataFrame, labels: DataFrame, training: Column, calibration: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """Per row ``doc_id`` and ``score`` in 0..1, with ``carry`` all input columns and ``score``, which replaces one of that name.

    ``training`` and ``calibration`` are conditions on the id; rows of the second
    are used for isotonic regression only. Labels may repeat (the largest counts)
    or be null (ignored). Null and empty texts have all features 0 and get a score
    like any other. Rows that repeat an id are scored each. Without labels of
    both classes every score is the share of toxic labels, or 0.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score") if carry else docs
    chosen = labels.where(training & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic")).where("toxic is not null")
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    marked = chosen.select(F.col("id").alias(id_col), "toxic").withColumn("calibrates", calibration)
    marked = cut(marked.select(F.col(id_col).alias("id"), "toxic", "calibrates"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # copies of one text would make all of its words look telling: one text of each group of copies is learned from
    rows = cut(sketched(own.join(F.broadcast(marked), "id")))
    alone = rows.drop("text").dropDuplicates(["id"])
    for k in range(SKETCHES):
        alone = alone.dropDuplicates([f"s{k}"])
    labelled = cut(rows.join(F.broadcast(alone.select("id")), "id").dropDuplicates(["id"]).select("text", "toxic", "calibrates").coalesce(8))
    seen = {r.toxic: r.n for r in labelled.where("not calibrates").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    plain = [F.col(c) for c in docs.columns] if carry else [F.col(id_col).alias("doc_id")]
    if len(seen) < 2:
        n = sum(seen.values())
        return docs.select(*plain, F.lit(seen.get(1, 0) / n if n else 0.0).alias("score"))
    lexicon = learn_lexicon(labelled.where("not calibrates"))

    def run(batches):
        for batch in T.slices(batches, "__text"):
            at = batch.schema.get_field_index("__text")
            x = features(batch.column(at), lexicon)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], rows], [*[c for c in batch.schema.names if c != "__text"], "__features"])

    def featured(df: DataFrame, text: str) -> DataFrame:
        kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "__text"]
        return df.withColumn("__text", F.col(text)).mapInArrow(run, ", ".join([*kept, "__features array<double>"])).withColumn("__x", array_to_vector("__features"))

    fit = cut(featured(labelled, "text").select("toxic", "calibrates", "__features")).withColumn("__x", array_to_vector("__features")).coalesce(2)
    trees = GBTClassifier(featuresCol="__x", labelCol="toxic", predictionCol="__p", maxIter=TREES, maxDepth=DEPTH, minInstancesPerNode=4, seed=1).fit(fit.where("not calibrates"))
    trees.setProbabilityCol("__prob").setRawPredictionCol("__raw")
    margin = vector_to_array("__prob")[1]
    held = trees.transform(fit.where("calibrates")).select(margin.alias("__m"), F.col("toxic").cast("double").alias("toxic"))
    smooth = IsotonicRegression(featuresCol="__m", labelCol="toxic", predictionCol="__iso").fit(held) if held.take(1) else None
    source = docs if carry else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__src"))
    scored = trees.transform(featured(source, text_col if carry else "__src")).withColumn("__m", margin)
    if smooth is not None:
        scored = smooth.transform(scored)
        # isotonic steps tie many scores; a thousandth of the trees' own probability orders them
        score = 0.999 * F.least(F.greatest("__iso", F.lit(0.0)), F.lit(1.0)) + 0.001 * F.col("__m")
    else:
        score = F.col("__m")
    return scored.select(*plain, score.alias("score"))
