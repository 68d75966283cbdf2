"""Removal of globally repeated multi-line chunks (operator 1).

A text is a sequence of lines; a line also ends after a sentence. At every line
starts a chunk: the fewest lines, two at least, that have ``LEAST_WORDS`` words. A
line of ``LONE_WORDS`` words is a chunk of its own, too. A chunk depends on its own
lines only, so every passage that holds one is found, whatever stands around it.

Of chunks that occur again, in any text, the first occurrence, by id and
position, stays. Chunks that overlap and point to the same earlier passage are
joined, and cut again after every ``PIECE`` lines of that passage. A piece is removed
if its lines equal those of the earlier text byte for byte; it then grows line by
line as far as the lines stay equal, at most over the lines (under ``LEAST_WORDS``
words) that no chunk covers at the end of a passage. Whatever is removed stands at
an earlier place, so nothing is lost from the corpus. Parts of a line are never removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm import text as T
from telemill.llm.common import blobs, by_shard, fanned_join, key_filter, only_possible, placed, places, records, salted_join, small_batches, unmarked
from telemill.session import cut

SPAN = 3  # lines that a match may grow on either side; more if they have under LEAST_WORDS words
LEAST_WORDS = 12
LONE_WORDS = 50
PIECE = 16
HELD = 1 << 18  # chunks or matches that a worker holds before it deals them out
SHIFT = T.U(53)  # shards are the upper 11 bits of a hash
MANY = 16  # a chunk met so often in what a worker holds, and 1 time in 1024, is dealt on its own
CHUNK = np.dtype([("h", "<u8"), ("id", "<i8"), ("a", "<i4"), ("n", "<i4")])
FIRST = np.dtype([("h", "<u8"), ("id", "<i8"), ("a", "<i4")])
MATCH = np.dtype([("id", "<i8"), ("sid", "<i8"), ("a", "<i4"), ("sa", "<i4"), ("n", "<i4")])
CASED = np.random.default_rng(0x11E5).integers(1, 1 << 63, 256, dtype=np.uint64)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of all lines (with the white space that ends them) and the bounds of each row's lines."""
    ends = data == 0x0A
    sentence = (data[1:] == 0x20) & _STOP[data[:-1]]
    sentence[bounds[(bounds > 0) & (bounds < len(data))] - 1] = False  # a row's first byte follows nothing
    ends[1:] |= sentence
    cuts = np.unique(np.concatenate([np.flatnonzero(ends) + 1, bounds]))
    return cuts, np.searchsorted(cuts, bounds)


def _range_hash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequences h[a:b]; 0 where empty."""
    run = np.concatenate([[T.U(0)], np.cumsum(h * T._power(T.BASE, len(h))[: len(h)], dtype=T.U)])
    return np.where(b > a, T.mix((run[b] - run[a]) * T._power(T.UNBASE, len(h) + 1)[a] + (b - a).astype(T.U)), T.U(0))


def chunks(texts: pa.Array, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """Row, first line, number of lines, number of words and hash of every chunk; those at the end of a row may be too short."""
    data, bounds = T.buffers(texts)
    cuts, to = lines(data, bounds)
    count = len(cuts) - 1
    if count <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, T.U))
    starts, ends = T.word_spans(data, bounds)
    w = np.searchsorted(starts, cuts)
    h = _range_hash(T.hash_spans(data, bounds, starts, ends, CASED), w[:-1], w[1:])
    row = np.repeat(np.arange(len(to) - 1), np.diff(to))
    first = np.flatnonzero(np.diff(w))
    last = np.minimum(np.maximum(np.searchsorted(w, w[first] + least_words), first + 2), to[row[first] + 1])
    lone = np.flatnonzero(np.diff(w) >= LONE_WORDS)
    first, last = np.concatenate([first, lone]), np.concatenate([last, lone + 1])
    return row[first], first - to[row[first]], last - first, w[last] - w[first], _range_hash(h, first, last)


def _split(text: bytes) -> list[bytes]:
    data = np.frombuffer(text, np.uint8)
    cuts, _ = lines(data, np.array([0, len(data)]))
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any of the columns."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def _dealt(rec: np.ndarray) -> list[pa.RecordBatch]:
    """Chunks as blobs by hash (kind 0); of a frequent one only the first occurrence, with n below 0, the others are spread (kind 1)."""
    rec = rec[np.argsort(rec["h"], kind="stable")]
    begin = np.flatnonzero(_starts(rec["h"]))
    count = np.diff(np.append(begin, len(rec)))
    frequent = np.repeat(count >= max(MANY, len(rec) >> 10), count)
    if not frequent.any():
        return [blobs(rec, rec["h"] >> SHIFT, 0)]
    many = rec[frequent]
    many = many[np.lexsort((many["a"], many["id"], many["h"]))]
    first = _starts(many["h"])
    told, rest = many[first], many[~first]
    told["n"] *= -1
    rec = np.concatenate([rec[~frequent], told])
    rec = rec[np.argsort(rec["h"], kind="stable")]
    spread = np.arange(len(rest)) // 1024 + int(rest["id"][0] & 2047)
    return [blobs(rec, rec["h"] >> SHIFT, 0), blobs(rest, spread, 1)]


def _repeats(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the chunks of a shard: occurrences after the first with the place of the first, and the first of every frequent chunk."""
    rec = rec[np.argsort(rec["h"], kind="stable")]
    begin = np.flatnonzero(_starts(rec["h"]))
    count = np.diff(np.append(begin, len(rec)))
    frequent = np.logical_or.reduceat(rec["n"] < 0, begin)
    rec = rec[np.repeat((count > 1) | frequent, count)]
    rec = rec[np.lexsort((rec["a"], rec["id"], rec["h"]))]
    new = _starts(rec["h"])
    first = rec[np.flatnonzero(new)[np.cumsum(new) - 1]]
    other = (rec["id"] != first["id"]) | (rec["a"] != first["a"])
    hits = np.empty(int(other.sum()), MATCH)
    hits["id"], hits["a"], hits["n"] = rec["id"][other], rec["a"][other], np.abs(rec["n"][other])
    hits["sid"], hits["sa"] = first["id"][other], first["a"][other]
    hot = first[rec["n"] < 0]
    hot = hot[_starts(hot["h"])]
    told = np.empty(len(hot), FIRST)
    for c in FIRST.names:
        told[c] = hot[c]
    return hits, told


def _late(rec: np.ndarray, h: np.ndarray, sid: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Hits of spread chunks, all of which are among the chunks ``h``, whose first places are told."""
    order = np.argsort(h)
    at = order[np.searchsorted(h, rec["h"], sorter=order)]
    other = (rec["id"] != sid[at]) | (rec["a"] != sa[at])
    rec, at = rec[other], at[other]
    hits = np.empty(len(rec), MATCH)
    hits["id"], hits["a"], hits["n"], hits["sid"], hits["sa"] = rec["id"], rec["a"], rec["n"], sid[at], sa[at]
    return hits


def _by_id(hits: np.ndarray) -> pa.RecordBatch:
    """Hits as blobs by a hash of their id."""
    shard = T.mix(hits["id"].astype(T.U)) >> SHIFT
    order = np.argsort(shard, kind="stable")
    return blobs(hits[order], shard[order], 0)


def _joined(hits: np.ndarray) -> np.ndarray:
    """Matches from joined hits that overlap or touch, cut where the earlier text's line number is a multiple of ``PIECE``."""
    hits = hits[np.lexsort((hits["a"], hits["a"] - hits["sa"], hits["sid"], hits["id"]))]
    shift = (hits["a"] - hits["sa"]).astype(np.int64)
    group = _starts(hits["id"], hits["sid"], shift)
    base = np.cumsum(group) << 32  # the greatest end of a group stays below the starts of the next
    end = np.maximum.accumulate(base + hits["a"] + hits["n"])
    new = group.copy()
    new[1:] |= (base + hits["a"])[1:] > end[:-1]
    begin = np.flatnonzero(new)
    last = np.append(begin, len(hits))[1:] - 1
    lo, hi = hits["sa"][begin].astype(np.int64), (end - base)[last] - shift[begin]
    count = (hi - 1) // PIECE - lo // PIECE + 1
    of = np.repeat(np.arange(len(begin)), count)
    part = lo[of] // PIECE + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    out = np.empty(len(of), MATCH)
    out["id"], out["sid"] = hits["id"][begin][of], hits["sid"][begin][of]
    out["sa"] = np.maximum(lo[of], part * PIECE)
    out["a"] = out["sa"] + shift[begin][of]
    out["n"] = np.minimum(hi[of], (part + 1) * PIECE) - out["sa"]
    return out


def _pieces(found: list[dict], shift: int) -> list[tuple[int, int]]:
    """Bounds of the matches that come from one pair's chunks."""
    out = _joined(np.array([(0, 0, x["a"], x["a"] - shift, x["n"]) for x in found], MATCH))
    return [(int(a), int(a + n)) for a, n in zip(out["a"], out["n"])]


def _remove(text: bytes, matches: list[dict]) -> tuple[bytes, int, int]:
    """Text without its confirmed matches, lines before and lines removed."""
    own = _split(text)
    bare = [x.rstrip(b" \t\n\r\x0b\x0c") for x in own]
    gone = [False] * len(own)
    for m in matches:
        a, n, core, other = m["a"], m["n"], m["core"], m["lines"].encode().split(b"\n")
        if bare[a : a + n] != other[core : core + n]:
            continue
        for i in range(a, a + n):
            gone[i] = True
        for step, i, j in ((-1, a - 1, core - 1), (1, a + n, core + n)):
            while 0 <= i < len(own) and 0 <= j < len(other) and bare[i] == other[j]:
                gone[i] = True
                i, j = i + step, j + step
    return b"".join(x for x, g in zip(own, gone) if not g), len(own), sum(gone)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, copy_col: str | None = None) -> DataFrame:
    """All input rows and columns with repeated chunks removed from the text, and ``n_lines``, ``n_removed``.

    A null text stays null, with no lines. Rows that repeat an id are not told
    apart reliably by position, so they are left unchanged, as are rows without
    id; they still count as occurrences, and a chunk whose first occurrence is in
    such a row stays everywhere in such rows only. A text all of whose lines are
    removed becomes empty. Input columns named ``n_lines`` or ``n_removed`` are replaced.
    A further column ``copy_col``, if wanted, tells whether all lines were removed
    and were found in one earlier text.
    """
    small_batches(docs.sparkSession)
    extra = [copy_col] if copy_col else []
    base = docs.drop("n_lines", "n_removed", *extra)
    base = base.withColumn(text_col, F.col(text_col).cast("string"))
    src = base.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def find(batches):
        held, size = [], 0
        for batch in T.slices(batches, "text", 1 << 18):
            row, first, n, words, h = chunks(batch.column(1), least_words)
            use = np.flatnonzero(((n >= 2) & (words >= least_words)) | ((n == 1) & (words >= LONE_WORDS)))
            rec = np.empty(len(use), CHUNK)
            rec["h"], rec["id"], rec["a"], rec["n"] = h[use], batch.column(0).to_numpy()[row[use]], first[use], n[use]
            held.append(rec)
            size += len(rec)
            if size >= HELD:
                yield from _dealt(np.concatenate(held))
                held, size = [], 0
        if size:
            yield from _dealt(np.concatenate(held))

    def match(batches):
        """Hits (kind 0), what was spread (1) and the first places that it waits for (2)."""
        aside: list[pa.RecordBatch] = []

        def own():
            for batch in batches:
                there = batch.column(1).to_numpy() == 0
                if not there.all():
                    aside.append(batch.filter(pa.array(~there)))
                yield batch.filter(pa.array(there))

        held, size = [], 0
        for rec in by_shard(own(), CHUNK):
            hits, told = _repeats(rec)
            held.append(hits)
            size += len(hits)
            if len(told):
                yield blobs(told, np.zeros(len(told), np.int64), 2)
            while aside:
                yield aside.pop()
            if size >= HELD:
                yield _by_id(np.concatenate(held))
                held, size = [], 0
        yield from aside
        if size:
            yield _by_id(np.concatenate(held))

    def asking(batches):
        """The different chunks of every spread blob; its key is a hash of its bytes, so equal blobs ask as one."""
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1)):
                h = np.unique(np.frombuffer(data.as_buffer(), CHUNK)["h"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), key.as_py())), pa.array(h.view("<i8"))], ["key", "h"])

    def unpacked(batches):
        for batch in batches:
            rec = records(batch.column(0), FIRST)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rec[c]).view("<i8") if c == "h" else rec[c]) for c in FIRST.names], ["h", "sid", "sa"])

    def answered(batches):
        held, size = [], 0
        for batch in batches:
            for data, told in zip(batch.column(0), batch.column(1)):
                h, sid, sa = (x.to_numpy() for x in told.values.flatten())
                held.append(_late(np.frombuffer(data.as_buffer(), CHUNK), h.view(T.U), sid, sa))
                size += len(held[-1])
                if size >= HELD:
                    yield _by_id(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield _by_id(np.concatenate(held))

    def join(batches):
        for rec in by_shard(batches, MATCH):
            out = _joined(rec)
            yield pa.RecordBatch.from_arrays([pa.array(out[c].astype(np.int64)) for c in ("id", "a", "n", "sid", "sa")], ["id", "a", "n", "sid", "sa"])

    blob = "shard int, kind int, data binary"
    pairs = cut(src.mapInArrow(find, blob).repartition("shard").sortWithinPartitions("shard").mapInArrow(match, blob))
    first = pairs.where("kind = 2").select("data").mapInArrow(unpacked, "h long, sid long, sa int")
    spread = pairs.where("kind = 1").select(F.xxhash64("data").alias("key"), "data")
    # a blob asks once for each of its chunks, however often it holds it
    told = salted_join(spread.mapInArrow(asking, "key long, h long"), first.hint("merge"), "h", "key").groupBy("key").agg(F.collect_set(F.struct("h", "sid", "sa")).alias("told"))
    late = spread.join(told.hint("merge"), "key").select("data", "told")
    hits = pairs.where("kind = 0").unionByName(late.mapInArrow(answered, blob))
    matches = cut(hits.select("shard", "data").repartition("shard").sortWithinPartitions("shard").mapInArrow(join, "id long, a long, n long, sid long, sa long"))
    from_, into = (key_filter(matches.select(places(c).alias("p")), "p") for c in ("sid", "id"))

    def excerpts(batches):
        for whole in batches:
            for batch in T.slices([whole], "text", 1 << 18):
                out: list[tuple] = []
                held = 0
                for i, t, wanted in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    own = [x.rstrip(b" \t\n\r\x0b\x0c").decode() for x in _split(t.encode())]
                    for x in wanted:
                        begin, end = max(0, x["sa"] - SPAN), x["sa"] + x["n"]
                        words, over = 0, end
                        while over < len(own) and (over < end + SPAN or words < least_words):
                            words += len(own[over].encode().split())
                            over += 1
                        out.append((i, x["sa"], x["n"], x["sa"] - begin, "\n".join(own[begin:over])))
                        held += len(out[-1][-1])
                        if held > 1 << 20:
                            yield told_rows(out)
                            out, held = [], 0
                yield told_rows(out)

    def told_rows(out):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], ["sid", "sa", "n", "core", "lines"])

    sources = matches.select("sid", "sa", "n").distinct().groupBy("sid").agg(F.collect_list(F.struct("sa", "n")).alias("wanted"))
    # no broadcast here and above, or each task would hold two Python workers
    one = only_possible(src, from_, "id").join(sources.hint("merge"), F.col("id") == F.col("sid")).select("id", "text", "wanted")
    texts = one.mapInArrow(excerpts, "sid long, sa long, n long, core long, lines string").dropDuplicates(["sid", "sa", "n"]).withColumn("at", F.struct("sid", "sa", "n")).drop("sid", "sa", "n")
    told = fanned_join(matches.withColumn("at", F.struct("sid", "sa", "n")), texts, "at", "id")
    names = base.columns
    kinds = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in base.schema)
    kinds = ", ".join([kinds, "n_lines long", "n_removed long", *[f"`{c}` boolean" for c in extra]])

    def rewritten(batch, matches):
        """The batch's rows, each without the chunks that its matches confirm."""
        texts = batch.column(batch.schema.get_field_index(text_col))
        count = np.diff(lines(*T.buffers(texts))[1])
        gone, copy = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
        new = texts
        if any(matches):
            new = texts.to_pylist()
            for i, (t, m) in enumerate(zip(new, matches)):
                if t is not None and m:
                    text, n, gone[i] = _remove(t.encode(), m)
                    new[i] = text.decode()
                    copy[i] = gone[i] == n and len({x["sid"] for x in m}) == 1
        cols = [(new if new is texts else pa.array(new, pa.string())) if c == text_col else batch.column(batch.schema.get_field_index(c)) for c in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(count, pa.int64()), pa.array(gone, pa.int64()), *[pa.array(copy, pa.bool_()) for _ in extra]], [*names, "n_lines", "n_removed", *extra])

    def untouched(batches):
        for batch in T.slices(batches, text_col, 1 << 18):
            rows, maybe = unmarked(batch, into)
            yield rewritten(rows.filter(pa.array(~maybe)), [])

    def rewrite(batches):
        key, rows, found = None, 0, []  # of one id: its rows are counted first, then come its matches, then the rows
        for batch in T.slices(batches, text_col, 1 << 18):
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            part = col("__part").to_numpy()
            matched, told_at = iter(col("__match").filter(pa.array(part == 1)).to_pylist()), []
            for k, what in zip(col("__key").to_pylist(), part.tolist()):
                if k != key:
                    key, rows, found = k, 0, []
                if what == 0:
                    rows += 1
                elif what == 1:
                    found.append(next(matched))
                else:
                    told_at.append(found if rows == 1 else None)
            if told_at:
                yield rewritten(batch.filter(pa.array(part == 2)), told_at)

    # told rows meet their text by order, so that no join or list holds texts in memory
    both = only_possible(base, into, id_col).withColumns({"__key": F.col(id_col).cast("long"), "__part": F.explode(F.array(F.lit(0), F.lit(2)))})
    both = both.select("__key", "__part", *[F.when(F.col("__part") == 2, F.col(f"`{c}`")).alias(c) for c in names])
    met = told.select(F.col("id").alias("__key"), F.lit(1).alias("__part"), F.struct("a", "n", "core", F.col("at.sid").alias("sid"), "lines").alias("__match"))
    changed = both.unionByName(met, allowMissingColumns=True).repartition("__key").sortWithinPartitions("__key", "__part").mapInArrow(rewrite, kinds)
    return placed(base, id_col).mapInArrow(untouched, kinds).unionByName(changed)
