"""WARC archives with revisit records, read back by boundary-chain verification (operator 7).

Writing: payloads are digested; of equal payloads the row with the largest id
becomes the response, the others become revisit records that name it. Records
are written by Spark's text writer with the record end as line separator, so
any store that Spark writes to will do.

Reading: files are cut into splits, and every split is searched for the record
magic by a task of its own. A magic inside a payload looks like a record too,
so each candidate only yields a jump: its offset and the offset where its record
would end. Inside a split jumps are followed at once (each candidate points to
where its chain leaves the split); between splits pointer jumping from the
start of the file doubles the length of the jumps per round. Only candidates
that the chain reaches are records.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import text as T
from telemill.llm.common import FILTER_BITS, key_filter, possible, salted_join
from telemill.session import cut

END = "\r\n\r\n"
SPLIT = 4 << 20  # bytes of a file searched by one task
OVER = 1 << 20  # bytes read beyond the end of a split; 16 times as many where a record head goes on
# records per file by their payload's size, so that a file holds about 256 MB at most
PER_FILE = ((64 << 10, 4000), (1 << 20, 256), (16 << 20, 16), (None, 1))
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(rows: DataFrame, repeated: np.ndarray | None = None) -> DataFrame:
    """Add ``size``, ``digest`` and ``maybe``: whether the digest may be one of the repeated ones."""

    def run(batches):
        for batch in T.slices(batches, "payload"):
            data, bounds = T.buffers(batch.column(batch.schema.get_field_index("payload")))
            whole = data.tobytes()
            raw = [hashlib.sha1(whole[a:b]).digest() for a, b in zip(bounds[:-1], bounds[1:])]
            place = np.array([int.from_bytes(x[:4], "big") for x in raw], np.int64) % FILTER_BITS
            maybe = np.ones(len(raw), bool) if repeated is None else possible(repeated, place)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.diff(bounds)), pa.array([base64.b32encode(x).decode() for x in raw], pa.string()), pa.array(place), pa.array(maybe)],
                [*batch.schema.names, "size", "digest", "place", "maybe"],
            )

    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1] + ",size:bigint,digest:string,place:bigint,maybe:boolean")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0, per_file=PER_FILE) -> None:
    """Write one record per row under ``path``; a null payload is empty, a null uri is left out.

    ``per_file`` pairs the payload size (exclusive, None for none) with the
    records that a file of such payloads may hold; each class goes to files of
    its own, and only classes that occur are written.

    Payloads of at least ``least`` bytes are stored once: rows with the largest
    id of their payload are responses (several if that id repeats, null ids
    count as smallest), the others revisits without body.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    marks = _digests(rows)
    best = cut(marks.where(F.col("size") >= least).groupBy("digest", "place").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "best", "place"))
    # only payloads that may be repeated are shuffled; the others are written where they are read
    told = _digests(rows, key_filter(best, "place")).withColumn("__row", F.xxhash64("id", "uri"))
    alone = told.where(~F.col("maybe")).withColumn("best", F.lit(None).cast("long"))
    full = alone.unionByName(salted_join(told.where("maybe"), best.select("digest", "best"), "digest", "__row", "left"))
    revisit = F.col("best").isNotNull() & ~F.col("best").eqNullSafe(F.col("id")) & (F.col("size") >= least)

    def line(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))).otherwise("")

    body = F.when(revisit, "").otherwise(F.col("payload"))
    uri = F.regexp_replace("uri", "[\\r\\n]", " ")  # a line end would end the header
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id"), F.lit(">"))),
        line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("best"), F.lit(">")))),
        line("X-Payload-Bytes", F.col("size")), line("Content-Length", F.octet_length(body)), F.lit("\r\n"),
    )
    sized = full.select(F.concat(head, body).alias("value"), F.octet_length(body).alias("bytes"))
    longest = rows.agg(F.max(F.octet_length("payload"))).first()[0] or 0
    low = 0
    for high, most in per_file:
        if low and longest < low:
            break
        inside = (F.col("bytes") >= low) & ((F.col("bytes") < high) if high and longest >= high else F.lit(True))
        sized.where(inside).select("value").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", most).text(path)
        low = high


def _parse(data: bytes, at: int) -> tuple[int, int, dict] | None:
    """Head end, record end and header of a candidate, relative to ``data``; None without a length or an end of the head."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    head = {}
    for x in data[at:stop].split(b"\r\n")[1:]:
        name, _, value = x.partition(b":")
        head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        return None
    return stop + 4, stop + 4 + int(head["content-length"]) + 4, head


def _number(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


_FOUND = ["file", "at", "body", "to", "leaves", "file_bytes", "mark", "id", "kind", "digest", "refers", "uri", "again"]
_FOUND_KINDS = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def candidates(files: DataFrame, split: int = SPLIT, over: int = OVER) -> DataFrame:
    """Every place that looks like a record: ``file, at, to`` (its end) and ``leaves``, where its chain leaves the split.

    ``mark`` is the digest of the payload bytes, null where they reach beyond
    what the task has read. A split with a head that does not end there is
    searched again with more bytes, until its heads end or the file does.
    """
    base = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("base")
    part = lambda: F.substring("content", (F.col("base") + 1).cast("int"), F.lit(split + over)).alias("data")
    parts = files.select("path", "length", "content", base).select("path", "base", "length", part())
    found = None
    while True:
        now = cut(_searched(parts, split))
        done = now.where("again is null")
        found = done if found is None else found.unionByName(done)
        if not now.where("again is not null").take(1):
            return found.drop("again")
        starts = cut(now.where("again is not null").select(F.col("file").alias("path"), F.col("again").alias("base")))
        over *= 16
        parts = files.join(starts, "path").select("path", "base", "length", part())


def _searched(parts: DataFrame, split: int) -> DataFrame:
    """The candidates of splits (path, base, length, data); one row with ``again`` for a split that must be read further."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for file, base, size, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found, whole = [], base + len(data) >= size
                short = False
                for m in _MAGIC.finditer(data):
                    if m.start() < split:
                        got = _parse(data, m.start())
                        short |= got is None and not whole and data.find(b"\r\n\r\n", m.start()) < 0
                        if got:
                            found.append((m.start(), got))
                if short:
                    rows.append((file, None, None, None, None, size, None, None, None, None, None, None, base))
                    continue
                leaves: dict[int, int] = {}
                for at, (_, to, head) in reversed(found):
                    leaves[at] = leaves.get(to, base + to)
                rows += [
                    (file, base + at, base + body, base + to, leaves[at], size, digest(data[body : to - 4]) if to <= len(data) else None, _number(head.get("warc-record-id")), head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:"), _number(head.get("warc-refers-to")), head.get("warc-target-uri"), None)
                    for at, (body, to, head) in found
                ]
            cols = list(zip(*rows)) or [[]] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _FOUND_KINDS)], _FOUND)

    return parts.mapInArrow(run, "file string, at long, body long, to long, leaves long, file_bytes long, mark string, id long, kind string, digest string, refers long, uri string, again long")


def reachable(found: DataFrame, split: int = SPLIT) -> DataFrame:
    """Candidates on the chain that starts at offset 0 of their file.

    Entry points of splits are found by pointer jumping: reached entries and
    jumps double each round, so a file of s splits takes log2(s) rounds.
    """
    jump = cut(found.select("file", "at", F.col("leaves").alias("next")))
    reach = cut(jump.where(F.col("at") == 0).select("file", "at"))
    n = reach.count()
    while True:
        step = reach.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        grown = cut(reach.unionByName(step).distinct())
        now = grown.count()
        reach = grown
        if now == n:
            break
        n = now
        far = jump.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        jump = cut(jump.join(far, ["file", "next"], "left").select("file", "at", F.coalesce("further", "next").alias("next")))
    # inside a split, follow the chain from its entries
    split_no = F.floor(F.col("at") / split)
    entries = reach.withColumn("split", split_no).groupBy("file", "split").agg(F.collect_set("at").alias("entries"))
    chains = found.select("file", "at", "to", split_no.alias("split")).groupBy("file", "split").agg(F.sort_array(F.collect_list(F.struct("at", "to"))).alias("c")).join(entries, ["file", "split"])
    follow = F.aggregate(
        "c", F.struct(F.col("entries").alias("open"), F.array().cast("array<bigint>").alias("got")),
        lambda s, x: F.when(F.array_contains(s["open"], x["at"]), F.struct(F.array_append(s["open"], x["to"]).alias("open"), F.array_append(s["got"], x["at"]).alias("got"))).otherwise(s),
    )
    return chains.select("file", F.explode(follow["got"]).alias("at"))


def read_archives(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Verified records: ``file, at, body, to, mark, id, kind, digest, refers, uri``; ``mark`` is computed from the bytes read.

    A file whose chain does not end with the file is an error: a record of it is
    damaged, and those behind it cannot be told from payload.
    """
    files = spark.read.format("binaryFile").load(path)
    found = cut(candidates(files, split))
    records = cut(found.join(reachable(found, split), ["file", "at"]))
    ends = files.select(F.col("path").alias("file"), "length").join(records.groupBy("file").agg(F.max("to").alias("end")), "file", "left")
    short = ends.where(F.coalesce("end", F.lit(0)) != F.col("length")).take(1)
    if short:
        raise ValueError(f"the chain of records in {short[0]['file']} ends at {short[0]['end'] or 0} of {short[0]['length']} bytes")
    long = records.where("mark is null").select("file", "at", "body", "to")

    def run(batches):
        for x in batches:
            marks = [digest(d[b : t - 4]) for b, t, d in zip(*(x.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(marks, pa.string())], ["file", "at", "whole"])

    if not long.take(1):
        return records
    # payloads longer than what a split's task has read: fetched by themselves
    far = long.join(files.select(F.col("path").alias("file"), "content"), "file").select(
        "file", "at", F.lit(0).cast("long").alias("b"), (F.col("to") - F.col("body")).alias("t"), F.substring("content", (F.col("body") + 1).cast("int"), (F.col("to") - F.col("body")).cast("int")).alias("d"))
    far = far.mapInArrow(run, "file string, at long, whole string")
    return records.join(far, ["file", "at"], "left").withColumn("mark", F.coalesce("mark", "whole")).drop("whole")


def archive_roundtrip(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write archives and read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A response's digest is computed from the bytes read; a revisit takes size and
    digest of the response that it names. Empty input gives no rows.
    """
    write_archives(pages, path, id_col, uri_col, payload_col, least)
    records = read_archives(pages.sparkSession, path).withColumn("size", F.col("to") - F.col("body") - 4)
    records = records.withColumn("key", F.concat_ws(":", "refers", "digest"))  # an id may repeat with another payload
    target = records.where("kind = 'response'").groupBy(F.concat_ws(":", "id", "mark").alias("key")).agg(F.first("size").alias("full"), F.first("mark").alias("full_mark"))
    out = salted_join(records, target, "key", "id", "left")
    revisit = F.col("kind") == "revisit"
    return out.select(
        F.col("id").alias("page_id"), F.when(revisit, F.col("full")).otherwise(F.col("size")).alias("payload_bytes"), F.when(revisit, F.col("full_mark")).otherwise(F.col("mark")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"),
    )
