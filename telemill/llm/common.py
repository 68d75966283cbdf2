"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemill.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join ``left`` to the unique keys of ``right`` so that rows of one key fall into ``salts`` partitions.

    ``spread`` is a column of ``left`` that tells its rows apart. ``right`` is
    the smaller side and is repeated once per salt.
    """
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many, [key, "__salt"], how).drop("__salt")


def fanned_join(left: DataFrame, right: DataFrame, key: str, spread: str, per: int = 256) -> DataFrame:
    """Inner join with the unique keys of a heavy ``right``: a row of it is repeated once per ``per`` partners.

    ``left`` is read twice and should be a stored table; ``spread`` tells its rows apart.
    """
    fan = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("__fan"))
    dealt = salted_join(left, fan, key, spread).withColumn("__slot", F.pmod(F.xxhash64(spread, F.lit(7)), F.col("__fan")).cast("int")).drop("__fan")
    many = right.join(fan, key).withColumn("__slot", F.explode(F.sequence(F.lit(0), F.col("__fan") - 1))).drop("__fan")
    return dealt.join(many, [key, "__slot"]).drop("__slot")


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts go to Python in batches bounded by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based position of each row along ``order``, which should tell rows apart: ranges are ordered in their own tasks."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return cut(ranged.withColumn("__inner", inner).join(starts, "__range").withColumn(name, (F.col("__start") + F.col("__inner") - 1).cast("long")).drop("__range", "__inner", "__start"))


FILTER_BITS = 1 << 23


def key_filter(keys: DataFrame, position: str) -> np.ndarray:
    """A bitmap with the bits of all positions, hashes below ``FILTER_BITS``, set: 1 MB, however many keys there are.

    It only spares work: a key whose bit is 0 is certainly absent.
    """
    words = keys.select(F.col(position).alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 32 as int)))").alias("b"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for w, b in words.collect():  # at most 2^18 rows
        out[w] = b
    return out


def possible(bitmap: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (bitmap[positions >> 5] >> (positions & 31).astype(np.uint32)) & np.uint32(1) == 1


def places(col: str):
    """Filter position of a long column."""
    return F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(FILTER_BITS))


def unmarked(batch: pa.RecordBatch, bitmap: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch without its column ``__place``, and which rows may be in the bitmap; false for a null place."""
    at = batch.schema.get_field_index("__place")
    maybe = possible(bitmap, batch.column(at).fill_null(0).to_numpy()) & np.asarray(batch.column(at).is_valid())
    return batch.select([i for i in range(batch.num_columns) if i != at]), maybe


def placed(df: DataFrame, col: str) -> DataFrame:
    """Add ``__place``, the filter position of ``col``, for ``unmarked``."""
    return df.withColumn("__place", F.when(F.col(col).isNotNull(), places(col)))


def only_possible(df: DataFrame, bitmap: np.ndarray, col: str) -> DataFrame:
    """The rows whose key in ``col`` may be in the bitmap; a null key is not.

    Joins that concern few rows of a wide table then shuffle those rows only.
    """

    def run(batches):
        for batch in batches:
            rows, maybe = unmarked(batch, bitmap)
            yield rows.filter(pa.array(maybe))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return placed(df, col).mapInArrow(run, kinds)


def blobs(rec: np.ndarray, shard: np.ndarray, kind: int) -> pa.RecordBatch:
    """Records, sorted by shard, as a row per shard: ``shard``, ``kind`` and the records' bytes.

    A shuffle and a sort of such rows move thousands of records at once.
    """
    begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(rec) else np.zeros(0, np.int64)
    ends = np.append(begin, len(rec)) * rec.dtype.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rec))])
    return pa.RecordBatch.from_arrays([pa.array(shard[begin].astype(np.int32)), pa.array(np.full(len(begin), kind, np.int32)), data], ["shard", "kind", "data"])


def records(data: pa.Array, dtype: np.dtype) -> np.ndarray:
    """The records of all rows of a column made by ``blobs``."""
    if not len(data):
        return np.zeros(0, dtype)
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(dtype)


def by_shard(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[np.ndarray]:
    """All records of one shard after the other, from rows sorted by ``shard``."""
    now, held = None, []
    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        data = batch.column(batch.schema.get_field_index("data"))
        begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        for a, b in zip(begin, np.append(begin, len(shard))[1:]):
            if held and shard[a] != now:
                yield np.concatenate(held)
                held = []
            now = shard[a]
            held.append(records(data.slice(a, b - a), dtype).copy())
    if held:
        yield np.concatenate(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every id that has an edge: columns ``id``, ``component_id``.

    Alternates the large-star and small-star steps of connected components in
    map-reduce; every step is a minimum per node (combined on the map side)
    and a join, and its edges are written to the shared folder. Ends at the
    fixed point. Null or equal ends are no edges.
    """
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).unionByName(
                now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where(F.col("v") > F.col("u")), low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, "u", "v").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
