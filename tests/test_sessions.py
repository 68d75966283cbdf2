"""Typed session tables declared in the store, read in batch and as a stream."""

import pytest
from pyspark.sql import functions as F

from telemill.session import fresh_path
from telemill.sources import sessions
from telemill.streaming import jobs

S = 1_000_000_000
DRAINS = {"drains": "ts_ns bigint, ring string, head bigint", "notes": "seq bigint, line string"}


def meta(spark, root, *versions):
    rows = [(s, "schema_version", v) for s, v in versions]
    sessions.write_session_table(spark.createDataFrame(rows, "session string, key string, value string"), root, "meta")


def test_declared_tables(spark):
    root = fresh_path(spark)
    assert set(sessions.declared_tables(spark, root)) == {"meta", "host_cpu"}
    sessions.declare_tables(spark, root, DRAINS)
    sessions.declare_tables(spark, root, {"notes": DRAINS["notes"], "more": "a double, b array<int>"})
    assert {"drains", "notes", "more"} <= set(sessions.declared_tables(spark, root))
    with pytest.raises(ValueError, match="is declared as"):
        sessions.declare_tables(spark, root, {"notes": "seq string"})
    with pytest.raises(ValueError, match="no table 'other'"):
        sessions.read_session_table(spark, root, "other")
    meta(spark, root, ("a", "2"), ("b", "1"))
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "session string, seq int, line string")
    sessions.write_session_table(rows, root, "notes")
    sessions.write_session_table(rows.select("session", F.lit(7).alias("a")), root, "more")
    got = sessions.read_session_table(spark, root, "notes")
    assert [tuple(r) for r in got.select("session", "seq", "line").collect()] == [("a", 1, "x")]
    assert dict(got.dtypes)["seq"] == "bigint"
    assert sessions.read_session_table(spark, root, "more").select("a", "b").first() == (7.0, None)
    assert sessions.read_session_table(spark, root, "notes", ["b"]).count() == 0
    assert sorted(r["session"] for r in sessions.unsupported_sessions(spark, root).collect()) == ["b"]


def test_ring_gaps_from_a_session_stream(spark):
    root = fresh_path(spark)
    sessions.declare_tables(spark, root, DRAINS)
    meta(spark, root, ("a", "2"), ("old", "1"))

    def put(rows):
        kinds = "session string, ts_ns long, ring string, head long"
        return lambda: sessions.write_session_table(spark.createDataFrame(rows, kinds), root, "drains")

    put([("a", S, "r", 0)])()
    stream = sessions.stream_session_table(spark, root, "drains").withColumn("ring", F.concat_ws("/", "session", "ring"))
    feed = [put([("a", 2 * S, "r", 900), ("old", 2 * S, "r", 0)]), put([("a", 3 * S, "r", 950), ("old", 3 * S, "r", 999)]), put([("a", 9 * S, "r", 2000), ("a", 99 * S, "r", 2001)])]
    got = jobs.drain(jobs.ring_gaps(stream, "ring", 256, "1 second"), "gaps", feed=feed).collect()
    assert sorted(map(tuple, got)) == [("a/r", 2 * S, 0, 900), ("a/r", 9 * S, 950, 2000)]
