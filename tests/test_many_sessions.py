"""Many sessions in few folders; collector messages read once."""

import os

from pyspark.sql import functions as F

from telemill.functions.integers import floor_div
from telemill.session import fresh_path
from telemill.sources import messages, sessions


def test_sessions_share_folders(spark):
    root = fresh_path(spark)
    name = F.concat(F.lit("s"), F.col("id").cast("string")).alias("session")
    ids = spark.range(300)
    sessions.write_session_table(ids.select(name, F.lit("schema_version").alias("key"), F.when(F.col("id") < 290, "2").otherwise("1").alias("value")), root, "meta")
    sessions.write_session_table(ids.select(name, F.col("id").alias("ts_ns")), root, "host_cpu")
    assert len([f for f in os.listdir(f"{root}/host_cpu") if "=" in f]) <= 64
    assert sessions.read_session_table(spark, root, "host_cpu").count() == 290
    some = sessions.read_session_table(spark, root, "host_cpu", ["s7", "s12", "s295", "x"])
    assert sorted((r["session"], r["ts_ns"]) for r in some.collect()) == [("s12", 12), ("s7", 7)]
    assert some.columns == ["session", *[f.split()[0] for f in sessions.TABLES["host_cpu"].split(", ")]]


def test_steps_skip_missing_readings(spark):
    rows = [
        (1, '{"ts_ns": 5, "host": {"ctxt": 4}, "top_tasks": [{"pid": 3, "utime": 1, "rss_kb": 9}, {"utime": 8}]}'), (2, '{"ts_ns": 6, "host": {"procs_running": 2}}'),
        (3, '{"ts_ns": 25, "host": {"ctxt": 10}, "top_tasks": [{"tgid": 3, "comm": "a", "utime": 6}]}'), (4, '{"ts_ns": 26, "host": {"ctxt": 7}}'),
    ]
    parsed = messages.parse_features(spark.createDataFrame(rows, "seq long, value string").withColumn("src", F.lit(0)))
    out = messages.features_to_points(parsed, ["src"], ["ts_ns", "seq"], floor_div(F.col("ts_ns"), F.lit(10)))
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()  # messages were read once, into a table
    mine = out.where("metric_id IN ('ctxt', 'procs_running', 'cpu_user', 'rss') AND value IS NOT NULL")
    got = sorted((r["seq"], r["entity_id"], r["metric_id"], r["value"], r["attrs"].get("comm")) for r in mine.collect())
    assert got == [(1, "proc3", "rss", 9.0, ""), (2, "host", "procs_running", 2.0, None), (3, "host", "ctxt", 6.0, None), (3, "proc3", "cpu_user", 5.0, "a"), (4, "host", "ctxt", 0.0, None)]
