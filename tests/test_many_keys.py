"""Many keys with few rows each share tasks and groups."""

import random

from pyspark.sql import functions as F

from telemill.functions.integers import floor_div
from telemill.operators import ordered
from telemill.streaming import jobs
from tests.test_streams import EVENTS, S, feed, run


def test_greedy_keeps_small_keys_whole(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), rng.randrange(400), i, rng.random() < 0.8) for i in range(3000)]
    rows += [(99, t, 3000 + t, True) for t in range(900)]
    want, free = [], {}
    for k, t, i, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        if ok and t >= free.get(k, -1):
            want.append(i)
            free[k] = t + 7
    df = spark.createDataFrame(rows, "k long, t long, i long, ok boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    chosen = lambda: ordered.greedy(df, ["k"], ["t", "i"], "t", "ok", 7, floor_div(F.col("t"), F.lit(50)))
    try:
        one = chosen()
        assert "FlatMapGroups" not in one._jdf.queryExecution().toString()  # no group per key
        assert sorted(r["i"] for r in one.collect()) == sorted(want)
        monkeypatch.setattr(ordered, "WHOLE", 500)  # key 99 in chunks
        assert sorted(r["i"] for r in chosen().collect()) == sorted(want)
        first = ordered.greedy(df, ["k"], ["t", "i"], "t", None, None, F.lit(0))
        assert first.count() == first.select("k").distinct().count() == 62
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_share_the_groups_of_a_fold(spark, monkeypatch):
    monkeypatch.setattr(jobs, "BUCKETS", 2)
    big = 2**60
    ids = [None, *range(big, big + 9)]
    batches = [[(i, (n + 1) * S, "b") for n, i in enumerate(ids)], [(i, (n + 20) * S, "e") for n, i in enumerate(ids)], [(7, 1000 * S, "b")]]
    stream, steps = feed(spark, EVENTS, batches)
    got = run(spark, jobs.live_pairs(stream, ["tid"], ["ts_ns"], F.col("kind") == "b", F.col("kind") == "e", [], lateness="1 second", expire_ns=500 * S), steps)
    assert got == sorted([(i, (n + 20) * S, (n + 1) * S, 19 * S) for n, i in enumerate(ids)], key=str)
