"""Stateful streams over hand-made batches: order, timers, expiry, restarts."""

import pytest
from pyspark.sql import functions as F

from telemill.session import fresh_path
from telemill.streaming import jobs

S = 1_000_000_000


def feed(spark, schema, batches):
    """(stream, feed of one file per batch)"""
    root = fresh_path(spark)
    spark.createDataFrame([], schema).write.parquet(root)

    def put(rows):
        return lambda: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)

    return spark.readStream.schema(schema).parquet(root), [put(b) for b in batches]


def run(spark, made, steps):
    return sorted(map(tuple, jobs.drain(made, "out", feed=steps).collect()), key=str)


TICKS = "host string, ts_ns long, is_anomaly boolean"


def test_a_silent_host_closes_at_its_deadline(spark):
    a = [("a", t * S, t == 3) for t in range(6)]  # silent from second 5 on
    b = [("b", t * S, False) for t in range(6)]
    later = [("b", t * S, t == 59) for t in range(6, 60)]
    stream, steps = feed(spark, TICKS, [a + b, later])
    got = run(spark, jobs.live_episodes(stream, "host", 10 * S, 3, "1 second"), steps)
    assert got == [("a", 3 * S, 13 * S, 13 * S, 13 * S)]  # b's own is open: its deadline is ahead of the watermark


def test_ticks_are_applied_in_event_time(spark):
    ticks = [("a", t * S, t in (2, 3, 20, 21)) for t in range(40)]
    batches = [[x for i, x in enumerate(ticks) if i % 3 == k] for k in range(3)]
    late = [[*batches[0][:5]], [*batches[1][:5], *batches[2][:5]], [*batches[0][5:], *batches[1][5:], *batches[2][5:]]]
    want = [("a", 2 * S, 4 * S, 9 * S, 9 * S), ("a", 20 * S, 22 * S, 27 * S, 27 * S)]
    for split in ([ticks], late, [ticks[:20], ticks[20:]]):
        stream, steps = feed(spark, TICKS, [list(reversed(b)) for b in split])
        assert run(spark, jobs.live_episodes(stream, "host", 7 * S, 3, "60 seconds"), [*steps]) == []  # nothing is behind the watermark yet
        stream, steps = feed(spark, TICKS, [*[list(reversed(b)) for b in split], [("z", 1000 * S, False)]])
        assert run(spark, jobs.live_episodes(stream, "host", 7 * S, 3, "60 seconds"), steps) == want


def test_a_tick_after_the_deadline_may_open_the_next(spark):
    stream, steps = feed(spark, TICKS, [[("a", S, True), ("a", 6 * S, True), ("a", 7 * S, False), ("z", 100 * S, False)]])
    got = run(spark, jobs.live_episodes(stream, "host", 5 * S, 1, "1 second"), steps)
    assert got == [("a", S, 6 * S, 6 * S, 6 * S), ("a", 6 * S, 7 * S, 11 * S, 11 * S)]


EVENTS = "tid long, ts_ns long, kind string"


@pytest.mark.parametrize("earliest", [False, True])
def test_pairs_across_batches_and_expiry(spark, earliest):
    batches = [
        [(1, 1 * S, "b"), (1, 2 * S, "b"), (2, 1 * S, "b"), (3, 1 * S, "e")],
        [(1, 4 * S, "e"), (1, 5 * S, "e"), (9, 30 * S, "x"), (9, 31 * S, "b")],
        [(2, 40 * S, "e"), (1, 41 * S, "b"), (1, 42 * S, "e"), (9, 60 * S, "e")],
        [(7, 200 * S, "e")],
    ]
    stream, steps = feed(spark, EVENTS, batches)
    pairs = jobs.live_pairs(stream, ["tid"], ["ts_ns"], F.col("kind") == "b", F.col("kind") == "e", [], earliest, "2 seconds", expire_ns=35 * S)
    got = run(spark, pairs, steps)
    first = 1 if earliest else 2
    # the begin of 2 was forgotten after 35 seconds
    assert got == sorted([(1, 4 * S, first * S, (4 - first) * S), (1, 42 * S, 41 * S, S), (9, 60 * S, 31 * S, 29 * S)], key=str)


def test_expired_state_is_gone(spark):
    stream, steps = feed(spark, EVENTS, [[(i, S + i * 1000, "b") for i in range(50)], [(99, 500 * S, "b")], [(99, 501 * S, "e"), (98, 900 * S, "e")]])
    pairs = jobs.live_pairs(stream, ["tid"], ["ts_ns"], F.col("kind") == "b", F.col("kind") == "e", [], expire_ns=60 * S)
    root, left = fresh_path(spark), []
    for put in steps:
        put()
        q = pairs.writeStream.format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        left.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert left == [50, 1, 1]  # only rows that still wait for the watermark


def test_counters_forget_a_silent_key(spark):
    schema = "entity_id string, metric_id string, ts_ns long, raw double, kind string"
    c = lambda t, v: ("e", "m", (t + 1) * S, float(v), "c")
    batches = [[c(0, 5), c(1, 9), ("e", "g", S, 3.0, "g")], [c(3, 7), c(2, 12)], [c(50, 100), c(51, 101), ("e", "g", 51 * S, 4.0, "g")], [c(99, 0)]]
    stream, steps = feed(spark, schema, batches)
    got = run(spark, jobs.live_points(stream, [], "5 seconds", expire_ns=20 * S), steps)
    steps_ = [("e", "m", 2 * S, 4.0), ("e", "m", 3 * S, 3.0), ("e", "m", 4 * S, 0.0), ("e", "m", 52 * S, 1.0)]
    assert got == sorted([*steps_, ("e", "g", S, 3.0), ("e", "g", 51 * S, 4.0)], key=str)


def test_accepted_and_rejected_are_the_input(spark):
    schema = "src string, arrival long, metric_id string, ts_ns long"
    rows = [("a", 0, "m", 10 * S), ("a", 1, "m", 10 * S), ("a", 2, "n", 10 * S), ("a", 3, "m", 20 * S), ("a", 4, "m", 10 * S), ("a", 5, "m", 16 * S), ("a", 6, None, 16 * S),
            ("b", 7, "m", 10 * S), ("a", 8, "m", 16 * S), ("a", 9, None, 16 * S), ("a", 10, "m", 20 * S), ("a", 11, "m", 21 * S)]
    want = "accepted duplicate accepted accepted late accepted accepted accepted duplicate duplicate duplicate accepted".split()
    for size in (1, 4, 12):
        stream, steps = feed(spark, schema, [rows[i : i + size] for i in range(0, len(rows), size)])
        got = jobs.drain(jobs.accept_or_reject(stream, "src", "arrival", ["metric_id"], 5 * S), "out", feed=steps).orderBy("arrival").collect()
        assert [r["status"] for r in got] == want and [(r["src"], r["arrival"], r["metric_id"], r["ts_ns"]) for r in got] == rows


def test_ring_gaps_keep_the_newest_head(spark):
    schema = "ring string, ts_ns long, head long"
    stream, steps = feed(spark, schema, [[("r", S, 10), ("r", 2 * S, 300)], [("r", 3 * S, 310), ("q", 3 * S, 5)], [("r", 90 * S, 900), ("q", 99 * S, 6)]])
    assert run(spark, jobs.ring_gaps(stream, "ring", 256, "5 seconds"), steps) == [("r", 2 * S, 10, 300), ("r", 90 * S, 310, 900)]
