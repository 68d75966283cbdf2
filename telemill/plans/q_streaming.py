"""Registered streaming queries: the events table arrives in parts, and the query restarts from its checkpoint for each."""

from pyspark.sql import functions as F

from telemill.functions.integers import floor_div
from telemill.plans.registry import DAY, HOUR, micros, query, r6
from telemill.session import fresh_path
from telemill.streaming import jobs


PARTS = 3


def event_stream(spark, sf, by="ts"):
    """(stream of points, feed): the feed adds the events part by part, in the order of ``ts`` or of ``event_id``."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    at = micros("ts") if by == "ts" else F.floor(F.col("event_id") / 20)
    low, high = events.agg(F.min(at), F.max(at)).first()
    cuts = [low + (high + 1 - low) * i // PARTS for i in range(PARTS + 1)]
    root = fresh_path(spark)
    events.limit(0).write.parquet(root)

    def part(i):
        return lambda: events.where((at >= cuts[i]) & (at < cuts[i + 1])).write.mode("append").parquet(root)

    e = spark.readStream.schema(events.schema).parquet(root)
    return _points(e), [part(i) for i in range(PARTS)]


def _points(e):
    k = F.get_json_object("props", "$.k").cast("long")
    m = k % 20
    return e.select(
        F.col("event_id").alias("seq"), (micros("ts") * 1000).alias("ts_ns"), F.concat(F.lit("e"), (F.col("user_id") % 10).cast("string")).alias("entity_id"),
        F.col("event_type").alias("metric_id"), k.alias("k"), "user_id", F.when(m == 0, None).otherwise(F.col("value")).alias("value"),
        F.when(m == 0, "missing").when(m == 1, "stale").when(m == 2, "out_of_order").otherwise("observed").alias("quality"),
    )


# the watermark after the last batch: rows and deadlines before it have been handled
LATE = "1 hour"
mark = lambda cond="true": f"(SELECT max(ts_ns) // 1000000 * 1000000 FROM points WHERE {cond}) - {HOUR}"
W = mark()


@query(
    "r1_accept_or_reject",
    f"""
WITH a AS (SELECT entity_id, metric_id, seq // 20 * 20 + (seq * 7919) % 20 AS arrival, ts_ns // {2 * HOUR} * {2 * HOUR} AS ts_ns FROM points),
m AS (SELECT *, max(ts_ns) OVER (PARTITION BY entity_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a),
l AS (SELECT *, newest IS NOT NULL AND ts_ns < newest - {HOUR} AS late FROM m),
d AS (SELECT *, row_number() OVER (PARTITION BY entity_id, metric_id, ts_ns, late ORDER BY arrival) AS n FROM l)
SELECT entity_id, metric_id, arrival, ts_ns, CASE WHEN late THEN 'late' WHEN n > 1 THEN 'duplicate' ELSE 'accepted' END AS status FROM d
""",
    ("points",),
)
def r1(spark, sf):
    base = F.col("seq") - F.col("seq") % 20
    s, feed = event_stream(spark, sf, "event_id")
    s = s.select("entity_id", "metric_id", (base + (F.col("seq") * 7919) % 20).alias("arrival"), (floor_div(F.col("ts_ns"), F.lit(2 * HOUR)) * (2 * HOUR)).alias("ts_ns"))
    return jobs.drain(jobs.accept_or_reject(s, "entity_id", "arrival", ["metric_id"], HOUR), "sorted", feed=feed)


@query("r1_dedupe_in_watermark", "SELECT DISTINCT entity_id, metric_id, ts_ns, quality FROM points", ("points",))
def r1b(spark, sf):
    s, feed = event_stream(spark, sf)
    s = s.select("entity_id", "metric_id", "ts_ns", "quality")
    return jobs.drain(jobs.dedupe_in_watermark(s), "dedupe", feed=feed).select("entity_id", "metric_id", "ts_ns", "quality")


@query(
    "r2_last_value_and_ewma",
    f"""
WITH RECURSIVE b AS (SELECT entity_id, metric_id, ts_ns, seq, coalesce(value, 0) AS x, row_number() OVER w AS i, coalesce(value, 0) - lag(coalesce(value, 0)) OVER w AS d FROM points WINDOW w AS (PARTITION BY entity_id, metric_id ORDER BY ts_ns, seq)),
r AS (SELECT entity_id, metric_id, ts_ns, seq, i, d, x::DOUBLE AS y FROM b WHERE i = 1 UNION ALL SELECT b.entity_id, b.metric_id, b.ts_ns, b.seq, b.i, b.d, 0.2 * b.x + 0.8 * r.y FROM r JOIN b ON b.entity_id = r.entity_id AND b.metric_id = r.metric_id AND b.i = r.i + 1)
SELECT seq, round(CASE WHEN d IS NOT NULL THEN greatest(0, d) END, 6) AS step, round(y, 6) AS ewma FROM r WHERE ts_ns < {W}
""",
    ("points",),
)
def r2(spark, sf):
    s, feed = event_stream(spark, sf)
    s = s.select("entity_id", "metric_id", "ts_ns", "seq", F.coalesce("value", F.lit(0.0)).alias("x"))
    out = jobs.drain(jobs.last_value_and_ewma(s, ["entity_id", "metric_id"], ["ts_ns", "seq"], "x", lateness=LATE), "ewma", feed=feed)
    return out.select("seq", r6("step").alias("step"), r6("ewma").alias("ewma"))


def trace_stream(spark, sf):
    """(trace rows as in the batch queries, but with times in ns; feed)"""
    s, feed = event_stream(spark, sf)
    return s.select("seq", "ts_ns", F.col("user_id").alias("tid"), "k", F.col("metric_id").alias("kind")), feed


@query(
    "r2_live_run_queue",
    f"""
WITH e AS (SELECT user_id AS tid, ts_ns, seq, metric_id = 'view' AS b FROM points WHERE metric_id IN ('view', 'click')),
g AS (SELECT *, coalesce(sum((NOT b)::INT) OVER (PARTITION BY tid ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM e)
SELECT tid, max(seq) FILTER (NOT b) AS seq, max(ts_ns) FILTER (NOT b) - min(ts_ns) FILTER (b) AS lat_ns FROM g GROUP BY tid, grp
HAVING count(*) FILTER (b) > 0 AND max(ts_ns) FILTER (NOT b) < {mark("metric_id IN ('view', 'click')")}
""",
    ("points",),
)
def r2_run_queue(spark, sf):
    """P4 across batches."""
    s, feed = trace_stream(spark, sf)
    pairs = jobs.live_pairs(s, ["tid"], ["ts_ns", "seq"], F.col("kind") == "view", F.col("kind") == "click", [], earliest=True, lateness=LATE)
    return jobs.drain(pairs, "pairs", feed=feed).select("tid", "seq", "lat_ns")


@query(
    "r2_live_lock_waits",
    f"""
SELECT tid, seq, pa AS addr, ts_ns - pt AS lat_ns FROM (
  SELECT user_id AS tid, seq, ts_ns, metric_id AS kind, lag(metric_id) OVER w AS pk, lag(ts_ns) OVER w AS pt, lag(k % 9) OVER w AS pa
  FROM points WHERE metric_id IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, seq))
WHERE kind = 'click' AND pk = 'view' AND ts_ns < pt + {5 * DAY} AND ts_ns < {mark("metric_id IN ('view', 'click')")}
""",
    ("points",),
)
def r2_lock_waits(spark, sf):
    """P7 across batches; a wait of five days is given up."""
    s, feed = trace_stream(spark, sf)
    pairs = jobs.live_pairs(s.withColumn("addr", F.col("k") % 9), ["tid"], ["ts_ns", "seq"], F.col("kind") == "view", F.col("kind") == "click", ["addr"], lateness=LATE, expire_ns=5 * DAY)
    return jobs.drain(pairs, "pairs", feed=feed).select("tid", "seq", "addr", "lat_ns")


@query(
    "r2_live_points",
    f"""
WITH c AS (SELECT entity_id, metric_id, ts_ns, seq * 10 + k AS raw, metric_id = 'view' AS gauge FROM points),
d AS (SELECT *, raw - lag(raw) OVER (PARTITION BY entity_id, metric_id ORDER BY ts_ns) AS step FROM c)
SELECT entity_id, metric_id, ts_ns, raw::DOUBLE AS value FROM d WHERE gauge
UNION ALL SELECT entity_id, metric_id, ts_ns, greatest(0, step)::DOUBLE FROM d WHERE NOT gauge AND step IS NOT NULL AND ts_ns < {mark("metric_id <> 'view'")}
""",
    ("points",),
)
def r2_points(spark, sf):
    """S9 across batches: one metric is a gauge, the others cumulative."""
    s, feed = event_stream(spark, sf)
    raw = s.select("entity_id", "metric_id", "ts_ns", (F.col("seq") * 10 + F.col("k")).alias("raw"), F.when(F.col("metric_id") == "view", "g").otherwise("c").alias("kind"))
    return jobs.drain(jobs.live_points(raw, [], LATE), "points", feed=feed)


@query("r3_warmup_scorer")
def r3(spark, sf):
    s, feed = event_stream(spark, sf)
    root = fresh_path(spark)
    for put in feed:
        put()
        scorer = jobs.WarmupScorer(spark, 15 * DAY, DAY, 12 * HOUR, HOUR, root)
        s.writeStream.foreachBatch(scorer).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return scorer.scores(spark).select("w_start", "entity_id", "metric_id", r6("score").alias("score"), "direction")


_H6 = 6 * HOUR


@query(
    "r4_sliding_windows",
    f"""
WITH w AS (SELECT entity_id, metric_id, value, unnest([ts_ns // {_H6} * {_H6}, ts_ns // {_H6} * {_H6} - {_H6}]) AS w_start FROM points)
SELECT w_start, entity_id, metric_id, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS top FROM w
WHERE w_start + {2 * _H6} <= (SELECT max(ts_ns) FROM points) - {HOUR} GROUP BY ALL
""",
    ("points",),
)
def r4(spark, sf):
    s, feed = event_stream(spark, sf)
    out = jobs.drain(jobs.sliding_stats(s, "12 hours", "6 hours", "1 hour"), "sliding", feed=feed)
    return out.select("w_start", "entity_id", "metric_id", "n", F.round("total", 4).alias("total"), r6("top").alias("top"))


@query(
    "r5_live_episodes",
    f"""
WITH RECURSIVE t AS (SELECT user_id % 3 AS host, ts_ns AS ts, coalesce(value, 0) > 100 AS a FROM points),
s AS (SELECT host, min(ts) AS start FROM t WHERE a GROUP BY host
      UNION ALL SELECT s.host, min(t.ts) FROM s JOIN t ON t.host = s.host AND t.a AND t.ts >= s.start + {_H6} GROUP BY s.host),
r AS (SELECT host, ts, a, sum(a::INT) OVER (PARTITION BY host ORDER BY ts) AS run FROM t),
e AS (SELECT host, start, min(first) AS ended FROM (
        SELECT s.host, s.start, r.run, min(r.ts) AS first FROM s JOIN r ON r.host = s.host AND NOT r.a AND r.ts > s.start AND r.ts < s.start + {_H6} GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL)
SELECT host, start AS start_ns, coalesce(ended, start + {_H6}) AS end_ns, start + {_H6} AS deadline_ns, start + {_H6} AS closed_ns
FROM s LEFT JOIN e USING (host, start) WHERE start + {_H6} < {W}
""",
    ("points",),
)
def r5(spark, sf):
    s, feed = event_stream(spark, sf)
    s = s.select((F.col("user_id") % 3).alias("host"), "ts_ns", (F.coalesce("value", F.lit(0.0)) > 100).alias("is_anomaly"))
    return jobs.drain(jobs.live_episodes(s, "host", 6 * HOUR, lateness=LATE), "episodes", feed=feed)


@query(
    "r6_ring_gaps",
    f"""
WITH h AS (SELECT entity_id, ts_ns, seq * 10 + k AS head FROM points), l AS (SELECT *, lag(head) OVER (PARTITION BY entity_id ORDER BY ts_ns) AS p FROM h)
SELECT entity_id, ts_ns, p AS from_head, head AS to_head FROM l WHERE head - p >= 192 AND ts_ns < {W}
""",
    ("points",),
)
def r6_gaps(spark, sf):
    s, feed = event_stream(spark, sf)
    s = s.select("entity_id", "ts_ns", (F.col("seq") * 10 + F.col("k")).alias("head"))
    return jobs.drain(jobs.ring_gaps(s, "entity_id", 256, LATE), "gaps", feed=feed)
