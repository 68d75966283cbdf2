"""Registered queries of the window family."""

from pyspark.sql import functions as F

from telemill.operators import ordered, windows
from telemill.plans.q_quality import W0, grid, win
from telemill.plans.registry import DAY, HOUR, points, query, r6, ticks


@query("w1_sliding_windows", "SELECT seq, w_start, w_end FROM win", ("win",))
def w1(spark, sf):
    return win(spark, sf).select("seq", "w_start", "w_end")


@query(
    "w2_align_grid",
    "SELECT w_start, entity_id, metric_id, cell_ts, round(value, 6) AS value, observed::INT AS observed FROM grid",
    ("grid",),
)
def w2(spark, sf):
    return grid(spark, sf).select(
        "w_start", "entity_id", "metric_id", "cell_ts", r6("value").alias("value"), F.col("observed").cast("int").alias("observed")
    )


_SEC = 60_000_000_000


@query(
    "w3_infer_interval",
    f"""
WITH d AS (SELECT DISTINCT ts_ns // {_SEC} * {_SEC} AS ts FROM points), g AS (SELECT ts, ts - lag(ts) OVER (ORDER BY ts) AS gap FROM d)
SELECT gap FROM g WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, min(ts) LIMIT 1
""",
    ("points",),
)
def w3(spark, sf):
    p = points(spark, sf).select((F.col("ts_ns") - F.col("ts_ns") % _SEC).alias("ts_ns"))
    return windows.infer_interval(p)


@query("w4_split_by_time", "SELECT seq, split FROM labelled", ("labelled",))
def w4(spark, sf):
    return windows.split_by_time(points(spark, sf), 0.6, 0.2).select("seq", "split")


@query(
    "w5_decimate",
    """SELECT entity_id, seq, ts_ns FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts_ns, seq) AS rn FROM points)
WHERE (rn - 1) % 15 = 0""",
    ("points",),
)
def w5(spark, sf):
    out = windows.decimate(points(spark, sf), 15, ["entity_id"], ["ts_ns", "seq"], ordered.by_time())
    return out.select("entity_id", "seq", "ts_ns")


@query(
    "w6_label_incident",
    f"SELECT seq, CASE WHEN ts_ns // 1000000000 < {W0 // 10**9 + 86400} THEN 'baseline' ELSE 'incident' END AS phase FROM points",
    ("points",),
)
def w6(spark, sf):
    return windows.label_incident(points(spark, sf), W0 // 10**9 + 86400).select("seq", "phase")


_EP_SQL = """SELECT seq AS ep, entity_id AS ep_entity, ts_ns AS start_ns, ts_ns + (k % 5 + 1) * 1800000000000 AS end_ns
FROM points WHERE metric_id = 'error' AND value > 100"""


def episodes_from_errors(spark, sf):
    return points(spark, sf).where("metric_id = 'error' AND value > 100").select(
        F.col("seq").alias("ep"),
        F.col("entity_id").alias("ep_entity"),
        F.col("ts_ns").alias("start_ns"),
        (F.col("ts_ns") + (F.col("k") % 5 + 1) * 1800000000000).alias("end_ns"),
    )


@query(
    "w7_extract_around",
    f"""WITH ep AS ({_EP_SQL}) SELECT ep, p.seq, p.ts_ns FROM ep JOIN points p ON p.entity_id = ep_entity
AND p.ts_ns BETWEEN start_ns - {HOUR} AND end_ns""",
    ("points",),
)
def w7(spark, sf):
    ep = episodes_from_errors(spark, sf).withColumnRenamed("ep_entity", "entity_id")
    p = points(spark, sf).select("entity_id", "seq", "ts_ns")
    return windows.extract_around(ep, p, HOUR, 2 * HOUR, ["entity_id"]).select("ep", "seq", "ts_ns")


_H = ", ".join(f"CAST(sum(CASE WHEN b = {i} THEN k ELSE 0 END) AS BIGINT)" for i in range(4))


@query(
    "w8_merge_slices",
    f"""
WITH s AS (SELECT user_id AS tid, ts_ns // {7 * DAY} AS bucket, ts_ns, seq, k, k % 4 AS b, metric_id FROM points)
SELECT tid, bucket, max(ts_ns) AS ts_ns, CAST(sum(k) AS BIGINT) AS total, concat_ws(',', {_H}) AS hist,
  CAST(bit_or(k % 8) AS BIGINT) AS flags, arg_min(metric_id, (ts_ns, seq)) AS comm FROM s GROUP BY 1, 2
""",
    ("points",),
)
def w8(spark, sf):
    k = F.col("k")
    s = points(spark, sf).select(
        F.col("user_id").alias("tid"), "ts_ns", "seq", k.alias("total"), (k % 8).alias("flags"), F.col("metric_id").alias("comm"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(k % 4 == i, k).otherwise(F.lit(0))).alias("hist"),
    )
    m = windows.merge_slices(s, 7 * DAY, ["total"], ["hist"], 4, "flags", ["comm"])
    return m.withColumn("hist", F.concat_ws(",", F.col("hist").cast("array<string>")))


@query(
    "w9_retain",
    f"SELECT seq FROM points WHERE ts_ns >= (SELECT max(ts_ns) FROM points) - {90 * HOUR + 2 * DAY}",
    ("points",),
)
def w9(spark, sf):
    return windows.retain(points(spark, sf), 90 * HOUR, DAY).select("seq")


@query(
    "w10_ring_gaps",
    """
WITH h AS (SELECT entity_id, ts_ns, seq * 10 + k AS head FROM points),
l AS (SELECT *, lag(head) OVER (PARTITION BY entity_id ORDER BY ts_ns) AS p FROM h)
SELECT entity_id, ts_ns, p AS from_head, head AS to_head FROM l WHERE head - p >= 192
""",
    ("points",),
)
def w10(spark, sf):
    h = points(spark, sf).select("entity_id", "ts_ns", (F.col("seq") * 10 + F.col("k")).alias("head"))
    return windows.ring_gaps(h, ["entity_id"], 256, ordered.by_time())


@query(
    "w11_last_and_mean",
    """
WITH x AS (SELECT entity_id, metric_id, ts_ns / 3600e9 AS x, value AS y, seq FROM points),
e AS (SELECT entity_id, metric_id, max(x) AS hi, min(x) AS lo, arg_max(y, x) FILTER (y IS NOT NULL) AS last FROM x GROUP BY ALL)
SELECT e.entity_id, e.metric_id, round(max(last), 6) AS last, round(avg(y), 6) AS mean FROM x JOIN e USING (entity_id, metric_id)
WHERE x >= greatest(hi - 60, lo) GROUP BY ALL
""",
    ("points",),
)
def w11(spark, sf):
    p = points(spark, sf).select("entity_id", "metric_id", (F.col("ts_ns") / F.lit(3600e9)).alias("x"), F.col("value").alias("y"))
    out = windows.last_and_trailing_mean(p, ["entity_id", "metric_id"])
    return out.withColumns({"last": r6("last"), "mean": r6("mean")})


@query(
    "w12_decimate_min_max",
    f"""
WITH p AS (SELECT entity_id, ts_ns::DOUBLE AS x, value AS y, least(99, greatest(0, floor((ts_ns::DOUBLE - {float(W0)}) / {float(10 * DAY)} * 100))) AS b
 FROM points WHERE value IS NOT NULL AND ts_ns::DOUBLE BETWEEN {float(W0)} AND {float(W0 + 10 * DAY)})
SELECT entity_id, CAST(b AS BIGINT) AS bucket, count(*) AS n, round(min(y), 6) AS mn, round(max(y), 6) AS mx,
  round(CASE WHEN count(*) > 2 THEN min(y) ELSE arg_max(y, x) END, 6) AS draw_lo, round(CASE WHEN count(*) > 2 THEN max(y) ELSE arg_max(y, x) END, 6) AS draw_hi
FROM p GROUP BY 1, 2
""",
    ("points",),
)
def w12(spark, sf):
    p = points(spark, sf).select("entity_id", F.col("ts_ns").cast("double").alias("x"), F.col("value").alias("y"))
    d = windows.decimate_min_max(p, ["entity_id"], F.lit(float(W0)), F.lit(float(W0 + 10 * DAY)), 100)
    return d.select("entity_id", "bucket", "n", *[r6(c).alias(c) for c in ("mn", "mx", "draw_lo", "draw_hi")])


@query(
    "w13_relative_time",
    "SELECT tid, ts_ns, round((ts_ns - (SELECT min(ts_ns) FROM ticks)) / 1e9, 6) AS x FROM ticks",
    ("ticks",),
)
def w13(spark, sf):
    t = ticks(spark, sf)
    return windows.relative_time(t.select("tid", "ts_ns"), t, t).withColumn("x", r6("x"))
