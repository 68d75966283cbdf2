"""Registered queries of the quality family."""

from pyspark.sql import functions as F

from telemill.functions.integers import floor_div
from telemill.operators import ordered, quality, windows
from telemill.plans.registry import DAY, HOUR, cte, micros, points, query, table
from telemill.schemas import POINT_KEY

cte(
    "typed",
    """
SELECT seq, CASE WHEN k % 17 = 3 THEN -ts_ns ELSE ts_ns END AS ts_ns, entity_id, metric_id, value, quality,
       CASE k % 13 WHEN 5 THEN 'planet' WHEN 6 THEN 'pod' ELSE 'host' END AS entity_type,
       CASE k % 19 WHEN 4 THEN 'rumour' ELSE 'replay' END AS source,
       CASE WHEN k % 23 = 7 THEN 0 WHEN k % 2 = 0 THEN 1000 END AS sample_interval_ns
FROM points
""",
    ("points",),
)


def typed(spark, sf):
    k = F.col("k")
    return points(spark, sf).select(
        "seq",
        F.when(k % 17 == 3, -F.col("ts_ns")).otherwise(F.col("ts_ns")).alias("ts_ns"),
        "entity_id",
        "metric_id",
        "value",
        "quality",
        F.when(k % 13 == 5, "planet").when(k % 13 == 6, "pod").otherwise("host").alias("entity_type"),
        F.when(k % 19 == 4, "rumour").otherwise("replay").alias("source"),
        F.when(k % 23 == 7, 0).when(k % 2 == 0, 1000).cast("long").alias("sample_interval_ns"),
    )


@query(
    "q1_validate_points",
    """
SELECT seq, ts_ns, CASE WHEN ts_ns < 0 THEN 'bad_ts' WHEN entity_type = 'planet' THEN 'bad_entity_type'
  WHEN source = 'rumour' THEN 'bad_source' WHEN sample_interval_ns <= 0 THEN 'bad_interval' END AS reason FROM typed
""",
    ("typed",),
)
def q1(spark, sf):
    return quality.validate_points(typed(spark, sf)).select("seq", "ts_ns", "reason")


cte(
    "spans",
    """
SELECT CAST(o_custkey AS VARCHAR) AS trace_id, CAST(o_orderkey AS VARCHAR) AS span_id, o_orderpriority AS service_name,
       epoch_us(o_orderdate) * 1000 AS start_ts_ns,
       greatest(epoch_us(o_orderdate), coalesce(s, epoch_us(o_orderdate))) * 1000 AS end_ts_ns,
       CASE WHEN o_orderstatus = 'F' THEN 'ERR' ELSE 'OK' END AS status, o_orderkey
FROM orders LEFT JOIN (SELECT l_orderkey, max(epoch_us(l_shipdate)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""",
)


def spans(spark, sf):
    ship = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    o = table(spark, sf, "orders").join(ship, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    start = micros("o_orderdate")
    return o.select(
        F.col("o_custkey").cast("string").alias("trace_id"),
        F.col("o_orderkey").cast("string").alias("span_id"),
        F.col("o_orderpriority").alias("service_name"),
        (start * 1000).alias("start_ts_ns"),
        (F.greatest(start, F.coalesce(micros("s"), start)) * 1000).alias("end_ts_ns"),
        F.when(F.col("o_orderstatus") == "F", "ERR").otherwise("OK").alias("status"),
        "o_orderkey",
    )


_BROKEN = """
SELECT CASE WHEN o_orderkey % 31 = 2 THEN '  ' ELSE trace_id END AS trace_id,
       CAST(o_orderkey // (CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END) AS VARCHAR) AS span_id, start_ts_ns,
       CASE WHEN o_orderkey % 29 = 1 THEN start_ts_ns - 1 ELSE end_ts_ns END AS end_ts_ns, o_orderkey FROM spans
"""


@query(
    "q2_validate_spans",
    f"""
WITH b AS ({_BROKEN})
SELECT o_orderkey, CASE WHEN trim(trace_id) = '' THEN 'blank_id' WHEN end_ts_ns < start_ts_ns THEN 'end_before_start'
   WHEN count(*) OVER (PARTITION BY trace_id, span_id) > 1 THEN 'duplicate' END AS reason FROM b
""",
    ("spans",),
)
def q2(spark, sf):
    k = F.col("o_orderkey")
    b = spans(spark, sf).select(
        F.when(k % 31 == 2, "  ").otherwise(F.col("trace_id")).alias("trace_id"),
        F.when(k % 7 == 0, k).otherwise(F.floor(k / 2)).cast("long").cast("string").alias("span_id"),
        "start_ts_ns",
        F.when(k % 29 == 1, F.col("start_ts_ns") - 1).otherwise(F.col("end_ts_ns")).alias("end_ts_ns"),
        "o_orderkey",
    )
    return quality.validate_spans(b).select("o_orderkey", "reason")


@query(
    "q3_find_duplicates",
    f"""SELECT entity_id, metric_id, ts_ns // {HOUR} * {HOUR} AS ts_ns, quality, count(*) AS n FROM points
GROUP BY ALL HAVING count(*) > 1""",
    ("points",),
)
def q3(spark, sf):
    p = points(spark, sf).withColumn("ts_ns", F.col("ts_ns") - F.col("ts_ns") % HOUR)
    return quality.find_duplicates(p, POINT_KEY)


@query(
    "q4_partition_quality",
    "SELECT seq, CASE WHEN quality = 'observed' THEN 'observed' ELSE 'other' END AS part FROM points",
    ("points",),
)
def q4(spark, sf):
    a, b = quality.partition_quality(points(spark, sf))
    return a.select("seq", F.lit("observed").alias("part")).unionByName(b.select("seq", F.lit("other").alias("part")))


@query("q5_summarize_quality", "SELECT quality, count(*) AS n FROM points GROUP BY 1", ("points",))
def q5(spark, sf):
    return quality.summarize_quality(points(spark, sf))


W0 = 1704499200000000000  # 2024-01-06 00:00 UTC


@query(
    "q6_slice_window",
    f"SELECT seq, ts_ns, entity_id, metric_id FROM points WHERE ts_ns BETWEEN {W0} AND {W0 + 5 * DAY}",
    ("points",),
)
def q6(spark, sf):
    return quality.slice_window(points(spark, sf), W0, W0 + 5 * DAY).select("seq", "ts_ns", "entity_id", "metric_id")


@query("q7_entity_metrics", "SELECT DISTINCT entity_id, metric_id FROM points", ("points",))
def q7(spark, sf):
    return quality.entity_metrics(points(spark, sf))


_ARRIVAL = "seq // 20 * 20 + (seq * 7919) % 20"


@query(
    "q8_out_of_order",
    f"""
WITH a AS (SELECT seq, {_ARRIVAL} AS arrival, ts_ns // 60000000000 * 60000000000 AS ts_ns, entity_id, metric_id, quality FROM points),
m AS (SELECT *, max(ts_ns) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a),
l AS (SELECT *, newest IS NOT NULL AND ts_ns < newest - {HOUR} AS late FROM m),
d AS (SELECT seq, row_number() OVER (PARTITION BY entity_id, metric_id, ts_ns, quality ORDER BY arrival) AS rn FROM l WHERE NOT late)
SELECT l.seq, CASE WHEN late THEN 'late' WHEN rn > 1 THEN 'duplicate' ELSE 'accepted' END AS status FROM l LEFT JOIN d ON l.seq = d.seq
""",
    ("points",),
)
def q8(spark, sf):
    minute = 60_000_000_000
    p = points(spark, sf).withColumn("ts_ns", F.col("ts_ns") - F.col("ts_ns") % minute)
    base = F.col("seq") - F.col("seq") % 20
    a = p.withColumn("arrival", base + (F.col("seq") * 7919) % 20)
    return quality.out_of_order(a, "arrival", ordered.by_time("arrival", 5000), tolerance_ns=HOUR).select("seq", "status")


cte(
    "win",
    f"""
SELECT p.*, w_start, w_start + {DAY} AS w_end
FROM (SELECT *, unnest([ts_ns // {12 * HOUR} * {12 * HOUR}, ts_ns // {12 * HOUR} * {12 * HOUR} - {12 * HOUR}]) AS w_start FROM points) p
WHERE w_start >= (SELECT min(ts_ns) // {12 * HOUR} * {12 * HOUR} FROM points)
""",
    ("points",),
)
cte(
    "grid",
    f"""
SELECT g.w_start, g.w_end, g.entity_id, g.metric_id, g.cell_ts, c.value, coalesce(c.observed, false) AS observed
FROM (SELECT *, unnest(range(w_start, w_end, {HOUR})) AS cell_ts
      FROM (SELECT DISTINCT w_start, w_end, entity_id, metric_id FROM win)) g
LEFT JOIN (SELECT * FROM (SELECT w_start, entity_id, metric_id, ts_ns // {HOUR} * {HOUR} AS cell_ts, value, quality = 'observed' AS observed,
             row_number() OVER (PARTITION BY w_start, entity_id, metric_id, ts_ns // {HOUR} ORDER BY ts_ns DESC, seq DESC) AS rn
           FROM win WHERE value IS NOT NULL) WHERE rn = 1) c
ON c.w_start = g.w_start AND c.entity_id = g.entity_id AND c.metric_id = g.metric_id AND c.cell_ts = g.cell_ts
""",
    ("win",),
)


def win(spark, sf):
    return windows.sliding_windows(points(spark, sf), DAY, 12 * HOUR)


def grid(spark, sf):
    return windows.align_grid(win(spark, sf), HOUR)


@query(
    "q9_mid_stream_gap",
    """
WITH cell AS (SELECT w_start, entity_id, cell_ts, max(observed::INT) AS o FROM grid GROUP BY ALL),
a AS (SELECT w_start, entity_id, min(CASE WHEN o = 0 THEN cell_ts END) AS miss, min(CASE WHEN o = 1 THEN cell_ts END) AS f,
  max(CASE WHEN o = 1 THEN cell_ts END) AS l FROM cell GROUP BY ALL)
SELECT w_start, entity_id, coalesce(f < miss AND l > miss, false)::INT AS gap FROM a
""",
    ("grid",),
)
def q9(spark, sf):
    g = quality.real_mid_stream_gap(grid(spark, sf), ["w_start", "entity_id"])
    return g.withColumn("gap", F.col("gap").cast("int"))


@query(
    "q10_run_id_on_reuse",
    f"""
WITH s AS (SELECT user_id AS pid, seq, ts_ns, ts_ns // {7 * DAY} AS start_time FROM points),
l AS (SELECT *, lag(start_time) OVER (PARTITION BY pid ORDER BY ts_ns, seq) AS p FROM s)
SELECT pid, seq, CAST(sum(CASE WHEN p <> start_time THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM l
""",
    ("points",),
)
def q10(spark, sf):
    s = points(spark, sf).select(
        F.col("user_id").alias("pid"), "seq", "ts_ns", floor_div(F.col("ts_ns"), F.lit(7 * DAY)).alias("start_time")
    )
    out = quality.run_id_on_reuse(s, ["pid"], ["ts_ns", "seq"], "start_time", ordered.by_time())
    return out.select("pid", "seq", "run")


@query("q11_gate_valid", "SELECT tid, ts_ns, c0 FROM ticks WHERE valid = 1", ("ticks",))
def q11(spark, sf):
    from telemill.plans.registry import ticks

    return quality.gate_valid(ticks(spark, sf)).select("tid", "ts_ns", "c0")


REQUIRED = [("coarse", "click"), ("coarse", "view"), ("coarse", "swap"), ("container", "error"), ("container", "restart"), ("fine", "signup")]
_REQ_SQL = " UNION ALL ".join(f"SELECT '{a}' AS layer, '{b}' AS metric_id" for a, b in REQUIRED)


@query(
    "q12_metric_coverage",
    f"""
WITH u AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, metric_id FROM points), r AS ({_REQ_SQL})
SELECT e.entity_id, r.layer, r.metric_id FROM (SELECT DISTINCT entity_id FROM u) e, r
WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.entity_id = e.entity_id AND u.metric_id = r.metric_id)
""",
    ("points",),
)
def q12(spark, sf):
    u = points(spark, sf).select(F.col("user_id").cast("string").alias("entity_id"), "metric_id")
    req = spark.createDataFrame(REQUIRED, "layer string, metric_id string")
    return quality.metric_coverage(u, req).select("entity_id", "layer", "metric_id")
