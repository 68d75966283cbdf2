"""Registered queries of the cross-host family: user_id % 3 is the host, its clock is host * 30 s off."""

from pyspark.sql import functions as F

from telemill.operators import fleet, ordered
from telemill.plans.q_rca import rca_logs, rca_points, rca_spans
from telemill.plans.registry import DAY, HOUR, cte, points, query, r6
from telemill.session import cut

OFF = 30_000_000_000
cte(
    "msg",
    f"""SELECT 'h' || user_id % 3 AS host_id, 'g' || seq // 4 AS incident_id, ts_ns AS s, ts_ns + (k % 7 + 1) * 60000000000 AS e, user_id % 3 * {OFF} AS off,
 CASE WHEN user_id % 3 = 2 THEN 'c2' ELSE 'c1' END AS cluster_id, value / 500 AS severity FROM points WHERE value > 80""",
    ("points",),
)


def host_points(spark, sf):
    return points(spark, sf).withColumn("host_id", F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")))


def incidents(spark, sf):
    p = host_points(spark, sf).where("value > 80")
    return p.select(
        "host_id", F.concat(F.lit("g"), F.floor(F.col("seq") / 4).cast("string")).alias("incident_id"), F.col("ts_ns").alias("start_ts_ns"),
        (F.col("ts_ns") + (F.col("k") % 7 + 1) * 60000000000).alias("end_ts_ns"), (F.col("value") / 500).alias("severity"),
    )


def agents(spark, sf):
    h = host_points(spark, sf).select("host_id", (F.col("user_id") % 3).alias("i")).distinct()
    return h.select("host_id", F.when(F.col("i") == 2, "c2").otherwise("c1").alias("cluster_id"), (F.col("i") * OFF).alias("clock_offset_ns"))


def messages(spark, sf):
    return fleet.agent_summaries(incidents(spark, sf), host_points(spark, sf), agents(spark, sf))


@query(
    "h1_agent_summaries",
    """
WITH q AS (SELECT host_id, string_agg(quality || '=' || n, ';' ORDER BY quality) AS quality FROM (SELECT 'h' || user_id % 3 AS host_id, quality, count(*) AS n FROM points GROUP BY ALL) GROUP BY 1)
SELECT msg.host_id, cluster_id, incident_id, s AS start_ts_ns, off AS clock_offset_ns, quality FROM msg JOIN q ON q.host_id = msg.host_id
""",
    ("msg",),
)
def h1(spark, sf):
    text = F.array_join(F.transform(F.map_entries("quality_summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return messages(spark, sf).select("host_id", "cluster_id", "incident_id", "start_ts_ns", "clock_offset_ns", text.alias("quality"))


@query(
    "h2_cluster_filter",
    "SELECT host_id, incident_id, s AS start_ts_ns, CASE WHEN cluster_id <> 'c1' THEN 'foreign cluster c2' END AS reason FROM msg",
    ("msg",),
)
def h2(spark, sf):
    own, bad = fleet.cluster_filter(messages(spark, sf), "c1")
    cols = ["host_id", "incident_id", "start_ts_ns"]
    return own.select(*cols, F.lit(None).cast("string").alias("reason")).unionByName(bad.select(*cols, "reason"))


@query(
    "h3_clock_correct",
    f"""SELECT 'window' AS kind, incident_id AS id, s + off AS t0, e + off AS t1 FROM msg UNION ALL SELECT 'point', CAST(seq AS VARCHAR), ts_ns + user_id % 3 * {OFF}, ts_ns + user_id % 3 * {OFF} FROM points""",
    ("msg", "points"),
)
def h3(spark, sf):
    w = fleet.clock_correct(messages(spark, sf)).select(F.lit("window").alias("kind"), F.col("incident_id").alias("id"), F.col("wall_start_ns").alias("t0"), F.col("wall_end_ns").alias("t1"))
    p = fleet.clock_correct_points(host_points(spark, sf), agents(spark, sf))
    return w.unionByName(p.select(F.lit("point").alias("kind"), F.col("seq").cast("string").alias("id"), F.col("ts_ns").alias("t0"), F.col("ts_ns").alias("t1")))


@query(
    "h4_group_incidents",
    "SELECT incident_id, array_to_string(list_sort(list(DISTINCT host_id)), ',') AS hosts, count(*) AS messages, min(s + off) AS wall_start_ns, max(e + off) AS wall_end_ns FROM msg GROUP BY 1",
    ("msg",),
)
def h4(spark, sf):
    g = fleet.group_incidents(fleet.clock_correct(messages(spark, sf)))
    return g.withColumn("hosts", F.array_join("hosts", ","))


@query(
    "h5_propagation_order",
    f"""
SELECT 'order' AS part, host_id, CAST(row_number() OVER (ORDER BY t, host_id) AS BIGINT) AS n FROM (SELECT host_id, min(s + off) AS t FROM msg GROUP BY 1)
UNION ALL SELECT 'skew', host_id, count(*) FROM (SELECT host_id, s + off - lag(s + off) OVER (PARTITION BY host_id ORDER BY s + off, incident_id) AS d FROM msg) WHERE d > {2 * HOUR} GROUP BY host_id
""",
    ("msg",),
)
def h5(spark, sf):
    m = cut(fleet.clock_correct(messages(spark, sf)))
    o = fleet.propagation_order(m).select(F.lit("order").alias("part"), "host_id", F.col("pos").cast("long").alias("n"))
    v = fleet.skew_violations(m, 2 * HOUR, ordered.by_time("wall_start_ns"))
    return o.unionByName(v.groupBy("host_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("skew").alias("part"), "host_id", "n"))


@query("h6_joint_analysis")
def h6(spark, sf):
    host = lambda df: df.withColumn("host_id", F.concat(F.lit("h"), F.col("case").cast("string"))).drop("case")
    # a cluster is one case of many columns, and the exact search over it grows exponentially: this query takes the later incidents, coarser seconds and three clusters
    late = incidents(spark, sf).where(F.col("start_ts_ns") > 1705363200000000000)
    msgs = late.join(agents(spark, sf), "host_id")
    rep = fleet.joint_analysis(
        host(rca_points(spark, sf)), host(rca_logs(spark, sf)), host(rca_spans(spark, sf)), msgs, agents(spark, sf), 30_000_000_000,
        bucket_ns=HOUR, resample=3, max_components=3, top_k=5,
    )
    return rep.select(F.col("cluster"), F.inline("candidates"), F.array_join("limitations", "; ").alias("limitations")).select("cluster", "rank", "entity_id", "limitations")


@query(
    "h7_summary_bytes",
    """SELECT host_id, CAST(sum(n) AS BIGINT) AS bytes, max(n)::BIGINT AS largest FROM (SELECT host_id, strlen('{"host_id":"' || host_id || '","incident_id":"' || incident_id || '","start_ts_ns":' || s || ',"end_ts_ns":' || e || '}') AS n FROM msg) GROUP BY 1""",
    ("msg",),
)
def h7(spark, sf):
    out = fleet.summary_bytes(messages(spark, sf).select("host_id", "incident_id", "start_ts_ns", "end_ts_ns"))
    return out.withColumn("largest", F.col("largest").cast("long"))
