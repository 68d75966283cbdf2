"""Registered queries of the top-k family: ``ticks`` as thread snapshots of three hosts, one tick a day."""

from pyspark.sql import functions as F

from telemill.operators import ordered, topk
from telemill.plans.registry import DAY, cte, points, query, r6, ticks

H = ["host"]
CH = lambda: ordered.by_time("ts_ns", 6 * DAY)
W = 3 * 86400
C = topk.COUNTERS
_COLS = ", ".join(f"c{j} * {m} AS {c}" for j, (c, m) in enumerate(zip(C, (10**9, 10**4, 10**5, 10**6, 10**9, 10**5, 10**4, 10**4))))
cte("snap", f"SELECT host, ts_ns, tid, tgid, {_COLS} FROM ticks", ("ticks",))
cte(
    "delta",
    f"""
WITH t AS (SELECT DISTINCT host, ts_ns FROM snap),
b AS (SELECT host, ts_ns, coalesce(min(ts_ns) OVER (PARTITION BY host ORDER BY ts_ns RANGE BETWEEN {W}000000000 PRECEDING AND 1 PRECEDING), lag(ts_ns) OVER (PARTITION BY host ORDER BY ts_ns)) AS base_ts FROM t)
SELECT s.host, s.ts_ns, s.tid, s.tgid, (s.ts_ns - base_ts) / 1e9 AS window_s, """
    + ", ".join(f"greatest(0, s.{c} - coalesce(o.{c}, 0)) AS {c}" for c in C)
    + " FROM snap s JOIN b ON b.host = s.host AND b.ts_ns = s.ts_ns AND base_ts IS NOT NULL LEFT JOIN snap o ON o.host = s.host AND o.ts_ns = base_ts AND o.tid = s.tid",
    ("snap",),
)


def _sat(x):
    return f"greatest(0, least(1, {x}))"


SCORE = (
    f"0.35 * {_sat('on_cpu_ns / (window_s * 1e9)')} + 0.15 * {_sat('(sw_vol + sw_invol) / window_s / 1e4')} + 0.2 * ({_sat('io_ops / window_s / 1e4')} + {_sat('io_bytes / window_s / 1073741824.0')}) / 2"
    f" + 0.15 * {_sat('(pf_minor + pf_major) / window_s / 1e4')} + 0.15 * {_sat('lock_waits / window_s / 1e3')}"
)
cte("proc", "SELECT host, ts_ns, tgid, max(window_s) AS window_s, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in C) + " FROM delta GROUP BY ALL", ("delta",))
# ranks compare the score times 20 * 2^30 * the window in ns, a whole number: sums of doubles would leave ties to rounding


def _exact(q=""):
    w = f"CAST(round({q}window_s * 1e9) AS HUGEINT)"
    sat = lambda x, top=w: f"greatest(0::HUGEINT, least({top}, CAST({x} AS HUGEINT)))"
    return (
        f"(7 * {sat(q + 'on_cpu_ns')} + 3 * {sat(f'({q}sw_vol + {q}sw_invol) * 100000')} + 2 * {sat(q + 'io_ops * 100000')} + 3 * {sat(f'({q}pf_minor + {q}pf_major) * 100000')}"
        f" + 3 * {sat(q + 'lock_waits * 1000000')}) * 1073741824 + 2 * {sat(f'{q}io_bytes::HUGEINT * 1000000000', f'{w} * 1073741824')}"
    )


cte("ranked", f"SELECT *, row_number() OVER (PARTITION BY host, ts_ns ORDER BY {_exact()} DESC, tgid) AS rank, {SCORE} AS score FROM proc", ("proc",))


def snapshots(spark, sf):
    muls = (10**9, 10**4, 10**5, 10**6, 10**9, 10**5, 10**4, 10**4)
    return ticks(spark, sf).select("host", "ts_ns", "tid", "tgid", *[(F.col(f"c{j}") * F.lit(m)).alias(c) for j, (c, m) in enumerate(zip(C, muls))])


def deltas(spark, sf):
    return topk.window_delta(snapshots(spark, sf), H, CH(), window_s=W)


def ranks(spark, sf):
    return topk.rank(topk.process_rollup(deltas(spark, sf), H).withColumn("score", topk.exact_score()), H)


@query("t1_window_delta", "SELECT host, ts_ns, tid, round(window_s, 3) AS window_s, on_cpu_ns, io_bytes, lock_waits FROM delta", ("delta",))
def t1(spark, sf):
    return deltas(spark, sf).select("host", "ts_ns", "tid", F.round("window_s", 3).alias("window_s"), "on_cpu_ns", "io_bytes", "lock_waits")


@query("t2_activity_score", f"SELECT host, ts_ns, tid, round({SCORE}, 6) AS score FROM delta", ("delta",))
def t2(spark, sf):
    return deltas(spark, sf).select("host", "ts_ns", "tid", r6(topk.activity_score()).alias("score"))


@query("t3_process_rollup", f"SELECT host, ts_ns, tgid, on_cpu_ns, round({SCORE}, 6) AS score FROM proc", ("proc",))
def t3(spark, sf):
    return topk.process_rollup(deltas(spark, sf), H).select("host", "ts_ns", "tgid", "on_cpu_ns", r6("score").alias("score"))


@query("t4_rank", "SELECT host, ts_ns, tgid, rank FROM ranked", ("ranked",))
def t4(spark, sf):
    return ranks(spark, sf).select("host", "ts_ns", "tgid", "rank")


def _members(spark, sf):
    return topk.hysteresis(ranks(spark, sf), "host", CH(), enter_rank=8, leave_rank=12, hold_periods=2, min_residency_s=86400, budget=6)


@query("t5_hysteresis")
def t5(spark, sf):
    return _members(spark, sf)


# SQL checks of the steps after the membership use the enter band itself as members
@query(
    "t6_top_threads",
    f"""
WITH b AS (SELECT d.host, d.ts_ns, d.tid, d.tgid, r.rank, row_number() OVER (PARTITION BY d.host, d.ts_ns, d.tgid ORDER BY {_exact('d.')} DESC, d.tid) AS r2
  FROM delta d JOIN ranked r ON r.host = d.host AND r.ts_ns = d.ts_ns AND r.tgid = d.tgid WHERE r.rank <= 8)
SELECT host, ts_ns, tid, tgid FROM (SELECT *, row_number() OVER (PARTITION BY host, ts_ns ORDER BY rank, tgid, r2) AS n FROM b WHERE r2 <= 2) WHERE n <= 10
""",
    ("delta", "ranked"),
)
def t6(spark, sf):
    d = deltas(spark, sf)
    threads = d.withColumn("score", topk.exact_score()).select("host", "ts_ns", "tid", "tgid", "score")
    members = ranks(spark, sf).where("rank <= 8").select("host", "ts_ns", "tgid", "rank")
    return topk.top_threads(threads, members, H, 2, 10).select("host", "ts_ns", "tid", "tgid")


@query(
    "t7_membership_diff",
    """
WITH m AS (SELECT host, ts_ns, tgid FROM ranked WHERE rank <= 8), t AS (SELECT host, ts_ns, lag(ts_ns) OVER (PARTITION BY host ORDER BY ts_ns) AS p FROM (SELECT DISTINCT host, ts_ns FROM m)),
b AS (SELECT t.host, t.ts_ns, m.tgid FROM t JOIN m ON m.host = t.host AND m.ts_ns = t.p)
SELECT *, 'join' AS action FROM (SELECT * FROM m EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'leave' FROM (SELECT * FROM b EXCEPT SELECT * FROM m)
""",
    ("ranked",),
)
def t7(spark, sf):
    return topk.membership_diff(ranks(spark, sf).where("rank <= 8").select("host", "ts_ns", "tgid"), H, CH(), "tgid")


_PR = """SELECT host, ts_ns, tid AS pid, CASE WHEN tid % 7 = 0 THEN 0 ELSE tgid END AS tgid, c0 AS utime, c1 AS stime, c2 AS nvcsw, c3 AS nivcsw, c4 AS minflt, c5 AS majflt, c6 AS total_vm, c7 AS rss_kb,
 c8 AS state, c9 AS start_time, 'c' || c0 % 5 AS comm FROM ticks"""
cte("procs", _PR, ("ticks",))


def procs(spark, sf):
    names = ("utime", "stime", "nvcsw", "nivcsw", "minflt", "majflt", "total_vm", "rss_kb", "state", "start_time")
    t = ticks(spark, sf).withColumn("comm", F.concat(F.lit("c"), (F.col("c0") % 5).cast("string")))
    return t.withColumnsRenamed({f"c{j}": n for j, n in enumerate(names)}).withColumnRenamed("tid", "pid").withColumn(
        "tgid", F.when(F.col("pid") % 7 == 0, 0).otherwise(F.col("tgid"))
    )


@query(
    "t8_top_tasks",
    "SELECT host, ts_ns, pid FROM (SELECT *, row_number() OVER (PARTITION BY host, ts_ns ORDER BY utime + stime DESC, pid) AS r FROM procs) WHERE r <= 20",
    ("procs",),
)
def t8(spark, sf):
    return topk.top_tasks(procs(spark, sf), H, 20).select("host", "ts_ns", "pid")


@query(
    "t9_task_rollup",
    """SELECT host, ts_ns, g AS tgid, CAST(sum(utime) AS BIGINT) AS utime, CAST(sum(stime) AS BIGINT) AS stime, CAST(sum(total_vm) AS BIGINT) AS total_vm, arg_min(state, pid) AS state, arg_min(rss_kb, pid) AS rss_kb, max(comm) FILTER (pid = g) AS comm
FROM (SELECT *, CASE WHEN tgid = 0 THEN pid ELSE tgid END AS g FROM procs) GROUP BY ALL""",
    ("procs",),
)
def t9(spark, sf):
    return topk.task_rollup(procs(spark, sf), H).select("host", "ts_ns", "tgid", "utime", "stime", "total_vm", "state", "rss_kb", "comm")


@query(
    "t10_counter_totals",
    """
SELECT s.host, s.ts_ns, CAST(sum(CASE WHEN s.on_cpu_ns <> 0 THEN s.on_cpu_ns ELSE (utime + stime) * 10000000 END) AS BIGINT) AS on_cpu_ns_total, CAST(sum(sw_vol + sw_invol) AS BIGINT) AS switch_total, CAST(sum(lock_waits) AS BIGINT) AS lock_waits_total
FROM snap s JOIN procs p ON p.host = s.host AND p.ts_ns = s.ts_ns AND p.pid = s.tid WHERE s.tid % 3 <> 1 GROUP BY ALL
""",
    ("snap", "procs"),
)
def t10(spark, sf):
    s = snapshots(spark, sf)
    out = topk.counter_totals(s, s.where("tid % 3 <> 1").select("host", "ts_ns", "tid"), procs(spark, sf), H)
    return out.select("host", "ts_ns", "on_cpu_ns_total", "switch_total", "lock_waits_total")


@query(
    "t11_channel_top_k",
    "SELECT entity_id, metric_id, round(v, 4) AS variance FROM (SELECT entity_id, metric_id, var_pop(value) AS v, row_number() OVER (PARTITION BY entity_id ORDER BY var_pop(value) DESC, metric_id) AS r FROM points GROUP BY 1, 2) WHERE r <= 3",
    ("points",),
)
def t11(spark, sf):
    return topk.channel_top_k(points(spark, sf), ["entity_id"], "metric_id", 3).select("entity_id", "metric_id", F.round("variance", 4).alias("variance"))
