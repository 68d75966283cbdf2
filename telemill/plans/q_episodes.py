"""Registered queries of episodes, evidence and drill-down."""

from pyspark.sql import functions as F

from telemill.functions.histograms import latency_stats
from telemill.operators import episodes as ep
from telemill.operators import ordered, pairing
from telemill.plans.q_pairing import _samples, file_table, finished_calls, lock_waits
from telemill.plans.q_rates import deep_series
from telemill.plans.q_sources import folded_lines
from telemill.plans.registry import DAY, HOUR, cte, points, query, r6, table, ticks
from telemill.session import cut
from telemill.sources import sessions

# an episode ordinal is the host here; fifteen deep columns over ten counters
_J = {c: j % 10 for j, c in enumerate((
    "on_cpu_ns", "nr_sw_vol", "nr_sw_invol", "io_ops", "io_bytes", "pf_minor", "pf_major", "lock_waits", "lock_lat_ns", "syscall_count",
    "syscall_lat_ns", "futex_waits", "futex_lat_ns", "runq_wait_count", "runq_wait_ns"))}
cte("deep", "SELECT host AS ordinal, tid, tgid, ts_ns, " + ", ".join(f"c{j} AS {c}" for c, j in _J.items()) + " FROM ticks", ("ticks",))


def deep(spark, sf):
    return ticks(spark, sf).select(F.col("host").alias("ordinal"), "tid", "tgid", "ts_ns", *[F.col(f"c{j}").alias(c) for c, j in _J.items()])


def _unpivot(src, keep, cols, agg=None):
    f = (lambda c: f"{agg}({c})") if agg else (lambda c: c)
    tail = " GROUP BY ALL" if agg else ""
    return " UNION ALL ".join(f"SELECT {keep}, '{c}' AS metric, CAST({f(c)} AS DOUBLE) AS value FROM {src}{tail}" for c in cols)


_K1 = _unpivot("deep WHERE tgid <> 0", "ordinal, ts_ns, 'proc' || tgid AS entity", ep.PROCESS_METRICS, "sum")
_TOP8 = "SELECT ordinal, tid FROM (SELECT ordinal, tid, row_number() OVER (PARTITION BY ordinal ORDER BY sum(" + " + ".join(ep.CONTENTION) + ") DESC, tid) AS r FROM deep GROUP BY ordinal, tid) WHERE r <= 8"
_K2 = _unpivot(f"deep SEMI JOIN ({_TOP8}) b ON b.ordinal = deep.ordinal AND b.tid = deep.tid", "deep.ordinal, ts_ns, 't' || deep.tid AS entity", ep.THREAD_METRICS)
cte("mem", "SELECT host AS ordinal, ts_ns, valid AS kswapd_active, c0 AS direct_reclaim, c1 AS nr_reclaimed FROM ticks", ("ticks",))
_K3 = _unpivot("mem", "ordinal, ts_ns, 'host' AS entity", ep.MEMORY_METRICS)


def mem(spark, sf):
    return ticks(spark, sf).select(F.col("host").alias("ordinal"), "ts_ns", F.col("valid").alias("kswapd_active"), F.col("c0").alias("direct_reclaim"), F.col("c1").alias("nr_reclaimed"))


_COLS = ("ordinal", "ts_ns", "entity", "metric", "value")


@query("k1_process_series", _K1, ("deep",))
def k1(spark, sf):
    return ep.process_series(deep(spark, sf)).select(*_COLS)


@query("k2_thread_series", _K2, ("deep",))
def k2(spark, sf):
    return ep.thread_series(deep(spark, sf)).select(*_COLS)


@query("k3_memory_series", _K3, ("mem",))
def k3(spark, sf):
    return ep.memory_series(mem(spark, sf), ["ordinal"]).select(*_COLS)


@query("s15_evidence_series", f"SELECT * FROM ({_K1}) UNION ALL SELECT * FROM ({_K2}) UNION ALL SELECT * FROM ({_K3})", ("deep", "mem"))
def s15(spark, sf):
    return ep.evidence_series(deep(spark, sf), mem(spark, sf)).select(*_COLS)


# hot-spot rows derived from points; the episode end is a function of the ordinal
cte("hot", "SELECT k % 4 AS ordinal, seq, user_id AS tid, metric_id AS nm, k AS count, value / 10 AS p99_us, k * 1048576 + k % 7 AS dev, ts_ns FROM points WHERE value IS NOT NULL", ("points",))


@query(
    "k4_event_rows",
    """
SELECT ordinal, 'syscall' AS kind, 't' || tid AS entity, nm AS name, count, NULL::BIGINT AS wait_ns, 1000 + ordinal AS ts_ns FROM hot WHERE nm = 'click'
UNION ALL SELECT ordinal, 'lock', 'host', nm, count, NULL, 1000 + ordinal FROM hot WHERE nm = 'view'
UNION ALL SELECT ordinal, 'runq', 't' || tid, NULL, count, CAST(trunc(p99_us * 1000) AS BIGINT), 1000 + ordinal FROM hot WHERE nm = 'signup'
UNION ALL SELECT ordinal, 'iofile', 'dev' || (dev >> 20) || 'm' || (dev & 1048575), '/f/' || nm, count, CAST(trunc(p99_us * 1000) AS BIGINT), 1000 + ordinal FROM hot WHERE nm = 'purchase'
UNION ALL SELECT ordinal, 'oom', 'host', 'c' || tid, 1, NULL, ts_ns FROM hot WHERE nm = 'error'
""",
    ("hot",),
)
def k4(spark, sf):
    k = F.col("k")
    h = points(spark, sf).where("value IS NOT NULL").select(
        (k % 4).alias("ordinal"), F.col("user_id").alias("tid"), F.col("metric_id").alias("nm"), k.alias("count"), (F.col("value") / 10).alias("p99_us"), (k * 1048576 + k % 7).alias("dev"), "ts_ns"
    )
    of = lambda n: h.where(F.col("nm") == n)
    ends = h.select("ordinal").distinct().withColumn("end_ns", F.lit(1000) + F.col("ordinal"))
    return ep.event_rows(
        ends, of("error").withColumn("comm", F.concat(F.lit("c"), F.col("tid").cast("string"))), of("click").withColumn("name", F.col("nm")), of("view").withColumn("sym", F.col("nm")),
        of("signup"), of("purchase").withColumns({"path": F.concat(F.lit("/f/"), "nm"), "ops": F.col("count")}),
    ).select("ordinal", "kind", "entity", "name", "count", "wait_ns", "ts_ns")


_POST = 6 * HOUR
cte(
    "eps",
    f"""
SELECT host, start AS start_ns, CASE WHEN en = 0 THEN ts ELSE en END AS end_ns, start + {_POST} AS deadline_ns, ts AS closed_ns FROM (
WITH RECURSIVE b AS (SELECT user_id % 3 AS host, ts_ns AS ts, value > 100 AS a, row_number() OVER w AS i, ts_ns = max(ts_ns) OVER (PARTITION BY user_id % 3) AS fin FROM (SELECT user_id, ts_ns, coalesce(value, 0) AS value FROM points) WINDOW w AS (PARTITION BY user_id % 3 ORDER BY ts_ns)),
s AS (SELECT host, i, ts, fin, a AS deep, CASE WHEN a THEN ts ELSE 0 END AS start, 0::BIGINT AS ff, 0 AS n, 0::BIGINT AS en, a AND fin AS closed FROM b WHERE i = 1
 UNION ALL SELECT b.host, b.i, b.ts, b.fin, d.deep, d.start, d.ff, d.n, CASE WHEN d.n >= 3 AND d.en = 0 THEN d.ff ELSE d.en END, d.deep AND (b.ts >= d.start + {_POST} OR b.fin)
 FROM (SELECT s.*, b.ts AS bts, b.a AS ba, (s.deep AND NOT s.closed) OR b.a AS ndeep, s.deep AND NOT s.closed AS inn FROM s JOIN b ON b.host = s.host AND b.i = s.i + 1) x
 JOIN b ON b.host = x.host AND b.i = x.i + 1, LATERAL (SELECT x.ndeep AS deep, CASE WHEN x.inn THEN x.start WHEN x.ba THEN x.bts ELSE 0 END AS start,
   CASE WHEN NOT x.inn OR x.ba THEN 0 WHEN x.n = 0 THEN x.bts ELSE x.ff END AS ff, CASE WHEN NOT x.inn OR x.ba THEN 0 ELSE x.n + 1 END AS n, CASE WHEN x.inn THEN x.en ELSE 0 END AS en) d)
SELECT * FROM s WHERE closed)
""",
    ("points",),
)


def host_ticks(spark, sf):
    return points(spark, sf).select((F.col("user_id") % 3).alias("host"), "ts_ns", (F.coalesce("value", F.lit(0.0)) > 100).alias("is_anomaly"))


def found_episodes(spark, sf):
    return ep.episodes(host_ticks(spark, sf), "host", ordered.by_time("ts_ns", 5 * DAY), post_ns=_POST)


@query("k5_episodes", "SELECT * FROM eps", ("eps",))
def k5(spark, sf):
    return found_episodes(spark, sf)


@query(
    "k6_episode_series",
    f"SELECT e.host, start_ns, seq FROM eps e JOIN points p ON p.user_id % 3 = e.host AND p.ts_ns BETWEEN start_ns - {HOUR} AND deadline_ns",
    ("eps", "points"),
)
def k6(spark, sf):
    s = points(spark, sf).select((F.col("user_id") % 3).alias("host"), "ts_ns", "seq")
    return ep.episode_series(cut(found_episodes(spark, sf)), s, HOUR, _POST, ["host"]).select("host", "start_ns", "seq")


cte(
    "tn",
    """SELECT t.tid, t.pid, t.tname, coalesce(p.main, p.any) AS pname FROM (SELECT tid, arg_max(tgid, ts_ns) AS pid, arg_max('c' || c0 % 5, ts_ns) AS tname FROM ticks GROUP BY 1) t
JOIN (SELECT pid, max(tname) FILTER (tid = pid) AS main, arg_min(tname, tid) AS any FROM (SELECT tid, arg_max(tgid, ts_ns) AS pid, arg_max('c' || c0 % 5, ts_ns) AS tname FROM ticks GROUP BY 1) GROUP BY 1) p ON p.pid = t.pid""",
    ("ticks",),
)


@query(
    "k7_hot_table",
    "SELECT a.tid, id, count, coalesce(pname, '') AS pname, coalesce(tname, '') AS tname FROM (SELECT tid, id, count(*) AS count FROM calls WHERE NOT fw GROUP BY ALL) a JOIN tn ON tn.tid = a.tid WHERE pid = 3",
    ("calls", "tn"),
)
def k7(spark, sf):
    named = ticks(spark, sf).withColumn("comm", F.concat(F.lit("c"), (F.col("c0") % 5).cast("string")))
    t = pairing.syscall_tables(finished_calls(spark, sf))["by_call"].select("tid", "id", "count")
    return ep.hot_table(t, "deep_syscall", ep.thread_names(named), pid=3).select("tid", "id", "count", "pname", "tname")


@query(
    "k8_file_rollup",
    "SELECT 'p' || k % 20 AS path, CAST(sum(k) AS BIGINT) AS bytes, count(*) AS ops, CAST(sum(k % 2) AS BIGINT) AS errors, arg_min(user_id, seq) AS dev, arg_min(k, seq) AS ino FROM points GROUP BY 1",
    ("points",),
)
def k8(spark, sf):
    k = F.col("k")
    f = points(spark, sf).select("seq", F.concat(F.lit("p"), (k % 20).cast("string")).alias("path"), k.alias("bytes"), F.lit(1).alias("ops"), (k % 2).alias("errors"), F.col("user_id").alias("dev"), k.alias("ino"))
    return ep.file_rollup(f)


@query("k9_table_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%' OR CAST(p_partkey AS VARCHAR) ILIKE '%ring%'")
def k9(spark, sf):
    return ep.table_search(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), " RING ", "p_brand")


@query(
    "k10_log_search",
    "SELECT seq, level FROM (SELECT conv_id * 1000 + turn AS seq, CASE role WHEN 'user' THEN 'INFO' ELSE 'WARN' END AS level, text FROM conversations) WHERE level = 'WARN' AND contains(lower(text), 'an')",
)
def k10(spark, sf):
    c = table(spark, sf, "conversations")
    logs = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.when(F.col("role") == "user", "INFO").otherwise("WARN").alias("level"), F.col("text").alias("line"))
    return ep.log_search(logs, ["WARN"], "AN").select("seq", "level")


@query(
    "k11_flame_tree",
    """
WITH l AS (SELECT string_split(left(line, length(line) - length(string_split(line, ' ')[-1]) - 1), ';') AS f, p_size AS v FROM folded WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_size > 0),
n AS (SELECT f, v, unnest(range(1, len(f) + 1)) AS d FROM l)
SELECT array_to_string(f[1:d], ';') AS path, CAST(d AS INT) AS depth, f[d] AS name, CAST(sum(v) AS DOUBLE) AS value, CAST(sum(CASE WHEN d = len(f) THEN v ELSE 0 END) AS DOUBLE) AS self FROM n GROUP BY ALL
""",
    ("folded",),
)
def k11(spark, sf):
    t = ep.flame_tree(sessions.parse_folded(folded_lines(spark, sf)))
    return t.select(F.array_join("path", ";").alias("path"), "depth", "name", "value", "self")


_FR = "CASE k % 6 WHEN 0 THEN 'p:1/a' WHEN 1 THEN 't:' || k WHEN 2 THEN '/lib/x.so+' || k WHEN 3 THEN 'deadBEEF' WHEN 4 THEN '[anon]' || k ELSE 'do_sys_open' END"


@query(
    "k12_frames",
    f"""SELECT seq, CASE WHEN name LIKE 'p:%' OR name LIKE 't:%' THEN 'root' WHEN contains(name, '/') OR regexp_matches(name, '^[0-9a-fA-F]{{6,}}$') OR starts_with(name, '[anon]') THEN 'user' ELSE 'kernel' END AS cls, contains(lower(name), 'sys')::INT AS hit
FROM (SELECT seq, {_FR} AS name FROM points)""",
    ("points",),
)
def k12(spark, sf):
    k = F.col("k")
    name = F.when(k % 6 == 0, "p:1/a").when(k % 6 == 1, F.concat(F.lit("t:"), k.cast("string"))).when(k % 6 == 2, F.concat(F.lit("/lib/x.so+"), k.cast("string"))).when(k % 6 == 3, "deadBEEF").when(
        k % 6 == 4, F.concat(F.lit("[anon]"), k.cast("string"))).otherwise("do_sys_open")
    n = points(spark, sf).select("seq", name.alias("name"))
    return ep.frame_search(n, "SYS").select("seq", ep.frame_class("name").alias("cls"), F.col("hit").cast("int").alias("hit"))


@query(
    "k13_dashboard_cards",
    """
WITH x AS (SELECT tid, 'ovh.cpu_pct' AS mid, ts_ns / 86400e9 AS x, 100.0 * ((c0 - p0) + (c1 - p1)) / (ts_ns - pt) AS y FROM tp WHERE pt IS NOT NULL),
e AS (SELECT tid, max(x) AS hi, min(x) AS lo, arg_max(y, x) AS last FROM x GROUP BY 1)
SELECT x.tid, 'ovh.cpu_pct' AS mid, round(max(last) * 1e9, 6) AS last, round(avg(y) * 1e9, 6) AS mean FROM x JOIN e ON e.tid = x.tid WHERE x.x >= greatest(hi - 60, lo) GROUP BY x.tid
""",
    ("tp",),
)
def k13(spark, sf):
    from telemill.operators import rates

    t = ticks(spark, sf).withColumnsRenamed({f"c{j}": c for j, c in enumerate(rates.OVERHEAD_COLS)}).withColumns({"rss_kb": F.lit(1), "vmhwm_kb": F.lit(1)})
    s = rates.derive(t, ["tid"], rates.OVERHEAD, rates.OVERHEAD_COLS, ordered.by_time("ts_ns", 8 * DAY)).withColumn("x", F.col("ts_ns") / F.lit(86400e9))
    out = ep.dashboard_cards(s, ["tid"])
    return out.select("tid", "mid", r6(F.col("last") * 1e9).alias("last"), r6(F.col("mean") * 1e9).alias("mean"))


@query("k14_latest_comm", "SELECT user_id AS tid, arg_max(metric_id, seq) AS comm FROM points GROUP BY 1", ("points",))
def k14(spark, sf):
    return ep.latest_comm(points(spark, sf).select(F.col("user_id").alias("tid"), F.col("metric_id").alias("comm"), "seq"))
