"""Registered queries of the trace-event pairing family."""

from pyspark.sql import functions as F

from telemill.functions.integers import floor_div
from telemill.functions.histograms import base4_bin, hist_percentile_us, latency_stats, log2_bin
from telemill.operators import ordered, pairing
from telemill.plans.registry import DAY, HOUR, cte, points, query, r6, table

CH = lambda: ordered.by_time("ts_ns", 4 * DAY)
# one trace event per row of events; latencies are scaled down to a kernel-like range
cte(
    "trace",
    """
SELECT seq, ts_ns // 1000000 AS ts_ns, user_id AS tid, user_id // 5 AS tgid, user_id % 4 AS cpu, k, metric_id AS kind, value, (user_id * 7 + k) % 150 AS other FROM points
""",
    ("points",),
)


def trace(spark, sf):
    u = F.col("user_id")
    return points(spark, sf).select(
        "seq", floor_div(F.col("ts_ns"), F.lit(1000000)).alias("ts_ns"), u.alias("tid"), F.floor(u / 5).cast("long").alias("tgid"),
        (u % 4).alias("cpu"), "k", F.col("metric_id").alias("kind"), "value", ((u * 7 + F.col("k")) % 150).alias("other"),
    )


ORD = ["ts_ns", "seq"]
CHT = lambda: ordered.by_time("ts_ns", 4 * DAY // 1000000)


def b4(x):
    return f"CASE WHEN {x} < 256 THEN 0 ELSE least(12, floor(log2({x} // 256) / 2)) END::BIGINT"


def hist_text(b, n):
    return "concat_ws(','," + ",".join(f"count(*) FILTER ({b} = {i})" for i in range(n)) + ")"


def _h(df):
    return df.withColumn("hist", F.concat_ws(",", F.col("hist").cast("array<string>")))


cte("sw", "SELECT seq, ts_ns, cpu, tid AS prev_tid, other AS next_tid, k % 5 AS prev_state, CASE WHEN k % 2 = 0 THEN 's' || k % 7 END AS stack FROM trace", ("trace",))


def switches(spark, sf):
    k = F.col("k")
    return trace(spark, sf).select(
        "seq", "ts_ns", "cpu", F.col("tid").alias("prev_tid"), F.col("other").alias("next_tid"), (k % 5).alias("prev_state"),
        F.when(k % 2 == 0, F.concat(F.lit("s"), (k % 7).cast("string"))).alias("stack"),
    )


@query(
    "p1_on_cpu_time",
    """SELECT p AS tid, CAST(sum(ts_ns - pt) AS BIGINT) AS on_cpu_ns FROM (SELECT ts_ns, lag(next_tid) OVER w AS p, lag(ts_ns) OVER w AS pt FROM sw WINDOW w AS (PARTITION BY cpu ORDER BY ts_ns, seq))
WHERE p <> 0 AND ts_ns > pt GROUP BY 1""",
    ("sw",),
)
def p1(spark, sf):
    return pairing.on_cpu_time(switches(spark, sf), CHT(), order=ORD)


@query(
    "p2_switch_counts",
    "SELECT prev_tid AS tid, count(*) FILTER (prev_state & 127 <> 0) AS nr_sw_vol, count(*) FILTER (prev_state = 0) AS nr_sw_invol FROM sw WHERE prev_tid <> 0 GROUP BY 1",
    ("sw",),
)
def p2(spark, sf):
    return pairing.switch_counts(switches(spark, sf))


cte(
    "dwell",
    """
SELECT tid, ts_ns, ts_ns - pt AS dwell, ps AS stack FROM (SELECT *, lag(side) OVER w AS pside, lag(ts_ns) OVER w AS pt, lag(stack) OVER w AS ps FROM (
  SELECT prev_tid AS tid, ts_ns, seq, stack, 0 AS side FROM sw WHERE prev_tid <> 0 AND prev_state & 127 <> 0
  UNION ALL SELECT next_tid, ts_ns, seq, NULL, 1 FROM sw WHERE next_tid <> 0) WINDOW w AS (PARTITION BY tid ORDER BY ts_ns, seq, side)) WHERE side = 1 AND pside = 0
""",
    ("sw",),
)


@query(
    "p3_off_cpu",
    f"""SELECT tid, stack, CAST(sum(dwell) AS BIGINT) AS dwell_ns, NULL::BIGINT AS count, NULL AS hist FROM dwell WHERE stack IS NOT NULL GROUP BY ALL
UNION ALL SELECT tid, NULL, CAST(sum(dwell) AS BIGINT), count(*), {hist_text(b4('dwell'), 13)} FROM dwell WHERE stack IS NULL GROUP BY tid""",
    ("dwell",),
)
def p3(spark, sf):
    stacked, plain = pairing.off_cpu_tables(pairing.off_cpu(switches(spark, sf), CHT(), ["ts_ns", "seq", "side"]))
    a = stacked.select("tid", "stack", "dwell_ns", F.lit(None).cast("long").alias("count"), F.lit(None).cast("string").alias("hist"))
    return a.unionByName(_h(plain).select("tid", F.lit(None).cast("string").alias("stack"), F.col("lat_sum").alias("dwell_ns"), "count", "hist"))


@query(
    "p4_run_queue_latency",
    """
WITH e AS (SELECT tid, ts_ns, seq, kind = 'view' AS b FROM trace WHERE kind IN ('view', 'click')),
g AS (SELECT *, coalesce(sum((NOT b)::INT) OVER (PARTITION BY tid ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM e)
SELECT tid, max(seq) AS seq, max(ts_ns) FILTER (NOT b) - min(ts_ns) FILTER (b) AS lat_ns FROM g GROUP BY tid, grp HAVING count(*) FILTER (b) > 0 AND count(*) FILTER (NOT b) > 0
""",
    ("trace",),
)
def p4(spark, sf):
    kind = F.when(F.col("kind") == "view", "wakeup").when(F.col("kind") == "click", "switch_in").otherwise("x")
    ev = trace(spark, sf).select("tid", "ts_ns", "seq", kind.alias("kind"))
    return pairing.run_queue_latency(ev, CHT(), ORD).select("tid", "seq", "lat_ns")


cte(
    "bio",
    """SELECT *, CASE WHEN pk = 'issue' THEN ts_ns - pt ELSE 0 END AS lat FROM (SELECT *, lag(kd) OVER w AS pk, lag(ts_ns) OVER w AS pt FROM
(SELECT seq, ts_ns, seq // 2 AS req, CASE WHEN seq % 2 = 0 AND k % 10 <> 0 THEN 'issue' WHEN seq % 2 = 0 THEN 'insert' ELSE 'complete' END AS kd, tid AS pid, k % 4 AS dev, k * 512 AS bytes FROM trace)
 WHERE kd <> 'insert' WINDOW w AS (PARTITION BY req ORDER BY ts_ns, seq)) WHERE kd = 'complete'""",
    ("trace",),
)


def block_events(spark, sf):
    s, k = F.col("seq"), F.col("k")
    kind = F.when((s % 2 == 0) & (k % 10 != 0), "issue").when(s % 2 == 0, "insert").otherwise("complete")
    return trace(spark, sf).select(
        "seq", "ts_ns", F.floor(s / 2).cast("long").alias("req"), kind.alias("kind"), F.col("tid").alias("pid"), (k % 4).alias("dev"), (k * 512).alias("bytes")
    )


@query(
    "p5_block_io",
    " UNION ALL ".join(
        f"SELECT '{c}' AS by, {c} AS id, count(*) AS ops, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(lat) AS BIGINT) AS lat_sum, {hist_text(b4('lat'), 13)} AS hist FROM bio GROUP BY {c}"
        for c in ("pid", "dev")
    ),
    ("bio",),
)
def p5(spark, sf):
    done = pairing.block_io(block_events(spark, sf), CHT(), ORD)
    one = lambda c: _h(pairing.io_stats(done, c)).select(F.lit(c).alias("by"), F.col(c).alias("id"), "ops", "bytes", "lat_sum", "hist")
    return one("pid").unionByName(one("dev"))


@query(
    "p6_page_faults",
    "SELECT tid, count(*) FILTER (k & 4 = 0) AS pf_minor, count(*) FILTER (k & 4 <> 0) AS pf_major FROM trace GROUP BY 1",
    ("trace",),
)
def p6(spark, sf):
    return pairing.page_faults(trace(spark, sf).withColumn("error_code", F.col("k")))


cte(
    "locks",
    """SELECT tid, ts_ns, seq, pa AS addr, ts_ns - pt AS lat FROM (SELECT *, lag(kind) OVER w AS pk, lag(ts_ns) OVER w AS pt, lag(k % 9) OVER w AS pa FROM trace WHERE kind IN ('view', 'click')
WINDOW w AS (PARTITION BY tid ORDER BY ts_ns, seq)) WHERE kind = 'click' AND pk = 'view'""",
    ("trace",),
)


def lock_waits(spark, sf):
    kind = F.when(F.col("kind") == "view", "begin").when(F.col("kind") == "click", "end").otherwise("x")
    ev = trace(spark, sf).select("tid", "ts_ns", "seq", kind.alias("kind"), (F.col("k") % 9).alias("addr"))
    return pairing.lock_contention(ev, CHT(), ORD)


@query(
    "p7_lock_contention",
    " UNION ALL ".join(
        f"SELECT '{c}' AS by, {c} AS id, count(*) AS count, CAST(sum(lat) AS BIGINT) AS lat_sum, {hist_text(b4('lat'), 13)} AS hist FROM locks GROUP BY {c}" for c in ("tid", "addr")
    ),
    ("locks",),
)
def p7(spark, sf):
    w = lock_waits(spark, sf)
    one = lambda c: _h(latency_stats(w, [c], "lat_ns")).select(F.lit(c).alias("by"), F.col(c).alias("id"), "count", "lat_sum", "hist")
    return one("tid").unionByName(one("addr"))


cte(
    "calls",
    """SELECT tid, seq, pid AS id, pid = 202 AND parg & ~384 IN (0, 9) AS fw, ts_ns - pt AS lat, k - 20 AS ret FROM (SELECT *, lag(kind) OVER w AS pk, lag(ts_ns) OVER w AS pt, lag(CASE WHEN k % 3 = 0 THEN 202 ELSE k % 6 END) OVER w AS pid, lag(k % 4 + 128) OVER w AS parg
FROM trace WHERE kind IN ('view', 'click') WINDOW w AS (PARTITION BY tid ORDER BY ts_ns, seq)) WHERE kind = 'click' AND pk = 'view'""",
    ("trace",),
)


def finished_calls(spark, sf):
    k = F.col("k")
    kind = F.when(F.col("kind") == "view", "enter").when(F.col("kind") == "click", "exit").otherwise("x")
    ev = trace(spark, sf).select(
        "tid", "ts_ns", "seq", kind.alias("kind"), F.when(k % 3 == 0, 202).otherwise(k % 6).cast("long").alias("id"), (k % 4 + 128).alias("arg1"), (k - 20).alias("ret")
    )
    return pairing.syscalls(ev, CHT(), ORD)


_LOG2 = "CASE WHEN lat < 2 THEN 0 ELSE length(bin(lat)) - 1 END"


@query(
    "p8_syscalls",
    f"""
SELECT 'futex' AS part, tid, NULL::BIGINT AS id, count(*) AS count, CAST(sum(lat) AS BIGINT) AS lat_sum, NULL::BIGINT AS errors, {hist_text(b4('lat'), 13)} AS hist FROM calls WHERE fw GROUP BY tid
UNION ALL SELECT 'by_call', tid, id, count(*), CAST(sum(lat) AS BIGINT), count(*) FILTER (ret < 0), {hist_text(_LOG2, 64)} FROM calls WHERE NOT fw GROUP BY tid, id
UNION ALL SELECT 'by_thread', tid, NULL, count(*), CAST(sum(lat) AS BIGINT), NULL, {hist_text(b4('lat'), 13)} FROM calls WHERE NOT fw GROUP BY tid
""",
    ("calls",),
)
def p8(spark, sf):
    out = None
    for part, df in pairing.syscall_tables(finished_calls(spark, sf)).items():
        pick = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("long").alias(c)
        row = _h(df).select(F.lit(part).alias("part"), "tid", pick("id"), "count", "lat_sum", pick("errors"), "hist")
        out = row if out is None else out.unionByName(row)
    return out


# sockets are users; kinds follow k; no RTT limit here (p15 checks the limit), so the spacing is below the event spacing
_FK = "CASE k % 12 WHEN 0 THEN 'connect' WHEN 1 THEN 'accept' WHEN 2 THEN 'established' WHEN 3 THEN 'retransmit' WHEN 4 THEN 'reset' WHEN 5 THEN 'close' WHEN 6 THEN 'tx' WHEN 7 THEN 'rx' ELSE 'rtt' END"


@query(
    "p9_tcp_flows",
    f"""
WITH RECURSIVE e AS (SELECT *, tid AS cookie, {_FK} AS fk, k * 16 AS srtt, k * 100 AS bytes FROM trace),
f AS (SELECT cookie, arg_max(other, ts_ns) FILTER (fk IN ('connect', 'accept')) AS tid, min(ts_ns) FILTER (fk IN ('connect', 'accept')) AS st, min(ts_ns) FILTER (fk = 'established') AS est, max(ts_ns) FILTER (fk = 'close') AS en,
  count(*) FILTER (fk = 'retransmit') AS retransmits, arg_max(k, ts_ns) FILTER (fk = 'reset') AS rst_reason, CAST(coalesce(sum(bytes) FILTER (fk = 'tx'), 0) AS BIGINT) AS tx_bytes FROM e GROUP BY 1),
b AS (SELECT e.cookie, srtt, e.ts_ns AS t, row_number() OVER (PARTITION BY e.cookie ORDER BY e.ts_ns, seq) AS i FROM e JOIN f ON f.cookie = e.cookie AND e.ts_ns >= f.st WHERE fk = 'rtt'),
l AS (SELECT cookie, srtt, i, t AS last, true AS kept FROM b WHERE i = 1  -- at most ten a second
 UNION ALL SELECT b.cookie, b.srtt, b.i, CASE WHEN (b.t - l.last) * 10 >= 1000000000 THEN b.t ELSE l.last END, (b.t - l.last) * 10 >= 1000000000 FROM l JOIN b ON b.cookie = l.cookie AND b.i = l.i + 1),
r AS (SELECT cookie, count(*) AS rtt_count, sum(srtt >> 3) AS s FROM l WHERE kept GROUP BY 1)
SELECT f.cookie, f.tid, retransmits, rst_reason, tx_bytes, CASE WHEN est > st THEN (est - st) // 1000 ELSE 0 END AS connect_latency_us, coalesce(rtt_count, 0) AS rtt_count, coalesce(CAST(s // rtt_count AS BIGINT), 0) AS rtt_avg_us,
 (en IS NOT NULL)::INT AS closed, coalesce(f.tid <> 0, false)::INT AS owner_available FROM f LEFT JOIN r ON r.cookie = f.cookie
""",
    ("trace",),
)
def p9(spark, sf):
    k = F.col("k")
    names = {0: "connect", 1: "accept", 2: "established", 3: "retransmit", 4: "reset", 5: "close", 6: "tx", 7: "rx"}
    kind = F.lit("rtt")
    for m, n in names.items():
        kind = F.when(k % 12 == m, n).otherwise(kind)
    ev = trace(spark, sf).select(
        F.col("tid").alias("cookie"), "ts_ns", "seq", kind.alias("kind"), F.col("other").alias("tid"), F.col("tgid"), (k * 16).alias("srtt_us8"), (k * 100).alias("bytes"), k.alias("reason")
    )
    f = pairing.tcp_flows(ev, CHT(), order=ORD)
    return f.select("cookie", "tid", "retransmits", "rst_reason", "tx_bytes", "connect_latency_us", "rtt_count", "rtt_avg_us",
                    F.col("closed").cast("int").alias("closed"), F.col("owner_available").cast("int").alias("owner_available"))


@query("p10_packet_drops", "SELECT tgid AS netns, cpu AS ifindex, k % 6 AS reason, count(*) AS count FROM trace GROUP BY ALL", ("trace",))
def p10(spark, sf):
    return pairing.packet_drops(trace(spark, sf).select(F.col("tgid").alias("netns"), F.col("cpu").alias("ifindex"), (F.col("k") % 6).alias("reason")))


@query(
    "p11_softirq_time",
    f"""
WITH e AS (SELECT *, k % 3 + 1 AS vector FROM trace WHERE kind IN ('view', 'click') AND k % 3 + 1 IN (2, 3)),
p AS (SELECT *, lag(kind) OVER w AS pk, ts_ns - lag(ts_ns) OVER w AS lat FROM e WINDOW w AS (PARTITION BY cpu ORDER BY ts_ns, seq))
SELECT cpu, vector, count(*) AS count, CAST(sum(lat) AS BIGINT) AS time_ns, {hist_text(b4('lat'), 13)} AS hist FROM p WHERE kind = 'click' AND pk = 'view' GROUP BY cpu, vector
""",
    ("trace",),
)
def p11(spark, sf):
    kind = F.when(F.col("kind") == "view", "entry").when(F.col("kind") == "click", "exit").otherwise("x")
    ev = trace(spark, sf).select("cpu", "ts_ns", "seq", kind.alias("kind"), (F.col("k") % 3 + 1).alias("vector"))
    return _h(pairing.softirq_time(ev, CHT(), ORD)).select("cpu", "vector", "count", "time_ns", "hist")


cte(
    "fio",
    """SELECT pd AS dev, pi AS ino, 'f' || pi AS path, k - 30 AS ret, ts_ns - pt AS lat FROM (SELECT *, lag(kind) OVER w AS pk, lag(ts_ns) OVER w AS pt, lag(k % 4) OVER w AS pd, lag(k % 17) OVER w AS pi
FROM trace WHERE kind IN ('view', 'click') WINDOW w AS (PARTITION BY tid ORDER BY ts_ns, seq)) WHERE kind = 'click' AND pk = 'view'""",
    ("trace",),
)


def file_table(spark, sf):
    k = F.col("k")
    kind = F.when(F.col("kind") == "view", "enter").when(F.col("kind") == "click", "exit").otherwise("x")
    ev = trace(spark, sf).select(
        "tid", "ts_ns", "seq", kind.alias("kind"), (k % 4).alias("dev"), (k % 17).alias("ino"), F.concat(F.lit("f"), (k % 17).cast("string")).alias("path"), (k - 30).alias("ret")
    )
    return pairing.file_io(ev, CHT(), ORD)


@query(
    "p12_file_io",
    f"""SELECT dev, ino, path, CAST(coalesce(sum(ret) FILTER (ret > 0), 0) AS BIGINT) AS bytes, count(*) FILTER (ret > 0) AS ops, count(*) FILTER (ret <= 0) AS errors, CAST(sum(lat) AS BIGINT) AS lat_sum,
{hist_text(b4('lat'), 13)} AS hist FROM fio GROUP BY dev, ino, path""",
    ("fio",),
)
def p12(spark, sf):
    return _h(file_table(spark, sf)).select("dev", "ino", "path", "bytes", "ops", "errors", "lat_sum", "hist")


@query(
    "p13_memory_reclaim",
    """
WITH e AS (SELECT cpu AS host, ts_ns, seq, CASE kind WHEN 'view' THEN 'wake' WHEN 'click' THEN 'sleep' WHEN 'error' THEN 'begin' WHEN 'signup' THEN 'end' ELSE 'other' END AS kd, k FROM trace),
s AS (SELECT host, ts_ns, seq, coalesce(last_value(CASE kd WHEN 'wake' THEN 1 WHEN 'sleep' THEN 0 END IGNORE NULLS) OVER w, 0) AS a, sum((kd = 'begin')::INT) OVER w AS d, sum(CASE WHEN kd = 'end' THEN k ELSE 0 END) OVER w AS r
  FROM e WINDOW w AS (PARTITION BY host ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, coalesce(lag(a) OVER w, 0) AS pa, coalesce(lag(d) OVER w, 0) AS pd, coalesce(lag(r) OVER w, 0) AS pr FROM s WINDOW w AS (PARTITION BY host ORDER BY ts_ns, seq))
SELECT host, ts_ns, seq, a AS kswapd_active, CAST(d AS BIGINT) AS direct_reclaim, CAST(r AS BIGINT) AS nr_reclaimed FROM l WHERE a <> pa OR d <> pd OR r <> pr
""",
    ("trace",),
)
def p13(spark, sf):
    m = {"view": "kswapd_wake", "click": "kswapd_sleep", "error": "direct_begin", "signup": "direct_end"}
    kind = F.lit("other")
    for a, b in m.items():
        kind = F.when(F.col("kind") == a, b).otherwise(kind)
    ev = trace(spark, sf).select(F.col("cpu").alias("host"), "ts_ns", "seq", kind.alias("kind"), F.col("k").alias("reclaimed"))
    return pairing.memory_reclaim(ev, ["host"], CHT(), ORD)


@query("p14_oom_events", "SELECT ts_ns, tid AS pid FROM trace WHERE kind = 'error'", ("trace",))
def p14(spark, sf):
    kind = F.when(F.col("kind") == "error", "oom").otherwise("x")
    return pairing.oom_events(trace(spark, sf).select("ts_ns", F.col("tid").alias("pid"), kind.alias("kind")))


# six hours between kept rows: one row per 21600 s is a rate of 1/21600; the timestamps are scaled instead
@query(
    "p15_rate_limit",
    """
WITH RECURSIVE b AS (SELECT entity_id, seq, ts_ns // 21600 AS t, row_number() OVER (PARTITION BY entity_id ORDER BY ts_ns, seq) AS i FROM points),
r AS (SELECT entity_id, i, seq, t AS last, true AS kept FROM b WHERE i = 1
 UNION ALL SELECT b.entity_id, b.i, b.seq, CASE WHEN b.t - r.last >= 1000000000 THEN b.t ELSE r.last END, b.t - r.last >= 1000000000 FROM r JOIN b ON b.entity_id = r.entity_id AND b.i = r.i + 1)
SELECT entity_id, seq FROM r WHERE kept
""",
    ("points",),
)
def p15(spark, sf):
    p = points(spark, sf).select("entity_id", "seq", floor_div(F.col("ts_ns"), F.lit(21600)).alias("ts_ns"))
    return pairing.rate_limit(p, ["entity_id"], ["ts_ns", "seq"], 1, ordered.by_time("ts_ns", 5 * DAY // 21600)).select("entity_id", "seq")


@query("p16_sample", "SELECT seq, ts_ns, entity_id FROM points WHERE ('0x' || left(md5(seq::VARCHAR), 8))::BIGINT % 10 = 0", ("points",))
def p16(spark, sf):
    return pairing.sample(points(spark, sf), 10, ["seq"]).select("seq", "ts_ns", "entity_id")


@query(
    "p17_profile_counts",
    "SELECT tgid AS pid, tid, 'u' || k % 3 AS user_stack, 'k' || k % 2 AS kernel_stack, count(*) AS count FROM trace GROUP BY ALL",
    ("trace",),
)
def p17(spark, sf):
    return pairing.profile_counts(_samples(spark, sf))


def _samples(spark, sf):
    k = F.col("k")
    return trace(spark, sf).select(
        F.col("tgid").alias("pid"), "tid", F.concat(F.lit("u"), (k % 3).cast("string")).alias("user_stack"), F.concat(F.lit("k"), (k % 2).cast("string")).alias("kernel_stack")
    )


@query(
    "p18_target_gate",
    """SELECT 'now' AS how, seq FROM trace WHERE tid IN (SELECT tid FROM trace WHERE kind = 'error' AND k < 20)
UNION ALL SELECT DISTINCT 'asof', t.seq FROM trace t JOIN (SELECT tid, ts_ns AS a, ts_ns + 86400000 AS b FROM trace WHERE kind = 'error' AND k < 20) m ON m.tid = t.tid AND t.ts_ns BETWEEN a AND b""",
    ("trace",),
)
def p18(spark, sf):
    t = trace(spark, sf)
    m = t.where("kind = 'error' AND k < 20").select("tid", F.col("ts_ns").alias("join_ns"), (F.col("ts_ns") + 86400000).alias("leave_ns"))
    ev = t.select("tid", "ts_ns", "seq")
    asof = pairing.target_gate_asof(ev, m, 86400000)
    return pairing.target_gate(ev, m).select(F.lit("now").alias("how"), "seq").unionByName(asof.select(F.lit("asof").alias("how"), "seq").distinct())


@query("p19_hist_base4", f"SELECT seq, {b4('lat')} AS bin FROM (SELECT seq, k * k * k * k * (seq % 100) AS lat FROM points)", ("points",))
def p19(spark, sf):
    k = F.col("k")
    return points(spark, sf).select("seq", base4_bin(k * k * k * k * (F.col("seq") % 100)).cast("long").alias("bin"))


@query("p20_hist_log2", f"SELECT seq, CAST({_LOG2} AS BIGINT) AS bin FROM (SELECT seq, k * k * k * k * (seq % 100) AS lat FROM points)", ("points",))
def p20(spark, sf):
    k = F.col("k")
    return points(spark, sf).select("seq", log2_bin(k * k * k * k * (F.col("seq") % 100)).cast("long").alias("bin"))


def pct_sql(src, key, q, b, base, factor):
    """Lower edge of the bin that holds rank max(1, trunc(n q))."""
    return f"""(SELECT {key}, {base} * pow({factor}, min(b)) / 1000.0 AS v FROM (SELECT {key}, {b} AS b, row_number() OVER (PARTITION BY {key} ORDER BY {b}) AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM {src})
 WHERE rn >= greatest(1, trunc(n * {q}::DOUBLE)) GROUP BY {key})"""


@query(
    "p21_hist_percentile",
    f"""WITH l AS (SELECT entity_id, k * k * k AS lat FROM points) SELECT a.entity_id, round(a.v, 6) AS p50, round(b.v, 6) AS p99 FROM {pct_sql('l', 'entity_id', 0.5, b4('lat'), 256, 4)} a JOIN {pct_sql('l', 'entity_id', 0.99, b4('lat'), 256, 4)} b ON a.entity_id = b.entity_id""",
    ("points",),
)
def p21(spark, sf):
    k = F.col("k")
    h = latency_stats(points(spark, sf).select("entity_id", (k * k * k).alias("lat")), ["entity_id"], "lat")
    return h.select("entity_id", r6(hist_percentile_us("hist", 0.5)).alias("p50"), r6(hist_percentile_us("hist", 0.99)).alias("p99"))


@query(
    "p22_hot_spots",
    f"""
WITH c2 AS (SELECT *, tid || ':' || id AS ck FROM calls WHERE NOT fw), f2 AS (SELECT *, dev || ':' || ino AS ck FROM fio),
base AS (SELECT addr, count(*) AS c, sum(lat) AS l FROM locks WHERE seq % 3 = 0 GROUP BY 1)
SELECT 'syscall' AS part, a.ck AS id, n AS count, round(avg_us, 6) AS avg_us, round(p.v, 6) AS p50_us, round(q.v, 6) AS p99_us FROM (SELECT ck, count(*) AS n, avg(lat) / 1000.0 AS avg_us FROM c2 GROUP BY 1) a
 JOIN {pct_sql('c2', 'ck', 0.5, _LOG2, 1, 2)} p ON p.ck = a.ck JOIN {pct_sql('c2', 'ck', 0.99, _LOG2, 1, 2)} q ON q.ck = a.ck
UNION ALL SELECT 'iofile', a.ck, n, round(avg_us, 6), round(p.v, 6), round(q.v, 6) FROM (SELECT ck, count(*) AS n, avg(lat) / 1000.0 AS avg_us FROM f2 GROUP BY 1) a
 JOIN {pct_sql('f2', 'ck', 0.5, b4('lat'), 256, 4)} p ON p.ck = a.ck JOIN {pct_sql('f2', 'ck', 0.99, b4('lat'), 256, 4)} q ON q.ck = a.ck
UNION ALL SELECT 'lock', CAST(l.addr AS VARCHAR), count(*) - coalesce(any_value(c), 0), CAST((sum(lat) - coalesce(any_value(l.l0), 0)) // (count(*) - coalesce(any_value(c), 0)) AS DOUBLE), NULL, NULL
 FROM (SELECT locks.addr, lat, base.c, base.l AS l0 FROM locks LEFT JOIN base ON base.addr = locks.addr) l GROUP BY l.addr HAVING count(*) - coalesce(any_value(c), 0) > 0
""",
    ("calls", "fio", "locks"),
)
def p22(spark, sf):
    null_d = F.lit(None).cast("double")
    calls = pairing.with_percentiles(pairing.syscall_tables(finished_calls(spark, sf))["by_call"], "log2")
    a = calls.select(F.lit("syscall").alias("part"), F.concat_ws(":", "tid", "id").alias("id"), "count", r6("avg_us").alias("avg_us"), r6("p50_us").alias("p50_us"), r6("p99_us").alias("p99_us"))
    files = pairing.with_percentiles(file_table(spark, sf).withColumn("count", F.col("ops") + F.col("errors")))
    b = files.select(F.lit("iofile").alias("part"), F.concat_ws(":", "dev", "ino").alias("id"), "count", r6("avg_us").alias("avg_us"), r6("p50_us").alias("p50_us"), r6("p99_us").alias("p99_us"))
    w = lock_waits(spark, sf)
    hot = pairing.lock_hot(latency_stats(w, ["addr"], "lat_ns"), latency_stats(w.where("seq % 3 = 0"), ["addr"], "lat_ns"))
    c = hot.select(F.lit("lock").alias("part"), F.col("addr").cast("string").alias("id"), "count", F.col("avg_wait_ns").cast("double").alias("avg_us"), null_d.alias("p50_us"), null_d.alias("p99_us"))
    return a.unionByName(b).unionByName(c)


@query(
    "p23_fold_stacks",
    """
WITH nm AS (SELECT tid, arg_max(kind, seq) AS comm FROM trace WHERE k % 2 = 0 GROUP BY 1), s AS (SELECT tgid AS pid, tid, 'u' || k % 3 AS us, 'k' || k % 2 AS ks, count(*) AS n FROM trace GROUP BY ALL)
SELECT 'p:' || pid || '/' || coalesce(pn.comm, '') || ';t:' || s.tid || '/' || coalesce(tn.comm, '') || ';' || ks || ';' || us AS line, CAST(sum(n) AS BIGINT) AS value
FROM s LEFT JOIN nm tn ON tn.tid = s.tid LEFT JOIN nm pn ON pn.tid = s.pid GROUP BY 1
""",
    ("trace",),
)
def p23(spark, sf):
    from telemill.operators.episodes import latest_comm

    comms = latest_comm(trace(spark, sf).where("k % 2 = 0").select("tid", F.col("kind").alias("comm"), "seq"))
    return pairing.fold_stacks(pairing.profile_counts(_samples(spark, sf)), comms)
