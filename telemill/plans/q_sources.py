"""Registered queries of the source and sink family."""

import uuid

from pyspark.sql import functions as F

from telemill.functions.integers import floor_div
from telemill.operators import ordered
from telemill.plans.registry import DAY, HOUR, cte, points, query, r6, table, ticks
from telemill.session import shared_dir
from telemill.sources import messages, points as src, sessions


def flat(col="attrs"):
    """Map as sorted text, so that results compare across engines."""
    return F.array_join(
        F.array_sort(F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"
    )


def _fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _point_rows(spark, sf):
    k = F.col("k")
    return points(spark, sf).select(
        "seq", "k", "ts_ns", "entity_id", F.lit("host").alias("entity_type"), "metric_id", "value",
        F.when(k % 3 == 0, "ms").alias("unit"), F.lit("replay").alias("source"),
        F.when(k % 4 == 0, 1000).cast("long").alias("sample_interval_ns"), "quality",
        F.when(k % 5 == 0, F.create_map(F.lit("role"), F.lit("state"), F.lit("k"), k.cast("string")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("attrs"),
    )


@query(
    "s1_read_points_jsonl",
    """
SELECT seq, CASE k % 11 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE ts_ns END AS ts_ns, CASE k % 11 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE metric_id END AS metric_id,
  CASE k % 11 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 1.0 WHEN 4 THEN 0.0 ELSE round(value, 6) END AS value,
  CASE k % 11 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE quality END AS quality, CASE k % 11 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'replay' END AS source,
  CASE WHEN k % 11 IN (1, 2) THEN NULL WHEN k % 5 = 0 THEN 'k=' || k ELSE '' END AS attrs,
  CASE k % 11 WHEN 1 THEN 'bad_json' WHEN 2 THEN 'missing_field' END AS reason
FROM points WHERE k % 11 <> 5
""",
    ("points",),
)
def s1(spark, sf):
    k = F.col("k")
    body = F.struct(
        "ts_ns", "entity_id", F.lit("host").alias("entity_type"), "metric_id", "value",
        F.when(F.col("quality") != "observed", F.col("quality")).alias("quality"),
        F.when(k % 5 == 0, F.create_map(F.lit("k"), k.cast("string"))).alias("attrs"),
    )
    text = F.to_json(body)
    flag = lambda v: F.to_json(
        F.struct("ts_ns", "entity_id", F.lit("host").alias("entity_type"), "metric_id", F.lit(v).alias("value"), "quality",
                 F.when(k % 5 == 0, F.create_map(F.lit("k"), k.cast("string"))).alias("attrs"))
    )
    line = (
        F.when(k % 11 == 1, F.concat(F.lit("{oops "), text))
        .when(k % 11 == 2, F.to_json(F.struct("ts_ns", "metric_id")))
        .when(k % 11 == 3, flag(True)).when(k % 11 == 4, flag(False)).when(k % 11 == 5, F.lit("   "))
        .otherwise(text)
    )
    good, bad = src.parse_points_jsonl(points(spark, sf).select("seq", line.alias("value")))
    g = good.select("seq", "ts_ns", "metric_id", r6("value").alias("value"), "quality", "source", flat().alias("attrs"), F.lit(None).cast("string").alias("reason"))
    return g.unionByName(bad.select("seq", "reason"), allowMissingColumns=True)


@query(
    "s2_read_points_csv",
    """
SELECT seq, ts_ns, entity_id, CASE k % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE round(value, 6) END AS value,
  CASE WHEN k % 3 = 0 THEN 'ms' END AS unit, CASE WHEN k % 2 = 0 THEN quality ELSE 'observed' END AS quality, 'replay' AS source,
  CASE WHEN k % 4 = 0 THEN 1000 END AS sample_interval_ns, CASE WHEN k % 5 = 0 THEN 'k=' || k ELSE '' END AS attrs
FROM points
""",
    ("points",),
)
def s2(spark, sf):
    k = F.col("k")
    value = (
        F.when(k % 7 == 0, "true").when(k % 7 == 1, "FALSE").when(k % 7 == 2, "NaN").when(k % 7 == 3, "None")
        .otherwise(F.coalesce(F.col("value").cast("string"), F.lit("")))
    )
    fields = [
        F.col("ts_ns").cast("string"), F.col("entity_id"), F.lit("host"), F.col("metric_id"), value,
        F.when(k % 3 == 0, "ms").otherwise(""), F.when(k % 2 == 0, F.col("quality")).otherwise(""),
        F.when(k % 4 == 0, "1000").otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit('"{""k"": ""'), k.cast("string"), F.lit('""}"'))).otherwise(""),
    ]
    lines = points(spark, sf).select("seq", F.concat_ws(",", *fields).alias("value"))
    header = ["ts_ns", "entity_id", "entity_type", "metric_id", "value", "unit", "quality", "sample_interval_ns", "attrs"]
    out = src.parse_points_csv(lines, header)
    return out.select("seq", "ts_ns", "entity_id", r6("value").alias("value"), "unit", "quality", "source", "sample_interval_ns", flat().alias("attrs"))


@query(
    "s3_read_points",
    "SELECT ts_ns, entity_id, metric_id, round(value, 6) AS value, quality, CASE WHEN k % 3 = 0 THEN 'ms' END AS unit FROM points",
    ("points",),
)
def s3(spark, sf):
    path = _fresh(spark, "points") + ".jsonl"
    src.write_points_jsonl(_point_rows(spark, sf), path)
    return src.read_points(spark, path).select("ts_ns", "entity_id", "metric_id", r6("value").alias("value"), "quality", "unit")


@query(
    "s4_write_points_jsonl",
    """
SELECT seq, '{' || CASE WHEN k % 5 = 0 THEN '"attrs":{"role":"state","k":"' || k || '"},' ELSE '' END || '"entity_id":"' || entity_id
 || '","entity_type":"host","metric_id":"' || metric_id || '","quality":"' || quality || '",'
 || CASE WHEN k % 4 = 0 THEN '"sample_interval_ns":1000,' ELSE '' END || '"source":"replay","ts_ns":' || ts_ns
 || CASE WHEN k % 3 = 0 THEN ',"unit":"ms"' ELSE '' END || CASE WHEN value IS NOT NULL THEN ',"value":' || CAST(value AS VARCHAR) ELSE '' END || '}' AS line FROM points
""",
    ("points",),
)
def s4(spark, sf):
    return src.format_points_jsonl(_point_rows(spark, sf).drop("k")).select("seq", "line")


@query(
    "s5_otlp_to_points",
    """
SELECT seq, i AS n, ts_ns + i AS ts_ns, CASE WHEN k % 3 = 0 THEN 'svc' || (k % 7) WHEN k % 3 = 1 THEN 'h' || user_id % 5 ELSE 'unknown-host' END AS entity_id,
 CASE WHEN k % 3 = 0 THEN 'pod' ELSE 'host' END AS entity_type, metric_id, CASE WHEN i = 0 THEN round(value, 6) ELSE CAST(k AS DOUBLE) END AS value, '1' AS unit,
 CASE WHEN i = 0 THEN 'a=1;scope=lib' ELSE 'scope=lib' END AS attrs
FROM points, (VALUES (0), (1)) v(i)
""",
    ("points",),
)
def s5(spark, sf):
    k = F.col("k")
    attrs = F.create_map(F.lit("a"), F.lit("1"))
    pts = F.array(
        F.struct(F.col("ts_ns").alias("time_unix_nano"), F.col("value").alias("as_double"), F.lit(None).cast("long").alias("as_int"), attrs.alias("attributes")),
        F.struct((F.col("ts_ns") + 1).alias("time_unix_nano"), F.lit(None).cast("double").alias("as_double"), k.alias("as_int"), F.lit(None).cast("map<string,string>").alias("attributes")),
    )
    res = (
        F.when(k % 3 == 0, F.create_map(F.lit("service.name"), F.concat(F.lit("svc"), (k % 7).cast("string")), F.lit("host.id"), F.lit("x")))
        .when(k % 3 == 1, F.create_map(F.lit("host.name"), F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string"))))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    doc = F.to_json(F.struct(
        res.alias("resource"), F.struct(F.lit("lib").alias("name")).alias("scope"),
        F.array(F.struct(F.col("metric_id").alias("name"), F.lit("1").alias("unit"), pts.alias("points"))).alias("metrics"),
    ))
    out = src.otlp_to_points(points(spark, sf).select("seq", F.col("ts_ns").alias("base"), doc.alias("value")))
    return out.select("seq", (F.col("ts_ns") - F.col("base")).alias("n"), "ts_ns", "entity_id", "entity_type", "metric_id", r6("value").alias("value"), "unit", flat().alias("attrs"))


@query(
    "s6_prom_text_to_points",
    """
SELECT seq, CASE WHEN k % 10 = 7 THEN NULL ELSE metric_id END AS metric_id,
 CASE WHEN k % 10 = 7 THEN NULL WHEN k % 2 = 0 THEN CAST(trunc((ts_ns // 1000000000 + 0.5::DOUBLE) * 1e9) AS BIGINT) ELSE 0 END AS ts_ns,
 CASE WHEN k % 10 = 7 THEN NULL ELSE CAST(k AS DOUBLE) / 4 END AS value,
 CASE WHEN k % 10 = 7 THEN NULL WHEN k % 3 = 0 THEN 'env=prod' WHEN k % 3 = 1 THEN 'env=prod;user=' || user_id ELSE 'env=dev;user=' || user_id END AS attrs,
 CASE WHEN k % 10 = 7 THEN 'unparseable' END AS reason
FROM points WHERE k % 10 <> 8
""",
    ("points",),
)
def s6(spark, sf):
    k = F.col("k")
    labels = (
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit('{user="'), F.col("user_id").cast("string"), F.lit('"}')))
        .otherwise(F.concat(F.lit('{user="'), F.col("user_id").cast("string"), F.lit('", env="dev"}')))
    )
    value = F.when(k % 10 == 7, "zz").otherwise((k / F.lit(4)).cast("string"))
    stamp = F.when(k % 2 == 0, F.concat(F.lit(" "), floor_div(F.col("ts_ns"), F.lit(10**9)).cast("string"), F.lit(".5"))).otherwise("")
    line = F.when(k % 10 == 8, "# HELP x").otherwise(F.concat("metric_id", labels, F.lit(" "), value, stamp))
    good, bad = src.prom_text_to_points(points(spark, sf).select("seq", line.alias("value")), {"env": "prod"})
    g = good.select("seq", "metric_id", "ts_ns", "value", flat().alias("attrs"), F.lit(None).cast("string").alias("reason"))
    return g.unionByName(bad.select("seq", "reason"), allowMissingColumns=True)


@query(
    "s7_trace_events_to_points",
    """
SELECT seq, ts_ns, CASE metric_id WHEN 'error' THEN CAST(user_id AS VARCHAR) WHEN 'click' THEN CAST(user_id AS VARCHAR) WHEN 'view' THEN 'd' || k % 4 ELSE 'read' END AS entity_id,
 CASE metric_id WHEN 'view' THEN 'device' WHEN 'purchase' THEN 'syscall' ELSE 'thread' END AS entity_type,
 CASE metric_id WHEN 'error' THEN 'scheduler.off_cpu' WHEN 'click' THEN 'futex.wait_time' WHEN 'view' THEN 'block.issue' ELSE 'syscall.count' END AS metric_id,
 coalesce(CASE WHEN k % 3 = 0 THEN round(value, 6) END, CASE WHEN k % 3 < 2 THEN CAST(k AS DOUBLE) END, 1.0) AS value,
 CASE WHEN metric_id IN ('error', 'click') THEN 'ns' ELSE '1' END AS unit
FROM points WHERE metric_id <> 'signup'
""",
    ("points",),
)
def s7(spark, sf):
    m, k = F.col("metric_id"), F.col("k")
    kind = (
        F.when(m == "error", "sched_switch").when(m == "click", "futex").when(m == "view", "block_rq_issue")
        .when(m == "purchase", "syscall_enter").otherwise("unknown_kind")
    )
    ev = points(spark, sf).select(
        "seq", kind.alias("type"), "ts_ns", F.col("user_id").alias("tid"), F.col("user_id").alias("pid"),
        F.concat(F.lit("d"), (k % 4).cast("string")).alias("dev"), F.lit("read").alias("name"),
        F.when(k % 3 == 0, F.col("value")).alias("value"), F.when(k % 3 < 2, k).alias("delta_ns"),
        F.lit("c").alias("comm"), F.lit("R").alias("state"),
    )
    out = src.trace_events_to_points(ev)
    return out.select("seq", "ts_ns", "entity_id", "entity_type", "metric_id", r6("value").alias("value"), "unit")


@query(
    "s8_profile_to_points",
    """
SELECT seq, ts_ns, 'func:c' || user_id % 4 || ':f' || (k + d) % 9 AS entity_id, CAST(d AS VARCHAR) AS depth, user_id || ':' || user_id AS join_key
FROM points, (VALUES (0), (1), (2)) v(d) WHERE d <= k % 3
""",
    ("points",),
)
def s8(spark, sf):
    k = F.col("k")
    stack = F.transform(
        F.sequence(F.lit(0).cast("long"), k % 3),
        lambda d: F.struct(F.concat(F.lit("f"), ((k + d) % 9).cast("string")).alias("symbol"), F.lit("bin").alias("binary"), F.lit("id").alias("build_id")),
    )
    s = points(spark, sf).select(
        "seq", "ts_ns", F.col("user_id").alias("tid"), F.col("user_id").alias("pid"),
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("comm"), stack.alias("stack"),
    )
    out = src.profile_to_points(s)
    return out.select("seq", "ts_ns", "entity_id", F.col("attrs")["depth"].alias("depth"), F.col("attrs")["join_key"].alias("join_key"))


# ---- collector messages: one per event, three sources ----
def feature_messages(spark, sf):
    _S, _K = F.col("seq"), F.col("k")
    d = lambda c: c.cast("double")
    disk = lambda a, b, c: F.struct(d(a).alias("io_ticks_ms"), d(b).alias("weighted_ticks_ms"), d(c).alias("ios_in_flight"))
    null_d = F.lit(None).cast("double")
    host = F.struct(
        F.struct(d(_S * 2).alias("user"), d(_S + _K).alias("system"), null_d.alias("iowait")).alias("total"),
        F.when(_K % 9 != 0, F.array(disk(_S * 3, _K, _K % 7), disk(_K, null_d, F.lit(1)))).alias("disks"),
        F.struct(
            F.struct((_K / F.lit(10)).alias("some"), F.lit(0.5).alias("full")).alias("io"), d(_K).alias("memory"),
            F.struct((_K / F.lit(4)).alias("avg10")).alias("cpu"),
        ).alias("psi"),
        F.struct(d(_K * 100).alias("mem_free_kb"), d(_K * 200).alias("mem_available_kb")).alias("mem"),
        F.struct(d(_S % 500).alias("pgmajfault")).alias("vm"), d(_S * 5).alias("ctxt"),
    )
    ebpf = F.struct(
        d(_K).alias("on_cpu_ns_total"), d(_S % 300).alias("switch_total"), d(_S).alias("lock_waits_total"),
        F.array(F.struct(F.col("user_id").alias("tid"), _K.alias("on_cpu_ns"), (_K % 5).alias("io_ops"))).alias("per_tid"),
    )
    net = F.when(
        _K % 2 == 0, F.to_json(F.struct(F.array(F.struct(d(_S * 7).alias("rx_bytes"), d(_S).alias("tx_bytes"))).alias("ifaces")))
    ).otherwise(F.to_json(F.struct(d(_S * 7).alias("rx_bytes"))))
    task = F.array(F.struct(
        F.col("user_id").alias("pid"), F.col("metric_id").alias("comm"), d(_S * 2).alias("utime"), d(_K).alias("rss_kb"), d(_S % 200).alias("read_bytes"),
    ))
    head = F.to_json(F.struct(_S, "ts_ns", host.alias("host"), ebpf.alias("ebpf"), task.alias("top_tasks")))
    text = F.concat(F.expr("left(h, length(h) - 1)"), F.lit(',"network":'), F.col("n"), F.lit("}"))
    return points(spark, sf).select("seq", (F.col("user_id") % 3).alias("src"), head.alias("h"), net.alias("n")).select("seq", "src", text.alias("value"))


_RAWS = [
    ("cpu_user", "c", "seq * 2"), ("cpu_sys", "c", "seq + k"), ("io_ticks", "c", "CASE WHEN k % 9 = 0 THEN 0 ELSE seq * 3 + k END"),
    ("io_wticks", "c", "CASE WHEN k % 9 = 0 THEN 0 ELSE k END"), ("io_inflight", "g", "CASE WHEN k % 9 = 0 THEN 0 ELSE k % 7 + 1 END"),
    ("psi_io", "g", "k / 10.0::DOUBLE"), ("mem_free", "g", "k * 100"), ("mem_avail", "g", "k * 200"), ("pgmajfault", "c", "seq % 500"),
    ("psi_mem", "g", "k"), ("ctxt", "c", "seq * 5"), ("psi_cpu", "g", "k / 4.0::DOUBLE"), ("lock_waits", "c", "seq"), ("switches", "c", "seq % 300"),
    ("net_rx", "c", "seq * 7"), ("net_tx", "c", "CASE WHEN k % 2 = 0 THEN seq ELSE 0 END"),
]
_RAWP = [("cpu_user", "c", "seq * 2"), ("rss", "g", "k"), ("io_read", "c", "seq % 200")]
_RAW_SQL = " UNION ALL ".join(
    [f"SELECT seq, ts_ns, user_id % 3 AS src, 'host' AS entity_id, '{m}' AS metric_id, '{t}' AS kind, ({e})::DOUBLE AS raw FROM points" for m, t, e in _RAWS]
    + [f"SELECT seq, ts_ns, user_id % 3 AS src, 'proc' || user_id AS entity_id, '{m}' AS metric_id, '{t}' AS kind, ({e})::DOUBLE AS raw FROM points WHERE user_id > 0" for m, t, e in _RAWP]
)
cte("rawch", _RAW_SQL, ("points",))


@query(
    "s9_features_to_points",
    """
WITH l AS (SELECT *, lag(raw) OVER (PARTITION BY src, entity_id, metric_id, kind ORDER BY ts_ns, seq) AS p FROM rawch)
SELECT src, seq, ts_ns, entity_id, metric_id, round(CASE WHEN kind = 'g' THEN raw ELSE greatest(0, raw - p) END, 6) AS value
FROM l WHERE kind = 'g' OR p IS NOT NULL
""",
    ("rawch",),
)
def s9(spark, sf):
    out = messages.features_to_points(messages.parse_features(feature_messages(spark, sf)), ["src"], ["ts_ns", "seq"])
    return out.select("src", "seq", "ts_ns", "entity_id", "metric_id", r6("value").alias("value"))


def evidence_bundles(spark, sf):
    k, t = F.col("k"), F.col("ts_ns")
    ev = lambda kind: F.struct(
        t.alias("ts_ns"), F.concat(F.lit("svc"), (k % 6).cast("string")).alias("entity"), F.when(k % 2 == 0, "kill").alias("kind"),
        F.when(k % 3 == 0, "futex").alias("name"), F.concat(F.lit("/var/log/f"), (k % 5).cast("string")).alias("path"),
        F.when(k % 3 != 1, k * 10).alias("wait_ns"), (k * 3).alias("dur_ns"), (k % 4 % 2).alias("errors"), F.lit(kind).alias("span_id"),
    )
    some = lambda kind, m: F.when(k % m == 0, F.array(ev(kind))).alias(kind)
    body = F.struct(
        F.when(k % 6 != 0, t).alias("anomaly_start_ts"), (t + (k - 3) * 1000).alias("anomaly_end_ts"),
        F.when(k % 4 == 0, F.array(F.struct(F.col("metric_id").alias("type"), (k / F.lit(100)).alias("confidence")))).alias("deep_indicators"),
        F.array(F.struct(t.alias("ts_ns"), F.col("entity_id").alias("entity"), F.when(k % 2 == 1, "thread").alias("entity_type"),
                         F.col("metric_id").alias("metric"), F.col("value").alias("value"))).alias("series"),
        F.struct(some("oom", 5), some("syscall", 3), some("lock", 2), some("runq", 7), some("iofile", 4)).alias("events"),
    )
    return points(spark, sf).select("seq", "k", F.to_json(body).alias("value"))


_WAIT = "CASE WHEN k % 3 <> 1 THEN k * 10 ELSE k * 3 END"
_ERRS = "CASE WHEN k % 4 % 2 <> 0 THEN 'ERR' ELSE '{}' END"


@query(
    "s10_evidence_to_modalities",
    f"""
SELECT seq, 'point' AS part, entity_id AS entity, metric_id AS name, ts_ns AS t0, ts_ns AS t1, round(value, 6) AS num, CASE WHEN k % 2 = 1 THEN 'thread' ELSE 'process' END AS extra FROM points WHERE value IS NOT NULL
UNION ALL SELECT seq, 'log', 'svc' || k % 6, 'oom_' || CASE WHEN k % 2 = 0 THEN 'kill' ELSE 'event' END, ts_ns, ts_ns, NULL, NULL FROM points WHERE k % 5 = 0
UNION ALL SELECT seq, 'log', 'svc' || k % 6, 'syscall_futex', ts_ns, ts_ns, NULL, NULL FROM points WHERE k % 3 = 0
UNION ALL SELECT seq, 'log', 'svc' || k % 6, 'io_f' || k % 5, ts_ns, ts_ns, NULL, NULL FROM points WHERE k % 4 = 0
UNION ALL SELECT seq, 'span', 'svc' || k % 6, 'deep-runq-' || ts_ns, ts_ns, ts_ns + {_WAIT}, NULL, {_ERRS.format('OK')} FROM points WHERE k % 7 = 0
UNION ALL SELECT seq, 'span', 'svc' || k % 6, 'deep-lock-' || ts_ns, ts_ns, ts_ns + {_WAIT}, NULL, {_ERRS.format('ERR')} FROM points WHERE k % 2 = 0
UNION ALL SELECT seq, 'span', 'svc' || k % 6, 'deep-iofile-' || ts_ns, ts_ns, ts_ns + {_WAIT}, NULL, {_ERRS.format('OK')} FROM points WHERE k % 4 = 0
UNION ALL SELECT seq, 'incident', NULL, 'inc-' || ts_ns || '-' || (ts_ns + (k - 3) * 1000) || '-deep', ts_ns, ts_ns + (k - 3) * 1000,
  CASE WHEN k % 4 = 0 THEN k / 100.0::DOUBLE ELSE 0.9 END, CASE WHEN k % 4 = 0 THEN metric_id ELSE 'cpu' END FROM points WHERE k % 6 <> 0 AND k >= 3
""",
    ("points",),
)
def s10(spark, sf):
    parts = messages.evidence_to_modalities(messages.parse_evidence(evidence_bundles(spark, sf)), ["seq"])
    null_s, null_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    p = parts["points"].select("seq", F.lit("point").alias("part"), F.col("entity_id").alias("entity"), F.col("metric_id").alias("name"),
                               F.col("ts_ns").alias("t0"), F.col("ts_ns").alias("t1"), r6("value").alias("num"), F.col("entity_type").alias("extra"))
    lo = parts["logs"].select("seq", F.lit("log").alias("part"), F.col("entity_id").alias("entity"), F.col("template_id").alias("name"),
                              F.col("ts_ns").alias("t0"), F.col("ts_ns").alias("t1"), null_d.alias("num"), null_s.alias("extra"))
    s = parts["spans"].select("seq", F.lit("span").alias("part"), F.col("service_name").alias("entity"), F.col("trace_id").alias("name"),
                              F.col("start_ts_ns").alias("t0"), F.col("end_ts_ns").alias("t1"), null_d.alias("num"), F.col("status").alias("extra"))
    i = parts["incident"].select("seq", F.lit("incident").alias("part"), null_s.alias("entity"), F.col("incident_id").alias("name"),
                                 F.col("start_ts_ns").alias("t0"), F.col("end_ts_ns").alias("t1"),
                                 r6(F.map_values("metric_scores")[0]).alias("num"), F.map_keys("metric_scores")[0].alias("extra"))
    return p.unionByName(lo).unionByName(s).unionByName(i)


def _session(tgid):
    return F.concat(F.lit("20240101-000000_"), tgid.cast("string"))


@query(
    "s11_session_tables",
    "SELECT '20240101-000000_' || tgid AS session, ts_ns, tid AS cpu_idx, c0 AS usr, c1 AS nice FROM ticks WHERE tgid % 4 <> 0",
    ("ticks",),
)
def s11(spark, sf):
    root = _fresh(spark, "sessions")
    t = ticks(spark, sf).withColumn("session", _session(F.col("tgid")))
    rows = t.select("session", "ts_ns", F.col("tid").alias("cpu_idx"), F.col("c0").alias("usr"), F.col("c1").alias("nice"))
    sessions.write_session_table(rows, root, "host_cpu")
    users = table(spark, sf, "events").select(F.floor(F.col("user_id") / 5).cast("long").alias("tgid")).distinct()
    meta = users.select(
        _session(F.col("tgid")).alias("session"), F.lit("schema_version").alias("key"), F.when(F.col("tgid") % 4 == 0, "1").otherwise("2").alias("value")
    )
    sessions.write_session_table(meta, root, "meta")
    return sessions.read_session_table(spark, root, "host_cpu").select("session", "ts_ns", "cpu_idx", "usr", "nice")


_LINE_SQL = """SELECT conv_id, turn, replace(text, chr(10), ' ') AS t,
  CASE WHEN role = 'user' THEN 'INFO' WHEN conv_id % 2 = 0 THEN 'WARN' END AS lvl FROM conversations"""


@query(
    "s12_parse_logs",
    f"""
WITH l AS ({_LINE_SQL}),
g AS (SELECT *, sum(CASE WHEN lvl IS NOT NULL OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS rec
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM l))
SELECT conv_id, min(turn) AS turn, CASE WHEN arg_min(coalesce(lvl, ''), turn) <> '' THEN 'T' || min(turn) END AS "time",
  CASE WHEN arg_min(coalesce(lvl, ''), turn) <> '' THEN arg_min(coalesce(lvl, ''), turn) ELSE 'INFO' END AS level,
  md5(string_agg(t, chr(10) ORDER BY turn)) AS msg_md5 FROM g GROUP BY conv_id, rec
""",
)
def s12(spark, sf):
    c = table(spark, sf, "conversations")
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    level = F.when(F.col("role") == "user", "INFO").when(F.col("conv_id") % 2 == 0, "WARN")
    head = F.concat(F.lit("[T"), F.col("turn").cast("string"), F.lit("] ["), level, F.lit("] "), text)
    lines = c.select("conv_id", "turn", F.coalesce(head, text).alias("line"))
    out = sessions.parse_logs(lines, ["conv_id"], ordered.by_time("turn", 1000), "turn")
    return out.select("conv_id", "turn", "time", "level", F.md5("msg").alias("msg_md5"))


cte(
    "folded",
    """
SELECT p_partkey, p_size, p_partkey % 50 AS tid, p_partkey % 50 // 5 AS tgid, p_brand, p_name,
  CASE p_partkey % 4 WHEN 0 THEN 'p:' || (p_partkey % 50 // 5) || '/' || p_brand || ';t:' || p_partkey % 50 || '/w;' WHEN 1 THEN 't:' || p_partkey % 50 || '/w;' ELSE '' END
   || replace(p_name, ' ', ';') || CASE WHEN p_partkey % 11 = 0 THEN ' x' WHEN p_partkey % 13 = 0 THEN ' -4' ELSE ' ' || p_size END AS line
FROM part
""",
)


def folded_lines(spark, sf):
    k = F.col("p_partkey")
    tid, tgid = (k % 50).cast("string"), F.floor(k % 50 / 5).cast("long").cast("string")
    root = (
        F.when(k % 4 == 0, F.concat(F.lit("p:"), tgid, F.lit("/"), "p_brand", F.lit(";t:"), tid, F.lit("/w;")))
        .when(k % 4 == 1, F.concat(F.lit("t:"), tid, F.lit("/w;"))).otherwise("")
    )
    value = F.when(k % 11 == 0, " x").when(k % 13 == 0, " -4").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", F.concat(root, F.replace("p_name", F.lit(" "), F.lit(";")), value).alias("line"))


@query(
    "s13_parse_folded",
    """
WITH ok AS (SELECT * FROM folded WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_size > 0)
SELECT 'tgid' AS by, CAST(tgid AS BIGINT) AS id, CAST(sum(p_size) AS DOUBLE) AS total FROM ok WHERE p_partkey % 4 = 0 GROUP BY 1, 2
UNION ALL SELECT 'tid', CAST(tid AS BIGINT), CAST(sum(p_size) AS DOUBLE) FROM ok WHERE p_partkey % 4 < 2 GROUP BY 1, 2
""",
    ("folded",),
)
def s13(spark, sf):
    parsed = sessions.parse_folded(folded_lines(spark, sf))
    one = lambda by: sessions.folded_totals(parsed, by).select(F.lit(by).alias("by"), F.col(by).alias("id"), "total")
    return one("tgid").unionByName(one("tid"))


@query(
    "s14_read_machine_matrix",
    f"""
WITH t AS (SELECT 'machine-' || tid AS machine, ts_ns, ts_ns // {DAY} AS t, c0, c1, c2, valid FROM ticks),
names AS (SELECT machine FROM t GROUP BY 1 HAVING count(*) FILTER (t % 2 = 0) > 0 AND count(*) FILTER (t % 2 = 1) > 0 AND count(*) FILTER (t % 2 = 1 AND valid = 1) > 0)
SELECT machine, CASE WHEN t % 2 = 0 THEN 'train' ELSE 'test' END AS part, t, ch AS channel, CAST([c0, c1, c2][ch + 1] AS DOUBLE) AS value
FROM t, (VALUES (0), (1), (2)) v(ch) WHERE machine IN (SELECT machine FROM names)
UNION ALL SELECT machine, 'label', t, -1, 1.0 FROM t WHERE t % 2 = 1 AND valid = 1 AND machine IN (SELECT machine FROM names)
""",
    ("ticks",),
)
def s14(spark, sf):
    t = ticks(spark, sf).select(
        F.concat(F.lit("machine-"), F.col("tid").cast("string")).alias("machine"), floor_div(F.col("ts_ns"), F.lit(DAY)).alias("t"),
        F.concat_ws(",", *[F.col(c).cast("string") for c in ("c0", "c1", "c2")]).alias("line"), "valid",
    )
    train, test = t.where("t % 2 = 0").drop("valid"), t.where("t % 2 = 1").drop("valid")
    labels = t.where("t % 2 = 1 AND valid = 1").select("machine", "t", F.lit("1").alias("line"))
    wide, lab = sessions.machine_matrix(train, test, labels)
    lab = lab.select("machine", F.lit("label").alias("part"), "t", F.lit(-1).alias("channel"), F.col("label").alias("value"))
    return wide.select("machine", "part", "t", "channel", "value").unionByName(lab)


@query(
    "s16_flatten_features",
    """
SELECT seq, 'total' AS part, NULL::BIGINT AS tid, NULL AS comm, CAST(k AS DOUBLE) AS on_cpu, CAST(seq % 300 AS DOUBLE) AS other FROM points
UNION ALL SELECT seq, 'tid', user_id, comm, CAST(k AS DOUBLE), CAST(k % 5 AS DOUBLE) FROM points
LEFT JOIN (SELECT user_id AS tid, arg_max(metric_id, seq) AS comm FROM points GROUP BY 1) ON tid = user_id
""",
    ("points",),
)
def s16(spark, sf):
    from telemill.operators.episodes import latest_comm

    log = points(spark, sf).select(F.col("user_id").alias("tid"), F.col("metric_id").alias("comm"), "seq")
    totals, tids = messages.flatten_features(messages.parse_features(feature_messages(spark, sf)), latest_comm(log), ["seq"])
    a = totals.select("seq", F.lit("total").alias("part"), F.lit(None).cast("long").alias("tid"), F.lit(None).cast("string").alias("comm"),
                      F.col("on_cpu_ns_total").alias("on_cpu"), F.col("switch_total").alias("other"))
    b = tids.select("seq", F.lit("tid").alias("part"), "tid", "comm", F.col("on_cpu_ns").cast("double").alias("on_cpu"), F.col("io_ops").cast("double").alias("other"))
    return a.unionByName(b)


@query(
    "s17_session_catalog",
    f"""
SELECT session, epoch(strptime(substr(session, 1, 15), '%Y%m%d-%H%M%S'))::BIGINT AS started_s, CAST(split_part(session, '_', 2) AS BIGINT) AS pid
FROM (SELECT DISTINCT strftime(make_timestamp(ts_ns // 1000), '%Y%m%d-%H%M%S') || CASE WHEN k % 5 = 0 THEN '-x' ELSE '_' || user_id END AS session FROM points)
WHERE regexp_full_match(session, '[0-9]{{8}}-[0-9]{{6}}_[0-9]+')
""",
    ("points",),
)
def s17(spark, sf):
    stamp = F.date_format(F.timestamp_micros(floor_div(F.col("ts_ns"), 1000)), "yyyyMMdd-HHmmss")
    tail = F.when(F.col("k") % 5 == 0, "-x").otherwise(F.concat(F.lit("_"), F.col("user_id").cast("string")))
    cat = sessions.session_catalog(points(spark, sf).select(F.concat(stamp, tail).alias("session")))
    return cat.select("session", F.unix_seconds("started").alias("started_s"), "pid")
