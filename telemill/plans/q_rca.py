"""Registered queries of root-cause analysis: three cases (user_id % 3), hourly buckets, one injection time."""

from pyspark.sql import functions as F

from telemill.operators import diagnosis, ordered, rca
from telemill.plans.q_quality import W0
from telemill.plans.q_sources import evidence_bundles
from telemill.plans.registry import DAY, HOUR, cte, points, query, r6
from telemill.session import cut

INJECT = (W0 + 10 * DAY) // HOUR
cte("rp", "SELECT user_id % 3 AS cs, seq, ts_ns, ts_ns // 3600000000000 AS sec, entity_id, metric_id, value, quality, k FROM points", ("points",))


def rca_points(spark, sf):
    return points(spark, sf).withColumn("case", F.col("user_id") % 3)


def rca_logs(spark, sf):
    p = rca_points(spark, sf).where("metric_id = 'error'")
    return p.select("case", "ts_ns", "entity_id", F.concat(F.lit("t"), (F.col("k") % 5).cast("string")).alias("template_id"))


def rca_spans(spark, sf):
    p = rca_points(spark, sf).where("metric_id IN ('click', 'error')")
    return p.select(
        "case", F.col("entity_id").alias("service_name"), F.col("ts_ns").alias("start_ts_ns"), (F.col("ts_ns") + F.col("k") * 1000).alias("end_ts_ns"),
        F.when(F.col("k") % 4 == 0, "ERR").when(F.col("k") % 4 == 1, "OK").when(F.col("k") % 4 == 2, "").alias("status"),
    )


def inject(spark, sf):
    return rca_points(spark, sf).select("case").distinct().withColumn("inject_s", F.lit(INJECT))


def _fill(vals, secs):
    return f"SELECT f.cs, f.sec, f.col, coalesce(v.v, 0) AS v FROM (SELECT s.cs, sec, col FROM ({secs}) s JOIN (SELECT DISTINCT cs, col FROM ({vals})) c ON c.cs = s.cs) f LEFT JOIN ({vals}) v ON v.cs = f.cs AND v.sec = f.sec AND v.col = f.col"


_MV = "SELECT cs, sec, entity_id || '_' || metric_id AS col, arg_max(coalesce(value, 0), (ts_ns, seq)) AS v FROM rp WHERE quality = 'observed' GROUP BY ALL"
cte("mt", _fill(_MV, "SELECT DISTINCT cs, sec FROM rp WHERE quality = 'observed'"), ("rp",))
_LV = "SELECT cs, sec, entity_id || '_t' || k % 5 AS col, count(*)::DOUBLE AS v FROM rp WHERE metric_id = 'error' GROUP BY ALL"
cte("lt", _fill(_LV, "SELECT DISTINCT cs, sec FROM rp WHERE metric_id = 'error'"), ("rp",))
_TS = "SELECT DISTINCT cs, sec FROM rp WHERE metric_id IN ('click', 'error')"
_TE = "SELECT cs, sec, entity_id || '_errors' AS col, (count(*) FILTER (k % 4 = 0))::DOUBLE AS v FROM rp WHERE metric_id IN ('click', 'error') GROUP BY ALL"
_TL = "SELECT cs, sec, entity_id || '_latency' AS col, avg(k * 1000) AS v FROM rp WHERE metric_id IN ('click', 'error') GROUP BY ALL"
cte("te", _fill(_TE, _TS), ("rp",))
cte("tl", _fill(_TL, _TS), ("rp",))
_OUT = 'cs AS "case", sec, col, round(v, 6) AS v'


def _table(df):
    return df.select("case", "sec", "col", r6("v").alias("v"))


@query("a1_metric_table", f"SELECT {_OUT} FROM mt", ("mt",))
def a1(spark, sf):
    return _table(rca.metric_table(rca_points(spark, sf), bucket_ns=HOUR))


@query("a2_log_table", f"SELECT {_OUT} FROM lt", ("lt",))
def a2(spark, sf):
    return _table(rca.log_table(rca_logs(spark, sf), bucket_ns=HOUR))


@query("a3_trace_tables", f"SELECT {_OUT} FROM te UNION ALL SELECT {_OUT} FROM tl", ("te", "tl"))
def a3(spark, sf):
    e, l = rca.trace_tables(rca_spans(spark, sf), bucket_ns=HOUR)
    return _table(e).unionByName(_table(l))


_SIDE = f"CASE WHEN sec < {INJECT} THEN 'normal' ELSE 'anomal' END AS side"
cte(
    "md",
    f"""
SELECT d.* FROM (SELECT *, {_SIDE} FROM (SELECT mt.* FROM mt JOIN (SELECT cs, sec, row_number() OVER (PARTITION BY cs ORDER BY sec) - 1 AS i FROM (SELECT DISTINCT cs, sec FROM mt)) r ON r.cs = mt.cs AND r.sec = mt.sec WHERE i % 3 = 0)) d
SEMI JOIN (SELECT cs, col FROM (SELECT cs, col, {_SIDE}, min(v) < max(v) AS m FROM (SELECT mt.* FROM mt JOIN (SELECT cs, sec, row_number() OVER (PARTITION BY cs ORDER BY sec) - 1 AS i FROM (SELECT DISTINCT cs, sec FROM mt)) r ON r.cs = mt.cs AND r.sec = mt.sec WHERE i % 3 = 0) GROUP BY ALL)
  GROUP BY ALL HAVING count(*) FILTER (m) = 2) k ON k.cs = d.cs AND k.col = d.col
""",
    ("mt",),
)
for _n, _src in (("ld", "lt"), ("ted", "te"), ("tld", "tl")):
    cte(_n, f"SELECT d.*, {_SIDE} FROM {_src} d SEMI JOIN (SELECT cs, col FROM {_src} GROUP BY ALL HAVING min(v) < max(v)) k ON k.cs = d.cs AND k.col = d.col", (_src,))


def metric_sided(spark, sf):
    t = rca.decimate_rows(cut(rca.metric_table(rca_points(spark, sf), bucket_ns=HOUR)), 3)
    return rca.drop_constant(rca.with_side(t, inject(spark, sf)))


def log_sided(spark, sf):
    return rca.drop_constant(rca.with_side(rca.log_table(rca_logs(spark, sf), bucket_ns=HOUR), inject(spark, sf)), per_side=False, mem_to_mb=False)


def trace_sided(spark, sf):
    e, l = rca.trace_tables(rca_spans(spark, sf), bucket_ns=HOUR)
    f = lambda t: rca.drop_constant(rca.with_side(t, inject(spark, sf)), per_side=False, mem_to_mb=False)
    return f(e), f(l)


@query("a4_drop_constant", f'SELECT {_OUT}, side FROM md', ("md",))
def a4(spark, sf):
    return metric_sided(spark, sf).select("case", "sec", "col", r6("v").alias("v"), "side")


def _sev(src, base=None):
    base = base or f"SELECT * FROM {src} WHERE side = 'normal'"
    return f"""SELECT cs, col, z / CASE WHEN sum(z) OVER (PARTITION BY cs) = 0 THEN 1 ELSE sum(z) OVER (PARTITION BY cs) END AS score FROM (SELECT a.cs, a.col, max(abs((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END)) AS z
FROM {src} a JOIN (SELECT cs, col, avg(v) AS m, stddev_pop(v) AS s FROM ({base}) GROUP BY ALL) b ON b.cs = a.cs AND b.col = a.col WHERE side = 'anomal' GROUP BY ALL)"""


_TEB = "SELECT t.* FROM ted t JOIN (SELECT cs, sec, row_number() OVER (PARTITION BY cs ORDER BY sec DESC) AS r FROM (SELECT DISTINCT cs, sec FROM ted WHERE side = 'normal')) r ON r.cs = t.cs AND r.sec = t.sec WHERE r > 2"
cte("sv_m", _sev("md"), ("md",))
cte("sv_l", _sev("ld"), ("ld",))
cte("sv_tl", _sev("tld"), ("tld",))
cte("sv_te", _sev("ted", _TEB), ("ted",))


def severities(spark, sf):
    te, tl = trace_sided(spark, sf)
    te = cut(te)
    parts = (metric_sided(spark, sf), log_sided(spark, sf), tl)
    return [cut(rca.severity(cut(p))) for p in parts] + [cut(rca.severity(rca.drop_last_normal_rows(te)))]


_NAMES = ("m", "l", "tl", "te")


@query(
    "a5_severity",
    " UNION ALL ".join(f"SELECT '{n}' AS modality, cs AS \"case\", col, round(score, 6) AS score FROM sv_{n}" for n in _NAMES),
    tuple(f"sv_{n}" for n in _NAMES),
)
def a5(spark, sf):
    out = None
    for n, s in zip(_NAMES, severities(spark, sf)):
        part = s.select(F.lit(n).alias("modality"), "case", "col", r6("score").alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


_SVC = "split_part(col, '_', 1)"
cte(
    "mx",
    f"""
SELECT cs, service, coalesce(max(score) FILTER (m = 'm'), 0) AS metric, coalesce(max(score) FILTER (m = 'l'), 0) AS log, coalesce(max(score) FILTER (m = 'tl'), 0) AS trace_lat, coalesce(max(score) FILTER (m = 'te'), 0) AS trace_err FROM (
 SELECT 'm' AS m, cs, {_SVC} AS service, sum(score) AS score FROM sv_m GROUP BY ALL UNION ALL SELECT 'tl', cs, {_SVC}, sum(score) FROM sv_tl GROUP BY ALL UNION ALL SELECT 'te', cs, {_SVC}, sum(score) FROM sv_te GROUP BY ALL
 UNION ALL SELECT 'l', cs, service, b / sum(b) OVER (PARTITION BY cs) FROM (SELECT cs, {_SVC} AS service, max(score) AS b FROM sv_l GROUP BY ALL)) GROUP BY ALL
""",
    tuple(f"sv_{n}" for n in _NAMES),
)


def matrix(spark, sf):
    m, l, tl, te = severities(spark, sf)
    return rca.modality_matrix(rca.rollup_sum(m), rca.rollup_max(l), rca.rollup_sum(tl), rca.rollup_sum(te))


@query(
    "a6_rollups",
    f"SELECT 'sum' AS kind, cs AS \"case\", {_SVC} AS service, round(sum(score), 6) AS score FROM sv_m GROUP BY ALL UNION ALL SELECT 'max', cs, service, round(b / sum(b) OVER (PARTITION BY cs), 6) FROM (SELECT cs, {_SVC} AS service, max(score) AS b FROM sv_l GROUP BY ALL)",
    ("sv_m", "sv_l"),
)
def a6(spark, sf):
    m, l, _, _ = severities(spark, sf)
    one = lambda kind, d: d.select(F.lit(kind).alias("kind"), "case", "service", r6("score").alias("score"))
    return one("sum", rca.rollup_sum(m)).unionByName(one("max", rca.rollup_max(l)))


@query(
    "a7_modality_matrix",
    'SELECT cs AS "case", service, ' + ", ".join(f"round({c}, 6) AS {c}" for c in rca.MODALITIES) + " FROM mx",
    ("mx",),
)
def a7(spark, sf):
    return matrix(spark, sf).select("case", "service", *[r6(c).alias(c) for c in rca.MODALITIES])


@query("a8_symptom_clusters")
def a8(spark, sf):
    return rca.symptom_clusters(matrix(spark, sf)).withColumn("cluster_score", r6("cluster_score"))


def _top_columns(spark, sf, n):
    s = cut(metric_sided(spark, sf))
    return s.join(rca.top_variance(s, n).select("case", "col"), ["case", "col"], "left_semi")


@query("a9_kbins")
def a9(spark, sf):
    s = cut(metric_sided(spark, sf))
    return rca.discretise(s, rca.kbins_edges(s)).select("case", "side", "sec", "col", "bin")


def _quartile_rows(spark, sf, n=12):
    """Samples binned at fixed values, so that SQL can repeat them."""
    s = _top_columns(spark, sf, n)
    b = F.when(F.col("v") <= 0, 0).when(F.col("v") <= 20, 1).when(F.col("v") <= 60, 2).otherwise(3)
    return s.select("case", "side", "sec", "col", b.alias("bin"))


_TOPV = "SELECT cs, col FROM (SELECT cs, col, row_number() OVER (PARTITION BY cs ORDER BY round(var_samp(v), 6) DESC, col) AS r FROM md GROUP BY cs, col) WHERE r <= 12"


@query(
    "a10_chi_square_ci",
    f"""
WITH b AS (SELECT md.cs, md.col, sec, side, CASE WHEN v <= 0 THEN 0 WHEN v <= 20 THEN 1 WHEN v <= 60 THEN 2 ELSE 3 END AS bin FROM md),
c AS (SELECT cs, col, row_number() OVER (PARTITION BY cs ORDER BY col) AS i FROM (SELECT DISTINCT cs, col FROM md)),
t AS (SELECT a.cs, a.col AS y, s.col AS s FROM c a JOIN c s ON s.cs = a.cs AND s.i = a.i + 1),
o AS (SELECT t.cs, t.y, bs.bin AS s, bb.side, bb.bin AS yb, count(*) AS o FROM t JOIN b bb ON bb.cs = t.cs AND bb.col = t.y JOIN b bs ON bs.cs = t.cs AND bs.col = t.s AND bs.sec = bb.sec GROUP BY ALL),
m AS (SELECT *, sum(o) OVER (PARTITION BY cs, y, s) AS n, sum(o) OVER (PARTITION BY cs, y, s, side) AS r, sum(o) OVER (PARTITION BY cs, y, s, yb) AS c FROM o),
st AS (SELECT cs, y, s, any_value(n) * (sum(o * o / (r * c)) - 1) AS stat, (count(DISTINCT side) - 1) * (count(DISTINCT yb) - 1) AS dof FROM m GROUP BY ALL)
SELECT cs AS "case", y, round(sum(stat), 5) AS stat, CAST(sum(dof) AS BIGINT) AS dof FROM st GROUP BY ALL
""",
    ("md",),
)
def a10(spark, sf):
    from pyspark.sql import Window

    s = cut(metric_sided(spark, sf))
    b = F.when(F.col("v") <= 0, 0).when(F.col("v") <= 20, 1).when(F.col("v") <= 60, 2).otherwise(3)
    rows = rca.sample_rows(s.select("case", "side", "sec", "col", b.alias("bin")))
    cols = s.select("case", "col").distinct()
    nxt = F.lead("col").over(Window.partitionBy("case").orderBy("col"))
    tests = cols.withColumn("s", nxt).where("s IS NOT NULL").select(
        "case", F.xxhash64("col").alias("test_id"), F.lit(rca.F_NODE).alias("x"), F.col("col").alias("y"), F.array("s").alias("given")
    )
    out = rca.chi_square_ci(rows, cut(tests))
    return out.select("case", "y", F.round("stat", 5).alias("stat"), "dof")


def _search_input(spark, sf, n):
    b = cut(_quartile_rows(spark, sf, n))
    return cut(rca.sample_rows(b)), cut(b.select("case", "col").distinct())


@query("a11_local_skeleton")
def a11(spark, sf):
    rows, cols = _search_input(spark, sf, 8)
    kept, removed = rca.local_skeleton(rows, cols, 0.05)
    return kept.select("case", "y", F.lit("kept").alias("state")).unionByName(removed.select("case", "y", F.lit("removed").alias("state")))


@query("a12_full_skeleton")
def a12(spark, sf):
    rows, cols = _search_input(spark, sf, 5)
    kept, removed = rca.full_skeleton(rows, cols, 0.05)
    return kept.select("case", "x", "y", F.lit("kept").alias("state")).unionByName(removed.select("case", "x", "y", F.lit("removed").alias("state")))


@query("a13_psi_pc")
def a13(spark, sf):
    rows, cols = _search_input(spark, sf, 12)
    return rca.psi_pc(rows, rca.column_chunks(cols), rca.CHUNK_ALPHA, 1)


@query("a14_multi_phase")
def a14(spark, sf):
    rows, cols = _search_input(spark, sf, 20)
    return rca.multi_phase(rows, cols)


@query("a15_top_variance", f'SELECT cs AS "case", col FROM ({_TOPV})', ("md",))
def a15(spark, sf):
    return rca.top_variance(metric_sided(spark, sf), 12).select("case", "col")


_MEAN4 = "(metric + log + trace_lat + trace_err) / 4"


def _hash_clusters(m):
    """A fixed grouping of services, so that SQL can repeat it: e0..e4 and e5..e9."""
    cid = F.when(F.substring("service", 2, 1).cast("int") < 5, 0).otherwise(1)
    return m.select("case", "service", cid.alias("cluster_id"), F.lit(1.0).alias("cluster_score"))


def _ordering(m):
    """Causal order by reversed name for the first group only."""
    c = _hash_clusters(m).where("cluster_id = 0")
    return c.select("case", "cluster_id", F.concat("service", F.lit("_x")).alias("col"), (10 - F.substring("service", 2, 1).cast("int")).alias("pos"))


_RK = f"""SELECT cs, service, g AS cluster_id, row_number() OVER (PARTITION BY cs ORDER BY g, CASE WHEN g = 0 AND n > 1 THEN 10 - d ELSE -round({_MEAN4}, 12) END, service) AS rank FROM
(SELECT *, count(*) OVER (PARTITION BY cs, g) AS n FROM (SELECT *, CAST(substr(service, 2, 1) AS INT) AS d, CASE WHEN CAST(substr(service, 2, 1) AS INT) < 5 THEN 0 ELSE 1 END AS g FROM mx))"""


@query("a16_refine_clusters", f'SELECT cs AS "case", service, cluster_id, rank FROM ({_RK})', ("mx",))
def a16(spark, sf):
    m = cut(matrix(spark, sf))
    return rca.refine_clusters(_hash_clusters(m), m, _ordering(m)).select("case", "service", "cluster_id", "rank")


_ALL = " UNION ALL ".join(f"SELECT cs, col, score FROM sv_{n}" for n in _NAMES)
_IND = f"SELECT *, row_number() OVER (PARTITION BY cs, service ORDER BY round(score, 12) DESC, col) AS pos FROM (SELECT *, {_SVC} AS service FROM ({_ALL}))"


@query("a17_indicator_ranks", f'SELECT cs AS "case", service, col, round(score, 6) AS score, pos FROM ({_IND}) WHERE pos <= 5', tuple(f"sv_{n}" for n in _NAMES))
def a17(spark, sf):
    ranks = [s.withColumn("score", F.round("score", 12)) for s in severities(spark, sf)]
    return rca.indicator_ranks(*ranks).select("case", "service", "col", r6("score").alias("score"), "pos")


@query(
    "a18_report",
    f"""
WITH rk AS ({_RK}), ind AS (SELECT cs, service, string_agg(col, ',' ORDER BY pos) AS evidence FROM ({_IND}) WHERE pos <= 5 GROUP BY ALL)
SELECT rk.cs AS "case", rk.service AS entity_id, rank, round(1.0 / rank, 6) AS score, 'up' AS direction, coalesce(evidence, '') AS evidence,
  concat_ws(';', CASE WHEN rk.cs NOT IN (SELECT cs FROM rp WHERE metric_id IN ('click', 'error')) THEN 'traces absent (blind spot)' END,
            CASE WHEN rk.cs NOT IN (SELECT cs FROM rp WHERE metric_id = 'error') THEN 'logs absent (blind spot)' END) AS limitations
FROM rk LEFT JOIN ind ON ind.cs = rk.cs AND ind.service = rk.service WHERE rank <= 3
""",
    ("mx", "rp", *[f"sv_{n}" for n in _NAMES]),
)
def a18(spark, sf):
    sev = [s.withColumn("score", F.round("score", 12)) for s in severities(spark, sf)]
    m = cut(rca.modality_matrix(rca.rollup_sum(sev[0]), rca.rollup_max(sev[1]), rca.rollup_sum(sev[2]), rca.rollup_sum(sev[3])))
    ranked = rca.refine_clusters(_hash_clusters(m), m, _ordering(m))
    rep = rca.report(ranked, m, rca.indicator_ranks(*sev), rca_logs(spark, sf), rca_spans(spark, sf), top_k=3, cases=inject(spark, sf))
    return rep.select("case", F.inline("candidates"), F.array_join("limitations", ";").alias("limitations")).select(
        "case", "entity_id", "rank", r6("score").alias("score"), "direction", F.array_join("evidence", ",").alias("evidence"), "limitations"
    )


@query("a18_analyze")
def a18b(spark, sf):
    """The whole pipeline end to end."""
    rep = rca.analyze(rca_points(spark, sf), rca_logs(spark, sf), rca_spans(spark, sf), inject(spark, sf), bucket_ns=HOUR)
    return rep.select("case", F.inline("candidates")).select("case", "entity_id", "rank", "cluster_id")


@query(
    "a18_diagnose",
    """SELECT k % 6 AS "case", bool_or(k % 6 <> 0 AND k >= 3) AS ok, CASE WHEN NOT bool_or(k % 6 <> 0 AND k >= 3) THEN 'no valid anomaly window in evidence' END AS abstained_reason,
 bool_or(k % 6 <> 0 AND k >= 3) AS has_report FROM points GROUP BY 1""",
    ("points",),
)
def a18c(spark, sf):
    """Evidence bundles, several a case, to reports in one call."""
    bundles = evidence_bundles(spark, sf).select((F.col("k") % 6).alias("case"), "value")
    out = diagnosis.diagnose(bundles, bucket_ns=HOUR, chunk=ordered.by_time("start_ts_ns"))
    return out.select("case", "ok", "abstained_reason", F.col("candidates").isNotNull().alias("has_report"))


# incidents of the entities, one per large error; maps of one or two metrics
cte(
    "inc",
    f"""SELECT user_id % 3 AS cs, 'i' || seq AS incident_id, ts_ns AS s, ts_ns + (k % 7 + 1) * {HOUR // 24} AS e, CASE k % 3 WHEN 0 THEN 'anomaly' WHEN 1 THEN 'uncertain' ELSE 'normal' END AS status, value / 500 AS severity,
 metric_id AS m1, CASE WHEN k % 2 = 0 THEN 'zz' END AS m2, k FROM points WHERE value > 100""",
    ("points",),
)


def incidents(spark, sf):
    k = F.col("k")
    p = rca_points(spark, sf).where("value > 100")
    two = k % 2 == 0
    return p.select(
        "case", F.concat(F.lit("i"), F.col("seq").cast("string")).alias("incident_id"), F.col("ts_ns").alias("start_ts_ns"), (F.col("ts_ns") + (k % 7 + 1) * (HOUR // 24)).alias("end_ts_ns"),
        F.when(k % 3 == 0, "anomaly").when(k % 3 == 1, "uncertain").otherwise("normal").alias("status"), (F.col("value") / 500).alias("severity"),
        F.when(two, F.create_map(F.col("metric_id"), F.lit(0.5), F.lit("zz"), k.cast("double"))).otherwise(F.create_map(F.col("metric_id"), F.lit(0.5))).alias("metric_scores"),
        F.when(two, F.create_map(F.col("metric_id"), F.lit("up"), F.lit("zz"), k.cast("string"))).otherwise(F.create_map(F.col("metric_id"), F.lit("up"))).alias("directions"),
    )


@query(
    "a19_pick_incident",
    """SELECT cs AS "case", arg_max(incident_id, ((status = 'anomaly')::INT, CASE WHEN m2 IS NULL THEN 1 ELSE 2 END, severity, incident_id)) AS incident_id FROM inc WHERE status <> 'normal' AND severity > 0 GROUP BY 1""",
    ("inc",),
)
def a19(spark, sf):
    return rca.pick_incident(incidents(spark, sf)).select("case", "incident_id")


@query(
    "a20_merge_across_entities",
    """
WITH g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY cs ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, max(e) OVER (PARTITION BY cs ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM inc)),
mt AS (SELECT cs, isl, m, arg_max(x, (s, -e, incident_id)) AS x FROM (SELECT cs, isl, s, e, incident_id, m1 AS m, 0.5::DOUBLE AS x FROM g UNION ALL SELECT cs, isl, s, e, incident_id, m2, k::DOUBLE FROM g WHERE m2 IS NOT NULL) GROUP BY ALL)
SELECT g.cs AS "case", arg_min(g.incident_id, (g.s, -g.e, g.incident_id)) AS incident_id, min(s) AS start_ts_ns, max(e) AS end_ts_ns, round(max(severity), 6) AS severity,
 CASE WHEN count(*) = 1 THEN any_value(status) WHEN bool_or(status = 'anomaly') THEN 'anomaly' ELSE 'uncertain' END AS status,
 any_value(t.txt) AS metrics FROM g JOIN (SELECT cs, isl, string_agg(m || '=' || printf('%.1f', x), ';' ORDER BY m) AS txt FROM mt GROUP BY ALL) t ON t.cs = g.cs AND t.isl = g.isl GROUP BY g.cs, g.isl
""",
    ("inc",),
)
def a20(spark, sf):
    m = rca.merge_across_entities(incidents(spark, sf), "case", ordered.by_time("start_ts_ns", 4 * DAY))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("metric_scores")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.1f", e["value"]))), ";")
    return m.select("case", "incident_id", "start_ts_ns", "end_ts_ns", r6("severity").alias("severity"), "status", text.alias("metrics"))


@query(
    "a21_abstain",
    """
WITH c AS (SELECT user_id AS cs, count(*) FILTER (quality = 'observed') AS n, max(value) > 100 AS i FROM points GROUP BY 1)
SELECT cs AS "case", (i AND n >= 2)::INT AS ok, CASE WHEN NOT coalesce(i, false) THEN 'no valid anomaly window in evidence' WHEN n < 2 THEN 'empty evidence series' END AS abstained_reason FROM c
""".replace("(i AND n >= 2)::INT", "(coalesce(i, false) AND n >= 2)::INT"),
    ("points",),
)
def a21(spark, sf):
    p = points(spark, sf).withColumnRenamed("user_id", "case")
    out = rca.abstain(p.select("case").distinct(), p.where("value > 100"), p.where("quality = 'observed'"))
    return out.withColumn("ok", F.col("ok").cast("int"))


@query(
    "a22_baselines",
    """
SELECT 'corr' AS method, cs AS "case", col, round(coalesce(abs(corr(v, (side = 'anomal')::INT)), 0), 6) AS score FROM md GROUP BY ALL
UNION ALL SELECT 'iqr', a.cs, a.col, round(max(abs(v - q[2]) / CASE WHEN q[3] - q[1] = 0 THEN 1 ELSE q[3] - q[1] END), 6) FROM md a JOIN (SELECT cs, col, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM md WHERE side = 'normal' GROUP BY ALL) b ON b.cs = a.cs AND b.col = a.col WHERE side = 'anomal' GROUP BY ALL
""",
    ("md",),
)
def a22(spark, sf):
    s = cut(metric_sided(spark, sf))
    one = lambda n, d: d.select(F.lit(n).alias("method"), "case", "col", r6("score").alias("score"))
    return one("corr", rca.baseline_correlation(s)).unionByName(one("iqr", rca.baseline_median_iqr(s)))
