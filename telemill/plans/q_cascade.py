"""Registered queries of the cascade and the fused detector."""

from pyspark.sql import functions as F

from telemill.functions.scores import incident_id
from telemill.operators import detect, detectors, ordered, spectral, stats as st, windows
from telemill.plans.q_detect import _RING_SQL, _SC_SQL, fitted, incident_rows, labelled, streaming_scores
from telemill.plans.q_quality import grid
from telemill.plans.registry import DAY, HOUR, cte, points, query, r6
from telemill.session import cut


@query("d12_spectral_scores")
def d12(spark, sf):
    cells = windows.align_grid(windows.sliding_windows(points(spark, sf), DAY, 12 * HOUR), HOUR)
    win = cut(spectral.collect_windows(cells, 6))
    cut1 = win.agg(F.percentile_approx("w_start", 0.6, 1000)).scalar()
    model = cut(spectral.fit(win.where(F.col("w_start") <= cut1), 2, 64, 64 * DAY))
    return spectral.score(win, model, 2, 64, 64 * DAY).select("w_start", "entity_id", "metric_id", r6("score").alias("score"))


_GATE_SQL = f"""
{_RING_SQL},
cell AS (SELECT w_start, entity_id, cell_ts, max(observed::INT) AS o FROM grid GROUP BY ALL),
gp AS (SELECT w_start, entity_id, coalesce(f < m AND l > m, false) AS gap FROM (SELECT w_start, entity_id, min(CASE WHEN o = 0 THEN cell_ts END) AS m,
   min(CASE WHEN o = 1 THEN cell_ts END) AS f, max(CASE WHEN o = 1 THEN cell_ts END) AS l FROM cell GROUP BY ALL)),
ec AS (SELECT w_start, entity_id, count(*) AS n, max((metric_id = '_quality')::INT) AS q FROM evs GROUP BY ALL),
g0 AS (SELECT r.w_start, r.w_end, r.entity_id, missing_frac, confidence, mean_residual_z, missing_frac > 0.7 AS thin, gap, coalesce(n, 0) AS n, coalesce(q, 0) AS q
  FROM ring2 r JOIN gp USING (w_start, entity_id) LEFT JOIN ec ON ec.w_start = r.w_start AND ec.entity_id = r.entity_id),
g1 AS (SELECT *, thin OR q = 1 AS quality_trigger, n > 0 AND NOT (thin OR q = 1) AS event_trigger,
  CASE WHEN thin THEN least(1, missing_frac) WHEN q = 1 THEN 1.0 END AS quality_score FROM g0 WHERE NOT thin OR gap),
gate AS (SELECT *, event_trigger OR confidence < 0.6 OR (mean_residual_z > 1.5 AND NOT event_trigger) OR quality_trigger AS need_trend FROM g1)
"""


def _gate(spark, sf):
    s, t = fitted(spark, sf)
    cells = cut(grid(spark, sf))
    events = cut(detect.event_scores(cells, s, t))
    return events, detect.trend_gate(detect.event_ring(cells, s), events, cells, max_missing=0.7)


@query(
    "d13_trend_gate",
    f"WITH {_GATE_SQL} SELECT w_start, entity_id, round(confidence, 6) AS confidence, event_trigger::INT AS event_trigger, quality_trigger::INT AS quality_trigger, need_trend::INT AS need_trend FROM gate",
    ("evs",),
)
def d13(spark, sf):
    _, g = _gate(spark, sf)
    return g.select("w_start", "entity_id", r6("confidence").alias("confidence"), *[F.col(c).cast("int").alias(c) for c in ("event_trigger", "quality_trigger", "need_trend")])


# the streaming scores stand in for the second ring, so that the gate has an SQL check
_CONS_SQL = f"""
{_GATE_SQL.replace("cell AS (", "cell0 AS (").replace("FROM cell GROUP", "FROM cell0 GROUP").replace("gp AS (", "gp0 AS (").replace("JOIN gp USING", "JOIN gp0 USING")},
{_SC_SQL},
bo AS (SELECT coalesce(e.w_start, t.w_start) AS w_start, coalesce(e.entity_id, t.entity_id) AS entity_id, coalesce(e.metric_id, t.metric_id) AS metric_id,
   greatest(e.score, t.score) AS score, coalesce(e.direction, t.direction) AS direction, coalesce(e.direction = t.direction, false) AS strong
   FROM (SELECT * FROM evs WHERE metric_id <> '_quality') e FULL JOIN (SELECT * FROM sc WHERE metric_id <> '_quality') t
   ON e.w_start = t.w_start AND e.entity_id = t.entity_id AND e.metric_id = t.metric_id),
bg AS (SELECT b.*, bool_or(strong) OVER (PARTITION BY b.w_start, b.entity_id) AS any_strong, quality_trigger, quality_score FROM bo b JOIN gate g ON g.w_start = b.w_start AND g.entity_id = b.entity_id),
cons AS (SELECT w_start, entity_id, metric_id, score, direction, CASE WHEN any_strong THEN 'anomaly' ELSE 'uncertain' END AS status FROM bg WHERE any_strong OR NOT quality_trigger
  UNION ALL SELECT g.w_start, g.entity_id, '_quality', g.quality_score, 'missing', CASE WHEN coalesce(a.s, false) THEN 'anomaly' ELSE 'uncertain' END FROM gate g
   LEFT JOIN (SELECT w_start, entity_id, bool_or(strong) AS s FROM bg GROUP BY ALL) a ON a.w_start = g.w_start AND a.entity_id = g.entity_id WHERE g.quality_trigger)
"""


def _consistent(spark, sf):
    events, gate = _gate(spark, sf)
    trends = streaming_scores(spark, sf).where("metric_id <> '_quality'")
    return detect.consistency_gate(events, trends, cut(gate))


@query(
    "d14_consistency_gate",
    f"WITH {_CONS_SQL} SELECT w_start, entity_id, metric_id, round(score, 6) AS score, direction, status FROM cons",
    ("evs",),
)
def d14(spark, sf):
    return _consistent(spark, sf).select("w_start", "entity_id", "metric_id", r6("score").alias("score"), "direction", "status")


cte(
    "state_pts",
    """
SELECT seq, ts_ns, entity_id, metric_id, quality, split, metric_id = 'signup' AS is_state, CASE WHEN metric_id = 'signup' THEN CAST(k % 3 AS DOUBLE)
  WHEN value IS NOT NULL AND k % 2 = 0 THEN CAST(k % 3 AS DOUBLE) ELSE value END AS value FROM labelled
""",
    ("labelled",),
)


@query(
    "d15_state_branch",
    f"""
WITH mem AS (SELECT entity_id, metric_id, CAST(round_even(value, 0) AS BIGINT) AS sid FROM state_pts WHERE is_state AND split = 'train' AND value IS NOT NULL AND seq % 3 = 0 GROUP BY ALL),
w AS (SELECT ts_ns // {12 * HOUR} * {12 * HOUR} AS w_start, * FROM state_pts WHERE quality = 'observed' AND value IS NOT NULL),
last AS (SELECT w_start, entity_id, metric_id, arg_max(value, (ts_ns, seq)) AS last FROM w GROUP BY ALL),
known AS (SELECT w_start, l.entity_id, sid FROM last l JOIN mem m ON m.entity_id = l.entity_id AND m.metric_id = l.metric_id AND m.sid = CAST(round_even(last, 0) AS BIGINT))
SELECT l.w_start, l.entity_id, l.metric_id, 0.8 * CASE WHEN k.sid IS NOT NULL AND abs(l.last - k.sid) <= 2e-9 THEN 0.5 ELSE 1 END AS score
FROM last l LEFT JOIN known k ON k.w_start = l.w_start AND k.entity_id = l.entity_id WHERE l.metric_id <> 'signup'
""",
    ("state_pts",),
)
def d15(spark, sf):
    k = F.col("k")
    state = F.col("metric_id") == "signup"
    value = F.when(state, (k % 3).cast("double")).when(F.col("value").isNotNull() & (k % 2 == 0), (k % 3).cast("double")).otherwise(F.col("value"))
    p = labelled(spark, sf).withColumn("value", value).withColumn("is_state", state)
    memory = detect.fit_state_memory(p.where("split = 'train' AND seq % 3 = 0"))
    half = 12 * HOUR
    w = F.col("ts_ns") - F.col("ts_ns") % half
    # one cell per point time: order within a window follows (ts_ns, seq)
    cells = p.select(
        w.alias("w_start"), (w + half).alias("w_end"), "entity_id", "metric_id", F.struct("ts_ns", "seq").alias("cell_ts"),
        "value", (F.col("quality") == "observed").alias("observed"),
    )
    scored = cells.where("observed AND value IS NOT NULL AND metric_id <> 'signup'").select(*detect.WIN, "metric_id").distinct()
    scored = scored.withColumns({"score": F.lit(0.8), "direction": F.lit("up")})
    series = p.where("is_state").select("entity_id", "metric_id").distinct()
    out = detect.state_branch(scored, cells, memory, series)
    return out.select("w_start", "entity_id", "metric_id", "score")


@query(
    "d16_merge_detected",
    f"""
WITH {_CONS_SQL},
w AS (SELECT entity_id, w_start, w_start + {DAY} AS w_end, max(status) AS st FROM cons GROUP BY ALL),
wi AS (SELECT *, sum(CASE WHEN p IS NULL OR w_start > p THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY w_start) AS island
  FROM (SELECT *, max(w_end) OVER (PARTITION BY entity_id ORDER BY w_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w)),
pmm AS (SELECT c.entity_id, island, metric_id, max(score) AS score, arg_min(direction, c.w_start) AS direction, min(c.w_start) AS fw
  FROM cons c JOIN wi ON wi.entity_id = c.entity_id AND wi.w_start = c.w_start GROUP BY ALL),
ext AS (SELECT entity_id, island, min(w_start) AS s, max(w_end) AS e, min(st) AS st FROM wi GROUP BY ALL)
SELECT pm.entity_id, s AS start_ts_ns, e AS end_ts_ns, any_value(st) AS status, round(least(1, max(score)) * CASE WHEN any_value(st) = 'uncertain' THEN 0.6 ELSE 1 END, 6) AS severity,
  'inc-' || s || '-' || e || '-' || arg_min(metric_id, (-score, fw, (metric_id = '_quality')::INT, metric_id)) || '-' || substr(sha1(s || ':' || e || ':' || pm.entity_id), 1, 8) AS incident_id,
  string_agg(metric_id || '=' || printf('%.4f', score) || ':' || direction, ';' ORDER BY metric_id) AS metrics
FROM pmm pm JOIN ext USING (entity_id, island) GROUP BY pm.entity_id, island, s, e
""",
    ("evs",),
)
def d16(spark, sf):
    inc = detect.merge_incidents(_consistent(spark, sf), "cascade")
    return incident_rows(inc).join(inc.select("entity_id", "start_ts_ns", "status"), ["entity_id", "start_ts_ns"])


# ---- fused detector: three sources, five channels each ----
cte(
    "chan",
    """
SELECT user_id % 3 AS src, seq, ts_ns, 'h' || user_id % 3 AS entity_id, metric_id, value, quality, k, split FROM labelled
""",
    ("labelled",),
)
cte(
    "cm",
    """
SELECT f.src, f.ts_ns, f.metric_id, coalesce(last_value(v.value IGNORE NULLS) OVER (PARTITION BY f.src, f.metric_id ORDER BY f.ts_ns ROWS UNBOUNDED PRECEDING), 0) AS value
FROM (SELECT t.src, ts_ns, metric_id FROM (SELECT DISTINCT src, ts_ns FROM chan) t JOIN (SELECT DISTINCT src, metric_id FROM chan WHERE quality = 'observed') c ON c.src = t.src) f
LEFT JOIN (SELECT src, ts_ns, metric_id, arg_max(value, seq) AS value FROM chan WHERE quality = 'observed' AND value IS NOT NULL GROUP BY ALL) v
ON v.src = f.src AND v.ts_ns = f.ts_ns AND v.metric_id = f.metric_id
""",
    ("chan",),
)
cte("cut1", "SELECT src, max(ts_ns) AS c FROM chan WHERE split = 'train' GROUP BY 1", ("chan",))
cte(
    "chfit",
    "SELECT cm.src, metric_id, median(value) AS med, mad(value) AS mad FROM cm JOIN cut1 ON cut1.src = cm.src AND ts_ns <= c GROUP BY ALL",
    ("cm", "cut1"),
)
cte(
    "cz",
    """SELECT cm.src, ts_ns, max(abs(value - med) / (1.4826 * greatest(mad, 1e-8))) AS z FROM cm JOIN chfit USING (src, metric_id) GROUP BY ALL""",
    ("cm", "chfit"),
)
cte(
    "cq",
    "SELECT cz.src, greatest(quantile_cont(z, 0.99), 1e-8) AS q99 FROM cz JOIN cut1 ON cut1.src = cz.src AND ts_ns <= c GROUP BY 1",
    ("cz", "cut1"),
)
cte(
    "fz",
    """SELECT cz.src, cz.ts_ns, least(1, z / q99) AS zn, 0.7 * raw + 0.3 * least(1, z / q99) AS fused FROM cz JOIN cq ON cq.src = cz.src
JOIN (SELECT src, ts_ns, max(k % 101) / 100.0::DOUBLE AS raw FROM chan GROUP BY ALL) r ON r.src = cz.src AND r.ts_ns = cz.ts_ns""",
    ("cz", "cq"),
)
_REF = "CASE WHEN ((i + o) % (2 * n) + 2 * n) % (2 * n) < n THEN ((i + o) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((i + o) % (2 * n) + 2 * n) % (2 * n) END"
cte(
    "sm",
    f"""
SELECT a.src, a.ts_ns, median(b.fused) AS smooth, median(b.zn) AS zn_smooth
FROM (SELECT *, {_REF} AS j FROM (SELECT src, ts_ns, row_number() OVER (PARTITION BY src ORDER BY ts_ns) - 1 AS i, count(*) OVER (PARTITION BY src) AS n FROM fz), (VALUES (-2), (-1), (0), (1), (2)) v(o)) a
JOIN (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts_ns) - 1 AS i FROM fz) b ON b.src = a.src AND b.i = a.j GROUP BY a.src, a.ts_ns
""",
    ("fz",),
)
G = ["src"]


def channel_points(spark, sf):
    src = F.col("user_id") % 3
    p = labelled(spark, sf).select(src.alias("src"), "seq", "ts_ns", F.concat(F.lit("h"), src.cast("string")).alias("entity_id"), "metric_id", "value", "quality", "k", "split")
    return detect.channel_values(p, G, ["split"], k=F.max(F.col("k") % 101))


def _matrix(spark, sf):
    return detect.channel_matrix(channel_points(spark, sf), G, ordered.by_time())


@query("d17_channel_matrix", "SELECT src, ts_ns, metric_id, round(value, 6) AS value FROM cm", ("cm",))
def d17(spark, sf):
    return _matrix(spark, sf).select("src", "ts_ns", "metric_id", r6("value").alias("value"))


def train_and_all(pts, chunk):
    """Channel runs of the train period, with the channels of the whole, and of everything."""
    last = pts.where("split = 'train'").groupBy("src").agg(F.max("ts_ns").alias("c"))
    m = detect.channel_runs(pts, G, chunk)
    return m.first(last), m


def _fuse_parts(spark, sf):
    pts = channel_points(spark, sf)
    train, m = train_and_all(pts, ordered.by_time())
    model, q = detect.fit_channels(train)
    return pts, m, model, cut(q)


def _fused(spark, sf):
    pts, m, model, q = _fuse_parts(spark, sf)
    raw = pts.groupBy("src", "ts_ns").agg((F.max(F.col("k") % 101) / F.lit(100.0)).alias("raw"))
    z = detect.max_channel_z(m, model).join(q, "src").join(raw, ["src", "ts_ns"])
    return m, model, detect.fuse(z)


@query("d18_max_channel_z", "SELECT cz.src, ts_ns, round(z, 5) AS z, round(q99, 6) AS q99 FROM cz JOIN cq ON cq.src = cz.src", ("cz", "cq"))
def d18(spark, sf):
    _, m, model, q = _fuse_parts(spark, sf)
    return detect.max_channel_z(m, model).join(q, "src").select("src", "ts_ns", F.round("z", 5).alias("z"), r6("q99").alias("q99"))


@query("d19_fuse", "SELECT src, ts_ns, round(zn, 6) AS zn, round(fused, 6) AS fused FROM fz", ("fz",))
def d19(spark, sf):
    return _fused(spark, sf)[2].select("src", "ts_ns", r6("zn").alias("zn"), r6("fused").alias("fused"))


def _smooth(fused):
    return detect.median_filter(cut(fused), G, ["ts_ns"], {"smooth": "fused", "zn_smooth": "zn"}, 5, ordered.by_time())


@query("d20_median_filter", "SELECT src, ts_ns, round(smooth, 6) AS smooth, round(zn_smooth, 6) AS zn_smooth FROM sm", ("sm",))
def d20(spark, sf):
    return _smooth(_fused(spark, sf)[2]).select("src", "ts_ns", r6("smooth").alias("smooth"), r6("zn_smooth").alias("zn_smooth"))


cte(
    "seg",
    """
SELECT src, run, min(ts_ns) AS s, max(ts_ns) AS e, least(1, max(sev)) AS severity, arg_max(ts_ns, (sev, -ts_ns)) AS peak
FROM (SELECT *, greatest(smooth, zn_smooth) AS sev, sum(CASE WHEN flag AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY ts_ns) AS run
  FROM (SELECT *, lag(flag) OVER (PARTITION BY src ORDER BY ts_ns) AS was FROM (SELECT *, smooth > 0.6 OR zn_smooth > 0.9 AS flag FROM sm))) WHERE flag GROUP BY ALL
""",
    ("sm",),
)
cte(
    "share",
    """
SELECT seg.src, run, metric_id, zc / CASE WHEN sum(zc) OVER (PARTITION BY seg.src, run) = 0 THEN 1 ELSE sum(zc) OVER (PARTITION BY seg.src, run) END AS share, direction, zc
FROM seg JOIN (SELECT cm.src, ts_ns, metric_id, abs(value - med) / (1.4826 * greatest(mad, 1e-8)) AS zc, CASE WHEN value > med THEN 'up' ELSE 'down' END AS direction FROM cm JOIN chfit USING (src, metric_id)) c
ON c.src = seg.src AND c.ts_ns = seg.peak
""",
    ("seg", "cm", "chfit"),
)


def _segments(spark, sf):
    m, model, fused = _fused(spark, sf)
    return detect.flag_and_segment(cut(_smooth(fused)), m, model, ordered.by_time(), 0.6, 0.9)


@query(
    "d21_flag_and_segment",
    """SELECT seg.src, s AS start_ts_ns, e AS end_ts_ns, round(severity, 6) AS severity, CASE WHEN severity >= 0.5 THEN 'anomaly' ELSE 'uncertain' END AS status, metric_id, round(share, 6) AS share, direction
FROM seg JOIN share ON share.src = seg.src AND share.run = seg.run WHERE zc > 0""",
    ("seg", "share"),
)
def d21(spark, sf):
    seg, parts = _segments(spark, sf)
    j = seg.join(parts, ["src", "run"])
    return j.select("src", "start_ts_ns", "end_ts_ns", r6("severity").alias("severity"), "status", "metric_id", r6("share").alias("share"), "direction")


_GRP = "CASE metric_id WHEN 'error' THEN 'lock' WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'io' ELSE 'mem' END"


@query(
    "d22_anomaly_type",
    f"""
WITH g AS (SELECT src, run, {_GRP} AS grp, sum(share) AS s FROM share WHERE zc > 0 GROUP BY ALL)
SELECT seg.src, seg.s AS start_ts_ns, arg_max(grp, (g.s, grp)) AS type, string_agg(grp || '=' || printf('%.4f', round(g.s, 4)), ';' ORDER BY round(g.s, 4) DESC, grp) AS indicators
FROM g JOIN seg ON seg.src = g.src AND seg.run = g.run GROUP BY ALL
""",
    ("seg", "share"),
)
def d22(spark, sf):
    seg, parts = _segments(spark, sf)
    m = F.col("metric_id")
    grp = F.when(m == "error", "lock").when(m == "click", "cpu").when(m == "view", "io").otherwise("mem")
    out = detect.anomaly_type(parts.withColumn("grp", grp), ["src", "run"], score="share")
    text = F.array_join(F.transform("indicators", lambda e: F.concat(e["type"], F.lit("="), F.format_string("%.4f", e["confidence"]))), ";")
    return out.join(seg.select("src", "run", "start_ts_ns"), ["src", "run"]).select("src", "start_ts_ns", "type", text.alias("indicators"))


@query(
    "d23_incident_id",
    """SELECT seq, 'inc-' || ts_ns || '-' || (ts_ns + k) || '-' || metric_id || '-' || substr(sha1(ts_ns || ':' || (ts_ns + k) || ':' || entity_id), 1, 8) AS incident_id FROM points""",
    ("points",),
)
def d23(spark, sf):
    p = points(spark, sf).withColumn("e", F.col("ts_ns") + F.col("k"))
    return p.select("seq", incident_id("ts_ns", "e", "entity_id", "metric_id").alias("incident_id"))


@query(
    "d24_apply_adjustments",
    """
WITH a AS (SELECT metric_id, pow(1.15, count(*) FILTER (k = 3)) AS loosen, pow(1.02, count(*) FILTER (k = 5)) AS tighten FROM points WHERE metric_id <> 'view' GROUP BY 1)
SELECT entity_id, thr.metric_id, round(threshold * coalesce(loosen, 1) / coalesce(tighten, 1), 4) AS threshold FROM thr LEFT JOIN a ON a.metric_id = thr.metric_id
""",
    ("thr", "points"),
)
def d24(spark, sf):
    adj = points(spark, sf).where("metric_id <> 'view'").groupBy("metric_id").agg(
        F.pow(F.lit(1.15), F.count_if(F.col("k") == 3)).alias("loosen"), F.pow(F.lit(1.02), F.count_if(F.col("k") == 5)).alias("tighten")
    )
    return st.apply_adjustments(fitted(spark, sf)[1], adj).select("entity_id", "metric_id", F.round("threshold", 4).alias("threshold"))


@query(
    "d25_suppress",
    """
WITH i AS (SELECT seq, 'i' || seq % 500 AS incident_id FROM points)
SELECT seq, incident_id FROM i WHERE incident_id NOT IN (SELECT 'i' || k * 3 FROM points WHERE quality <> 'observed')
""",
    ("points",),
)
def d25(spark, sf):
    p = points(spark, sf)
    inc = p.select("seq", F.concat(F.lit("i"), (F.col("seq") % 500).cast("string")).alias("incident_id"))
    rej = p.where("quality <> 'observed'").select(F.concat(F.lit("i"), (F.col("k") * 3).cast("string")).alias("incident_id"))
    return detect.suppress(inc, rej)


def _by_name(name):
    """A detector by its registered name, end to end."""

    def run(spark, sf):
        p = detectors.Params(window_ns=DAY, stride_ns=12 * HOUR, interval_ns=HOUR, low_freq=2, min_observed_frac=0.8, state_metrics=("signup",) if name == "edge_cascade" else ())
        return incident_rows(detectors.detect_points(points(spark, sf), name, p))

    return run


for _name in detectors.REGISTRY:
    query("d26_detector_registry" if _name == "edge_cascade" else f"d26_{_name}")(_by_name(_name))


@query(
    "d27_gate_statistics",
    f"WITH {_GATE_SQL} SELECT count(*) AS windows, count(*) FILTER (need_trend) AS trend_run, (SELECT count(*) FROM (SELECT DISTINCT w_start, entity_id FROM grid WHERE metric_id = 'signup')) AS state_seen FROM gate",
    ("evs",),
)
def d27(spark, sf):
    _, g = _gate(spark, sf)
    return detect.gate_statistics(g, grid(spark, sf).where("metric_id = 'signup'"))
