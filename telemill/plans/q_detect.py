"""Registered queries of the statistics and detector family, and the flagship."""

from pyspark.sql import functions as F

from telemill.functions.scores import incident_id, plain_z, robust_z, sigmoid
from telemill.operators import detect, ordered, stats as st, windows
from telemill.plans.q_quality import grid
from telemill.plans.registry import DAY, HOUR, cte, points, query, r6
from telemill.session import cut

cte(
    "st",
    """
SELECT entity_id, metric_id, median(value) FILTER (quality = 'observed') AS median, mad(value) FILTER (quality = 'observed') AS mad,
  avg(value) FILTER (quality = 'observed') AS mean, stddev_pop(value) FILTER (quality = 'observed') AS std,
  count(value) FILTER (quality = 'observed') AS count, min(value) FILTER (quality = 'observed') AS min, max(value) FILTER (quality = 'observed') AS max,
  count(*) FILTER (quality <> 'observed' OR value IS NULL) / count(*) AS non_observed_frac
FROM labelled WHERE split = 'train' GROUP BY 1, 2
""",
    ("labelled",),
)
cte(
    "thr",
    """
SELECT s.entity_id, s.metric_id, CASE WHEN s.mad <= 0 THEN 1.0 WHEN q IS NULL THEN 4.0 ELSE greatest(1.5, q * 1.5) END AS threshold
FROM st s LEFT JOIN (SELECT l.entity_id, l.metric_id, quantile_cont(abs((value - median) / (1.4826 * mad)), 0.99) AS q FROM labelled l JOIN st USING (entity_id, metric_id)
  WHERE split = 'val' AND quality = 'observed' AND value IS NOT NULL AND mad > 0 GROUP BY 1, 2) v ON v.entity_id = s.entity_id AND v.metric_id = s.metric_id
""",
    ("labelled", "st"),
)


def labelled(spark, sf):
    return windows.split_by_time(points(spark, sf), 0.6, 0.2)


def fitted(spark, sf, flat_value=1.0):
    lab = labelled(spark, sf)
    s = cut(st.fit_stats(lab.where("split = 'train'")))
    return s, cut(st.pot_thresholds(s, lab.where("split = 'val'"), flat_value=flat_value))


_STAT_COLS = ("median", "mad", "mean", "std", "min", "max", "non_observed_frac")
_STAT_SQL = "entity_id, metric_id, count, " + ", ".join(f"round({c}, 6) AS {c}" for c in _STAT_COLS)


@query("d1_fit_stats", f"SELECT {_STAT_SQL} FROM st", ("st",))
def d1(spark, sf):
    s = st.fit_stats(labelled(spark, sf).where("split = 'train'"))
    return s.select("entity_id", "metric_id", "count", *[r6(c).alias(c) for c in _STAT_COLS])


_Z = "CASE WHEN mad > 0 AND value IS NOT NULL THEN (value - median) / (1.4826 * mad) ELSE 0 END"


@query("d2_robust_z", f"SELECT seq, round({_Z}, 6) AS z FROM labelled JOIN st USING (entity_id, metric_id)", ("labelled", "st"))
def d2(spark, sf):
    lab = labelled(spark, sf)
    s = st.fit_stats(lab.where("split = 'train'")).select("entity_id", "metric_id", "median", "mad")
    return lab.join(s, ["entity_id", "metric_id"]).select("seq", r6(robust_z("value")).alias("z"))


@query(
    "d3_z_and_sigmoid",
    """SELECT seq, round(z, 6) AS z, round(1 / (1 + exp(-z)), 6) AS s FROM (SELECT seq, CASE WHEN std > 0 AND value IS NOT NULL THEN (value - mean) / std ELSE 0 END AS z
FROM labelled JOIN st USING (entity_id, metric_id))""",
    ("labelled", "st"),
)
def d3(spark, sf):
    lab = labelled(spark, sf)
    s = st.fit_stats(lab.where("split = 'train'")).select("entity_id", "metric_id", "mean", "std")
    z = lab.join(s, ["entity_id", "metric_id"]).select("seq", plain_z("value").alias("z"))
    return z.select("seq", r6("z").alias("z"), r6(sigmoid("z")).alias("s"))


@query("d4_stats_round_trip", f"SELECT {_STAT_SQL} FROM st", ("st",))
def d4(spark, sf):
    s = st.fit_stats(labelled(spark, sf).where("split = 'train'"))
    back = st.map_to_stats(st.stats_to_map(s))
    return back.select("entity_id", "metric_id", "count", *[r6(c).alias(c) for c in _STAT_COLS])


@query("d5_pot_thresholds", "SELECT entity_id, metric_id, round(threshold, 6) AS threshold FROM thr", ("thr",))
def d5(spark, sf):
    return fitted(spark, sf)[1].withColumn("threshold", r6("threshold"))


# recursion over each series: the definition of the EWMA, row by row
_EWMA = """
WITH RECURSIVE b AS (SELECT entity_id, metric_id, seq, {x} AS x, row_number() OVER (PARTITION BY entity_id, metric_id ORDER BY ts_ns, seq) AS i FROM {src}),
r AS (SELECT entity_id, metric_id, seq, i, x::DOUBLE AS y FROM b WHERE i = 1
  UNION ALL SELECT b.entity_id, b.metric_id, b.seq, b.i, {a} * b.x + (1 - {a}) * r.y FROM r JOIN b ON b.entity_id = r.entity_id AND b.metric_id = r.metric_id AND b.i = r.i + 1)
"""


def _recursive(x, src, tail, a=0.2):
    return _EWMA.format(x=x, src=src, a=a).strip() + " " + tail


@query("d6_ewma", _recursive("coalesce(value, 0)", "points", "SELECT seq, round(y, 6) AS y FROM r"), ("points",))
def d6(spark, sf):
    p = points(spark, sf).withColumn("x", F.coalesce("value", F.lit(0.0)))
    e = ordered.ewma(p, ["entity_id", "metric_id"], ["ts_ns", "seq"], "x", 0.2, ordered.by_time(), "y")
    return e.select("seq", r6("y").alias("y"))


# cells of the whole range scored per window
_SC_SQL = """
o AS (SELECT g.w_start, g.w_end, g.entity_id, g.metric_id, cell_ts, CASE WHEN s.mad > 0 THEN (value - s.median) / (1.4826 * s.mad) ELSE 0 END AS z,
   row_number() OVER w AS i, count(*) OVER (PARTITION BY g.w_start, g.entity_id, g.metric_id) AS n
   FROM grid g JOIN st s ON s.entity_id = g.entity_id AND s.metric_id = g.metric_id WHERE observed
   WINDOW w AS (PARTITION BY g.w_start, g.entity_id, g.metric_id ORDER BY cell_ts)),
ew AS (SELECT w_start, w_end, entity_id, metric_id, sum(z * CASE WHEN i = 1 THEN pow(0.8, n - 1) ELSE 0.2 * pow(0.8, n - i) END) AS e FROM o GROUP BY ALL),
miss AS (SELECT w_start, entity_id, 1 - count(*) FILTER (observed) / count(*) AS missing FROM grid GROUP BY ALL),
cell AS (SELECT w_start, entity_id, cell_ts, max(observed::INT) AS o FROM grid GROUP BY ALL),
gp AS (SELECT w_start, entity_id, coalesce(f < m AND l > m, false) AS gap FROM (SELECT w_start, entity_id, min(CASE WHEN o = 0 THEN cell_ts END) AS m,
   min(CASE WHEN o = 1 THEN cell_ts END) AS f, max(CASE WHEN o = 1 THEN cell_ts END) AS l FROM cell GROUP BY ALL)),
qual AS (SELECT * FROM miss JOIN gp USING (w_start, entity_id)),
sc AS (SELECT ew.w_start, ew.w_end, ew.entity_id, ew.metric_id, least(1, abs(e) / threshold) AS score, CASE WHEN e > 0 THEN 'up' ELSE 'down' END AS direction
   FROM ew JOIN (SELECT entity_id, metric_id, threshold * 0.3 AS threshold FROM thr) t ON t.entity_id = ew.entity_id AND t.metric_id = ew.metric_id JOIN qual q ON q.w_start = ew.w_start AND q.entity_id = ew.entity_id
   WHERE abs(e) > threshold AND NOT (missing > 0.9 AND NOT gap)
   UNION ALL SELECT w_start, w_start + 86400000000000, entity_id, '_quality', missing, 'missing' FROM qual WHERE missing > 0.9 AND gap)
"""


def streaming_scores(spark, sf):
    s, t = fitted(spark, sf)
    t = t.withColumn("threshold", F.col("threshold") * 0.3)
    return detect.score_windows_streaming(cut(grid(spark, sf)), s, t, min_observed_frac=0.9)


@query(
    "d7_score_windows_streaming",
    f"WITH {_SC_SQL} SELECT w_start, entity_id, metric_id, round(score, 6) AS score, direction FROM sc",
    ("grid", "st", "thr"),
)
def d7(spark, sf):
    return streaming_scores(spark, sf).select("w_start", "entity_id", "metric_id", r6("score").alias("score"), "direction")


@query(
    "d8_observe_points",
    _recursive(
        "CASE WHEN mad > 0 THEN (value - median) / (1.4826 * mad) ELSE 0 END",
        "(SELECT * FROM points JOIN st USING (entity_id, metric_id)) WHERE quality = 'observed' AND value IS NOT NULL",
        """SELECT seq, round(y, 6) AS ewma, (abs(y) > threshold * 0.5)::INT AS anomaly, CASE WHEN abs(y) > threshold * 0.5 THEN CASE WHEN y > 0 THEN 'up' ELSE 'down' END END AS direction
FROM r JOIN thr ON thr.entity_id = r.entity_id AND thr.metric_id = r.metric_id""",
    ),
    ("points", "st", "thr"),
)
def d8(spark, sf):
    s, t = fitted(spark, sf)
    t = t.withColumn("threshold", F.col("threshold") * 0.5)
    out = detect.observe_points(points(spark, sf), s, t, ["ts_ns", "seq"], ordered.by_time())
    return out.select("seq", r6("ewma").alias("ewma"), F.col("anomaly").cast("int").alias("anomaly"), "direction")


_MERGE_SQL = """
w AS (SELECT DISTINCT entity_id, w_start, w_end FROM sc),
wi AS (SELECT *, sum(CASE WHEN p IS NULL OR w_start > p THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY w_start) AS island
  FROM (SELECT *, max(w_end) OVER (PARTITION BY entity_id ORDER BY w_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w)),
pm AS (SELECT sc.entity_id, island, metric_id, max(score) AS score, coalesce(arg_max(direction, sc.w_start) FILTER (direction <> 'down'), 'down') AS direction, min(sc.w_start) AS fw
  FROM sc JOIN wi ON wi.entity_id = sc.entity_id AND wi.w_start = sc.w_start GROUP BY ALL),
ext AS (SELECT entity_id, island, min(w_start) AS s, max(w_end) AS e FROM wi GROUP BY ALL),
inc AS (SELECT pm.entity_id, s AS start_ts_ns, e AS end_ts_ns, least(1, max(score)) AS severity,
  arg_min(metric_id, (-score, fw, (metric_id = '_quality')::INT, metric_id)) AS hint,
  string_agg(metric_id || '=' || printf('%.4f', score) || ':' || direction, ';' ORDER BY metric_id) AS metrics
  FROM pm JOIN ext USING (entity_id, island) GROUP BY pm.entity_id, island, s, e)
"""
_INC_OUT = """SELECT entity_id, 'inc-' || start_ts_ns || '-' || end_ts_ns || '-' || hint || '-' || substr(sha1(start_ts_ns || ':' || end_ts_ns || ':' || entity_id), 1, 8) AS incident_id,
  start_ts_ns, end_ts_ns, round(severity, 6) AS severity, metrics FROM inc"""


def incident_rows(inc):
    text = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("metric_scores")),
            lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]), F.lit(":"), F.try_element_at("directions", e["key"])),
        ),
        ";",
    )
    return inc.select("entity_id", "incident_id", "start_ts_ns", "end_ts_ns", r6("severity").alias("severity"), text.alias("metrics"))


@query("d9_merge_incidents", f"WITH {_SC_SQL}, {_MERGE_SQL} {_INC_OUT}", ("grid", "st", "thr"))
def d9(spark, sf):
    return incident_rows(detect.merge_incidents(streaming_scores(spark, sf)))


cte(
    "evs",
    """
SELECT g.w_start, g.w_end, g.entity_id, g.metric_id, least(1, z / threshold) AS score, CASE WHEN m > median THEN 'up' ELSE 'down' END AS direction
FROM (SELECT g.w_start, g.w_end, g.entity_id, g.metric_id, max(abs(CASE WHEN s.mad > 0 THEN (value - s.median) / (1.4826 * s.mad) ELSE 0 END)) AS z, avg(value) AS m, any_value(s.median) AS median
  FROM grid g JOIN st s ON s.entity_id = g.entity_id AND s.metric_id = g.metric_id WHERE observed GROUP BY ALL) g
JOIN thr t ON t.entity_id = g.entity_id AND t.metric_id = g.metric_id WHERE z > threshold
UNION ALL SELECT DISTINCT w_start, w_end, entity_id, '_quality', 1.0, 'missing' FROM
 (SELECT g.w_start, g.w_end, g.entity_id, g.metric_id FROM grid g JOIN st s ON s.entity_id = g.entity_id AND s.metric_id = g.metric_id GROUP BY ALL HAVING count(*) FILTER (observed) = 0)
""",
    ("grid", "st", "thr"),
)


@query("d11_event_scores", "SELECT w_start, entity_id, metric_id, round(score, 6) AS score, direction FROM evs", ("evs",))
def d11(spark, sf):
    s, t = fitted(spark, sf)
    return detect.event_scores(grid(spark, sf), s, t).select("w_start", "entity_id", "metric_id", r6("score").alias("score"), "direction")


@query(
    "flagship_incidents",
    f"WITH sc AS (SELECT * FROM evs), {_MERGE_SQL} {_INC_OUT}",
    ("evs",),
)
def flagship(spark, sf):
    """Points -> windows -> train statistics -> thresholds -> window scores -> merged incidents."""
    s, t = fitted(spark, sf)
    return incident_rows(detect.merge_incidents(detect.event_scores(grid(spark, sf), s, t)))


_RING_SQL = """
c AS (SELECT g.*, s.median, s.mad, s.entity_id IS NOT NULL AS fitted FROM grid g LEFT JOIN st s ON s.entity_id = g.entity_id AND s.metric_id = g.metric_id),
oc AS (SELECT *, avg(value) OVER q AS mu, stddev_pop(value) OVER q AS sd, count(*) OVER q AS n, value - lag(value) OVER o AS d FROM c WHERE observed
  WINDOW q AS (PARTITION BY w_start, entity_id, metric_id), o AS (PARTITION BY w_start, entity_id, metric_id ORDER BY cell_ts)),
ocz AS (SELECT *, CASE WHEN NOT fitted THEN (value - mu) / (sd + 1e-9) WHEN mad > 0 THEN (value - median) / (1.4826 * mad) ELSE 0 END AS z,
  var_pop(d) OVER (PARTITION BY w_start, entity_id, metric_id ORDER BY cell_ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS be,
  count(d) OVER (PARTITION BY w_start, entity_id, metric_id ORDER BY cell_ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bn FROM oc),
md AS (SELECT w_start, entity_id, metric_id, median(d) AS md, mad(d) + 1e-9 AS ad FROM oc GROUP BY ALL),
pm AS (SELECT o.w_start, o.entity_id, o.metric_id, max(abs(z)) AS mz, sum(abs(z)) AS sz, any_value(n) AS n,
   CASE WHEN any_value(n) >= 3 THEN max(abs(d - md) / ad) END AS cp, CASE WHEN any_value(n) >= 5 THEN max(be) FILTER (bn = 3) END AS be,
   bool_or(z > 2) AS pos, bool_or(z < -2) AS neg FROM ocz o JOIN md USING (w_start, entity_id, metric_id) GROUP BY ALL),
tot AS (SELECT w_start, w_end, entity_id, count(*) AS cells, count(DISTINCT metric_id) AS n_metrics FROM grid GROUP BY ALL),
ring AS (SELECT t.w_start, t.w_end, t.entity_id, coalesce(max(mz), 0) AS max_residual_z, coalesce(sum(sz) / sum(n), 0) AS mean_residual_z, coalesce(max(cp), 0) AS max_change_point,
  coalesce(max(be), 0) AS max_band_energy, 1 - coalesce(sum(n), 0) / any_value(cells) AS missing_frac, any_value(n_metrics) AS n_metrics, coalesce(CAST(sum(n) AS BIGINT), 0) AS n_observed,
  coalesce(bool_or(pos), false) AS pos, coalesce(bool_or(neg), false) AS neg FROM tot t LEFT JOIN pm p ON p.w_start = t.w_start AND p.entity_id = t.entity_id GROUP BY ALL),
ring2 AS (SELECT *, 0.7 * (1 - missing_frac) + 0.3 * CASE WHEN max_residual_z > 0.5 THEN least(1, max_residual_z / 8) ELSE 0.3 END AS confidence,
  CASE WHEN pos AND neg THEN 'mixed' WHEN pos THEN 'up' WHEN neg THEN 'down' ELSE 'flat' END AS direction FROM ring)
"""
_RING_COLS = ("max_residual_z", "mean_residual_z", "max_band_energy", "missing_frac", "confidence")


@query(
    "d10_event_ring",
    f"WITH {_RING_SQL} SELECT w_start, entity_id, n_metrics, n_observed, direction, round(max_change_point, 3) AS max_change_point, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _RING_COLS) + " FROM ring2",
    ("grid", "st"),
)
def d10(spark, sf):
    ring = detect.event_ring(grid(spark, sf), fitted(spark, sf)[0])
    return ring.select("w_start", "entity_id", "n_metrics", "n_observed", "direction", F.round("max_change_point", 3).alias("max_change_point"), *[r6(c).alias(c) for c in _RING_COLS])
