"""Registered queries of score post-processing and evaluation: one score series per entity."""

from pyspark.sql import functions as F

from telemill.operators import detect, evaluate, ordered, score_ops
from telemill.plans.q_cascade import G, channel_points, train_and_all
from telemill.plans.q_detect import labelled
from telemill.plans.registry import DAY, cte, query, r6
from telemill.session import cut

cte(
    "ser",
    """
SELECT entity_id, seq, ts_ns, split, coalesce(value, 0) / 150.0::DOUBLE AS score, (metric_id = 'error')::INT AS label, (coalesce(value, 0) > 80)::INT AS pred, (k - 50) / 25.0::DOUBLE AS logit, k,
  row_number() OVER (PARTITION BY entity_id ORDER BY ts_ns, seq) - 1 AS idx FROM labelled
""",
    ("labelled",),
)
K, O = ["entity_id"], ["ts_ns", "seq"]
CH = ordered.by_time
VCH = lambda c="score": F.floor(F.col(c) * 1000).cast("long")


def series(spark, sf):
    v = F.coalesce("value", F.lit(0.0))
    return labelled(spark, sf).select(
        "entity_id", "seq", "ts_ns", "split", (v / F.lit(150.0)).alias("score"), (F.col("metric_id") == "error").cast("int").alias("label"),
        (v > 80).cast("int").alias("pred"), ((F.col("k") - 50) / F.lit(25.0)).alias("logit"), "k",
    )


def indexed(spark, sf):
    return ordered.with_index(series(spark, sf), K, O, CH())


def train(df):
    return df.where("split = 'train'")


@query(
    "x1_cusum",
    """
WITH RECURSIVE lim AS (SELECT entity_id, 0.5 * stddev_pop(score) + 0.4 AS k, 4 * stddev_pop(score) AS h FROM ser WHERE split = 'train' GROUP BY 1),
b AS (SELECT s.*, lim.k AS lk, lim.h AS lh FROM ser s JOIN lim ON lim.entity_id = s.entity_id),
r AS (SELECT entity_id, idx, seq, greatest(0, score - lk) AS stat, lk, lh FROM b WHERE idx = 0
 UNION ALL SELECT b.entity_id, b.idx, b.seq, greatest(0, CASE WHEN r.stat > r.lh THEN 0 ELSE r.stat END + b.score - b.lk), b.lk, b.lh FROM r JOIN b ON b.entity_id = r.entity_id AND b.idx = r.idx + 1)
SELECT seq, round(stat, 6) AS stat, (stat > lh)::INT AS alarm FROM r
""",
    ("ser",),
)
def x1(spark, sf):
    s = series(spark, sf)
    lim = score_ops.cusum_limits(train(s), K, "score").withColumn("k", F.col("k") + 0.4)
    j = s.drop("k").join(lim, K)
    return score_ops.cusum(j, K, O, "score", CH("ts_ns", 4 * DAY)).select("seq", r6("stat").alias("stat"), "alarm")


@query("x2_temperature", "SELECT seq, round(1 / (1 + exp(-logit / 2)), 6) AS score FROM ser", ("ser",))
def x2(spark, sf):
    return series(spark, sf).select("seq", r6(score_ops.temperature("logit", 2.0)).alias("score"))


@query("x3_quantile_threshold", "SELECT entity_id, round(quantile_cont(score, 0.995), 6) AS threshold FROM ser WHERE split = 'train' GROUP BY 1", ("ser",))
def x3(spark, sf):
    return score_ops.quantile_threshold(train(series(spark, sf)), K, "score", 0.995).withColumn("threshold", r6("threshold"))


@query("x4_pot_gpd")
def x4(spark, sf):
    out = score_ops.pot_gpd(train(series(spark, sf)), K, O, "score", CH())
    return out.select("entity_id", r6("threshold").alias("threshold"), F.col("failed").cast("int").alias("failed"))


@query(
    "x5_conformal",
    """
WITH w AS (SELECT entity_id, score, idx, exp(-(max(idx) OVER (PARTITION BY entity_id) - idx) / 200.0) AS w FROM ser WHERE split = 'train'),
c AS (SELECT *, sum(w) OVER (PARTITION BY entity_id ORDER BY score, idx ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY entity_id) AS cdf FROM w)
SELECT entity_id, round(coalesce(min(score) FILTER (cdf >= 0.95), max(score)), 6) AS threshold FROM c GROUP BY 1
""",
    ("ser",),
)
def x5(spark, sf):
    t = cut(train(indexed(spark, sf)))
    return score_ops.conformal_threshold(t, K, "idx", "score", 200, 0.05, VCH()).withColumn("threshold", r6("threshold"))


@query("x6_minmax01", "SELECT seq, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) AS score FROM ser WINDOW w AS (PARTITION BY entity_id)", ("ser",))
def x6(spark, sf):
    return score_ops.minmax01(series(spark, sf), K, ["score"]).select("seq", r6("score").alias("score"))


@query(
    "x7_fuse_channels",
    "SELECT src, ts_ns, round(max(value) / 500, 6) AS mx, round(avg(value) / 500, 6) AS mean FROM cm GROUP BY ALL",
    ("cm",),
)
def x7(spark, sf):
    m = detect.channel_matrix(channel_points(spark, sf), G, CH()).withColumn("score", F.col("value") / 500)
    out = score_ops.fuse_channels(m, ["src", "ts_ns"], "score", {"mx": "max", "mean": "mean"})
    return out.select("src", "ts_ns", r6("mx").alias("mx"), r6("mean").alias("mean"))


@query(
    "x8_multiscale",
    """SELECT seq, round(0.5 * ((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) + (logit - min(logit) OVER w) / (max(logit) OVER w - min(logit) OVER w)), 6) AS s
FROM ser WINDOW w AS (PARTITION BY entity_id)""",
    ("ser",),
)
def x8(spark, sf):
    return score_ops.multiscale(series(spark, sf), K, "score", "logit", "s").select("seq", r6("s").alias("s"))


@query(
    "x9_overlap_average",
    "SELECT a.seq, round(CASE WHEN b.idx IS NOT NULL THEN 0.5 * (a.score + b.logit) ELSE a.score END, 6) AS score FROM ser a LEFT JOIN ser b ON b.entity_id = a.entity_id AND b.idx = a.idx - 100",
    ("ser",),
)
def x9(spark, sf):
    i = cut(indexed(spark, sf))
    shifted = i.select("entity_id", "idx", F.col("logit").alias("score"))
    return score_ops.overlap_average(i, shifted, K, 100).select("seq", r6("score").alias("score"))


@query("x10_robust_fusion", "SELECT src, ts_ns, round(fused, 6) AS fused FROM fz", ("fz",))
def x10(spark, sf):
    pts = channel_points(spark, sf)
    raw = pts.groupBy("src", "ts_ns").agg((F.max(F.col("k") % 101) / F.lit(100.0)).alias("raw"))
    out = score_ops.robust_fusion(*train_and_all(pts, CH()), raw, 0.3)
    return out.select("src", "ts_ns", r6("fused").alias("fused"))


@query(
    "x11_cascade_gate",
    """
WITH tr AS (SELECT entity_id, idx // 32 AS b, max(score) AS wm FROM ser WHERE split = 'train' GROUP BY ALL),
g AS (SELECT entity_id, quantile_cont(wm, 0.2) AS gate FROM tr GROUP BY 1),
te AS (SELECT s.entity_id, idx // 32 AS b, max(score) > any_value(gate) AS pass FROM ser s JOIN g ON g.entity_id = s.entity_id WHERE split <> 'train' GROUP BY ALL)
SELECT s.seq, round(CASE WHEN pass THEN logit ELSE 0 END, 6) AS logit, round(r.rate, 6) AS pass_rate FROM ser s JOIN te ON te.entity_id = s.entity_id AND te.b = idx // 32
JOIN (SELECT entity_id, avg(pass::INT) AS rate FROM te GROUP BY 1) r ON r.entity_id = s.entity_id WHERE split <> 'train'
""",
    ("ser",),
)
def x11(spark, sf):
    i = cut(indexed(spark, sf))
    test = i.where("split <> 'train'")
    gated, rate = score_ops.cascade_gate(train(i), test, test.select("entity_id", "seq", "idx", "logit"), K, 32, 0.2, z="score", score="logit")
    return gated.join(rate, K).select("seq", r6("logit").alias("logit"), r6("pass_rate").alias("pass_rate"))


@query(
    "x12_combos",
    """
WITH RECURSIVE r AS (SELECT entity_id, idx, seq, 1 / (1 + exp(-logit / 2)) AS y FROM ser WHERE idx = 0
 UNION ALL SELECT s.entity_id, s.idx, s.seq, 0.2 / (1 + exp(-s.logit / 2)) + 0.8 * r.y FROM r JOIN ser s ON s.entity_id = r.entity_id AND s.idx = r.idx + 1)
SELECT seq, round(y, 6) AS score FROM r
""",
    ("ser",),
)
def x12(spark, sf):
    return score_ops.combo(series(spark, sf), ["temp-20", "ewma-a02"], K, O, "score", CH()).select("seq", r6("score").alias("score"))


@query(
    "x12_combo_median_quantile",
    """
WITH m AS (SELECT a.entity_id, a.seq, median(b.score) AS s FROM (SELECT *, unnest([idx - 1, idx, idx + 1]) AS j, count(*) OVER (PARTITION BY entity_id) AS n FROM ser) a
 JOIN ser b ON b.entity_id = a.entity_id AND b.idx = CASE WHEN j < 0 THEN 0 WHEN j >= n THEN n - 1 ELSE j END GROUP BY ALL),
t AS (SELECT a.entity_id, median(b.score) AS s FROM (SELECT *, unnest([idx - 1, idx, idx + 1]) AS j, count(*) OVER (PARTITION BY entity_id) AS n FROM ser WHERE split = 'train') a
 JOIN ser b ON b.entity_id = a.entity_id AND b.idx = CASE WHEN j < 0 THEN 0 WHEN j >= n THEN n - 1 ELSE j END GROUP BY a.entity_id, a.idx)
SELECT m.seq, round(s, 6) AS score, round(q, 6) AS threshold FROM m JOIN (SELECT entity_id, quantile_cont(s, 0.95) AS q FROM t GROUP BY 1) q ON q.entity_id = m.entity_id
""",
    ("ser",),
)
def x12b(spark, sf):
    s = series(spark, sf)
    out = score_ops.combo_quantile(train(s), s, "median-k3", 0.95, K, O, "score", CH())
    return out.select("seq", r6("score").alias("score"), r6("threshold").alias("threshold"))


_PRF = "round(CASE WHEN {np} > 0 THEN tp / {np} ELSE 0 END, 6) AS {x}_precision, round(CASE WHEN {nt} > 0 THEN tp / {nt} ELSE 0 END, 6) AS {x}_recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / ({np} + {nt}) ELSE 0 END, 6) AS {x}_f1"
_P_COLS = ("point_precision", "point_recall", "point_f1")
_S_COLS = ("seg_precision", "seg_recall", "seg_f1")
cte("pf", "SELECT entity_id, count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1) AS np, count(*) FILTER (label = 1) AS nt FROM ser GROUP BY 1", ("ser",))
cte(
    "islands",
    """
SELECT *, sum((pred = 1 AND coalesce(pp, 0) = 0)::INT) OVER w AS pr, sum((label = 1 AND coalesce(pl, 0) = 0)::INT) OVER w AS tr
FROM (SELECT *, lag(pred) OVER w AS pp, lag(label) OVER w AS pl FROM ser WINDOW w AS (PARTITION BY entity_id ORDER BY ts_ns, seq)) WINDOW w AS (PARTITION BY entity_id ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING)
""",
    ("ser",),
)
cte(
    "sf1",
    """
SELECT t.entity_id, nt, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM (SELECT entity_id, count(DISTINCT tr) FILTER (label = 1) AS nt FROM islands GROUP BY 1) t
LEFT JOIN (SELECT p.entity_id, count(*) AS np, count(*) FILTER (EXISTS (SELECT 1 FROM (SELECT entity_id, tr, min(idx) AS c, max(idx) AS d FROM islands WHERE label = 1 GROUP BY ALL) t WHERE t.entity_id = p.entity_id AND t.c <= p.b AND t.d >= p.a)) AS tp
  FROM (SELECT entity_id, pr, min(idx) AS a, max(idx) AS b FROM islands WHERE pred = 1 GROUP BY ALL) p GROUP BY 1) p ON p.entity_id = t.entity_id
""",
    ("islands",),
)


@query("e1_point_f1", f"SELECT entity_id, tp, {_PRF.format(np='np', nt='nt', x='point')} FROM pf", ("pf",))
def e1(spark, sf):
    return evaluate.point_f1(series(spark, sf), K).select("entity_id", "tp", *[r6(c).alias(c) for c in _P_COLS])


@query("e2_segment_f1", f"SELECT entity_id, tp, np AS pred_segments, nt AS true_segments, {_PRF.format(np='np', nt='nt', x='seg')} FROM sf1", ("sf1",))
def e2(spark, sf):
    return evaluate.segment_f1(series(spark, sf), K, O, CH()).select("entity_id", "tp", "pred_segments", "true_segments", *[r6(c).alias(c) for c in _S_COLS])


@query(
    "e3_vus_pr",
    """
WITH th AS (SELECT entity_id, unnest(quantile_cont(score, [1 - i / 99.0::DOUBLE for i in range(100)])) AS t, unnest(range(100)) AS i FROM ser GROUP BY entity_id),
c AS (SELECT th.entity_id, i, count(*) FILTER (score >= t) AS k, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (label = 1) AS p FROM th JOIN ser ON ser.entity_id = th.entity_id GROUP BY ALL),
pr AS (SELECT entity_id, i, CASE WHEN k > 0 THEN tp / k ELSE 0 END AS prec, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS rec FROM c)
SELECT entity_id, round(sum(a), 5) AS vus_pr FROM (SELECT entity_id, 0.5 * (prec + lag(prec) OVER w) * abs(rec - lag(rec) OVER w) AS a FROM pr WINDOW w AS (PARTITION BY entity_id ORDER BY i)) GROUP BY 1
""".replace("[1 - i / 99.0::DOUBLE for i in range(100)]", "[" + ", ".join(repr(max(0.0, 1 - i * (1 / 99))) for i in range(100)) + "]"),
    ("ser",),
)
def e3(spark, sf):
    return evaluate.vus_pr(series(spark, sf), K, "score", VCH()).select("entity_id", F.round("vus_pr", 5).alias("vus_pr"))


cte(
    "rk",
    "SELECT user_id AS case_id, metric_id AS service, k, row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, metric_id) AS rank FROM (SELECT user_id, metric_id, value, k % 1 AS k FROM points) GROUP BY user_id, metric_id, k",
    ("points",),
)


@query(
    "e4_accuracy_at_k",
    """
WITH t AS (SELECT user_id AS case_id, arg_min(metric_id, (k, seq)) AS service FROM points GROUP BY 1), j AS (SELECT t.case_id, rank FROM t LEFT JOIN rk ON rk.case_id = t.case_id AND rk.service = t.service)
SELECT count(*) AS cases, round(avg(coalesce(rank <= 1, false)::INT), 6) AS ac_1, round(avg(coalesce(rank <= 3, false)::INT), 6) AS ac_3, round(avg(coalesce(rank <= 5, false)::INT), 6) AS ac_5,
 round((avg(coalesce(rank <= 1, false)::INT) + avg(coalesce(rank <= 2, false)::INT) + avg(coalesce(rank <= 3, false)::INT) + avg(coalesce(rank <= 4, false)::INT) + avg(coalesce(rank <= 5, false)::INT)) / 5, 6) AS avg_5 FROM j
""",
    ("rk",),
)
def e4(spark, sf):
    from pyspark.sql import Window

    from telemill.plans.registry import points

    p = points(spark, sf).withColumnRenamed("user_id", "case_id")
    best = p.groupBy("case_id", F.col("metric_id").alias("service")).agg(F.max("value").alias("v"))
    # a null maximum ranks last, as in the check
    w = Window.partitionBy("case_id").orderBy(F.desc_nulls_last("v"), "service")
    ranking = best.withColumn("rank", F.row_number().over(w))
    truth = p.groupBy("case_id").agg(F.min_by("metric_id", F.struct("k", "seq")).alias("service"))
    out = evaluate.accuracy_at_k(ranking, truth)
    return out.select("cases", *[r6(c).alias(c) for c in ("ac_1", "ac_3", "ac_5", "avg_5")])


@query(
    "e5_summary_table",
    f"""
WITH m AS (SELECT pf.entity_id, {_PRF.format(np='pf.np', nt='pf.nt', x='point').replace('tp', 'pf.tp').replace('round(CASE', '(CASE').replace(', 6) AS', ') AS')}, {_PRF.format(np='sf1.np', nt='sf1.nt', x='seg').replace('tp', 'sf1.tp').replace('round(CASE', '(CASE').replace(', 6) AS', ') AS')} FROM pf JOIN sf1 ON sf1.entity_id = pf.entity_id)
SELECT entity_id, round(point_f1, 5) AS point_f1, round(seg_f1, 5) AS seg_f1 FROM m UNION ALL SELECT 'mean', round(avg(point_f1), 5), round(avg(seg_f1), 5) FROM m
""",
    ("pf", "sf1"),
)
def e5(spark, sf):
    s = series(spark, sf)
    m = evaluate.point_f1(s, K).join(evaluate.segment_f1(s, K, O, CH()), K)
    out = evaluate.summary_table(cut(m.select("entity_id", "point_f1", "seg_f1")), "entity_id", ["point_f1", "seg_f1"])
    return out.select("entity_id", F.round("point_f1", 5).alias("point_f1"), F.round("seg_f1", 5).alias("seg_f1"))


@query(
    "e6_alarms_and_delay",
    """
WITH f AS (SELECT entity_id, count(*) FILTER (NOT hit) AS false_alarms FROM (SELECT entity_id, pr, bool_or(label = 1) AS hit FROM islands WHERE pred = 1 GROUP BY ALL) GROUP BY 1),
d AS (SELECT entity_id, count(*) AS true_segments, count(delay) AS detected, avg(delay) AS mean_delay FROM (SELECT entity_id, tr, min(ts_ns) FILTER (pred = 1) - min(ts_ns) AS delay FROM islands WHERE label = 1 GROUP BY ALL) GROUP BY 1),
h AS (SELECT entity_id, (max(ts_ns) - min(ts_ns)) / 3600e9 AS hours FROM ser GROUP BY 1)
SELECT h.entity_id, coalesce(false_alarms, 0) AS false_alarms, round(coalesce(false_alarms, 0) / hours, 6) AS false_alarms_per_hour, true_segments, detected, round(mean_delay / 1e9, 3) AS mean_delay_s FROM h LEFT JOIN f ON f.entity_id = h.entity_id JOIN d ON d.entity_id = h.entity_id
""",
    ("ser", "islands"),
)
def e6(spark, sf):
    out = evaluate.alarms_and_delay(series(spark, sf), K, O, CH())
    return out.select("entity_id", "false_alarms", r6("false_alarms_per_hour").alias("false_alarms_per_hour"), "true_segments", "detected", F.round(F.col("mean_delay_ns") / 1e9, 3).alias("mean_delay_s"))
