"""Registered queries of feedback and review, on incidents and reports derived from large values."""

from pyspark.sql import functions as F

from telemill.operators import feedback as fb
from telemill.operators import ordered
from telemill.plans.registry import DAY, cte, points, query, r6

LABELS = ("true_positive", "false_positive", "wrong_direction", "wrong_root_cause", "confirmed", "rejected")
cte("finc", "SELECT 'i' || seq AS incident_id, '0.1.0' AS model_version, metric_id AS m1, CASE WHEN k % 2 = 0 THEN 'zz' END AS m2, k, seq, value FROM points WHERE value > 80", ("points",))
_LBL = "CASE k % 6 " + " ".join(f"WHEN {i} THEN '{l}'" for i, l in enumerate(LABELS)) + " END"
cte(
    "fbk",
    f"""SELECT 'f' || seq AS feedback_id, 'i' || (seq - seq % 4) AS incident_id, {_LBL} AS label, CASE k % 4 WHEN 0 THEN 'zz' WHEN 1 THEN 'click' ELSE metric_id END AS target_id, ts_ns AS created_at_ns,
 CASE k % 9 WHEN 0 THEN 'old' WHEN 1 THEN '' ELSE '0.1.0' END AS model_version, seq FROM points""",
    ("points",),
)
cte(
    "chk",
    """SELECT f.*, CASE WHEN i.incident_id IS NULL THEN 'unknown_incident' WHEN f.model_version = 'old' THEN 'version_mismatch' WHEN label <> 'wrong_root_cause' AND NOT (target_id = m1 OR coalesce(target_id = m2, false)) THEN 'unknown_metric' END AS reason
FROM fbk f LEFT JOIN finc i ON i.incident_id = f.incident_id""",
    ("fbk", "finc"),
)
cte("acc", "SELECT * FROM chk WHERE reason IS NULL", ("chk",))


def incidents(spark, sf):
    k, m = F.col("k"), F.col("metric_id")
    scores = F.when(k % 2 == 0, F.create_map(m, F.lit(0.5), F.lit("zz"), F.lit(0.4))).otherwise(F.create_map(m, F.lit(0.5)))
    return points(spark, sf).where("value > 80").select(
        F.concat(F.lit("i"), F.col("seq").cast("string")).alias("incident_id"), F.lit("0.1.0").alias("model_version"), scores.alias("metric_scores"),
        F.when(k % 3 == 0, "anomaly").otherwise("uncertain").alias("status"), (F.col("value") / 500).alias("severity"), "k", "seq",
    )


def feedback_rows(spark, sf):
    k = F.col("k")
    label = F.lit(None).cast("string")
    for i, l in enumerate(LABELS):
        label = F.when(k % 6 == i, l).otherwise(label)
    return points(spark, sf).select(
        F.concat(F.lit("f"), F.col("seq").cast("string")).alias("feedback_id"), F.concat(F.lit("i"), (F.col("seq") - F.col("seq") % 4).cast("string")).alias("incident_id"),
        label.alias("label"), F.when(k % 4 == 0, "zz").when(k % 4 == 1, "click").otherwise(F.col("metric_id")).alias("target_id"), F.col("ts_ns").alias("created_at_ns"),
        F.when(k % 9 == 0, "old").when(k % 9 == 1, "").otherwise("0.1.0").alias("model_version"),
    )


def checked(spark, sf):
    return fb.validate_feedback(feedback_rows(spark, sf), incidents(spark, sf))


def accepted(spark, sf):
    return checked(spark, sf).where("reason IS NULL").drop("reason")


@query("f1_validate_feedback", "SELECT feedback_id, reason FROM chk", ("chk",))
def f1(spark, sf):
    return checked(spark, sf).select("feedback_id", "reason")


@query(
    "f2_calibrate",
    """SELECT 'metric' AS part, target_id AS id, round(ln(pow(1.15, count(*) FILTER (label = 'false_positive'))), 6) AS loosen_ln, round(ln(pow(1.02, count(*) FILTER (label = 'true_positive'))), 6) AS tighten_ln, NULL AS reason FROM acc WHERE label IN ('false_positive', 'true_positive') GROUP BY target_id
UNION ALL SELECT 'suppressed', incident_id, NULL, NULL, arg_max(label, (created_at_ns, feedback_id)) FROM acc WHERE label IN ('false_positive', 'rejected') GROUP BY incident_id""",
    ("acc",),
)
def f2(spark, sf):
    a = accepted(spark, sf)
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    m = fb.adjustments(a).select(F.lit("metric").alias("part"), F.col("metric_id").alias("id"), r6(F.ln("loosen")).alias("loosen_ln"), r6(F.ln("tighten")).alias("tighten_ln"), null_s.alias("reason"))
    s = fb.suppressed(a).select(F.lit("suppressed").alias("part"), F.col("incident_id").alias("id"), null_d.alias("loosen_ln"), null_d.alias("tighten_ln"), "reason")
    return m.unionByName(s)


@query(
    "f3_version_chain",
    "SELECT feedback_id, '0.1.' || n AS model_version, '0.1.' || (n - 1) AS parent, n AS n_parents FROM (SELECT feedback_id, row_number() OVER (ORDER BY created_at_ns, feedback_id) AS n FROM acc)",
    ("acc",),
)
def f3(spark, sf):
    return fb.version_chain(accepted(spark, sf), "0.1.0", ordered.by_time("created_at_ns")).select("feedback_id", "model_version", "parent", "n_parents")


@query(
    "f4_conflicts",
    """SELECT DISTINCT a.incident_id, a.target_id, 'conflict:' || least(a.feedback_id, b.feedback_id) || '~' || greatest(a.feedback_id, b.feedback_id) AS conflict FROM fbk a JOIN fbk b ON a.incident_id = b.incident_id AND a.target_id = b.target_id
WHERE a.label IN ('true_positive', 'confirmed') AND b.label IN ('false_positive', 'rejected', 'wrong_direction')""",
    ("fbk",),
)
def f4(spark, sf):
    return fb.conflicts(feedback_rows(spark, sf).withColumn("audit_id", F.col("feedback_id")))


# two writes of up to two versions per incident; 0 to 2 candidates
def reports(spark, sf):
    k = F.col("k")
    i = incidents(spark, sf)
    cand = lambda n, s, d, ab: F.struct(
        F.lit(n).alias("rank"), F.concat(F.lit("e"), (k % 7 + n).cast("string")).alias("entity_id"), s.alias("score"), F.lit(d).alias("direction"),
        F.array(F.concat(F.lit("e"), (k % 7 + n).cast("string"), F.lit("_cpu")), F.lit("x_mem")).alias("evidence"), ab.alias("abstained_reason"),
    )
    none = F.lit(None).cast("string")
    two = F.array(cand(1, F.lit(0.5) + k / F.lit(1000.0), "up", none), cand(2, F.lit(0.5), "down", F.when(k % 2 == 0, "no data")))
    c = F.when(k % 5 == 1, F.slice(two, 1, 0)).when(k % 5 == 0, F.slice(two, 1, 1)).otherwise(two)
    clusters = F.when(
        k % 3 != 0,
        F.array(
            F.struct(F.lit(0).alias("cluster_id"), F.array(F.lit("a"), F.lit("b")).alias("members"), (k / F.lit(100.0)).alias("cluster_score")),
            F.struct(F.lit(1).alias("cluster_id"), F.array(F.lit("c")).alias("members"), F.lit(0.5).alias("cluster_score")),
        ),
    )
    base = i.select("incident_id", c.alias("candidates"), F.coalesce(clusters, F.array().cast("array<struct<cluster_id:int,members:array<string>,cluster_score:double>>")).alias("clusters"), "k", "seq")
    w = base.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return w.select(
        "incident_id", F.when(F.col("n") == 2, F.concat(F.lit("0.1."), (F.col("k") % 2).cast("string"))).otherwise("0.1.0").alias("model_version"),
        (F.col("seq") * 10 + F.col("n")).alias("written_ns"), "candidates", "clusters", "k",
    )


cte(
    "rep",
    "SELECT incident_id, CASE WHEN n = 2 THEN '0.1.' || k % 2 ELSE '0.1.0' END AS model_version, seq * 10 + n AS written_ns, k, CASE k % 5 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS nc, 0.5::DOUBLE + k / 1000.0::DOUBLE AS s1, 0.5::DOUBLE AS s2 FROM finc, (VALUES (0), (1), (2)) v(n)",
    ("finc",),
)
cte(
    "lrep",
    "SELECT incident_id, arg_max(model_version, (fw, model_version)) AS model_version, arg_max(w, (fw, model_version)) AS written_ns, any_value(k) AS k, any_value(nc) AS nc, any_value(s1) AS s1, any_value(s2) AS s2 FROM (SELECT incident_id, model_version, min(written_ns) AS fw, max(written_ns) AS w, any_value(k) AS k, any_value(nc) AS nc, any_value(s1) AS s1, any_value(s2) AS s2 FROM rep GROUP BY incident_id, model_version) GROUP BY 1",
    ("rep",),
)


@query(
    "f5_report_versions",
    "SELECT 'version' AS part, incident_id, model_version, max(written_ns) AS written_ns FROM rep GROUP BY ALL UNION ALL SELECT 'latest', incident_id, model_version, written_ns FROM lrep",
    ("rep", "lrep"),
)
def f5(spark, sf):
    r = reports(spark, sf)
    one = lambda part, d: d.select(F.lit(part).alias("part"), "incident_id", "model_version", "written_ns")
    return one("version", fb.report_versions(r)).unionByName(one("latest", fb.latest_report(r)))


@query(
    "f6_uncertainty",
    "SELECT incident_id, round(least(1, CASE WHEN nc = 2 THEN 1 - greatest(0, least(1, s1 - s2)) ELSE 1 END + CASE WHEN nc = 2 AND k % 2 = 0 THEN 0.1 ELSE 0 END), 6) AS uncertainty FROM lrep",
    ("lrep",),
)
def f6(spark, sf):
    return fb.uncertainty(fb.latest_report(reports(spark, sf))).select("incident_id", r6("uncertainty").alias("uncertainty"))


@query(
    "f7_next_question",
    """
WITH h AS (SELECT DISTINCT incident_id, target_id FROM (SELECT incident_id, label, CASE WHEN target_id = 'zz' THEN 'e' || (CAST(substr(incident_id, 2) AS BIGINT) % 7 + 1) ELSE target_id END AS target_id FROM fbk) WHERE label IN ('false_positive', 'rejected', 'wrong_root_cause')),
q AS (SELECT l.incident_id, 'e' || (k % 7 + 1) AS top, CASE WHEN nc > 0 AND h.target_id IS NOT NULL THEN 'conflict' WHEN nc = 0 THEN 'observe' WHEN nc = 2 AND s1 - s2 < 0.05 THEN 'confirm_top1' END AS kind
 FROM lrep l LEFT JOIN h ON h.incident_id = l.incident_id AND h.target_id = 'e' || (k % 7 + 1))
SELECT incident_id, kind, CASE WHEN kind <> 'observe' THEN top END AS target_id FROM q WHERE kind IS NOT NULL
""",
    ("lrep", "fbk"),
)
def f7(spark, sf):
    f = feedback_rows(spark, sf)
    n = F.expr("cast(substr(incident_id, 2) as bigint)") % 7 + 1
    f = f.withColumn("target_id", F.when(F.col("target_id") == "zz", F.concat(F.lit("e"), n.cast("string"))).otherwise(F.col("target_id")))
    return fb.next_question(fb.latest_report(reports(spark, sf)), f).select("incident_id", "kind", "target_id")


_LINE = lambda n, s: f"{n} || ') e' || (k % 7 + {n}) || ', score ' || printf('%.3f', {s}) || ', seen in e' || (k % 7 + {n}) || '_cpu, x_mem'"
_NARR = f"""'Likely causes of ' || incident_id || ', most likely first: ' || CASE nc WHEN 0 THEN '' WHEN 1 THEN {_LINE(1, 's1')} ELSE {_LINE(1, 's1')} || '; ' || {_LINE(2, 's2')} END || '.'
 || CASE WHEN k % 3 <> 0 THEN ' Of 2 group(s) of services with like symptoms, this one stands out: ' || CASE WHEN k >= 50 THEN 'a, b' ELSE 'c' END || '.' ELSE '' END"""


@query("f8_narrative", f"SELECT incident_id, {_NARR} AS narrative FROM lrep", ("lrep",))
def f8(spark, sf):
    return fb.narrative(fb.latest_report(reports(spark, sf))).select("incident_id", "narrative")


@query(
    "f9_check_sentences",
    f"""
SELECT incident_id, CASE WHEN k % 3 = 0 THEN (nc > 0 AND k % 2 = 0)::INT + (nc > 0 AND k % 4 = 1)::INT
  ELSE (nc = 0 OR k % 2 = 0)::INT + 1 END AS n_valid FROM lrep  -- the clusters' members a, b and c are in every sentence
""",
    ("lrep",),
)
def f9(spark, sf):
    k = F.col("k")
    top = F.concat(F.lit("e"), (k % 7 + 1).cast("string"))
    first = F.concat(top, F.when(k % 2 == 0, " increased sharply.").otherwise(" decreased sharply."))
    second = F.when(k % 4 == 1, F.concat(F.lit("See "), top, F.lit("_cpu."))).otherwise("Nothing more to say.")
    r = fb.narrative(fb.latest_report(reports(spark, sf))).withColumn("text", F.concat_ws(" ", first, second))
    return fb.check_sentences(r).select("incident_id", "n_valid")


@query(
    "f10_audit_snapshot",
    "SELECT 'incident' AS kind, count(*) AS n FROM finc UNION ALL SELECT 'report', count(*) FROM (SELECT DISTINCT incident_id, model_version FROM rep) UNION ALL SELECT 'feedback', count(*) FROM fbk",
    ("finc", "rep", "fbk"),
)
def f10(spark, sf):
    a = fb.audit_snapshot(incidents(spark, sf), reports(spark, sf), feedback_rows(spark, sf))
    return a.where(F.get_json_object("json", "$.incident_id") == F.col("incident_id")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f11_threshold_drift",
    """
WITH RECURSIVE b AS (SELECT feedback_id, label, row_number() OVER (ORDER BY created_at_ns, feedback_id) AS i FROM acc),
d AS (SELECT *, CASE WHEN label IN ('false_positive', 'rejected') THEN 0.02 WHEN label = 'true_positive' THEN -0.01 ELSE 0 END::DOUBLE AS d FROM b),
r AS (SELECT i, feedback_id, CASE WHEN d > 0 THEN least(0.95, 0.5 + d) WHEN d < 0 THEN greatest(0.2, 0.5 + d) ELSE 0.5 END::DOUBLE AS t FROM d WHERE i = 1
 UNION ALL SELECT d.i, d.feedback_id, CASE WHEN d > 0 THEN least(0.95, r.t + d) WHEN d < 0 THEN greatest(0.2, r.t + d) ELSE r.t END FROM r JOIN d ON d.i = r.i + 1)
SELECT feedback_id, round(t, 6) AS threshold FROM r
""",
    ("acc",),
)
def f11(spark, sf):
    out = fb.threshold_drift(accepted(spark, sf), 0.5, ordered.by_time("created_at_ns", 6 * DAY))
    return out.select("feedback_id", r6("threshold").alias("threshold"))


@query(
    "f12_incident_view",
    f"""
WITH w AS (SELECT DISTINCT incident_id FROM fbk WHERE label = 'rejected'),
v AS (SELECT incident_id, string_agg(model_version, ',' ORDER BY fw, model_version) AS versions FROM (SELECT incident_id, model_version, min(written_ns) AS fw FROM rep GROUP BY ALL) GROUP BY 1),
f AS (SELECT incident_id, string_agg(feedback_id, ',' ORDER BY created_at_ns, feedback_id) AS feedback FROM fbk GROUP BY 1)
SELECT w.incident_id, versions, feedback, CASE WHEN i.incident_id IS NULL THEN 'unknown incident ' || w.incident_id END AS error, (l.incident_id IS NOT NULL)::INT AS has_narrative
FROM w LEFT JOIN finc i ON i.incident_id = w.incident_id LEFT JOIN v ON v.incident_id = w.incident_id LEFT JOIN f ON f.incident_id = w.incident_id LEFT JOIN lrep l ON l.incident_id = w.incident_id
""",
    ("finc", "rep", "lrep", "fbk"),
)
def f12(spark, sf):
    f = feedback_rows(spark, sf)
    view = fb.incident_view(incidents(spark, sf), reports(spark, sf), f, f.where("label = 'rejected'"))
    return view.select("incident_id", F.array_join("versions", ",").alias("versions"), F.array_join("feedback", ",").alias("feedback"), "error", F.col("narrative").isNotNull().cast("int").alias("has_narrative"))
