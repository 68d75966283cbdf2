"""Evidence bundles to reports, reports to text."""

import json
import math

from pyspark.sql import functions as F

from telemill.operators import diagnosis, feedback, rca

S = 1_000_000_000


def bundle(spike, lo=0, hi=600, start=300, end=450):
    series = []
    for t in range(lo, hi):
        series.append({"entity": "proc7", "metric": "cpu", "ts_ns": t * S, "value": 10 + 0.5 * math.sin(t / 7) + (60 if spike and t >= 300 else 0)})
        series.append({"entity": "proc9", "metric": "cpu", "ts_ns": t * S, "value": 12 + 0.5 * math.cos(t / 5)})
    out = {"deep_indicators": [{"type": "cpu", "confidence": 0.95}], "series": series}
    return json.dumps(out | ({"anomaly_start_ts": start * S, "anomaly_end_ts": end * S} if start else {}))


def test_bundles_to_reports(spark):
    rows = [("a", bundle(True)), ("two", bundle(True, 0, 300, 320, 330)), ("two", bundle(True, 300, 600)), ("none", bundle(True, start=None)),
            ("empty", json.dumps({"series": [], "anomaly_start_ts": S, "anomaly_end_ts": 2 * S})), ("broken", "{not json"), ("flat", json.dumps({
                "anomaly_start_ts": 5 * S, "anomaly_end_ts": 8 * S, "series": [{"entity": "p", "metric": "cpu", "ts_ns": t * S, "value": 1.0} for t in range(9)]}))]
    got = {r["case"]: r for r in diagnosis.diagnose(spark.createDataFrame(rows, "case string, value string"), resample=15).collect()}
    assert set(got) == {"a", "two", "none", "empty", "broken", "flat"}
    for case in ("a", "two"):
        assert got[case]["ok"] and got[case]["candidates"][0]["entity_id"] == "proc7" and got[case]["candidates"][0]["rank"] == 1
    assert got["two"]["incident_id"] == f"inc-{300 * S}-{450 * S}-deep"  # overlapping windows are one incident
    for case, why in (("none", "no valid anomaly window in evidence"), ("broken", "no valid anomaly window in evidence"), ("empty", "empty evidence series")):
        assert not got[case]["ok"] and got[case]["abstained_reason"] == why and got[case]["candidates"] is None
    assert got["flat"]["ok"] and got["flat"]["candidates"] == [] and "no service to rank: every metric is constant" in got["flat"]["limitations"]


def test_report_for_every_case(spark):
    matrix = spark.createDataFrame([(1, "s", 1.0, 0.0, 0.0, 0.0)], "case int, service string, metric double, log double, trace_lat double, trace_err double")
    matrix = matrix.select("case", "service", *[F.col(a).alias(b) for a, b in zip(("metric", "log", "trace_lat", "trace_err"), rca.MODALITIES)])
    ranked = spark.createDataFrame([(1, "s", 0, 1.0, 1)], "case int, service string, cluster_id int, cluster_score double, rank int")
    ind = spark.createDataFrame([(1, "s", "s_cpu", 2.0, 1)], "case int, service string, col string, score double, pos int")
    have = spark.createDataFrame([(1,)], "case int")
    got = {r["case"]: r for r in rca.report(ranked, matrix, ind, have, have, cases=spark.createDataFrame([(1,), (2,)], "case int")).collect()}
    assert got[1]["limitations"] == ["single-service fallback: refinement skipped"] and len(got[1]["candidates"]) == 1
    assert got[2]["candidates"] == [] and got[2]["clusters"] == [] and len(got[2]["limitations"]) == 3
    assert rca.report(ranked, matrix, ind, have, have).count() == 1


def test_renderer_with_fallback(spark):
    kinds = "incident_id string, candidates array<struct<rank:int,entity_id:string,score:double,direction:string,evidence:array<string>>>, clusters array<struct<cluster_id:int,members:array<string>,cluster_score:double>>"
    rows = [(i, [(1, "svc", 1.0, "up", ["svc_cpu"])], []) for i in ("good", "wrong", "failed", "blank")]
    reports = spark.createDataFrame(rows, kinds)
    text = F.when(F.col("incident_id") == "good", "svc went up.").when(F.col("incident_id") == "wrong", "svc decreased. svc_cpu tells so.").when(F.col("incident_id") == "blank", " ")
    got = {r["incident_id"]: r["narrative"] for r in feedback.narrate(reports, lambda df: df.withColumn("text", text)).collect()}
    plain = {r["incident_id"]: r["narrative"] for r in feedback.narrate(reports).collect()}
    assert got["good"] == "svc went up." and got["failed"] == plain["failed"] and got["blank"] == plain["blank"]
    assert got["wrong"] == plain["wrong"] + " svc_cpu tells so."
