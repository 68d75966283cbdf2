"""From evidence bundles to reports in one call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.integers import floor_div
from telemill.operators import ordered, rca
from telemill.session import cut
from telemill.sources import messages


def diagnose(bundles: DataFrame, case: str = "case", column: str = "value", bucket_ns: int = rca.SECOND, chunk: Column | None = None, **params) -> DataFrame:
    """(case, ok, abstained_reason, incident_id, candidates, clusters, limitations) for every case of ``bundles``.

    A case may have several bundles, each a JSON text in ``column``: their
    series, events and spans count together, overlapping incidents become one
    and the strongest is analysed. Cases without a valid anomaly window, or
    with fewer than two points, are not analysed and say why; their lists are
    null. Malformed text counts as an empty bundle.
    """
    parsed = cut(messages.parse_evidence(bundles.select(case, column), column))
    parts = messages.evidence_to_modalities(parsed, [case])
    points = cut(parts["points"])
    incidents = cut(parts["incident"].select(case, "incident_id", "start_ts_ns", "end_ts_ns", "status", "severity", "metric_scores", "directions"))
    verdict = cut(rca.abstain(bundles.select(case).distinct(), incidents, points, case))
    ok = verdict.where("ok").select(case)
    along = chunk if chunk is not None else ordered.by_time("start_ts_ns")
    chosen = cut(rca.pick_incident(rca.merge_across_entities(incidents, case, along), case).join(ok, case, "left_semi"))
    inject = cut(chosen.select(case, floor_div(F.col("start_ts_ns"), F.lit(bucket_ns)).alias("inject_s")))
    of = lambda df: df.join(ok, case, "left_semi")
    report = rca.analyze(of(points), of(parts["logs"]), of(parts["spans"]), inject, case, bucket_ns, **params)
    return verdict.join(chosen.select(case, "incident_id"), case, "left").join(report, case, "left")
