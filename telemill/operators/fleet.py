"""Cross-host aggregation of incident summaries (H family).

Messages: (cluster_id, host_id, clock_offset_ns, incident_id, start_ts_ns, end_ts_ns, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.integers import floor_div
from telemill.operators import ordered, rca, windows
from telemill.session import cut


def agent_summaries(incidents: DataFrame, points: DataFrame, agents: DataFrame) -> DataFrame:
    """H1: one message per host incident with the host's quality counts; raw series stay home.

    ``agents``: (host_id, cluster_id, clock_offset_ns).
    """
    q = points.groupBy("host_id", "quality").agg(F.count(F.lit(1)).alias("n"))
    summary = q.groupBy("host_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("quality", "n")))).alias("quality_summary"))
    return incidents.join(agents, "host_id").join(summary, "host_id", "left")


def cluster_filter(messages: DataFrame, cluster_id: str) -> tuple[DataFrame, DataFrame]:
    """H2: (own messages, rejects)."""
    own = F.col("cluster_id") == cluster_id
    reject = messages.where(~own | own.isNull())
    return messages.where(own), reject.withColumn("reason", F.concat(F.lit("foreign cluster "), F.coalesce("cluster_id", F.lit(""))))


def clock_correct(messages: DataFrame) -> DataFrame:
    """H3: window times in the coordinator's clock."""
    off = F.col("clock_offset_ns")
    return messages.withColumns({"wall_start_ns": F.col("start_ts_ns") + off, "wall_end_ns": F.col("end_ts_ns") + off})


def clock_correct_points(points: DataFrame, agents: DataFrame) -> DataFrame:
    """H3: point times in the coordinator's clock."""
    j = points.join(agents.select("host_id", "clock_offset_ns"), "host_id")
    return j.withColumn("ts_ns", F.col("ts_ns") + F.col("clock_offset_ns")).drop("clock_offset_ns")


def group_incidents(corrected: DataFrame) -> DataFrame:
    """H4: hosts and extent of each incident id."""
    return corrected.groupBy("incident_id").agg(
        F.array_sort(F.collect_set("host_id")).alias("hosts"), F.count(F.lit(1)).alias("messages"),
        F.min("wall_start_ns").alias("wall_start_ns"), F.max("wall_end_ns").alias("wall_end_ns"),
    )


def skew_violations(corrected: DataFrame, max_skew_ns: int, chunk: Column) -> DataFrame:
    """H5: consecutive incidents of one host further apart than the allowed skew; any row makes the order untrustworthy."""
    order = ["wall_start_ns", "incident_id"]
    prev = ordered.previous(corrected, ["host_id"], order, {"prev_start": "wall_start_ns"}, chunk)
    return prev.where(F.col("wall_start_ns") - F.col("prev_start") > max_skew_ns).select("host_id", "incident_id", "prev_start", "wall_start_ns")


def propagation_order(corrected: DataFrame) -> DataFrame:
    """H5: hosts by their first corrected incident start. Check :func:`skew_violations` first."""
    from pyspark.sql import Window

    first = corrected.groupBy("host_id").agg(F.min("wall_start_ns").alias("first_ns"))
    # one row per host
    return first.withColumn("pos", F.row_number().over(Window.orderBy("first_ns", "host_id")))


def joint_analysis(points: DataFrame, logs: DataFrame, spans: DataFrame, messages: DataFrame, agents: DataFrame, max_skew_ns: int, **params) -> DataFrame:
    """H6: root causes over all hosts of a cluster, in the coordinator's clock.

    Entities get their host as prefix, since two hosts may name them alike. A
    cluster is one case, starting at its earliest corrected incident.
    """
    case = "cluster"
    home = agents.select("host_id", F.col("cluster_id").alias(case), "clock_offset_ns")
    named = lambda df, col: df.withColumn(col, F.concat_ws("/", "host_id", col))

    def moved(df: DataFrame, *times: str) -> DataFrame:
        j = df.join(home, "host_id")
        return j.withColumns({t: F.col(t) + F.col("clock_offset_ns") for t in times}).drop("clock_offset_ns")

    start = clock_correct(messages).groupBy(F.col("cluster_id").alias(case)).agg(F.min("wall_start_ns").alias("t"))
    bucket = params.get("bucket_ns", rca.SECOND)
    inject = start.select(case, floor_div(F.col("t"), F.lit(bucket)).alias("inject_s"))
    rep = rca.analyze(
        moved(named(points, "entity_id"), "ts_ns"), moved(named(logs, "entity_id"), "ts_ns"), moved(named(spans, "service_name"), "start_ts_ns", "end_ts_ns"),
        cut(inject), case, **params,
    )
    skew = home.groupBy(case).agg(F.max(F.abs("clock_offset_ns")).alias("skew"))
    note = F.when(F.col("skew") > max_skew_ns, F.concat(F.lit("host clocks differ by "), F.col("skew").cast("string"), F.lit(f" ns, more than the {max_skew_ns} ns allowed; the order across hosts is doubtful")))
    j = rep.join(skew, case)
    return j.withColumn("limitations", F.array_compact(F.array_append("limitations", note))).drop("skew")


def summary_bytes(messages: DataFrame) -> DataFrame:
    """H7: JSON size of the messages per host."""
    size = F.octet_length(F.to_json(F.struct(*messages.columns)))
    return messages.groupBy("host_id").agg(F.sum(size).alias("bytes"), F.max(size).alias("largest"))
