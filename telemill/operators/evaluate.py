"""Evaluation of detectors and rankings (E family). Points hold keys, an order, ``pred`` and ``label`` as 0/1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators import ordered
from telemill.session import cut

HOUR_NS = 3_600_000_000_000


def _prf(df: DataFrame, tp: str, n_pred: Column, n_true: Column, prefix: str) -> DataFrame:
    p = F.when(n_pred > 0, F.col(tp) / n_pred).otherwise(0.0)
    r = F.when(n_true > 0, F.col(tp) / n_true).otherwise(0.0)
    out = df.withColumns({f"{prefix}_precision": p, f"{prefix}_recall": r})
    p, r = F.col(f"{prefix}_precision"), F.col(f"{prefix}_recall")
    return out.withColumn(f"{prefix}_f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def point_f1(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per point, without point adjustment."""
    p, t = F.col("pred") > 0, F.col("label") > 0
    c = df.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return _prf(c, "tp", F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"), "point")


def segment_f1(df: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """A predicted segment hits if it overlaps a true one; recall is hits over true segments and may exceed 1.

    Segments are runs of consecutive rows, so an overlap is a predicted row
    with a true label and no range join is needed.
    """
    d = df.withColumns({"__p": F.col("pred") > 0, "__t": F.col("label") > 0})
    d = ordered.previous(d, keys, order, {"__pp": "__p", "__pt": "__t"}, chunk)
    new = lambda c, was: F.col(c) & ~F.coalesce(was, F.lit(False))
    d = cut(d.withColumns({"__ps": new("__p", "__pp"), "__ts": new("__t", "__pt")}))
    true = d.groupBy(*keys).agg(F.count_if("__ts").alias("true_segments"))
    runs = ordered.islands(d, keys, order, F.col("__ps"), chunk, "__run").where("__p")
    hits = runs.groupBy(*keys, "__run").agg(F.max("__t").alias("hit")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pred_segments"), F.count_if("hit").alias("tp")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("pred_segments", "tp")}
    joined = true.join(hits, keys, "left").withColumns(zero) if keys else hits.withColumn("true_segments", true.scalar())
    return _prf(joined, "tp", F.col("pred_segments"), F.col("true_segments"), "seg")


def vus_pr(df: DataFrame, keys: list[str], score: str, value_chunk: Column, n: int = 100) -> DataFrame:
    """Area under precision over recall at the thresholds of ``n`` score quantiles.

    Scores shrink to counts per distinct value first; running counts along the
    values then give every threshold's confusion without touching points.
    """
    v = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("c"), F.sum((F.col("label") > 0).cast("long")).alias("pos"))
    run = ordered.running(v, keys, [score], {"cn": ("sum", F.col("c")), "cp": ("sum", F.col("pos"))}, value_chunk)
    total = v.groupBy(*keys).agg(F.sum("c").alias("n_all"), F.sum("pos").alias("p_all"))
    j = run.join(total, keys)
    step = F.lit(1.0 / (n - 1))
    rank = lambda i: (F.lit(1.0) - i * step) * (F.col("n_all") - 1)
    before = F.col("cn") - F.col("c")
    mine = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.floor(rank(i)) >= before) & (F.floor(rank(i)) < F.col("cn")))
    at = j.withColumn("i", F.explode(mine)).withColumn("r", rank(F.col("i")))
    # a threshold between two values lies above all of the lower one
    above = (F.ceil("r") >= F.col("cn")) & (F.ceil("r") > F.floor("r"))
    below_n = F.when(above, F.col("cn")).otherwise(before)
    below_p = F.when(above, F.col("cp")).otherwise(F.col("cp") - F.col("pos"))
    at = at.withColumns({"k": F.col("n_all") - below_n, "tp": F.col("p_all") - below_p})
    at = at.withColumns({
        "prec": F.when(F.col("k") > 0, F.col("tp") / F.col("k")).otherwise(0.0), "rec": F.when(F.col("p_all") > 0, F.col("tp") / F.col("p_all")).otherwise(0.0),
    })
    w = Window.partitionBy(*keys).orderBy("i")  # n rows a series
    area = 0.5 * (F.col("prec") + F.lag("prec").over(w)) * F.abs(F.col("rec") - F.lag("rec").over(w))
    return at.withColumn("a", area).groupBy(*keys).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("vus_pr"))


def accuracy_at_k(ranking: DataFrame, truth: DataFrame, on: Sequence[str] = ("case_id",), ks: Sequence[int] = (1, 3, 5), target: str = "service") -> DataFrame:
    """AC@k for the given ks and Avg@5; ``ranking``: (case, target, rank), ``truth``: (case, target)."""
    hit = truth.join(ranking, [*on, *([target] if isinstance(target, str) else target)], "left")
    best = hit.groupBy(*on).agg(F.min("rank").alias("r"))
    at = lambda k: F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double"))
    avg5 = (at(1) + at(2) + at(3) + at(4) + at(5)) / 5
    return best.agg(F.count(F.lit(1)).alias("cases"), *[at(k).alias(f"ac_{k}") for k in ks], avg5.alias("avg_5"))


def summary_table(metrics: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """E5: metrics per machine and their mean row."""
    mean = metrics.agg(*[F.avg(c).alias(c) for c in cols]).select(F.lit("mean").alias(key), *cols)
    return metrics.select(F.col(key).cast("string").alias(key), *cols).unionByName(mean)


def alarms_and_delay(df: DataFrame, keys: list[str], order: list[str], chunk: Column, ts: str = "ts_ns") -> DataFrame:
    """False alarm segments per hour, and mean delay from the start of a true segment to its first predicted row."""
    d = df.withColumns({"__p": F.col("pred") > 0, "__t": F.col("label") > 0})
    d = ordered.previous(d, keys, order, {"__pp": "__p", "__pt": "__t"}, chunk)
    start = lambda c, was: (F.col(c) & ~F.coalesce(was, F.lit(False))).cast("long")
    d = cut(ordered.running(d, keys, order, {"__pr": ("sum", start("__p", "__pp")), "__tr": ("sum", start("__t", "__pt"))}, chunk))
    false = d.where("__p").groupBy(*keys, "__pr").agg(F.max("__t").alias("hit")).groupBy(*keys).agg(F.count_if(~F.col("hit")).alias("false_alarms"))
    seen = d.where("__t").groupBy(*keys, "__tr").agg((F.min(F.when(F.col("__p"), F.col(ts))) - F.min(ts)).alias("delay"))
    delay = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("true_segments"), F.count("delay").alias("detected"), F.avg("delay").alias("mean_delay_ns"))
    hours = d.groupBy(*keys).agg(((F.max(ts) - F.min(ts)) / F.lit(float(HOUR_NS))).alias("hours"))
    out = hours.join(false, keys, "left").join(delay, keys, "left").withColumn("false_alarms", F.coalesce("false_alarms", F.lit(0)))
    return out.withColumn("false_alarms_per_hour", F.when(F.col("hours") > 0, F.col("false_alarms") / F.col("hours")))
