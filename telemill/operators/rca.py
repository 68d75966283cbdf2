"""Root-cause ranking over metrics, logs and traces (A family).

Tables are long: (case, side, col, sec, v), where ``case`` names the incident
and ``side`` is ``normal`` before the injection second and ``anomal`` after.
All cases of a run are analysed together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions.integers import floor_div
from telemill.functions import numerics
from telemill.operators import ordered
from telemill.session import cut

SECOND = 1_000_000_000
MODALITIES = ("metric", "log", "trace_lat", "trace_err")
F_NODE = "F-node"
# Significance levels of the search and its defaults.
START_ALPHA, CHUNK_ALPHA, ALPHA_STEP = 0.001, 0.01, 0.1
GAMMA, BINS = 5, 5


def _sec(ts: str, bucket_ns: int) -> Column:
    return floor_div(F.col(ts), F.lit(bucket_ns))


def _grid(values: DataFrame, secs: DataFrame, case: str) -> DataFrame:
    """Zero-filled long table: every second of a case times every column of it.

    A case's columns are its services times their signals, a short list that
    travels as one array.
    """
    cols = values.groupBy(case).agg(F.collect_set("col").alias("__cols"))
    frame = secs.join(cols, case).select(case, "sec", F.explode("__cols").alias("col"))
    return frame.join(values, [case, "sec", "col"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def metric_table(points: DataFrame, case: str = "case", bucket_ns: int = SECOND) -> DataFrame:
    """A1: observed points as ``entity_metric`` columns per second; the last value wins, gaps are 0."""
    p = points.where("quality = 'observed'").withColumn("sec", _sec("ts_ns", bucket_ns))
    order = F.struct("ts_ns", *[c for c in ("seq",) if c in points.columns])
    v = p.groupBy(case, "sec", F.concat_ws("_", "entity_id", "metric_id").alias("col")).agg(
        F.max_by(F.coalesce(F.col("value").cast("double"), F.lit(0.0)), order).alias("v")
    )
    return _grid(v, p.select(case, "sec").distinct(), case)


def log_table(logs: DataFrame, case: str = "case", bucket_ns: int = SECOND) -> DataFrame:
    """A2: counts per ``entity_template`` and second of any log."""
    p = logs.withColumn("sec", _sec("ts_ns", bucket_ns))
    v = p.groupBy(case, "sec", F.concat_ws("_", "entity_id", "template_id").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return _grid(v, p.select(case, "sec").distinct(), case)


def trace_tables(spans: DataFrame, case: str = "case", bucket_ns: int = SECOND) -> tuple[DataFrame, DataFrame]:
    """A3: (errors, mean duration) per service and second of any span start."""
    p = spans.withColumn("sec", _sec("start_ts_ns", bucket_ns))
    bad = ~F.coalesce(F.col("status"), F.lit("")).isin("", "OK", "ok")
    per = p.groupBy(case, "sec", "service_name").agg(
        F.count_if(bad).cast("double").alias("e"), F.avg(F.col("end_ts_ns") - F.col("start_ts_ns")).alias("l")
    )
    secs = p.select(case, "sec").distinct()
    named = lambda suffix, c: per.select(case, "sec", F.concat("service_name", F.lit(suffix)).alias("col"), F.col(c).alias("v"))
    return _grid(named("_errors", "e"), secs, case), _grid(named("_latency", "l"), secs, case)


def decimate_rows(table: DataFrame, n: int, case: str = "case") -> DataFrame:
    """Every n-th second of a case (W5 on the rows of the wide table)."""
    secs = table.select(case, "sec").distinct()
    idx = ordered.with_index(secs, [case], ["sec"], ordered.by_time("sec", 86400), "__i")
    return table.join(idx.where(F.col("__i") % n == 0).select(case, "sec"), [case, "sec"])


def with_side(table: DataFrame, inject: DataFrame, case: str = "case") -> DataFrame:
    """Label rows by the case's injection second; ``inject``: (case, inject_s)."""
    j = table.join(inject, case)
    return j.withColumn("side", F.when(F.col("sec") < F.col("inject_s"), "normal").otherwise("anomal")).drop("inject_s")


def drop_constant(sided: DataFrame, case: str = "case", per_side: bool = True, mem_to_mb: bool = True) -> DataFrame:
    """A4: memory columns in MB; columns constant on either side (or over all rows) are dropped."""
    d = sided
    if mem_to_mb:
        d = d.withColumn("v", F.when(F.col("col").endswith("_mem"), F.col("v") / 1e6).otherwise(F.col("v")))
    if per_side:
        s = d.groupBy(case, "col", "side").agg((F.min("v") < F.max("v")).alias("moves"))
        keep = s.groupBy(case, "col").agg(F.count_if("moves").alias("n")).where("n = 2")
    else:
        keep = d.groupBy(case, "col").agg((F.min("v") < F.max("v")).alias("moves")).where("moves")
    return d.join(keep.select(case, "col"), [case, "col"], "left_semi")


def drop_last_normal_rows(sided: DataFrame, n: int = 2, case: str = "case") -> DataFrame:
    """The trace error baseline leaves out its last ``n`` rows when it has more."""
    secs = sided.where("side = 'normal'").select(case, "sec").distinct()
    w = Window.partitionBy(case).orderBy(F.desc("sec"))
    last = secs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    count = secs.groupBy(case).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > n)
    gone = last.join(count, case).select(case, "sec", F.lit("normal").alias("side"))
    return sided.join(gone, [case, "sec", "side"], "left_anti")


def severity(sided: DataFrame, case: str = "case") -> DataFrame:
    """A5: (case, col, score): largest |z| of the incident side under the baseline's mean and deviation, summing to 1."""
    base = sided.where("side = 'normal'").groupBy(case, "col").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scale = F.when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s"))
    z = F.abs((F.col("v") - F.col("m")) / scale)
    raw = sided.where("side = 'anomal'").join(base, [case, "col"]).groupBy(case, "col").agg(F.max(z).alias("z"))
    total = raw.groupBy(case).agg(F.sum("z").alias("t"))
    share = F.col("z") / F.when(F.col("t") == 0, F.lit(1.0)).otherwise(F.col("t"))
    return raw.join(total, case).select(case, "col", share.alias("score"))


def service_of(col: Column) -> Column:
    svc = F.substring_index(col, "_", 1)
    return F.when(svc == "frontendservice", "frontend").otherwise(svc)


def rollup_sum(ranks: DataFrame, case: str = "case") -> DataFrame:
    """A6"""
    return ranks.groupBy(case, service_of(F.col("col")).alias("service")).agg(F.sum("score").alias("score"))


def rollup_max(ranks: DataFrame, case: str = "case") -> DataFrame:
    """The best score per service, renormalised."""
    best = ranks.groupBy(case, service_of(F.col("col")).alias("service")).agg(F.max("score").alias("score"))
    total = best.groupBy(case).agg(F.sum("score").alias("t"))
    share = F.col("score") / F.when(F.col("t") == 0, F.lit(1.0)).otherwise(F.col("t"))
    return best.join(total, case).withColumn("score", share).drop("t")


def modality_matrix(metric: DataFrame, log: DataFrame, trace_lat: DataFrame, trace_err: DataFrame, case: str = "case") -> DataFrame:
    """Service rows with one severity per modality, 0 where absent."""
    parts = [metric, log, trace_lat, trace_err]
    tagged = None
    for name, df in zip(MODALITIES, parts):
        t = df.select(case, "service", F.lit(name).alias("m"), "score")
        tagged = t if tagged is None else tagged.unionByName(t)
    return tagged.groupBy(case, "service").agg(*[F.coalesce(F.max(F.when(F.col("m") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in MODALITIES])


def symptom_clusters(matrix: DataFrame, case: str = "case", max_components: int | None = None) -> DataFrame:
    """(case, service, cluster_id, cluster_score); clusters are numbered by falling score.

    A case's matrix has one row per service and four columns.
    """
    schema = T.StructType([matrix.schema[case], T.StructField("service", T.StringType()), T.StructField("cluster_id", T.IntegerType()), T.StructField("cluster_score", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("service").reset_index(drop=True)
        x = pdf[list(MODALITIES)].to_numpy(float)
        labels = numerics.best_mixture(x, max_components)
        mean = pd.Series(x.mean(axis=1)).groupby(labels).mean()
        order = {c: i for i, c in enumerate(sorted(mean.index, key=lambda c: (-mean[c], pdf["service"][np.argmax(labels == c)])))}
        out = pdf[[case, "service"]].copy()
        out["cluster_id"] = [order[c] for c in labels]
        out["cluster_score"] = [mean[c] for c in labels]
        return out

    return matrix.groupBy(case).applyInPandas(run, schema)


# ---- discrete columns and conditional independence ----


def kbins_edges(sided: DataFrame, case: str = "case", bins: int = BINS) -> DataFrame:
    """Inner bin edges (case, col, edges) of one-dimensional k-means from uniform centres.

    All columns of all cases take a Lloyd step together; a step only moves
    counts and sums per (column, bin). Columns with fewer rows than bins use
    quantile edges instead.
    """
    key = [case, "col"]
    vals = cut(sided.groupBy(*key, "v").agg(F.count(F.lit(1)).alias("w")))
    stats = vals.groupBy(*key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("n"),
                                      (F.sum(F.col("w") * F.col("v") * F.col("v")) / F.sum("w") - F.pow(F.sum(F.col("w") * F.col("v")) / F.sum("w"), F.lit(2.0))).alias("var"))
    width = (F.col("hi") - F.col("lo")) / bins
    start = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.col("lo") + width * (i + 0.5))
    centres = cut(stats.where(F.col("n") >= bins).select(*key, start.alias("c"), "var"))
    mids = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: (a + b) / 2)
    while True:  # Lloyd steps only ever lower the squared error, so they come to rest
        bin_ = F.size(F.filter("e", lambda e: F.col("v") >= e))
        sums = (
            vals.join(centres.select(*key, mids(F.col("c")).alias("e")), key).groupBy(*key, bin_.alias("b"))
            .agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
        )
        packed = sums.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("mm"))
        # an empty bin keeps its centre
        moved = F.transform("c", lambda c, i: F.coalesce(F.try_element_at("mm", i), c))
        nxt = cut(centres.join(packed, key).select(*key, "var", "c", F.array_sort(moved).alias("c2")))
        # the usual k-means stop: total squared shift within 1e-4 of the variance
        shift = F.aggregate(F.zip_with("c", "c2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d)
        more = nxt.where(shift > 1e-4 * F.col("var")).limit(1).count()
        centres = nxt.select(*key, F.col("c2").alias("c"), "var")
        if not more:
            break
    by_means = centres.select(*key, mids(F.col("c")).alias("edges"))
    qs = [i / bins for i in range(1, bins)]
    few = sided.join(stats.where(F.col("n") < bins).select(*key), key, "left_semi")
    by_quantiles = few.groupBy(*key).agg(F.array_distinct(F.percentile("v", F.array(*[F.lit(q) for q in qs]))).alias("edges"))
    return by_means.unionByName(by_quantiles)


def discretise(sided: DataFrame, edges: DataFrame, case: str = "case") -> DataFrame:
    """(case, side, sec, col, bin)."""
    b = F.size(F.filter("edges", lambda e: F.col("v") >= e))
    return sided.join(edges, [case, "col"]).select(case, "side", "sec", "col", b.cast("int").alias("bin"))


def sample_rows(binned: DataFrame, case: str = "case") -> DataFrame:
    """One row per (case, side, sec) with all bins as a map, the indicator included."""
    entry = F.struct(F.col("col").alias("k"), F.col("bin").alias("b"))
    flag = F.struct(F.lit(F_NODE).alias("k"), (F.col("side") == "anomal").cast("int").alias("b"))
    rows = binned.groupBy(case, "side", "sec").agg(F.collect_list(entry).alias("e"))
    return rows.select(case, "side", "sec", F.map_from_entries(F.array_append("e", flag)).alias("bins"))


@F.pandas_udf(T.DoubleType())
def chi2_tail(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(numerics.chi2_tail(stat.to_numpy(), dof.to_numpy()))


def chi_square_ci(rows: DataFrame, tests: DataFrame, case: str = "case") -> DataFrame:
    """A10: (test columns, stat, dof, p) of a batch of tests (case, test_id, x, y, given).

    Samples shrink to contingency cells in the map-side aggregate. Since the
    expected counts add up to the observed ones, a stratum's statistic is
    n * (sum of o^2 / (row * column) - 1) over its non-zero cells.
    """
    at = lambda c: F.try_element_at("bins", c)
    tested = rows.join(tests, case).select(
        case, "test_id", F.transform("given", lambda c: at(c)).alias("s"), at(F.col("x")).alias("xv"), at(F.col("y")).alias("yv")
    )
    cells = tested.groupBy(case, "test_id", "s", "xv", "yv").agg(F.count(F.lit(1)).cast("double").alias("o"))
    key = [case, "test_id", "s"]
    packed = cells.groupBy(*key).agg(F.sum("o").alias("n"), F.countDistinct("xv").alias("r"), F.countDistinct("yv").alias("c"))
    row = cells.groupBy(*key, "xv").agg(F.sum("o").alias("ro"))
    col = cells.groupBy(*key, "yv").agg(F.sum("o").alias("co"))
    terms = cells.join(row, [*key, "xv"]).join(col, [*key, "yv"]).groupBy(*key).agg(F.sum(F.col("o") * F.col("o") / (F.col("ro") * F.col("co"))).alias("q"))
    stat = F.greatest(F.lit(0.0), F.col("n") * (F.col("q") - 1))
    per = packed.join(terms, key).groupBy(case, "test_id").agg(F.sum(stat).alias("stat"), F.sum((F.col("r") - 1) * (F.col("c") - 1)).alias("dof"))
    return tests.join(per, [case, "test_id"]).withColumn("p", chi2_tail("stat", "dof"))


def _subsets(items: Column, depth: int) -> Column:
    """All subsets of ``depth`` items of a sorted array, as arrays."""
    if depth == 0:
        return F.array(F.array().cast("array<string>"))
    out = F.transform(items, lambda c: F.array(c))
    for _ in range(depth - 1):
        later = lambda s: F.filter(items, lambda c: c > F.element_at(s, -1))
        out = F.flatten(F.transform(out, lambda s: F.transform(later(s), lambda c: F.array_append(s, c))))
    return out


def _skeleton(rows: DataFrame, edges: DataFrame, alpha: float, local: bool, case: str, max_depth: int | None) -> tuple[DataFrame, DataFrame]:
    """Level-wise removal: all tests of a depth run as one batch, then edges with any p > alpha go."""
    removed = None
    depth = 0
    edges = cut(edges)
    while True:
        both = edges.unionByName(edges.select(case, F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
        near = both.groupBy(case, "x").agg(F.array_sort(F.collect_set("y")).alias("adj"))
        if local:
            pool = edges.join(near, [case, "x"])
        else:
            other = near.select(case, F.col("x").alias("y"), F.col("adj").alias("adj2"))
            pool = edges.join(near, [case, "x"]).join(other, [case, "y"])
        side = lambda c, drop: F.filter(c, lambda e: e != F.col(drop))
        sets = _subsets(side("adj", "y"), depth)
        if not local and depth > 0:
            sets = F.array_distinct(F.concat(sets, _subsets(side("adj2", "x"), depth)))
        cand = pool.select(case, "x", "y", F.explode(sets).alias("given"))
        tests = cut(cand.withColumn("test_id", F.xxhash64("x", "y", F.array_join("given", "\x01"), F.size("given"))))
        if tests.limit(1).count() == 0:
            break
        res = chi_square_ci(rows, tests, case)
        verdict = cut(
            res.groupBy(case, "x", "y").agg(F.max("p").alias("p"), F.max_by("given", "p").alias("sepset"), F.max_by("p", F.struct(F.size("given"), "given")).alias("last_p"))
        )
        gone = verdict.where(F.col("p") > alpha).select(case, "x", "y", "p", "sepset", F.lit(depth).alias("depth"))
        removed = gone if removed is None else removed.unionByName(gone)
        edges = cut(edges.join(verdict.where(F.col("p") > alpha).select(case, "x", "y"), [case, "x", "y"], "left_anti"))
        depth += 1
        if max_depth is not None and depth > max_depth:
            break
    return edges, removed


def local_skeleton(rows: DataFrame, columns: DataFrame, alpha: float, case: str = "case", max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges between the indicator and its neighbours, removed edges with p, separating set and depth).

    Edges removed at depth 0 are the marginally independent columns.
    """
    edges = columns.select(case, F.lit(F_NODE).alias("x"), F.col("col").alias("y"))
    return _skeleton(rows, edges, alpha, True, case, max_depth)


def full_skeleton(rows: DataFrame, columns: DataFrame, alpha: float, case: str = "case", max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The same over all column pairs. Removal is per level, so the result does not depend on column order."""
    cols = columns.select(case, "col").unionByName(columns.select(case, F.lit(F_NODE).alias("col")).distinct())
    listed = cols.groupBy(case).agg(F.array_sort(F.collect_set("col")).alias("cs"))
    pairs = F.flatten(F.transform("cs", lambda a: F.transform(F.filter("cs", lambda b: b > a), lambda b: F.struct(a.alias("x"), b.alias("y")))))
    return _skeleton(rows, listed.select(case, F.inline(pairs)), alpha, False, case, max_depth)


def _joint_counts(rows: DataFrame, groups: DataFrame, case: str) -> DataFrame:
    """Distinct joint bins of each column group with their counts: all that a search inside the group needs."""
    j = rows.join(groups, case)
    return (
        j.select(case, "grp", "cols", F.transform("cols", lambda c: F.try_element_at("bins", c)).alias("cell"), F.element_at("bins", F.lit(F_NODE)).alias("f"))
        .groupBy(case, "grp", "cols", "cell", "f").agg(F.count(F.lit(1)).alias("w"))
    )


def psi_pc(rows: DataFrame, groups: DataFrame, start_alpha: float = START_ALPHA, min_nodes: int = -1, case: str = "case") -> DataFrame:
    """Ranked root-cause columns (case, grp, col, pos) of each column group (case, grp, cols).

    A group of g columns with b bins has at most 2 * b^g distinct cells; the
    counting is distributed and only the cells reach the search.
    """
    counts = _joint_counts(rows, groups, case)
    schema = T.StructType([counts.schema[case], T.StructField("grp", T.LongType()), T.StructField("col", T.StringType()), T.StructField("pos", T.IntegerType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = list(pdf["cols"].iloc[0])
        pdf = pdf.sort_values("f", kind="mergesort")
        cells = np.column_stack([np.vstack(pdf["cell"].to_numpy()), pdf["f"].to_numpy()]).astype(int)
        cells = np.column_stack([np.unique(c, return_inverse=True)[1] for c in cells.T])
        order = numerics.CauseSearch(cells, pdf["w"].to_numpy(float), len(cols)).ranking(start_alpha, min_nodes, ALPHA_STEP)
        return pd.DataFrame({case: pdf[case].iloc[0], "grp": pdf["grp"].iloc[0], "col": [cols[i] for i in order], "pos": range(1, len(order) + 1)})

    return counts.groupBy(case, "grp").applyInPandas(run, schema)


def column_chunks(columns: DataFrame, gamma: int = GAMMA, seed: int = 7, case: str = "case") -> DataFrame:
    """Groups of ``gamma`` columns in a seeded hash order: (case, grp, cols)."""
    w = Window.partitionBy(case).orderBy(F.xxhash64(F.lit(seed), "col"), "col")
    c = columns.withColumn("grp", F.floor((F.row_number().over(w) - 1) / gamma).cast("long"))
    return c.groupBy(case, "grp").agg(F.array_sort(F.collect_list("col")).alias("cols"))


def multi_phase(rows: DataFrame, columns: DataFrame, gamma: int = GAMMA, seed: int = 7, case: str = "case", min_nodes: int = -1) -> DataFrame:
    """Chunked search until at most ``gamma`` columns remain or nothing shrinks, then a final ordering (case, col, pos)."""
    rows = cut(rows)
    alive = cut(columns.select(case, "col"))
    done = None
    while True:
        kids = psi_pc(rows, column_chunks(alive, gamma, seed, case), CHUNK_ALPHA, 1, case)
        nxt = cut(kids.select(case, "col"))
        sizes = alive.groupBy(case).agg(F.count(F.lit(1)).alias("was")).join(nxt.groupBy(case).agg(F.count(F.lit(1)).alias("now")), case, "left")
        sizes = cut(sizes.withColumn("stop", (F.coalesce("now", F.lit(0)) <= gamma) | (F.col("now") == F.col("was"))))
        stopped = nxt.join(sizes.where("stop").select(case), case, "left_semi")
        done = stopped if done is None else done.unionByName(stopped)
        if sizes.where("NOT stop").limit(1).count() == 0:
            break
        alive = cut(nxt.join(sizes.where("NOT stop").select(case), case, "left_semi"))
    final = done.groupBy(case).agg(F.array_sort(F.collect_list("col")).alias("cols")).withColumn("grp", F.lit(0).cast("long"))
    return psi_pc(rows, final, START_ALPHA, min_nodes, case).drop("grp")


def top_variance(sided: DataFrame, n: int = 64, by: list[str] | None = None, case: str = "case") -> DataFrame:
    """The ``n`` columns of a case (or cluster) with the highest variance over both sides; ties by name."""
    by = by or [case]
    v = sided.groupBy(*by, "col").agg(F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("variance"))
    w = Window.partitionBy(*by).orderBy(F.desc("variance"), "col")
    return v.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def refine_clusters(clusters: DataFrame, matrix: DataFrame, ordering: DataFrame, case: str = "case") -> DataFrame:
    """Final service ranks (case, service, cluster_id, rank).

    Inside a cluster the causal order holds if it covers all its services,
    else the mean severity. ``ordering``: (case, cluster_id, col, pos).
    """
    mean = sum((F.col(m) for m in MODALITIES[1:]), F.col(MODALITIES[0])) / len(MODALITIES)
    rows = clusters.join(matrix.select(case, "service", mean.alias("sev")), [case, "service"])
    first = ordering.withColumn("service", service_of(F.col("col"))).groupBy(case, "cluster_id", "service").agg(F.min("pos").alias("pos"))
    j = rows.join(first, [case, "cluster_id", "service"], "left")
    cover = j.groupBy(case, "cluster_id").agg(F.count("pos").alias("have"), F.count(F.lit(1)).alias("size"))
    j = j.join(cover, [case, "cluster_id"])
    causal = (F.col("have") == F.col("size")) & (F.col("size") > 1)
    inner = F.when(causal, F.col("pos").cast("double")).otherwise(-F.col("sev"))
    w = Window.partitionBy(case).orderBy("cluster_id", inner, "service")  # one row per service
    return j.withColumn("rank", F.row_number().over(w)).select(case, "service", "cluster_id", "cluster_score", "rank")


def indicator_ranks(*ranks: DataFrame, case: str = "case", top: int = 5) -> DataFrame:
    """The strongest indicators of each service over all modalities."""
    every = None
    for r in ranks:
        part = r.select(case, service_of(F.col("col")).alias("service"), "col", "score")
        every = part if every is None else every.unionByName(part)
    w = Window.partitionBy(case, "service").orderBy(F.desc("score"), "col")
    return every.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top)


def report(ranked: DataFrame, matrix: DataFrame, indicators: DataFrame, has_logs: DataFrame, has_traces: DataFrame, case: str = "case", top_k: int | None = None, cases: DataFrame | None = None) -> DataFrame:
    """One row per case: candidates, clusters and limitations. ``has_*``: cases with that modality.

    ``cases`` are all that want a report; one without a ranked service gets
    empty lists and says so. Without it only cases with a ranked service have one.
    """
    ind = indicators.groupBy(case, "service").agg(F.array_sort(F.collect_list(F.struct("pos", "col", "score"))).alias("i"))
    sev = F.struct(*MODALITIES)
    c = ranked.join(matrix, [case, "service"]).join(ind, [case, "service"], "left")
    direction = F.when(F.col("i").isNull(), "mixed").when(F.element_at("i", 1)["score"] > 0, "up").otherwise("down")
    cand = F.struct(
        F.col("rank"), F.col("service").alias("entity_id"), (1.0 / F.col("rank")).alias("score"), direction.alias("direction"), sev.alias("severity"),
        F.transform(F.coalesce("i", F.array().cast("array<struct<pos:int,col:string,score:double>>")), lambda e: e["col"]).alias("evidence"), F.col("cluster_id"),
    )
    kept = c if top_k is None else c.where(F.col("rank") <= top_k)
    per = kept.groupBy(case).agg(F.array_sort(F.collect_list(cand)).alias("candidates"))
    members = ranked.groupBy(case, "cluster_id").agg(F.array_sort(F.collect_list("service")).alias("members"), F.max("cluster_score").alias("cluster_score"))
    clusters = members.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("cluster_id", "members", "cluster_score"))).alias("clusters"), F.sum(F.size("members")).alias("n"))
    flag = lambda df, name: df.select(case).distinct().withColumn(name, F.lit(True))
    wanted = per.select(case) if cases is None else cases.select(case).distinct()
    j = wanted.join(per.join(clusters, case), case, "left").join(flag(has_logs, "l"), case, "left").join(flag(has_traces, "t"), case, "left")
    limits = F.array_compact(F.array(
        F.when(F.col("t").isNull(), F.lit("traces absent (blind spot)")), F.when(F.col("l").isNull(), F.lit("logs absent (blind spot)")),
        F.when(F.col("n").isNull(), F.lit("no service to rank: every metric is constant")),
        F.when(F.col("n") == 1, F.lit("single-service fallback: refinement skipped")),
    ))
    none = lambda c: F.coalesce(c, F.array().cast(j.schema[c].dataType)).alias(c)
    return j.select(case, none("candidates"), none("clusters"), limits.alias("limitations"))


def pick_incident(incidents: DataFrame, case: str = "case") -> DataFrame:
    """The incident to analyse: anomalies first, then the most metrics, then severity."""
    ok = incidents.where(F.col("status").isin("anomaly", "uncertain") & (F.col("severity") > 0))
    rank = F.struct((F.col("status") == "anomaly").cast("int"), F.size("metric_scores"), F.col("severity"), F.col("incident_id"))
    best = ok.groupBy(case).agg(F.max_by(F.struct(*[c for c in incidents.columns if c != case]), rank).alias("b"))
    return best.select(case, "b.*")


def merge_across_entities(incidents: DataFrame, case: str, chunk: Column) -> DataFrame:
    """Overlapping incidents of all entities become one: first id, widest extent, highest severity, later map entries win."""
    inc = ordered.merge_spans(incidents, [case], "start_ts_ns", "end_ts_ns", chunk)
    inc = cut(inc)
    order = F.struct("start_ts_ns", -F.col("end_ts_ns"), "incident_id")
    base = inc.groupBy(case, "island").agg(
        F.min_by("incident_id", order).alias("incident_id"), F.min("start_ts_ns").alias("start_ts_ns"), F.max("end_ts_ns").alias("end_ts_ns"),
        F.when(F.max((F.col("status") == "anomaly").cast("int")) == 1, "anomaly").otherwise("uncertain").alias("any"),
        F.min_by("status", order).alias("only"), F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity"),
    )
    base = base.withColumn("status", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("any"))).drop("any", "only", "n")

    def merged(field: str) -> DataFrame:
        e = inc.select(case, "island", order.alias("o"), F.explode(field).alias("k", "x")).groupBy(case, "island", "k").agg(F.max_by("x", "o").alias("x"))
        return e.groupBy(case, "island").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "x")))).alias(field))

    out = base
    for field in ("metric_scores", "directions"):
        out = out.join(merged(field), [case, "island"], "left")
    return out.drop("island")


def abstain(cases: DataFrame, incidents: DataFrame, points: DataFrame, case: str = "case") -> DataFrame:
    """Per case ok, or why no analysis is possible."""
    inc = incidents.select(case).distinct().withColumn("__i", F.lit(True))
    n = points.groupBy(case).agg(F.count(F.lit(1)).alias("__n"))
    j = cases.join(inc, case, "left").join(n, case, "left")
    reason = F.when(F.col("__i").isNull(), "no valid anomaly window in evidence").when(F.coalesce("__n", F.lit(0)) < 2, "empty evidence series")
    return j.select(case, reason.isNull().alias("ok"), reason.alias("abstained_reason"))


def baseline_correlation(sided: DataFrame, case: str = "case") -> DataFrame:
    """|Pearson correlation| of each column with the incident indicator; 0 for a constant column."""
    flag = (F.col("side") == "anomal").cast("double")
    c = sided.groupBy(case, "col").agg(F.corr("v", flag).alias("r"))
    return c.select(case, "col", F.coalesce(F.abs("r"), F.lit(0.0)).alias("score"))


def baseline_median_iqr(sided: DataFrame, case: str = "case") -> DataFrame:
    """Largest distance from the baseline median in units of the interquartile range (1 where it is 0)."""
    from telemill.operators.quantile import exact_quantiles

    q = exact_quantiles(sided.where("side = 'normal'"), [case, "col"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    z = F.abs(F.col("v") - F.col("q2")) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
    return sided.where("side = 'anomal'").join(q, [case, "col"]).groupBy(case, "col").agg(F.max(z).alias("score"))


def analyze(
    points: DataFrame, logs: DataFrame, spans: DataFrame, inject: DataFrame, case: str = "case", bucket_ns: int = SECOND,
    resample: int = 1, gamma: int = GAMMA, bins: int = BINS, top_k: int | None = None, max_components: int | None = None,
    max_cols: int | None = None,
) -> DataFrame:
    """The whole pipeline for many cases: tables, severities, clusters, causal refinement, report. ``inject``: (case, inject_s).

    Every second of every column is used unless ``resample`` or ``max_cols`` (columns of largest variance per cluster) ask for less.
    """
    metric = cut(metric_table(points, case, bucket_ns))
    metric = decimate_rows(metric, resample, case) if resample > 1 else metric
    m = cut(drop_constant(with_side(metric, inject, case), case))
    lg = cut(drop_constant(with_side(log_table(logs, case, bucket_ns), inject, case), case, per_side=False, mem_to_mb=False))
    err, lat = trace_tables(spans, case, bucket_ns)
    te = cut(drop_constant(with_side(err, inject, case), case, per_side=False, mem_to_mb=False))
    tl = cut(drop_constant(with_side(lat, inject, case), case, per_side=False, mem_to_mb=False))
    ranks = [cut(severity(m, case)), cut(severity(lg, case)), cut(severity(tl, case)), cut(severity(drop_last_normal_rows(te, 2, case), case))]
    matrix = cut(modality_matrix(rollup_sum(ranks[0], case), rollup_max(ranks[1], case), rollup_sum(ranks[2], case), rollup_sum(ranks[3], case), case))
    clusters = cut(symptom_clusters(matrix, case, max_components))
    ordering = cut(cluster_ordering(m, lg, clusters, gamma, bins, case, max_cols))
    ranked = refine_clusters(clusters, matrix, ordering, case)
    return report(ranked, matrix, indicator_ranks(*ranks, case=case), logs, spans, case, top_k, inject)


def cluster_ordering(metric: DataFrame, logs: DataFrame, clusters: DataFrame, gamma: int = GAMMA, bins: int = BINS, case: str = "case", max_cols: int | None = None) -> DataFrame:
    """Causal order (case, cluster_id, col, pos) inside every cluster of two or more services, all clusters at once."""
    sizes = clusters.groupBy(case, "cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = clusters.join(sizes.select(case, "cluster_id"), [case, "cluster_id"])
    key = F.concat_ws("|", F.col(case).cast("string"), F.col("cluster_id").cast("string"))
    both = metric.select(case, "side", "sec", "col", "v").unionByName(logs.select(case, "side", "sec", "col", "v"))
    own = both.withColumn("service", service_of(F.col("col"))).join(members.select(case, "cluster_id", "service"), [case, "service"])
    own = cut(drop_constant(own.withColumn("unit", key).drop("service"), "unit", mem_to_mb=False))
    if max_cols is not None:
        own = cut(own.join(top_variance(own, max_cols, ["unit"]).select("unit", "col"), ["unit", "col"], "left_semi"))
    # metrics and logs have their own seconds; a value missing at one of them is 0
    secs = own.select("unit", "sec", "side").distinct()
    filled = _grid(own.select("unit", "sec", "col", "v"), secs.select("unit", "sec"), "unit").join(secs, ["unit", "sec"])
    names = own.select("unit", case, "cluster_id").distinct()
    own = cut(filled)
    binned = discretise(own, cut(kbins_edges(own, "unit", bins)), "unit")
    found = multi_phase(sample_rows(binned, "unit"), own.select("unit", "col").distinct(), gamma, case="unit")
    return found.join(names, "unit").select(case, "cluster_id", "col", "pos")
