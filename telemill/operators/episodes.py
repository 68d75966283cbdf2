"""Episodes, evidence and drill-down (K family)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators import ordered, windows
from telemill.session import cut

SECOND = 1_000_000_000
# Counters of the process series, the thread series and the contention that ranks threads.
PROCESS_METRICS = ("on_cpu_ns", "io_ops", "io_bytes", "pf_minor", "pf_major", "lock_waits", "lock_lat_ns", "futex_waits", "futex_lat_ns",
                   "syscall_count", "syscall_lat_ns", "runq_wait_count", "runq_wait_ns")
THREAD_METRICS = ("on_cpu_ns", "lock_waits", "lock_lat_ns", "futex_waits", "futex_lat_ns", "syscall_count", "syscall_lat_ns", "runq_wait_count", "runq_wait_ns")
CONTENTION = ("lock_lat_ns", "futex_lat_ns", "runq_wait_ns", "lock_waits", "futex_waits", "runq_wait_count")
MEMORY_METRICS = ("kswapd_active", "direct_reclaim", "nr_reclaimed")


def latest_comm(log: DataFrame) -> DataFrame:
    """Newest command name per tid by sequence."""
    return log.groupBy("tid").agg(F.max_by("comm", "seq").alias("comm"))


def unpivot(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keep, F.inline(cells))


def process_series(deep: DataFrame, by: Sequence[str] = ("ordinal",)) -> DataFrame:
    """K1: counters summed per tick and process, as (entity, metric, ts_ns, value)."""
    g = deep.where("tgid <> 0").groupBy(*by, "ts_ns", "tgid").agg(*[F.sum(c).alias(c) for c in PROCESS_METRICS])
    return unpivot(g.withColumn("entity", F.concat(F.lit("proc"), F.col("tgid").cast("string"))), [*by, "ts_ns", "entity"], PROCESS_METRICS)


def thread_series(deep: DataFrame, by: Sequence[str] = ("ordinal",), n: int = 8) -> DataFrame:
    """K2: series of the ``n`` threads of an episode with the most contention; ties by tid."""
    total = deep.groupBy(*by, "tid").agg(F.sum(sum((F.col(c) for c in CONTENTION[1:]), F.col(CONTENTION[0]))).alias("a"))
    w = Window.partitionBy(*by).orderBy(F.desc("a"), "tid")
    best = total.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    kept = deep.join(best.select(*by, "tid"), [*by, "tid"], "left_semi")
    return unpivot(kept.withColumn("entity", F.concat(F.lit("t"), F.col("tid").cast("string"))), [*by, "ts_ns", "entity"], THREAD_METRICS)


def memory_series(memory: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K3"""
    return unpivot(memory.withColumn("entity", F.lit("host")), [*by, "ts_ns", "entity"], MEMORY_METRICS)


def _device(dev: Column) -> Column:
    return F.concat(F.lit("dev"), F.shiftright(dev, 20).cast("string"), F.lit("m"), dev.bitwiseAND(F.lit(0xFFFFF)).cast("string"))


def event_rows(ends: DataFrame, oom: DataFrame, syscall: DataFrame, lock: DataFrame, runq: DataFrame, iofile: DataFrame, by: Sequence[str] = ("ordinal",)) -> DataFrame:
    """K4: evidence events (kind, entity, name, count, wait_ns, ts_ns); events without a time of their own get the episode's end."""
    by = list(by)
    t = lambda tid: F.concat(F.lit("t"), F.col(tid).cast("string"))
    null_l = F.lit(None).cast("long")
    wait = (F.col("p99_us") * 1000).cast("long")
    pick = lambda df, kind, entity, name, count, wait_ns: df.select(
        *by, F.lit(kind).alias("kind"), entity.alias("entity"), name.alias("name"), count.cast("long").alias("count"), wait_ns.alias("wait_ns")
    )
    timed = (
        pick(syscall, "syscall", t("tid"), F.col("name"), F.col("count"), null_l)
        .unionByName(pick(lock, "lock", F.lit("host"), F.col("sym"), F.col("count"), null_l))
        .unionByName(pick(runq, "runq", t("tid"), F.lit(None).cast("string"), F.col("count"), wait))
        .unionByName(pick(iofile, "iofile", _device(F.col("dev")), F.col("path"), F.col("ops"), wait))
        .join(ends.select(*by, F.col("end_ns").alias("ts_ns")), by)
    )
    kills = oom.select(*by, F.lit("oom").alias("kind"), F.lit("host").alias("entity"), F.col("comm").alias("name"), F.lit(1).cast("long").alias("count"), null_l.alias("wait_ns"), "ts_ns")
    return timed.unionByName(kills)


def evidence_series(deep: DataFrame, memory: DataFrame, by: Sequence[str] = ("ordinal",), n: int = 8) -> DataFrame:
    """All series of an episode's evidence; ``memory`` carries the episode columns too."""
    return process_series(deep, by).unionByName(thread_series(deep, by, n)).unionByName(memory_series(memory, by))


def episodes(ticks: DataFrame, host: str, chunk: Column, post_ns: int = 180 * SECOND, debounce: int = 3) -> DataFrame:
    """K5: (host, start_ns, end_ns, deadline_ns, closed_ns).

    The first anomaly opens an episode that lasts to its deadline and is not
    re-entered. It ends at the first of ``debounce`` normal ticks in a row,
    else when it closes, at the first tick from the deadline on; the last tick
    closes an open one. Starts are a greedy choice; ends follow from counts of
    the runs of normal ticks inside an episode.
    """
    rows = cut(ticks.groupBy(host, "ts_ns").agg(F.coalesce(F.max("is_anomaly"), F.lit(False)).alias("is_anomaly")))
    starts = ordered.greedy(rows, [host], ["ts_ns"], "ts_ns", "is_anomaly", post_ns, chunk, skip=1).select(host, "ts_ns", F.lit(True).alias("opens"))
    at = {"start_ns": ("last", F.when(F.col("opens"), F.col("ts_ns"))), "run": ("sum", F.col("is_anomaly").cast("long"))}
    inside = cut(ordered.running(rows.join(starts, [host, "ts_ns"], "left"), [host], ["ts_ns"], at, chunk).where("start_ns is not null"))
    late = F.when(F.col("ts_ns") >= F.col("start_ns") + post_ns, F.col("ts_ns"))
    closed = inside.groupBy(host, "start_ns").agg(F.coalesce(F.min(late), F.max("ts_ns")).alias("closed_ns"))
    quiet = inside.where(~F.col("is_anomaly")).join(closed, [host, "start_ns"]).where("ts_ns <= closed_ns")
    runs = quiet.groupBy(host, "start_ns", "run").agg(F.min("ts_ns").alias("ts_ns"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= debounce)
    ends = runs.groupBy(host, "start_ns").agg(F.min("ts_ns").alias("end_ns"))
    out = closed.join(ends, [host, "start_ns"], "left")
    return out.select(host, "start_ns", F.coalesce("end_ns", "closed_ns").alias("end_ns"), (F.col("start_ns") + post_ns).alias("deadline_ns"), "closed_ns")


def episode_series(eps: DataFrame, series: DataFrame, pre_ns: int, bucket: int, on: Sequence[str] = ()) -> DataFrame:
    """K6: series rows from ``pre_ns`` before the start up to the deadline."""
    spans = eps.withColumns({"__lo": F.col("start_ns") - pre_ns, "__hi": F.col("deadline_ns")})
    return windows.range_join(spans, series, "__lo", "__hi", "ts_ns", bucket, on).drop("__lo", "__hi")


# Hot table and the column it is sorted by.
HOT_ORDER = {
    "deep_syscall": "count", "deep_runq": "count", "deep_lock": "count", "deep_iofile": "bytes", "deep_proc": "ts_ns", "deep_io_device": "ops",
    "deep_net_flow": "tx_bytes", "deep_net_drop": "count", "deep_net_softirq": "count", "deep_gpu_process": "ts_ns", "deep_offcpu": "dwell_ns",
}
_ASCENDING = {"deep_proc", "deep_gpu_process"}


def thread_names(deep: DataFrame) -> DataFrame:
    """Process, process name (its main thread's, else any) and own name per tid."""
    t = deep.groupBy("tid").agg(F.max_by("tgid", "ts_ns").alias("pid"), F.max_by("comm", "ts_ns").alias("tname"))
    p = t.groupBy("pid").agg(F.coalesce(F.max(F.when(F.col("tid") == F.col("pid"), F.col("tname"))), F.min_by("tname", "tid")).alias("pname"))
    return t.join(p, "pid")


def hot_table(df: DataFrame, name: str, names: DataFrame | None = None, pid: int | None = None) -> DataFrame:
    """K7: rows by their key figure, largest first (time-ordered tables by time), with process and thread names."""
    out = df
    if names is not None:
        out = df.drop("pid", "pname", "tname").join(names, "tid", "left").withColumns({"pname": F.coalesce("pname", F.lit("")), "tname": F.coalesce("tname", F.lit(""))})
        if pid is not None:
            out = out.where(F.col("pid") == pid)
    key = HOT_ORDER[name]
    return out.orderBy(F.asc(key) if name in _ASCENDING else F.desc(key))


def file_rollup(iofile: DataFrame, order: str = "seq") -> DataFrame:
    """K8: files by path; device and inode of the first row."""
    return iofile.groupBy("path").agg(
        F.sum("bytes").alias("bytes"), F.sum("ops").alias("ops"), F.sum("errors").alias("errors"), F.min_by("dev", order).alias("dev"), F.min_by("ino", order).alias("ino")
    )


def table_search(df: DataFrame, text: str = "", sort: str | None = None, descending: bool = True) -> DataFrame:
    """K9: rows with the text in any column, any case; sorted with nulls last."""
    q = text.strip().lower()
    if q:
        hay = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns])
        df = df.where(F.exists(hay, lambda v: F.contains(v, F.lit(q))))
    if sort:
        df = df.orderBy(F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort))
    return df


def log_search(logs: DataFrame, levels: Sequence[str], text: str = "", limit: int | None = None) -> DataFrame:
    """Log records of the levels that hold the text, by ``seq``; ``limit`` gives the first ones only."""
    out = logs.where(F.col("level").isin(*levels))
    q = text.strip().lower()
    if q:
        out = out.where(F.contains(F.lower("line"), F.lit(q)))
    out = out.orderBy("seq")
    return out if limit is None else out.limit(limit)


def flame_tree(parsed: DataFrame, tgid: int | None = None, tid: int | None = None) -> DataFrame:
    """Nodes (path, depth, name, value, self) of the prefix tree of folded stacks."""
    d = parsed
    if tgid is not None:
        d = d.where(F.col("tgid") == tgid)
    if tid is not None:
        d = d.where(F.col("tid") == tid)
    # equal stacks merge before they fan out into prefixes
    d = d.groupBy("frames").agg(F.sum("value").alias("value"))
    n = d.select("frames", "value", F.explode(F.sequence(F.lit(1), F.size("frames"))).alias("depth"))
    own = F.when(F.col("depth") == F.size("frames"), F.col("value")).otherwise(0.0)
    path = F.slice("frames", 1, F.col("depth"))
    nodes = n.groupBy(path.alias("path"), "depth").agg(F.sum("value").alias("value"), F.sum(own).alias("self"))
    return nodes.withColumn("name", F.element_at("path", -1))


def frame_class(name) -> Column:
    """Root, user or kernel by the frame's name."""
    n = F.col(name) if isinstance(name, str) else name
    user = F.contains(n, F.lit("/")) | F.regexp_like(n, F.lit("(?i)^[0-9a-f]{6,}$")) | n.startswith("[anon]")
    return F.when(n.isNull() | (n == ""), "kernel").when(n.startswith("p:") | n.startswith("t:"), "root").when(user, "user").otherwise("kernel")


def frame_search(nodes: DataFrame, text: str) -> DataFrame:
    """Add ``hit`` where the name holds the text, any case."""
    return nodes.withColumn("hit", F.contains(F.lower("name"), F.lit(text.lower())))


# Dashboard metrics.
CARDS = ("host.cpu.usage_pct", "host.mem.used_pct", "host.mem.swap_used_pct", "host.load.load1", "host.load.nr_running", "host.psi.cpu.some.avg10",
         "host.psi.io.some.avg10", "host.psi.mem.some.avg10", "net.tcp.retrans_segs_s", "ovh.cpu_pct")


def dashboard_cards(series: DataFrame, keys: Sequence[str] = (), mids: Sequence[str] = CARDS) -> DataFrame:
    """Last value and 60 s mean of the dashboard metrics; ``series``: (keys, mid, x, y)."""
    return windows.last_and_trailing_mean(series.where(F.col("mid").isin(*mids)), [*keys, "mid"])
