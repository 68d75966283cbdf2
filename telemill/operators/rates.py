"""Counter to rate derivations and series drill-down (C family).

One rule holds throughout: per key in time order, a step is the difference to
the reading before; a shrinking monotone counter breaks the line, a zero time
step has no rate, and null or non-finite results are not emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.scores import finite
from telemill.operators import ordered


@dataclass(frozen=True)
class Metric:
    """``value(d, c, s, ns)``: d(col) is the step, c(col) the reading, s and ns the time step (null when zero)."""

    mid: str
    value: Callable[..., Column]
    mono: Sequence[str] = ()
    counter: bool = True


def _d(col: str) -> Column:
    return F.col(col) - F.col(f"p_{col}")


def derive(df: DataFrame, keys: list[str], metrics: Sequence[Metric], columns: Sequence[str], chunk: Column, order: Sequence[str] = ("ts_ns",)) -> DataFrame:
    """Long (keys, ts_ns, mid, y) of all metrics; ``columns`` are the readings their steps use."""
    if columns:
        prev = {f"p_{c}": c for c in columns}
        df = ordered.previous(df, keys, list(order), {**prev, "p_ts_ns": "ts_ns"}, chunk)
        has = F.col("p_ts_ns").isNotNull()
        ns = F.nullif(F.col("ts_ns") - F.col("p_ts_ns"), F.lit(0)).cast("double")
    else:
        has, ns = F.lit(False), F.lit(None).cast("double")
    cells = []
    for m in metrics:
        y = m.value(_d, F.col, ns / 1e9, ns).cast("double")
        if m.counter:
            ok = has
            for c in m.mono:
                ok = ok & (_d(c) >= 0)
            y = F.when(ok, y)
        cells.append(F.struct(F.lit(m.mid).alias("mid"), y.alias("y")))
    out = df.select(*keys, "ts_ns", F.inline(F.array(*cells)))
    return out.where(finite("y"))


def _ratio(num: Column, den: Column, factor: float = 1.0) -> Column:
    return F.lit(factor) * num / F.nullif(den.cast("double"), F.lit(0.0))


def per_second(mid: str, col: str, factor: float = 1.0) -> Metric:
    return Metric(mid, lambda d, c, s, ns: F.lit(factor) * d(col) / s, (col,))


def gauge(mid: str, value: Callable[[Callable[[str], Column]], Column]) -> Metric:
    return Metric(mid, lambda d, c, s, ns: value(c), counter=False)


def counter_rate(df: DataFrame, keys: list[str], cols: Sequence[str], mono: Sequence[str], chunk: Column) -> DataFrame:
    """Step / dt of each column; a shrinking column among ``mono`` breaks all of them."""
    metrics = [Metric(f"{c}_s", lambda d, c_, s, ns, c=c: d(c) / s, tuple(mono)) for c in cols]
    return derive(df, keys, metrics, list(dict.fromkeys([*cols, *mono])), chunk)


# Metric names and the columns they are derived from.
_PSI = [(g, k, w) for g in ("cpu", "io", "mem") for k in ("some", "full") for w in (10, 60, 300)]
GAUGES = [
    *[gauge(f"host.load.{c}", lambda c_, c=c: c_(c)) for c in ("load1", "load5", "load15", "nr_running", "nr_threads")],
    gauge("host.mem.used_pct", lambda c: _ratio(c("mem_total_kb") - c("mem_avail_kb"), c("mem_total_kb"), 100.0)),
    gauge("host.mem.swap_used_pct", lambda c: _ratio(c("swap_total_kb") - c("swap_free_kb"), c("swap_total_kb"), 100.0)),
    *[
        gauge(f"host.mem.{n}_mb", lambda c_, c=c: c_(c) / 1024)
        for n, c in (("cached", "cached_kb"), ("buffers", "buffers_kb"), ("anon", "anon_pages_kb"), ("avail", "mem_avail_kb"))
    ],
    *[
        gauge(f"host.psi.{g}.{k}.avg{w}", lambda c, g=g, k=k, w=w: F.when(c(f"psi_{g}_{k[0]}_valid") != 0, c(f"psi_{g}_{k[0]}{w}")))
        for g, k, w in _PSI
    ],
]

CPU = ("cu_user", "cu_nice", "cu_sys", "cu_idle", "cu_iowait", "cu_irq", "cu_softirq", "cu_steal", "cu_guest", "cu_guest_nice")


def _share(mid: str, cols: Sequence[str]) -> Metric:
    total = lambda d, names: sum((d(c) for c in names[1:]), d(names[0]))
    return Metric(mid, lambda d, c, s, ns: _ratio(total(d, cols), total(d, CPU), 100.0), CPU)


HOST_CPU = [
    _share("host.cpu.usage_pct", [c for c in CPU if c not in ("cu_idle", "cu_guest", "cu_guest_nice")]),
    _share("host.cpu.user_pct", ["cu_user", "cu_nice"]),
    _share("host.cpu.sys_pct", ["cu_sys"]),
    _share("host.cpu.iowait_pct", ["cu_iowait"]),
    _share("host.cpu.irq_pct", ["cu_irq", "cu_softirq"]),
]
VM = [per_second(f"host.vm.{c}_s", f"vm_{c}") for c in ("pgfault", "pgmajfault", "pswpin", "pswpout")]

CORE = ("usr", "nice", "sys", "idle", "iowait", "irq", "softirq", "steal")


def _core_usage(d, c, s, ns):
    total = sum((d(x) for x in CORE[1:]), d(CORE[0])).cast("double")
    return F.when(total > 0, 100.0 * (1 - d("idle") / total))


CORE_USAGE = [Metric("host.cpu.core.usage_pct", _core_usage)]

_MB_SECTOR = 512 / 1e6
DISK = [
    per_second("host.disk.read_mbs", "sectors_read", _MB_SECTOR),
    per_second("host.disk.write_mbs", "sectors_written", _MB_SECTOR),
    per_second("host.disk.util_pct", "io_ticks_ms", 0.1),
    Metric("host.disk.read_await_ms", lambda d, c, s, ns: F.when(s.isNotNull() & (d("reads_completed") > 0), d("read_ticks_ms") / d("reads_completed")), ("read_ticks_ms",)),
    Metric("host.disk.write_await_ms", lambda d, c, s, ns: F.when(s.isNotNull() & (d("writes_completed") > 0), d("write_ticks_ms") / d("writes_completed")), ("write_ticks_ms",)),
]
DISK_COLS = ("sectors_read", "sectors_written", "io_ticks_ms", "reads_completed", "writes_completed", "read_ticks_ms", "write_ticks_ms")

ACTIVITY = [
    Metric("ebpf.busy_pct", lambda d, c, s, ns: 100.0 * d("on_cpu_ns_total") / ns, ("on_cpu_ns_total",)),
    per_second("ebpf.switches_s", "switch_total"),
    Metric("ebpf.faults_s", lambda d, c, s, ns: (d("minor_faults_total") + d("major_faults_total")) / s, ("minor_faults_total",)),
    per_second("ebpf.io_ops_s", "io_ops_total"),
    per_second("ebpf.io_mbs", "io_bytes_total", 1e-6),
    per_second("ebpf.lock_waits_s", "lock_waits_total"),
]
ACTIVITY_COLS = ("on_cpu_ns_total", "switch_total", "minor_faults_total", "major_faults_total", "io_ops_total", "io_bytes_total", "lock_waits_total")

_IFACE = (("rx_bytes", "rx_mbps", 8e-6), ("tx_bytes", "tx_mbps", 8e-6), ("rx_packets", "rx_pps", 1.0), ("tx_packets", "tx_pps", 1.0),
          ("rx_errors", "rx_err_s", 1.0), ("tx_errors", "tx_err_s", 1.0), ("rx_dropped", "rx_drop_s", 1.0), ("tx_dropped", "tx_drop_s", 1.0))
IFACE = [per_second(f"net.iface.{m}", c, f) for c, m, f in _IFACE]
IFACE_COLS = tuple(c for c, _, _ in _IFACE)

STACK_COLS = ("active_opens", "passive_opens", "attempt_fails", "estab_resets", "retrans_segs", "out_rsts", "in_errs", "syn_retrans", "timeouts",
              "listen_overflows", "listen_drops", "udp_no_ports")
STACK = [
    *[per_second(f"net.tcp.{c}_s", c) for c in STACK_COLS],
    # gauges that the source emits from the second row on
    Metric("net.tcp.curr_estab", lambda d, c, s, ns: c("curr_estab")),
    Metric("net.tcp.sock_mem_kb", lambda d, c, s, ns: c("tcp_sock_mem") * 4),
]

SOFTNET_COLS = ("processed", "dropped", "time_squeeze", "net_rx_softirq", "net_tx_softirq")
SOFTNET = [gauge("net.softnet.backlog_len", lambda c: c("backlog_len")), *[per_second(f"net.softnet.{c}_s", c) for c in SOFTNET_COLS]]

GPU = [
    gauge("gpu.util_pct", lambda c: c("util_pct")),
    gauge("gpu.mem_used_mb", lambda c: c("mem_used_bytes") / 1e6),
    gauge("gpu.mem_pct", lambda c: _ratio(c("mem_used_bytes"), c("mem_total_bytes"), 100.0)),
    gauge("gpu.temp_c", lambda c: c("temperature_c")),
    gauge("gpu.power_w", lambda c: c("power_w")),
    gauge("gpu.enc_pct", lambda c: c("encoder_util_pct")),
    gauge("gpu.dec_pct", lambda c: c("decoder_util_pct")),
    gauge("gpu.pcie_rx_mbps", lambda c: c("pcie_rx_kbps") * 8 / 1000),
    gauge("gpu.pcie_tx_mbps", lambda c: c("pcie_tx_kbps") * 8 / 1000),
]

CGROUP_COLS = ("cpu_usage_usec", "throttled_usec", "memory_events_oom")
CGROUP = [
    per_second("cgroup.cpu_usage_pct", "cpu_usage_usec", 1e-4),
    per_second("cgroup.cpu_throttled_pct", "throttled_usec", 1e-4),
    per_second("cgroup.mem_events_oom_s", "memory_events_oom"),
    gauge("cgroup.mem_current_mb", lambda c: c("memory_current_bytes") / 1e6),
    gauge("cgroup.cpu_psi_s10", lambda c: F.when(c("cpu_psi_s_valid") != 0, c("cpu_psi_s10"))),
]
MEMORY_COLS = ("direct_reclaim", "nr_reclaimed")
MEMORY = [
    gauge("memv.kswapd", lambda c: c("kswapd_active")), per_second("memv.direct_reclaim_s", "direct_reclaim"), per_second("memv.nr_reclaimed_s", "nr_reclaimed"),
]
OVERHEAD_COLS = ("utime_ns", "stime_ns", "minflt", "majflt", "nvcsw", "nivcsw")
OVERHEAD = [
    Metric("ovh.cpu_pct", lambda d, c, s, ns: 100.0 * (d("utime_ns") + d("stime_ns")) / ns),
    gauge("ovh.rss_mb", lambda c: c("rss_kb") / 1024),
    gauge("ovh.vmhwm_mb", lambda c: c("vmhwm_kb") / 1024),
    per_second("ovh.minflt_s", "minflt"), per_second("ovh.majflt_s", "majflt"), per_second("ovh.vcsw_s", "nvcsw"), per_second("ovh.ivcsw_s", "nivcsw"),
]

DEEP_COLS = ("on_cpu_ns", "nr_sw_vol", "nr_sw_invol", "io_ops", "io_bytes", "pf_minor", "pf_major", "lock_waits", "lock_lat_ns", "syscall_count",
             "syscall_lat_ns", "futex_waits", "futex_lat_ns", "runq_wait_count", "runq_wait_ns")


def _deep(mid: str, value, cols=DEEP_COLS) -> Metric:
    return Metric(mid, value, tuple(cols))


def deep_metrics(cols: Sequence[str] = DEEP_COLS) -> list[Metric]:
    """The per-thread metrics whose columns are present; any shrinking column breaks all."""
    rate = lambda c, f=1.0: (lambda d, c_, s, ns: F.lit(f) * d(c) / s)
    mean_ms = lambda lat, n: (lambda d, c, s, ns: _ratio(d(lat), d(n)) / 1e6)
    table = [
        ("cpu_pct", lambda d, c, s, ns: 100.0 * d("on_cpu_ns") / ns, ("on_cpu_ns",)),
        ("switch_s", lambda d, c, s, ns: (d("nr_sw_vol") + d("nr_sw_invol")) / s, ("nr_sw_vol", "nr_sw_invol")),
        ("io_ops_s", rate("io_ops"), ("io_ops",)),
        ("io_mbs", rate("io_bytes", 1e-6), ("io_bytes",)),
        ("fault_s", rate("pf_minor"), ("pf_minor",)),
        ("majpf_s", rate("pf_major"), ("pf_major",)),
        ("lock_s", rate("lock_waits"), ("lock_waits",)),
        ("lock_avg_ms", mean_ms("lock_lat_ns", "lock_waits"), ("lock_lat_ns", "lock_waits")),
        ("sys_s", rate("syscall_count"), ("syscall_count",)),
        ("sys_avg_ms", mean_ms("syscall_lat_ns", "syscall_count"), ("syscall_lat_ns", "syscall_count")),
        ("futex_s", rate("futex_waits"), ("futex_waits",)),
        ("futex_avg_ms", mean_ms("futex_lat_ns", "futex_waits"), ("futex_lat_ns", "futex_waits")),
        ("runq_s", rate("runq_wait_count"), ("runq_wait_count",)),
        ("runq_avg_ms", mean_ms("runq_wait_ns", "runq_wait_count"), ("runq_wait_ns", "runq_wait_count")),
    ]
    return [_deep(mid, value, cols) for mid, value, needs in table if set(needs) <= set(cols)]


def process_cpu_rss(df: DataFrame, chunk: Column, unit_ns: float = 1.0) -> DataFrame:
    """Per process and tick, CPU % summed over its threads and RSS in MB. ``unit_ns``: nanoseconds per utime unit.

    Integer steps are summed per length of the time step before any division,
    and the few lengths of a tick are added in order, so the answer does not
    depend on the order of the threads.
    """
    tgid = F.coalesce(F.nullif(F.col("tgid"), F.lit(0)), F.col("pid"))
    base = df.withColumn("tgid", tgid)
    prev = ordered.previous(base, ["tgid", "pid"], ["ts_ns"], {"p_utime": "utime", "p_stime": "stime", "p_ts_ns": "ts_ns"}, chunk)
    dt = F.col("ts_ns") - F.col("p_ts_ns")
    steps = prev.where((_d("utime") >= 0) & (_d("stime") >= 0) & (dt != 0))
    steps = steps.groupBy("tgid", "ts_ns", dt.alias("dt")).agg(F.sum(_d("utime") + _d("stime")).alias("n"))
    terms = F.array_sort(F.collect_list(F.struct("dt", (100.0 * unit_ns * F.col("n") / F.col("dt")).alias("y"))))
    cpu = steps.groupBy("tgid", "ts_ns").agg(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["y"]).alias("y"))
    rss = base.groupBy("tgid", "ts_ns").agg((F.max("rss_kb") / 1024).alias("y"))
    return cpu.select("tgid", "ts_ns", F.lit("cpu_pct").alias("mid"), "y").unionByName(rss.select("tgid", "ts_ns", F.lit("rss_mb").alias("mid"), "y"))


def top_threads(df: DataFrame, rank_col: str, n: int, chunk: Column) -> DataFrame:
    """Threads by the sum of their positive steps of ``rank_col``; ties by tid."""
    prev = ordered.previous(df, ["tid"], ["ts_ns"], {"__p": rank_col}, chunk)
    total = prev.groupBy("tid").agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col(rank_col) - F.col("__p"))), F.lit(0)).alias("total"))
    return total.orderBy(F.desc("total"), "tid").limit(n)


def group_aggregate(
    df: DataFrame, mode: str, metrics: Sequence[Metric], cols: Sequence[str], chunk: Column, sel: Sequence[int] | None = None, n: int = 5
) -> DataFrame:
    """C17: rates per thread (``tid``), or per process (``pid``, ``top``) after summing the cumulative columns per tick.

    ``top`` ranks threads by their on-CPU time (else I/O operations), takes
    ``n``, and keeps their processes.
    """
    if mode == "tid":
        chosen = df if sel is None else df.where(F.col("tid").isin(*sel))
        return derive(chosen, ["tid"], metrics, cols, chunk)
    if mode == "top":
        best = top_threads(df, "on_cpu_ns" if "on_cpu_ns" in cols else "io_ops", n, chunk)
        pids = df.join(best.select("tid"), "tid", "left_semi").select("tgid").distinct()
        df = df.join(pids, "tgid", "left_semi")
    elif mode == "pid":
        df = df if sel is None else df.where(F.col("tgid").isin(*sel))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    summed = df.groupBy("tgid", "ts_ns").agg(*[F.sum(c).alias(c) for c in cols])
    return derive(summed, ["tgid"], metrics, cols, chunk)


def family_top(df: DataFrame, key: str, n: int = 5, sel: Sequence | None = None, x: str = "ts_ns", y: str = "y") -> DataFrame:
    """Series ranked by their last value; ties by key."""
    last = df.groupBy(key).agg(F.max_by(y, x).alias("last"))
    if sel is not None:
        return last.where(F.col(key).isin(*sel)).orderBy(F.desc("last"), key)
    return last.orderBy(F.desc("last"), key).limit(n)


def enrich_threads(samples: DataFrame, targets_log: DataFrame) -> DataFrame:
    """Process of each thread from its join records, 0 where unknown."""
    joined = targets_log.where(F.col("action") == "join").groupBy("tid").agg(F.max("tgid").alias("__tgid"))
    return samples.join(joined, "tid", "left").withColumn("tgid", F.coalesce("__tgid", F.lit(0))).drop("__tgid")


def event_timeline(memory: DataFrame, oom: DataFrame, targets: DataFrame) -> DataFrame:
    """C20: kswapd, oom, join and leave markers."""
    who = lambda id_col: F.concat(F.coalesce("comm", F.lit("")), F.lit("("), F.col(id_col).cast("string"), F.lit(")"))
    k = memory.where(F.col("kswapd_active") != 0).select("ts_ns", F.lit("kswapd").alias("kind"), F.lit("kswapd active").alias("label"))
    o = oom.select("ts_ns", F.lit("oom").alias("kind"), F.concat(F.lit("OOM "), who("pid")).alias("label"))
    mark = F.when(F.col("action") == "leave", "leave").otherwise("join")
    t = targets.select("ts_ns", mark.alias("kind"), F.concat(F.when(mark == "join", "+").otherwise("-"), who("tid")).alias("label"))
    return k.unionByName(o).unionByName(t)


def episode_bands(episodes: DataFrame, max_ts: Column) -> DataFrame:
    """[start, end or newest sample] per episode with a start; running without a usable end."""
    m = F.from_json("meta_json", "struct<anomaly_start_ts:long,anomaly_end_ts:long>")
    e = episodes.withColumn("m", m).select("ordinal", F.col("m.anomaly_start_ts").alias("start_ns"), F.nullif(F.col("m.anomaly_end_ts"), F.lit(0)).alias("end"))
    return e.select("ordinal", "start_ns", F.when(F.col("start_ns").isNotNull(), F.coalesce("end", max_ts)).alias("end_ns"), F.col("end").isNull().alias("running"))


def deep_trends(series: DataFrame, chunk: Column, cols: Sequence[str] = DEEP_COLS, n: int = 8) -> DataFrame:
    """All thread metrics of the ``n`` threads with the most on-CPU time."""
    best = top_threads(series, "on_cpu_ns", n, chunk)
    kept = series.join(best.select("tid"), "tid", "left_semi")
    return derive(kept, ["tid"], deep_metrics(cols), cols, chunk)
