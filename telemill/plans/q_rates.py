"""Registered queries of the counter and rate family. ``ticks`` stands in for the session tables."""

from pyspark.sql import functions as F

from telemill.operators import ordered, rates
from telemill.plans.registry import DAY, cte, points, query, r6, ticks

_PREV = ", ".join(f"lag(c{j}) OVER w AS p{j}" for j in range(10))
cte("tp", f"SELECT *, {_PREV}, lag(ts_ns) OVER w AS pt, (ts_ns - lag(ts_ns) OVER w) / 1e9 AS s FROM ticks WINDOW w AS (PARTITION BY tid ORDER BY ts_ns)", ("ticks",))
cte(
    "tpv",
    f"SELECT *, {_PREV}, lag(ts_ns) OVER w AS pt, (ts_ns - lag(ts_ns) OVER w) / 1e9 AS s FROM ticks WHERE valid = 1 WINDOW w AS (PARTITION BY tid ORDER BY ts_ns)",
    ("ticks",),
)
CH = lambda: ordered.by_time("ts_ns", 8 * DAY)
D = lambda j: f"(c{j} - p{j})"


def _long(metrics, src="tp", key="tid"):
    """metrics: (mid, expression, guard)."""
    return " UNION ALL ".join(
        f"SELECT {key} AS key, ts_ns, '{m}' AS mid, round({e}, 6) AS y FROM {src} WHERE {g} AND ({e}) IS NOT NULL" for m, e, g in metrics
    )


def _mono(*js):
    return "pt IS NOT NULL AND " + " AND ".join(f"{D(j)} >= 0" for j in js)


def _rate(m, j, f=1.0):
    return (m, f"{f!r}::DOUBLE * {D(j)} / s", _mono(j))


def _named(spark, sf, names):
    return ticks(spark, sf).withColumnsRenamed({f"c{j}": n for j, n in enumerate(names)})


def _out(df, key="tid"):
    return df.select(F.col(key).alias("key"), "ts_ns", "mid", r6("y").alias("y"))


@query(
    "c1_counter_rate",
    _long([(f"c{j}_s", f"{D(j)} / s", _mono(0, 1, 2)) for j in range(2)]),
    ("tp",),
)
def c1(spark, sf):
    return _out(rates.counter_rate(ticks(spark, sf), ["tid"], ["c0", "c1"], ["c0", "c1", "c2"], CH()))


_G = ["c0", "c1", "c2", "c3", "c4", "c5", "c6", "c7", "c8", "c9"]
_PSI_SQL = [
    (f"host.psi.{g}.{k}.avg{w}", f"(c{j} + {w})::DOUBLE", "valid = 1")
    for j, g in enumerate(("cpu", "io", "mem")) for k in ("some", "full") for w in (10, 60, 300)
]


@query(
    "c2_gauges",
    _long(
        [("host.load.load1", "gauge", "true"), ("host.load.load5", "gauge / 5", "true"), ("host.load.load15", "gauge / 15", "true"), ("host.load.nr_running", "n::DOUBLE", "true"),
         ("host.load.nr_threads", "(n * 3)::DOUBLE", "true"), ("host.mem.used_pct", "100.0::DOUBLE * (c0 - c1) / nullif(c0, 0)", "true"),
         ("host.mem.swap_used_pct", "100.0::DOUBLE * (c2 - c3) / nullif(c2, 0)", "true"), ("host.mem.cached_mb", "c4 / 1024", "true"),
         ("host.mem.buffers_mb", "c5 / 1024", "true"), ("host.mem.anon_mb", "c6 / 1024", "true"), ("host.mem.avail_mb", "c1 / 1024", "true"), *_PSI_SQL],
        "ticks",
    ),
    ("ticks",),
)
def c2(spark, sf):
    t = ticks(spark, sf)
    cols = {"load1": F.col("gauge"), "load5": F.col("gauge") / 5, "load15": F.col("gauge") / 15, "nr_running": F.col("n"), "nr_threads": F.col("n") * 3,
            "mem_total_kb": F.col("c0"), "mem_avail_kb": F.col("c1"), "swap_total_kb": F.col("c2"), "swap_free_kb": F.col("c3"),
            "cached_kb": F.col("c4"), "buffers_kb": F.col("c5"), "anon_pages_kb": F.col("c6")}
    for j, g in enumerate(("cpu", "io", "mem")):
        for k in "sf":
            cols[f"psi_{g}_{k}_valid"] = F.col("valid")
            for w in (10, 60, 300):
                cols[f"psi_{g}_{k}{w}"] = (F.col(f"c{j}") + w).cast("double")
    return _out(rates.derive(t.withColumns(cols), ["tid"], rates.GAUGES, (), CH()))


_ALL = " + ".join(D(j) for j in range(10))
_CPU = lambda m, js: (m, f"100.0::DOUBLE * ({' + '.join(D(j) for j in js)}) / nullif({_ALL}, 0)", _mono(*range(10)))


@query(
    "c3_host_cpu_pct",
    _long([_CPU("host.cpu.usage_pct", (0, 1, 2, 4, 5, 6, 7)), _CPU("host.cpu.user_pct", (0, 1)), _CPU("host.cpu.sys_pct", (2,)), _CPU("host.cpu.iowait_pct", (4,)), _CPU("host.cpu.irq_pct", (5, 6))]),
    ("tp",),
)
def c3(spark, sf):
    return _out(rates.derive(_named(spark, sf, rates.CPU), ["tid"], rates.HOST_CPU, rates.CPU, CH()))


@query("c4_vm_rates", _long([_rate(f"host.vm.{m}_s", j) for j, m in enumerate(("pgfault", "pgmajfault", "pswpin", "pswpout"))]), ("tp",))
def c4(spark, sf):
    cols = ("vm_pgfault", "vm_pgmajfault", "vm_pswpin", "vm_pswpout")
    return _out(rates.derive(_named(spark, sf, cols), ["tid"], rates.VM, cols, CH()))


_A8 = " + ".join(D(j) for j in range(8))


@query("c5_core_usage", _long([("host.cpu.core.usage_pct", f"100.0::DOUBLE * (1 - {D(3)}::DOUBLE / ({_A8}))", f"pt IS NOT NULL AND ({_A8}) > 0")]), ("tp",))
def c5(spark, sf):
    return _out(rates.derive(_named(spark, sf, rates.CORE), ["tid"], rates.CORE_USAGE, rates.CORE, CH()))


@query(
    "c6_disk",
    _long([
        _rate("host.disk.read_mbs", 0, 512 / 1e6), _rate("host.disk.write_mbs", 1, 512 / 1e6), _rate("host.disk.util_pct", 2, 0.1),
        ("host.disk.read_await_ms", f"{D(5)} / {D(3)}", _mono(5) + f" AND {D(3)} > 0"), ("host.disk.write_await_ms", f"{D(6)} / {D(4)}", _mono(6) + f" AND {D(4)} > 0"),
    ]),
    ("tp",),
)
def c6(spark, sf):
    return _out(rates.derive(_named(spark, sf, rates.DISK_COLS), ["tid"], rates.DISK, rates.DISK_COLS, CH()))


@query(
    "c7_process_cpu_rss",
    f"""
SELECT key, ts_ns, 'cpu_pct' AS mid, round(sum(1e8 * n / dt ORDER BY dt), 6) AS y FROM (
  SELECT CASE WHEN tgid = 0 THEN tid ELSE tgid END AS key, ts_ns, ts_ns - pt AS dt, sum({D(0)} + {D(1)})::DOUBLE AS n FROM tp WHERE {_mono(0, 1)} AND ts_ns <> pt GROUP BY ALL) GROUP BY ALL
UNION ALL SELECT CASE WHEN tgid = 0 THEN tid ELSE tgid END, ts_ns, 'rss_mb', round(max(c2) / 1024, 6) FROM tp GROUP BY ALL
""",
    ("tp",),
)
def c7(spark, sf):
    t = _named(spark, sf, ("utime", "stime", "rss_kb")).withColumnRenamed("tid", "pid")
    return _out(rates.process_cpu_rss(t, CH(), 1e6), "tgid")


@query(
    "c8_activity",
    _long([
        ("ebpf.busy_pct", f"100.0::DOUBLE * {D(0)} / (ts_ns - pt)", _mono(0)), _rate("ebpf.switches_s", 1), ("ebpf.faults_s", f"({D(2)} + {D(3)}) / s", _mono(2)),
        _rate("ebpf.io_ops_s", 4), _rate("ebpf.io_mbs", 5, 1e-6), _rate("ebpf.lock_waits_s", 6),
    ]),
    ("tp",),
)
def c8(spark, sf):
    return _out(rates.derive(_named(spark, sf, rates.ACTIVITY_COLS), ["tid"], rates.ACTIVITY, rates.ACTIVITY_COLS, CH()))


@query("c9_net_iface", _long([_rate(f"net.iface.{m}", j, f) for j, (_, m, f) in enumerate(rates._IFACE)], "tpv"), ("tpv",))
def c9(spark, sf):
    from telemill.operators.quality import gate_valid

    t = gate_valid(_named(spark, sf, rates.IFACE_COLS))
    return _out(rates.derive(t, ["tid"], rates.IFACE, rates.IFACE_COLS, CH()))


_STACK = [(c, j % 8) for j, c in enumerate(rates.STACK_COLS)]


@query(
    "c10_net_stack",
    _long([_rate(f"net.tcp.{c}_s", j) for c, j in _STACK] + [("net.tcp.curr_estab", "c8::DOUBLE", "pt IS NOT NULL"), ("net.tcp.sock_mem_kb", "(c9 * 4)::DOUBLE", "pt IS NOT NULL")]),
    ("tp",),
)
def c10(spark, sf):
    t = ticks(spark, sf).withColumns({c: F.col(f"c{j}") for c, j in _STACK}).withColumnsRenamed({"c8": "curr_estab", "c9": "tcp_sock_mem"})
    return _out(rates.derive(t, ["tid"], rates.STACK, rates.STACK_COLS, CH()))


@query("c11_softnet", _long([("net.softnet.backlog_len", "c9::DOUBLE", "true")] + [_rate(f"net.softnet.{c}_s", j) for j, c in enumerate(rates.SOFTNET_COLS)]), ("tp",))
def c11(spark, sf):
    t = _named(spark, sf, rates.SOFTNET_COLS).withColumnRenamed("c9", "backlog_len")
    return _out(rates.derive(t, ["tid"], rates.SOFTNET, rates.SOFTNET_COLS, CH()))


@query(
    "c12_gpu",
    _long([
        ("gpu.util_pct", "gauge", "valid = 1"), ("gpu.mem_used_mb", "c0 / 1e6", "valid = 1"), ("gpu.mem_pct", "100.0::DOUBLE * c0 / nullif(c1, 0)", "valid = 1"),
        ("gpu.temp_c", "c2::DOUBLE", "valid = 1"), ("gpu.power_w", "c3::DOUBLE", "valid = 1"), ("gpu.enc_pct", "c4::DOUBLE", "valid = 1"), ("gpu.dec_pct", "c5::DOUBLE", "valid = 1"),
        ("gpu.pcie_rx_mbps", "c6 * 8 / 1000", "valid = 1"), ("gpu.pcie_tx_mbps", "c7 * 8 / 1000", "valid = 1"),
    ], "ticks"),
    ("ticks",),
)
def c12(spark, sf):
    from telemill.operators.quality import gate_valid

    names = ("mem_used_bytes", "mem_total_bytes", "temperature_c", "power_w", "encoder_util_pct", "decoder_util_pct", "pcie_rx_kbps", "pcie_tx_kbps")
    t = gate_valid(_named(spark, sf, names).withColumnRenamed("gauge", "util_pct"))
    return _out(rates.derive(t, ["tid"], rates.GPU, (), CH()))


@query(
    "c13_cgroup",
    _long([_rate("cgroup.cpu_usage_pct", 0, 1e-4), _rate("cgroup.cpu_throttled_pct", 1, 1e-4), _rate("cgroup.mem_events_oom_s", 2),
           ("cgroup.mem_current_mb", "c3 / 1e6", "true"), ("cgroup.cpu_psi_s10", "gauge", "valid = 1")]),
    ("tp",),
)
def c13(spark, sf):
    t = _named(spark, sf, (*rates.CGROUP_COLS, "memory_current_bytes")).withColumnsRenamed({"gauge": "cpu_psi_s10", "valid": "cpu_psi_s_valid"})
    return _out(rates.derive(t, ["tid"], rates.CGROUP, rates.CGROUP_COLS, CH()))


@query("c14_memory_events", _long([("memv.kswapd", "valid::DOUBLE", "true"), _rate("memv.direct_reclaim_s", 0), _rate("memv.nr_reclaimed_s", 1)]), ("tp",))
def c14(spark, sf):
    t = _named(spark, sf, rates.MEMORY_COLS).withColumnRenamed("valid", "kswapd_active")
    return _out(rates.derive(t, ["tid"], rates.MEMORY, rates.MEMORY_COLS, CH()))


@query(
    "c15_overhead",
    _long([("ovh.cpu_pct", f"100.0::DOUBLE * ({D(0)} + {D(1)}) / (ts_ns - pt)", "pt IS NOT NULL"), ("ovh.rss_mb", "c6 / 1024", "true"), ("ovh.vmhwm_mb", "c7 / 1024", "true"),
           _rate("ovh.minflt_s", 2), _rate("ovh.majflt_s", 3), _rate("ovh.vcsw_s", 4), _rate("ovh.ivcsw_s", 5)]),
    ("tp",),
)
def c15(spark, sf):
    t = _named(spark, sf, (*rates.OVERHEAD_COLS, "rss_kb", "vmhwm_kb"))
    return _out(rates.derive(t, ["tid"], rates.OVERHEAD, rates.OVERHEAD_COLS, CH()))


# fifteen deep columns over ten counters: the last five repeat the first five
_J = {c: j % 10 for j, c in enumerate(rates.DEEP_COLS)}
_DM = _mono(*range(10))
_N = lambda c: D(_J[c])
_MEAN = lambda m, a, b: (m, f"{_N(a)} / nullif({_N(b)}, 0) / 1e6", _DM)
_DEEP_SQL = [
    ("cpu_pct", f"100.0::DOUBLE * {_N('on_cpu_ns')} / (ts_ns - pt)", _DM), ("switch_s", f"({_N('nr_sw_vol')} + {_N('nr_sw_invol')}) / s", _DM),
    ("io_ops_s", f"{_N('io_ops')} / s", _DM), ("io_mbs", f"{_N('io_bytes')} / 1e6 / s", _DM), ("fault_s", f"{_N('pf_minor')} / s", _DM), ("majpf_s", f"{_N('pf_major')} / s", _DM),
    ("lock_s", f"{_N('lock_waits')} / s", _DM), _MEAN("lock_avg_ms", "lock_lat_ns", "lock_waits"), ("sys_s", f"{_N('syscall_count')} / s", _DM),
    _MEAN("sys_avg_ms", "syscall_lat_ns", "syscall_count"), ("futex_s", f"{_N('futex_waits')} / s", _DM), _MEAN("futex_avg_ms", "futex_lat_ns", "futex_waits"),
    ("runq_s", f"{_N('runq_wait_count')} / s", _DM), _MEAN("runq_avg_ms", "runq_wait_ns", "runq_wait_count"),
]


def deep_series(spark, sf):
    return ticks(spark, sf).select("tid", "tgid", "ts_ns", *[F.col(f"c{j}").alias(c) for c, j in _J.items()])


@query("c16_deep_metrics", _long(_DEEP_SQL), ("tp",))
def c16(spark, sf):
    return _out(rates.derive(deep_series(spark, sf), ["tid"], rates.deep_metrics(), rates.DEEP_COLS, CH()))


_TOT = "SELECT tid, sum(greatest(0, c0 - p0)) AS total FROM tp GROUP BY 1 ORDER BY coalesce(sum(greatest(0, c0 - p0)), 0) DESC, tid"
_SUMJ = ", ".join(f"CAST(sum(c{j}) AS BIGINT) AS c{j}" for j in range(10))


def _group_sql(where, mode):
    per = (
        f"m AS (SELECT * FROM ticks WHERE {where}), g AS (SELECT tgid, ts_ns, {_SUMJ} FROM m GROUP BY ALL), "
        f"gp AS (SELECT *, {_PREV}, lag(ts_ns) OVER w AS pt, (ts_ns - lag(ts_ns) OVER w) / 1e9 AS s FROM g WINDOW w AS (PARTITION BY tgid ORDER BY ts_ns))"
    )
    return f"{per} SELECT '{mode}' AS mode, * FROM ({_long(_DEEP_SQL, 'gp', 'tgid')})"


@query(
    "c17_group_aggregate",
    f"""
SELECT * FROM (WITH {_group_sql('tgid IN (1, 3, 4)', 'pid')})
UNION ALL SELECT * FROM (WITH {_group_sql(f'tgid IN (SELECT tgid FROM ticks WHERE tid IN (SELECT tid FROM ({_TOT} LIMIT 5)))', 'top')})
UNION ALL SELECT 'tid' AS mode, * FROM ({_long(_DEEP_SQL)}) WHERE key IN (3, 8, 50)
""",
    ("tp",),
)
def c17(spark, sf):
    s, m = deep_series(spark, sf), rates.deep_metrics()
    one = lambda mode, key, **kw: _out(rates.group_aggregate(s, mode, m, rates.DEEP_COLS, CH(), **kw), key).withColumn("mode", F.lit(mode))
    return one("pid", "tgid", sel=[1, 3, 4]).unionByName(one("top", "tgid", n=5)).unionByName(one("tid", "tid", sel=[3, 8, 50]))


@query(
    "c18_family_top",
    f"WITH f AS ({_long([_rate('r', 0)])}) SELECT key, arg_max(y, ts_ns) AS last FROM f GROUP BY key ORDER BY last DESC, key LIMIT 5",
    ("tp",),
)
def c18(spark, sf):
    f = _out(rates.counter_rate(ticks(spark, sf), ["tid"], ["c0"], ["c0"], CH()))
    return rates.family_top(f, "key", 5)


@query(
    "c19_enrich_threads",
    """SELECT t.tid, t.ts_ns, coalesce(g, 0) AS tgid FROM ticks t LEFT JOIN (SELECT user_id AS tid, max(k % 40) AS g FROM points WHERE metric_id = 'signup' AND quality <> 'observed' GROUP BY 1) m ON m.tid = t.tid""",
    ("ticks", "points"),
)
def c19(spark, sf):
    log = points(spark, sf).where("metric_id = 'signup'").select(
        F.col("user_id").alias("tid"), (F.col("k") % 40).alias("tgid"), F.when(F.col("quality") == "observed", "leave").otherwise("join").alias("action")
    )
    return rates.enrich_threads(ticks(spark, sf).select("tid", "ts_ns"), log)


@query(
    "c20_event_timeline",
    """SELECT ts_ns, 'kswapd' AS kind, 'kswapd active' AS label FROM points WHERE metric_id = 'view' AND k % 2 <> 0
UNION ALL SELECT ts_ns, 'oom', 'OOM c' || k % 5 || '(' || user_id || ')' FROM points WHERE metric_id = 'error'
UNION ALL SELECT ts_ns, CASE WHEN k % 3 = 0 THEN 'leave' ELSE 'join' END, CASE WHEN k % 3 = 0 THEN '-' ELSE '+' END || 'c' || k % 5 || '(' || user_id || ')' FROM points WHERE metric_id = 'click'""",
    ("points",),
)
def c20(spark, sf):
    p = points(spark, sf)
    comm = F.concat(F.lit("c"), (F.col("k") % 5).cast("string")).alias("comm")
    mem = p.where("metric_id = 'view'").select("ts_ns", (F.col("k") % 2).alias("kswapd_active"))
    oom = p.where("metric_id = 'error'").select("ts_ns", F.col("user_id").alias("pid"), comm)
    tgt = p.where("metric_id = 'click'").select("ts_ns", F.col("user_id").alias("tid"), comm, F.when(F.col("k") % 3 == 0, "leave").otherwise("join").alias("action"))
    return rates.event_timeline(mem, oom, tgt)


@query(
    "c21_episode_bands",
    """
SELECT seq AS ordinal, CASE WHEN k % 5 = 0 THEN NULL ELSE ts_ns END AS start_ns,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 1 THEN ts_ns + k ELSE (SELECT max(ts_ns) FROM points) END AS end_ns, (k % 5 = 0 OR k % 3 <> 1)::INT AS running FROM points
""",
    ("points",),
)
def c21(spark, sf):
    p = points(spark, sf)
    k = F.col("k")
    end = F.when(k % 3 == 0, F.lit(0)).when(k % 3 == 1, F.col("ts_ns") + k)
    meta = F.when(k % 5 != 0, F.to_json(F.struct(F.col("ts_ns").alias("anomaly_start_ts"), end.alias("anomaly_end_ts"))))
    bands = rates.episode_bands(p.select(F.col("seq").alias("ordinal"), meta.alias("meta_json")), p.agg(F.max("ts_ns")).scalar())
    return bands.withColumn("running", F.col("running").cast("int"))


@query(
    "c22_deep_trends",
    f"SELECT * FROM ({_long(_DEEP_SQL)}) WHERE key IN (SELECT tid FROM ({_TOT} LIMIT 8))",
    ("tp",),
)
def c22(spark, sf):
    return _out(rates.deep_trends(deep_series(spark, sf), CH()))
