"""Collector messages: feature vectors and evidence bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.operators import ordered
from telemill.session import cut, pin

# Channel path in the message, metric, group, kind (c = cumulative, g = gauge).
HOST_CHANNELS = [
    ("host.total.user", "cpu_user", "cpu", "c"),
    ("host.total.system", "cpu_sys", "cpu", "c"),
    ("host.total.iowait", "cpu_iowait", "cpu", "c"),
    ("host.disks.io_ticks_ms", "io_ticks", "io", "c"),
    ("host.disks.weighted_ticks_ms", "io_wticks", "io", "c"),
    ("host.disks.ios_in_flight", "io_inflight", "io", "g"),
    ("host.psi.io", "psi_io", "io", "g"),
    ("host.mem.mem_free_kb", "mem_free", "mem", "g"),
    ("host.mem.mem_available_kb", "mem_avail", "mem", "g"),
    ("host.vm.pgmajfault", "pgmajfault", "mem", "c"),
    ("host.vm.pgscan_kswapd", "pgscan_kswapd", "mem", "c"),
    ("host.psi.memory", "psi_mem", "mem", "g"),
    ("host.ctxt", "ctxt", "lock", "c"),
    ("host.procs_running", "procs_running", "lock", "g"),
    ("host.psi.cpu", "psi_cpu", "lock", "g"),
    ("ebpf.lock_waits_total", "lock_waits", "lock", "c"),
    ("ebpf.switch_total", "switches", "lock", "c"),
    ("network.rx_bytes", "net_rx", "net", "c"),
    ("network.tx_bytes", "net_tx", "net", "c"),
]
PROC_CHANNELS = [
    ("utime", "cpu_user", "cpu", "c"),
    ("stime", "cpu_sys", "cpu", "c"),
    ("nvcsw", "nvcsw", "lock", "c"),
    ("nivcsw", "nivcsw", "lock", "c"),
    ("minflt", "minflt", "mem", "c"),
    ("majflt", "majflt", "mem", "c"),
    ("rss_kb", "rss", "mem", "g"),
    ("read_bytes", "io_read", "io", "c"),
    ("write_bytes", "io_write", "io", "c"),
    ("run_delay_ns", "run_delay", "lock", "c"),
    ("syscr", "syscr", "cpu", "c"),
    ("syscw", "syscw", "cpu", "c"),
]

_D, _S, _L = T.DoubleType(), T.StringType(), T.LongType()


def _st(**f):
    return T.StructType([T.StructField(n, t) for n, t in f.items()])


_TASK = _st(pid=_L, tgid=_L, comm=_S, **{c[0]: _D for c in PROC_CHANNELS})
FEATURES = _st(
    seq=_L,
    ts_ns=_L,
    host=_st(
        total=_st(user=_D, system=_D, iowait=_D),
        disks=T.ArrayType(_st(io_ticks_ms=_D, weighted_ticks_ms=_D, ios_in_flight=_D)),
        psi=_st(io=_S, memory=_S, cpu=_S),
        mem=_st(mem_free_kb=_D, mem_available_kb=_D),
        vm=_st(pgmajfault=_D, pgscan_kswapd=_D),
        ctxt=_D,
        procs_running=_D,
    ),
    ebpf=_st(
        **{c: _D for c in ("on_cpu_ns_total", "switch_total", "io_ops_total", "io_bytes_total", "minor_faults_total", "major_faults_total", "lock_waits_total")},
        per_tid=T.ArrayType(
            _st(tid=_L, **{c: _L for c in ("on_cpu_ns", "nr_sw_vol", "nr_sw_invol", "io_ops", "io_bytes", "pf_minor", "pf_major", "lock_waits", "lock_lat_ns")})
        ),
    ),
    network=_st(ifaces=T.ArrayType(_st(rx_bytes=_D, tx_bytes=_D)), rx_bytes=_D, tx_bytes=_D),
    top_tasks=T.ArrayType(_TASK),
)


def parse_features(df: DataFrame, column: str = "value") -> DataFrame:
    return pin(df, "m", F.from_json(column, FEATURES)).drop(column)


def _raw(path: str) -> Column:
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.coalesce(x[f], F.lit(0.0)))
    leaf = path.rsplit(".", 1)[1]
    if path.startswith("host.disks."):
        return F.coalesce(total(F.col("m.host.disks"), leaf), F.lit(0.0))
    if path.startswith("network."):
        ifaces = F.col("m.network.ifaces")
        return F.when(F.size(ifaces) > 0, total(ifaces, leaf)).otherwise(F.coalesce(F.col(f"m.network.{leaf}"), F.lit(0.0)))
    if path.startswith("host.psi."):
        text = F.col(f"m.{path}")
        part = lambda k: F.get_json_object(text, f"$.{k}").try_cast("double")
        return F.when(text.startswith("{"), F.coalesce(part("some"), part("avg10"), F.lit(0.0))).otherwise(text.try_cast("double"))
    return F.col(f"m.{path}")


def raw_channels(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per message, entity and channel with the raw reading."""
    row = lambda raw, name, group, kind: F.struct(
        F.lit(name).alias("metric_id"), raw.cast("double").alias("raw"), F.lit(group).alias("grp"), F.lit(kind).alias("kind")
    )
    host = parsed.select(
        *keep, F.coalesce("m.ts_ns", F.lit(0)).alias("ts_ns"), F.lit("host").alias("entity_id"), F.lit("host").alias("entity_type"),
        F.lit(None).cast("string").alias("comm"),
        F.inline(F.array(*[row(_raw(p), n, g, k) for p, n, g, k in HOST_CHANNELS])),
    )
    task = parsed.select(*keep, F.coalesce("m.ts_ns", F.lit(0)).alias("ts_ns"), F.explode("m.top_tasks").alias("t"))
    pid = F.coalesce(F.nullif(F.col("t.pid"), F.lit(0)), F.col("t.tgid"))
    procs = task.where(pid.isNotNull()).select(
        *keep, "ts_ns", F.concat(F.lit("proc"), pid.cast("string")).alias("entity_id"), F.lit("process").alias("entity_type"),
        F.coalesce("t.comm", F.lit("")).alias("comm"),
        F.inline(F.array(*[row(F.col(f"t.{f}"), n, g, k) for f, n, g, k in PROC_CHANNELS])),
    )
    return host.unionByName(procs).where(F.col("raw").isNotNull())


def _steps(wide: DataFrame, keys: list[str], order: list[str], chunk: Column, channels: list[tuple[str, str, str, str]]) -> DataFrame:
    """Long rows (metric_id, value, grp) of a table with one column per channel: gauges as they are, cumulative ones as steps."""
    before = {f"__before_{n}": ("last", F.col(n)) for _, n, _, k in channels if k == "c"}
    seen = ordered.running(wide, keys, order, before, chunk, include_current=False)
    step = lambda n: F.when(F.col(n).isNotNull() & F.col(f"__before_{n}").isNotNull(), F.greatest(F.lit(0.0), F.col(n) - F.col(f"__before_{n}")))
    row = lambda n, g, k: F.struct(F.lit(n).alias("metric_id"), (F.col(n) if k == "g" else step(n)).alias("value"), F.lit(g).alias("grp"))
    kept = [c for c in wide.columns if c not in {n for _, n, _, _ in channels}]
    return seen.select(*kept, F.inline(F.array(*[row(n, g, k) for _, n, g, k in channels]))).where("value IS NOT NULL")


def features_to_points(parsed: DataFrame, source: list[str], order: list[str], chunk: Column | None = None) -> DataFrame:
    """S9 in batch: gauges pass, cumulative channels become max(0, step) and are silent on their first reading.

    Messages are read once, into a table with one column per channel; the
    readings before are found there, one row per message and entity.
    """
    keep = list(dict.fromkeys([*source, *[o for o in order if o != "ts_ns"]]))
    chunk = chunk if chunk is not None else ordered.by_time()
    named = lambda channels, raw: F.struct(*[raw(c[0]).cast("double").alias(c[1]) for c in channels])
    pid = lambda t: F.coalesce(F.nullif(t["pid"], F.lit(0)), t["tgid"])
    entity = lambda t: F.concat(F.lit("proc"), pid(t).cast("string"))
    task = lambda t: F.struct(entity(t).alias("entity_id"), F.coalesce(t["comm"], F.lit("")).alias("comm"), named(PROC_CHANNELS, lambda f: t[f]).alias("r"))
    tasks = F.transform(F.filter("m.top_tasks", lambda t: pid(t).isNotNull()), task)
    read = cut(parsed.select(*keep, F.coalesce("m.ts_ns", F.lit(0)).alias("ts_ns"), named(HOST_CHANNELS, _raw).alias("r"), tasks.alias("tasks")))
    host = read.select(*keep, "ts_ns", F.lit("host").alias("entity_id"), F.lit("host").alias("entity_type"), F.lit(None).cast("string").alias("comm"), "r.*")
    procs = read.select(*keep, "ts_ns", F.explode("tasks").alias("t")).select(
        *keep, "ts_ns", "t.entity_id", F.lit("process").alias("entity_type"), "t.comm", "t.r.*"
    )
    both = _steps(host, [*source, "entity_id"], order, chunk, HOST_CHANNELS).unionByName(_steps(procs, [*source, "entity_id"], order, chunk, PROC_CHANNELS))
    attrs = F.map_filter(F.create_map(F.lit("group"), "grp", F.lit("comm"), "comm"), lambda k, v: v.isNotNull())
    return both.select(
        *keep, "ts_ns", "entity_id", "entity_type", "metric_id", "value", F.lit(None).cast("string").alias("unit"), F.lit("ebpf").alias("source"),
        F.lit(None).cast("long").alias("sample_interval_ns"), F.lit("observed").alias("quality"), attrs.alias("attrs"),
    )


_TOTALS = ("on_cpu_ns_total", "switch_total", "io_ops_total", "io_bytes_total", "minor_faults_total", "major_faults_total", "lock_waits_total")


def flatten_features(parsed: DataFrame, comms: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(totals, per-thread rows); ``comms`` is K14's newest comm per tid."""
    totals = parsed.select(*keep, F.col("m.ts_ns").alias("ts_ns"), *[F.col(f"m.ebpf.{c}").alias(c) for c in _TOTALS])
    tids = parsed.select(*keep, F.col("m.ts_ns").alias("ts_ns"), F.inline("m.ebpf.per_tid"))
    named = tids.join(comms.select("tid", "comm"), "tid", "left").withColumn("comm", F.coalesce("comm", F.lit("")))
    return totals, named


_EV = "array<struct<ts_ns:long,entity:string,kind:string,name:string,path:string,wait_ns:long,dur_ns:long,errors:long,span_id:string>>"
_EVIDENCE = (
    "struct<anomaly_start_ts:long,anomaly_end_ts:long,deep_indicators:array<struct<type:string,confidence:double>>,"
    "series:array<struct<ts_ns:long,entity:string,entity_type:string,metric:string,value:double>>,"
    f"events:struct<oom:{_EV},syscall:{_EV},lock:{_EV},runq:{_EV},iofile:{_EV}>>"
)


def parse_evidence(df: DataFrame, column: str = "value") -> DataFrame:
    return pin(df, "b", F.from_json(column, _EVIDENCE)).drop(column)


def evidence_points(parsed: DataFrame, keep: list[str]) -> DataFrame:
    s = parsed.select(*keep, F.explode("b.series").alias("s")).where(
        F.col("s.ts_ns").isNotNull() & F.col("s.entity").isNotNull() & F.col("s.metric").isNotNull() & F.col("s.value").isNotNull()
    )
    return s.select(
        *keep, "s.ts_ns", F.col("s.entity").alias("entity_id"), F.coalesce("s.entity_type", F.lit("process")).alias("entity_type"),
        F.col("s.metric").alias("metric_id"), F.col("s.value").alias("value"), F.lit("ebpf").alias("source"), F.lit("observed").alias("quality"),
    )


def _event(parsed: DataFrame, keep: list[str], kind: str) -> DataFrame:
    e = parsed.select(*keep, F.explode(f"b.events.{kind}").alias("e"))
    return e.select(*keep, "e", F.coalesce("e.ts_ns", F.lit(0)).alias("ts_ns"), F.coalesce("e.entity", F.lit("host")).alias("entity_id"))


def evidence_logs(parsed: DataFrame, keep: list[str]) -> DataFrame:
    base = F.element_at(F.split(F.coalesce("e.path", F.lit("file")), "/"), -1)
    templates = {
        "oom": F.concat(F.lit("oom_"), F.coalesce("e.kind", F.lit("event"))),
        "syscall": F.concat(F.lit("syscall_"), F.coalesce("e.name", F.lit("unknown"))),
        "iofile": F.concat(F.lit("io_"), base),
    }
    out = None
    for kind, template in templates.items():
        part = _event(parsed, keep, kind).select(*keep, "ts_ns", "entity_id", template.alias("template_id"))
        out = part if out is None else out.unionByName(part)
    return out


def evidence_spans(parsed: DataFrame, keep: list[str]) -> DataFrame:
    out = None
    for kind, status in (("runq", "OK"), ("lock", "ERR"), ("iofile", "OK")):
        dur = F.greatest(F.lit(0), F.coalesce("e.wait_ns", "e.dur_ns", F.lit(0)))
        part = _event(parsed, keep, kind).select(
            *keep, F.concat(F.lit(f"deep-{kind}-"), F.col("ts_ns").cast("string")).alias("trace_id"),
            F.coalesce("e.span_id", F.col("ts_ns").cast("string")).alias("span_id"), F.col("entity_id").alias("service_name"),
            F.col("ts_ns").alias("start_ts_ns"), (F.col("ts_ns") + dur).alias("end_ts_ns"),
            F.when(F.coalesce("e.errors", F.lit(0)) != 0, "ERR").otherwise(status).alias("status"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def evidence_incident(parsed: DataFrame, keep: list[str]) -> DataFrame:
    start, end = F.coalesce("b.anomaly_start_ts", F.lit(0)), F.coalesce("b.anomaly_end_ts", F.lit(0))
    valid = parsed.where((start != 0) & (end != 0) & (end >= start))
    given = F.transform(
        "b.deep_indicators",
        lambda i: F.struct(F.coalesce(i["type"], F.lit("cpu")).alias("key"), F.coalesce(i["confidence"], F.lit(0.9)).alias("value")),
    )
    keys = F.array_distinct(F.transform(given, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(given, lambda e: e["key"] == k), -1)["value"]
    scores = F.when(F.size("b.deep_indicators") > 0, F.map_from_arrays(keys, F.transform(keys, last))).otherwise(
        F.create_map(F.lit("cpu"), F.lit(0.9))
    )
    return valid.select(
        *keep, F.concat(F.lit("inc-"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("-deep")).alias("incident_id"),
        start.alias("start_ts_ns"), end.alias("end_ts_ns"), start.alias("detected_at_ns"), F.lit("anomaly").alias("status"),
        F.lit(0.9).alias("severity"), scores.alias("metric_scores"), F.transform_values(scores, lambda k, v: F.lit("up")).alias("directions"),
        F.lit("collector").alias("model_version"),
    )


def evidence_to_modalities(parsed: DataFrame, keep: list[str]) -> dict[str, DataFrame]:
    """Points, logs, spans and the incident of evidence bundles."""
    return {
        "points": evidence_points(parsed, keep),
        "logs": evidence_logs(parsed, keep),
        "spans": evidence_spans(parsed, keep),
        "incident": evidence_incident(parsed, keep),
    }
