"""Pairing of raw trace events into durations, counts and hot-spot tables (P family)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.integers import floor_div
from telemill.functions.histograms import hist_percentile_us, latency_stats
from telemill.operators import ordered


def pair(
    df: DataFrame, keys: list[str], order: Sequence, begin: Column, end: Column, chunk: Column, carry: dict[str, str], earliest: bool = False
) -> DataFrame:
    """End rows with a pending begin, plus ``carry`` columns (new name: column) of that begin.

    An end consumes its begin. Of several begins the newest counts, or with
    ``earliest`` the first.
    """
    ev = df.withColumns({"__b": begin, "__e": end}).where("__b OR __e")
    was = {"__was_b": "__b"}
    if not earliest:
        ev = ordered.previous(ev, keys, order, {**was, **carry}, chunk)
        return ev.where(F.col("__e") & F.coalesce("__was_b", F.lit(False))).drop("__b", "__e", "__was_b")
    ev = ordered.previous(ev, keys, order, was, chunk)
    first = F.col("__b") & ~F.coalesce("__was_b", F.lit(False))
    packed = F.when(first, F.struct(*[F.col(c).alias(n) for n, c in carry.items()]))
    ev = ordered.running(ev, keys, order, {"__open": ("last", packed)}, chunk, include_current=False)
    out = ev.where(F.col("__e") & F.coalesce("__was_b", F.lit(False)))
    return out.withColumns({n: F.col("__open")[n] for n in carry}).drop("__b", "__e", "__was_b", "__open")


def _lat(start: str = "begin_ts") -> Column:
    return F.greatest(F.lit(0), F.col("ts_ns") - F.col(start))


def on_cpu_time(switches: DataFrame, chunk: Column, cpu: Sequence[str] = ("cpu",), order: Sequence = ("ts_ns",)) -> DataFrame:
    """Time between switches of a cpu goes to the thread that was switched in before."""
    prev = ordered.previous(switches, list(cpu), list(order), {"__tid": "next_tid", "__ts": "ts_ns"}, chunk)
    ran = prev.where((F.col("__tid") != 0) & (F.col("ts_ns") > F.col("__ts")))
    return ran.groupBy(F.col("__tid").alias("tid")).agg(F.sum(F.col("ts_ns") - F.col("__ts")).alias("on_cpu_ns"))


def switch_counts(switches: DataFrame) -> DataFrame:
    """P2"""
    state = F.col("prev_state")
    sleeps = (state != 0) & (state.bitwiseAND(F.lit(0x7F)) != 0)
    return switches.where("prev_tid <> 0").groupBy(F.col("prev_tid").alias("tid")).agg(
        F.count_if(sleeps).alias("nr_sw_vol"), F.count_if(state == 0).alias("nr_sw_invol")
    )


def off_cpu(switches: DataFrame, chunk: Column, order: Sequence = ("ts_ns", "side")) -> DataFrame:
    """Dwell of each sleep of a thread (rows tid, ts_ns, dwell_ns, stack)."""
    state = F.col("prev_state")
    sleep = (state.bitwiseAND(F.lit(0x7F)) != 0) & (state.bitwiseAND(F.lit(0x180)) == 0)
    extra = [c for c in ("seq",) if c in switches.columns]
    outs = switches.where((F.col("prev_tid") != 0) & sleep).select(F.col("prev_tid").alias("tid"), "ts_ns", *extra, F.col("stack"), F.lit(0).alias("side"))
    ins = switches.where("next_tid <> 0").select(F.col("next_tid").alias("tid"), "ts_ns", *extra, F.lit(None).cast("string").alias("stack"), F.lit(1).alias("side"))
    ev = outs.unionByName(ins)
    p = pair(ev, ["tid"], list(order), F.col("side") == 0, F.col("side") == 1, chunk, {"begin_ts": "ts_ns", "begin_stack": "stack"})
    return p.select("tid", "ts_ns", *extra, _lat().alias("dwell_ns"), F.col("begin_stack").alias("stack"))


def off_cpu_tables(dwell: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sum by thread and stack where a stack is known, statistics by thread where not)."""
    stacked = dwell.where("stack IS NOT NULL").groupBy("tid", "stack").agg(F.sum("dwell_ns").alias("dwell_ns"))
    return stacked, latency_stats(dwell.where("stack IS NULL"), ["tid"], "dwell_ns")


def run_queue_latency(events: DataFrame, chunk: Column, order: Sequence = ("ts_ns",)) -> DataFrame:
    """Earliest pending wakeup to switch-in; ``events`` holds (tid, ts_ns, kind wakeup or switch_in)."""
    p = pair(events, ["tid"], list(order), F.col("kind") == "wakeup", F.col("kind") == "switch_in", chunk, {"begin_ts": "ts_ns"}, earliest=True)
    return p.withColumn("lat_ns", _lat()).drop("begin_ts")


def block_io(events: DataFrame, chunk: Column, order: Sequence = ("ts_ns",)) -> DataFrame:
    """P5: one row per completed request with its latency from issue (0 without an issue).

    ``events``: (req, ts_ns, kind issue or complete, pid, dev, bytes). A
    completion without an issue is kept.
    """
    ev = events.where(F.col("kind").isin("issue", "complete"))
    prev = ordered.previous(ev, ["req"], list(order), {"__k": "kind", "__t": "ts_ns"}, chunk)
    lat = F.when(F.col("__k") == "issue", F.greatest(F.lit(0), F.col("ts_ns") - F.col("__t"))).otherwise(F.lit(0))
    return prev.where("kind = 'complete'").withColumn("lat_ns", lat).drop("__k", "__t")


def io_stats(done: DataFrame, key: str) -> DataFrame:
    """P5: operations, bytes, latency and histogram by ``pid`` or ``dev``."""
    return latency_stats(done, [key], "lat_ns", sums={"bytes": F.col("bytes")}).withColumnRenamed("count", "ops")


def page_faults(events: DataFrame) -> DataFrame:
    """P6"""
    major = F.col("error_code").bitwiseAND(F.lit(0x4)) != 0
    return events.groupBy("tid").agg(F.count_if(~major).alias("pf_minor"), F.count_if(major).alias("pf_major"))


def lock_contention(events: DataFrame, chunk: Column, order: Sequence = ("ts_ns",)) -> DataFrame:
    """Contention waits (tid, lock address of the begin, lat_ns)."""
    p = pair(events, ["tid"], list(order), F.col("kind") == "begin", F.col("kind") == "end", chunk, {"begin_ts": "ts_ns", "begin_addr": "addr"})
    return p.withColumns({"lat_ns": _lat(), "addr": F.col("begin_addr")}).drop("begin_ts", "begin_addr")


FUTEX_ID = 202
_FUTEX_WAITS = (0, 9)  # wait, wait_bitset


def syscalls(events: DataFrame, chunk: Column, order: Sequence = ("ts_ns",)) -> DataFrame:
    """Finished calls (tid, id, futex_wait, lat_ns, ret); ``events``: (tid, ts_ns, kind enter or exit, id, arg1, ret)."""
    p = pair(events, ["tid"], list(order), F.col("kind") == "enter", F.col("kind") == "exit", chunk, {"b_ts": "ts_ns", "b_id": "id", "b_arg": "arg1"})
    op = F.col("b_arg").bitwiseAND(F.lit(~384))  # without the private and realtime flags
    futex = (F.col("b_id") == FUTEX_ID) & op.isin(*_FUTEX_WAITS)
    return p.withColumns({"id": F.col("b_id"), "futex_wait": F.coalesce(futex, F.lit(False)), "lat_ns": _lat("b_ts")}).drop("b_ts", "b_id", "b_arg", "arg1")


def syscall_tables(calls: DataFrame) -> dict[str, DataFrame]:
    """Futex waits by thread; other calls by (tid, id) with log2 bins and errors, and by thread with base-4 bins."""
    other = calls.where("NOT futex_wait")
    return {
        "futex": latency_stats(calls.where("futex_wait"), ["tid"], "lat_ns"),
        "by_call": latency_stats(other, ["tid", "id"], "lat_ns", "log2", {"errors": (F.col("ret") < 0).cast("long")}),
        "by_thread": latency_stats(other, ["tid"], "lat_ns"),
    }


def rate_limit(df: DataFrame, keys: list[str], order: list[str], rate: int, chunk: Column, ts: str = "ts_ns") -> DataFrame:
    """Keep a row if it is the first of its key or (now - last kept) * rate >= 1e9."""
    return ordered.greedy(df, keys, order, ts, None, -(-1_000_000_000 // rate) if rate > 0 else None, chunk)


def sample(df: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """One in ``n`` by a stable hash: the first 32 bits of the MD5 of the columns, joined by ``|`` (null columns are left out)."""
    first = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in by])), 1, 8), 16, 10).cast("long")
    return df.where(first % n == 0)


def tcp_flows(events: DataFrame, chunk: Column, rtt_rate: int = 10, order: Sequence[str] = ("ts_ns",)) -> DataFrame:
    """One row per socket cookie.

    ``events``: (cookie, ts_ns, kind, tid, tgid, srtt_us8, bytes, reason) with
    kinds connect, accept, established, retransmit, reset, close, rtt, tx, rx.
    RTT samples count only on owned sockets and at most ``rtt_rate`` a second.
    """
    kind = F.col("kind")
    start = kind.isin("connect", "accept")
    at = lambda cond: F.min(F.when(cond, F.col("ts_ns")))
    last = lambda c, cond: F.max_by(c, F.when(cond, F.col("ts_ns")))
    flows = events.groupBy("cookie").agg(
        last("tid", start).alias("tid"), last("tgid", start).alias("tgid"), at(start).alias("start_ts_ns"),
        at(kind == "established").alias("established_ts_ns"), F.max(F.when(kind == "close", F.col("ts_ns"))).alias("end_ts_ns"),
        F.count_if(kind == "retransmit").alias("retransmits"), last("reason", kind == "reset").alias("rst_reason"),
        F.sum(F.when(kind == "tx", F.col("bytes")).otherwise(0)).alias("tx_bytes"), F.sum(F.when(kind == "rx", F.col("bytes")).otherwise(0)).alias("rx_bytes"),
    )
    owned = flows.where("start_ts_ns IS NOT NULL").select("cookie", "start_ts_ns")
    rtt = events.where(kind == "rtt").join(owned, "cookie").where("ts_ns >= start_ts_ns").select("cookie", "ts_ns", "srtt_us8", *[o for o in order if o != "ts_ns"])
    kept = rate_limit(rtt, ["cookie"], list(order), rtt_rate, chunk)
    rtts = kept.groupBy("cookie").agg(F.count(F.lit(1)).alias("rtt_count"), F.sum(F.shiftright("srtt_us8", 3)).alias("__s"))
    j = flows.join(rtts, "cookie", "left").withColumn("rtt_count", F.coalesce("rtt_count", F.lit(0)))
    lat = F.when(F.col("established_ts_ns") > F.col("start_ts_ns"), F.floor((F.col("established_ts_ns") - F.col("start_ts_ns")) / 1000)).otherwise(0)
    return j.withColumns({
        "connect_latency_us": lat.cast("long"),
        "rtt_avg_us": F.when(F.col("rtt_count") > 0, F.floor(F.col("__s") / F.col("rtt_count"))).otherwise(0).cast("long"),
        "closed": F.col("end_ts_ns").isNotNull(), "owner_available": F.coalesce(F.col("tid") != 0, F.lit(False)),
    }).drop("__s")


def packet_drops(events: DataFrame) -> DataFrame:
    """P10"""
    return events.groupBy("netns", "ifindex", "reason").agg(F.count(F.lit(1)).alias("count"))


def softirq_time(events: DataFrame, chunk: Column, order: Sequence = ("ts_ns",)) -> DataFrame:
    """Network softirq (vectors 2 and 3) time per cpu and vector of the exit; one entry is pending per cpu."""
    net = events.where(F.col("vector").isin(2, 3))
    p = pair(net, ["cpu"], list(order), F.col("kind") == "entry", F.col("kind") == "exit", chunk, {"begin_ts": "ts_ns"})
    return latency_stats(p.withColumn("lat_ns", _lat()), ["cpu", "vector"], "lat_ns").withColumnRenamed("lat_sum", "time_ns")


def file_io(events: DataFrame, chunk: Column, order: Sequence = ("ts_ns",)) -> DataFrame:
    """Per (dev, ino, path); a result above 0 adds bytes and an operation, any other an error."""
    p = pair(events, ["tid"], list(order), F.col("kind") == "enter", F.col("kind") == "exit", chunk,
             {"b_ts": "ts_ns", "b_dev": "dev", "b_ino": "ino", "b_path": "path"})
    calls = p.select(F.col("b_dev").alias("dev"), F.col("b_ino").alias("ino"), F.col("b_path").alias("path"), "ret", _lat("b_ts").alias("lat_ns"))
    ok = F.col("ret") > 0
    sums = {"bytes": F.when(ok, F.col("ret")).otherwise(0), "ops": ok.cast("long"), "errors": (~ok).cast("long")}
    return latency_stats(calls, ["dev", "ino", "path"], "lat_ns", sums=sums).drop("count")


def memory_reclaim(events: DataFrame, keys: list[str], chunk: Column, order: Sequence = ("ts_ns",)) -> DataFrame:
    """Kswapd flag, direct reclaims and reclaimed pages so far, only where one of them changed.

    ``events``: (ts_ns, kind kswapd_wake, kswapd_sleep, direct_begin or direct_end, reclaimed).
    """
    kind = F.col("kind")
    active = F.when(kind == "kswapd_wake", 1).when(kind == "kswapd_sleep", 0)
    state = ordered.running(
        events, keys, list(order),
        {
            "kswapd_active": ("last", active),
            "direct_reclaim": ("sum", (kind == "direct_begin").cast("long")),
            "nr_reclaimed": ("sum", F.when(kind == "direct_end", F.coalesce("reclaimed", F.lit(0))).otherwise(0)),
        },
        chunk,
    ).withColumn("kswapd_active", F.coalesce("kswapd_active", F.lit(0)))
    cols = ("kswapd_active", "direct_reclaim", "nr_reclaimed")
    prev = ordered.previous(state, keys, list(order), {f"__{c}": c for c in cols}, chunk)
    changed = None
    for c in cols:
        d = F.col(c) != F.coalesce(F.col(f"__{c}"), F.lit(0))
        changed = d if changed is None else changed | d
    return prev.where(changed).select(*keys, *[o for o in order if isinstance(o, str)], *cols)


def oom_events(events: DataFrame) -> DataFrame:
    """P14"""
    return events.where("kind = 'oom'").select("ts_ns", "pid")


def profile_counts(samples: DataFrame) -> DataFrame:
    """P17"""
    return samples.groupBy("pid", "tid", "user_stack", "kernel_stack").agg(F.count(F.lit(1)).alias("count"))


def target_gate(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events of member threads; the planner broadcasts the member list when it is small."""
    return events.join(members.select("tid").distinct(), "tid", "left_semi")


def target_gate_asof(events: DataFrame, intervals: DataFrame, bucket: int) -> DataFrame:
    """Events while their thread was a member; ``intervals``: (tid, join_ns, leave_ns)."""
    from telemill.operators.windows import range_join

    return range_join(intervals, events, "join_ns", "leave_ns", "ts_ns", bucket, ["tid"]).drop("join_ns", "leave_ns")


def with_percentiles(stats: DataFrame, kind: str = "base4") -> DataFrame:
    """Average, p50 and p99 in microseconds."""
    n = F.coalesce("count", F.lit(0))
    return stats.withColumns({
        "avg_us": F.when(n > 0, F.col("lat_sum") / n / 1000.0).otherwise(0.0),
        "p50_us": hist_percentile_us("hist", 0.5, kind), "p99_us": hist_percentile_us("hist", 0.99, kind),
    })


def lock_hot(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Count and wait of an episode over its baseline, clamped at 0; locks without new waits are dropped."""
    b = baseline.select("addr", F.col("count").alias("__c"), F.col("lat_sum").alias("__l"))
    j = current.join(b, "addr", "left")
    d = lambda c, p: F.greatest(F.lit(0), F.col(c) - F.coalesce(p, F.lit(0)))
    out = j.select("addr", d("count", "__c").alias("count"), d("lat_sum", "__l").alias("total_wait_ns"))
    return out.where("count > 0").withColumn("avg_wait_ns", floor_div("total_wait_ns", F.col("count")))


def fold_stacks(samples: DataFrame, comms: DataFrame) -> DataFrame:
    """Folded line and value; ``comms`` names tids, kernel frames come before user frames."""
    names = comms.select("tid", "comm")
    j = samples.join(names.withColumnRenamed("comm", "tcomm"), "tid", "left")
    j = j.join(names.select(F.col("tid").alias("pid"), F.col("comm").alias("pcomm")), "pid", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    root = F.concat(F.lit("p:"), F.col("pid").cast("string"), F.lit("/"), text("pcomm"), F.lit(";t:"), F.col("tid").cast("string"), F.lit("/"), text("tcomm"))
    line = F.concat_ws(";", root, F.nullif("kernel_stack", F.lit("")), F.nullif("user_stack", F.lit("")))
    return j.groupBy(line.alias("line")).agg(F.sum("count").alias("value"))
