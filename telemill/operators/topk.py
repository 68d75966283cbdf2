"""Weighted top-k with hysteresis (T family).

Snapshots hold one row per (host, ts_ns, tid) with cumulative counters.
Ranking windows cover one (host, tick), which is bounded by what one machine
runs at an instant.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.operators import ordered

SECOND = 1_000_000_000
COUNTERS = ("on_cpu_ns", "sw_vol", "sw_invol", "io_ops", "io_bytes", "pf_minor", "pf_major", "lock_waits")

# Default weights and reference rates of the activity score, and the selection settings.
WEIGHTS = {"cpu": 0.35, "switch": 0.15, "io": 0.20, "fault": 0.15, "lock": 0.15}
REFERENCE = {"switch": 1e4, "io": 1e4, "io_bw": 1073741824.0, "fault": 1e4, "lock": 1e3}


def base_snapshots(ticks: DataFrame, host: list[str], window_ns: int, chunk: Column) -> DataFrame:
    """(host, ts_ns, base_ts) of distinct ticks: the oldest tick within the window, but at least the one before."""
    t = ticks.select(*host, "ts_ns").distinct()
    width = max(window_ns, 64 * SECOND)
    w = Window.partitionBy(*host, "block").orderBy("ts_ns").rangeBetween(-window_ns, -1)
    near = ordered.with_time_halo(t, "ts_ns", window_ns, width).withColumn("__lo", F.min("ts_ns").over(w)).where("NOT is_halo")
    prev = ordered.previous(near.select(*host, "ts_ns", "__lo"), host, ["ts_ns"], {"__p": "ts_ns"}, chunk)
    return prev.withColumn("base_ts", F.coalesce("__lo", "__p")).where("base_ts IS NOT NULL").select(*host, "ts_ns", "base_ts")


def window_delta(snap: DataFrame, host: list[str], chunk: Column, cols: Sequence[str] = COUNTERS, window_s: int = 30) -> DataFrame:
    """Counters over the window, clamped at 0; a thread absent from the base counts in full."""
    base = base_snapshots(snap, host, window_s * SECOND, chunk)
    cur = snap.join(base, [*host, "ts_ns"])
    old = snap.select(*host, F.col("ts_ns").alias("base_ts"), "tid", *[F.col(c).alias(f"__o_{c}") for c in cols])
    j = cur.join(old, [*host, "base_ts", "tid"], "left")
    step = {c: F.greatest(F.lit(0), F.col(c) - F.coalesce(F.col(f"__o_{c}"), F.lit(0))) for c in cols}
    return j.withColumns({**step, "window_s": (F.col("ts_ns") - F.col("base_ts")) / F.lit(1e9)}).drop(*[f"__o_{c}" for c in cols])


def activity_score(weights: dict[str, float] | None = None, cpu_unit_ns: float = 1.0) -> Column:
    """T2 over the window columns; ``cpu_unit_ns`` turns the CPU counter into nanoseconds."""
    w = {**WEIGHTS, **(weights or {})}
    sat = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    s = F.col("window_s")
    per = lambda *cols: sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / s
    return (
        w["cpu"] * sat(F.col("on_cpu_ns") * cpu_unit_ns / (s * 1e9))
        + w["switch"] * sat(per("sw_vol", "sw_invol") / REFERENCE["switch"])
        + w["io"] * ((sat(per("io_ops") / REFERENCE["io"]) + sat(per("io_bytes") / REFERENCE["io_bw"])) / 2)
        + w["fault"] * sat(per("pf_minor", "pf_major") / REFERENCE["fault"])
        + w["lock"] * sat(per("lock_waits") / REFERENCE["lock"])
    )


def exact_score() -> Column:
    """T2 with the fixed weights as a whole number: the score times 20 * 2^30 * the window in ns.

    Ranks inside one window (a host's tick has one) then depend neither on the
    order of a sum of doubles nor on where their rounding falls.
    """
    whole = lambda c: c.cast("decimal(20,0)")
    unit = F.lit(2**30).cast("decimal(10,0)")
    w = F.round(F.col("window_s") * SECOND).cast("long")
    sat = lambda v: F.greatest(F.lit(0).cast("long"), F.least(w, v))
    parts = (
        7 * sat(F.col("on_cpu_ns")) + 3 * sat((F.col("sw_vol") + F.col("sw_invol")) * 100_000) + 2 * sat(F.col("io_ops") * 100_000)
        + 3 * sat((F.col("pf_minor") + F.col("pf_major")) * 100_000) + 3 * sat(F.col("lock_waits") * 1_000_000)
    )
    bytes_ = F.greatest(F.lit(0).cast("decimal(30,0)"), F.least(whole(w) * unit, whole(F.col("io_bytes")) * F.lit(SECOND).cast("decimal(10,0)")))
    return whole(parts) * unit + F.lit(2).cast("decimal(1,0)") * bytes_


def process_rollup(delta: DataFrame, host: list[str], cols: Sequence[str] = COUNTERS, **score) -> DataFrame:
    """Thread deltas summed per process, scored on the sums."""
    p = delta.groupBy(*host, "ts_ns", "tgid").agg(*[F.sum(c).alias(c) for c in cols], F.max("window_s").alias("window_s"))
    return p.withColumn("score", activity_score(**score))


def rank(scored: DataFrame, host: list[str]) -> DataFrame:
    """T4: 1 is the highest score; ties by tgid."""
    w = Window.partitionBy(*host, "ts_ns").orderBy(F.desc("score"), "tgid")
    return scored.withColumn("rank", F.row_number().over(w))


def _member_state(text: str) -> dict[int, list]:
    return {int(k): v for k, v in json.loads(text).items()}


def hysteresis(
    ranked: DataFrame, host: str, chunk: Column, enter_rank: int = 12, leave_rank: int = 20, hold_periods: int = 3, min_residency_s: float = 10,
    budget: int = 16, pinned: Sequence[int] = (),
) -> DataFrame:
    """T5: members (host, ts_ns, tgid, joined_ns) after each evaluation.

    Joining takes ``hold_periods`` evaluations in the enter band, leaving as
    many below the leave band and a minimum stay; joins go by rank within the
    budget, pinned processes never leave, and the set is never empty. The
    state only holds members and streaks, so it stays small.
    """
    pins = set(pinned)
    stay = int(min_residency_s * SECOND)
    schema = T.StructType([
        ranked.schema[host], T.StructField("ts_ns", T.LongType()), T.StructField("tgid", T.LongType()), T.StructField("joined_ns", T.LongType()),
    ])

    def step(rows: pd.DataFrame, state: str) -> tuple[pd.DataFrame, str]:
        # per process: [member, good streak, bad streak, joined]
        st = _member_state(state)
        out = []
        key = rows[host].iloc[0]
        for ts, tick in rows.groupby("ts_ns", sort=True):
            ts = int(ts)
            ranks = dict(zip(tick["tgid"].tolist(), tick["rank"].tolist()))
            leave, join = [], []
            for g in set(st) | {g for g, r in ranks.items() if r <= enter_rank}:
                if g in pins:
                    continue
                e = st.setdefault(g, [0, 0, 0, 0])
                r = ranks.get(g)
                if e[0]:
                    e[2] = e[2] + 1 if r is None or r > leave_rank else 0
                    if e[2] >= hold_periods and ts - e[3] >= stay:
                        leave.append(g)
                else:
                    e[1] = e[1] + 1 if r is not None and r <= enter_rank else 0
                    if e[1] >= hold_periods:
                        join.append(g)
            for g in leave:
                st[g][0], st[g][2] = 0, 0
            count = sum(1 for e in st.values() if e[0]) + len(pins)
            for g in sorted(join, key=lambda g: ranks[g]):
                if count >= budget:
                    break
                st[g][0], st[g][1], st[g][3] = 1, 0, ts
                count += 1
            if ranks and not any(g in ranks for g in pins) and not any(e[0] and g in ranks for g, e in st.items()):
                top = min(ranks, key=lambda g: ranks[g])
                e = st.setdefault(top, [0, 0, 0, 0])
                e[0], e[3] = 1, ts
            st = {g: e for g, e in st.items() if e[0] or e[1]}
            out += [(key, ts, g, e[3]) for g, e in st.items() if e[0]] + [(key, ts, g, 0) for g in pins]
        return pd.DataFrame(out, columns=schema.names), json.dumps(dict(sorted(st.items())))

    rows = ranked.select(host, "ts_ns", F.col("tgid").cast("long").alias("tgid"), "rank")
    return ordered.fold(rows, [host], ["ts_ns", "rank"], chunk, step, "{}", schema)


def top_threads(scored_threads: DataFrame, members: DataFrame, host: list[str], per_proc: int = 4, budget: int = 64) -> DataFrame:
    """The best threads of each member process, by process rank, within the thread budget."""
    inner = scored_threads.join(members, [*host, "ts_ns", "tgid"])
    by_proc = Window.partitionBy(*host, "ts_ns", "tgid").orderBy(F.desc("score"), "tid")
    best = inner.withColumn("__r", F.row_number().over(by_proc)).where(F.col("__r") <= per_proc)
    fill = Window.partitionBy(*host, "ts_ns").orderBy("rank", "tgid", "__r")
    return best.withColumn("__n", F.row_number().over(fill)).where(F.col("__n") <= budget).drop("__r", "__n")


def membership_diff(members: DataFrame, host: list[str], chunk: Column, key: str = "tid") -> DataFrame:
    """Join and leave records between consecutive evaluations of a host."""
    ticks = members.select(*host, "ts_ns").distinct()
    nxt = ordered.previous(ticks, host, ["ts_ns"], {"prev_ts": "ts_ns"}, chunk)
    now = members.select(*host, "ts_ns", key)
    before = now.withColumnRenamed("ts_ns", "prev_ts").join(nxt.where("prev_ts IS NOT NULL"), [*host, "prev_ts"]).select(*host, "ts_ns", key)
    on = [*host, "ts_ns", key]
    joins = now.join(before, on, "left_anti").withColumn("action", F.lit("join"))
    leaves = before.join(now, on, "left_anti").withColumn("action", F.lit("leave"))
    return joins.unionByName(leaves)


def top_tasks(procs: DataFrame, host: list[str], n: int = 200) -> DataFrame:
    """The busiest tasks of each tick; the partial limit of the rank keeps the shuffle small."""
    w = Window.partitionBy(*host, "ts_ns").orderBy(F.desc(F.col("utime") + F.col("stime")), "pid")
    return procs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def task_rollup(procs: DataFrame, host: list[str]) -> DataFrame:
    """One row per process: sums, main thread's name, state, start time and memory of its first row (by pid)."""
    g = F.coalesce(F.nullif(F.col("tgid"), F.lit(0)), F.col("pid"))
    p = procs.withColumn("__g", g)
    sums = [F.sum(c).alias(c) for c in ("utime", "stime", "nvcsw", "nivcsw", "minflt", "majflt", "total_vm")]
    firsts = [F.min_by(c, "pid").alias(c) for c in ("state", "start_time", "rss_kb")]
    comm = F.max(F.when(F.col("pid") == F.col("__g"), F.col("comm"))).alias("comm")
    return p.groupBy(*host, "ts_ns", F.col("__g").alias("tgid")).agg(*sums, *firsts, comm)


def counter_totals(counters: DataFrame, members: DataFrame, procs: DataFrame, host: list[str], hz: float = 100.0) -> DataFrame:
    """Sums over member threads; a thread without on-CPU time takes its scheduler ticks."""
    on = [*host, "ts_ns", "tid"]
    m = counters.join(members.select(*on).distinct(), on, "left_semi")
    ticks = procs.select(*host, "ts_ns", F.col("pid").alias("tid"), ((F.col("utime") + F.col("stime")) * (1e9 / hz)).cast("long").alias("__cpu"))
    j = m.join(ticks, on, "left").withColumn("on_cpu_ns", F.coalesce(F.nullif("on_cpu_ns", F.lit(0)), "__cpu", F.lit(0)))
    return j.groupBy(*host, "ts_ns").agg(
        F.sum("on_cpu_ns").alias("on_cpu_ns_total"), F.sum(F.col("sw_vol") + F.col("sw_invol")).alias("switch_total"), F.sum("io_ops").alias("io_ops_total"),
        F.sum("io_bytes").alias("io_bytes_total"), F.sum("pf_minor").alias("minor_faults_total"), F.sum("pf_major").alias("major_faults_total"),
        F.sum("lock_waits").alias("lock_waits_total"),
    )


def channel_top_k(train: DataFrame, group: list[str], channel: str, k: int, value: str = "value") -> DataFrame:
    """Channels with the highest population variance; ties by channel."""
    v = train.groupBy(*group, channel).agg(F.var_pop(value).alias("variance"))
    w = Window.partitionBy(*group).orderBy(F.desc("variance"), channel)
    return v.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
