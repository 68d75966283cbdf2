"""Ordered (time-series) steps that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends a whole series to one
task. Here the rows of a key are first cut into chunks along the order
(for example one chunk per day): windows run inside (key, chunk), one summary
row per chunk is carried forward over the key, and the carry is joined back.
The shuffle key is (key, chunk), so a hot key spreads over as many tasks as it
has chunks. Only the summaries, one row per chunk, are ordered per key.

``chunk`` must be a Column that never decreases along the order.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions.integers import floor_div
from telemill.session import cut

CHUNK = "__chunk"
DAY_NS = 86_400_000_000_000


def by_time(column: str = "ts_ns", width: int = DAY_NS) -> Column:
    """Chunk along a numeric column in steps of ``width``."""
    return floor_div(F.col(column), F.lit(width))


def _order(order: Sequence) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _windows(keys, order):
    local = Window.partitionBy(*keys, CHUNK).orderBy(*_order(order))
    carry_keys = [F.col(k) for k in keys] or [F.lit(0)]
    return local, Window.partitionBy(*carry_keys).orderBy(CHUNK)


def _fresh(df: DataFrame, chunk: Column) -> DataFrame:
    return df.withColumn(CHUNK, chunk)


def previous(df: DataFrame, keys: list[str], order: Sequence, cols: dict[str, str], chunk: Column) -> DataFrame:
    """Add ``new = cols[name]`` of the preceding row of the key (null on the first row)."""
    df = _fresh(df, chunk)
    local, across = _windows(keys, order)
    payload = F.struct(*[F.col(src).alias(new) for new, src in cols.items()])
    tails = (
        df.groupBy(*keys, CHUNK)
        .agg(F.max_by(payload, F.struct(*_order(order))).alias("__tail"))
        .withColumn("__carry", F.lag("__tail").over(across))
        .select(*keys, CHUNK, "__carry")
    )
    out = df.withColumn("__prev", F.lag(payload).over(local)).join(tails, [*keys, CHUNK], "left")
    picked = F.coalesce("__prev", "__carry")
    return out.withColumns({new: picked[new] for new in cols}).drop("__prev", "__carry", CHUNK)


_FOLDS = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: list[str],
    order: Sequence,
    aggs: dict[str, tuple[str, Column]],
    chunk: Column,
    include_current: bool = True,
) -> DataFrame:
    """Running sum, count, max, min or last non-null value (``last``) along the order.

    ``include_current=False`` stops each frame one row earlier.
    """
    df = _fresh(df, chunk)
    local, across = _windows(keys, order)
    frame = local.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    named = {f"__v{i}": spec[1] for i, spec in enumerate(aggs.values())}
    df = df.withColumns(named)
    totals, carries, local_cols, merged = [], {}, {}, {}
    for i, (name, (kind, _)) in enumerate(aggs.items()):
        v, t, c, l = f"__v{i}", f"__t{i}", f"__c{i}", f"__l{i}"
        if kind == "last":
            totals.append(F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*_order(order)))).alias(t))
            carries[c] = F.last(t, ignorenulls=True).over(before)
            local_cols[l] = F.last(v, ignorenulls=True).over(frame)
            merged[name] = F.coalesce(l, c)
        else:
            totals.append(_FOLDS[kind](v).alias(t))
            outer = F.sum if kind in ("sum", "count") else _FOLDS[kind]
            carries[c] = outer(t).over(before)
            local_cols[l] = _FOLDS[kind](v).over(frame)
            if kind in ("sum", "count"):
                merged[name] = F.when(
                    F.col(l).isNotNull() | F.col(c).isNotNull(),
                    F.coalesce(F.col(l), F.lit(0)) + F.coalesce(F.col(c), F.lit(0)),
                )
            elif kind == "max":
                merged[name] = F.greatest(l, c)
            else:
                merged[name] = F.least(l, c)
    carry = df.groupBy(*keys, CHUNK).agg(*totals).withColumns(carries).select(*keys, CHUNK, *carries)
    out = df.withColumns(local_cols).join(carry, [*keys, CHUNK], "left").withColumns(merged)
    return out.drop(*named, *carries, *local_cols, CHUNK)


def with_index(df: DataFrame, keys: list[str], order: Sequence, chunk: Column, name: str = "idx") -> DataFrame:
    """0-based position of each row within its key."""
    out = running(df, keys, order, {name: ("count", F.lit(1))}, chunk)
    return out.withColumn(name, (F.col(name) - 1).cast("long"))


def fill_forward(df: DataFrame, keys: list[str], order: Sequence, cols: list[str], chunk: Column) -> DataFrame:
    """Replace nulls by the last non-null value of the key."""
    tmp = {f"__f_{c}": ("last", F.col(c)) for c in cols}
    out = running(df, keys, order, tmp, chunk)
    return out.withColumns({c: F.col(f"__f_{c}") for c in cols}).drop(*tmp)


def islands(df: DataFrame, keys: list[str], order: Sequence, starts: Column, chunk: Column, name: str = "island") -> DataFrame:
    """Number the runs of a key; ``starts`` is true on the first row of each run."""
    return running(df, keys, order, {name: ("sum", starts.cast("long"))}, chunk)


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str, chunk: Column, name: str = "island") -> DataFrame:
    """Number groups of overlapping or touching [start, end] spans of a key."""
    order = [start, end]
    reach = running(df, keys, order, {"__reach": ("max", F.col(end))}, chunk, include_current=False)
    starts = F.col("__reach").isNull() | (F.col(start) > F.col("__reach"))
    return islands(reach.withColumn("__new", starts), keys, order, F.col("__new"), chunk, name).drop("__reach", "__new")


def with_halo(df: DataFrame, keys: list[str], idx: str, before: int, after: int, block: int = 8192) -> DataFrame:
    """Copy each row into the blocks that need it as context.

    Blocks hold ``block`` consecutive positions of a key. A row within
    ``before`` positions ahead of a block, or ``after`` positions behind it,
    is copied there with ``is_halo`` true, so bounded frames can run inside
    (key, block). Filter ``NOT is_halo`` afterwards.
    """
    i = F.col(idx)
    home = F.floor(i / block).cast("long")
    targets = F.array_distinct(
        F.array(home, F.floor((i + before) / block).cast("long"), F.floor((i - after) / block).cast("long"))
    )
    return (
        df.withColumn("__home", home)
        .withColumn("block", F.explode(targets))
        .withColumn("is_halo", F.col("block") != F.col("__home"))
        .drop("__home")
    )


def ewma(df: DataFrame, keys: list[str], order: Sequence, value: str, alpha: float, chunk: Column, name: str = "ewma") -> DataFrame:
    """y0 = x0, y = alpha*x + (1-alpha)*y along the key; a null adds nothing.

    The recurrence is affine, so it is composed in two levels of weighted sums.
    Positions of a key are cut into blocks over which the weight falls by 1e-100:
    inside a block y is a running sum of weighted values times the weight of its
    place, and a block hands on its end. Ends of as many blocks as double
    arithmetic can tell from 0 make up what stands before a block: nothing is cut.
    """
    rows = with_index(df, keys, order, chunk, "__i")
    x, beta = F.col(value).cast("double"), 1.0 - alpha
    if beta <= 0.0:
        return rows.withColumn(name, x).drop("__i")
    fall = -math.log10(beta)  # digits lost per row
    block = max(1, min(10_000_000, int(100 / fall)))
    kept = max(1, math.ceil(324 / (fall * block)))
    place = F.col("__i") % block
    gain = F.when(F.col("__i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    within = Window.partitionBy(*keys, "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    summed = F.coalesce(F.sum(gain * x * F.pow(F.lit(beta), -place)).over(within), F.lit(0.0))
    local = rows.withColumn("__b", floor_div(F.col("__i"), F.lit(block))).withColumn("__y", F.pow(F.lit(beta), place) * summed)
    across = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy("__b")
    ends = local.groupBy(*keys, "__b").agg(F.max_by("__y", "__i").alias("__end"))
    carry = sum((F.lit(beta ** (block * i)) * F.coalesce(F.lag("__end", i + 1).over(across), F.lit(0.0)) for i in range(kept)), F.lit(0.0))
    out = local.join(ends.select(*keys, "__b", carry.alias("__carry")), [*keys, "__b"])
    return out.withColumn(name, F.col("__y") + F.pow(F.lit(beta), place + 1) * F.col("__carry")).drop("__i", "__b", "__y", "__carry")


def fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    step: Callable[[pd.DataFrame, str], tuple[pd.DataFrame, str]],
    initial: str,
    schema: T.StructType,
    max_rounds: int | None = None,
) -> DataFrame:
    """Order-dependent fold whose state does not compose, still chunk-parallel and exact.

    ``step(rows, state)`` folds the sorted rows of one chunk and returns output
    rows and the end state as text. Every chunk is folded from ``initial``
    first; then only the chunks whose true start state (the end state of the
    chunk before) differs are folded again, until nothing changes. Folds that
    forget their past, as resetting sums and time limits do, settle in a few
    rounds; the worst case is one round per chunk.
    """
    by = [*keys, CHUNK]
    src = cut(_fresh(df, chunk))
    across = Window.partitionBy(*([F.col(k) for k in keys] or [F.lit(0)])).orderBy(CHUNK)
    key_fields = [src.schema[k] for k in by]
    end_schema = T.StructType([*key_fields, T.StructField("__start", T.StringType()), T.StructField("__end", T.StringType())])

    def run_ends(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf["__start"].iloc[0]
        rows = pdf.sort_values(order, kind="mergesort").reset_index(drop=True)
        _, end = step(rows, start)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), start, end]], columns=[*by, "__start", "__end"])

    def run_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf["__start"].iloc[0]
        rows = pdf.sort_values(order, kind="mergesort").reset_index(drop=True)
        out, _ = step(rows, start)
        return out[[f.name for f in schema.fields]]

    states = cut(
        src.withColumn("__start", F.lit(initial)).groupBy(*by).applyInPandas(run_ends, end_schema)
    )
    rounds = 0
    while True:
        truth = states.withColumn("__true", F.coalesce(F.lag("__end").over(across), F.lit(initial)))
        stale = truth.where(F.col("__true") != F.col("__start"))
        if stale.limit(1).count() == 0:
            break
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"fold did not settle in {max_rounds} rounds")
        todo = stale.select(*by, F.col("__true").alias("__start"))
        redone = src.join(todo, by).groupBy(*by).applyInPandas(run_ends, end_schema)
        kept = truth.where(F.col("__true") == F.col("__start")).select(*by, "__start", "__end")
        states = cut(kept.unionByName(redone))
    return src.join(states.select(*by, "__start"), by).groupBy(*by).applyInPandas(run_rows, schema)


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    summarise: Callable[[pd.DataFrame], Any],
    through: Callable[[Any, Any], Any],
    replay: Callable[[pd.DataFrame, Any], pd.DataFrame],
    initial: Any,
    schema: T.StructType,
) -> DataFrame:
    """Order-dependent fold in two passes, for states whose steps compose.

    ``summarise(rows)`` is what the sorted rows of one chunk do to any start
    state, small and JSON-like; ``through(state, summary)`` applies it, chunk by
    chunk along the key, one row each; ``replay(rows, state)`` makes the output
    of a chunk from its true start state.
    """
    by = [*keys, CHUNK]
    src = cut(_fresh(df, chunk))
    key_fields = [src.schema[k] for k in by]
    said = T.StructType([*key_fields, T.StructField("__s", T.StringType())])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="mergesort").reset_index(drop=True)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in by), json.dumps(summarise(rows))]], columns=[*by, "__s"])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK, kind="mergesort")
        state, starts = initial, []
        for s in pdf["__s"]:
            starts.append(json.dumps(state))
            state = through(state, json.loads(s))
        return pdf.assign(__s=starts)[said.names]

    def rows_of(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order, kind="mergesort").reset_index(drop=True)
        return replay(rows, json.loads(pdf["__s"].iloc[0]))[[f.name for f in schema.fields]]

    summaries = src.groupBy(*by).applyInPandas(sums, said)
    along = [F.col(k) for k in keys] or [F.lit(0)]
    starts = cut(summaries.groupBy(*along).applyInPandas(carry, said))
    return src.join(starts, by).groupBy(*by).applyInPandas(rows_of, schema)


class _Jumps:
    """Greedy choice along sorted times: after a chosen row the next eligible one behind the time that it blocks."""

    def __init__(self, ts: np.ndarray, eligible: np.ndarray, gap: int, skip: int, free: np.ndarray | None = None):
        n = self.n = len(ts)
        self.ts, self.gap, self.skip = ts, gap, skip
        at = np.where(eligible, np.arange(n), n)
        self.ahead = np.append(np.minimum.accumulate(at[::-1])[::-1], [n] * (skip + 1))  # next eligible row from here
        self.free = np.searchsorted(ts, ts + gap, side="left") if free is None else free  # first row that is not blocked
        self.next = np.append(self.ahead[self.free + np.where(self.free < n, skip, 0)], n)

    def end(self, i: int, ends: np.ndarray) -> int | None:
        """State after the chunk if row ``i`` is chosen: the time until which its last chosen row blocks, None if free."""
        last = int(ends[i])
        return int(self.ts[last]) + self.gap if self.free[last] == self.n else None

    def lasts(self) -> np.ndarray:
        """Last chosen row of the chain from every row, by doubling."""
        last = np.where(self.next < self.n, self.next, np.arange(self.n + 1))
        while True:
            further = last[last]
            if (further == last).all():
                return last
            last = further

    def chain(self, first: int) -> np.ndarray:
        """Which rows are chosen from ``first`` on."""
        mask, jump = np.zeros(self.n + 1, bool), self.next.copy()
        mask[first] = True
        while (jump < self.n).any():
            mask[jump[np.flatnonzero(mask)]] = True
            jump = jump[jump]
        return mask[: self.n]


WHOLE = 100_000  # keys of at most so many rows are not cut into chunks


def _narrow(gap: int, ts: np.ndarray) -> int:
    """The gap, no wider than times can be added to."""
    return min(gap, (1 << 62) - 1 - int(np.abs(ts).max()))


def _free_within(key: np.ndarray, ts: np.ndarray, gap: int) -> np.ndarray:
    """First row at least ``gap`` after each row, or the first one of the next key; rows are sorted by (key, ts)."""
    n = len(ts)
    order = np.lexsort((np.repeat([1, 0], n), np.concatenate([ts, ts + gap]), np.concatenate([key, key])))
    seen = np.cumsum(order < n)
    free = np.empty(n, np.int64)
    asked = order >= n
    free[order[asked] - n] = seen[asked]
    return free


def _greedy_whole(df: DataFrame, keys: list[str], order: list[str], ts: str, eligible: str | None, gap: int) -> DataFrame:
    """``greedy`` without ``skip``, key after key: a task walks through its keys' sorted rows batch by batch."""

    def choose(batches):
        before, until = None, None  # key of the row before, and the time until which its last chosen row blocks
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            t = b.column(ts).to_numpy(zero_copy_only=False).astype(np.int64)
            ok = np.ones(n, bool) if eligible is None else pc.fill_null(b.column(eligible), False).to_numpy(zero_copy_only=False).copy()
            new = np.zeros(n, bool)
            for c in (b.column(k) for k in keys):
                a, z = c.slice(1), c.slice(0, n - 1)
                same = pc.or_(pc.fill_null(pc.equal(a, z), False), pc.and_(pc.is_null(a), pc.is_null(z)))
                new[1:] |= ~same.to_numpy(zero_copy_only=False)
            at = lambda i: [b.column(k)[i].as_py() for k in keys]
            new[0] = at(0) != before
            key = np.cumsum(new)
            step = _narrow(gap, t)
            if new[0]:
                until = None
            elif until is not None:
                ok &= (key > 0) | (t >= until)
            j = _Jumps(t, ok, step, 0, _free_within(key, t, step))
            mask = j.chain(int(j.ahead[0]))
            last = np.flatnonzero(mask & (key == key[-1]))
            if len(last):
                until = int(t[last[-1]]) + step
            elif key[-1] > key[0]:
                until = None
            before = at(n - 1)
            yield b.filter(pa.array(mask))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(choose, df.schema)


def greedy(df: DataFrame, keys: list[str], order: list[str], ts: str, eligible: str | None, gap: int | None, chunk: Column, skip: int = 0) -> DataFrame:
    """The rows chosen greedily along the key: the first eligible one, then the next one at least ``gap`` later.

    ``skip`` rows that are not blocked any more are passed over first. With
    ``gap`` null only the first is chosen. The choices made in a chunk depend on
    the past through one time, until which the last chosen row blocks; a chunk
    is summarised by the time that it hands on for each row that may end the
    blocking, where consecutive rows that hand on the same are one entry.

    Only keys of more than ``WHOLE`` rows are cut into chunks. All others stay
    whole, many to a task: a group for each would cost more than its rows.
    """
    wide = 1 << 62 if gap is None else gap
    if keys and skip == 0:
        df = cut(df)
        large = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > WHOLE).select(*keys))
        whole = _greedy_whole(df.join(large, keys, "left_anti").select(*df.columns), keys, order, ts, eligible, wide)
        if large.limit(1).count() == 0:
            return whole
        return whole.unionByName(_greedy_chunks(df.join(large, keys, "left_semi").select(*df.columns), keys, order, ts, eligible, wide, chunk, 0))
    return _greedy_chunks(df, keys, order, ts, eligible, wide, chunk, skip)


def _greedy_chunks(df: DataFrame, keys: list[str], order: list[str], ts: str, eligible: str | None, wide: int, chunk: Column, skip: int) -> DataFrame:

    def jumps(rows: pd.DataFrame) -> _Jumps:
        t = rows[ts].to_numpy(dtype=np.int64)
        ok = np.ones(len(t), bool) if eligible is None else rows[eligible].fillna(False).to_numpy(dtype=bool)
        return _Jumps(t, ok, _narrow(wide, t), skip)

    def summarise(rows: pd.DataFrame):
        j = jumps(rows)
        lasts = j.lasts()
        result = lambda i: j.end(i, lasts) if i < j.n else None
        runs: list[list] = []
        for c in range(int(np.searchsorted(j.ts, j.ts[0] + j.gap, side="left")) + 1):
            if c == j.n:
                break
            r = result(int(j.ahead[c + skip]))
            if runs and runs[-1][1] == r:
                runs[-1][0] = int(j.ts[c])
            else:
                runs.append([int(j.ts[c]), r])
        return {"idle": result(int(j.ahead[0])), "runs": runs, "last": int(j.ts[-1])}

    def through(state, s):
        if state is None:
            return s["idle"]
        if state > s["last"]:
            return state
        return next((r for t, r in s["runs"] if t >= state), None)

    def replay(rows: pd.DataFrame, state):
        j = jumps(rows)
        if state is None:
            first = int(j.ahead[0])
        else:
            c = int(np.searchsorted(j.ts, state, side="left"))
            first = int(j.ahead[c + skip]) if c < j.n else j.n
        return rows[j.chain(first)]

    return scan(df, keys, order, chunk, summarise, through, replay, None, df.schema)


def clamped_walk(df: DataFrame, keys: list[str], order: Sequence, start: Column, shift: Column, low: Column, high: Column, chunk: Column, name: str, block: int = 512) -> DataFrame:
    """Running value x = min(high, max(low, x + shift)) along the key, from ``start``; null bounds do not bind.

    Clamped shifts compose to clamped shifts, so a block of ``block`` rows is one
    (shift, low, high); blocks of blocks are composed level by level, the states
    before them handed down again, and only the last level walks through rows.
    """
    inf = float("inf")
    step = F.struct(shift.cast("double").alias("a"), F.coalesce(low.cast("double"), F.lit(-inf)).alias("lo"), F.coalesce(high.cast("double"), F.lit(inf)).alias("hi"))
    clamp = lambda x, s: F.least(s["hi"], F.greatest(s["lo"], x + s["a"]))

    def after(p, s):  # p, then s; as p's bounds are the least and greatest values, s is applied to them
        return F.struct((p["a"] + s["a"]).alias("a"), clamp(p["lo"], s).alias("lo"), clamp(p["hi"], s).alias("hi"))

    none = F.struct(F.lit(0.0).alias("a"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"))
    src = with_index(df.withColumn("__step", step), keys, order, chunk, "__i")
    kept = cut(src.withColumn("__b0", floor_div(F.col("__i"), F.lit(block))))
    at = lambda level: [*keys, f"__b{level}"]
    lists = [cut(kept.groupBy(*at(0)).agg(F.array_sort(F.collect_list(F.struct("__i", "__step"))).alias("__steps")))]
    while lists[-1].select(F.max(f"__b{len(lists) - 1}")).first()[0]:  # blocks of blocks, until each key has one
        k = len(lists)
        whole = lists[-1].select(*at(k - 1), F.aggregate("__steps", none, lambda p, x: after(p, x["__step"])).alias("__step"))
        whole = whole.withColumns({"__i": F.col(f"__b{k - 1}"), f"__b{k}": floor_div(F.col(f"__b{k - 1}"), F.lit(block))})
        lists.append(cut(whole.groupBy(*at(k)).agg(F.array_sort(F.collect_list(F.struct("__i", "__step"))).alias("__steps"))))

    def walked(level: int, begin: Column) -> Column:
        """(position, value before, value after) of each step of a list."""
        first = F.struct(begin.alias("x"), F.array().cast("array<struct<i:bigint,before:double,after:double>>").alias("out"))

        def go(acc, s):
            x = clamp(acc["x"], s["__step"])
            return F.struct(x.alias("x"), F.array_append(acc["out"], F.struct(s["__i"].alias("i"), acc["x"].alias("before"), x.alias("after"))).alias("out"))

        return F.aggregate("__steps", first, go)["out"]

    top = len(lists) - 1
    now = lists[top].withColumn("__x", start.cast("double"))
    for k in range(top, 0, -1):
        told = now.select(*keys, F.inline(walked(k, F.col("__x")))).select(*keys, F.col("i").alias(f"__b{k - 1}"), F.col("before").alias("__x"))
        now = lists[k - 1].join(told, at(k - 1)) if keys else lists[k - 1].join(told, [f"__b{k - 1}"])
    values = now.select(*keys, F.inline(walked(0, F.col("__x")))).select(*keys, F.col("i").alias("__i"), F.col("after").alias(name))
    return kept.join(values, [*keys, "__i"]).drop("__i", "__b0", "__step")


def with_time_halo(df: DataFrame, column: str, before: int, width: int) -> DataFrame:
    """Copy each row into its own time block and into the block that still looks ``before`` back at it.

    Inside (key, ``block``) a range frame of up to ``before`` preceding units
    is then complete for the rows with ``NOT is_halo``. ``width`` must not be
    smaller than ``before``.
    """
    home = floor_div(F.col(column), F.lit(width))
    ahead = floor_div((F.col(column) + before), F.lit(width))
    return (
        df.withColumn("__home", home)
        .withColumn("block", F.explode(F.array_distinct(F.array(home, ahead))))
        .withColumn("is_halo", F.col("block") != F.col("__home"))
        .drop("__home")
    )
