"""Structured Streaming forms of the per-key operators (R family).

Rows wait in their key's state until the watermark has passed them and are then
applied in event-time order, so results do not depend on how rows fell into
batches; rows behind the watermark are dropped by the engine. A timer in event
time wakes a key for waiting rows and for what is due without any row. State
that is due for nothing is removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from telemill.functions.integers import floor_div
from telemill.operators import detect, stats as st, windows
from telemill.session import fresh_path


def with_event_time(df: DataFrame, ts: str = "ts_ns") -> DataFrame:
    """Add ``ts`` for watermarks; nanoseconds stay the truth."""
    return df.withColumn("ts", F.timestamp_micros(floor_div(F.col(ts), 1000)))


def drain(stream: DataFrame, name: str, mode: str = "append", feed: Iterable[Callable[[], None]] = (lambda: None,)) -> DataFrame:
    """Run a stream over all available input into a table in the shared folder and read it.

    Each step of ``feed`` adds input; the query is then started anew from its
    checkpoint and takes what is new, so state passes from batch to batch.
    """
    spark = stream.sparkSession
    root = f"{fresh_path(spark)}/{name}"
    for put in feed:
        put()
        out = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/data").option("checkpointLocation", f"{root}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def _by_arrival(stream: DataFrame, keys: list[str], order: list[str], out: T.StructType, initial, step: Callable) -> DataFrame:
    """Per key, in the order of arrival: ``step(rows, state) -> (output rows, state)`` with a JSON state."""
    names = [f.name for f in out.fields]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="mergesort").reset_index(drop=True)
        before = json.loads(state.get[0]) if state.exists else initial
        result, after = step(rows, before)
        state.update((json.dumps(after),))
        yield result[names]

    return stream.groupBy(*keys).applyInPandasWithState(run, out, "state string", "append", GroupStateTimeout.NoTimeout)


MS = 1_000_000
BUCKETS = 4096  # groups that share the keys of a fold; part of its checkpoint


def event_time_fold(
    stream: DataFrame, keys: list[str], order: list[str], rows: list[str], out: T.StructType, initial, step: Callable, due: Callable, lateness: str, ts: str = "ts_ns"
) -> DataFrame:
    """Fold each key's rows in event-time order, exactly once, with event-time timers.

    ``step(row, state)`` takes one row as a dict and returns (output rows,
    state); ``due(state)`` is the time in ns at which ``step(None, state)`` has
    to run, or None. All rows with a
    time (in ms) before the watermark have been applied when a batch ends, and
    whatever is due before it has been run, in order of time. A state equal to
    ``initial`` with nothing waiting is removed. Keys are strings, whole numbers
    or booleans; they share ``BUCKETS`` groups, as a group costs far more than
    the few rows that most keys have in a batch.
    """
    columns = list(dict.fromkeys([*rows, *order, ts]))
    kinds = {"long": "Int64", "integer": "Int32", "double": "float64"}
    at, by = columns.index(ts), itemgetter(*(columns.index(o) for o in order))

    def advance(state, until: int | None, made: list):
        """Run what is due before ``until`` (inclusive)."""
        while (when := due(state)) is not None and until is not None and when <= until:
            found, state = step(None, state)
            made += found
        return state

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: [waiting, fold] for k, waiting, fold in json.loads(state.get[0])} if state.exists else {}
        for batch in batches:
            for k, *r in zip(batch["__key"].tolist(), *(batch[c].tolist() for c in columns), strict=True):
                held.setdefault(k, [[], initial])[0].append(r)
        now = state.getCurrentWatermarkMs()
        made, kept, times = [], [], []
        for k, (waiting, fold) in held.items():
            waiting.sort(key=by)
            found: list = []
            for r in waiting:
                if r[at] // MS < now:
                    fold = advance(fold, r[at], found)
                    rows_out, fold = step(dict(zip(columns, r, strict=True)), fold)
                    found += rows_out
            waiting = [r for r in waiting if r[at] // MS >= now]
            fold = advance(fold, now * MS - 1, found)
            if found:
                told = json.loads(k)
                made += [[*(told.get(c) for c in keys), *m] for m in found]
            if waiting or fold != initial:
                kept.append([k, waiting, fold])
                times += [min(r[at] for r in waiting)] if waiting else []
                times += [t for t in [due(fold)] if t is not None]
        if kept:
            state.update((json.dumps(kept),))
            if times:
                state.setTimeoutTimestamp(max(now, min(times) // MS, 1))
        elif state.exists:
            state.remove()
        if made:
            typed = zip(out.fields, zip(*made), strict=True)
            yield pd.DataFrame({f.name: pd.Series(list(v), dtype=kinds.get(f.dataType.typeName(), "object")) for f, v in typed})

    named = stream.withColumn("__key", F.to_json(F.struct(*keys))).withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(BUCKETS)))
    timed = with_event_time(named.select("__key", "__bucket", *columns), ts).withWatermark("ts", lateness)
    return timed.groupBy("__bucket").applyInPandasWithState(run, out, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def _key_and(stream: DataFrame, keys: list[str], fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*[stream.schema[k] for k in keys], *fields])


def dedupe_in_watermark(points: DataFrame, tolerance: str = "5 seconds") -> DataFrame:
    """Native form; late rows are dropped by later stateful steps, repeats within the tolerance here."""
    return with_event_time(points).withWatermark("ts", tolerance).dropDuplicatesWithinWatermark(["entity_id", "metric_id", "ts_ns", "quality"])


def accept_or_reject(points: DataFrame, source: str, arrival: str, identity: list[str], tolerance_ns: int = 5_000_000_000) -> DataFrame:
    """Every row with its ``status``: accepted, late or duplicate.

    Rows count in the order of arrival. A row is late if it is more than the
    tolerance behind the newest time that its source has shown before; else it
    is a duplicate if one with the same ``identity`` and time came before. What a
    source must remember is its newest time and the rows within the tolerance
    of it: older ones would be late. Accepted and rejected rows together are the input.
    """
    kept = list(dict.fromkeys([source, arrival, *identity, "ts_ns"]))
    out = T.StructType([*[points.schema[c] for c in kept], T.StructField("status", T.StringType())])

    def step(rows, state):
        newest, seen = state
        ts = rows["ts_ns"].to_numpy()
        top = np.maximum.accumulate(ts) if newest is None else np.maximum(np.maximum.accumulate(ts), newest)
        before = np.concatenate([[ts[0] if newest is None else newest], top[:-1]])
        late = ts < before - tolerance_ns
        ids = rows[[*identity, "ts_ns"]].astype(object).where(rows[[*identity, "ts_ns"]].notna(), None)
        marks = pd.Series([json.dumps(list(r), default=str) for r in ids.itertuples(index=False, name=None)])
        fresh = marks.where(~late)
        again = ~late & (fresh.isin(set(seen)) | fresh.duplicated()).to_numpy()
        newest = int(top[-1])
        near = (ts >= newest - tolerance_ns) & ~late & ~again
        seen = [m for m in seen if json.loads(m)[-1] >= newest - tolerance_ns] + marks[near].tolist()
        return rows.assign(status=np.where(late, "late", np.where(again, "duplicate", "accepted"))), [newest, seen]

    return _by_arrival(points.select(*kept), [source], [arrival], out, [None, []], step)


def last_value_and_ewma(points: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = 0.2, lateness: str = "5 seconds", expire_ns: int | None = None) -> DataFrame:
    """R2: step to the reading before (at least 0, silent on the first) and running EWMA per key.

    A key that is silent for ``expire_ns`` is forgotten and starts anew.
    """
    out = _key_and(points, keys, [*[points.schema[c] for c in order], T.StructField("step", T.DoubleType()), T.StructField("ewma", T.DoubleType())])

    def step(row, state):
        if row is None:
            return [], None
        x = row[value]
        last, y, _ = state or (None, None, None)
        y = x if y is None else alpha * x + (1 - alpha) * y
        return [[*[row[c] for c in order], None if last is None else max(0.0, x - last), y]], [x, y, row["ts_ns"]]

    due = lambda state: state[2] + expire_ns if state and expire_ns is not None else None
    return event_time_fold(points, keys, order, [value], out, None, step, due, lateness)


def live_pairs(events: DataFrame, keys: list[str], order: list[str], begin: Column, end: Column, carry: list[str], earliest: bool = False, lateness: str = "5 seconds", expire_ns: int | None = None) -> DataFrame:
    """R2: spans that end (P3, P4, P7, P8), with ``begin_ts``, the columns ``carry`` of their begin and ``lat_ns``.

    The newest begin counts, or with ``earliest`` the first since the last end;
    an end consumes it. A begin that is open for ``expire_ns`` is forgotten.
    """
    fields = [*[events.schema[c] for c in order], T.StructField("begin_ts", T.LongType()), *[events.schema[c] for c in carry], T.StructField("lat_ns", T.LongType())]
    marked = events.withColumns({"__b": F.coalesce(begin, F.lit(False)), "__e": F.coalesce(end, F.lit(False))}).where("__b OR __e")

    def step(row, state):
        if row is None:
            return [], None
        if row["__b"]:
            return [], state if earliest and state else [row["ts_ns"], *[row[c] for c in carry]]
        found = [[*[row[c] for c in order], *state, max(0, row["ts_ns"] - state[0])]] if state else []
        return found, None

    due = lambda state: state[0] + expire_ns if state and expire_ns is not None else None
    return event_time_fold(marked, keys, order, ["__b", "__e", *carry], _key_and(events, keys, fields), None, step, due, lateness)


def live_points(channels: DataFrame, source: list[str], lateness: str = "5 seconds", expire_ns: int | None = None) -> DataFrame:
    """R2: S9 in the stream: gauges pass, cumulative channels become max(0, step), silent on their first reading.

    ``channels`` are the rows of ``messages.raw_channels``; columns as there, with ``value``.
    """
    keys = [*source, "entity_id", "metric_id"]
    shown = [*keys, "ts_ns", "value"]
    gauges = channels.where("kind = 'g'").withColumn("value", F.col("raw").cast("double")).select(*shown)
    steps = last_value_and_ewma(channels.where("kind = 'c'").withColumn("x", F.col("raw").cast("double")), keys, ["ts_ns"], "x", lateness=lateness, expire_ns=expire_ns)
    return gauges.unionByName(steps.where("step is not null").withColumn("value", F.col("step")).select(*shown))


def sliding_stats(points: DataFrame, window: str = "60 seconds", stride: str = "30 seconds", lateness: str = "5 seconds") -> DataFrame:
    """Count, sum and largest value per series and event-time window, emitted when the window closes."""
    w = F.window("ts", window, stride)
    agg = with_event_time(points).withWatermark("ts", lateness).groupBy(w.alias("w"), "entity_id", "metric_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")
    )
    start = F.unix_micros("w.start") * 1000
    return agg.select(start.alias("w_start"), "entity_id", "metric_id", "n", "total", "top")


def live_episodes(ticks: DataFrame, host: str, post_ns: int, debounce: int = 3, lateness: str = "5 seconds") -> DataFrame:
    """Episodes as they close, at their deadline, whether or not the host still ticks.

    The first anomaly opens an episode; it ends at the first of ``debounce``
    normal ticks in a row, else at its deadline. The first tick at or after the
    deadline finds the host outside an episode and may open the next one.
    """
    out = _key_and(ticks, [host], [T.StructField(c, T.LongType()) for c in ("start_ns", "end_ns", "deadline_ns", "closed_ns")])

    def step(row, state):
        if row is None:  # the deadline
            start, end, _, _ = state
            deadline = start + post_ns
            return [[start, deadline if end is None else end, deadline, deadline]], None
        bad, ts = row["is_anomaly"], row["ts_ns"]
        if state is None:
            return [], [ts, None, None, 0] if bad else None
        start, end, first, normal = state
        if bad:
            return [], [start, end, None, 0]
        first, normal = (ts if normal == 0 else first), normal + 1
        return [], [start, first if end is None and normal >= debounce else end, first, normal]

    due = lambda state: state[0] + post_ns if state else None
    return event_time_fold(ticks, [host], ["ts_ns"], ["is_anomaly"], out, None, step, due, lateness)


def ring_gaps(drains: DataFrame, key: str, capacity: int, lateness: str = "5 seconds", expire_ns: int | None = None) -> DataFrame:
    """Gap rows of an incremental drain; the newest head per ring is the state, for ``expire_ns`` at most."""
    out = _key_and(drains, [key], [T.StructField(c, T.LongType()) for c in ("ts_ns", "from_head", "to_head")])

    def step(row, state):
        if row is None:
            return [], None
        head = row["head"]
        gap = state is not None and head - state[0] >= capacity - 64
        return [[row["ts_ns"], state[0], head]] if gap else [], [head, row["ts_ns"]]

    due = lambda state: state[1] + expire_ns if state and expire_ns is not None else None
    return event_time_fold(drains, [key], ["ts_ns"], ["head"], out, None, step, due, lateness)


class WarmupScorer:
    """Warm up, fit once, then score each batch's windows; use as ``foreachBatch(scorer)``.

    Event time decides everything. Points are appended to a table; when their
    span reaches ``warmup_ns`` the statistics and thresholds of the warm-up
    are written once, with its end; windows after it are scored and appended.
    A restart finds the fit in its table. Replayed batches write to their own
    folder again, so results stay exactly once.
    """

    def __init__(self, spark: SparkSession, warmup_ns: int, window_ns: int, stride_ns: int, interval_ns: int, root: str | None = None):
        self.root = root or fresh_path(spark)
        self.warmup_ns, self.window_ns, self.stride_ns, self.interval_ns = warmup_ns, window_ns, stride_ns, interval_ns

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.root}/points/batch={batch_id}")
        points = spark.read.schema(batch.schema).option("basePath", f"{self.root}/points").parquet(f"{self.root}/points/batch=*")
        cut_ns = self._fitted_until(spark)
        if cut_ns is None:
            span = points.agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b")).first()  # one row
            if span["a"] is None or span["b"] - span["a"] < self.warmup_ns:
                return
            cut_ns = span["a"] + self.warmup_ns
            warm = points.where(F.col("ts_ns") <= cut_ns)
            stats = st.fit_stats(warm)
            stats.write.mode("overwrite").parquet(f"{self.root}/stats")
            stats = spark.read.parquet(f"{self.root}/stats")
            st.pot_thresholds(stats, warm).write.mode("overwrite").parquet(f"{self.root}/thresholds")
            spark.createDataFrame([(cut_ns,)], "cut_ns long").write.mode("overwrite").parquet(f"{self.root}/fit")  # last, so that it marks a complete fit
        stats, thr = spark.read.parquet(f"{self.root}/stats"), spark.read.parquet(f"{self.root}/thresholds")
        low = batch.agg(F.min("ts_ns")).scalar()
        recent = points.where((F.col("ts_ns") > cut_ns) & (F.col("ts_ns") >= low - 2 * self.window_ns))
        cells = windows.align_grid(windows.sliding_windows(recent, self.window_ns, self.stride_ns), self.interval_ns)
        detect.event_scores(cells, stats, thr).write.mode("overwrite").parquet(f"{self.root}/scores/batch={batch_id}")

    def _fitted_until(self, spark: SparkSession) -> int | None:
        """End of the warm-up if the fit is complete."""
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/fit/_SUCCESS")
        if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            return None
        return spark.read.parquet(f"{self.root}/fit").first()["cut_ns"]

    def scores(self, spark: SparkSession) -> DataFrame:
        """All window scores; a window scored in several batches keeps its newest score."""
        s = spark.read.parquet(f"{self.root}/scores")
        key = ["w_start", "w_end", "entity_id", "metric_id"]
        return s.groupBy(*key).agg(F.max_by("score", "batch").alias("score"), F.max_by("direction", "batch").alias("direction"))
