"""Query registry and the input relations the registered queries share.

Each shared relation exists twice: as a DataFrame built from the given tables
and as an SQL common table expression, so a query and its check read the same
input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.integers import floor_div
from telemill.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}

HOUR = 3_600_000_000_000
DAY = 24 * HOUR


def cte(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    _CTES[name] = (sql.strip(), uses)


def _collect(names, seen: list[str]) -> list[str]:
    for n in names:
        if n in seen:
            continue
        _collect(_CTES[n][1], seen)
        seen.append(n)
    return seen


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir)``; ``sql`` may start with its own WITH list."""

    def deco(fn):
        QUERIES[name] = lambda spark, sf: fn(prepare(spark), sf)
        if sql is not None:
            body = sql.strip()
            parts = [f"{n} AS ({_CTES[n][0]})" for n in _collect(uses, [])]
            if body.upper().startswith("WITH "):
                recursive = body.upper().startswith("WITH RECURSIVE ")
                body = body[15:] if recursive else body[5:]
                head = "WITH RECURSIVE " if recursive else "WITH "
                ORACLES[name] = head + ", ".join(parts) + (", " if parts else "") + body
            else:
                ORACLES[name] = (("WITH " + ", ".join(parts) + " ") if parts else "") + body
        return fn

    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(col) -> F.Column:
    """Microseconds since the epoch of a zoneless timestamp, read as UTC."""
    return F.unix_micros(F.col(col).cast("timestamp"))


def r6(col):
    return F.round(col, 6)


# ---- points: metric observations derived from events ----
cte(
    "points",
    """
SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, 'e' || (user_id % 10) AS entity_id,
       event_type AS metric_id, k, user_id,
       CASE WHEN k % 20 = 0 THEN NULL ELSE value END AS value,
       CASE k % 20 WHEN 0 THEN 'missing' WHEN 1 THEN 'stale' WHEN 2 THEN 'out_of_order' ELSE 'observed' END AS quality
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
""",
)


def points(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    m = k % 20
    return e.select(
        F.col("event_id").alias("seq"),
        (micros("ts") * 1000).alias("ts_ns"),
        F.concat(F.lit("e"), (F.col("user_id") % 10).cast("string")).alias("entity_id"),
        F.col("event_type").alias("metric_id"),
        k.alias("k"),
        "user_id",
        F.when(m == 0, None).otherwise(F.col("value")).alias("value"),
        F.when(m == 0, "missing").when(m == 1, "stale").when(m == 2, "out_of_order").otherwise("observed").alias("quality"),
    )


# ---- ticks: per thread and day, ten cumulative counters that sometimes wrap ----
_SUMS = ",\n       ".join(f"CAST(sum(CASE WHEN k % 10 = {j} THEN inc ELSE 0 END) AS BIGINT) AS d{j}" for j in range(10))
_CUMS = ",\n       ".join(
    f"CAST(sum(d{j}) OVER (PARTITION BY tid ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS BIGINT) % 1500 AS c{j}" for j in range(10)
)
cte(
    "ticks",
    f"""
SELECT tid, tid // 5 AS tgid, tid % 3 AS host, ts_ns, {_CUMS}, n, valid, gauge
FROM (SELECT user_id AS tid, ts_ns // {DAY} * {DAY} AS ts_ns, {_SUMS}, count(*) AS n,
             CASE WHEN min(k) % 4 = 0 THEN 0 ELSE 1 END AS valid, max(v) AS gauge
      FROM (SELECT user_id, epoch_us(ts) * 1000 AS ts_ns, CAST(floor(value) AS BIGINT) AS inc, value AS v,
                   CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
      GROUP BY 1, 2)
""",
)


def ticks(spark, sf) -> DataFrame:
    from telemill.operators import ordered

    e = table(spark, sf, "events").select(
        F.col("user_id").alias("tid"),
        (floor_div(micros("ts") * 1000, F.lit(DAY)) * DAY).alias("ts_ns"),
        F.floor("value").cast("long").alias("inc"),
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    daily = e.groupBy("tid", "ts_ns").agg(
        *[F.sum(F.when(F.col("k") % 10 == j, F.col("inc")).otherwise(0)).alias(f"d{j}") for j in range(10)],
        F.count(F.lit(1)).alias("n"),
        F.when(F.min("k") % 4 == 0, 0).otherwise(1).alias("valid"),
        F.max("v").alias("gauge"),
    )
    cum = ordered.running(
        daily, ["tid"], ["ts_ns"], {f"c{j}": ("sum", F.col(f"d{j}")) for j in range(10)}, ordered.by_time("ts_ns", 8 * DAY)
    )
    return cum.select(
        "tid",
        F.floor(F.col("tid") / 5).cast("long").alias("tgid"),
        (F.col("tid") % 3).alias("host"),
        "ts_ns",
        *[(F.col(f"c{j}") % 1500).alias(f"c{j}") for j in range(10)],
        "n",
        "valid",
        "gauge",
    )


# ---- train / validation / test labels on points ----
cte(
    "labelled",
    """
SELECT p.*, CASE WHEN ts_ns <= c1 THEN 'train' WHEN ts_ns <= c2 THEN 'val' ELSE 'test' END AS split
FROM points p, (SELECT t0 + CAST(trunc((t1 - t0) * 0.6::DOUBLE) AS BIGINT) AS c1, t0 + CAST(trunc((t1 - t0) * 0.8::DOUBLE) AS BIGINT) AS c2
      FROM (SELECT min(ts_ns) AS t0, max(ts_ns) AS t1 FROM points))
""",
    ("points",),
)
