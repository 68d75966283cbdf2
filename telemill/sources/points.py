"""Readers, writers and wire-format adapters for metric points.

Each ``parse_*`` works on a DataFrame of raw records so that it can sit behind
any source (files, Kafka, a table); each ``read_*`` adds a file source.
Unparseable records are returned as a reject table, never dropped silently.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.schemas import ATTRS
from telemill.session import pin

_CORRUPT = "_corrupt_record"
_RAW = T.StructType(
    [
        T.StructField("ts_ns", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("entity_id", "entity_type", "metric_id", "value", "unit", "source")],
        T.StructField("sample_interval_ns", T.LongType()),
        T.StructField("quality", T.StringType()),
        T.StructField("attrs", ATTRS),
        T.StructField(_CORRUPT, T.StringType()),
    ]
)


def coerce_value(text: Column) -> Column:
    """Empty, null, none and nan are null; true and false are 1 and 0; the rest must be a number."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.isNull() | t.isin("", "null", "none", "nan"), None)
        .when(t == "true", 1.0)
        .when(t == "false", 0.0)
        .otherwise(t.try_cast("double"))
    )


def _is_bad_number(text: Column) -> Column:
    t = F.lower(F.trim(text))
    known = t.isNull() | t.isin("", "null", "none", "nan", "true", "false")
    return ~known & t.try_cast("double").isNull()


def parse_points_jsonl(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(points, rejects) from JSON lines; blank lines are skipped."""
    extra = [c for c in lines.columns if c != column]
    text = F.trim(F.col(column))
    kept = lines.where(text != "").select(*extra, text.alias("__line"))
    parsed = pin(kept, "p", F.from_json("__line", _RAW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    p = lambda n: F.col(f"p.{n}")
    missing = p("ts_ns").isNull() | p("entity_id").isNull() | p("entity_type").isNull() | p("metric_id").isNull()
    reason = (
        F.when(F.col("p").isNull() | p(_CORRUPT).isNotNull(), "bad_json")
        .when(missing, "missing_field")
        .when(_is_bad_number(p("value")), "bad_value")
    )
    parsed = parsed.withColumn("reason", reason)
    good = parsed.where(F.col("reason").isNull()).select(
        *extra, p("ts_ns").alias("ts_ns"), p("entity_id").alias("entity_id"), p("entity_type").alias("entity_type"),
        p("metric_id").alias("metric_id"), coerce_value(p("value")).alias("value"), p("unit").alias("unit"),
        F.coalesce(p("source"), F.lit("replay")).alias("source"), p("sample_interval_ns").alias("sample_interval_ns"),
        F.coalesce(p("quality"), F.lit("observed")).alias("quality"),
        F.coalesce(p("attrs"), F.create_map().cast(ATTRS)).alias("attrs"),
    )
    return good, parsed.where(F.col("reason").isNotNull()).select(*extra, F.col("__line").alias("line"), "reason")


CSV_REQUIRED = ("ts_ns", "entity_id", "entity_type", "metric_id", "value")
CSV_OPTIONAL = ("quality", "source", "unit", "sample_interval_ns", "attrs")


def csv_rows_to_points(rows: DataFrame) -> DataFrame:
    """Text columns of a CSV replay to points; a missing required column is an error."""
    lacking = [c for c in CSV_REQUIRED if c not in rows.columns]
    if lacking:
        raise ValueError(f"CSV lacks required columns {lacking}")
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    extra = [c for c in rows.columns if c not in CSV_REQUIRED + CSV_OPTIONAL]
    return rows.select(
        *extra, F.col("ts_ns").cast("long").alias("ts_ns"), "entity_id", "entity_type", "metric_id",
        coerce_value(F.col("value")).alias("value"), has("unit").alias("unit"),
        F.coalesce(has("source"), F.lit("replay")).alias("source"),
        has("sample_interval_ns").cast("long").alias("sample_interval_ns"),
        F.coalesce(has("quality"), F.lit("observed")).alias("quality"),
        F.coalesce(F.from_json(has("attrs"), ATTRS), F.create_map().cast(ATTRS)).alias("attrs"),
    )


def parse_points_csv(lines: DataFrame, header: list[str], column: str = "value") -> DataFrame:
    """S2 on raw CSV lines without their header."""
    schema = ", ".join(f"`{h}` string" for h in header)
    extra = [c for c in lines.columns if c != column]
    rows = lines.select(*extra, F.from_csv(column, schema, {"escape": '"'}).alias("r")).select(*extra, "r.*")
    return csv_rows_to_points(rows)


def read_points_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_points_jsonl(spark.read.text(path))


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    return csv_rows_to_points(spark.read.option("header", True).option("escape", '"').csv(path))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """S3: choose the reader by extension (of the file, glob or directory name)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        return read_points_csv(spark, path)
    if ext in (".jsonl", ".json", ".ndjson"):
        return read_points_jsonl(spark, path)[0]
    raise ValueError(f"unsupported point file extension: {ext or path}")


POINT_COLUMNS = ("attrs", "entity_id", "entity_type", "metric_id", "quality", "sample_interval_ns", "source", "ts_ns", "unit", "value")


def format_points_jsonl(df: DataFrame) -> DataFrame:
    """One JSON line per point, keys in order; empty attrs and absent unit or interval are left out."""
    cols = [F.when(F.size("attrs") > 0, F.col("attrs")).alias("attrs"), *POINT_COLUMNS[1:]]
    extra = [c for c in df.columns if c not in POINT_COLUMNS]
    return df.select(*extra, F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("line"))


def write_points_jsonl(df: DataFrame, path: str) -> None:
    format_points_jsonl(df.select(*POINT_COLUMNS)).write.text(path)


_NUMBER_POINT = "struct<time_unix_nano:long,as_double:double,as_int:long,attributes:map<string,string>>"
_OTLP = (
    "struct<resource:map<string,string>,scope:struct<name:string>,"
    f"metrics:array<struct<name:string,unit:string,points:array<{_NUMBER_POINT}>>>>"
)


def otlp_to_points(df: DataFrame, column: str = "value", source: str = "otlp") -> DataFrame:
    """Resource -> metric -> number point nesting to points."""
    extra = [c for c in df.columns if c != column]
    d = pin(df, "d", F.from_json(column, _OTLP)).select(*extra, "d")
    res = lambda k: F.nullif(F.col("d.resource")[k], F.lit(""))
    m = d.select(
        *extra, res("service.name").alias("svc"),
        F.coalesce(res("host.id"), res("host.name"), F.lit("unknown-host")).alias("host"),
        F.coalesce(F.col("d.scope.name"), F.lit("")).alias("scope"), F.explode("d.metrics").alias("m"),
    )
    p = m.select("*", F.explode("m.points").alias("p"))
    return p.select(
        *extra, F.coalesce(F.col("p.time_unix_nano"), F.lit(0)).alias("ts_ns"),
        F.coalesce("svc", "host").alias("entity_id"),
        F.when(F.col("svc").isNotNull(), "pod").otherwise("host").alias("entity_type"),
        F.col("m.name").alias("metric_id"), F.coalesce(F.col("p.as_double"), F.col("p.as_int").cast("double")).alias("value"),
        F.col("m.unit").alias("unit"), F.lit(source).alias("source"), F.lit(None).cast("long").alias("sample_interval_ns"),
        F.lit("observed").alias("quality"),
        F.map_concat(
            F.map_filter(F.coalesce("p.attributes", F.create_map().cast(ATTRS)), lambda k, v: k != "scope"),
            F.create_map(F.lit("scope"), F.col("scope")),
        ).alias("attrs"),
    )


def prom_text_to_points(
    lines: DataFrame, labels: dict[str, str] | None = None, entity_id: str = "prom-host", column: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Prometheus text lines to (points, rejects). Labels split at every comma, quoted or not."""
    extra = [c for c in lines.columns if c != column]
    text = F.trim(F.col(column))
    src = lines.where((text != "") & ~text.startswith("#")).select(*extra, text.alias("line"))
    braced = F.instr("line", "{") > 0
    head = F.struct(
        braced.alias("braced"),
        F.when(braced, F.substring_index("line", "{", 1)).otherwise(F.substring_index("line", " ", 1)).alias("name"),
        F.when(braced, F.regexp_extract("line", r"\{([^}]*)\}", 1)).otherwise(F.lit("")).alias("labels"),
        F.trim(F.when(braced, F.regexp_extract("line", r"\}(.*)$", 1)).otherwise(F.regexp_extract("line", r"^\S+ (.*)$", 1))).alias("rest"),
    )
    cut = pin(src, "h", head)
    pairs = F.filter(F.split("h.labels", ","), lambda kv: F.instr(kv, "=") > 0)
    entries = F.transform(
        pairs,
        lambda kv: F.struct(
            F.trim(F.regexp_extract(kv, r"^([^=]*)=", 1)).alias("key"),
            F.regexp_replace(F.trim(F.regexp_extract(kv, r"=(.*)$", 1)), r'^"+|"+$', "").alias("value"),
        ),
    )
    fixed = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (labels or {}).items()])
    body = F.struct(F.split("h.rest", r"\s+").alias("parts"), (F.concat(fixed, entries) if labels else entries).alias("all"))
    cut = pin(cut, "b", body)
    # later labels of a line win, and labels of a line win over the defaults
    keys = F.array_distinct(F.transform("b.all", lambda e: e["key"]))
    last_of = lambda k: F.element_at(F.filter("b.all", lambda e: e["key"] == k), -1)["value"]
    parts = F.col("b.parts")
    value = F.get(parts, F.lit(0)).try_cast("double")
    stamp = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("double"))
    empty = F.coalesce(F.col("h.rest") == "", F.lit(True))
    bad = ~empty & (value.isNull() | ((F.size(parts) > 1) & stamp.isNull()))
    bad = bad | (~F.col("h.braced") & (F.instr("line", " ") == 0))
    parsed = cut.select(
        *extra, "line", F.col("h.name").alias("metric_id"), value.alias("v"), stamp.alias("s"),
        F.map_from_arrays(keys, F.transform(keys, last_of)).alias("attrs"), F.coalesce(bad, F.lit(True)).alias("bad"), empty.alias("empty"),
    )
    good = parsed.where(~F.col("bad") & ~F.col("empty")).select(
        *extra, F.coalesce((F.col("s") * F.lit(1e9)).cast("long"), F.lit(0)).alias("ts_ns"),
        F.lit(entity_id).alias("entity_id"), F.lit("host").alias("entity_type"), "metric_id", F.col("v").alias("value"),
        F.lit(None).cast("string").alias("unit"), F.lit("prometheus").alias("source"),
        F.lit(None).cast("long").alias("sample_interval_ns"), F.lit("observed").alias("quality"), "attrs",
    )
    return good, parsed.where(F.col("bad")).select(*extra, "line", F.lit("unparseable").alias("reason"))


# Kind of trace event, entity type, column naming the entity, metric, unit.
TRACE_KINDS = [
    ("sched_switch", "thread", "tid", "scheduler.off_cpu", "ns"),
    ("futex", "thread", "tid", "futex.wait_time", "ns"),
    ("syscall_enter", "syscall", "name", "syscall.count", "1"),
    ("block_rq_issue", "device", "dev", "block.issue", "1"),
    ("block_rq_complete", "device", "dev", "block.complete", "1"),
    ("irq_softirq", "thread", "tid", "irq.softirq.duration", "ns"),
    ("hardirq_entry", "thread", "tid", "irq.hardirq.duration", "ns"),
]


def trace_events_to_points(df: DataFrame, ts_base_ns: int = 0) -> DataFrame:
    """Kernel trace events (type, ts_ns, tid, pid, dev, name, value, delta_ns, comm, state) to points."""
    kinds = df.sparkSession.createDataFrame(TRACE_KINDS, "type string, entity_type string, id_from string, metric_id string, unit string")
    typed = df.withColumn("type", F.coalesce("type", F.lit("sched_switch")))
    j = typed.join(F.broadcast(kinds), "type")  # seven rows
    tid = F.coalesce(F.col("tid").cast("string"), F.lit("0"))
    entity = (
        F.when(F.col("id_from") == "tid", tid)
        .when(F.col("id_from") == "dev", F.coalesce(F.col("dev").cast("string"), F.lit("0")))
        .otherwise(F.coalesce("name", F.lit("unknown")))
    )
    text = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d))
    extra = [c for c in ("seq",) if c in df.columns]
    return j.select(
        *extra, (F.lit(ts_base_ns) + F.coalesce("ts_ns", F.lit(0))).alias("ts_ns"), entity.alias("entity_id"), "entity_type", "metric_id",
        F.coalesce(F.col("value").cast("double"), F.col("delta_ns").cast("double"), F.lit(1.0)).alias("value"), "unit",
        F.lit("ebpf").alias("source"), F.lit(None).cast("long").alias("sample_interval_ns"), F.lit("observed").alias("quality"),
        F.create_map(
            F.lit("pid"), text("pid", "0"), F.lit("tid"), tid, F.lit("comm"), text("comm", ""), F.lit("state"), text("state", "")
        ).alias("attrs"),
    )


def profile_to_points(df: DataFrame, interval_ns: int = 9_000_000) -> DataFrame:
    """One point per stack frame of a sample (ts_ns, tid, pid, comm, stack of symbol, binary, build_id)."""
    extra = [c for c in ("seq",) if c in df.columns]
    f = df.select("*", F.posexplode("stack").alias("depth", "f"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return f.select(
        *extra, "ts_ns", F.concat(F.lit("func:"), "comm", F.lit(":"), "f.symbol").alias("entity_id"), F.lit("function").alias("entity_type"),
        F.lit("profile.sample_count").alias("metric_id"), F.lit(1.0).alias("value"), F.lit("count").alias("unit"),
        F.lit("profile").alias("source"), F.lit(interval_ns).cast("long").alias("sample_interval_ns"), F.lit("observed").alias("quality"),
        F.create_map(
            F.lit("pid"), text("pid"), F.lit("tid"), text("tid"), F.lit("comm"), text("comm"), F.lit("symbol"), text("f.symbol"),
            F.lit("binary"), text("f.binary"), F.lit("build_id"), text("f.build_id"), F.lit("depth"), text("depth"),
            F.lit("join_key"), F.concat_ws(":", F.col("pid").cast("string"), F.col("tid").cast("string")),
        ).alias("attrs"),
    )
