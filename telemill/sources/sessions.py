"""Session tables, logs, folded stacks and wide machine files."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.operators import ordered

SCHEMA_VERSION = "2"
FOLDERS = 64  # folders of a table; a session has one of them, many sessions share it
FOLDER = "session_folder"
# The two tables that every session has. All others are declared in the store itself.
TABLES: dict[str, str] = {
    "meta": "key string, value string",
    "host_cpu": "ts_ns bigint, cpu_idx bigint, usr bigint, nice bigint, sys bigint, idle bigint, iowait bigint, irq bigint, softirq bigint, steal bigint, guest bigint, guest_nice bigint",
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def declared_tables(spark: SparkSession, root: str) -> dict[str, T.StructType]:
    """The typed tables of a store: those of every session and those declared in its catalog."""
    own = spark.read.schema("name string, ddl string").parquet(f"{root}/catalog").collect() if _exists(spark, f"{root}/catalog") else []  # a row per table
    return {n: T.StructType.fromDDL(d) for n, d in [*TABLES.items(), *((r["name"], r["ddl"]) for r in own)]}


def declare_tables(spark: SparkSession, root: str, tables: dict[str, str]) -> None:
    """Add typed tables (name to DDL) to a store's catalog; a table keeps the type it has."""
    known = declared_tables(spark, root)
    new = {}
    for name, ddl in tables.items():
        if name not in known:
            new[name] = ddl
        elif known[name] != T.StructType.fromDDL(ddl):
            raise ValueError(f"table {name} is declared as {known[name].simpleString()}")
    if new:
        spark.createDataFrame(list(new.items()), "name string, ddl string").coalesce(1).write.mode("append").parquet(f"{root}/catalog")


def _type_of(spark: SparkSession, root: str, name: str, ddl: str | None) -> T.StructType:
    if ddl is not None:
        return T.StructType.fromDDL(ddl)
    known = declared_tables(spark, root)
    if name not in known:
        raise ValueError(f"no table {name!r} is declared in {root}; there are {', '.join(sorted(known))}")
    return known[name]


def write_session_table(df: DataFrame, root: str, name: str, ddl: str | None = None) -> None:
    """Append rows (with their ``session``) to a session table; columns that ``df`` lacks stay null.

    A folder per session would cost more than its rows where sessions are many.
    """
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in _type_of(df.sparkSession, root, name, ddl).fields]
    rows = df.select("session", *cols).withColumn(FOLDER, (F.crc32("session") % FOLDERS).cast("int"))
    rows.hint("rebalance", FOLDER).sortWithinPartitions(FOLDER, "session").write.mode("append").partitionBy(FOLDER).parquet(f"{root}/{name}")


def _typed(reader, kind: T.StructType, path: str, sessions: list[str] | None = None) -> DataFrame:
    """Rows of a table; its sessions are sorted inside the files of a folder, so ``sessions`` prunes folders and parts of files."""
    df = reader.schema(T.StructType([*kind.fields, T.StructField("session", T.StringType()), T.StructField(FOLDER, T.IntegerType())])).parquet(path)
    if sessions is not None:
        df = df.where(F.col(FOLDER).isin(sorted({zlib.crc32(s.encode()) % FOLDERS for s in sessions})) & F.col("session").isin(sessions))
    return df.drop(FOLDER)


def _supported(spark: SparkSession, root: str, df: DataFrame, sessions: list[str] | None) -> DataFrame:
    meta = _typed(spark.read, T.StructType.fromDDL(TABLES["meta"]), f"{root}/meta", sessions)
    good = meta.where((F.col("key") == "schema_version") & (F.col("value") == SCHEMA_VERSION)).select("session").distinct()
    return df.join(good, "session", "left_semi")


def read_session_table(spark: SparkSession, root: str, name: str, sessions: list[str] | None = None, ddl: str | None = None) -> DataFrame:
    """Rows of the sessions with the supported schema version; ``sessions`` prunes partitions."""
    return _supported(spark, root, _typed(spark.read, _type_of(spark, root, name, ddl), f"{root}/{name}", sessions), sessions)


def stream_session_table(spark: SparkSession, root: str, name: str, sessions: list[str] | None = None, ddl: str | None = None) -> DataFrame:
    """New rows of a session table as they are written; a session counts once its ``meta`` has the supported version."""
    return _supported(spark, root, _typed(spark.readStream, _type_of(spark, root, name, ddl), f"{root}/{name}", sessions), sessions)


def unsupported_sessions(spark: SparkSession, root: str) -> DataFrame:
    meta = _typed(spark.read, T.StructType.fromDDL(TABLES["meta"]), f"{root}/meta")
    version = meta.groupBy("session").agg(F.max(F.when(F.col("key") == "schema_version", F.col("value"))).alias("version"))
    return version.where(F.col("version").isNull() | (F.col("version") != SCHEMA_VERSION))


_HEAD = r"^\[(.*?)\] \[(\w+)\] (.*)$"


def parse_logs(df: DataFrame, keys: list[str], chunk: Column, seq: str = "seq", line: str = "line") -> DataFrame:
    """Log records; a line without a head continues the record before it, a leading orphan is INFO."""
    head = F.regexp_like(line, F.lit(_HEAD))
    first = df.groupBy(*keys).agg(F.min(seq).alias("__first"))
    marked = df.join(first, keys).withColumn("__head", head)
    starts = F.col("__head") | (F.col(seq) == F.col("__first"))
    runs = ordered.islands(marked, keys, [seq], starts, chunk, "__rec")
    text = F.when(F.col("__head"), F.regexp_extract(line, _HEAD, 3)).otherwise(F.col(line))
    at_head = F.when(starts, F.struct("__head", line))
    rec = runs.groupBy(*keys, "__rec").agg(
        F.min(seq).alias(seq),
        F.max(at_head).alias("h"),
        F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), text.alias("t")))).alias("parts"),
    )
    part = lambda i: F.when(F.col("h.__head"), F.regexp_extract(F.col(f"h.{line}"), _HEAD, i))
    return rec.select(
        *keys, seq, part(1).alias("time"), F.coalesce(part(2), F.lit("INFO")).alias("level"),
        F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("msg"),
    )


def parse_folded(df: DataFrame, column: str = "line") -> DataFrame:
    """Frames and value of folded stack lines, with the process and thread of its root frames."""
    extra = [c for c in df.columns if c != column]
    text = F.col(column)
    has_space = F.instr(column, " ") > 0
    value = F.substring_index(text, " ", -1).try_cast("double")
    frames = F.filter(F.split(F.expr(f"left({column}, length({column}) - length(substring_index({column}, ' ', -1)) - 1)"), ";"), lambda f: f != "")
    base = df.where(has_space).select(*extra, frames.alias("frames"), value.alias("value"))
    base = base.where(
        F.col("value").isNotNull() & (F.col("value") > 0) & (F.col("value") < float("inf")) & ~F.isnan("value") & (F.size("frames") > 0)
    )
    f0, f1 = F.get("frames", F.lit(0)), F.get("frames", F.lit(1))
    num = lambda f: F.regexp_extract(f, r"^.:([^/]*)", 1).try_cast("long")
    comm = lambda f: F.regexp_extract(f, r"^[^/]*/(.*)$", 1)
    t = F.when(f1.startswith("t:"), f1).when(f0.startswith("t:"), f0)
    is_p = f0.startswith("p:")
    return base.select(
        *extra, "frames", "value", F.when(is_p, num(f0)).alias("tgid"), F.when(is_p, comm(f0)).alias("pcomm"),
        num(t).alias("tid"), comm(t).alias("tcomm"),
    )


def folded_totals(parsed: DataFrame, by: str) -> DataFrame:
    """Total value by ``tgid`` or ``tid``."""
    return parsed.where(F.col(by).isNotNull()).groupBy(by).agg(F.sum("value").alias("total"))


def machine_matrix(train: DataFrame, test: DataFrame, labels: DataFrame, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Long (machine, part, t, channel, value) and (machine, t, label) of the machines present in all three inputs.

    Inputs hold (machine, t, line): ``t`` is the explicit line number and
    ``line`` the comma-separated row or the label.
    """
    names = test.select("machine").distinct().join(train.select("machine").distinct(), "machine", "left_semi")
    names = names.join(labels.select("machine").distinct(), "machine", "left_semi")
    if limit > 0:
        names = names.orderBy("machine").limit(limit)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    kept = both.join(names, "machine", "left_semi")
    long = kept.select("machine", "part", "t", F.posexplode(F.split("line", ",")).alias("channel", "v"))
    out = long.select("machine", "part", "t", "channel", F.trim("v").cast("double").alias("value"))
    lab = labels.join(names, "machine", "left_semi").select("machine", "t", F.trim("line").cast("double").alias("label"))
    return out, lab


def read_machine_matrix(spark: SparkSession, root: str, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """S14 on a folder of converted files: ``t,line...`` per row, one file per machine."""

    def part(sub: str) -> DataFrame:
        raw = spark.read.text(f"{root}/{sub}/machine-*.txt").withColumn("f", F.input_file_name())
        return raw.select(
            F.regexp_extract("f", r"(machine-[^/]*)\.txt$", 1).alias("machine"),
            F.substring_index("value", ",", 1).cast("long").alias("t"),
            F.regexp_extract("value", r"^[^,]*,(.*)$", 1).alias("line"),
        )

    return machine_matrix(part("train"), part("test"), part("test_label"), limit)


def session_catalog(names: DataFrame, column: str = "session") -> DataFrame:
    """Well-formed session names with start time and pid, newest first."""
    ok = names.select(column).distinct().where(F.regexp_like(column, F.lit(r"^\d{8}-\d{6}_\d+$")))
    return ok.select(
        column, F.to_timestamp(F.substring_index(column, "_", 1), "yyyyMMdd-HHmmss").alias("started"),
        F.substring_index(column, "_", -1).cast("long").alias("pid"),
    ).orderBy(F.desc(column))
