"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_written: list[str] = []  # intermediate tables not yet deleted
_named: list[str] = []  # their names in the catalog, where they have one


def builder(app: str = "telemill") -> SparkSession.Builder:
    """Settings a job wants on any cluster; master, memory and parallelism belong to spark-submit."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the only runtime setting results depend on."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Executors of a cluster do not see each other's disks, so a missing setting
    is an error there; only a local master gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by ``clean`` or when Python ends."""
    if not _written:
        atexit.register(lambda: clean(SparkSession.getActiveSession()))
    path = f"{shared_dir(spark)}/telemill-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def fresh_table(spark: SparkSession) -> tuple[str, str]:
    """A new path like that of ``fresh_path`` and a table name for it, which ``clean`` drops too."""
    path = fresh_path(spark)
    _named.append("telemill_" + path.rpartition("-")[2])
    return _named[-1], path


def clean(spark: SparkSession | None) -> None:
    """Delete all intermediate tables of this session; frames that read them end with it."""
    if spark is None or spark.sparkContext._jsc is None:
        return
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")  # the files go below
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Several ordered steps in a row each read their input twice, so a deep chain
    would re-evaluate its source exponentially often; a written table also
    survives the loss of executors.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that the optimizer evaluates once.

    A filter on a plain column is pushed below the projection and takes copies
    of its expression along; parsing would then run once per use. Filters do
    not move below a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))
