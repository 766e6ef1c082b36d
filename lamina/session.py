"""What the operators need from a session: tables, a shared folder, time."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none (tests, one machine) a temporary folder is
    made and set, so that later calls find the same one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads neither compute it again nor depend on
    the executors that made it."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 00:00 UTC. A timestamp without zone is read as UTC."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType) and df.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        since = F.col(name) - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        return (since.cast("interval second").cast("decimal(24,6)") * 1000000).cast("bigint")
    return F.unix_micros(F.col(name).cast("timestamp"))


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that are no longer needed, through Hadoop's file systems."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """A plain scan for work in Python that costs far more than a shuffle of its rows. Small tables have fewer row groups than there are
    cores, and one task each; they are dealt out to all cores. A scan that gives every core a task stays as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if tasks(df) >= cores else df.repartition(cores)


def tasks(df: DataFrame) -> int:
    """Into how many tasks of some work a scan falls at least: one for each file, and one for every so many bytes of large ones."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(len(df._jdf.inputFiles()), size // int(conf.filesMaxPartitionBytes()))
