"""Whether two tables hold the same rows, and whether one is sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.operators import merge


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many rows, counted with their repetitions, only the left and only the right has."""
    sides = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("side"), "n") for k, df in enumerate((left.exceptAll(right), right.exceptAll(left)))]
    only = lambda k, name: F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(name)
    return sides[0].unionByName(sides[1]).agg(only(0, "left_only"), only(1, "right_only"))


def same_shape(left: DataFrame, right: DataFrame) -> bool:
    return left.schema.simpleString() == right.schema.simpleString()


def out_of_order(spark: SparkSession, folder: str, field: str) -> DataFrame:
    """(``source``, ``row``) of the rows of a written table that sort before the row ahead of them, files taken in the order of their names:
    no value after a null, none that falls. Empty if the table is sorted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    paths = sorted(f.getPath().toString() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.getPath().getName().startswith("part-"))
    rows = spark.read.parquet(*paths).select(F.col(f"`{field}`"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias(merge.ROW))
    tagged = merge.numbered(rows, paths)
    inside = merge.disorder(tagged, field).select(F.col(merge.SOURCE).alias("source"), F.col(merge.ROW).alias("row"))
    # Between files: the ends of those that have rows.
    key = F.struct(F.col(f"`{field}`").isNull().alias("none"), F.col(f"`{field}`").alias("k"))
    ends = tagged.groupBy(merge.SOURCE).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    before = F.lag("high").over(Window.orderBy(merge.SOURCE))
    between = ends.withColumn("before", before).filter(F.col("before").isNotNull() & (F.col("before") > F.col("low"))).select(F.col(merge.SOURCE).alias("source"), F.lit(0).cast("bigint").alias("row"))
    return inside.unionByName(between).distinct()
