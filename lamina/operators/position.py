"""The place of each row in a sorted table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import written


def with_position(df: DataFrame, name: str = "pos") -> DataFrame:
    """A sorted frame with its rows numbered from 1. A window over everything would be one task; here each sorted partition numbers
    its rows, and what lies before it, one number per partition, is added."""
    rows = written(df.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}), "sorted")
    before, total = {}, 1
    for r in rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).orderBy("__p").collect():
        before[r["__p"]], total = total, total + r["n"]
    offsets = df.sparkSession.createDataFrame(list(before.items()), "__p int, __before long")
    place = F.col("__m") - F.shiftleft(F.col("__p").cast("long"), 33) + F.col("__before")
    return rows.join(F.broadcast(offsets), "__p").withColumn(name, place).drop("__p", "__m", "__before")
