"""New files of a growing folder, merged as they come.

Each micro-batch is adapted to a schema that was fixed when the stream began, and appended to a Parquet folder. The sink
names its folder by the batch's number, so a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.operators.adapt import adapt
from lamina.plans.types import schema_of, to_spark


def append_adapted(stream: DataFrame, target: pa.Schema, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    source = schema_of(stream.schema)

    def sink(batch: DataFrame, number: int) -> None:
        adapt(batch, source, target).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_folder(spark: SparkSession, folder: str, schema: pa.Schema) -> DataFrame:
    from pyspark.sql import types as T

    return spark.readStream.schema(T.StructType([T.StructField(f.name, to_spark(f.type)) for f in schema])).parquet(folder)


def read_appended(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output).drop("batch")


def windowed_counts(stream: DataFrame, timestamp: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per window and key; a window is final once the watermark has passed it."""
    watermarked = stream.withWatermark(timestamp, late)
    return watermarked.groupBy(F.window(timestamp, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
