"""Very many small files into few balanced ones, each record once.

Every row gets a digest of its record (payload compared as JSON value) and a code along a Hilbert curve through the
dimensions; without the payloads these are written once, a narrow table. Copies are found in it by (ids, digest), with partial
aggregation before the shuffle, so that a group of copies of any size crosses it once per task. The records are sorted along
the curve by range; running sums of their bytes over the exact codes are the cumulative histogram, and its equal parts are
the files: a border may lie anywhere, inside a code too, so that no code or key is too hot for one file. Payloads
are then shuffled by file number, sorted along the curve and written. Last, source and destination are compared by digests and
counts, and only a destination that holds each record once is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions import hilbert
from lamina.functions.jsonvalues import digest
from lamina.session import dropped, fresh_path, spread

CURVE_BITS = 24
#: A file's size, as UTF-8 bytes of its records before compression.
FILE_BYTES = 512 << 20
#: Bytes that a record counts for beside its payload.
RECORD_BYTES = 16


class DigestMismatch(RuntimeError):
    """The destination doesn't hold the records of the source."""


@dataclass(frozen=True)
class Compaction:
    destination: DataFrame
    path: str
    files: int
    records: int
    rows: int


def _coded(df: DataFrame, keep: list[str], dims: tuple[str, str], payload: str, low: list[int], high: list[int]) -> DataFrame:
    """``keep``, and of each row its digest, code and size; the payload stays behind."""
    size = F.coalesce(F.octet_length(payload), F.lit(0)).cast("bigint") + RECORD_BYTES
    rows = df.select(*keep, *[F.col(c).alias(f"__d{k}") for k, c in enumerate(dims)], size.alias("__bytes"), F.col(payload).alias("__payload"))
    schema = T.StructType([*rows.select(*keep, "__bytes").schema.fields, T.StructField("__digest", T.BinaryType()), T.StructField("__code", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            axes = []
            for k, (a, b) in enumerate(zip(low, high)):
                column = batch.column(len(keep) + k)
                axes.append(hilbert.scaled(column.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False), ~column.is_null().to_numpy(zero_copy_only=False), a, b, CURVE_BITS))
            extra = [batch.column(len(keep) + 2), pa.array([digest(t) for t in batch.column(len(keep) + 3).to_pylist()], pa.binary()), pa.array(hilbert.codes(axes, CURVE_BITS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *extra], names=schema.names)

    return rows.mapInArrow(run, schema)


def _fingerprint(*columns: Column) -> list[Column]:
    """Of a set of rows: how many, and their 64-bit hashes together."""
    return _together(F.xxhash64(*columns))


def _together(h: Column) -> list[Column]:
    """Hashes by exclusive or, and by the sum of their lowest bits, as two equal ones cancel each other out. No sum of 2^43 rows overflows."""
    return [F.count(F.lit(1)).alias("n"), F.struct(F.bit_xor(h), F.sum(h.bitwiseAND(F.lit((1 << 20) - 1)))).alias("h")]


def _place(order: tuple[str, str], ends: list) -> Column:
    """A row's place as one value that sorts like ``order``, whose least and greatest values are ``ends``. Whole numbers whose ranges fit
    64 bits together become one such number, which a hash aggregate can keep the least of; others a struct."""
    if all(isinstance(x, int) for x in ends):
        (low, high), (least, most) = ends[:2], ends[2:]
        width = most - least + 1
        if (high - low + 1) * width < 1 << 62:
            return (F.col(order[0]).cast("bigint") - F.lit(low)) * F.lit(width) + (F.col(order[1]).cast("bigint") - F.lit(least))
    return F.struct(*order)


def running(df: DataFrame, size: str) -> tuple[DataFrame, int]:
    """A sorted frame with, as ``__before``, the sum of ``size`` over all rows ahead; and the whole sum. Tasks sum their own rows as
    they stream by; one number per task comes to the driver and goes back."""
    rows = df.withColumn("__task", F.spark_partition_id())
    schema = T.StructType([*rows.schema.fields, T.StructField("__before", T.LongType())])
    at = rows.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sizes = batch.column(at).to_numpy(zero_copy_only=False)
            sums = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - sizes + total, pa.int64())], names=schema.names)
            total += int(sums[-1]) if len(sums) else 0

    spark = df.sparkSession
    path = fresh_path(spark, "running")
    rows.mapInArrow(run, schema).write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    offsets, total = [], 0
    for r in out.groupBy("__task").agg(F.sum(size).alias("n")).orderBy("__task").collect():
        offsets.append((r["__task"], total))
        total += r["n"]
    ahead = spark.createDataFrame(offsets, "__task int, __offset long")
    return out.join(F.broadcast(ahead), "__task").withColumn("__before", F.col("__before") + F.col("__offset")).drop("__task", "__offset"), total


def compact(df: DataFrame, order: tuple[str, str] = ("file_id", "row_no"), dims: tuple[str, str] = ("event_id", "org_id"),
            payload: str = "payload", path: str | None = None, file_bytes: int = FILE_BYTES) -> Compaction:
    """Writes each record (``dims``, ``payload``) once, as the first of its rows by ``order`` has it, and checks the result.

    Defined results: nulls in ``dims`` and ``payload`` are values, equal to each other; a payload that is no JSON is
    compared as text; an empty table gives one empty file; ``order`` must be unique and not null; other columns are left
    out. Files differ by no more than a record's size. Raises DigestMismatch, before anything is returned, if a record is
    missing, doubled or altered.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "compacted")
    rows = df.select(*order, *dims, payload)
    whole = F.xxhash64(*order, *dims, payload)
    bounds = rows.agg(*[f(c).cast("bigint") for c in dims for f in (F.min, F.max)], *[f(c) for c in order for f in (F.min, F.max)]).first()
    low, high = [x or 0 for x in bounds[:4:2]], [x or 0 for x in bounds[1:4:2]]
    place = _place(order, list(bounds[4:]))

    def staged(table: DataFrame, what: str) -> DataFrame:
        table.write.parquet(f"{path}.{what}")
        return spark.read.schema(table.schema).parquet(f"{path}.{what}")

    tagged = spread(rows).withColumns({"__place": place, "__whole": whole})
    narrow = staged(_coded(tagged, [*dims, "__place", "__whole"], dims, payload, low, high), "rows")
    key = [*dims, "__digest"]
    records = staged(narrow.groupBy(*key, "__code").agg(F.min("__place").alias("__place"), F.max("__bytes").alias("__bytes"), F.count(F.lit(1)).alias("copies")), "records")
    along, total = running(records.orderBy("__code", *key), "__bytes")
    files = max(1, -(-total // file_bytes))
    number = F.floor(F.col("__before") * files / F.lit(max(total, 1))).cast("int")
    numbers = along.select("__place", "copies", "__code", "__digest", F.least(number, F.lit(files - 1)).alias("file_no"))
    placed = rows.withColumn("__place", place).join(numbers, "__place").select("file_no", *order, *dims, payload, "copies", "__code", "__digest")
    final = placed.drop("__digest", "__code")
    placed.repartitionById(files, F.col("file_no")).sortWithinPartitions("__code", *dims, "__digest").select(*final.columns).write.parquet(path)
    destination = spark.read.schema(final.schema).parquet(path)
    # Each side is digested anew: the source's rows, which must be those that were staged, and the files, which must hold of each
    # record that row which the staged ones say is its first.
    hashes = _together(F.col("w"))
    wanted = narrow.groupBy(*key).agg(F.min_by("__whole", "__place").alias("w")).agg(*hashes).first()
    held = destination.agg(*_fingerprint(*order, *dims, payload), F.sum("copies").alias("rows")).first()
    if (wanted["n"], wanted["h"]) != (held["n"], held["h"]):
        raise DigestMismatch(f"source has {wanted['n']} records, hash {wanted['h']}; destination {held['n']}, hash {held['h']}")
    source, kept = rows.agg(*_fingerprint(*order, *dims, payload)).first(), narrow.select(F.col("__whole").alias("w")).agg(*hashes).first()
    if (source["n"], source["h"]) != (kept["n"], kept["h"]):
        raise DigestMismatch(f"source has {source['n']} rows, hash {source['h']}; {kept['n']} were read, hash {kept['h']}")
    if source["n"] != (held["rows"] or 0):
        raise DigestMismatch(f"source has {source['n']} rows; the records of the destination stand for {held['rows']}")
    dropped(spark, f"{path}.rows", f"{path}.records")
    return Compaction(destination, path, files, wanted["n"], source["n"])


def redundant_rows(df: DataFrame, order: tuple[str, str] = ("file_id", "row_no"), **how) -> DataFrame:
    """The rows of the source that the compacted destination doesn't hold: each is a copy of an earlier row. Both sides of
    the join have unique keys, so no key is hot."""
    done = compact(df, order, **how)
    return df.select(*order).join(done.destination.select(*order), list(order), "left_anti")
