"""What Parquet footers say: schemas, row groups, column chunks. Data pages aren't read."""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.plans.widening import fingerprint

#: From so many files on, footers are read by the cluster and not by threads of the driver.
DRIVER_FILES = 256


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        return system.open_input_file(inner)
    return path


def many(spark: SparkSession, paths: list[str], read, columns: str) -> list:
    """``read`` of every path, which gives rows: by threads for few paths, by the cluster for many."""
    if len(paths) < DRIVER_FILES:
        with ThreadPoolExecutor(16) as pool:
            return [row for rows in pool.map(read, range(len(paths)), paths) for row in rows]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row for k, path in zip(batch["k"], batch["path"]) for row in read(k, path)], columns=[c.split()[0] for c in columns.split(", ")], dtype=object)

    frame = spark.createDataFrame(pd.DataFrame({"k": range(len(paths)), "path": paths})).repartition(min(len(paths) // 16, 4096))
    return [tuple(r) for r in frame.mapInPandas(run, columns).collect()]


#: Ends of every order: what is unknown may be as low as the one, nulls are as high as the other.
LOWEST, HIGHEST = (0,), (2,)


@dataclass(frozen=True)
class Group:
    """A row group in an order: its rows' places in the source, and between which keys they lie."""

    source: int
    group: int
    begin: int
    end: int
    low: tuple
    high: tuple


def null_class(rows: int, nulls: int | None) -> str:
    """``none``, ``all`` or ``mixed``; ``unknown`` where the footer doesn't count nulls."""
    return "unknown" if nulls is None else "none" if nulls == 0 else "all" if nulls == rows else "mixed"


def key_bounds(stats, rows: int) -> tuple[tuple, tuple]:
    """Between which keys a chunk's values lie, nulls last. Statistics come as values of the column's type, and compare as its rows do;
    those of doubles leave NaN out and say nothing."""
    if stats is None:
        return LOWEST, HIGHEST
    kind = null_class(rows, stats.null_count if stats.has_null_count else None)
    if kind == "all":
        return HIGHEST, HIGHEST
    if not stats.has_min_max or stats.physical_type in ("DOUBLE", "FLOAT"):
        return LOWEST, HIGHEST
    return (1, stats.min), (1, stats.max) if kind == "none" else HIGHEST


def order_groups(spark: SparkSession, paths: list[str], field: str) -> list[Group]:
    """The row groups of all files with the bounds of the ordering column."""
    def read(k: int, path: str) -> list[Group]:
        meta, out, begin = pq.ParquetFile(_open(path)).metadata, [], 0
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = next((group.column(c).statistics for c in range(group.num_columns) if group.column(c).path_in_schema == field), None)
            if group.num_rows:
                out.append(Group(k, g, begin, begin + group.num_rows, *key_bounds(stats, group.num_rows)))
            begin += group.num_rows
        return out

    import pickle

    if len(paths) < DRIVER_FILES:
        return many(spark, paths, read, "")
    return [pickle.loads(bytes(x)) for (x,) in many(spark, paths, lambda k, path: [(pickle.dumps(g),) for g in read(k, path)], "x binary")]


def rows_and_bytes(spark: SparkSession, paths: list[str], count: bool = True) -> tuple[int, int]:
    """Of all files together; rows only if they are to be counted."""
    def read(k: int, path: str) -> list[tuple[int, int]]:
        opened = _open(path)
        size = os.path.getsize(path) if isinstance(opened, str) else opened.size()
        return [(pq.ParquetFile(opened).metadata.num_rows if count else 0, size)]

    found = many(spark, paths, read, "n long, b long")
    return sum(int(n) for n, _ in found), sum(int(b) for _, b in found)


def tails(paths: list[str]) -> list[tuple]:
    """(file, bytes, where its footer begins, footer bytes, magic) of each file."""
    def read(path: str) -> tuple:
        opened = _open(path)
        with open(opened, "rb") if isinstance(opened, str) else opened as f:
            size = f.seek(0, 2) and f.tell()
            f.seek(size - 8)
            end = f.read(8)
        length = int.from_bytes(end[:4], "little")
        return path, size, size - 8 - length, length, end[4:].decode("ascii", "replace")

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(read, paths))


def read_schema(path: str) -> pa.Schema:
    return pq.read_schema(_open(path))


def distinct_schemas(spark: SparkSession, paths: list[str]) -> tuple[list[pa.Schema], list[int]]:
    """The distinct schemas in the order in which they first appear, and the number of each file's schema."""
    if len(paths) < DRIVER_FILES:
        with ThreadPoolExecutor(16) as pool:
            seen = list(pool.map(read_schema, paths))
        raw = [(k, fingerprint(s), s) for k, s in enumerate(seen)]
    else:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                known: dict[str, str] = {}
                out = []
                for k, path in zip(batch["k"], batch["path"]):
                    schema = read_schema(path)
                    known.setdefault(key := fingerprint(schema), schema.serialize().to_pybytes().hex())
                    out.append((k, key))
                yield pd.DataFrame([(k, key, known[key]) for k, key in out], columns=["k", "key", "schema"])

        frame = spark.createDataFrame(pd.DataFrame({"k": range(len(paths)), "path": paths})).repartition(min(len(paths) // 16, 4096))
        read = frame.mapInPandas(run, "k long, key string, schema string").cache()
        texts = {r["key"]: pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(r["schema"]))) for r in read.groupBy("key").agg(F.first("schema").alias("schema")).collect()}
        raw = [(r["k"], r["key"], texts[r["key"]]) for r in read.select("k", "key").collect()]
        read.unpersist()
    number: dict[str, int] = {}
    schemas, which = [], [0] * len(paths)
    for k, key, schema in sorted(raw, key=lambda r: r[0]):
        if key not in number:
            number[key] = len(schemas)
            schemas.append(schema)
        which[k] = number[key]
    return schemas, which


def _chunks(path: str) -> Iterator[dict]:
    meta = pq.ParquetFile(_open(path)).metadata
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            stats = chunk.statistics
            yield {
                "file": path, "row_group": g, "rows": group.num_rows, "column_path": chunk.path_in_schema, "physical_type": chunk.physical_type, "codec": chunk.compression,
                "encodings": ",".join(sorted(chunk.encodings)), "num_values": chunk.num_values, "compressed_bytes": chunk.total_compressed_size, "uncompressed_bytes": chunk.total_uncompressed_size,
                "has_statistics": stats is not None, "null_count": stats.null_count if stats is not None and stats.has_null_count else None, "null_class": null_class(group.num_rows, stats.null_count if stats is not None and stats.has_null_count else None),
                "min_value": str(stats.min) if stats is not None and stats.has_min_max else None, "max_value": str(stats.max) if stats is not None and stats.has_min_max else None,
            }


LAYOUT = "file string, row_group int, rows long, column_path string, physical_type string, codec string, encodings string, num_values long, compressed_bytes long, uncompressed_bytes long, has_statistics boolean, null_count long, null_class string, min_value string, max_value string"


def layout(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file, row group and column chunk."""
    names = [c.split()[0] for c in LAYOUT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                frame = pd.DataFrame(list(_chunks(path)), columns=names)
                frame["null_count"] = frame["null_count"].astype("Int64")
                yield frame

    frame = spark.createDataFrame(pd.DataFrame({"path": paths}, dtype="object"), "path string")
    return frame.repartition(max(1, min(len(paths), 4096))).mapInPandas(run, LAYOUT)


def layout_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("column_path", "codec", "encodings").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("num_values").alias("num_values"), F.sum("compressed_bytes").alias("compressed_bytes"), F.sum("uncompressed_bytes").alias("uncompressed_bytes"))


def size_deltas(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Compressed bytes per column on both sides, and the difference."""
    side = lambda df, name: df.groupBy("column_path").agg(F.sum("compressed_bytes").alias(name))
    both = side(ours, "left_bytes").join(side(theirs, "right_bytes"), "column_path", "full").na.fill(0, ["left_bytes", "right_bytes"])
    return both.withColumn("delta_bytes", F.col("left_bytes") - F.col("right_bytes"))
