"""Parquet output: a directory that all tasks write, or one file, with the writer's options; and the report of a job."""

from __future__ import annotations

import resource
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from lamina.operators.merge import BLOCK, ROW, SOURCE, ZONE, Parts, files_in_order, merge_payload_files, payload, payload_files_in_order, read_files, sort_columns, top_level
from lamina.plans.options import ENCODABLE, ExecutionOptions, MergeOrder, NdjsonOptions, PayloadOptions, TopLevelOptions, resolved_parallelism
from lamina.sources import ndjson
from lamina.sources.footers import rows_and_bytes


@dataclass
class Report:
    """What a job did. The counters from ``ordered_merge_seconds`` on belong to parts of an engine that Spark's own stand in for: row groups
    that are taken as they lie count here, all others are documented zeros."""

    rows: int = 0
    input_bytes: int = 0
    output_bytes: int = 0
    planning_seconds: float = 0.0
    execution_seconds: float = 0.0
    sorting_seconds: float = 0.0
    total_seconds: float = 0.0
    peak_rss_bytes: int = 0
    planning_threads_used: int = 1
    planning_unique_shapes: int = 0
    planning_shape_cache_hits: int = 0
    planning_shape_cache_misses: int = 0
    adapter_cache_hits: int = 0
    adapter_cache_misses: int = 0
    output_files: list[str] = field(default_factory=list)
    #: Rows that weren't sorted, as the footers show that no other source's row groups overlap theirs; and rows that were.
    fast_path_rows: int = 0
    sorted_rows: int = 0
    ordered_merge_seconds: float = 0.0
    input_batches: int = 0
    output_batches: int = 0
    fast_path_row_groups: int = 0
    fast_path_batches: int = 0
    fallback_batches: int = 0
    dense_partition_jobs: int = 0
    dense_rows: int = 0
    dense_fallback_count: int = 0
    direct_batch_writes: int = 0
    accumulator_flushes: int = 0
    copy_candidate_row_groups: int = 0
    copied_row_groups: int = 0
    copied_rows: int = 0
    copied_compressed_bytes: int = 0


def writer_settings(options: ExecutionOptions) -> dict[str, str]:
    """The options as settings of Spark's Parquet sink."""
    out = {
        "compression": options.writer_compression.codec, "parquet.enable.dictionary": str(options.writer_dictionary_enabled).lower(), "parquet.writer.version": f"v{options.writer_version}",
        "parquet.block.row.count.limit": str(options.output_row_group_rows),
    }
    if options.writer_compression.codec == "zstd" and options.writer_compression.level:
        out["parquet.compression.codec.zstd.level"] = str(options.writer_compression.level)
    for name, key in (("writer_data_page_size_limit", "parquet.page.size"), ("writer_dictionary_page_size_limit", "parquet.dictionary.page.size"), ("writer_data_page_row_count_limit", "parquet.page.row.count.limit")):
        if getattr(options, name) is not None:
            out[key] = str(getattr(options, name))
    for c in options.writer_column_options:
        if c.dictionary_enabled is not None:
            out[f"parquet.enable.dictionary#{'.'.join(c.path)}"] = str(c.dictionary_enabled).lower()
    return out


def needs_arrow(options: ExecutionOptions) -> bool:
    """Spark's sink knows no codec or encoding of a single column."""
    return any(c.encoding or c.compression for c in options.writer_column_options)


def column_policies(schema: pa.Schema, options: ExecutionOptions) -> dict:
    """The options as arguments of Arrow's writer; fails for a path that is no leaf, or an encoding that its type can't have."""
    sink = pa.BufferOutputStream()
    pq.ParquetWriter(sink, schema).close()
    leaves = {c.path: c.physical_type for c in pq.ParquetFile(pa.BufferReader(sink.getvalue())).schema}
    dictionary, codecs, levels, encodings = {}, {}, {}, {}
    for path in leaves:
        dictionary[path] = options.writer_dictionary_enabled
        codecs[path] = _codec(options.writer_compression)
        if options.writer_compression.level is not None:
            levels[path] = options.writer_compression.level
    for c in options.writer_column_options:
        path = ".".join(c.path)
        if path not in leaves:
            raise ValueError(f"writer_column_options path `{path}` does not match an output parquet leaf column; available leaf columns: {', '.join(leaves)}")
        if c.encoding:
            if leaves[path] not in ENCODABLE.get(c.encoding, {leaves[path]}):
                raise ValueError(f"writer_column_options path `{path}` cannot use {c.encoding.value} encoding for parquet physical type {leaves[path]}")
            encodings[path] = c.encoding.value
            dictionary[path] = False
        if c.dictionary_enabled is not None:
            dictionary[path] = c.dictionary_enabled and not c.encoding
        if c.compression:
            codecs[path] = _codec(c.compression)
            if c.compression.level is not None:
                levels[path] = c.compression.level
    out = {"use_dictionary": [p for p, on in dictionary.items() if on], "compression": codecs, "version": "1.0" if options.writer_version == 1 else "2.6", "data_page_version": f"{options.writer_version}.0"}
    if encodings:
        out["column_encoding"] = encodings
    if levels:
        out["compression_level"] = levels
    if options.writer_data_page_size_limit:
        out["data_page_size"] = options.writer_data_page_size_limit
    if options.writer_dictionary_page_size_limit:
        out["dictionary_pagesize_limit"] = options.writer_dictionary_page_size_limit
    if options.writer_data_page_row_count_limit:
        out["max_rows_per_page"] = options.writer_data_page_row_count_limit
    return out


def _codec(c) -> str:
    return {"uncompressed": "NONE", "lz4_raw": "LZ4"}.get(c.codec, c.codec.upper())


class _Folder:
    """A folder beside its final place, which takes that place when it is whole: a reader sees the old one or the new one, and nothing of
    the old one is left in the new."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.staging = spark, path, f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def __enter__(self) -> _Folder:
        return self

    def __exit__(self, *failed) -> None:
        self.fs.delete(self.at(self.staging), True)

    def files(self, folder: str) -> list[str]:
        """The data files below a folder, as paths relative to it."""
        found, out, root = self.fs.listFiles(self.at(folder), True), [], None
        root = self.fs.makeQualified(self.at(folder)).toUri().getPath().rstrip("/") + "/"
        while found.hasNext():
            name = found.next().getPath().toUri().getPath()[len(root):]
            if name.endswith(".parquet") and not any(p.startswith(("_", ".")) and not p.startswith("__") for p in name.split("/")):
                out.append(name)
        return out

    def move(self, source: str, target: str) -> None:
        self.fs.mkdirs(self.at(target).getParent())
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"cannot move {source} to {target}")

    def take(self, source: str) -> None:
        """``source``, a folder or file, becomes the result."""
        self.fs.delete(self.at(self.path), True)
        self.move(source, self.path)


def write_directory(df: DataFrame, path: str, options: ExecutionOptions = ExecutionOptions()) -> None:
    """One file per task: the form for data of any size. Sorted frames give files whose names follow the order."""
    options.check()
    if needs_arrow(options):
        _write_arrow(df, path, options)
    else:
        df.write.mode("overwrite").options(**writer_settings(options)).parquet(path)


def write_parts(parts: Parts, path: str, options: ExecutionOptions = ExecutionOptions()) -> None:
    """A table that is in pieces. Every piece is written where its zones and blocks say, and the files are named in this order."""
    options.check()
    with _Folder(parts.pieces[0].sparkSession, path) as folder:
        files = []
        own = lambda k: f"{folder.staging}/pieces/{k}"
        with ThreadPoolExecutor(len(parts.pieces) + 1) as pool:
            checked = pool.submit(parts.check or (lambda: None))
            written = [pool.submit(p.select(*[f"`{n}`" for n in parts.names], ZONE, BLOCK).write.partitionBy(ZONE, BLOCK).options(**writer_settings(options)).parquet, own(k)) for k, p in enumerate(parts.pieces)]
            checked.result()
            for w in written:
                w.result()
        for k in range(len(parts.pieces)):
            for name in folder.files(own(k)):
                zone, block, file = name.split("/")
                files.append((int(zone.split("=")[1]), int(block.split("=")[1]), file, f"{own(k)}/{name}"))
        whole = f"{folder.staging}/whole"
        for k, (*_, file, name) in enumerate(sorted(files)):
            folder.move(name, f"{whole}/part-{k:06d}{file[file.index('-', 5):]}")
        if not files:  # a table without rows still has a schema
            parts.pieces[0].select(*[f"`{n}`" for n in parts.names]).limit(0).coalesce(1).write.options(**writer_settings(options)).parquet(whole)
        folder.take(whole)


def _write_arrow(df: DataFrame, path: str, options: ExecutionOptions) -> None:
    """By Arrow's writer in every task. ``path`` must be one that all executors share; it may be the address of any file system that Arrow opens."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)
    policies = column_policies(schema, options)
    rows = options.output_row_group_rows
    with _Folder(df.sparkSession, path) as folder:
        tried = f"{folder.staging}/tried"
        folder.fs.mkdirs(folder.at(tried))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            # Under the attempt's own name; only files of attempts that ended well are taken.
            part = TaskContext.get().partitionId()
            name = f"part-{part:05d}-{uuid.uuid4().hex}.parquet"
            held, count = [], 0
            system, inner = pa.fs.FileSystem.from_uri(tried) if "://" in tried else (pa.fs.LocalFileSystem(), tried.removeprefix("file:"))
            with pq.ParquetWriter(f"{inner}/{name}", schema, filesystem=system, **policies) as writer:
                for batch in batches:
                    held.append(batch)
                    count += batch.num_rows
                    if count >= rows:
                        writer.write_table(pa.Table.from_batches(held).cast(schema), row_group_size=rows)
                        held, count = [], 0
                if held:
                    writer.write_table(pa.Table.from_batches(held).cast(schema), row_group_size=rows)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name])], names=["part", "name"])

        for part, name in df.mapInArrow(run, "part long, name string").collect():
            folder.move(f"{tried}/{name}", f"{folder.staging}/whole/part-{part:05d}.parquet")
        folder.take(f"{folder.staging}/whole")


def write_file(df: DataFrame, path: str, options: ExecutionOptions = ExecutionOptions()) -> None:
    """One file, written by one task and renamed when it is whole: for results that fit one file."""
    with _Folder(df.sparkSession, path) as folder:
        write_directory(df.coalesce(1), f"{folder.staging}/one", options)
        parts = folder.files(f"{folder.staging}/one")
        if not parts:
            raise RuntimeError("nothing was written")
        folder.take(f"{folder.staging}/one/{min(parts)}")


def _report(spark: SparkSession, began: float, planned: float, paths: list[str], output: str, **counters) -> Report:
    folder = _Folder(spark, output)
    single = folder.fs.getFileStatus(folder.at(output)).isFile()
    files = [output] if single else [f"{output.rstrip('/')}/{name}" for name in sorted(folder.files(output))]
    rows, size = rows_and_bytes(spark, files)
    end = time.time()
    return Report(
        rows=rows, input_bytes=rows_and_bytes(spark, paths, False)[1], output_bytes=size, planning_seconds=planned - began, execution_seconds=end - planned, total_seconds=end - began,
        peak_rss_bytes=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024, planning_threads_used=resolved_parallelism(16, 16, len(paths)), output_files=files, **counters,
    )


def _write(df: DataFrame, output: str, options: ExecutionOptions, single: bool) -> None:
    if single:
        write_file(df, output, options)
    else:
        write_directory(df, output, options)


def _write_in_order(parts: Parts, output: str, options: ExecutionOptions, single: bool, whole: Callable[[], DataFrame], by: list) -> None:
    """In pieces where there may be several files. One file is one task, which sorts for itself; Arrow's writer numbers its files by task and
    takes the table as a whole."""
    if single or needs_arrow(options):
        (parts.check or (lambda: None))()
    if single:
        tagged = reduce(DataFrame.union, parts.pieces)
        write_file(tagged.coalesce(1).sortWithinPartitions(*by).select(*[f"`{n}`" for n in parts.names]), output, options)
    elif needs_arrow(options):
        write_directory(whole(), output, options)
    else:
        write_parts(parts, output, options)


def _merged(spark: SparkSession, paths: list[str], output: str, contract, options: ExecutionOptions, single: bool) -> Report:
    """Without an ordering column."""
    began = time.time()
    if options.unordered_merge_order is MergeOrder.PRESERVE_INPUT_ORDER:
        result = files_in_order(spark, paths, contract)
        planned = time.time()
        frame = lambda: reduce(DataFrame.union, result.pieces).orderBy(SOURCE, ROW).select(*[f"`{n}`" for n in result.names])
        _write_in_order(result, output, options, single, frame, [SOURCE, ROW])
    else:
        result = read_files(spark, paths, contract)
        planned = time.time()
        _write(result.frame, output, options, single)
    return _report(spark, began, planned, paths, output, adapter_cache_hits=result.hits, adapter_cache_misses=result.misses)


def merge_top_level_parquet_files(spark: SparkSession, paths: list[str], output: str, options: TopLevelOptions = TopLevelOptions(), execution: ExecutionOptions = ExecutionOptions(), single_file: bool = True) -> Report:
    execution.check()
    if execution.ordering_field is not None:
        raise ValueError("ordering_field is only supported for payload parquet merges")
    return _merged(spark, paths, output, top_level(options), execution, single_file)


def merge_payload_parquet_files(spark: SparkSession, paths: list[str], output: str, options: PayloadOptions = PayloadOptions(), execution: ExecutionOptions = ExecutionOptions(), single_file: bool = True) -> Report:
    execution.check()
    key = execution.ordering_field
    if key is None:
        return _merged(spark, paths, output, payload(options), execution, single_file)
    began = time.time()
    parts = payload_files_in_order(spark, paths, options, key, execution.stats_fast_path)
    planned = time.time()
    by = [*sort_columns(key, pa.types.is_floating(parts.schema.field(key).type)), SOURCE, ROW]
    _write_in_order(parts, output, execution, single_file, lambda: merge_payload_files(spark, paths, options, key).frame, by)
    report = _report(spark, began, planned, paths, output, adapter_cache_hits=parts.hits, adapter_cache_misses=parts.misses, fast_path_rows=parts.alone, sorted_rows=parts.sorted)
    report.sorting_seconds = report.ordered_merge_seconds = report.execution_seconds
    return report


def compact_ndjson_to_parquet(spark: SparkSession, paths: list[str], output: str, options: NdjsonOptions = NdjsonOptions(), single_file: bool = True) -> Report:
    """Two passes: discovery, then the typed read. Nothing is written unless discovery succeeds."""
    options.check()
    if not paths:
        raise ValueError("at least one NDJSON input path is required")
    began = time.time()
    source = ndjson.lines(spark, paths)
    found = ndjson.discover_lines(source, options)
    frame, _ = ndjson.read(source, options, found)
    planned = time.time()
    if options.sort_field is None:
        frame = frame.orderBy("__source", "__block", "__at") if single_file else frame
    _write(frame.drop("__source", "__block", "__at"), output, ExecutionOptions(), single_file)
    return _report(spark, began, planned, paths, output, planning_unique_shapes=found.shapes, planning_shape_cache_hits=found.hits, planning_shape_cache_misses=found.misses)
