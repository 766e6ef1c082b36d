"""Files of drifting schemas as one table: union by name under a contract, in any order or sorted by one column.

Plans grow with the number of distinct schemas, not of files: files that share a schema are one scan. Scans are adapted by
projection and put together by a union of equal schemas, so that Spark coerces nothing and filters and column pruning
reach every scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import types as at
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.operators.adapt import adapt
from lamina.plans.options import PayloadOptions, TopLevelOptions
from lamina.plans.types import schema_of, to_spark
from lamina.plans.widening import fold, merge_payload, merge_schemas, merge_top_level, shown
from lamina.sources.footers import Group, distinct_schemas, order_groups

#: Names of the columns that hold a row's source and place in it.
SOURCE, ROW = "__source", "__row"
#: Names of the columns that say where a row is written: the zone of the order, and the place of its split in the source.
ZONE, BLOCK = "__zone", "__block"
#: Names of so many files at most are broadcast, each of a few hundred bytes; of more, they are joined like any table.
BROADCAST_FILES = 50_000


class NotSorted(ValueError):
    """A source isn't sorted by the ordering column."""


@dataclass(frozen=True)
class Merged:
    """The table, its logical schema, and how many distinct schemas were adapted and how often one was met again."""

    frame: DataFrame
    schema: pa.Schema
    misses: int = 0
    hits: int = 0


def union(frames: list[DataFrame]) -> DataFrame:
    """A union in a balanced tree: the plan's depth grows with the logarithm of its inputs."""
    while len(frames) > 1:
        frames = [reduce(DataFrame.union, frames[k : k + 2]) for k in range(0, len(frames), 2)]
    return frames[0]


def merge_frames(sources: list[tuple[DataFrame, pa.Schema | None]], contract, keep: tuple[str, ...] = ()) -> Merged:
    """Frames with their logical schemas (None: what Spark's types say) as one, under a contract."""
    if not sources:
        raise ValueError("at least one input parquet file is required")
    known = [(df, schema or schema_of(df.drop(*keep).schema)) for df, schema in sources]
    target = fold([s for _, s in known], contract)
    return Merged(union([adapt(df, s, target, keep) for df, s in known]), target, len(known))


def top_level(options: TopLevelOptions = TopLevelOptions()):
    return lambda a, b: merge_top_level(a, b, options)


def payload(options: PayloadOptions = PayloadOptions()):
    return lambda a, b: merge_payload(a, b, options)


def generic(options=None):
    from lamina.plans.options import WideningOptions

    return lambda a, b: merge_schemas(a, b, options or WideningOptions())


def read_files(spark: SparkSession, paths: list[str], contract, tagged: bool = False, only: set[int] | None = None, known: tuple[list[pa.Schema], list[int]] | None = None) -> Merged:
    """Parquet files as one table. ``tagged`` adds each row's source, by position in ``paths``, its place in the file, and where the split that
    it was read with begins. Of the files, those in ``only`` are read; the schema is that of all. ``known`` are their schemas, if the footers were read before."""
    if not paths:
        raise ValueError("at least one input parquet file is required")
    schemas, which = known or distinct_schemas(spark, paths)
    target = fold(schemas if len(paths) > 1 else schemas[:1], contract)
    frames = []
    tags = ("__file", ROW, BLOCK) if tagged else ()
    for k, schema in enumerate(schemas):
        own = [p for i, (p, w) in enumerate(zip(paths, which)) if w == k and (only is None or i in only)]
        if not own:
            continue
        df = spark.read.schema(T.StructType([T.StructField(f.name, to_spark(f.type)) for f in schema])).parquet(*own)  # as the footers were read, Spark needn't
        if tagged:
            df = df.withColumns({"__file": F.col("_metadata.file_path"), ROW: F.col("_metadata.row_index"), BLOCK: F.col("_metadata.file_block_start")})
        frames.append(adapt(df, schema, target, tags))
    out = union(frames)
    if tagged:
        out = numbered(out, paths).select(*[f"`{n}`" for n in target.names], SOURCE, ROW, BLOCK)
    return Merged(out, target, len(schemas), len(paths) - len(schemas))


def numbered(df: DataFrame, paths: list[str], file: str = "__file", number: str = SOURCE) -> DataFrame:
    """``df``, whose column ``file`` has ``_metadata.file_path``, with the place in ``paths`` of each row's file."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def uri(path: str) -> str:
        at = jvm.org.apache.hadoop.fs.Path(path)
        return _one_slash(at.getFileSystem(conf).makeQualified(at).toUri().toString())

    with ThreadPoolExecutor(16) as pool:
        names = spark.createDataFrame([(u, k) for k, u in enumerate(pool.map(uri, paths))], f"__uri string, {number} int")
    names = F.broadcast(names) if len(paths) <= BROADCAST_FILES else names
    return df.withColumn("__uri", F.regexp_replace(file, "^file:/+", "file:/")).join(names, "__uri").drop("__uri")


def _one_slash(uri: str) -> str:
    return "file:/" + uri[5:].lstrip("/") if uri.startswith("file:/") else uri


def order_key_error(schema: pa.Schema, field: str, payload_column: str | None) -> str | None:
    if field == payload_column:
        return f"ordering_field `{field}` must reference a top-level envelope column, not `{payload_column}`"
    if schema.get_field_index(field) < 0:
        return f"ordering_field `{field}` is missing from the merged schema"
    kind = schema.field(field).type
    if kind in (pa.int64(), pa.uint64(), pa.float64(), pa.string(), pa.large_string(), pa.date32(), pa.date64()) or at.is_timestamp(kind):
        return None
    return f"ordering_field `{field}` has unsupported type {shown(kind)}; supported types are Int64, UInt64, Float64, Utf8, LargeUtf8, Date32, Date64, and Timestamp(_, _)"


def sort_columns(field: str, floating: bool = False) -> list[Column]:
    """Ascending, nulls last. Minus zero comes before zero; NaN comes last but for nulls, whatever its sign."""
    key = F.col(f"`{field}`")
    signed = [F.when(key == 0, (key.cast("string") != "-0.0").cast("int")).otherwise(0).asc()] if floating else []
    return [key.asc_nulls_last(), *signed]


def disorder(df: DataFrame, field: str, source: str = SOURCE, row: str = ROW, first_only: bool = False) -> DataFrame:
    """(``source``, ``row``) of every row that sorts before the row ahead of it in its source; with ``first_only`` a task tells only the
    first of each run of rows, so that what leaves it doesn't grow with the disorder.

    Scans deliver a source's rows in their order, so each task compares neighbours as they stream by; one row with both
    ends of each run is all that leaves a task, and these ends are compared with each other. Nothing else is shuffled.
    Frames whose rows don't come by source and place must be sorted that way within their partitions. NaN and null are last.
    """
    rows = df.select(F.col(source).alias("s"), F.col(row).alias("r"), F.col(f"`{field}`").alias("k"))
    kinds = rows.schema
    out = T.StructType([kinds["s"], T.StructField("r", T.LongType()), T.StructField("bad", T.BooleanType()), T.StructField("first", kinds["k"].dataType), T.StructField("last", kinds["k"].dataType), T.StructField("end", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far
        head = None  # source, first place and first key of the run so far
        ends: list[tuple] = []
        told: set = set()  # sources whose first fall in this task is known
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            if held is not None:
                table = pa.concat_tables([held.cast(table.schema), table])
            s, r = table["s"].to_numpy(), table["r"].to_numpy()
            k = table["k"].combine_chunks()
            if held is None:
                head = (s[0], r[0], k[0])
            falls = _falls(k)
            # Within a run of one source places go up by one; where they don't, another run begins.
            joins = (s[1:] == s[:-1]) & (r[1:] == r[:-1] + 1)
            for at in np.flatnonzero(~joins):
                ends.append((*head, k[at], r[at]))
                head = (s[at + 1], r[at + 1], k[at + 1])
            bad = np.flatnonzero(falls & joins) + 1
            if first_only:
                bad = bad[np.unique(s[bad], return_index=True)[1]]
                bad = bad[[x not in told for x in s[bad].tolist()]] if len(bad) else bad
                told.update(s[bad].tolist())
            if len(bad):
                n = len(bad)
                yield pa.RecordBatch.from_arrays([pa.array(s[bad], batch.schema.field("s").type), pa.array(r[bad], pa.int64()), pa.array([True] * n), pa.nulls(n, k.type), pa.nulls(n, k.type), pa.nulls(n, pa.int64())], names=out.names)
            held = table.slice(table.num_rows - 1)
        if held is not None:
            ends.append((*head, held["k"][0], held["r"][0].as_py()))
            kind = held["k"].type
            yield pa.RecordBatch.from_arrays([
                pa.array([e[0] for e in ends], held["s"].type), pa.array([e[1] for e in ends], pa.int64()), pa.array([False] * len(ends)), pa.array([e[2].as_py() for e in ends], kind),
                pa.array([e[3].as_py() for e in ends], kind), pa.array([e[4] for e in ends], pa.int64())], names=out.names)

    ahead = Window.partitionBy("s").orderBy("r", "bad").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.mapInArrow(run, out).withColumn("p", F.last(F.when(~F.col("bad"), F.struct("last")), ignorenulls=True).over(ahead))
    falls = F.col("p").isNotNull() & F.coalesce((F.col("p.last").isNull() & F.col("first").isNotNull()) | (F.col("p.last") > F.col("first")), F.lit(False))
    return found.filter(F.col("bad") | falls).select(F.col("s").alias(source), F.col("r").alias(row))


def _falls(k: pa.Array) -> np.ndarray:
    """Whether each value but the first sorts before the one ahead of it."""
    before, after = k.slice(0, len(k) - 1), k.slice(1)
    none_before, none_after = before.is_null().to_numpy(zero_copy_only=False), after.is_null().to_numpy(zero_copy_only=False)
    greater = pc.fill_null(pc.greater(before, after), False).to_numpy(zero_copy_only=False)
    if at.is_floating(k.type):
        nan_before, nan_after = (pc.fill_null(pc.is_nan(x), False).to_numpy(zero_copy_only=False) for x in (before, after))
        greater = greater | (nan_before & ~nan_after & ~none_after)
    return np.where(none_before, ~none_after, greater & ~none_after)


def ordered(df: DataFrame, field: str, kind: pa.DataType | None = None, names: list[str] | None = None) -> DataFrame:
    """A tagged table in total order: by the key, ties by source and place. Tags are kept."""
    floating = kind is not None and at.is_floating(kind)
    return df.orderBy(*sort_columns(field, floating), SOURCE, ROW)


def zones(groups: list[Group]) -> list[tuple[int, int, int, int, bool]]:
    """(source, from row, to row, zone, whether it stands alone) of sources that are sorted. Zones follow each other in the order: in a zone
    that stands alone one source's rows are in order already; where row groups of several sources overlap, their zone has to be
    sorted. Equal keys go by source, so a group may begin with the key that another ends with only if it comes after it."""
    clusters: list[list[Group]] = []
    high: tuple = ()
    last = (-1, -1)
    for g in sorted(groups, key=lambda g: (g.low, g.source, g.group)):
        at = (g.source, g.group)
        if not clusters or g.low > high or (g.low == high and last < at):
            clusters.append([])
            high, last = g.high, at
        elif g.high > high:
            high, last = g.high, at
        elif g.high == high:
            last = max(last, at)
        clusters[-1].append(g)
    out: list[tuple[int, int, int, int, bool]] = []
    zone, before = -1, None
    for cluster in clusters:
        own = {g.source for g in cluster}
        kind = own.pop() if len(own) == 1 else None
        if zone < 0 or kind != before:
            zone, before = zone + 1, kind
        out += [(g.source, g.begin, g.end, zone, kind is not None) for g in cluster]
    spans: list[tuple[int, int, int, int, bool]] = []
    for s in sorted(out):
        if spans and spans[-1][0] == s[0] and spans[-1][2] == s[1] and spans[-1][3:] == s[3:]:
            spans[-1] = (*spans[-1][:2], *s[2:])
        else:
            spans.append(s)
    return spans


def _zoned(df: DataFrame, spans: list[tuple[int, int, int, int, bool]], alone: bool) -> DataFrame:
    """The rows of a tagged table that lie in zones of one kind, with their zone."""
    by_source: dict[int, list[tuple]] = {}
    for source, _, end, zone, kind in spans:
        by_source.setdefault(source, []).append((end, zone, kind))
    table = df.sparkSession.createDataFrame(list(by_source.items()), f"{SOURCE} int, __spans array<struct<until:long,zone:int,alone:boolean>>")
    span = F.element_at("__spans", 1) if all(len(x) == 1 for x in by_source.values()) else F.element_at(F.filter("__spans", lambda x: F.col(ROW) < x["until"]), 1)
    placed = df.join(F.broadcast(table), SOURCE).withColumn("__span", span).filter(F.col("__span.alone") == alone)
    return placed.withColumn(ZONE, F.col("__span.zone")).drop("__spans", "__span")


@dataclass(frozen=True)
class Parts:
    """A table in pieces that need no order among each other: each row says by ZONE, and within one by BLOCK, where it goes; what shares
    both is in order already. ``names`` are the table's columns."""

    pieces: list[DataFrame]
    names: list[str]
    schema: pa.Schema
    misses: int = 0
    hits: int = 0
    alone: int = 0  # rows that weren't sorted, as no other source overlaps theirs
    sorted: int = 0
    #: What must hold of the sources: it is looked at while the pieces are written, and nothing is kept if it fails.
    check: Callable[[], None] | None = None


def _by_place(df: DataFrame) -> DataFrame:
    """Rows as their scan has them, which is their order: a sort within the task keeps it through the writer, and nothing is shuffled."""
    return df.sortWithinPartitions(ZONE, BLOCK, ROW)


def files_in_order(spark: SparkSession, paths: list[str], contract) -> Parts:
    """Files as one table by file and row. No row leaves its task."""
    merged = read_files(spark, paths, contract, True)
    return Parts([_by_place(merged.frame.withColumn(ZONE, F.col(SOURCE)))], merged.schema.names, merged.schema, merged.misses, merged.hits)


def payload_files_in_order(spark: SparkSession, paths: list[str], options: PayloadOptions, field: str, use_footers: bool = True) -> Parts:
    """Files as one table sorted by ``field``, after each source's own order has been checked. Footers tell which row groups overlap no
    other source's: these are taken as they lie; only the others are sorted."""
    known = distinct_schemas(spark, paths) if paths else None
    whole = read_files(spark, paths, payload(options), True, None, known)
    if problem := order_key_error(whole.schema, field, options.payload_column):
        raise ValueError(problem)
    few = use_footers and len(paths) <= BROADCAST_FILES
    groups = order_groups(spark, paths, field) if few else []
    spans = zones(groups) if len(groups) <= BROADCAST_FILES else []
    kind, pieces = whole.schema.field(field).type, []
    keys = [*sort_columns(field, at.is_floating(kind)), SOURCE, ROW]
    lonely, mixed = {s[0] for s in spans if s[4]}, {s[0] for s in spans if not s[4]}
    if lonely:
        pieces.append(_by_place(_zoned(read_files(spark, paths, payload(options), True, lonely, known).frame, spans, True)))
    if mixed:
        frame = read_files(spark, paths, payload(options), True, mixed, known).frame
        if (near := _ranges(groups, spans, kind, field)) is not None:
            frame = frame.filter(near)  # reaches the scan, which leaves out the other row groups
        pieces.append(_zoned(frame, spans, False).withColumn(BLOCK, F.lit(0).cast("bigint")).orderBy(ZONE, BLOCK, *keys))
    if not pieces:
        pieces.append(whole.frame.withColumns({ZONE: F.lit(0), BLOCK: F.lit(0).cast("bigint")}).orderBy(ZONE, BLOCK, *keys))
    rows = [sum(s[2] - s[1] for s in spans if s[4] == alone) for alone in (True, False)]
    return Parts(pieces, whole.schema.names, whole.schema, whole.misses, whole.hits, *rows, lambda: check_sorted(whole, paths, field, options))


#: Ranges of keys that a scan is asked for at most.
MAX_RANGES = 32


def _ranges(groups: list[Group], spans: list[tuple[int, int, int, int, bool]], kind: pa.DataType, field: str) -> Column | None:
    """A filter that holds for every row of the zones that have to be sorted, if few ranges of plain keys say so."""
    if kind not in (pa.int64(), pa.string(), pa.date32()):
        return None
    ends: dict[int, list] = {}
    for source, begin, end, zone, alone in spans:
        if not alone:
            for g in groups:
                if g.source == source and begin <= g.begin and g.end <= end:
                    if len(g.low) < 2 or len(g.high) < 2:
                        return None
                    low, high = ends.setdefault(zone, [g.low[1], g.high[1]])
                    ends[zone] = [min(low, g.low[1]), max(high, g.high[1])]
    if len(ends) > MAX_RANGES:
        return None
    return reduce(lambda a, b: a | b, [F.col(f"`{field}`").between(F.lit(low), F.lit(high)) for low, high in ends.values()])


def check_sorted(merged: Merged, paths: list[str], field: str, options: PayloadOptions) -> None:
    """Fails unless a tagged table can be ordered by ``field`` and each source is."""
    if problem := order_key_error(merged.schema, field, options.payload_column):
        raise ValueError(problem)
    checked = merged.frame
    if len(paths) > BROADCAST_FILES:  # their join with the names lost the order of the scans
        checked = checked.repartition(SOURCE, F.shiftright(ROW, 20)).sortWithinPartitions(SOURCE, ROW)
    bad = disorder(checked, field, first_only=True).agg(F.min(F.struct(SOURCE, ROW)).alias("first")).first()["first"]
    if bad:
        raise NotSorted(f"input parquet file `{paths[bad[SOURCE]]}` is not sorted ascending by `{field}` near row {bad[ROW]}")


def merge_top_level_files(spark: SparkSession, paths: list[str], options: TopLevelOptions = TopLevelOptions()) -> Merged:
    """Under the top-level contract, as the scans come; ``files_in_order`` keeps the order."""
    return read_files(spark, paths, top_level(options))


def merge_payload_files(spark: SparkSession, paths: list[str], options: PayloadOptions = PayloadOptions(), ordering_field: str | None = None) -> Merged:
    """Under the payload contract. With ``ordering_field`` sorted by it, after each source's own order has been checked."""
    if ordering_field is None:
        return read_files(spark, paths, payload(options))
    merged = read_files(spark, paths, payload(options), True)
    check_sorted(merged, paths, ordering_field, options)
    frame = ordered(merged.frame, ordering_field, merged.schema.field(ordering_field).type)
    return Merged(frame.drop(SOURCE, ROW, BLOCK), merged.schema, merged.misses, merged.hits)
