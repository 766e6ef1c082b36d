"""NDJSON files as typed tables: exact discovery of the schema, then a typed read, sorted on request.

Discovery folds types, not values: each task reduces its lines to one tree of kinds and counts, as large as the schema and
not as its rows; trees of neighbouring tasks are joined by other tasks, and the driver joins what these give. The typed read is Spark's own JSON parser with the discovered schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.operators.merge import numbered, sort_columns
from lamina.plans.options import NdjsonOptions, WideningOptions
from lamina.plans.types import to_spark
from lamina.plans.widening import SchemaConflict, scalar, shown

I64, U64 = (1 << 63) - 1, (1 << 64) - 1
#: A task folds the records of so many shapes at once into its tree.
SHAPES_AT_ONCE = 4096
#: Trees of so many tasks are joined before the driver sees them.
TREES_AT_ONCE = 64
#: A schema of more fields is refused: plans and files of such a width are of no use.
MAX_FIELDS = 100_000
SORTABLE = (pa.int64(), pa.uint64(), pa.float64(), pa.string(), pa.large_string())


@dataclass
class Shape:
    """What was seen at one place: its scalar type, members or elements, and how often it was there and null."""

    scalar: pa.DataType | None = None
    members: dict[str, Shape] | None = None
    element: Shape | None = None
    seen: int = 0
    nulls: int = 0
    mixed: bool = False  # a text column that also holds numbers or booleans

    def kind(self) -> str:
        if self.members is not None:
            return "Struct"
        if self.element is not None:
            return "List"
        return shown(self.scalar) if self.scalar is not None else "Null"

    def arrow(self) -> pa.DataType:
        if self.members is not None:
            return pa.struct([pa.field(k, m.arrow(), m.nulls > 0 or m.seen < self.seen - self.nulls) for k, m in sorted(self.members.items())])
        if self.element is not None:
            return pa.list_(pa.field("item", self.element.arrow(), self.element.nulls > 0))
        return self.scalar if self.scalar is not None else pa.null()


def shape_of(value) -> Shape:
    if value is None:
        return Shape(seen=1, nulls=1)
    if isinstance(value, bool):
        return Shape(pa.bool_(), seen=1)
    if isinstance(value, int):
        return Shape(pa.int64() if -I64 - 1 <= value <= I64 else pa.uint64() if 0 <= value <= U64 else pa.float64(), seen=1)
    if isinstance(value, float):
        return Shape(pa.float64(), seen=1)
    if isinstance(value, str):
        return Shape(pa.string(), seen=1)
    if isinstance(value, dict):
        return Shape(members={k: shape_of(v) for k, v in value.items()}, seen=1)
    raise TypeError


def joined(left: Shape, right: Shape, path: str, options: WideningOptions) -> Shape:
    """The join of two shapes; fails at the first conflict."""
    out = Shape(seen=left.seen + right.seen, nulls=left.nulls + right.nulls, mixed=left.mixed or right.mixed)
    if left.kind() == "Null" or right.kind() == "Null":
        other = right if left.kind() == "Null" else left
        out.scalar, out.members, out.element = other.scalar, other.members, other.element
        return out
    if left.members is not None and right.members is not None:
        out.members = dict(left.members)
        for k, m in right.members.items():
            out.members[k] = joined(out.members[k], m, f"{path}.{k}" if path else k, options) if k in out.members else m
        return out
    if left.element is not None and right.element is not None:
        out.element = joined(left.element, right.element, f"{path}[]", options)
        return out
    if left.scalar is not None and right.scalar is not None:
        out.scalar = scalar(left.scalar, right.scalar, options)
        if out.scalar is None:
            raise SchemaConflict([f"field `<root>` incompatible types for widening: left={shown(left.scalar)}, right={shown(right.scalar)}"])
        out.mixed |= out.scalar == pa.string() and left.scalar != right.scalar
        return out
    raise SchemaConflict([f"field `{path or '<root>'}` incompatible types for widening: left={left.kind()}, right={right.kind()}"])


def observed(value, path: str, options: WideningOptions) -> Shape:
    """The shape of a value, with its lists' elements joined."""
    if isinstance(value, list):
        element = Shape()
        for v in value:
            element = joined(element, observed(v, f"{path}[]", options), f"{path}[]", options)
        return Shape(element=element, seen=1)
    if isinstance(value, dict):
        return Shape(members={k: observed(v, f"{path}.{k}" if path else k, options) for k, v in value.items()}, seen=1)
    return shape_of(value)


def signature(value):
    """Equal for values of equal shape; far cheaper than the shape itself."""
    if value is None or value is True or value is False:
        return value is None
    kind = type(value)
    if kind is dict:
        return tuple((k, signature(value[k])) for k in sorted(value))  # the order of keys doesn't matter
    if kind is list:
        return ("[]", *dict.fromkeys(map(signature, value)))
    if kind is int:
        return "i" if -I64 - 1 <= value <= I64 else "u" if 0 <= value <= U64 else "f"
    return "s" if kind is str else "f"


def fields(shape: Shape) -> int:
    own = [*(shape.members or {}).values(), *([shape.element] if shape.element is not None else [])]
    return len(own) + sum(map(fields, own))


def times(shape: Shape, n: int) -> Shape:
    """The shape of ``n`` records of one shape."""
    members = None if shape.members is None else {k: times(m, n) for k, m in shape.members.items()}
    return Shape(shape.scalar, members, None if shape.element is None else times(shape.element, n), shape.seen * n, shape.nulls * n, shape.mixed)


def _first_wins(pairs):
    out = {}
    for k, v in pairs:
        out.setdefault(k, v)
    return out


def parse(line: str, where: str) -> dict:
    try:
        record = json.loads(line, object_pairs_hook=_first_wins)
    except ValueError as e:
        raise ValueError(f"failed to parse NDJSON record in {where}: {e}") from None
    if not isinstance(record, dict):
        raise ValueError(f"NDJSON record in {where} must be an object")
    return record


@dataclass
class Discovered:
    schema: pa.Schema
    records: int
    rendered: list[tuple[str, ...]] = field(default_factory=list)  # paths of texts that also hold numbers or booleans
    shapes: int = 0  # distinct shapes of records, as tasks met them
    hits: int = 0  # records whose shape was known
    misses: int = 0


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(``line``, ``__source``, ``__block``, ``__at``): lines that aren't empty; the last three order them by file and place."""
    df = spark.read.option("lineSep", "\n").text(list(dict.fromkeys(paths))).select(
        F.regexp_replace("value", r"\r+\z", "").alias("line"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    df = df.withColumn("__at", F.monotonically_increasing_id()).filter("line != ''")
    return numbered(df, paths).select("line", "__source", "__block", "__at", "__file")


def _mixed(shape: Shape, path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
    if shape.mixed:
        yield path
    for k, m in (shape.members or {}).items():
        yield from _mixed(m, (*path, k))
    if shape.element is not None:
        yield from _mixed(shape.element, (*path, "[]"))


def discover(spark: SparkSession, paths: list[str], options: NdjsonOptions) -> Discovered:
    options.check()
    if not paths:
        raise ValueError("at least one NDJSON input path is required")
    return discover_lines(lines(spark, paths), options)


def discover_lines(df: DataFrame, options: NdjsonOptions) -> Discovered:
    """The schema of a frame with ``line``, ``__source``, ``__block``, ``__at`` and ``__file``."""
    widening, payload, envelope = options.widening, options.payload_column, set(options.envelope_fields)

    def both(left: Shape, right: Shape) -> Shape:
        members = {k: joined(left.members[k], right.members[k], path, widening) for k, path in (("e", ""), ("p", payload))}
        return Shape(members=members, seen=left.seen + right.seen)

    def folded(state: Shape | None, counts: dict[tuple, list]) -> Shape | None:
        for n, record in counts.values():
            own, rest = {}, {}
            for k, v in record.items():
                (own if k in envelope else rest)[k] = v
            shape = times(Shape(members={"e": observed(own, "", widening), "p": observed(rest, payload, widening)}, seen=1), n)
            state = shape if state is None else both(state, shape)
        if state is not None and fields(state) > MAX_FIELDS:
            raise ValueError(f"the records have more than {MAX_FIELDS} fields")
        return state

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        at, error, state = None, None, None
        counts: dict[tuple, list] = {}  # by signature: how many records, and the first one
        hits = misses = 0
        try:
            for batch in batches:
                for text, source, block, file in zip(batch["line"], batch["__source"], batch["__block"], batch["__file"]):
                    at = at if at is not None else (int(source), int(block))
                    record = parse(text, file)
                    known = counts.setdefault(signature(record), [0, record])
                    known[0] += 1
                    hits, misses = (hits + 1, misses) if known[0] > 1 else (hits, misses + 1)
                    if len(counts) >= SHAPES_AT_ONCE:
                        state, counts = folded(state, counts), {}
            state = folded(state, counts)
        except SchemaConflict as e:
            error = ("SchemaConflict", e.conflicts, at)
        except ValueError as e:
            error = ("ValueError", str(e), at)
        if at is not None:
            yield pd.DataFrame([(*at, pickle.dumps((state, error, hits, misses)))], columns=["s", "b", "x"])

    def join(rows) -> tuple:
        """Of pickled states in the order of their first rows: their join, the first error, and the sums of both counters."""
        import pickle

        state, error, hits, misses = None, None, 0, 0
        for x in rows:
            own, wrong, h, m = pickle.loads(bytes(x))
            hits, misses = hits + h, misses + m
            if error is None and wrong is not None:
                error = wrong
            if error is None and own is not None:
                try:
                    state = own if state is None else both(state, own)
                except SchemaConflict as e:
                    error = ("SchemaConflict", e.conflicts, None)
        return state, error, hits, misses

    def joining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        rows = [r for batch in batches for r in zip(batch["g"], batch["s"], batch["b"], batch["x"])]
        for g in sorted({r[0] for r in rows}):
            own = sorted((r[1:] for r in rows if r[0] == g), key=lambda r: r[:2])
            yield pd.DataFrame([(own[0][0], own[0][1], pickle.dumps(join(r[2] for r in own)))], columns=["s", "b", "x"])

    partial = df.select("line", "__source", "__block", "__file").mapInPandas(run, "s long, b long, x binary")
    grouped = partial.withColumn("g", F.floor(F.spark_partition_id() / TREES_AT_ONCE)).repartition("g").mapInPandas(joining, "s long, b long, x binary")
    state, error, hits, misses = join(r["x"] for r in sorted(grouped.collect(), key=lambda r: (r["s"], r["b"])))
    if error:
        raise SchemaConflict(error[1]) if error[0] == "SchemaConflict" else ValueError(error[1])
    records = state.seen if state else 0
    own = state.members["e"].members if state else {}
    columns = []
    for name in options.envelope_fields:
        shape = own.get(name)
        columns.append(pa.field(name, shape.arrow() if shape else pa.null(), shape is None or shape.nulls > 0 or shape.seen < records))
    rest = state.members["p"] if state else Shape(members={})
    rest = Shape(members=rest.members, seen=records)
    columns.append(pa.field(payload, rest.arrow(), True))
    rendered = [p for k, s in own.items() for p in _mixed(s, (k,))] + [p for k, s in rest.members.items() for p in _mixed(s, (k,))]
    return Discovered(pa.schema(columns), records, rendered, misses, hits, misses)


def _text(value):
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e16 else repr(value)
    return str(value) if isinstance(value, int) else value


def _rendered(value, path: tuple[str, ...]):
    if not path:
        return _text(value)
    if path[0] == "[]" and isinstance(value, list):
        return [_rendered(v, path[1:]) for v in value]
    if isinstance(value, dict) and path[0] in value:
        return {**value, path[0]: _rendered(value[path[0]], path[1:])}
    return value


def typed(df: DataFrame, found: Discovered, options: NdjsonOptions) -> DataFrame:
    """The lines as envelope columns and one payload struct; order columns stay behind them."""
    payload = options.payload_column
    body = found.schema.field(payload).type
    if not body.num_fields:
        raise ValueError("the payload has no field in any record; Spark's Parquet sink can't write a struct without fields")
    if found.rendered:
        paths = found.rendered

        @F.pandas_udf("string")
        def as_text(lines: pd.Series) -> pd.Series:
            out = []
            for x in lines:
                record = json.loads(x, object_pairs_hook=_first_wins)
                for p in paths:
                    record = _rendered(record, p)
                out.append(json.dumps(record))
            return pd.Series(out, dtype=object)

        df = df.withColumn("line", as_text("line"))
    # Keys of the envelope and of the payload stand side by side in a line: one parse serves both.
    flat = {f.name: to_spark(f.type) for f in body} | {n: to_spark(found.schema.field(n).type) for n in options.envelope_fields}
    known = {n: t for n, t in flat.items() if not isinstance(t, T.NullType)}
    parsed = F.from_json("line", T.StructType([T.StructField(n, t) for n, t in known.items()]), {"mode": "FAILFAST"})
    value = lambda n: (F.col("__r").getField(n) if n in known else F.lit(None)).alias(n)
    envelope = [value(n) for n in options.envelope_fields]
    return df.withColumn("__r", parsed).select(*envelope, F.struct(*[value(f.name) for f in body]).alias(payload), "__source", "__block", "__at")


def sort_error(schema: pa.Schema, name: str) -> str | None:
    kind = schema.field(name).type
    if kind in SORTABLE:
        return None
    return f"sort field `{name}` has unsupported type {shown(kind)}; supported types are Int64, UInt64, Float64, Utf8, and LargeUtf8"


def read(df: DataFrame, options: NdjsonOptions, found: Discovered | None = None) -> tuple[DataFrame, Discovered]:
    """The typed table of a frame of lines, sorted if the options say so. The sort spills; a cap on its rows is a guard that callers
    may set."""
    found = found or discover_lines(df, options)
    if options.sort_field is not None:
        if problem := sort_error(found.schema, options.sort_field):
            raise ValueError(problem)
        if options.sort_max_rows_in_memory is not None and found.records > options.sort_max_rows_in_memory:
            raise ValueError(f"NDJSON sort requires buffering {found.records} rows, which exceeds sort_max_rows_in_memory={options.sort_max_rows_in_memory}; external spill sort is not implemented")
    out = typed(df, found, options)
    if options.sort_field is not None:
        kind = found.schema.field(options.sort_field).type
        out = out.orderBy(*sort_columns(options.sort_field, kind == pa.float64()), "__source", "__block", "__at")
    return out, found
