"""Schema algebra: the least schema that holds two given ones, under three contracts.

Logical schemas are Arrow schemas, as Parquet footers keep them; Spark's own types tell neither unsigned from signed nor
units of time, and take every column for nullable. The algebra is a join in a lattice, applied as a left fold; as it is idempotent,
folding the distinct schemas in the order in which they first appear gives what folding all files does.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyarrow import types as at

from lamina.plans.options import NumericMode, PayloadOptions, StringMode, TopLevelOptions, WideningOptions

SIGNED = {8: pa.int8(), 16: pa.int16(), 32: pa.int32(), 64: pa.int64()}
UNSIGNED = {8: pa.uint8(), 16: pa.uint16(), 32: pa.uint32(), 64: pa.uint64()}
# How types are called in messages.
NAMES = {
    pa.null(): "Null", pa.bool_(): "Boolean", pa.int8(): "Int8", pa.int16(): "Int16", pa.int32(): "Int32", pa.int64(): "Int64", pa.uint8(): "UInt8", pa.uint16(): "UInt16",
    pa.uint32(): "UInt32", pa.uint64(): "UInt64", pa.float16(): "Float16", pa.float32(): "Float32", pa.float64(): "Float64", pa.string(): "Utf8", pa.large_string(): "LargeUtf8",
    pa.date32(): "Date32", pa.date64(): "Date64", pa.binary(): "Binary", pa.large_binary(): "LargeBinary",
}


class SchemaConflict(ValueError):
    """Schemas that don't fit together; ``conflicts`` has a line for each place."""

    def __init__(self, conflicts: list[str]):
        self.conflicts = conflicts
        super().__init__(f"schema widening found {len(conflicts)} conflict(s):\n- " + "\n- ".join(conflicts))


def shown(kind: pa.DataType) -> str:
    if at.is_struct(kind):
        return "Struct(" + ", ".join(f"{f.name}: {shown(f.type)}{'?' * f.nullable}" for f in kind) + ")"
    if at.is_list(kind) or at.is_large_list(kind):
        return ("LargeList" if at.is_large_list(kind) else "List") + f"({shown(kind.value_type)}{'?' * kind.value_field.nullable})"
    if at.is_timestamp(kind):
        return f"Timestamp({kind.unit}, {kind.tz})"
    return NAMES.get(kind, str(kind))


def is_list(kind: pa.DataType) -> bool:
    return at.is_list(kind) or at.is_large_list(kind)


def is_numeric(kind: pa.DataType) -> bool:
    return at.is_integer(kind) or at.is_floating(kind)


def is_text(kind: pa.DataType) -> bool:
    return at.is_string(kind) or at.is_large_string(kind)


def is_scalar(kind: pa.DataType) -> bool:
    """What may be widened. All other types pass through a merge only if they are equal on both sides."""
    return at.is_null(kind) or at.is_boolean(kind) or is_numeric(kind) or is_text(kind)


def exact_integer(left: pa.DataType, right: pa.DataType) -> pa.DataType | None:
    """The narrowest integer type that holds all values of both, if there is one."""
    if at.is_signed_integer(left) == at.is_signed_integer(right):
        return max(left, right, key=lambda k: k.bit_width)
    signed, unsigned = (left, right) if at.is_signed_integer(left) else (right, left)
    return next((SIGNED[w] for w in SIGNED if w >= signed.bit_width and w > unsigned.bit_width), None)


def numeric(left: pa.DataType, right: pa.DataType, mode: NumericMode) -> pa.DataType | None:
    floating = at.is_floating(left) or at.is_floating(right)
    if mode is NumericMode.EXACT_SAFE:
        return None if floating else exact_integer(left, right)
    if floating:
        return pa.float64()
    if at.is_signed_integer(left) == at.is_signed_integer(right):
        return exact_integer(left, right)
    return pa.float64() if pa.uint64() in (left, right) else pa.int64()


def scalar(left: pa.DataType, right: pa.DataType, options: WideningOptions) -> pa.DataType | None:
    """The join of two types that may be widened; None if there is none."""
    if left == right:
        return left
    if at.is_null(left) or at.is_null(right):
        other = right if at.is_null(left) else left
        return other if is_scalar(other) else None
    if not (is_scalar(left) and is_scalar(right)):
        return None
    text = pa.large_string() if pa.large_string() in (left, right) else pa.string()
    if is_text(left) and is_text(right):
        return text
    if is_numeric(left) and is_numeric(right) and (joined := numeric(left, right, options.numeric)) is not None:
        return joined
    return text if options.strings is StringMode.PRIMITIVE_TO_STRING else None


class _Join:
    """One pairwise join; collects every conflict before it fails."""

    def __init__(self, options: WideningOptions):
        self.options, self.conflicts = options, []

    def done(self, result):
        if self.conflicts:
            raise SchemaConflict(self.conflicts)
        return result

    def clash(self, path: str, left: pa.DataType, right: pa.DataType) -> pa.DataType:
        self.conflicts.append(f"field `{path or '<root>'}` incompatible types for widening: left={shown(left)}, right={shown(right)}")
        return left

    def type(self, path: str, left: pa.DataType, right: pa.DataType) -> pa.DataType:
        if left == right and not at.is_nested(left):
            return left
        if at.is_struct(left) and at.is_struct(right):
            return pa.struct(self.fields(path, list(left), list(right)))
        if is_list(left) and is_list(right):
            element = self.field(f"{path}[]", left.value_field, right.value_field)
            return pa.large_list(element) if at.is_large_list(left) or at.is_large_list(right) else pa.list_(element)
        if left == right:
            return left
        joined = scalar(left, right, self.options)
        return self.clash(path, left, right) if joined is None else joined

    def field(self, path: str, left: pa.Field, right: pa.Field, kind: pa.DataType | None = None) -> pa.Field:
        kind = self.type(path, left.type, right.type) if kind is None else kind
        a, b = left.metadata or {}, right.metadata or {}
        if a and b and a != b:
            self.conflicts.append(f"field `{path or '<root>'}` incompatible metadata for widening: left={a}, right={b}")
        return pa.field(left.name, kind, left.nullable or right.nullable, a or b or None)

    def fields(self, path: str, left: list[pa.Field], right: list[pa.Field]) -> list[pa.Field]:
        """Left order, then what only the right has; what one side lacks is nullable. Names match exactly, with case."""
        other = {f.name: f for f in right}
        own = {f.name for f in left}
        under = f"{path}." if path else ""
        out = [self.field(under + f.name, f, other[f.name]) if f.name in other else f.with_nullable(True) for f in left]
        return out + [f.with_nullable(True) for f in right if f.name not in own]


def widen_type(left: pa.DataType, right: pa.DataType, options: WideningOptions = WideningOptions()) -> pa.DataType:
    join = _Join(options)
    return join.done(join.type("", left, right))


def merge_schemas(left: pa.Schema, right: pa.Schema, options: WideningOptions = WideningOptions()) -> pa.Schema:
    """Every column may be missing on one side and is widened at every level. Schema metadata is dropped."""
    join = _Join(options)
    return join.done(pa.schema(join.fields("", list(left), list(right))))


def merge_top_level(left: pa.Schema, right: pa.Schema, options: TopLevelOptions = TopLevelOptions()) -> pa.Schema:
    """Columns may be missing; scalars are widened; nested columns must be equal."""
    join = _Join(options.widening)
    other, own = {f.name: f for f in right}, {f.name for f in left}
    out = []
    for f in left:
        if f.name not in other:
            out.append(f.with_nullable(True))
            continue
        g = other[f.name]
        kind = f.type if f.type == g.type else scalar(f.type, g.type, options.widening)
        out.append(join.field(f.name, f, g, join.clash(f.name, f.type, g.type) if kind is None else kind))
    out += [f.with_nullable(True) for f in right if f.name not in own]
    return join.done(pa.schema(out))


def _payload(schema: pa.Schema, name: str, side: str) -> pa.Field:
    if schema.get_field_index(name) < 0:
        raise SchemaConflict([f"{side} schema is missing required payload column `{name}`"])
    field = schema.field(name)
    if not at.is_struct(field.type):
        raise SchemaConflict([f"{side} payload column `{name}` must be Struct, found {shown(field.type)}"])
    return field


def merge_payload(left: pa.Schema, right: pa.Schema, options: PayloadOptions = PayloadOptions()) -> pa.Schema:
    """Columns beside the payload must be on both sides with equal types; the payload is widened at every level."""
    name = options.payload_column
    for side, schema in (("left", left), ("right", right)):
        _payload(schema, name, side)
    join = _Join(options.widening)
    other, own = {f.name: f for f in right}, {f.name for f in left}
    out = []
    for f in left:
        if f.name not in other:
            join.conflicts.append(f"stable envelope column `{f.name}` is missing from right schema")
        elif f.name == name:
            out.append(join.field(name, f, other[name]))
        elif f.type != other[f.name].type:
            join.clash(f.name, f.type, other[f.name].type)
        else:
            out.append(join.field(f.name, f, other[f.name], f.type))
    join.conflicts += [f"stable envelope column `{f.name}` is missing from left schema" for f in right if f.name not in own]
    return join.done(pa.schema(out))


def fold(schemas: list[pa.Schema], contract) -> pa.Schema:
    """A left fold. A single schema is taken as it is, without the contract's checks."""
    if not schemas:
        raise ValueError("at least one input schema is required")
    return reduce(contract, schemas)


def index_mapping(target: pa.Schema, source: pa.Schema) -> list[int | None]:
    """For each target column its place in the source, None where it is missing."""
    places = {name: k for k, name in reversed(list(enumerate(source.names)))}
    return [places.get(name) for name in target.names]


def fingerprint(schema: pa.Schema) -> str:
    """Equal for equal schemas: names, nullability, types and metadata at every level, in order."""
    def text(f: pa.Field) -> str:
        inner = ""
        if at.is_struct(f.type):
            inner = "{" + ",".join(map(text, f.type)) + "}"
        elif is_list(f.type):
            inner = f"{'L' if at.is_large_list(f.type) else 'l'}[{text(f.type.value_field)}]"
        else:
            inner = shown(f.type)
        meta = sorted((f.metadata or {}).items())
        return f"{f.name!r}:{f.nullable}:{inner}{meta or ''}"

    return hashlib.sha256(";".join(map(text, schema)).encode("utf-8", "surrogatepass")).hexdigest()
