"""Logical (Arrow) types and Spark types."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import types as at
from pyspark.sql import types as T

from lamina.plans.widening import is_list, shown

_PLAIN = {
    pa.null(): T.NullType(), pa.bool_(): T.BooleanType(), pa.int8(): T.ByteType(), pa.int16(): T.ShortType(), pa.int32(): T.IntegerType(), pa.int64(): T.LongType(),
    pa.uint8(): T.ShortType(), pa.uint16(): T.IntegerType(), pa.uint32(): T.LongType(), pa.uint64(): T.DecimalType(20, 0), pa.float32(): T.FloatType(), pa.float64(): T.DoubleType(),
    pa.string(): T.StringType(), pa.large_string(): T.StringType(), pa.date32(): T.DateType(), pa.date64(): T.DateType(), pa.binary(): T.BinaryType(), pa.large_binary(): T.BinaryType(),
}


def to_spark(kind: pa.DataType) -> T.DataType:
    """The type that Spark reads such a column as."""
    if kind in _PLAIN:
        return _PLAIN[kind]
    if at.is_struct(kind):
        return T.StructType([T.StructField(f.name, to_spark(f.type)) for f in kind])
    if is_list(kind) or at.is_fixed_size_list(kind):
        return T.ArrayType(to_spark(kind.value_type))
    if at.is_map(kind):
        return T.MapType(to_spark(kind.key_type), to_spark(kind.item_type))
    if at.is_timestamp(kind):
        if kind.unit == "ns":
            raise TypeError("Spark's Parquet source doesn't read nanoseconds; write microseconds, or read them as numbers")
        return T.TimestampType() if kind.tz else T.TimestampNTZType()
    if at.is_decimal(kind):
        return T.DecimalType(kind.precision, kind.scale)
    if at.is_dictionary(kind):
        return to_spark(kind.value_type)
    raise TypeError(f"Spark has no type for {shown(kind)}")


def from_spark(kind: T.DataType) -> pa.DataType:
    """The logical type of a DataFrame's column; for frames that come from no file."""
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, from_spark(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa.field("element", from_spark(kind.elementType), kind.containsNull))
    if isinstance(kind, T.MapType):
        return pa.map_(from_spark(kind.keyType), from_spark(kind.valueType))
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    if isinstance(kind, T.TimestampType):
        return pa.timestamp("us", "UTC")
    if isinstance(kind, T.TimestampNTZType):
        return pa.timestamp("us")
    for arrow, spark in _PLAIN.items():
        if type(spark) is type(kind) and not at.is_unsigned_integer(arrow):
            return arrow
    raise TypeError(f"no logical type for {kind.simpleString()}")


def schema_of(struct: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, from_spark(f.dataType), f.nullable) for f in struct.fields])
