"""Rows of one schema as rows of a wider one: columns by name, structs by member name, missing ones null.

A cast of structs in Spark goes by position; here every struct is rebuilt by name, a null one stays null. All of it is
projection: scans keep their pushed filters and pruned columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import types as at
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.plans.options import PayloadOptions
from lamina.plans.types import to_spark
from lamina.plans.widening import fingerprint, fold, is_list, is_scalar, is_text, merge_payload, shown


def same_values(source: pa.DataType, target: pa.DataType) -> bool:
    """Whether a column needs no expression: types that differ by nullability, names of list elements or offset width alone."""
    if at.is_struct(source) and at.is_struct(target):
        return [f.name for f in source] == [f.name for f in target] and all(same_values(a.type, b.type) for a, b in zip(source, target))
    if is_list(source) and is_list(target):
        return same_values(source.value_type, target.value_type)
    return source == target or (is_text(source) and is_text(target))


def adapted(column: Column, source: pa.DataType, target: pa.DataType) -> Column:
    if same_values(source, target):
        return column
    if at.is_null(source):
        return F.lit(None).cast(to_spark(target))
    if at.is_struct(source) and at.is_struct(target):
        members = {f.name: f for f in source}
        parts = [(adapted(column.getField(f.name), members[f.name].type, f.type) if f.name in members else F.lit(None).cast(to_spark(f.type))).alias(f.name) for f in target]
        return F.when(column.isNotNull(), F.struct(*parts))
    if is_list(source) and is_list(target):
        return F.transform(column, lambda x: adapted(x, source.value_type, target.value_type))
    if is_scalar(source) and is_scalar(target) and not at.is_null(target):
        return column.cast(to_spark(target))
    raise TypeError(f"unsupported coercion from {shown(source)} to {shown(target)}")


def adapt(df: DataFrame, source: pa.Schema, target: pa.Schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the target's columns in the target's order; columns in ``keep`` stay behind them."""
    own = {f.name: f for f in source}
    columns = [(adapted(df[f"`{f.name}`"], own[f.name].type, f.type) if f.name in own else F.lit(None).cast(to_spark(f.type))).alias(f.name) for f in target]
    return df.select(*columns, *keep)


@dataclass
class PayloadPlan:
    """The merged schema of payload files, with adapters by schema: each distinct one is compiled once."""

    schema: pa.Schema
    hits: int = 0
    misses: int = 0
    _known: dict[str, bool] = field(default_factory=dict)

    @classmethod
    def of(cls, schemas: list[pa.Schema], options: PayloadOptions = PayloadOptions()) -> PayloadPlan:
        return cls(fold(schemas, lambda a, b: merge_payload(a, b, options)))

    def identical(self, source: pa.Schema) -> bool:
        key = fingerprint(source)
        if key in self._known:
            self.hits += 1
        else:
            self.misses += 1
            self._known[key] = source.names == self.schema.names and all(same_values(a.type, b.type) for a, b in zip(source, self.schema))
        return self._known[key]

    def adapt(self, df: DataFrame, source: pa.Schema) -> DataFrame:
        return df.select(*[f"`{n}`" for n in source.names]) if self.identical(source) else adapt(df, source, self.schema)
