"""Rows of delimited text that cannot be read under a schema, with the first reason, beside the rest as typed columns.

One anchored pattern is generated from the schema for the whole row. Only rows that fail it go on to the incremental
patterns: all fields well quoted, the right number of fields, and then the prefixes ``f1``, ``f1,f2``, … of typed
fields, the first of which that fails names the broken field. Everything is a JVM expression over one scan: nothing is
shuffled, so no skew can arise. All repetitions are possessive; matching is linear and doesn't recurse in very long rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
PLAIN = r'(?!")[^,]*+'
ANY = f"(?:{QUOTED}|{PLAIN})"
NUMBER = r"[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?"


@dataclass(frozen=True)
class Field:
    """A column of the text. ``pattern`` restricts the value without quotes and outer spaces; None admits anything."""

    name: str
    type: str = "string"
    pattern: str | None = None
    optional: bool = False

    def regex(self) -> str:
        if self.pattern is None:
            return ANY
        value = f"(?:{self.pattern})" + "?" * self.optional
        return f'(?:" *+{value} *+"| *+{value} *+)(?=,|\\z)'


#: The columns of the exports: whole numbers of at most 18 and 9 digits, an optional finite double, two free texts.
EXPORT = (
    Field("event_id", "bigint", "[0-9]{1,18}+"),
    Field("org_id", "int", "[0-9]{1,9}+"),
    Field("score", "double", NUMBER, optional=True),
    Field("name"),
    Field("age", "int"),
)


def row_pattern(fields: tuple[Field, ...]) -> str:
    return r"\A" + ",".join(f.regex() for f in fields) + r"\z"


def prefix_patterns(fields: tuple[Field, ...]) -> list[tuple[str, str]]:
    """(reason, pattern that a row without this fault has), in the order in which faults count."""
    steps = [("quoting", rf"\A{ANY}(?:,{ANY})*+\z"), ("column_count", rf"\A{ANY}(?:,{ANY}){{{len(fields) - 1}}}+\z")]
    for k, field in enumerate(fields):
        if field.pattern is not None:
            steps.append((field.name, r"\A" + ",".join(f.regex() for f in fields[: k + 1]) + r"(?=,|\z)"))
    return steps


def classify_rows(df: DataFrame, line: str, fields: tuple[Field, ...] = EXPORT) -> DataFrame:
    """``df`` with ``reason`` (null for a row that can be read) and ``record``, a struct of the typed fields.

    Defined results: a trailing carriage return isn't part of a row; a null line and an empty one have the reason
    ``column_count``; a double beyond the finite range is a fault of its field; a free field whose text doesn't fit its
    type becomes null and is no fault; repeated lines are classified each; ``record`` is null in faulty rows. An empty
    table gives an empty one. Other columns pass through, also ones named like a field.
    """
    body = F.regexp_replace(F.col(line), r"\r\z", "")
    out = df.withColumn("__body", body).withColumn("__whole", F.coalesce(F.col("__body").rlike(row_pattern(fields)), F.lit(False)))
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.col("__body")), F.lit(f",({QUOTED}|{PLAIN})"), F.lit(1))
    plain = F.transform(cells, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    out = out.withColumn("__cells", plain)
    typed, finite = [], F.lit(True)
    for k, field in enumerate(fields):
        text = F.get(F.col("__cells"), F.lit(k))
        if field.type == "string":
            value = text
        else:
            value = F.nullif(F.trim(text), F.lit("")).try_cast(field.type)
            if field.type in ("double", "float"):
                finite = finite & F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(True))
        typed.append(value.alias(field.name))
    reason = F.when(F.col("__body").isNull(), F.lit("column_count"))
    for k, (name, pattern) in enumerate(prefix_patterns(fields)):
        fault = ~F.col("__body").rlike(pattern)
        field = next((f for f in fields if f.name == name and k >= 2), None)
        if field is not None and field.type in ("double", "float"):
            fault = fault | ~finite
        reason = reason.when(fault, F.lit(name))
    out = out.withColumn("reason", F.when(F.col("__whole") & finite, F.lit(None).cast("string")).otherwise(reason))
    out = out.withColumn("record", F.when(F.col("reason").isNull(), F.struct(*typed)))
    return out.drop("__body", "__whole", "__cells")


def faulty_rows(df: DataFrame, key: str = "row_id", line: str = "line", fields: tuple[Field, ...] = EXPORT) -> DataFrame:
    rows = classify_rows(df.select(F.col(key), F.col(line).alias("__line")), "__line", fields)
    return rows.filter(F.col("reason").isNotNull()).select(key, "reason")


def readable_rows(df: DataFrame, key: str = "row_id", line: str = "line", fields: tuple[Field, ...] = EXPORT) -> DataFrame:
    rows = classify_rows(df.select(F.col(key).alias("__key"), F.col(line).alias("__line")), "__line", fields)
    return rows.filter(F.col("reason").isNull()).select(F.col("__key").alias(key), *(F.col("record")[f.name].alias(f.name) for f in fields))
