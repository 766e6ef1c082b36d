"""Partition columns derived from a time, a number and a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier(number: Column, bounds: tuple[int, ...], names: tuple[str, ...]) -> Column:
    """The name of the first bound that the number is below; the last name where there is none, nulls included."""
    out = None
    for bound, name in zip(bounds, names):
        out = F.when(number < bound, name) if out is None else out.when(number < bound, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def partition_columns(df: DataFrame, timestamp: str, number: str, text: str, bounds: tuple[int, ...] = (200, 300), names: tuple[str, ...] = ("tier1", "tier2", "tier3")) -> DataFrame:
    """Adds ``partition_date``, ``org_tier``, ``partition_country`` and ``partition_struct`` {year, month, day, country, org_tier}."""
    t = F.col(timestamp)
    label = tier(F.col(number), bounds, names)
    return df.withColumns({
        "partition_date": F.date_trunc("day", t), "org_tier": label, "partition_country": F.col(text),
        "partition_struct": F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.col(text).alias("country"), label.alias("org_tier")),
    })


def render(column: Column) -> Column:
    """Any value as text."""
    return column.cast("string")
