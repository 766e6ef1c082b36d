"""Percentiles per group from merging centroid digests, certified by counting.

A digest is a sorted list of centroids. Sorted values (or the centroids of many digests) are clustered under a size
function of their quantile: with k(q) = DELTA / pi * (asin(2q - 1) + pi / 2), what lies between two whole values of k is
one centroid, so that centroids are small at both ends. Merging is clustering again. Digests are made per Arrow batch, table and
date, merged per (table, date, group, salt) and then per group, each time over sorted streams: no task holds more than a
batch and the digest it works on. A second pass over the values counts how many lie below each answer; the rank error
that it finds is exact. Keys of which an answer misses the bound are digested again with more centroids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.session import written

#: Centroids of a digest at most. The rank error at quantile q is at most about pi * sqrt(q * (1 - q)) / (2 * DELTA).
DELTA = 512
#: The rank error, as a share of the group's values, that is promised beside one value.
BOUND = 0.01
#: How often keys that miss the bound are digested again, each time with so many times the centroids.
REFINEMENTS, FINER = 3, 8
#: Parts of a key at the first merge.
SALTS = 16
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
BIG = np.finfo(np.float64).max
_DIGEST = [("means", pa.list_(pa.float64())), ("weights", pa.list_(pa.int64())), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64())]
DIGEST_DDL = "means array<double>, weights array<bigint>, low double, high double, n bigint"


def cluster(group: np.ndarray, means: np.ndarray, weights: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of many groups at once. ``group`` is sorted, ``means`` are within each group."""
    if not len(group):
        return group, means, weights
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    total = np.cumsum(weights)
    base = np.repeat(total[starts] - weights[starts], sizes)
    n = np.repeat(np.add.reduceat(weights, starts), sizes)
    q = (total - base - weights / 2) / n
    k = np.minimum(delta / np.pi * (np.arcsin(np.clip(2 * q - 1, -1, 1)) + np.pi / 2), delta - 1e-9).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (k[1:] != k[:-1])])
    w = np.add.reduceat(weights, cut)
    sums = np.add.reduceat(means.astype(np.longdouble) * weights, cut)  # wide enough for the sum of extreme values
    m = (sums / w).astype(np.float64)
    single = np.diff(np.r_[cut, len(group)]) == 1
    m[single] = means[cut[single]]
    return group[cut], m, w


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """The value at rank q * n, between the middles of the centroids."""
    n = weights.sum()
    middle = np.r_[0.0, np.cumsum(weights) - weights / 2, float(n)]
    at = np.r_[low, means, high].astype(np.longdouble)
    t = q * n
    i = int(np.clip(np.searchsorted(middle, t, "right") - 1, 0, len(at) - 2))
    span = middle[i + 1] - middle[i]
    share = np.longdouble((t - middle[i]) / span) if span > 0 else np.longdouble(0)
    return float(min(max(at[i] + (at[i + 1] - at[i]) * share, np.longdouble(low)), np.longdouble(high)))


def _emit(keys: list[pa.Array], names: list[str], group: np.ndarray, means: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[starts, len(group)].astype(np.int32), pa.int32())
    n = np.add.reduceat(weights, starts) if len(group) else np.zeros(0, np.int64)
    columns = [pa.ListArray.from_arrays(offsets, pa.array(means)), pa.ListArray.from_arrays(offsets, pa.array(weights.astype(np.int64))), pa.array(low), pa.array(high), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays([*keys, *columns], names=[*names, *[k for k, _ in _DIGEST]])


def _runs(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Numbers of runs of equal keys, nulls equal to each other."""
    new = np.zeros(batch.num_rows, bool)
    if len(new):
        new[0] = True
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        codes = codes.indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new) - 1


def digests(df: DataFrame, keys: list[str], value: str, delta: int = DELTA) -> DataFrame:
    """Partial digests: (keys, means, weights, low, high, n), one or more rows per key. Nulls and NaN don't count."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name in keys], *T._parse_datatype_string(DIGEST_DDL).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).sort_by([(k, "ascending") for k in [*keys, "__v"]]).combine_chunks()
            group = _runs(table, keys)
            v = np.clip(table.column("__v").to_numpy(), -BIG, BIG)
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.r_[starts[1:], len(group)] - 1
            g, m, w = cluster(group, v, np.ones(len(v), np.int64), delta)
            yield _emit([table.column(k).combine_chunks().take(pa.array(starts)) for k in keys], keys, g, m, w, v[starts], v[ends])

    return rows.mapInArrow(run, schema)


def merged(partial: DataFrame, keys: list[str], salts: int = 1, delta: int = DELTA) -> DataFrame:
    """One digest per key (and salt, if there are any: merge again without, for one per key)."""
    names = [*keys, "__salt"] if salts > 1 else keys
    rows = partial.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts))) if salts > 1 else partial
    rows = rows.select(*names, *[k for k, _ in _DIGEST])
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the digest of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                held = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(held.columns, batch.schema)], schema=batch.schema)
            out = _combined(pa.Table.from_batches([held, batch] if held is not None else [batch]), names, delta)
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
            held = out.slice(out.num_rows - 1)
        if held is not None:
            yield held

    ordered = rows.repartition(*names).sortWithinPartitions(*names)
    out = ordered.mapInArrow(run, schema)
    return out.drop("__salt") if salts > 1 else out


def _combined(table: pa.Table, names: list[str], delta: int = DELTA) -> pa.RecordBatch:
    table = table.combine_chunks()
    run = _runs(table, names)
    lists = table.column("means").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    means = lists.flatten().to_numpy(zero_copy_only=False)
    weights = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    group = np.repeat(run, lengths)
    order = np.lexsort((means, group))
    g, m, w = cluster(group[order], means[order], weights[order], delta)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    low = np.minimum.reduceat(table.column("low").to_numpy(), starts)
    high = np.maximum.reduceat(table.column("high").to_numpy(), starts)
    return _emit([table.column(k).combine_chunks().take(pa.array(starts)) for k in names], names, g, m, w, low, high)


def quantiles(digest: DataFrame, keys: list[str], at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(keys, n, ``estimates``): the values at the quantiles, in their order."""
    schema = T.StructType([*[f for f in digest.schema.fields if f.name in keys], T.StructField("n", T.LongType()), T.StructField("estimates", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for m, w, low, high in zip(*(batch.column(k).to_pylist() for k in ("means", "weights", "low", "high"))):
                m, w = np.array(m), np.array(w)
                found.append([quantile(m, w, low, high, q) for q in at])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("n"), pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return digest.select(*keys, *[k for k, _ in _DIGEST]).mapInArrow(run, schema)


def certified(values: DataFrame, key: str, value: str, answers: DataFrame, at: tuple[float, ...] = QUANTILES, bound: float = BOUND) -> DataFrame:
    """One row per key and quantile: the estimate, the exact shares of values below and up to it, the rank error that follows,
    and whether it keeps the bound. The answers are joined to the values by key; Spark broadcasts them if their files are under
    its threshold and else sorts both sides, splitting hot keys."""
    v = F.least(F.greatest(F.col("__v"), F.lit(-float(BIG))), F.lit(float(BIG)))
    rows = values.select(F.col(key).alias("__k"), F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v")).withColumn("__v", v)
    both = rows.join(answers.select(F.col(key).alias("__j"), "estimates"), F.col("__k").eqNullSafe(F.col("__j")))
    e = lambda k: F.get(F.col("estimates"), F.lit(k))
    counts = both.groupBy("__k").agg(
        F.count(F.lit(1)).alias("n"), F.first("estimates").alias("estimates"),
        *[F.sum((F.col("__v") < e(k)).cast("bigint")).alias(f"lt{k}") for k in range(len(at))],
        *[F.sum((F.col("__v") <= e(k)).cast("bigint")).alias(f"le{k}") for k in range(len(at))],
    )
    rank: list[Column] = [F.struct(F.lit(q).alias("q"), e(k).alias("value"), F.col(f"lt{k}").alias("below"), F.col(f"le{k}").alias("up_to")) for k, q in enumerate(at)]
    flat = counts.select("__k", "n", F.explode(F.array(*rank)).alias("r")).select(F.col("__k").alias(key), "n", "r.*")
    target = F.col("q") * F.col("n")
    error = F.greatest(F.lit(0.0), F.col("below") - target, target - F.col("up_to")) / F.col("n")
    return flat.withColumn("rank_error", error).withColumn("within_bound", F.col("rank_error") <= F.lit(bound) + 1 / F.col("n"))


def group_percentiles(tables: dict[str, tuple[DataFrame, str, str, str]], key: str, at: tuple[float, ...] = QUANTILES, bound: float = BOUND) -> DataFrame:
    """Percentiles per ``key`` over several tables, from digests per table and date that are merged. ``tables`` has, by name, a
    table with the names of its key, date and value.

    Result: key, ``n``, ``q``, ``value``, ``below``, ``up_to``, ``rank_error``, ``within_bound``. Defined results: nulls and NaN
    don't count; infinite values count as the largest finite ones; a key without values gives no row; with a single value every
    percentile is that value; ties have the error zero; a null key is a key; a null date is a date. Empty tables add nothing.
    """
    values = None
    for name, (df, k, date, value) in tables.items():
        own = df.select(F.col(k).alias(key), F.col(date).alias("__date"), F.expr(value).cast("double").alias("__value"), F.lit(name).alias("__table"))
        values = own if values is None else values.unionByName(own)
    out, delta = None, DELTA
    for left in range(REFINEMENTS, -1, -1):
        by_date = merged(digests(values, ["__table", "__date", key], "__value", delta), ["__table", "__date", key], SALTS, delta)
        answers = written(quantiles(merged(by_date, [key], 1, delta), [key], at), "percentiles")
        found = written(certified(values, key, "__value", answers, at, bound), "certified")
        missed = found.filter("not within_bound").select(F.col(key).alias("__missed")).distinct()
        again = left > 0 and not missed.isEmpty()
        kept = found.join(missed, found[key].eqNullSafe(F.col("__missed")), "left_anti") if again else found
        out = kept if out is None else out.unionByName(kept)
        if not again:
            break
        values = values.join(missed, values[key].eqNullSafe(F.col("__missed")), "left_semi")
        delta *= FINER
    return out
