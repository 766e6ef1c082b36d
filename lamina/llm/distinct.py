"""Distinct counts from mergeable registers, for every combination of group columns.

Each identifier is hashed to a register and a rank (rank r with probability 2^-r). A register is one byte: the highest rank
and two bits that say whether the two ranks below it occurred. Two registers are merged by comparison and shift: the higher
rank stays, the other's bits move down by the difference. A sketch is a group's registers: three bytes for each that was
touched, or all 2^PRECISION bytes once that is shorter. Tasks reduce their rows to one sketch per group of every combination
before anything is shuffled, and keep sketches that are full while their rows last, so that no group, however large, sends
more than one of them per task. Estimates maximize the likelihood of the registers, with a standard error of
0.76 / sqrt(registers), where registers with the highest rank alone need 1.9 times as many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 2^PRECISION registers: a standard error of 1.2 %.
PRECISION = 12
#: Indicator bits below the highest rank.
INDICATORS = 2
#: Rows that a task reduces at once, and full sketches that it keeps beyond that.
ROWS_AT_ONCE = 1 << 18
MAX_KEPT = 256
#: Bytes of sketches that are merged at once.
BYTES_AT_ONCE = 4 << 20
GROUPING = "__grouping"


def standard_error(precision: int = PRECISION) -> float:
    return 0.7608 / math.sqrt(1 << precision)


def register_code(item: Column, precision: int = PRECISION) -> Column:
    """The register of an identifier and its byte, as one number. The lowest hash bits name the register; the rank is the place of
    the lowest one bit of the rest. Null for null."""
    h = F.xxhash64(item)
    rest = F.shiftrightunsigned(h, precision)
    rank = F.when(rest == 0, F.lit(64 - precision + 1)).otherwise(F.bit_count(rest.bitwiseAND(F.negative(rest)) - 1) + 1)
    return F.when(item.isNotNull(), (h.bitwiseAND(F.lit((1 << precision) - 1)) * 256 + rank * 4).cast("int"))


def joined(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Registers with equal keys merged: (sorted keys, bytes)."""
    if not len(key):
        return key, value
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    rank = value >> 2
    top = np.maximum.reduceat(rank, cut)
    fall = np.repeat(top, np.diff(np.r_[cut, len(key)])) - rank
    bits = (4 | value & 3) >> np.minimum(fall, 7)
    return key[cut], top << 2 | np.bitwise_or.reduceat(bits, cut) & 3


def _joined_full(group: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full sketches, one per row and sorted by group, merged to one per group."""
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    if len(cut) == len(group):
        return group, full
    rank = full >> 2
    top = np.maximum.reduceat(rank, cut, axis=0)
    fall = np.repeat(top, np.diff(np.r_[cut, len(group)]), axis=0) - rank
    bits = np.where(full > 0, 4 | full & 3, 0).astype(np.uint8) >> np.minimum(fall, 7)
    return group[cut], top << 2 | np.bitwise_or.reduceat(bits, cut, axis=0) & 3


def unpacked(sketches: pa.Array, group: np.ndarray, precision: int = PRECISION) -> tuple[np.ndarray, np.ndarray]:
    """The registers of sketches whose groups are sorted, merged by group: (group * 2^precision + register, byte)."""
    m = 1 << precision
    offsets = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1]
    data = np.frombuffer(sketches.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    is_full = size == m
    of_full = np.repeat(is_full, size)
    few = data[~of_full].reshape(-1, 3)
    key = np.repeat(group[~is_full], size[~is_full] // 3) * m + (few[:, 0].astype(np.int64) | few[:, 1].astype(np.int64) << 8)
    value = few[:, 2]
    if is_full.any():
        owner, full = _joined_full(group[is_full], data[of_full].reshape(-1, m))
        at, register = np.nonzero(full)
        key, value = np.r_[key, owner[at] * m + register], np.r_[value, full[at, register]]
    return joined(key, value)


def packed(key: np.ndarray, value: np.ndarray, groups: int, precision: int = PRECISION) -> pa.Array:
    """One sketch for each of ``groups`` groups from merged registers; the inverse of ``unpacked``."""
    m = 1 << precision
    group, register = key // m, key % m
    count = np.bincount(group, minlength=groups)
    is_full = 3 * count >= m
    size = np.where(is_full, m, 3 * count)
    offsets = np.r_[0, np.cumsum(size)]
    data = np.zeros(int(offsets[-1]), np.uint8)
    place = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
    full = is_full[group]
    data[offsets[group[full]] + register[full]] = value[full]
    at = offsets[group[~full]] + 3 * place[~full]
    data[at], data[at + 1], data[at + 2] = register[~full] & 255, register[~full] >> 8, value[~full]
    return pa.Array.from_buffers(pa.binary(), groups, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def estimates(key: np.ndarray, value: np.ndarray, groups: int, precision: int = PRECISION) -> np.ndarray:
    """The maximum-likelihood count of each of ``groups`` groups from its merged registers.

    With a Poisson rate x per register, rank j is absent with probability exp(-x 2^-j); registers give the exponents of absent
    ranks (their sum is ``absent``) and counts of present ones. The derivative of the log likelihood falls in x; Newton's
    method on log x finds its root for all groups at once.
    """
    m, top = 1 << precision, 64 - precision + 1
    group, high, bits = key // m, (value >> 2).astype(np.int64), value & 3
    weight = 2.0 ** -np.minimum(np.arange(top + 1), top - 1)  # of rank j; the last has the weight of the one before
    present = np.zeros((groups, top + 1))
    absent = m - np.bincount(group, minlength=groups).astype(np.float64)  # untouched registers lack all ranks
    absent += np.bincount(group, weights=np.where(high < top, 2.0 ** -high.astype(np.float64), 0.0), minlength=groups)
    for below in range(INDICATORS + 1):
        rank = high - below
        valid = rank >= 1
        seen = valid if below == 0 else valid & (bits >> (INDICATORS - below) & 1 == 1)
        present += np.bincount(group[seen] * (top + 1) + rank[seen], minlength=groups * (top + 1)).reshape(groups, -1)
        lacking = valid & ~seen
        absent += np.bincount(group[lacking], weights=weight[rank[lacking]], minlength=groups)
    out = np.zeros(groups)
    live = np.flatnonzero(present.sum(axis=1) > 0)
    b, a = present[live], absent[live]
    used = np.flatnonzero(b.sum(axis=0) > 0)
    b, w = b[:, used], weight[used]
    x = np.maximum(b.sum(axis=1) / m, 1e-9) * 1.0
    for _ in range(60):
        z = np.minimum(x[:, None] * w, 700.0)
        ez = np.expm1(z)
        f = (b * (z / ez)).sum(axis=1) - a * x  # x times the derivative
        slope = (b * (z / ez) * (1 - z * (ez + 1) / ez)).sum(axis=1) - a * x
        step = np.clip(f / np.where(slope == 0, -1e-300, slope), -2, 2)
        x = x * np.exp(-step)
        if np.all(np.abs(step) < 1e-9):
            break
    out[live] = x * m
    return out


def _numbered(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's combination, a row that has it)."""
    at = np.zeros(len(columns[0]), np.int64) if columns else np.zeros(0, np.int64)
    first = np.zeros(min(len(at), 1), np.int64)
    for c in columns:
        _, first, at = np.unique(at * (int(c.max(initial=0)) + 1) + c, return_index=True, return_inverse=True)
    return at, first


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    codes = column.dictionary_encode(null_encoding="encode")
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    return codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def sketches(df: DataFrame, dims: dict[str, Column], items: dict[str, Column], sets: list[tuple[str, ...]], precision: int = PRECISION) -> DataFrame:
    """Mergeable partial results: (``__grouping``, dims, one sketch per item), a row or more per group of each of ``sets``, which are
    numbered by their place; dims that a set lacks are null. Null items don't count; a group without items has empty sketches."""
    base = df.select(*[c.alias(n) for n, c in dims.items()], *[register_code(c, precision).alias(n) for n, c in items.items()]) if dims else df.select(*[register_code(c, precision).alias(n) for n, c in items.items()])
    schema = T.StructType([T.StructField(GROUPING, T.IntegerType()), *[T.StructField(n, base.schema[n].dataType) for n in dims], *[T.StructField(n, T.BinaryType()) for n in items]])
    m, dims, items = 1 << precision, list(dims), list(items)
    names = [GROUPING, *dims]

    def reduced(batches: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(batches).combine_chunks()
        codes = {n: _codes(rows[n]) for n in dims}
        fine, first = _numbered(list(codes.values())) if dims else (np.zeros(rows.num_rows, np.int64), np.zeros(1, np.int64))
        found = []
        for n in items:
            column = rows[n].combine_chunks() if isinstance(rows[n], pa.ChunkedArray) else rows[n]
            known = column.is_valid().to_numpy(zero_copy_only=False)
            code = column.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
            found.append(joined(fine[known] * m + (code >> 8), (code & 255).astype(np.uint8)))
        out = []
        for k, s in enumerate(sets):
            own, at = _numbered([codes[n][first] for n in s]) if s else (np.zeros(len(first), np.int64), np.zeros(1, np.int64))
            take = pa.array(first[at])
            columns = [pa.array(np.full(len(at), k, np.int32))]
            columns += [rows[n].take(take).combine_chunks() if n in s else pa.nulls(len(at), rows.schema.field(n).type) for n in dims]
            columns += [packed(*joined(own[key // m] * m + key % m, value), len(at), precision) for key, value in found]
            out.append(pa.Table.from_arrays(columns, names=[*names, *items]))
        return pa.concat_tables(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count, kept = [], 0, None
        for batch in batches:
            waiting.append(batch)
            count += batch.num_rows
            if count >= ROWS_AT_ONCE:
                out, kept = _without_full(reduced(waiting), kept, names, items, precision)
                yield from out.to_batches()
                waiting, count = [], 0
        if count:
            yield from reduced(waiting).to_batches()
        if kept is not None:
            yield from kept.to_batches()

    return base.mapInArrow(run, schema)


def _without_full(new: pa.Table, kept: pa.Table | None, names: list[str], items: list[str], precision: int) -> tuple[pa.Table, pa.Table | None]:
    """What a task sends on at once, and the full sketches that it keeps for rows to come."""
    full = np.logical_or.reduce([pc.binary_length(new[i]).to_numpy() == 1 << precision for i in items])
    if not full.any():
        return new, kept
    own = new.filter(pa.array(full))
    own = own if kept is None else pa.concat_tables([kept, own])
    own = own.sort_by([(n, "ascending") for n in names]).combine_chunks()
    own = pa.Table.from_batches([_combined(own, names, items, precision)]) if own.num_rows else own
    return pa.concat_tables([new.filter(pa.array(~full)), own.slice(MAX_KEPT)]), own.slice(0, MAX_KEPT)


def _runs(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Numbers of runs of equal names, nulls equal to each other."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for n in names:
        codes = _codes(table[n])
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new) - 1


def _combined(table: pa.Table, names: list[str], items: list[str], precision: int) -> pa.RecordBatch:
    """One row for each run of equal names."""
    run = _runs(table, names)
    starts = pa.array(np.flatnonzero(np.r_[True, run[1:] != run[:-1]]))
    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    columns = [whole(table[n].take(starts)) for n in names]
    columns += [packed(*unpacked(whole(table[i]), run, precision), len(starts), precision) for i in items]
    return pa.RecordBatch.from_arrays(columns, names=[*names, *items])


def merged(partial: DataFrame, names: list[str], items: list[str], precision: int = PRECISION) -> DataFrame:
    """One row per group, whatever partial results there are of it and in whatever order. Groups are merged as they stream by; no
    task holds more than a few megabytes of sketches."""
    rows = partial.select(*names, *items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last group so far
        for batch in batches:
            size = np.sum([pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False) for i in items], axis=0)
            part = np.cumsum(size) // BYTES_AT_ONCE
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part_of = batch.slice(a, b - a)
                if held is not None:
                    held = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(held.columns, part_of.schema)], schema=part_of.schema)
                out = _combined(pa.Table.from_batches([held, part_of] if held is not None else [part_of]).combine_chunks(), names, items, precision)
                if out.num_rows > 1:
                    yield out.slice(0, out.num_rows - 1)
                held = out.slice(out.num_rows - 1)
        if held is not None:
            yield held

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, rows.schema)


def counted(whole: DataFrame, names: list[str], items: list[str], precision: int = PRECISION) -> DataFrame:
    """One row per merged group: its names and the estimate of each item."""
    schema = T.StructType([*[whole.schema[n] for n in names], *[T.StructField(i, T.DoubleType()) for i in items]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                n = part.num_rows
                found = [pa.array(estimates(*unpacked(part.column(i), np.arange(n), precision), n, precision)) for i in items]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in names], *found], names=schema.names)

    return whole.select(*names, *items).mapInArrow(run, schema)


def combinations_of(names: list[str]) -> list[tuple[str, ...]]:
    return [s for n in range(len(names), -1, -1) for s in combinations(names, n)]


def level_of(number: Column, sets: list[tuple[str, ...]]) -> Column:
    return F.element_at(F.array(*[F.lit(",".join(s)) for s in sets]), number + 1)


def distinct_counts(df: DataFrame, dims: dict[str, Column], items: dict[str, Column], precision: int = PRECISION) -> DataFrame:
    """For every combination of ``dims``: ``level`` (the names it groups by), the dims, an estimate per item, ``std_error``.

    Defined results: null items don't count, and a group whose items are all null has the estimate 0; null in a dim is a value
    of its own, told from a dim that isn't grouped by through ``level``; repeated rows count once; the empty combination is
    one row over everything, which an empty table lacks. Merging partial results in any order gives the same registers.
    ``dims`` and ``items`` must not share names.
    """
    names, sets = [GROUPING, *dims], combinations_of(list(dims))
    whole = merged(sketches(df, dims, items, sets, precision), names, list(items), precision)
    out = counted(whole, names, list(items), precision)
    return out.select(level_of(F.col(GROUPING), sets).alias("level"), *dims, *items, F.lit(standard_error(precision)).alias("std_error"))


def exact_counts(df: DataFrame, dims: dict[str, Column], items: dict[str, Column]) -> DataFrame:
    """The same groups counted exactly, to hold the estimates against: the cost grows with all distinct identifiers of all groups."""
    sets = combinations_of(list(dims))
    known = F.explode(F.array(*[F.struct(F.lit(k).alias("item"), c.cast("string").alias("value")) for k, c in enumerate(items.values())]))
    fine = df.select(*[c.alias(n) for n, c in dims.items()], known.alias("s")).select(*dims, "s.*").distinct()
    rows = fine.select(F.explode(F.array(*[F.lit(k) for k in range(len(sets))])).alias(GROUPING), *dims, "item", "value")
    kept = [F.when(F.col(GROUPING).isin([k for k, s in enumerate(sets) if d in s]), F.col(d)).alias(d) for d in dims]
    distinct = rows.select(GROUPING, *kept, "item", "value").distinct()
    return distinct.groupBy(GROUPING, *dims).agg(*[F.count(F.when(F.col("item") == k, F.col("value"))).alias(n) for k, n in enumerate(items)]).select(
        level_of(F.col(GROUPING), sets).alias("level"), *dims, *items)


def checked_counts(df: DataFrame, dims: dict[str, Column], items: dict[str, Column], precision: int = PRECISION) -> DataFrame:
    """The exact counts, and for each item whether its estimate lies within five standard errors of them and two more (few identifiers
    may share registers)."""
    key = lambda side: F.struct("level", *dims).alias(side)
    exact = exact_counts(df, dims, items).select(key("g"), *items)
    guess = distinct_counts(df, dims, items, precision).select(key("h"), *[F.col(i).alias(f"__{i}") for i in items])
    near = [(F.abs(F.col(f"__{i}") - F.col(i)) <= 5 * standard_error(precision) * F.col(i) + 2).alias(f"{i}_within") for i in items]
    return exact.join(guess, F.col("g").eqNullSafe(F.col("h")), "full").select("g.*", *items, *near)
