"""Schemas that drift from file to file: every change as a row, and all files as one table.

Headers: each task reads its lines once and folds what it sees of a file into bit masks, one per path; masks of one
file from many tasks are combined with ``bit_or``, so a file that many tasks share costs no more than one header each.
Files are then compared with the file before them. Only where paths that went and paths that came have a parent and a
type in common are values looked at: lines of those two files, cut to these paths, are read again and combined per
event. Old and new paths meet where an event has the same value at both, so that neither repeated events nor many paths
cost all their pairs; how many events each old path shares with a new one decides whether all of them agreed.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.jsonvalues import canonical
from lamina.session import spread, written

#: Bits of the kinds that a path may hold in one file.
BOOLEAN, INT64, FLOAT64, UTF8, STRUCT, LIST = (1 << k for k in range(6))
#: A number with an exponent but no fraction part: Int64 as a type, but a column of it has to hold doubles.
EXPONENT = 1 << 6
#: A list's elements are a path of their own, with this suffix.
ELEMENT = "[]"
#: Stands between the names of a path, as names may hold points.
SEP = "\x1f"


class Fraction(float):
    """A number written with a fraction part."""


def _fraction(text: str):
    return Fraction(text) if "." in text else Whole(text)


class Whole(float):
    """A number written with an exponent but no fraction part."""


def parse_line(text: str):
    return json.loads(text, parse_float=_fraction)


def note(value, path: str, seen: dict[str, int]) -> None:
    if isinstance(value, bool):
        bit = BOOLEAN
    elif isinstance(value, Whole):
        bit = INT64 | EXPONENT
    elif isinstance(value, int):
        bit = INT64
    elif isinstance(value, float):
        bit = FLOAT64
    elif isinstance(value, str):
        bit = UTF8
    elif isinstance(value, dict):
        bit = STRUCT
    else:
        bit = LIST
    seen[path] = seen.get(path, 0) | bit
    if bit == STRUCT:
        for k, v in value.items():
            if v is not None:
                note(v, path + SEP + k, seen)
    elif bit == LIST:
        for v in value:
            if v is not None:
                note(v, path + SEP + ELEMENT, seen)


def type_of(path: str, masks: dict[str, int]) -> str:
    """The type at a path: the join of its kinds. ``?`` stands for elements of lists that were all empty."""
    mask = masks.get(path, 0) & ~EXPONENT
    if mask == STRUCT:
        return "Struct"
    if mask == LIST:
        return f"List<{type_of(path + SEP + ELEMENT, masks)}>"
    return {0: "?", BOOLEAN: "Boolean", INT64: "Int64", FLOAT64: "Float64", INT64 | FLOAT64: "Float64"}.get(mask, "Utf8")


def same_type(a: str, b: str) -> bool:
    """Empty lists have no say: a list of unknown elements is of the type of any list."""
    if a == b or "?" in (a, b):
        return True
    return a.startswith("List<") and b.startswith("List<") and same_type(a[5:-1], b[5:-1])


def _kept(record: dict, outside: tuple[str, ...]) -> dict:
    return {k: v for k, v in record.items() if k not in outside and v is not None}


def headers(df: DataFrame, file: tuple[str, str], line: str, outside: tuple[str, ...], root: str) -> DataFrame:
    """(file, ``paths``): the masks of each file. Lines that are null or no JSON object are left out."""
    fields = [df.schema[c] for c in file]
    schema = T.StructType([T.StructField("a", fields[0].dataType), T.StructField("b", fields[1].dataType), T.StructField("path", T.StringType()), T.StructField("mask", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (a, b), lines in batch.groupby(["a", "b"], sort=False, dropna=False)["line"]:
                seen: dict[str, int] = {"": 0}
                for text in lines:
                    try:
                        record = parse_line(text)
                    except (ValueError, TypeError, RecursionError):
                        continue
                    if isinstance(record, dict):
                        for k, v in _kept(record, outside).items():
                            note(v, root + SEP + k, seen)
                out += [(a, b, path, mask) for path, mask in seen.items()]
            yield pd.DataFrame(out, columns=["a", "b", "path", "mask"])

    lines = spread(df.select(F.col(file[0]).alias("a"), F.col(file[1]).alias("b"), F.col(line).alias("line")))
    seen = lines.mapInPandas(run, schema).groupBy("a", "b", "path").agg(F.bit_or("mask").alias("mask"))
    return seen.groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("path", "mask"))).alias("paths"))


def compare(old: dict[str, int], new: dict[str, int], root: str) -> tuple[list[tuple], list[tuple]]:
    """Changes (kind, path, '') at paths in only one file or with another type; and candidates (side, path, parent and type): paths that
    may have been renamed, as one went and one came with the same parent and type. Both go down only below structs in both files."""
    children: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    for side, paths in enumerate((old, new)):
        for path in paths:
            if path and not path.endswith(SEP + ELEMENT) and SEP + ELEMENT + SEP not in path:
                children[path.rpartition(SEP)[0]][side].add(path)
    changes, pairs, todo = [], [], [root]
    while todo:
        before, after = children[todo.pop()]
        gone, come = sorted(before - after), sorted(after - before)
        changes += [("removed", p, "") for p in gone] + [("added", p, "") for p in come]
        # Lists of unknown elements fit any list: candidates meet by the outermost part of their types, and are told apart by their values.
        sides = [{p: type_of(p, masks).split("<")[0] for p in paths} for paths, masks in ((gone, old), (come, new))]
        both = set(sides[0].values()) & set(sides[1].values())
        under = gone[0].rpartition(SEP)[0] if gone else ""
        pairs += [(k, p, f"{under}{SEP}{t}") for k, side in enumerate(sides) for p, t in side.items() if t in both]
        for p in before & after:
            if not same_type(a := type_of(p, old), b := type_of(p, new)):
                changes.append(("retyped", p, ""))
            elif a == b == "Struct":
                todo.append(p)
    return changes, pairs


def _at(record: dict, path: list[str]):
    for name in path:
        if not isinstance(record, dict):
            return None
        record = record.get(name)
    return record


def _value(value) -> str:
    return hashlib.md5(canonical(_plain(value)).encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float):
        return int(value) if value.is_integer() else float(value)
    return value


def _dotted(column: str):
    return F.replace(F.col(column), F.lit(SEP), F.lit("."))


def file_changes(df: DataFrame, file: tuple[str, str] = ("feed", "file_no"), line: str = "line", event_id: str = "event_id",
                 outside: tuple[str, ...] = ("event_id", "org_id"), root: str = "payload") -> DataFrame:
    """(``file``, ``change_kind``, ``field_path``, ``new_path``): what changed in each file against the one before it.

    ``file`` is a feed and the number that orders its files. Keys in ``outside`` don't count. Defined results: lines that
    are null, empty or no JSON object hold no value; a file without values has no paths; the first file of a feed
    changes nothing; of a repeated key the last holds; repeated lines count like one; lists that are empty in a whole file
    fit any list; a scalar that shares a path with a struct or list makes it Utf8; where a path may have become several, or several one,
    it is the one with most common events, then the first by name. An empty table gives an empty one.
    """
    first, number = file
    heads = headers(df, file, line, outside, root)
    order = Window.partitionBy("a").orderBy("b")
    steps = heads.select("a", "b", "paths", F.lag("b").over(order).alias("before"), F.lag("paths").over(order).alias("old")).filter(F.col("old").isNotNull())
    kinds = heads.schema
    out = T.StructType([kinds["a"], kinds["b"], T.StructField("before", kinds["b"].dataType), T.StructField("change_kind", T.StringType()), T.StructField("p", T.StringType()), T.StructField("q", T.StringType()), T.StructField("t", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, paths, before, old in zip(batch["a"], batch["b"], batch["paths"], batch["before"], batch["old"]):
                old, new = dict(old), dict(paths)
                changes, candidates = compare(old, new, root)
                rows += [(a, b, before, *x, "") for x in changes] + [(a, b, before, ("old", "new")[k], p, family, type_of(p, new if k else old)) for k, p, family in candidates]
            yield pd.DataFrame(rows, columns=out.names).astype({"b": batch["b"].dtype, "before": batch["b"].dtype})

    changes = written(steps.select("a", "b", "paths", F.col("before"), "old").mapInPandas(run, out), "drift-changes")
    candidates = changes.filter("change_kind in ('old', 'new')").select("a", "b", "before", F.when(F.col("change_kind") == "old", 0).otherwise(1).alias("side"), F.col("p").alias("path"), F.col("q").alias("family"), F.col("t").alias("type"))
    # Which paths of which file to look at, for which later file.
    sides = candidates.select("a", F.when(F.col("side") == 0, F.col("before")).otherwise(F.col("b")).alias("at"), "b", "side", "path", "family", "type")
    wanted = sides.groupBy("a", "at").agg(F.collect_set(F.struct("b", "side", "path", "family", "type")).alias("wanted"))
    lines = df.select(F.col(first).alias("a"), F.col(number).alias("at"), F.col(line).alias("line"))
    seen = T.StructType([kinds["a"], kinds["b"], T.StructField("side", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("family", T.StringType()), T.StructField("type", T.StringType()), T.StructField("e", T.StringType()), T.StructField("v", T.StringType())])

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, text, wanted in zip(batch["a"], batch["line"], batch["wanted"]):
                try:
                    record = parse_line(text)
                except (ValueError, TypeError, RecursionError):
                    continue
                if not isinstance(record, dict) or record.get(event_id) is None:
                    continue
                e = canonical(_plain(record[event_id]))
                for w in wanted:
                    v = _at(record, w["path"].split(SEP)[1:])
                    if v is not None:
                        rows.append((a, w["b"], w["side"], w["path"], w["family"], w["type"], e, _value(v)))
            yield pd.DataFrame(rows, columns=seen.names).astype({"b": "int64", "side": "int32"})

    found = lines.join(wanted, ["a", "at"]).select("a", "line", "wanted").mapInPandas(values, seen)
    # One row per event and path, whatever its copies say: lo and hi differ where they disagree.
    per = written(found.groupBy("a", "b", "family", "e", "side", "path", "type").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "drift-values")
    # Old and new paths meet by event and value; that they never meet otherwise is a matter of counting their common events.
    agreed = per.filter("lo = hi")
    p = agreed.filter("side = 0").select("a", "b", "family", "e", F.col("lo").alias("v"), F.col("path").alias("p"), F.col("type").alias("pt"))
    q = agreed.filter("side = 1").select("a", "b", "family", "e", F.col("lo").alias("v"), F.col("path").alias("q"), F.col("type").alias("qt"))
    alike = p.join(q, ["a", "b", "family", "e", "v"]).groupBy("a", "b", "p", "q", "pt", "qt").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").filter(_same_type(F.col("pt"), F.col("qt")))
    alike = written(alike.select("a", "b", "p", "q", "n"), "drift-alike")
    old = per.filter("side = 0").select("a", "b", "e", F.col("path").alias("p"))
    new = per.filter("side = 1").select("a", "b", "e", F.col("path").alias("q"))
    common = alike.select("a", "b", "p", "q").join(old, ["a", "b", "p"]).join(new, ["a", "b", "e", "q"]).groupBy("a", "b", "p", "q").agg(F.count(F.lit(1)).alias("common"))
    renamed = alike.join(common, ["a", "b", "p", "q"]).filter("n = common").select("a", "b", "p", "q", "n")
    renamed = written(_one_to_one(renamed).select("a", "b", F.lit("renamed").alias("change_kind"), "p", "q"), "drift-renames")
    moved = renamed.select("a", "b", F.lit("removed").alias("change_kind"), "p").unionByName(renamed.select("a", "b", F.lit("added").alias("change_kind"), F.col("q").alias("p")))
    rest = changes.filter("change_kind not in ('old', 'new')").select("a", "b", "change_kind", "p", "q").join(moved, ["a", "b", "change_kind", "p"], "left_anti")
    return rest.unionByName(renamed).select(F.col("a").alias(first), F.col("b").alias(number), "change_kind", _dotted("p").alias("field_path"), _dotted("q").alias("new_path"))


def _same_type(a: Column, b: Column) -> Column:
    """``same_type`` of two columns: up to where one doesn't know its elements, types must be equal."""
    known = lambda c: F.regexp_replace(c, r"\?>*$", "")
    return F.startswith(a, known(b)) & F.startswith(b, known(a)) | (a == b)


def _one_to_one(pairs: DataFrame) -> DataFrame:
    """Of pairs (p, q) of one step those that hold if a path becomes one path only: most common events first, then by name. Few paths of a
    file change their names, and fewer might have become more than one: what has no rival stays as it is, rivals meet per file."""
    rivals = [F.count(F.lit(1)).over(Window.partitionBy("a", "b", c)) for c in "pq"]
    marked = pairs.withColumn("rivals", F.greatest(*rivals))
    kinds = pairs.schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "p", "q"], ascending=[False, True, True], kind="stable")
        old, new, keep = set(), set(), []
        for p, q in zip(rows["p"], rows["q"]):
            keep.append(p not in old and q not in new)
            if keep[-1]:
                old.add(p)
                new.add(q)
        return rows[keep][kinds.names]

    clear = marked.filter("rivals = 1").select(*kinds.names)
    return clear.unionByName(marked.filter("rivals > 1").select(*kinds.names).groupBy("a", "b").applyInPandas(run, kinds))


def union_type(root: str, masks: dict[str, int]) -> T.DataType:
    """The Spark type that holds the values at a path in every file. Structs hold their members by name; what is no join of
    numbers, one struct or one list becomes text."""
    mask = masks.get(root, 0)
    if mask == STRUCT:
        return struct_type(root, masks)
    if mask == LIST:
        return T.ArrayType(union_type(root + SEP + ELEMENT, masks))
    if mask == BOOLEAN:
        return T.BooleanType()
    if mask == INT64:
        return T.LongType()
    if mask and not mask & ~(INT64 | FLOAT64 | EXPONENT):
        return T.DoubleType()
    return T.StringType()


def struct_type(root: str, masks: dict[str, int]) -> T.DataType:
    names = sorted({p[len(root) + 1:] for p in masks if p.startswith(root + SEP)} - {ELEMENT})
    names = [n for n in names if SEP not in n]
    if not names:
        return T.StringType()  # a struct without members isn't a type that files can hold: its text
    return T.StructType([T.StructField(n, union_type(root + SEP + n, masks)) for n in names])


def _distinct_names(kind: T.DataType) -> T.DataType:
    """Names that differ by case alone get a number, as most readers of the table don't tell them apart."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_distinct_names(kind.elementType))
    if not isinstance(kind, T.StructType):
        return kind
    used: dict[str, int] = defaultdict(int)
    fields = []
    for f in kind.fields:
        used[f.name.lower()] += 1
        again = used[f.name.lower()]
        fields.append(T.StructField(f.name if again == 1 else f"{f.name}__{again}", _distinct_names(f.dataType)))
    return T.StructType(fields)


def unified(df: DataFrame, file: tuple[str, str] = ("feed", "file_no"), line: str = "line", position: str = "line_no",
            envelope: tuple[tuple[str, str], ...] = (("event_id", "bigint"), ("org_id", "bigint")), root: str = "payload") -> DataFrame:
    """All files as one table: ``file``, ``position``, the envelope and one ``payload`` struct of the union schema.

    The schema is the join of all headers: a driver-side fold over distinct paths, of which there are as many as the
    schema is wide, not as many as there are files. Defined results: a line that is null or no JSON object keeps its place with a
    null payload; missing members are null; if no file has a member, payload is a string and null.
    """
    first, number = file
    outside = tuple(n for n, _ in envelope)
    heads = headers(df, file, line, outside, root)
    paths = heads.select(F.explode("paths").alias("path", "mask")).groupBy("path").agg(F.bit_or("mask").alias("mask")).collect()
    masks = {r["path"]: r["mask"] for r in paths if r["path"]}
    kind = struct_type(root, masks)
    whole = T.StructType([T.StructField(n, T.StringType()) for n in outside])
    text = F.col("__line")
    base = df.select(F.col(first), F.col(number), F.col(position), F.col(line).alias("__line"))
    members = F.from_json(text, kind) if isinstance(kind, T.StructType) else F.lit(None).cast("string")
    out = base.withColumn("__env", F.from_json(text, whole)).withColumn(root, members)
    if isinstance(kind, T.StructType):
        out = out.withColumn(root, F.col(root).cast(_distinct_names(kind)))
    return out.select(first, number, position, *[F.col("__env")[n].try_cast(t).alias(n) for n, t in envelope], root)


def _renames(old: DataFrame, new: DataFrame, pairs: list[tuple], event_id: str) -> list[tuple]:
    """Of pairs (old path, new path) those with equal values: at least two events have values at both, and all agree. Both tables are
    combined per event before they are joined."""
    def side(df: DataFrame, name: str, paths: list[tuple]) -> DataFrame:
        at = [reduce(lambda c, part: c[part], p[1:], F.col(p[0])) for p in paths]
        return df.filter(F.col(event_id).isNotNull()).groupBy(F.col(event_id).alias("e")).agg(*[f(c).alias(f"{name}{end}{k}") for k, c in enumerate(at) for f, end in ((F.min, "lo"), (F.max, "hi"))])

    before, after = sorted({p for p, _ in pairs}), sorted({q for _, q in pairs})
    both, found = side(old, "p", before).join(side(new, "q", after), "e"), []
    for k, (p, q) in enumerate(pairs):
        i, j = before.index(p), after.index(q)
        lo, hi, new_lo, new_hi = (F.col(c) for c in (f"plo{i}", f"phi{i}", f"qlo{j}", f"qhi{j}"))
        has = lo.isNotNull() & new_lo.isNotNull()
        found += [F.count_if(has).alias(f"n{k}"), F.min(F.when(has, (lo == hi) & (new_lo == new_hi) & (lo == new_lo))).alias(f"equal{k}")]
    row = both.agg(*found).first()
    return [pair for k, pair in enumerate(pairs) if row[f"n{k}"] >= 2 and row[f"equal{k}"]]


def schema_changes(tables: list[tuple[str, DataFrame]], root: str = "payload", event_id: str = "event_id") -> DataFrame:
    """(``file``, ``step``, ``change_kind``, ``field_path``, ``old_type``, ``new_type``): the ordered differences of each typed table's schema from
    the one before it. A path that went and one that came under the same parent and with the same type are one ``renamed``, its ``field_path``
    ``old -> new``, where at least two events of both tables have values at both and all are equal."""
    from lamina.plans.types import from_spark
    from lamina.plans.widening import shown

    def name(kind: T.DataType) -> str:
        if isinstance(kind, T.ArrayType):
            return f"List({name(kind.elementType)})"
        return "Struct" if isinstance(kind, T.StructType) else shown(from_spark(kind))

    def walk(path: tuple, old: T.DataType, new: T.DataType) -> Iterator[tuple]:
        if isinstance(old, T.StructType) and isinstance(new, T.StructType):
            for f in old.fields:
                if f.name in new.names:
                    yield from walk((*path, f.name), f.dataType, new[f.name].dataType)
                else:
                    yield "removed", (*path, f.name), name(f.dataType), "", f.dataType
            for f in new.fields:
                if f.name not in old.names:
                    yield "added", (*path, f.name), "", name(f.dataType), f.dataType
        elif name(old) != name(new):
            yield "retyped", path, name(old), name(new), new

    rows = []
    for (_, old), (file, new) in zip(tables, tables[1:]):
        changes = list(walk((root,), old.schema[root].dataType, new.schema[root].dataType))
        gone, come = ([c for c in changes if c[0] == kind] for kind in ("removed", "added"))
        pairs = [(p[1], q[1]) for p in gone for q in come if p[1][:-1] == q[1][:-1] and p[4].simpleString() == q[4].simpleString()]
        renamed = _renames(old, new, pairs, event_id) if pairs else []
        moved = {("removed", p) for p, _ in renamed} | {("added", q) for _, q in renamed}
        step = 0
        for kind, path, before, after, _ in changes:
            listed = [("renamed", f"{'.'.join(path)} -> {'.'.join(q)}", before, before) for p, q in renamed if kind == "removed" and p == path]
            for change in listed or ([] if (kind, path) in moved else [(kind, ".".join(path), before, after)]):
                step += 1
                rows.append((file, step, *change))
    spark = tables[0][1].sparkSession
    return spark.createDataFrame(rows, "file string, step int, change_kind string, field_path string, old_type string, new_type string")
