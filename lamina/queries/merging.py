"""Queries of the merges of drifting schemas and their SQL. Drift is made by projecting the tables; every row takes part."""

from __future__ import annotations

import json
import pathlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import derive, merge, validate
from lamina.operators.position import with_position
from lamina.plans.options import ColumnOptions, Compression, Encoding, ExecutionOptions, MergeOrder, NdjsonOptions, NumericMode, StringMode, TopLevelOptions, WideningOptions
from lamina.plans.widening import shown
from lamina.session import fresh_path, table
from lamina.sources import footers, ndjson, sink

PAYLOADS = ("payload_left", "payload_right", "payload_mixed")


def _parity(df: DataFrame, key: str, k: int, *columns: str, parts: int = 2) -> DataFrame:
    return df.filter(F.pmod(key, F.lit(parts)) == k).selectExpr(*columns)


def _frames(sources: list[DataFrame], contract) -> DataFrame:
    return merge.merge_frames([(s, None) for s in sources], contract).frame


def top_level_union_pragmatic(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    left = _parity(o, "o_orderkey", 0, "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    right = _parity(o, "o_orderkey", 1, "o_totalprice", "o_orderkey", "cast(o_custkey as double) as o_custkey", "o_orderpriority")
    return _frames([left, right], merge.top_level())


def top_level_union_exact_safe(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    left = _parity(c, "c_custkey", 0, "c_custkey", "c_nationkey", "c_name")
    right = _parity(c, "c_custkey", 1, "cast(c_nationkey as bigint) as c_nationkey", "c_custkey", "c_acctbal")
    return _frames([left, right], merge.top_level(TopLevelOptions(NumericMode.EXACT_SAFE)))


def top_level_null_fill(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return _frames([_parity(p, "p_partkey", 0, "p_partkey", "p_name", "p_brand"), _parity(p, "p_partkey", 1, "p_type", "p_partkey", "p_size"), _parity(p, "p_partkey", 1, "p_partkey", "p_retailprice")], merge.top_level())


def interleaved_union(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return _frames([_parity(s, "s_suppkey", k, *c, parts=3) for k, c in enumerate((("s_suppkey", "s_name"), ("s_name", "s_suppkey", "s_nationkey"), ("s_suppkey", "s_acctbal")))], merge.top_level())


def null_type_absorb(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return _frames([_parity(s, "s_suppkey", 0, "s_suppkey", "null as s_acctbal"), _parity(s, "s_suppkey", 1, "s_suppkey", "s_acctbal")], merge.top_level())


def schema_union_nested(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    left = _parity(li, "l_orderkey", 0, "l_orderkey", "l_linenumber", "named_struct('qty', cast(l_quantity as int), 'flag', named_struct('ret', l_returnflag)) as detail")
    right = _parity(li, "l_orderkey", 1, "named_struct('flag', named_struct('status', l_linestatus), 'qty', l_quantity, 'tax', l_tax) as detail", "l_linenumber", "l_orderkey", "l_discount")
    out = _frames([left, right], merge.generic())
    return out.select("l_orderkey", "l_linenumber", F.col("detail.qty").alias("qty"), F.col("detail.flag.ret").alias("ret"), F.col("detail.flag.status").alias("status"), F.col("detail.tax").alias("tax"), "l_discount")


def string_fallback(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    left = _parity(o, "o_orderkey", 0, "o_orderkey", "o_custkey as code", "o_orderkey % 4 = 0 as mark")
    right = _parity(o, "o_orderkey", 1, "o_orderkey", "o_orderpriority as code", "o_orderstatus as mark")
    return _frames([left, right], merge.generic(WideningOptions(strings=StringMode.PRIMITIVE_TO_STRING)))


def _payloads(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return _frames([table(spark, d, n) for n in names], merge.payload())


def _number(c: Column, name: str) -> list[Column]:
    """A double in two columns, as NaN is no value that two engines compare alike."""
    return [F.when(~F.isnan(c), c).alias(name), F.coalesce(F.isnan(c), F.lit(False)).alias(f"{name}_is_nan")]


def payload_union_nested(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("payload")
    return _payloads(spark, d, *PAYLOADS).select(
        "event_id", "org_id", "event_date", p.isNull().alias("no_payload"), *_number(p["score"], "score"), p["profile"].isNull().alias("no_profile"), p["profile"]["name"].alias("name"),
        p["profile"]["tier"].alias("tier"), p["profile"]["segment"].alias("segment"), F.size(p["scores"]).alias("n_scores"), p["amount"].alias("amount"))


def p2_payload_table(spark: SparkSession, d: str) -> DataFrame:
    """The three payload tables as one, a row for each element of ``payload.scores`` and one where there are none: what has become of every value
    of the fields that drift. ``p2_payload_whole`` has the same table with the payload as it is."""
    p = F.col("payload")
    rows = _payloads(spark, d, *PAYLOADS).select("event_id", "org_id", "event_date", p["score"].alias("s"), p["profile"].alias("f"), p["amount"].alias("amount"), p["scores"].isNull().alias("no_scores"), F.posexplode_outer(p["scores"]).alias("place", "e"))
    f = F.col("f")
    return rows.select("event_id", "org_id", "event_date", *_number(F.col("s"), "score"), f["name"].alias("name"), f["tier"].alias("tier"), f["segment"].alias("segment"), "amount", "no_scores", "place", *_number(F.col("e"), "element"))


def p2_payload_whole(spark: SparkSession, d: str) -> DataFrame:
    """The three payload tables as one, under the join of their schemas, with the payload as it is: lists with their elements."""
    return _payloads(spark, d, *PAYLOADS).select("event_id", "org_id", "event_date", "payload")


def payload_list_widen(spark: SparkSession, d: str) -> DataFrame:
    return _payloads(spark, d, "payload_left", "payload_right").select("event_id", F.posexplode("payload.scores").alias("place", "element"))


def payload_sum_nested(spark: SparkSession, d: str) -> DataFrame:
    """Sum and count of a nested field that Int32 and Float64 files share. In whole 1024ths, without NaN and values beyond 10^9, so that the sum
    doesn't depend on the order of rows."""
    _payloads(spark, d, *PAYLOADS).createOrReplaceTempView("merged_payload")
    return spark.sql("""SELECT sum(CASE WHEN abs(payload['score']) < 1e9 THEN CAST(floor(payload['score'] * 1024) AS BIGINT) END) AS total, count(payload['score']) AS n, count_if(isnan(payload['score'])) AS n_nan,
      count(*) AS n_rows FROM merged_payload""")


def payload_project_nested(spark: SparkSession, d: str) -> DataFrame:
    _payloads(spark, d, *PAYLOADS).createOrReplaceTempView("merged_projection")
    return spark.sql("SELECT event_id, payload['profile']['name'] AS name, payload['profile']['tier'] AS tier, payload['profile']['segment'] AS segment FROM merged_projection ORDER BY event_id")


def _files(df: DataFrame) -> list[str]:
    """The files that a frame is read from, by name."""
    return sorted(df.inputFiles())


def _parts(spark: SparkSession, frames: list[DataFrame], key: str) -> list[str]:
    """Each frame as one file in the order of its key: the inputs of a merge of files."""
    paths = []
    for df in frames:
        path = fresh_path(spark, "part")
        df.repartitionByRange(1, key).sortWithinPartitions(key).write.parquet(path)
        paths += _files(spark.read.parquet(path))
    return paths


def _placed(spark: SparkSession, report: sink.Report) -> DataFrame:
    """What a merge has written, with each row's place over all files in the order of their names."""
    rows = spark.read.parquet(*report.output_files).withColumns({"__file": F.col("_metadata.file_path"), merge.ROW: F.col("_metadata.row_index")})
    return with_position(merge.numbered(rows, report.output_files).drop("__file").orderBy(merge.SOURCE, merge.ROW)).drop(merge.SOURCE, merge.ROW)


def _order_files(spark: SparkSession, d: str) -> list[str]:
    o = table(spark, d, "orders")
    return _parts(spark, [_parity(o, "o_orderkey", 1, "o_totalprice", "o_orderkey", "cast(o_custkey as double) as o_custkey"), _parity(o, "o_orderkey", 0, "o_orderkey", "o_custkey", "o_orderstatus")], "o_orderkey")


def files_top_level(spark: SparkSession, d: str) -> DataFrame:
    """Files under the top-level contract, in the order of files and rows, as a folder."""
    report = sink.merge_top_level_parquet_files(spark, _order_files(spark, d), fresh_path(spark, "merged"), single_file=False)
    return _placed(spark, report).select("pos", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def files_top_level_single(spark: SparkSession, d: str) -> DataFrame:
    """The same as one file."""
    report = sink.merge_top_level_parquet_files(spark, _order_files(spark, d), fresh_path(spark, "merged") + ".parquet")
    return _placed(spark, report).select("pos", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def files_interleaved(spark: SparkSession, d: str) -> DataFrame:
    """The same rows in any order."""
    execution = ExecutionOptions(unordered_merge_order=MergeOrder.ALLOW_INTERLEAVED, writer_compression=Compression("zstd", 3))
    report = sink.merge_top_level_parquet_files(spark, _order_files(spark, d), fresh_path(spark, "merged"), execution=execution, single_file=False)
    return spark.read.parquet(*report.output_files)


def files_payload(spark: SparkSession, d: str) -> DataFrame:
    """The files of the three payload tables in order, merged by ``event_id``, with whether the output is sorted."""
    paths = [f for n in PAYLOADS for f in _files(table(spark, d, n))]
    report = sink.merge_payload_parquet_files(spark, paths, folder := fresh_path(spark, "merged"), execution=ExecutionOptions(ordering_field="event_id"), single_file=False)
    sound = validate.out_of_order(spark, folder, "event_id").isEmpty()
    p = F.col("payload")
    return spark.read.parquet(*report.output_files).select("event_id", "org_id", *_number(p["score"], "score"), p["profile"]["tier"].alias("tier"), F.size(p["scores"]).alias("n_scores"), p["amount"].alias("amount"), F.lit(sound).alias("in_order"))


def files_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Sorted files of drifting schemas, of which two follow each other and two overlap: every row has its place."""
    e = table(spark, d, "events").selectExpr("event_id", "user_id", "event_type", "value")
    left, right = "named_struct('score', user_id, 'kind', event_type) as payload", "named_struct('score', value) as payload"
    third = e.agg((F.max("event_id") / 3).cast("bigint")).first()[0]
    frames = [e.filter(F.col("event_id") > 2 * third).selectExpr("event_id", left), e.filter(F.col("event_id") <= third).selectExpr("event_id", right),
              *[e.filter((F.col("event_id") > third) & (F.col("event_id") <= 2 * third) & (F.pmod("event_id", F.lit(2)) == k)).selectExpr("event_id", (left, right)[k]) for k in range(2)]]
    report = sink.merge_payload_parquet_files(spark, _parts(spark, frames, "event_id"), fresh_path(spark, "merged"), execution=ExecutionOptions(ordering_field="event_id"), single_file=False)
    p = F.col("payload")
    return _placed(spark, report).select("pos", "event_id", *_number(p["score"], "score"), p["kind"].alias("kind"))


def files_report(spark: SparkSession, d: str) -> DataFrame:
    """What a merge of three files with two schemas reports."""
    s = table(spark, d, "supplier")
    paths = _parts(spark, [_parity(s, "s_suppkey", k, "s_suppkey", "s_name" if k != 1 else "s_acctbal", parts=3) for k in range(3)], "s_suppkey")
    report = sink.merge_top_level_parquet_files(spark, paths, fresh_path(spark, "merged"), single_file=False)
    return spark.createDataFrame([(report.rows, report.adapter_cache_misses, report.adapter_cache_hits, report.input_bytes > 0 and report.output_bytes > 0)], "n_rows long, misses int, hits int, sized boolean")


def files_writer_options(spark: SparkSession, d: str) -> DataFrame:
    """Codec and encodings of every column as the options ask, and the rows that come back."""
    columns = (ColumnOptions(("o_orderkey",), encoding=Encoding.DELTA_BINARY_PACKED), ColumnOptions(("o_totalprice",), encoding=Encoding.BYTE_STREAM_SPLIT, compression=Compression("zstd", 1)), ColumnOptions(("o_orderstatus",), dictionary_enabled=False))
    execution = ExecutionOptions(writer_compression=Compression("snappy"), writer_column_options=columns, writer_version=2, writer_data_page_row_count_limit=1000, output_row_group_rows=5000)
    report = sink.merge_top_level_parquet_files(spark, _order_files(spark, d), fresh_path(spark, "merged"), execution=execution, single_file=False)
    chunks = footers.layout(spark, report.output_files)
    has = lambda word: F.max(F.contains("encodings", F.lit(word)))
    return chunks.groupBy("column_path").agg(F.min("codec").alias("codec"), has("DELTA_BINARY_PACKED").alias("packed"), has("BYTE_STREAM_SPLIT").alias("split"), has("DICTIONARY").alias("dictionary"), F.sum("num_values").alias("num_values"), (F.max("rows") <= 5000).alias("small_groups"))


def ndjson_files(spark: SparkSession, d: str) -> DataFrame:
    """NDJSON files with a field that holds numbers, texts and truth values, compacted to Parquet as text."""
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct("event_id", F.col("user_id").alias("v")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("v"), "event_id"))).otherwise(F.to_json(F.struct("event_id", (F.col("user_id") % 2 == 0).alias("v"))))
    path = fresh_path(spark, "lines")
    e.select(line.alias("line")).write.text(path)
    options = NdjsonOptions(("event_id",), widening=WideningOptions(strings=StringMode.PRIMITIVE_TO_STRING))
    report = sink.compact_ndjson_to_parquet(spark, _files(spark.read.text(path)), fresh_path(spark, "compacted"), options, single_file=False)
    return spark.read.parquet(*report.output_files).select("event_id", F.col("payload.v").alias("v"))


def _ordered(spark: SparkSession, d: str, key: str, kind: pa.DataType) -> DataFrame:
    """``events`` in three sources, merged in the order of an expression; ties go by source, then by place, which is ``event_id`` here."""
    e = table(spark, d, "events")
    sources = [_parity(e, "event_id", k, "event_id", f"{key} as k", f"{k} as {merge.SOURCE}", f"event_id as {merge.ROW}", parts=3) for k in range(3)]
    merged = merge.merge_frames([(s, None) for s in sources], merge.generic(), (merge.SOURCE, merge.ROW))
    return with_position(merge.ordered(merged.frame, "k", kind)).select("pos", "event_id", "k")


ORDERINGS = {
    "ordered_merge_int64": ("event_id", pa.int64()), "ordered_merge_ties": ("user_id", pa.int64()), "ordered_merge_nulls_last": ("nullif(user_id, 7)", pa.int64()), "ordered_merge_string": ("event_type", pa.string()),
    "ordered_merge_timestamp": ("ts", pa.timestamp("us")), "ordered_merge_date": ("cast(ts as date)", pa.date32()), "ordered_merge_float": ("value", pa.float64()),
}


def ordered_sortedness_check(spark: SparkSession, d: str) -> DataFrame:
    # Three sources of consecutive events; their places in the sources count from the first.
    e = table(spark, d, "events").select("value", F.pmod("event_id", F.lit(3)).cast("int").alias(merge.SOURCE), F.expr("event_id div 3").alias(merge.ROW))
    bad = merge.disorder(e.repartition(merge.SOURCE).sortWithinPartitions(merge.SOURCE, merge.ROW), "value")
    return bad.groupBy(F.col(merge.SOURCE).alias("source")).agg(F.count(F.lit(1)).alias("violations"), F.min(merge.ROW).alias("first_row"))


def _event_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("kind"), F.col("user_id").alias("score"), F.struct(F.col("event_type").alias("name")).alias("profile"))))
    line = line.otherwise(F.to_json(F.struct(F.col("value").alias("score"), F.struct(F.col("user_id").alias("tier")).alias("profile"), "event_id", F.array("user_id", "event_id").alias("scores"))))
    # Both kinds of lines become files in the shared folder, in the order of the events, and are read as any others.
    paths = []
    for k in range(2):
        path = fresh_path(spark, f"event-lines-{k}")
        e.filter(F.pmod("event_id", F.lit(2)) == k).orderBy("event_id").select(line.alias("line")).write.text(path)
        paths += sorted(map(str, pathlib.Path(path.replace("file://", "").replace("file:", "")).glob("*.txt")))
    return ndjson.lines(spark, paths)


def ndjson_compact(spark: SparkSession, d: str) -> DataFrame:
    out, _ = ndjson.read(_event_lines(spark, d), NdjsonOptions(("event_id", "user_id")))
    p = F.col("payload")
    return out.select("event_id", "user_id", p["kind"].alias("kind"), p["score"].alias("score"), p["profile"]["name"].alias("name"), p["profile"]["tier"].alias("tier"), F.element_at(p["scores"], 1).alias("first_score"))


def ndjson_compact_sorted(spark: SparkSession, d: str) -> DataFrame:
    out, _ = ndjson.read(_event_lines(spark, d), NdjsonOptions(("event_id", "user_id"), sort_field="user_id"))
    return with_position(out).select("pos", "event_id", "user_id")


def _fields(prefix: str, fields) -> list[tuple[str, str, bool]]:
    out = []
    for f in fields:
        name = f"{prefix}{f.name}"
        nested = pa.types.is_struct(f.type)
        out.append((name, "Struct" if nested else "List" if pa.types.is_list(f.type) else shown(f.type), f.nullable))
        if nested:
            out += _fields(f"{name}.", f.type)
        if pa.types.is_list(f.type):
            out.append((f"{name}[]", shown(f.type.value_type), f.type.value_field.nullable))
    return out


def ndjson_discovered_schema(spark: SparkSession, d: str) -> DataFrame:
    found = ndjson.discover_lines(_event_lines(spark, d), NdjsonOptions(("event_id", "user_id")))
    return spark.createDataFrame(_fields("", found.schema), "path string, type string, nullable boolean")


def multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return validate.multiset_diff(li.select("l_partkey", "l_returnflag"), li.select((F.col("l_partkey") + 1).alias("l_partkey"), "l_linestatus"))


def partition_columns(spark: SparkSession, d: str) -> DataFrame:
    out = derive.partition_columns(table(spark, d, "event_log"), "timestamp", "org_id", "country")
    s = F.col("partition_struct")
    return out.select("event_id", "received_at", F.col("partition_date").cast("timestamp_ntz").alias("partition_date"), "org_tier", "partition_country", s["year"].alias("year"), s["month"].alias("month"), s["day"].alias("day"), derive.render(s["org_tier"]).alias("tier_text"))


def metadata_layout(spark: SparkSession, d: str) -> DataFrame:
    """Column chunks of the files of a table, by column and codec."""
    chunks = footers.layout(spark, _files(table(spark, d, "payload_right")))
    return footers.layout_summary(chunks).groupBy("column_path", "codec").agg(F.sum("chunks").alias("chunks"), F.sum("num_values").alias("num_values"), F.sum("compressed_bytes").alias("compressed_bytes"), F.sum("uncompressed_bytes").alias("uncompressed_bytes"))


def p2_payload_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changes in the payload from each of the three tables to the next."""
    from lamina.operators.drift import schema_changes

    return schema_changes([(n, table(spark, d, n)) for n in PAYLOADS])


def _named(name: str, key: str, kind: pa.DataType):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _ordered(spark, d, key, kind)

    query.__name__ = name
    return query


QUERIES = {f.__name__: f for f in (
    top_level_union_pragmatic, top_level_union_exact_safe, top_level_null_fill, interleaved_union, null_type_absorb, schema_union_nested, string_fallback, payload_union_nested, payload_list_widen,
    payload_sum_nested, payload_project_nested, *(_named(n, *x) for n, x in ORDERINGS.items()), ordered_sortedness_check, ndjson_compact, ndjson_compact_sorted, ndjson_discovered_schema,
    files_top_level, files_top_level_single, files_interleaved, files_payload, files_ordered, files_report, files_writer_options, ndjson_files, multiset_diff, partition_columns, metadata_layout, p2_payload_changes, p2_payload_table, p2_payload_whole,
)}

_DISCOVERED = [
    ("event_id", "Int64", False), ("user_id", "Int64", True), ("payload", "Struct", True), ("payload.kind", "Utf8", True), ("payload.profile", "Struct", False), ("payload.profile.name", "Utf8", True),
    ("payload.profile.tier", "Int64", True), ("payload.score", "Float64", False), ("payload.scores", "List", True), ("payload.scores[]", "Int64", False),
]
_CHANGES = [
    ("payload_right", 1, "retyped", "payload.score", "Int32", "Float64"), ("payload_right", 2, "removed", "payload.profile.name", "Utf8", ""), ("payload_right", 3, "added", "payload.profile.tier", "", "Utf8"),
    ("payload_right", 4, "retyped", "payload.scores", "List(Int32)", "List(Float64)"), ("payload_right", 5, "added", "payload.amount", "", "Int32"), ("payload_mixed", 1, "retyped", "payload.score", "Float64", "Int32"),
    ("payload_mixed", 2, "removed", "payload.profile.tier", "Utf8", ""), ("payload_mixed", 3, "added", "payload.profile.segment", "", "Utf8"), ("payload_mixed", 4, "removed", "payload.scores", "List(Float64)", ""),
]


def _values(rows: list[tuple], names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(json.dumps(v).replace('"', "'") if not isinstance(v, bool) else str(v).lower() for v in r) + ")" for r in rows) + f") AS t({names})"


def _order_sql(key: str) -> str:
    order = "CASE WHEN isnan(k) THEN 1 ELSE 0 END, k" if key == "value" else "k"
    return f'WITH s AS (SELECT event_id, {key} AS k, event_id % 3 AS src FROM events) SELECT row_number() OVER (ORDER BY (k IS NULL), {order}, src, event_id) AS pos, event_id, k FROM s'


_PAYLOADS = """
p AS (SELECT event_id, org_id, event_date, payload IS NULL AS no_payload, payload.score::DOUBLE AS s, payload.profile IS NULL AS no_profile, payload.profile.name AS name, NULL::VARCHAR AS tier, NULL::VARCHAR AS segment, payload.scores::DOUBLE[] AS l, NULL::INTEGER AS amount FROM payload_left
UNION ALL SELECT event_id, org_id, event_date, payload IS NULL, payload.score, payload.profile IS NULL, NULL, payload.profile.tier, NULL, payload.scores, payload.amount FROM payload_right
UNION ALL SELECT event_id, org_id, event_date, payload IS NULL, payload.score::DOUBLE, payload.profile IS NULL, NULL, NULL, payload.profile.segment, NULL, payload.amount FROM payload_mixed)
"""
_SCORE = "CASE WHEN NOT isnan(s) THEN s END AS score, coalesce(isnan(s), FALSE) AS score_is_nan"
_PAYLOAD_SQL = f"WITH {_PAYLOADS} SELECT event_id, org_id, event_date, no_payload, {_SCORE}, no_profile, name, tier, segment, len(l)::INTEGER AS n_scores, amount FROM p"
_ORDERS = "SELECT row_number() OVER (ORDER BY o_orderkey % 2 DESC, o_orderkey) AS pos, o_orderkey, o_custkey::DOUBLE AS o_custkey, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders"
SQL = {
    "top_level_union_pragmatic": "SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, o_orderstatus, o_totalprice, NULL::VARCHAR AS o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey::DOUBLE, NULL, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1",
    "top_level_union_exact_safe": "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_name, NULL::DOUBLE AS c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_nationkey::BIGINT, NULL, c_acctbal FROM customer WHERE c_custkey % 2 = 1",
    "top_level_null_fill": "SELECT p_partkey, p_name, p_brand, NULL::VARCHAR AS p_type, NULL::INTEGER AS p_size, NULL::DOUBLE AS p_retailprice FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, NULL, NULL, p_type, p_size, NULL FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, p_retailprice FROM part WHERE p_partkey % 2 = 1",
    "interleaved_union": "SELECT s_suppkey, s_name, NULL::INTEGER AS s_nationkey, NULL::DOUBLE AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT s_suppkey, NULL, NULL, s_acctbal FROM supplier WHERE s_suppkey % 3 = 2",
    "null_type_absorb": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal END AS s_acctbal FROM supplier",
    "schema_union_nested": "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN trunc(l_quantity) ELSE l_quantity END AS qty, CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag END AS ret, CASE WHEN l_orderkey % 2 = 1 THEN l_linestatus END AS status, CASE WHEN l_orderkey % 2 = 1 THEN l_tax END AS tax, CASE WHEN l_orderkey % 2 = 1 THEN l_discount END AS l_discount FROM lineitem",
    "string_fallback": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE o_orderpriority END AS code, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 4 = 0)::VARCHAR ELSE o_orderstatus END AS mark FROM orders",
    "payload_union_nested": _PAYLOAD_SQL,
    "payload_list_widen": "WITH u AS (SELECT event_id, payload.scores::DOUBLE[] AS s FROM payload_left UNION ALL SELECT event_id, payload.scores FROM payload_right), x AS (SELECT event_id, s, unnest(range(0, len(s))) AS place FROM u) SELECT event_id, place::INTEGER AS place, s[place + 1] AS element FROM x",
    "payload_sum_nested": f"WITH {_PAYLOADS} SELECT sum(CASE WHEN NOT isnan(s) AND abs(s) < 1e9 THEN floor(s * 1024)::BIGINT END)::BIGINT AS total, count(s) AS n, count(CASE WHEN isnan(s) THEN 1 END) AS n_nan, count(*) AS n_rows FROM p",
    "payload_project_nested": f"WITH {_PAYLOADS} SELECT event_id, name, tier, segment FROM p",
    "files_top_level": _ORDERS,
    "files_top_level_single": _ORDERS,
    "files_interleaved": f"SELECT o_totalprice, o_orderkey, o_custkey, o_orderstatus FROM ({_ORDERS})",
    "files_payload": f"WITH {_PAYLOADS} SELECT event_id, org_id, {_SCORE}, tier, len(l)::INTEGER AS n_scores, amount, TRUE AS in_order FROM p",
    "files_ordered": """WITH t AS (SELECT *, max(event_id) OVER () // 3 AS third FROM events), m AS (SELECT event_id, event_id > 2 * third OR (event_id > third AND event_id % 2 = 0) AS l, user_id, value, event_type FROM t),
      s AS (SELECT event_id, CASE WHEN l THEN user_id::DOUBLE ELSE value END AS s, CASE WHEN l THEN event_type END AS kind FROM m)
      SELECT row_number() OVER (ORDER BY event_id) AS pos, event_id, CASE WHEN NOT isnan(s) THEN s END AS score, coalesce(isnan(s), FALSE) AS score_is_nan, kind FROM s""",
    "files_report": "SELECT count(*) AS n_rows, 2::INTEGER AS misses, 1::INTEGER AS hits, TRUE AS sized FROM supplier",
    "files_writer_options": """SELECT column_path, CASE WHEN column_path = 'o_totalprice' THEN 'ZSTD' ELSE 'SNAPPY' END AS codec, column_path = 'o_orderkey' AS packed, column_path = 'o_totalprice' AS split, column_path = 'o_custkey' AS dictionary, (SELECT count(*) FROM orders) AS num_values, TRUE AS small_groups
      FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice'), ('o_orderstatus')) AS c(column_path)""",
    "ndjson_files": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN event_type ELSE (user_id % 2 = 0)::VARCHAR END AS v FROM events",
    "metadata_layout": "SELECT replace(path_in_schema, ', ', '.') AS column_path, CASE compression WHEN 'LZ4_RAW' THEN 'LZ4' ELSE compression END AS codec, count(*) AS chunks, sum(num_values)::BIGINT AS num_values, sum(total_compressed_size)::BIGINT AS compressed_bytes, sum(total_uncompressed_size)::BIGINT AS uncompressed_bytes FROM parquet_metadata('/root/testdata/sf0.01/payload_right.parquet') GROUP BY ALL",
    **{n: _order_sql(k.replace("cast(ts as date)", "ts::DATE")) for n, (k, _) in ORDERINGS.items()},
    "ordered_sortedness_check": "WITH s AS (SELECT (event_id % 3)::INTEGER AS source, event_id, value, lag(value) OVER w AS p, lag(event_id) OVER w AS q FROM events WINDOW w AS (PARTITION BY event_id % 3 ORDER BY event_id)) SELECT source, count(*) AS violations, min(event_id // 3) AS first_row FROM s WHERE q IS NOT NULL AND ((p IS NULL AND value IS NOT NULL) OR p > value) GROUP BY source",
    "ndjson_compact": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS user_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind, CASE WHEN event_id % 2 = 0 THEN user_id::DOUBLE ELSE value END AS score, CASE WHEN event_id % 2 = 0 THEN event_type END AS name, CASE WHEN event_id % 2 = 1 THEN user_id END AS tier, CASE WHEN event_id % 2 = 1 THEN user_id END AS first_score FROM events",
    "ndjson_compact_sorted": "WITH s AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id END AS user_id FROM events) SELECT row_number() OVER (ORDER BY (user_id IS NULL), user_id, event_id % 2, event_id) AS pos, event_id, user_id FROM s",
    "ndjson_discovered_schema": _values(_DISCOVERED, "path, type, nullable"),
    "multiset_diff": "WITH a AS (SELECT l_partkey, l_returnflag AS f FROM lineitem), b AS (SELECT l_partkey + 1 AS l_partkey, l_linestatus AS f FROM lineitem) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS right_only",
    "partition_columns": "SELECT event_id, received_at, date_trunc('day', \"timestamp\")::TIMESTAMP AS partition_date, CASE WHEN org_id < 200 THEN 'tier1' WHEN org_id < 300 THEN 'tier2' ELSE 'tier3' END AS org_tier, country AS partition_country, extract(year FROM \"timestamp\")::INTEGER AS year, extract(month FROM \"timestamp\")::INTEGER AS month, extract(day FROM \"timestamp\")::INTEGER AS day, CASE WHEN org_id < 200 THEN 'tier1' WHEN org_id < 300 THEN 'tier2' ELSE 'tier3' END AS tier_text FROM event_log",
    "p2_payload_table": f"""WITH {_PAYLOADS}, x AS (SELECT *, unnest(CASE WHEN len(l) > 0 THEN range(0, len(l)) ELSE [NULL::BIGINT] END) AS i FROM p), y AS (SELECT *, l[i + 1] AS e FROM x)
      SELECT event_id, org_id, event_date, {_SCORE}, name, tier, segment, amount, l IS NULL AS no_scores, i::INTEGER AS place, CASE WHEN NOT isnan(e) THEN e END AS element, coalesce(isnan(e), FALSE) AS element_is_nan FROM y""",
    "p2_payload_changes": _values(_CHANGES, "file, step, change_kind, field_path, old_type, new_type"),
}
