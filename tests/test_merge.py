import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lamina.operators import derive, merge, validate
from lamina.operators.adapt import PayloadPlan, adapt
from lamina.operators.position import with_position
from lamina.plans.options import ColumnOptions, Compression, Encoding, ExecutionOptions, MergeOrder, TopLevelOptions, resolved_parallelism
from lamina.sources import footers, sink

LEFT = pa.schema([pa.field("event_id", pa.int64(), False), pa.field("org_id", pa.int64(), False), ("payload", pa.struct([("score", pa.int32()), ("profile", pa.struct([("name", pa.string())])), ("scores", pa.list_(pa.int32()))]))])
RIGHT = pa.schema([pa.field("org_id", pa.int64(), False), pa.field("event_id", pa.int64(), False), ("payload", pa.struct([("score", pa.float64()), ("profile", pa.struct([("tier", pa.string())])), ("scores", pa.list_(pa.float64())), ("amount", pa.int32())]))])


def write(path, schema, rows, **how):
    pq.write_table(pa.Table.from_pylist(rows, schema), path, **how)
    return str(path)


def left(path, ids, orgs, **how):
    return write(path, LEFT, [{"event_id": e, "org_id": o, "payload": {"score": 1, "profile": {"name": "A"}, "scores": [1, None]}} for e, o in zip(ids, orgs)], **how)


def right(path, ids, orgs, **how):
    return write(path, RIGHT, [{"event_id": e, "org_id": o, "payload": {"score": 4.5, "profile": {"tier": "gold"}, "scores": [1.5], "amount": 7}} for e, o in zip(ids, orgs)], **how)


def test_top_level_files(spark, tmp_path):
    a, c = pa.schema([pa.field("event_id", pa.int32(), False), ("score", pa.int32()), ("name", pa.string())]), pa.schema([("score", pa.float64()), pa.field("event_id", pa.int32(), False), ("age", pa.int32())])
    paths = [
        write(tmp_path / "l 1.parquet", a, [{"event_id": 1, "score": 10, "name": "alice"}, {"event_id": 2, "score": None, "name": "bob"}, {"event_id": 3, "score": 30, "name": "carol"}]),
        write(tmp_path / "r.parquet", c, [{"event_id": 4, "score": 44.5, "age": 40}, {"event_id": 5, "score": 8.25, "age": None}]),
        write(tmp_path / "l2.parquet", a, [{"event_id": 6, "score": 11, "name": "dave"}, {"event_id": 7, "score": 12, "name": "erin"}]),
    ]
    out = str(tmp_path / "out.parquet")
    report = sink.merge_top_level_parquet_files(spark, paths, out, execution=ExecutionOptions(writer_compression=Compression("snappy")))
    rows = [tuple(r.values()) for r in pq.read_table(out).to_pylist()]  # in the order of files and rows
    assert pq.read_schema(out).names == ["event_id", "score", "name", "age"]
    assert rows == [(1, 10.0, "alice", None), (2, None, "bob", None), (3, 30.0, "carol", None), (4, 44.5, None, 40), (5, 8.25, None, None), (6, 11.0, "dave", None), (7, 12.0, "erin", None)]
    assert (report.rows, report.adapter_cache_misses, report.adapter_cache_hits) == (7, 2, 1) and report.input_bytes > 0 and report.output_bytes == os.path.getsize(out)
    sink.merge_top_level_parquet_files(spark, paths, out + "d", execution=ExecutionOptions(unordered_merge_order=MergeOrder.ALLOW_INTERLEAVED), single_file=False)
    assert sorted(tuple(r.values()) for r in pq.read_table(out + "d").to_pylist()) == rows
    with pytest.raises(ValueError, match="ordering_field"):
        sink.merge_top_level_parquet_files(spark, paths, out, TopLevelOptions(), ExecutionOptions(ordering_field="event_id"))
    with pytest.raises(ValueError, match="at least one"):
        sink.merge_top_level_parquet_files(spark, [], out)


def test_payload_files_and_sql(spark, tmp_path):
    paths = [left(tmp_path / "l.parquet", [1, 2], [10, 20]), right(tmp_path / "r.parquet", [3, 4], [30, 40])]
    merged = merge.merge_payload_files(spark, paths)
    payload = merged.schema.field("payload").type
    assert [f.name for f in payload] == ["score", "profile", "scores", "amount"] and payload.field("score").type == pa.float64()
    merged.frame.createOrReplaceTempView("m")
    assert spark.sql("SELECT sum(payload['score']) FROM m").first()[0] == 11.0
    assert [tuple(r) for r in spark.sql("SELECT event_id, payload['profile']['name'], payload['profile']['tier'] FROM m ORDER BY event_id").collect()] == [(1, "A", None), (2, "A", None), (3, None, "gold"), (4, None, "gold")]
    assert merged.frame.filter("event_id = 1").first()["payload"]["scores"] == [1.0, None]


def test_filters_and_pruned_columns_reach_every_scan(spark, tmp_path):
    paths = [left(tmp_path / "l.parquet", [1, 2], [10, 20]), right(tmp_path / "r.parquet", [3, 4], [30, 40])]
    plan = merge.merge_payload_files(spark, paths).frame.filter("event_id > 1").select("event_id", "payload.score")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThan(event_id,1)") == 2 and "scores" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_many_files_of_few_schemas_are_few_scans(spark, tmp_path):
    paths = [left(tmp_path / f"{k}.parquet", [k], [k]) for k in range(6)] + [right(tmp_path / f"r{k}.parquet", [k], [k]) for k in range(6)]
    merged = merge.merge_payload_files(spark, paths)
    assert merged.frame._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    assert (merged.misses, merged.hits) == (2, 10) and merged.frame.count() == 12


def test_null_parents_stay_null(spark):
    source = pa.schema([("p", pa.struct([("a", pa.int32())])), ("l", pa.list_(pa.struct([("x", pa.int32())])))])
    target = pa.schema([("p", pa.struct([("b", pa.string()), ("a", pa.float64())])), ("l", pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int32())]))), ("new", pa.int32())])
    df = spark.createDataFrame([(None, None), ((None,), [None, (1,)]), ((5,), [])], "p struct<a:int>, l array<struct<x:int>>")
    rows = [tuple(r) for r in adapt(df, source, target).collect()]
    assert rows[0] == (None, None, None) and rows[1][0] is not None and tuple(rows[1][0]) == (None, None) and rows[1][1][0] is None and tuple(rows[1][1][1]) == (1, None)
    assert tuple(rows[2][0]) == (None, 5.0) and rows[2][1] == []
    with pytest.raises(TypeError, match="unsupported coercion from Struct"):
        adapt(df, source, pa.schema([("p", pa.int32())]))


def test_plan_compiles_each_schema_once(spark):
    plan = PayloadPlan.of([LEFT, RIGHT])
    df = spark.createDataFrame([], "event_id long, org_id long, payload struct<score:int,profile:struct<name:string>,scores:array<int>>")
    for _ in range(3):
        assert plan.adapt(df, LEFT).columns == ["event_id", "org_id", "payload"]
    assert (plan.misses, plan.hits) == (1, 2)


@pytest.mark.parametrize("sources,want", [
    ([[(1, 10), (2, 20)], [(1, 30), (3, 40)]], [(1, 10), (1, 30), (2, 20), (3, 40)]),
    ([[(1, 10), (5, 50)], [(1, 30), (6, 60)], [(2, 20), (7, 70)], [(3, 40), (8, 80)]], [(1, 10), (1, 30), (2, 20), (3, 40), (5, 50), (6, 60), (7, 70), (8, 80)]),
    ([[(1, 0), (1, 1), (2, 2)], [(1, 10), (1, 11), (2, 12)], [(1, 20), (3, 21)]], [(1, 0), (1, 1), (1, 10), (1, 11), (1, 20), (2, 2), (2, 12), (3, 21)]),
])
def test_ordered_merge_breaks_ties_by_source_and_row(spark, tmp_path, sources, want):
    paths = [(left, right)[k % 2](tmp_path / f"{k}.parquet", *zip(*rows), row_group_size=1) for k, rows in enumerate(sources)]
    out = str(tmp_path / "out.parquet")
    sink.merge_payload_parquet_files(spark, paths, out, execution=ExecutionOptions(ordering_field="event_id"))
    assert [(r["event_id"], r["org_id"]) for r in pq.read_table(out).to_pylist()] == want


KEYS = [
    (pa.int64(), [1, 3], [2, 4]), (pa.uint64(), [1, 2**63 + 3], [2, 2**63 + 4]), (pa.float64(), [-0.0, 3.5], [0.0, float("nan")]), (pa.string(), ["a", "c"], ["b", "é"]), (pa.large_string(), ["a", "c"], ["b", "d"]),
    (pa.date32(), [dt.date(2020, 1, 1), dt.date(2020, 1, 3)], [dt.date(2020, 1, 2), None]), (pa.timestamp("ms"), [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 3)], [dt.datetime(2020, 1, 2), None]), (pa.timestamp("us", "UTC"), [dt.datetime(2020, 1, 1), None], [dt.datetime(2020, 1, 2), None]),
]


@pytest.mark.parametrize("kind,a,c", KEYS, ids=lambda k: str(k) if isinstance(k, pa.DataType) else "")
def test_order_keys(spark, tmp_path, kind, a, c):
    schema = pa.schema([("k", kind), ("n", pa.int64()), ("payload", pa.struct([("score", pa.int32())]))])
    paths = [write(tmp_path / f"{k}.parquet", schema, [{"k": v, "n": 10 * k + i, "payload": {"score": 1}} for i, v in enumerate(x)]) for k, x in enumerate((a, c))]
    rows = merge.merge_payload_files(spark, paths, ordering_field="k").frame.select("n").collect()
    assert [r["n"] for r in rows][:2] == [0, 10]
    assert [r["n"] for r in rows][2:] == [1, 11]


def test_bad_order(spark, tmp_path):
    unsorted, fine = left(tmp_path / "u.parquet", [2, 1], [1, 2]), left(tmp_path / "f.parquet", [1, 2], [1, 2])
    with pytest.raises(merge.NotSorted, match="is not sorted ascending by `event_id`"):
        merge.merge_payload_files(spark, [fine, unsorted], ordering_field="event_id")
    with pytest.raises(ValueError, match="missing from the merged schema"):
        merge.merge_payload_files(spark, [fine], ordering_field="nothing")
    with pytest.raises(ValueError, match="must reference a top-level envelope column"):
        merge.merge_payload_files(spark, [fine], ordering_field="payload")
    flags = write(tmp_path / "b.parquet", pa.schema([("is_active", pa.bool_()), ("payload", pa.struct([("s", pa.int32())]))]), [])
    with pytest.raises(ValueError, match="unsupported type Boolean"):
        merge.merge_payload_files(spark, [flags], ordering_field="is_active")


def group(source, n, begin, end, low, high):
    key = lambda x: x if isinstance(x, tuple) else (1, x)
    return footers.Group(source, n, begin, end, key(low), key(high))


def test_zones():
    null = footers.HIGHEST
    # Sources one after the other, whatever their order in the list, are one zone each.
    assert merge.zones([group(0, 0, 0, 5, 10, 19), group(0, 1, 5, 9, 20, 29), group(1, 0, 0, 4, 0, 9)]) == [(0, 0, 9, 1, True), (1, 0, 4, 0, True)]
    # Only the row groups that overlap are sorted.
    assert merge.zones([group(0, 0, 0, 5, 0, 9), group(0, 1, 5, 9, 10, 19), group(1, 0, 0, 4, 15, 25), group(1, 1, 4, 8, 26, 30)]) == [(0, 0, 5, 0, True), (0, 5, 9, 1, False), (1, 0, 4, 1, False), (1, 4, 8, 2, True)]
    # Equal ends go by source.
    assert [z[4] for z in merge.zones([group(0, 0, 0, 1, 1, 5), group(1, 0, 0, 1, 5, 6)])] == [True, True]
    assert [z[4] for z in merge.zones([group(0, 0, 0, 1, 5, 6), group(1, 0, 0, 1, 1, 5)])] == [False, False]
    # Nulls come last; what footers don't tell may lie anywhere.
    assert [z[4] for z in merge.zones([group(0, 0, 0, 1, 1, null), group(1, 0, 0, 1, 5, 6)])] == [False, False]
    assert [z[4] for z in merge.zones([group(0, 0, 0, 1, 1, 4), group(1, 0, 0, 1, 5, null), group(2, 0, 0, 1, null, null)])] == [True, True, True]
    assert [z[4] for z in merge.zones([group(0, 0, 0, 1, footers.LOWEST, null), group(1, 0, 0, 1, 5, 6)])] == [False, False]
    assert merge.zones([]) == []


def test_bounds_of_keys(tmp_path):
    path = write(tmp_path / "a.parquet", pa.schema([("i", pa.int64()), ("s", pa.string()), ("f", pa.float64()), ("n", pa.int32())]), [{"i": 3, "s": "b", "f": 1.0, "n": None}, {"i": 5, "s": None, "f": 2.0, "n": None}])
    g = pq.ParquetFile(path).metadata.row_group(0)
    assert [footers.key_bounds(g.column(k).statistics, 2) for k in range(4)] == [((1, 3), (1, 5)), ((1, "b"), footers.HIGHEST), (footers.LOWEST, footers.HIGHEST), (footers.HIGHEST, footers.HIGHEST)]
    assert footers.key_bounds(None, 2) == (footers.LOWEST, footers.HIGHEST)
    (_, size, begin, length, magic), = footers.tails([path])
    assert magic == "PAR1" and begin + length + 8 == size == os.path.getsize(path)


@pytest.mark.parametrize("layout", ["apart", "apart backwards", "overlapping ends", "dense", "nulls"])
@pytest.mark.parametrize("single", [True, False])
def test_ordered_directory(spark, tmp_path, layout, single):
    n, rows = 4, 60
    sources = {
        "apart": [list(range(k * rows, (k + 1) * rows)) for k in range(n)], "apart backwards": [list(range((n - k) * rows, (n - k + 1) * rows)) for k in range(n)],
        "overlapping ends": [list(range(k * rows - 6 * (k % 2), (k + 1) * rows)) for k in range(n)], "dense": [list(range(k, n * rows, n)) for k in range(n)],
        "nulls": [[*range(k * rows, (k + 1) * rows), *[None] * (3 * (k % 2))] for k in range(n)],
    }[layout]
    schema = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("payload", pa.struct([("score", pa.int32())]))])
    paths = [write(tmp_path / f"{k}.parquet", schema, [{"k": v, "n": 1000 * k + i, "payload": {"score": 1}} for i, v in enumerate(x)], row_group_size=10) for k, x in enumerate(sources)]
    want = [v for *_, v in sorted((v is None, v or 0, k, i, 1000 * k + i) for k, x in enumerate(sources) for i, v in enumerate(x))]
    out = str(tmp_path / "out")
    for _ in range(2):  # the second time over what the first has left
        report = sink.merge_payload_parquet_files(spark, paths, out, execution=ExecutionOptions(ordering_field="k"), single_file=single)
        files = [out] if single else sorted(str(p) for p in (tmp_path / "out").glob("*.parquet"))
        assert [x for f in files for x in pq.read_table(f)["n"].to_pylist()] == want
        assert report.rows == len(want) and report.output_files == files and report.fast_path_rows + report.sorted_rows == len(want)
        assert (report.sorted_rows == 0) == (layout not in ("overlapping ends", "dense"))  # row groups of nulls alone go last as they are
    if not single:
        assert validate.out_of_order(spark, out, "k").count() == 0
    if layout == "overlapping ends":
        assert report.sorted_rows == 2 * 2 * 10
    plans = [p._jdf.queryExecution().executedPlan().toString() for p in merge.payload_files_in_order(spark, paths, merge.PayloadOptions(), "k").pieces]
    if layout.startswith("apart"):
        assert len(plans) == 1 and "Exchange rangepartitioning" not in plans[0] and "Exchange hashpartitioning" not in plans[0]


def test_order_of_input_without_a_shuffle(spark, tmp_path):
    paths = [(left, right)[k % 2](tmp_path / f"{k}.parquet", range(k * 10, k * 10 + 7), range(7), row_group_size=3) for k in (3, 0, 2, 1)]
    out = str(tmp_path / "out")
    sink.merge_payload_parquet_files(spark, paths, out, single_file=False)
    files = sorted(str(p) for p in (tmp_path / "out").glob("*.parquet"))
    assert [x for f in files for x in pq.read_table(f)["event_id"].to_pylist()] == [k * 10 + i for k in (3, 0, 2, 1) for i in range(7)]
    plan = merge.files_in_order(spark, paths, merge.payload()).pieces[0]._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan
    assert pq.read_schema(files[0]).names == ["org_id", "event_id", "payload"]


def test_output_that_is_out_of_order_is_noticed(spark, tmp_path):
    for k, ids in enumerate(([1, 2, 5], [4, 6, None], [None])):
        os.makedirs(tmp_path / "o", exist_ok=True)
        write(tmp_path / "o" / f"part-{k}.parquet", pa.schema([("v", pa.int64())]), [{"v": v} for v in ids])
    assert [tuple(r) for r in validate.out_of_order(spark, str(tmp_path / "o"), "v").collect()] == [(1, 0)]


@pytest.mark.parametrize("columns", [(), (ColumnOptions(("id",), encoding=Encoding.DELTA_BINARY_PACKED),)])
def test_overwriting_leaves_nothing_behind(spark, tmp_path, columns):
    path = str(tmp_path / "d")
    options = ExecutionOptions(writer_column_options=columns, writer_data_page_row_count_limit=50)
    sink.write_directory(spark.range(100).repartition(4), path, options)
    sink.write_directory(spark.range(10).coalesce(1), path, options)
    assert spark.read.parquet(path).count() == 10 and sorted(os.listdir(tmp_path)) == ["d"]
    assert not [f for f in os.listdir(path) if "writing" in f or "tried" in f]


def test_disorder_is_found_within_and_between_tasks(spark):
    values = [1, 2, 2, 5, 4, None, None, 7, 8]
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)] + [(1, 0, 0)], f"{merge.SOURCE} int, {merge.ROW} long, v int")
    for parts in (1, 2, 3, 5, 10):
        cut = df.repartitionByRange(parts, merge.SOURCE, merge.ROW).sortWithinPartitions(merge.SOURCE, merge.ROW)
        assert sorted(r[merge.ROW] for r in merge.disorder(cut, "v").collect()) == [4, 7]


def test_first_disorder_of_each_task(spark):
    df = spark.createDataFrame([(0, k, -k) for k in range(500)], f"{merge.SOURCE} int, {merge.ROW} long, v int").repartitionByRange(3, merge.ROW).sortWithinPartitions(merge.ROW)
    rows = [r[merge.ROW] for r in merge.disorder(df, "v", first_only=True).collect()]
    assert min(rows) == 1 and len(rows) <= 6


@pytest.mark.parametrize("values,bad", [([1.0, float("nan"), None], []), ([float("nan"), 1.0], [1]), ([None, float("nan")], [1]), (["b", "a"], [1]), ([dt.date(2020, 1, 2), dt.date(2020, 1, 1), None], [1]), ([], [])])
def test_disorder_of_kinds(spark, values, bad):
    kind = "double" if not values or isinstance(values[-1], float) or isinstance(values[0], float) else "string" if isinstance(values[0], str) else "date"
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], f"{merge.SOURCE} int, {merge.ROW} long, v {kind}").coalesce(1)
    assert [r[merge.ROW] for r in merge.disorder(df, "v").collect()] == bad


def test_positions(spark):
    df = spark.range(1000).repartition(7).orderBy("id")
    assert [(r["pos"], r["id"]) for r in with_position(df).orderBy("pos").collect()] == [(k + 1, k) for k in range(1000)]
    assert with_position(spark.range(0).orderBy("id")).count() == 0


def test_writer(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "cast(id as string) as s", "named_struct('score', cast(id as double), 'l', array(id)) as payload")
    path = str(tmp_path / "a.parquet")
    for codec, shown in (("uncompressed", "UNCOMPRESSED"), ("snappy", "SNAPPY"), ("lz4_raw", "LZ4"), ("zstd", "ZSTD")):
        sink.write_file(df, path, ExecutionOptions(writer_compression=Compression(codec, 5 if codec == "zstd" else None), output_row_group_rows=2))
        meta = pq.ParquetFile(path).metadata
        assert meta.num_rows == 5 and meta.row_group(0).column(0).compression == shown
    columns = (ColumnOptions(("id",), encoding=Encoding.DELTA_BINARY_PACKED), ColumnOptions(("payload", "score"), encoding=Encoding.BYTE_STREAM_SPLIT, compression=Compression("zstd", 1)), ColumnOptions(("s",), dictionary_enabled=False))
    sink.write_file(df, path, ExecutionOptions(writer_column_options=columns, output_row_group_rows=2, writer_version=2))
    chunks = {c["column_path"]: c for c in footers._chunks(path)}
    assert pq.ParquetFile(path).metadata.num_row_groups == 3 and "DELTA_BINARY_PACKED" in chunks["id"]["encodings"] and "BYTE_STREAM_SPLIT" in chunks["payload.score"]["encodings"] and chunks["payload.score"]["codec"] == "ZSTD"
    assert "DICTIONARY" not in chunks["s"]["encodings"] and spark.read.parquet(path).count() == 5
    with pytest.raises(ValueError, match="does not match an output parquet leaf column; available"):
        sink.write_file(df, path, ExecutionOptions(writer_column_options=(ColumnOptions(("x",), encoding=Encoding.PLAIN),)))
    with pytest.raises(ValueError, match="cannot use DELTA_BINARY_PACKED"):
        sink.write_file(df, path, ExecutionOptions(writer_column_options=(ColumnOptions(("s",), encoding=Encoding.DELTA_BINARY_PACKED),)))


@pytest.mark.parametrize("how,text", [
    ({"read_batch_size": 0}, "read_batch_size must be greater than zero"), ({"ordered_memory_budget_bytes": 0}, "when set"), ({"writer_compression": Compression("zstd", 23)}, "between 1 and 22, got 23"), ({"ordering_field": " "}, "must not be empty when provided"),
    ({"writer_column_options": (ColumnOptions(()),)}, "path must not be empty"), ({"writer_column_options": (ColumnOptions(("a", " ")),)}, "empty component"), ({"writer_column_options": (ColumnOptions(("a",)),)}, "must set dictionary_enabled, encoding, or compression"),
    ({"writer_column_options": (ColumnOptions(("a",), True), ColumnOptions(("a",), True))}, "duplicate writer_column_options path `a`"),
])
def test_options(how, text):
    with pytest.raises(ValueError, match=text):
        ExecutionOptions(**how).check()
    assert [resolved_parallelism(*x) for x in ((0, 8, 3), (1, 8, 3), (5, 8, 3), (0, 8, 0))] == [3, 1, 3, 1]


def test_layout(spark, tmp_path):
    path = write(tmp_path / "a.parquet", pa.schema([pa.field("id", pa.int32(), False), ("value", pa.string())]), [{"id": k + 1, "value": v} for k, v in enumerate(["a", "b", None, "d", "e"])], row_group_size=2)
    chunks = footers.layout(spark, [path])
    assert chunks.count() == 6 and chunks.agg({"null_count": "sum"}).first()[0] == 1
    deltas = footers.size_deltas(chunks, chunks.filter("column_path = 'id'")).collect()
    assert {r["column_path"]: r["delta_bytes"] == 0 for r in deltas} == {"id": True, "value": False}
    assert {r["column_path"]: r["chunks"] for r in footers.layout_summary(chunks).groupBy("column_path").agg({"chunks": "sum"}).withColumnRenamed("sum(chunks)", "chunks").collect()} == {"id": 3, "value": 3}


def test_multisets_and_derived_columns(spark):
    a = spark.createDataFrame([(1, (2,)), (1, (2,)), (3, None)], "x int, s struct<y:int>")
    assert tuple(validate.multiset_diff(a, a.limit(1)).first()) == (2, 0) and tuple(validate.multiset_diff(a, a).first()) == (0, 0)
    df = spark.createDataFrame([(dt.datetime(2024, 5, 6, 7), 250, "DE"), (None, None, None)], "timestamp timestamp_ntz, org_id long, country string")
    rows = derive.partition_columns(df, "timestamp", "org_id", "country").collect()
    assert rows[0]["org_tier"] == "tier2" and tuple(rows[0]["partition_struct"]) == (2024, 5, 6, "DE", "tier2") and rows[1]["org_tier"] == "tier3"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_whole_payload_of_three_tables_equals_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    df = entry.queries()["p2_payload_whole"](spark, data)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema["payload"].dataType}
    assert kinds == {"score": "double", "profile": "struct<name:string,tier:string,segment:string>", "scores": "array<double>", "amount": "int"}

    def side(name, profile, scores, amount):
        members = {"name": "NULL", "tier": "NULL", "segment": "NULL", profile: f"payload.profile.{profile}"}
        struct = ", ".join(f"{k}: {v}::VARCHAR" for k, v in members.items())
        return f"""SELECT event_id, org_id, event_date, CASE WHEN payload IS NOT NULL THEN {{score: payload.score::DOUBLE, profile: CASE WHEN payload.profile IS NOT NULL THEN {{{struct}}} END,
          scores: {scores}::DOUBLE[], amount: {amount}::INTEGER}} END AS payload FROM '{data}/{name}.parquet'"""

    sql = " UNION ALL ".join([side("payload_left", "name", "payload.scores", "NULL"), side("payload_right", "tier", "payload.scores", "payload.amount"), side("payload_mixed", "segment", "NULL", "payload.amount")])
    want = sorted(repr(r) for r in duckdb.sql(sql).fetchall())
    rows = [r.asDict(recursive=True) for r in df.collect()]
    assert sorted(repr((r["event_id"], r["org_id"], r["event_date"], r["payload"])) for r in rows) == want
    lists = [r["payload"]["scores"] for r in rows if r["payload"] and r["payload"]["scores"]]
    assert any(None in x for x in lists) and all(isinstance(v, float) for x in lists for v in x if v is not None)
