import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lamina.plans.options import NdjsonOptions, StringMode, WideningOptions
from lamina.plans.widening import SchemaConflict
from lamina.sources import ndjson, sink

OPTIONS = NdjsonOptions(("event_id", "org_id"))
A = ['{"event_id":1,"org_id":10,"score":1,"profile":{"name":"Alice"},"scores":[1,2]}', '{"event_id":2,"org_id":20,"score":4.5,"profile":{"tier":"gold"},"scores":[1.5],"amount":9}']


def write(path, lines, end="\n"):
    path.write_text(end.join(lines) + end, encoding="utf-8", newline="")
    return str(path)


def discovered(spark, tmp_path, *files, options=OPTIONS):
    return ndjson.discover(spark, [write(tmp_path / f"{k}.ndjson", f) for k, f in enumerate(files)], options).schema


def test_union(spark, tmp_path):
    schema = discovered(spark, tmp_path, A)
    payload = schema.field("payload").type
    assert schema.names == ["event_id", "org_id", "payload"] and not schema.field("event_id").nullable and schema.field("payload").nullable
    assert [f.name for f in payload] == ["amount", "profile", "score", "scores"]
    assert payload.field("score").type == pa.float64() and payload.field("amount").nullable and not payload.field("profile").nullable
    assert [f.name for f in payload.field("profile").type] == ["name", "tier"] and payload.field("scores").type == pa.list_(pa.field("item", pa.float64(), False))


def test_order_of_files_doesnt_matter(spark, tmp_path):
    b = ['{"event_id":3,"tags":["x"]}', '{"org_id":4,"tags":[],"big":%d}' % (2**63)]
    one = discovered(spark, tmp_path, A, b)
    assert one == discovered(spark, tmp_path, b, A)
    assert one.field("payload").type.field("big").type == pa.uint64()


def test_conflicts(spark, tmp_path):
    with pytest.raises(SchemaConflict) as e:
        discovered(spark, tmp_path, ['{"profile":1}', '{"profile":{"name":"A"}}'])
    assert "payload.profile" in str(e.value) and "Int64" in str(e.value) and "Struct" in str(e.value)
    with pytest.raises(SchemaConflict, match="<root>"):
        discovered(spark, tmp_path, ['{"a":1}', '{"a":"x"}'])
    with pytest.raises(SchemaConflict):
        discovered(spark, tmp_path, ['{"a":true}'], ['{"a":1}'])
    for bad, text in (("[1]", "must be an object"), ("{", "failed to parse"), (" ", "failed to parse")):
        with pytest.raises(ValueError, match=text):
            discovered(spark, tmp_path, [A[0], bad])


def test_compaction_fills_nulls(spark, tmp_path):
    paths = [write(tmp_path / "l.ndjson", ['{"event_id":1,"org_id":10,"score":1}', "", '{"event_id":2,"org_id":20,"score":2}'], "\r\n"), write(tmp_path / "r.ndjson", ['{"event_id":3,"org_id":30,"score":4.5,"amount":9}'])]
    out = str(tmp_path / "out.parquet")
    report = sink.compact_ndjson_to_parquet(spark, paths, out, OPTIONS)
    rows = pq.read_table(out).to_pylist()
    assert report.rows == 3 and [(r["payload"]["score"], r["payload"]["amount"]) for r in rows] == [(1.0, None), (2.0, None), (4.5, 9)]


def test_stable_sort_with_nulls_last(spark, tmp_path):
    lines = [json.dumps({"event_id": e, "org_id": o, "x": 1}) for e, o in ((2, 10), (None, 11), (1, 12), (1, 13))]
    out = str(tmp_path / "out.parquet")
    options = NdjsonOptions(("event_id", "org_id"), sort_field="event_id")
    sink.compact_ndjson_to_parquet(spark, [write(tmp_path / "a.ndjson", lines)], out, options)
    assert [(r["event_id"], r["org_id"]) for r in pq.read_table(out).to_pylist()] == [(1, 12), (1, 13), (2, 10), (None, 11)]
    with pytest.raises(ValueError, match="external spill sort is not implemented"):
        sink.compact_ndjson_to_parquet(spark, [write(tmp_path / "a.ndjson", lines)], out, NdjsonOptions(("event_id", "org_id"), sort_field="event_id", sort_max_rows_in_memory=1))
    with pytest.raises(ValueError, match="unsupported type Boolean"):
        sink.compact_ndjson_to_parquet(spark, [write(tmp_path / "b.ndjson", ['{"f":true,"x":1}'])], out, NdjsonOptions(("f",), sort_field="f"))


def test_string_sort_over_files(spark, tmp_path):
    a = write(tmp_path / "l.ndjson", ['{"event_time":"01:00","org_id":10,"x":1}', '{"event_time":"03:00","org_id":11,"x":1}'])
    b = write(tmp_path / "r.ndjson", ['{"event_time":"00:00","org_id":20,"x":1}', '{"event_time":null,"org_id":21,"x":1}'])
    options = NdjsonOptions(("event_time", "org_id"), sort_field="event_time")
    for paths in ([a, b], [b, a]):
        sink.compact_ndjson_to_parquet(spark, paths, out := str(tmp_path / "o.parquet"), options)
        assert [r["org_id"] for r in pq.read_table(out).to_pylist()] == [20, 10, 11, 21]


def test_text_columns_that_hold_numbers(spark, tmp_path):
    options = NdjsonOptions(("id",), widening=WideningOptions(strings=StringMode.PRIMITIVE_TO_STRING))
    path = write(tmp_path / "a.ndjson", ['{"id":1,"v":true,"l":["a",2],"s":"1.0"}', '{"id":2,"v":"x","l":[1.0]}', '{"id":3,"v":2.5}', '{"id":4,"v":null,"v":1}'])
    sink.compact_ndjson_to_parquet(spark, [path], out := str(tmp_path / "o.parquet"), options)
    rows = [r["payload"] for r in pq.read_table(out).to_pylist()]
    assert [r["v"] for r in rows] == ["true", "x", "2.5", None] and rows[0]["l"] == ["a", "2"] and rows[1]["l"] == ["1"] and rows[0]["s"] == "1.0"


def test_never_seen_fields_and_empty_input(spark, tmp_path):
    schema = discovered(spark, tmp_path, ['{"event_id":1,"x":1}'])
    assert schema.field("org_id").type == pa.null() and schema.field("org_id").nullable
    assert discovered(spark, tmp_path, [""]).field("payload").type.num_fields == 0
    with pytest.raises(ValueError, match="no field"):
        sink.compact_ndjson_to_parquet(spark, [write(tmp_path / "e.ndjson", [""])], str(tmp_path / "o.parquet"), OPTIONS)


@pytest.mark.parametrize("how,text", [
    ({"payload_column": " "}, "payload_column must not be empty"), ({"batch_rows": 0}, "batch_rows"), ({"envelope_fields": ("a", "a")}, "duplicate envelope field `a`"), ({"envelope_fields": ("payload",)}, "conflicts with payload column"),
    ({"sort_field": "x"}, "must also be listed in envelope_fields"), ({"sort_max_rows_in_memory": 0}, "sort_max_rows_in_memory"),
])
def test_options(how, text):
    with pytest.raises(ValueError, match=text):
        NdjsonOptions(**how).check()


def test_registered_queries_read_files(spark, monkeypatch):
    import os

    import __spark_entry__ as entry
    from lamina.sources import ndjson

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    good, seen = ndjson.lines, []
    monkeypatch.setattr(ndjson, "lines", lambda spark, paths: seen.append(paths) or good(spark, paths))
    for name in ("ndjson_compact", "ndjson_compact_sorted"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 2 and all(len(paths) >= 2 for paths in seen)
