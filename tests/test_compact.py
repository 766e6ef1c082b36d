import itertools
import json
import random

import numpy as np
import pytest

from lamina.functions import hilbert
from lamina.functions.jsonvalues import canonical_text, digest
from lamina.operators import compact as C

SCHEMA = "file_id long, row_no int, event_id long, org_id long, payload string, copies string"


@pytest.mark.parametrize("same", [
    ('{"a":1,"b":[1,2]}', '{ "b" : [1.0, 2e0], "a":1 }'), ('{"a":null}', "{}"), ('{"a":"\\u00e9\\/"}', '{"a":"é/"}'), ('{"a":-0.0}', '{"a":0}'), ('{"a":1.50}', '{"a":15e-1}'), ('{"x":{"y":null,"z":1}}', '{"x":{"z":1}}'), ("1e3", "1000"),
])
def test_equal_json_values(same):
    assert digest(same[0]) == digest(same[1])


@pytest.mark.parametrize("other", [('{"a":[1,2]}', '{"a":[2,1]}'), ('{"a":[null]}', '{"a":[]}'), ('{"a":1}', '{"a":"1"}'), ('{"a":true}', '{"a":1}'), ('{"a":{}}', "{}"), ("{", "{ "), (None, "null"), ('{"a":12345678901234567890}', '{"a":12345678901234567891}'), ('{"a":0.1}', '{"a":"0.1"}'), ("", None)])
def test_different_json_values(other):
    assert digest(other[0]) != digest(other[1])


def test_deep_and_long_texts_stand_for_themselves():
    deep = "[" * 100_000 + "]" * 100_000
    assert canonical_text(deep).startswith("\0text")
    assert digest(json.dumps({"a": "x" * 1_000_000}))


@pytest.mark.parametrize("n,bits", [(1, 5), (2, 4), (3, 3)])
def test_hilbert_codes_visit_every_point_by_steps_of_one(n, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=n)), np.uint64)
    codes = hilbert.codes([points[:, k] for k in range(n)], bits)
    assert sorted(codes.tolist()) == list(range(1 << (bits * n)))
    path = points[np.argsort(codes)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("a,b,same", [("1" + "0" * 500, "1e500", True), ("0.1" + "0" * 30, "0.1", True), ("1.5e0", "1.5", True), ("123456789012345678e-3", "123456789012345.678", True), ("9" * 450, "9" * 449 + "8", False), ("0.1234567890123456", "0.1234567890123457", False), ("-0", "0.0", True), ("1e99999999999999999999", "1e99999999999999999998", False)])
def test_numbers_of_all_sizes(a, b, same):
    assert (digest(f'{{"a":{a}}}') == digest(f'{{"a":{b}}}')) == same


def test_running_sums_over_tasks(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as n").repartitionByRange(5, "id").sortWithinPartitions("id")
    out, total = C.running(df, "n")
    want = list(itertools.accumulate([0] + [k % 7 for k in range(1000)]))
    assert total == want[-1] and [r["__before"] for r in out.orderBy("id").collect()] == want[:-1]


def test_files_are_balanced_however_hot_a_key_is(spark):
    data = [(k, 0, 7 if k % 3 else k, 1, '{"a":%d}' % k) for k in range(2000)]
    done = C.compact(spark.createDataFrame(data, "file_id long, row_no int, event_id long, org_id long, payload string"), file_bytes=3000)
    sizes = [r["n"] for r in done.destination.groupBy("file_no").agg({"payload": "count"}).withColumnRenamed("count(payload)", "n").collect()]
    assert len(sizes) == done.files > 10 and max(sizes) - min(sizes) <= 0.1 * max(sizes)


def test_places_of_other_types(spark):
    data = [("b", 1, 5, 1, "{}"), ("a", 2, 5, 1, "{ }"), ("a", 1, 5, 1, "null")]
    df = spark.createDataFrame(data, "file_id string, row_no int, event_id long, org_id long, payload string")
    assert [tuple(r) for r in C.redundant_rows(df).collect()] == [("b", 1)]


def rows(seed=1, n=600):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        event = rnd.choice([7, 7, 7, rnd.randint(1, 200), None])
        value = rnd.choice(['{"a":1}', '{"a": 1.0}', '{"a":null,"b":"x"}', '{"b":"x"}', None, "", "broken", '{"a":%d}' % rnd.randint(0, 3)])
        out.append((k // 5, k % 5, event, rnd.choice([1, 2, None]), value, "c"))
    rnd.shuffle(out)
    return out


def test_each_record_once_and_copies_found(spark):
    data = rows()
    seen, copies = set(), []
    for r in sorted(data):
        key = (r[2], r[3], digest(r[4]))
        copies += [(r[0], r[1])] if key in seen else []
        seen.add(key)
    df = spark.createDataFrame(data, SCHEMA)
    done = C.compact(df, file_bytes=300)
    assert done.records == len(seen) and done.rows == len(data) and done.files > 3
    assert {(r["event_id"], r["org_id"], digest(r["payload"])) for r in done.destination.collect()} == seen
    assert done.destination.agg({"copies": "sum"}).first()[0] == len(data)
    assert sorted(tuple(r) for r in C.redundant_rows(df).collect()) == sorted(copies)


def test_lost_records_are_noticed(spark, monkeypatch):

    good = C._fingerprint
    calls = []

    def bad(*columns):
        calls.append(1)
        return good(*columns) if len(calls) == 1 else good(*columns[:1])

    monkeypatch.setattr(C, "_fingerprint", bad)
    with pytest.raises(C.DigestMismatch):
        C.compact(spark.createDataFrame(rows(), SCHEMA))


@pytest.mark.parametrize("change,what", [("event_id = 7", "records"), ("copies > 1", "rows")])
def test_what_is_lost_before_staging_is_noticed(spark, monkeypatch, change, what):
    from pyspark.sql import DataFrame, DataFrameReader
    from pyspark.sql import functions as F

    parquet = DataFrameReader.parquet

    def lossy(self, *paths, **how) -> DataFrame:
        df = parquet(self, *paths, **how)
        if not paths[0].endswith(".records"):
            return df
        return df.filter(f"not coalesce({change}, false)") if what == "records" else df.withColumn("copies", F.expr(f"if({change}, copies - 1, copies)"))

    # What is staged lacks records, or counts a row too few.
    monkeypatch.setattr(DataFrameReader, "parquet", lossy)
    with pytest.raises(C.DigestMismatch, match=what):
        C.compact(spark.createDataFrame(rows(), SCHEMA))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.compact(df).records == 0
    assert C.redundant_rows(df).count() == 0
