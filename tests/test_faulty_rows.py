import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.operators import faulty_rows as R


def cut(line):
    """The fields of a record by a scan of its characters; None for faulty quoting."""
    fields, k, n = [], 0, len(line)
    while True:
        if k < n and line[k] == '"':
            k += 1
            text = ""
            while True:
                if k >= n:
                    return None
                if line[k] == '"':
                    if k + 1 < n and line[k + 1] == '"':
                        text += '"'
                        k += 2
                        continue
                    k += 1
                    break
                text += line[k]
                k += 1
            if k < n and line[k] != ",":
                return None
        else:
            text = ""
            while k < n and line[k] != ",":
                text += line[k]
                k += 1
        fields.append(text)
        if k >= n:
            return fields
        k += 1


def reason(line):
    if line is None:
        return "column_count"
    line = line[:-1] if line.endswith("\r") else line
    fields = cut(line)
    if fields is None:
        return "quoting"
    if len(fields) != 5:
        return "column_count"
    digits = "0123456789"
    for name, most, value in (("event_id", 18, fields[0].strip(" ")), ("org_id", 9, fields[1].strip(" "))):
        if not (1 <= len(value) <= most and all(c in digits for c in value)):
            return name
    score = fields[2].strip(" ")
    if score:
        body = score[1:] if score[0] in "+-" else score
        mantissa, _, exponent = body.replace("E", "e").partition("e")
        whole, _, fraction = mantissa.partition(".")
        ok = mantissa and all(c in digits for c in whole + fraction) and whole + fraction
        if "e" in body.replace("E", "e"):
            power = exponent[1:] if exponent[:1] in ("+", "-") and exponent else exponent
            ok = ok and power and all(c in digits for c in power)
        if not ok or not math.isfinite(float(score)):
            return "score"
    return None


CASES = [
    None, "", "\r", "1,2,3,a,4", "1,2,3,a,4\r", "1,2,3,a,4\r\r", '"1", 2 ,"3.5",a,4', ' "1",2,3,a,4', '1,2,3,"a,4', '1,2,3,"a"b,4', '1,2,3,"a""b",4', '1,2,3,a"b,4', "1,2,3,a", "1,2,3,a,4,5",
    "x,2,3,a,4", "1,y,3,a,4", "1,2,z,a,4", "1,2,,a,", "1,2,1e999,a,4", "1,2,-1e-999,a,4", "1,2,.,a,4", "1,2,.5,a,4", "1,2,5.,a,4", "1,2,+5e+3,a,4", "1,2,5e,a,4", "1,2,NaN,a,4", "1,2,Infinity,a,4", "1,2,0x10,a,4", "1,2,1_0,a,4",
    "1" * 18 + ",2,3,a,4", "1" * 19 + ",2,3,a,4", "1,1234567890,3,a,4", "١,2,3,a,4", "1,2,3, ,4", "1\t,2,3,a,4", "1,2,3d,a,4", '1,2,3,"a\nb",4', "1,2,3,a\nb,4", '"",2,3,a,4', '1,2,"",a,4', '1,2,"  ",a,4', "-1,2,3,a,4", ",,,,", '"1,2,3,a,4',
    '1,2,3,"' + '""' * 50_000 + '",4', "1,2,3," + "a" * 200_000 + ",4", '1,2,3,"' + "a,\n" * 50_000,
]


def classified(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "row_id long, line string")
    return {r["row_id"]: r["reason"] for r in R.classify_rows(df, "line").select("row_id", "reason").collect()}


def test_every_kind_of_fault(spark):
    found = classified(spark, CASES)
    for k, line in enumerate(CASES):
        assert found[k] == reason(line), (line or "")[:80]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(['"', ",", "1", "7", " ", "\n", "\r", "a", ".", "e", "-", '""']), max_size=24).map("".join), min_size=40, max_size=120))
def test_any_text_is_judged_as_by_a_scan(spark, lines):
    found = classified(spark, lines)
    assert [found[k] for k in range(len(lines))] == [reason(x) for x in lines]


def test_loaded_rows_have_types_and_whole_texts(spark):
    lines = ['1, 22 ,"3.5","a ""q"", b",x', "2,3,,n,41\r", "bad"]
    df = spark.createDataFrame([(k, x, 9) for k, x in enumerate(lines)], "row_id long, line string, event_id int")
    rows = {r["row_id"]: tuple(r)[1:] for r in R.readable_rows(df).collect()}
    assert rows == {0: (1, 22, 3.5, 'a "q", b', None), 1: (2, 3, None, "n", 41)}
    assert [tuple(r) for r in R.faulty_rows(df).collect()] == [(2, "column_count")]


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", 5, "r", "w"), (2, "x", 5, None, "w")], "row_id long, line string, record int, reason string, score string")
    assert sorted(tuple(r) for r in R.faulty_rows(df).collect()) == [(1, "column_count"), (2, "column_count")]
    assert R.readable_rows(df).columns == ["row_id", "event_id", "org_id", "score", "name", "age"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, line string")
    assert R.faulty_rows(df).count() == R.readable_rows(df).count() == 0


def test_nothing_is_shuffled(spark):
    df = spark.createDataFrame([(1, "x")], "row_id long, line string")
    plan = R.faulty_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
