import collections
import json
import random

from lamina.functions.jsonvalues import canonical
from lamina.operators import drift as D

SCHEMA = "feed string, file_no long, line_no long, line string, payload string, paths int"


def frame(spark, files):
    data = [(f, n, k, x, "p", 1) for (f, n), lines in files.items() for k, x in enumerate(lines)]
    return spark.createDataFrame(data, SCHEMA)


def changes(spark, files):
    return sorted(tuple(r) for r in D.file_changes(frame(spark, files)).collect())


def brute(files):
    """Changes by comparing whole files in memory, with values of every candidate side by side."""
    records, out = {}, []
    for key, lines in files.items():
        records[key] = []
        for x in lines:
            try:
                r = json.loads(x, parse_float=D._fraction)
            except (ValueError, TypeError):
                continue
            if isinstance(r, dict):
                records[key].append(r)
    feeds = collections.defaultdict(list)
    for f, n in sorted(records):
        feeds[f].append(n)
    for f, numbers in feeds.items():
        for a, b in zip(numbers, numbers[1:]):
            heads = []
            for n in (a, b):
                masks = {"": 0}
                for r in records[f, n]:
                    for k, v in r.items():
                        if k not in ("event_id", "org_id") and v is not None:
                            D.note(v, "payload" + D.SEP + k, masks)
                heads.append(masks)
            plain, candidates = D.compare(*heads, "payload")
            pairs = [(p, q) for i, p, x in candidates for j, q, y in candidates if (i, j) == (0, 1) and x == y and D.same_type(D.type_of(p, heads[0]), D.type_of(q, heads[1]))]
            gone, come, fit = set(), set(), []
            for p, q in pairs:
                sides = []
                for n, path in ((a, p), (b, q)):
                    values = collections.defaultdict(set)
                    for r in records[f, n]:
                        v = D._at(r, path.split(D.SEP)[1:])
                        if v is not None and r.get("event_id") is not None:
                            values[r["event_id"]].add(canonical(D._plain(v)))
                    sides.append(values)
                both = set(sides[0]) & set(sides[1])
                if len(both) >= 2 and all(len(sides[0][e]) == 1 and sides[0][e] == sides[1][e] for e in both):
                    fit.append((-len(both), p, q))
            for _, p, q in sorted(fit):
                if p not in gone and q not in come:
                    gone.add(p)
                    come.add(q)
                    out.append((f, b, "renamed", p.replace(D.SEP, "."), q.replace(D.SEP, ".")))
            out += [(f, b, k, p.replace(D.SEP, "."), "") for k, p, _ in plain if not (k == "removed" and p in gone or k == "added" and p in come)]
    return sorted(out)


def test_kinds_of_change(spark):
    files = {
        ("a", 1): ['{"event_id":1,"org_id":1,"score":1,"p":{"n":"x","m":1},"gone":true,"l":[1],"same":{"k":1}}', '{"event_id":2,"score":2,"p":{"n":"y"},"old":7,"same":{}}'],
        ("a", 3): ['{"event_id":1,"score":1.0,"p":{"n2":"x","m":1.0},"l":["s"],"same":{"k":2}}', '{"event_id":2,"p":{"n2":"y"},"new":7,"Old":1}', '{"event_id":2,"p":{"n2":"y"}}'],
        ("b", 1): ['{"event_id":1,"s":{"x":1}}'],
        ("b", 2): ['{"event_id":1,"s":"text","t":{"y":{"z":1}}}'],
    }
    assert changes(spark, files) == sorted([
        ("a", 3, "retyped", "payload.score", ""), ("a", 3, "renamed", "payload.p.n", "payload.p.n2"), ("a", 3, "retyped", "payload.p.m", ""), ("a", 3, "removed", "payload.gone", ""), ("a", 3, "retyped", "payload.l", ""),
        ("a", 3, "removed", "payload.old", ""), ("a", 3, "added", "payload.new", ""), ("a", 3, "added", "payload.Old", ""), ("b", 2, "retyped", "payload.s", ""), ("b", 2, "added", "payload.t", ""),
    ])


def test_empty_lists_nulls_and_broken_lines_have_no_say(spark):
    files = {("a", 1): ['{"event_id":1,"l":[1],"n":null}', "not json", "", "[1]", "7"], ("a", 2): ['{"event_id":1,"l":[]}', '{"event_id":1,"l":null}'], ("a", 3): ["{}", None]}
    assert changes(spark, files) == [("a", 3, "removed", "payload.l", "")]


def test_renames_need_two_equal_events(spark):
    files = {("a", 1): ['{"event_id":1,"x":5}', '{"event_id":2,"x":6}'], ("a", 2): ['{"event_id":1,"y":5}', '{"event_id":2,"y":7}'], ("a", 3): ['{"event_id":1,"z":5}']}
    assert [c[2] for c in changes(spark, files)] == ["added", "removed", "added", "removed"]


def test_against_brute_force(spark):
    rnd = random.Random(5)
    files = {}
    for f in "ab":
        names = ["q", "w", "e"]
        for n in range(1, 15):
            if rnd.random() < 0.6:
                names[rnd.randrange(3)] = rnd.choice("rtyuiop") + str(n)
            lines = []
            for e in rnd.sample(range(12), 8):
                record = {"event_id": e, **{x: rnd.choice([e * 3 + k, None]) if n % 4 else float(e) + 0.5 for k, x in enumerate(names)}, "s": {names[0]: str(e), "k": [e]}}
                lines += [json.dumps(record)] * rnd.choice([1, 1, 2])
            files[f, n] = lines
    assert changes(spark, files) == brute(files)


def test_rare_cases_against_brute_force(spark):
    """Few events, small domains, empty lists, exponents, several paths that fit, repeated events that disagree."""
    rnd = random.Random(11)
    files = {}
    for f in "abcdef":
        for n in range(1, 12):
            names = rnd.sample("qwertz", 4)
            lines = []
            for e in rnd.sample(range(6), 4):
                record = {"event_id": e, "s": {}}
                for k, x in enumerate(names):
                    value = rnd.choice([True, rnd.random() < 0.8, None]) if k == 0 else rnd.choice([[], [1], [e]]) if k == 1 else rnd.choice([e, float(e)]) if k == 2 else {"m": e % 2}
                    (record["s"] if rnd.random() < 0.3 else record)[x] = value
                text = json.dumps(record)
                lines += [text.replace(": 3", ": 3e0") if rnd.random() < 0.2 else text] * rnd.choice([1, 2])
            if rnd.random() < 0.2:
                lines.append(json.dumps({"event_id": 0, names[0]: rnd.random() < 0.5}))
            files[f, n] = lines
    got = changes(spark, files)
    assert got == brute(files) and any(c[2] == "renamed" for c in got)


def test_a_path_becomes_one_path_only(spark):
    files = {("a", 1): ['{"event_id":1,"x":5,"u":1}', '{"event_id":2,"x":6,"u":1}', '{"event_id":3,"u":1}'], ("a", 2): ['{"event_id":1,"y":5,"z":5,"v":1}', '{"event_id":2,"y":6,"z":6}', '{"event_id":3,"w":1,"v":1}', '{"event_id":1,"w":1}', '{"event_id":2,"w":1}']}
    assert changes(spark, files) == [("a", 2, "added", "payload.v", ""), ("a", 2, "added", "payload.z", ""), ("a", 2, "renamed", "payload.u", "payload.w"), ("a", 2, "renamed", "payload.x", "payload.y")]


def test_one_table(spark):
    files = {("a", 1): ['{"event_id":1,"org_id":2,"score":1,"A":1,"l":[1]}', "broken"], ("a", 2): ['{"event_id":2,"score":2.5,"a":true,"p":{"n":"x"},"l":[1.5],"v":1}', '{"event_id":3,"v":"s"}'], ("b", 1): ['{"p":{"m":1}}']}
    table = D.unified(frame(spark, files))
    kinds = {x.name: x.dataType.simpleString() for x in table.schema["payload"].dataType.fields}
    assert kinds == {"A": "bigint", "a__2": "boolean", "l": "array<double>", "p": "struct<m:bigint,n:string>", "score": "double", "v": "string"}
    got = {(r["feed"], r["file_no"], r["line_no"]): (r["event_id"], r["org_id"], r["payload"]) for r in table.collect()}
    assert len(got) == 5
    assert got["a", 1, 0][:2] == (1, 2) and got["a", 1, 0][2]["score"] == 1.0 and got["a", 1, 0][2]["l"] == [1.0]
    assert got["a", 2, 1][2]["v"] == "s" and got["b", 1, 0][2]["p"]["m"] == 1


def test_empty_table(spark):
    assert changes(spark, {}) == []
    assert D.unified(frame(spark, {})).count() == 0


def test_renames_between_typed_tables_are_checked_by_value(spark):
    from lamina.operators.drift import schema_changes

    old = spark.createDataFrame([(1, ("a", "x", 1)), (2, ("b", "y", 2)), (2, ("b", "y", 2)), (3, (None, "z", 3)), (None, ("q", "q", 0))], "event_id long, payload struct<name:string,note:string,n:int>")
    new = spark.createDataFrame([(2, ("b", "u", 2)), (1, ("a", "x", 1)), (3, ("c", "z", 3)), (9, ("k", "k", 4))], "event_id long, payload struct<title:string,remark:string,n:int>")
    got = [tuple(r) for r in schema_changes([("old", old), ("new", new)]).collect()]
    assert got == [("new", 1, "renamed", "payload.name -> payload.title", "Utf8", "Utf8"), ("new", 2, "removed", "payload.note", "Utf8", ""), ("new", 3, "added", "payload.remark", "", "Utf8")]
