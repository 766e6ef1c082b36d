import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import distinct as D


def registers(rng, n, precision):
    """(register, byte) of n identifiers, from a plain set of ranks per register."""
    h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    register = (h & np.uint64((1 << precision) - 1)).astype(np.int64)
    rest = (h >> np.uint64(precision)).astype(np.int64)
    rank = np.where(rest == 0, 64 - precision + 1, np.log2((rest & -rest).astype(float)).astype(np.int64) + 1)
    ranks = {}
    for r, k in zip(register.tolist(), rank.tolist()):
        ranks.setdefault(r, set()).add(k)
    key = np.array(sorted(ranks), np.int64)
    value = np.array([max(ranks[r]) * 4 + 2 * (max(ranks[r]) - 1 in ranks[r]) + (max(ranks[r]) - 2 in ranks[r]) for r in sorted(ranks)], np.uint8)
    return key, value


@pytest.mark.parametrize("n", [1, 10, 300, 5000, 100_000])
def test_estimates_keep_the_standard_error(n):
    precision, runs = 10, 60
    rng = np.random.default_rng(n)
    sketches = [registers(rng, n, precision) for _ in range(runs)]
    got = D.estimates(np.concatenate([k + (g << precision) for g, (k, _) in enumerate(sketches)]), np.concatenate([v for _, v in sketches]), runs, precision)
    error = got / n - 1
    assert abs(error.mean()) < 4 * D.standard_error(precision) / math.sqrt(runs) + 1e-3
    assert math.sqrt((error**2).mean()) < 1.35 * D.standard_error(precision)


@pytest.mark.parametrize("sizes", [(3, 5), (40, 4000), (4000, 9000), (0, 7), (1, 1)])
def test_merging_in_any_order_and_grouping_is_the_same(sizes):
    """Merged bytes equal those of all identifiers together, whether sketches are short, full or one of each."""
    precision = 8
    a, b = (registers(np.random.default_rng(k), n, precision) if n else (np.zeros(0, np.int64), np.zeros(0, np.uint8)) for k, n in enumerate(sizes))
    packs = [D.packed(*x, 1, precision) for x in (a, b)]
    assert all(len(p[0].as_py()) in (3 * len(k), 1 << precision) for p, (k, _) in zip(packs, (a, b)))
    one = D.unpacked(pa.concat_arrays(packs), np.zeros(2, np.int64), precision)
    other = D.unpacked(pa.concat_arrays(packs[::-1] + packs), np.zeros(4, np.int64), precision)
    ranks = {}
    for key, value in (a, b):
        for k, v in zip(key.tolist(), value.tolist()):
            ranks.setdefault(k, set()).update({v >> 2} | ({(v >> 2) - 1} if v & 2 else set()) | ({(v >> 2) - 2} if v & 1 else set()))
    want = {k: max(s) * 4 + 2 * (max(s) - 1 in s) + (max(s) - 2 in s) for k, s in ranks.items()}
    assert dict(zip(one[0].tolist(), one[1].tolist())) == want
    assert all((x == y).all() for x, y in zip(one, other))
    again = D.unpacked(D.packed(*one, 1, precision), np.zeros(1, np.int64), precision)
    assert all((x == y).all() for x, y in zip(one, again))


def frame(spark, n=4000, seed=1):
    rnd = random.Random(seed)
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice(["a", "b", None]), rnd.choice([None, "u%d" % rnd.randint(0, 900)]), "x", 1.0) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "org long, country string, user string, level string, std_error double").repartition(6)


@pytest.mark.parametrize("at_once", [D.ROWS_AT_ONCE, 100])
def test_every_combination(spark, monkeypatch, at_once):
    monkeypatch.setattr(D, "ROWS_AT_ONCE", at_once)
    rows, df = frame(spark)
    dims = {"org": F.col("org"), "country": F.col("country")}
    got = D.distinct_counts(df, dims, {"users": F.col("user"), "countries": F.col("country")}).collect()
    want = {}
    for n in (0, 1, 2):
        for s in combinations(("org", "country"), n):
            for r in rows:
                key = (",".join(s), r[0] if "org" in s else None, r[1] if "country" in s else None)
                users, countries = want.setdefault(key, (set(), set()))
                users.add(r[2])
                countries.add(r[1])
    assert {(r["level"], r["org"], r["country"]) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        users, countries = (len(x - {None}) for x in want[r["level"], r["org"], r["country"]])
        assert abs(r["users"] - users) <= 5 * r["std_error"] * max(users, 1) and round(r["countries"]) == countries


def test_full_sketches_stay_with_their_task(spark, monkeypatch):
    """Small registers fill up; a task then sends each full group once, and counts stay the same."""
    rows, df = frame(spark, 6000)
    dims, items = {"org": F.col("org")}, {"users": F.col("user")}
    sets = D.combinations_of(list(dims))
    plain = sorted(map(repr, D.counted(D.merged(D.sketches(df, dims, items, sets, 6), [D.GROUPING, "org"], ["users"], 6), [D.GROUPING, "org"], ["users"], 6).collect()))
    for kept in (256, 1):
        monkeypatch.setattr(D, "ROWS_AT_ONCE", 50)
        monkeypatch.setattr(D, "MAX_KEPT", kept)
        parts = D.sketches(df.coalesce(1), dims, items, sets, 6)
        assert sorted(map(repr, D.counted(D.merged(parts, [D.GROUPING, "org"], ["users"], 6), [D.GROUPING, "org"], ["users"], 6).collect())) == plain


def test_partial_results_of_days_merge_to_the_whole(spark):
    rows, df = frame(spark)
    dims, items = {"org": F.col("org")}, {"users": F.col("user")}
    sets, names = [("org",)], [D.GROUPING, "org"]
    parts = [D.sketches(df.filter(F.abs(F.hash("user", "country")) % 3 == k), dims, items, sets) for k in range(3)]
    parts.append(D.sketches(df.filter("user is null"), dims, items, sets))
    both = D.merged(D.merged(parts[0].unionByName(parts[1]), names, ["users"]).unionByName(parts[2]).unionByName(parts[3]), names, ["users"])
    one = sorted(map(repr, D.counted(both, names, ["users"]).collect()))
    assert one == sorted(map(repr, D.counted(D.merged(D.sketches(df, dims, items, sets), names, ["users"]), names, ["users"]).collect()))


def test_against_exact_counts(spark):
    rows, df = frame(spark)
    got = D.checked_counts(df, {"org": F.col("org"), "country": F.col("country")}, {"users": F.col("user")}).collect()
    assert got and all(r["users_within"] for r in got)
    assert {r["users"] for r in got if r["level"] == ""} == {len({r[2] for r in rows} - {None})}


def test_blank_groups_and_empty(spark):
    df = spark.createDataFrame([(1, None)], "org long, user string")
    got = D.distinct_counts(df, {"org": F.col("org")}, {"users": F.col("user")}).collect()
    assert sorted((r["level"], r["org"], r["users"]) for r in got) == [("", None, 0.0), ("org", 1, 0.0)]
    assert D.distinct_counts(df.limit(0), {"org": F.col("org")}, {"users": F.col("user")}).count() == 0
    assert D.distinct_counts(df, {}, {"users": F.col("user")}).collect()[0]["users"] == 0.0
