import datetime as dt
import math

import numpy as np
import pytest

from lamina.llm import percentiles as P

SCHEMA = "event_id long, org_id long, event_date date, payload struct<score:double>, n int, q string"


def digest(values):
    v = np.sort(np.clip(np.array(values, float), -P.BIG, P.BIG))
    _, m, w = P.cluster(np.zeros(len(v), np.int64), v, np.ones(len(v), np.int64))
    return m, w, v[0], v[-1]


def rank_error(values, x, q):
    v = np.sort(values)
    lt, le = np.searchsorted(v, x, "left"), np.searchsorted(v, x, "right")
    return max(0, lt - q * len(v), q * len(v) - le) / len(v)


DISTRIBUTIONS = {
    "uniform": lambda r, n: r.random(n), "ties": lambda r, n: r.integers(0, 5, n), "constant": lambda r, n: np.full(n, 7.0), "tail": lambda r, n: r.pareto(0.3, n), "peaks": lambda r, n: np.r_[r.normal(-1e6, 1, n // 2), r.normal(1e6, 1, n - n // 2)],
    "extreme": lambda r, n: r.choice([-1.7e308, 1.7e308, 0, 1e-300], n), "sorted": lambda r, n: np.arange(n) * 1.0,
}


@pytest.mark.parametrize("name", DISTRIBUTIONS)
@pytest.mark.parametrize("n", [1, 2, 50, 30_000])
def test_rank_error_of_merged_digests(name, n):
    values = DISTRIBUTIONS[name](np.random.default_rng(1), n).astype(float)
    parts = [digest(p) for p in np.array_split(values, min(n, 23)) if len(p)]
    order = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
    m, w = np.concatenate([p[0] for p in parts])[order], np.concatenate([p[1] for p in parts])[order]
    _, m, w = P.cluster(np.zeros(len(m), np.int64), m, w)
    assert len(m) <= P.DELTA and w.sum() == n and (np.diff(m) >= 0).all()
    for q in (0, *P.QUANTILES, 1):
        x = P.quantile(m, w, values.min(), values.max(), q)
        assert math.isfinite(x) and rank_error(values, x, q) <= P.BOUND + 1 / n


def frame(spark, rows):
    return spark.createDataFrame([(k, o, d, None if s == "no payload" else (s,), 1, "x") for k, (o, d, s) in enumerate(rows)], SCHEMA)


def test_groups_over_tables(spark):
    rnd = np.random.default_rng(2)
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]
    rows = [(int(rnd.choice([1, 1, 1, 2, 3])), days[rnd.integers(3)], float(rnd.normal())) for _ in range(6000)]
    rows += [(4, days[0], None), (4, days[0], float("nan")), (4, days[0], "no payload"), (5, days[1], 2.5), (6, days[0], float("inf")), (6, days[0], 1.0), (None, days[0], 3.0)]
    half = len(rows) // 2
    tables = {n: (frame(spark, r).repartition(5), "org_id", "event_date", "payload.score") for n, r in (("a", rows[:half]), ("b", rows[half:]), ("c", []))}
    got = P.group_percentiles(tables, "org_id").collect()
    assert {r["org_id"] for r in got} == {1, 2, 3, 5, 6, None} and all(r["within_bound"] for r in got) and len(got) == 6 * len(P.QUANTILES)
    for r in got:
        own = np.array([s for o, _, s in rows if o == r["org_id"] and isinstance(s, float) and not math.isnan(s)])
        assert r["n"] == len(own) and r["below"] == (own < r["value"]).sum() and abs(r["rank_error"] - rank_error(np.clip(own, -P.BIG, P.BIG), r["value"], r["q"])) < 1e-9
    assert {r["value"] for r in got if r["org_id"] == 5} == {2.5}


def test_order_of_merging_keeps_counts_and_bounds(spark):
    rows = [(k % 7, dt.date(2024, 1, 1 + k % 5), float(k % 1000)) for k in range(20_000)]
    partial = P.digests(frame(spark, rows).selectExpr("org_id", "event_date", "payload.score as v"), ["org_id", "event_date"], "v")
    one = P.merged(partial, ["org_id"])
    two = P.merged(P.merged(partial, ["org_id", "event_date"], 3), ["org_id"])
    for d in (one, two):
        assert {r["org_id"]: r["n"] for r in d.collect()} == {k: len(range(k, 20_000, 7)) for k in range(7)}


def test_keys_that_miss_the_bound_are_digested_again(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = [(k % 2, dt.date(2024, 1, 1 + k % 5), float(rnd.normal())) for k in range(20_000)] + [(None, None, 1.0)]
    table = {"a": (frame(spark, rows).repartition(7), "org_id", "event_date", "payload.score")}
    monkeypatch.setattr(P, "REFINEMENTS", 0)
    rough = P.group_percentiles(table, "org_id", bound=2e-5).collect()
    monkeypatch.setattr(P, "REFINEMENTS", 3)
    fine = P.group_percentiles(table, "org_id", bound=2e-5).collect()
    assert not all(r["within_bound"] for r in rough) and all(r["within_bound"] for r in fine) and len(rough) == len(fine) == 21


def test_empty(spark):
    assert P.group_percentiles({"a": (frame(spark, []), "org_id", "event_date", "payload.score")}, "org_id").count() == 0
