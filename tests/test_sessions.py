import datetime as dt
import random

import pytest

from lamina.operators.sessions import DAY_US, HALF_HOUR_US, sessionize

SCHEMA = "event_id long, timestamp timestamp_ntz, user_id string, event_type string, start_us string, k int"
EPOCH = dt.datetime(1970, 1, 1)


def us(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def brute(rows, gap=HALF_HOUR_US):
    by = {}
    for e, t, u in {(r[0], r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None and r[2].strip()}:
        by.setdefault(u, []).append(us(t))
    out = []
    for u, times in by.items():
        times.sort()
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last > gap:
                out.append((u, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((u, start, last, n))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def found(spark, rows, **how):
    df = sessionize(frame(spark, rows), "user_id", "timestamp", "event_id", **how)
    return sorted((r["user_id"], r["start_us"], r["end_us"], r["n_events"]) for r in df.collect())


def test_against_brute_force(spark):
    random.seed(3)
    rows = []
    for k in range(4000):
        t = EPOCH + dt.timedelta(days=17_000, minutes=random.choice([0, 1, 29, 30, 31]) * random.randint(0, 400), microseconds=random.choice([0, 0, 1]))
        rows.append((random.randint(0, 3000) if random.random() < 0.1 else 10_000 + k, random.choice([t, t, t, None]), random.choice(["a", "b", "hot", "hot", "hot", None, "", "  "]), random.choice(["v", "c", None])))
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, bucket_us=HALF_HOUR_US) == brute(rows)  # every session crosses borders


def test_pause_of_exactly_the_gap_and_borders_of_buckets(spark):
    border = EPOCH + dt.timedelta(microseconds=20_000 * DAY_US)
    gap = dt.timedelta(microseconds=HALF_HOUR_US)
    rows = [(1, border - gap, "u", "v"), (2, border, "u", "v"), (3, border + gap, "u", "c"), (4, border + 2 * gap + dt.timedelta(microseconds=1), "u", "v"), (4, border + 2 * gap + dt.timedelta(microseconds=1), "u", "v")]
    assert found(spark, rows) == [("u", us(border - gap), us(border + gap), 3), ("u", us(border + 2 * gap) + 1, us(border + 2 * gap) + 1, 1)]


def test_times_before_1970_and_null_types(spark):
    t = dt.datetime(1969, 12, 31, 23, 50)
    rows = [(1, t, "u", None), (2, t + dt.timedelta(minutes=20), "u", "v"), (3, t + dt.timedelta(minutes=20), "u", None)]
    assert found(spark, rows) == [("u", -600_000_000, 600_000_000, 3)]
    typed = sessionize(frame(spark, rows), "user_id", "timestamp", "event_id", "event_type").collect()
    assert sorted((r["event_type"] or "", r["n_events"], r["start_us"], r["end_us"], r["duration_us"]) for r in typed) == [("", 2, -600_000_000, 600_000_000, 1_200_000_000), ("v", 1, -600_000_000, 600_000_000, 1_200_000_000)]


def test_empty_and_bad_options(spark):
    assert found(spark, []) == []
    with pytest.raises(ValueError):
        sessionize(frame(spark, []), "user_id", "timestamp", "event_id", bucket_us=1)


def test_two_shuffles(spark):
    plan = sessionize(frame(spark, []), "user_id", "timestamp", "event_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
