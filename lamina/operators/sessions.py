"""Sessions of activity: events of one key without a pause longer than the gap.

A sweep line adds one at each event and takes one off at event plus gap; where the running sum falls to zero a session
closes. The line is cut into buckets of time, so that a busy key is spread over as many tasks as it has buckets: an
event whose interval reaches into the next bucket is handed on to it, where it opens the sum and takes its one off.
Every bucket is thus swept alone, after one shuffle by (key, bucket); what leaves it is one fragment per session and
bucket, and only fragments are shuffled by key to be joined where a bucket border lay inside a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import micros

HALF_HOUR_US = 30 * 60 * 1_000_000
DAY_US = 24 * 60 * 60 * 1_000_000


def sessionize(df: DataFrame, key: str, timestamp: str, event_id: str, event_type: str | None = None,
               gap_us: int = HALF_HOUR_US, bucket_us: int = DAY_US) -> DataFrame:
    """One row per session (and ``event_type``, if given): key, ``start_us``, ``end_us``, ``duration_us``, ``n_events``.

    With ``event_type``, start, end and duration are the session's and ``n_events`` counts the events of that type.

    Defined results: rows with null timestamp or null or blank key are left out; a null ``event_id`` counts as an event
    of its own only once per key, timestamp and type; copies (equal id, key and timestamp) count once; events at the
    same time lie in one session; a pause of exactly the gap doesn't end a session; a null type is a type of its own. A
    bucket must not be shorter than the gap. An empty table gives an empty one; other columns are ignored.
    """
    if bucket_us < gap_us or gap_us <= 0:
        raise ValueError("the bucket must be at least as long as the gap, and the gap positive")
    typed = event_type is not None
    events = df.select(
        F.col(key).alias("k"), micros(df, timestamp).alias("t"), F.col(event_id).alias("e"),
        *([F.col(event_type).alias("y")] if typed else []),
    ).filter(F.col("t").isNotNull() & F.col("k").isNotNull() & (F.trim(F.regexp_replace(F.col("k").cast("string"), r"\s", "")) != ""))
    bucket = F.expr(f"(t - pmod(t, {bucket_us}L)) div {bucket_us}L")
    events = events.withColumn("b", bucket)
    # The event in its own bucket; in the next one too if its interval reaches there.
    reaches = F.expr(f"t + {gap_us}L >= (b + 1) * {bucket_us}L")
    events = events.withColumn("b", F.explode(F.when(reaches, F.array(F.col("b"), F.col("b") + 1)).otherwise(F.array(F.col("b")))))
    events = events.repartition("k", "b").dropDuplicates(["k", "b", "t", "e", *(["y"] if typed else [])])
    # Deltas: d is +1 or -1 at time x; "own" marks the event itself.
    start = F.expr(f"b * {bucket_us}L")
    end = F.expr(f"(b + 1) * {bucket_us}L")
    carried = F.col("t") < start
    closes = F.expr(f"t + {gap_us}L")
    opening = F.struct(F.greatest(F.col("t"), start).alias("x"), F.lit(1).alias("d"), (~carried).cast("int").alias("own"))
    closing = F.struct(closes.alias("x"), F.lit(-1).alias("d"), F.lit(0).alias("own"))
    deltas = events.select("k", "b", *(["y"] if typed else []), F.explode(F.when(carried | (closes < end), F.array(opening, closing)).otherwise(F.array(opening))).alias("s"))
    deltas = deltas.select("k", "b", *(["y"] if typed else []), F.col("s.x").alias("x"), F.col("s.d").alias("d"), F.col("s.own").alias("own"))
    # Openings come before closings at the same time, carried ones first.
    line = Window.partitionBy("k", "b").orderBy(F.col("x"), F.col("d").desc(), F.col("own"))
    swept = deltas.withColumn("open", F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    begins = (F.col("own") == 1) & (F.coalesce(F.col("open"), F.lit(0)) == 0)
    swept = swept.withColumn("f", F.max(F.when(begins, F.col("x"))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    # Fragments. A null f is one that goes on from the bucket before.
    pieces = swept.filter("own = 1").groupBy("k", "b", "f", *(["y"] if typed else [])).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("k").orderBy("b", F.col("f").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = pieces.withColumn("start_us", F.max("f").over(order))
    sessions = joined.groupBy("k", "start_us", *(["y"] if typed else [])).agg(F.max("hi").alias("end_us"), F.sum("n").alias("n_events"))
    if typed:
        sessions = sessions.withColumn("end_us", F.max("end_us").over(Window.partitionBy("k", "start_us")))
    return sessions.select(F.col("k").alias(key), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), *([F.col("y").alias(event_type)] if typed else []), F.col("n_events").cast("bigint").alias("n_events"))
