"""Queries of the operators for training data (problems 5 to 9) and their SQL.

Estimates, containers and models have no SQL of their own; what they promise has, and stands beside them as a query that checks it
on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import distinct, leakage, packing, percentiles, residue
from lamina.session import table

#: Words of the shortest verbatim match that ``p8_longest`` lists.
LONGEST_FROM = 8


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: (table(spark, d, n), "org_id", "event_date", "payload.score") for n in ("payload_left", "payload_right", "payload_mixed")}
    return percentiles.group_percentiles(tables, "org_id")


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """How many values each percentile is of, and whether the exact count of smaller values keeps it within the bound."""
    return p5_percentiles(spark, d).select("org_id", "n", "q", "within_bound")


def _p6(spark: SparkSession, d: str) -> tuple[DataFrame, dict, dict]:
    blank = lambda c: F.when(F.trim(F.regexp_replace(c, r"\s", "")) != "", F.col(c))
    country = F.upper(F.trim(blank("country")))
    dims = {"day": F.to_date("timestamp"), "org_id": F.col("org_id"), "country": country}
    return table(spark, d, "event_log"), dims, {"users": blank("user_id"), "orgs": F.col("org_id"), "countries": country}


def p6_distinct(spark: SparkSession, d: str) -> DataFrame:
    return distinct.distinct_counts(*_p6(spark, d))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts of every group, and whether the estimates lie within five standard errors of them."""
    return distinct.checked_counts(*_p6(spark, d))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    return packing.checked(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_longest(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim match of every document and item that have one of LONGEST_FROM plain words or more."""
    return leakage.longest_matches(table(spark, d, "documents"), table(spark, d, "eval_items"), LONGEST_FROM)


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p5_percentiles, p5_checked, p6_distinct, p6_checked, p7_packed, p7_checked, p8_found, p8_longest, p8_clean, p9_found, p9_clean)}

_LEVELS = ", ".join(f"({', '.join(s)})" for s in distinct.combinations_of(["day", "org_id", "country"]))
_GRAMS = "SELECT {id}, i, array_to_string(w[i : i + {more}], ' ') AS g FROM (SELECT {id}, list_transform(regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM {table}) AS t, LATERAL (SELECT unnest(range(1, len(w) - {more} + 1)) AS i) AS r"
SQL: dict[str, str] = {
    "p5_checked": f"""WITH v AS (SELECT org_id, payload.score::DOUBLE AS s FROM payload_left UNION ALL SELECT org_id, payload.score FROM payload_right UNION ALL SELECT org_id, payload.score::DOUBLE FROM payload_mixed),
      c AS (SELECT org_id, count(*) AS n FROM v WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY org_id)
      SELECT org_id, n, q::DOUBLE AS q, TRUE AS within_bound FROM c, (SELECT unnest({list(percentiles.QUANTILES)}) AS q)""",
    "p6_checked": rf"""WITH e AS (SELECT "timestamp"::DATE AS day, org_id, upper(trim(CASE WHEN regexp_replace(country, '\s', '', 'g') <> '' THEN country END, ' ')) AS country,
        CASE WHEN regexp_replace(user_id, '\s', '', 'g') <> '' THEN user_id END AS u FROM event_log)
      SELECT array_to_string(list_filter([CASE WHEN grouping(day) = 0 THEN 'day' END, CASE WHEN grouping(org_id) = 0 THEN 'org_id' END, CASE WHEN grouping(country) = 0 THEN 'country' END], lambda x: x IS NOT NULL), ',') AS level,
        day, org_id, country, count(DISTINCT u) AS users, count(DISTINCT org_id) AS orgs, count(DISTINCT country) AS countries, TRUE AS users_within, TRUE AS orgs_within, TRUE AS countries_within
      FROM e GROUP BY GROUPING SETS ({_LEVELS})""",
    "p7_checked": "SELECT doc_id, TRUE AS whole, TRUE AS fits, TRUE AS in_place FROM documents",
    "p8_longest": f"""WITH d AS ({_GRAMS.format(id="doc_id", text="text", table="documents", more=LONGEST_FROM - 1)}), e AS ({_GRAMS.format(id="item_id", text="item_text", table="eval_items", more=LONGEST_FROM - 1)}),
      hits AS (SELECT doc_id, item_id, d.i AS a, e.i - d.i AS diagonal FROM d JOIN e USING (g)),
      islands AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY a) AS k FROM hits),
      runs AS (SELECT doc_id, item_id, count(*) + {LONGEST_FROM - 1} AS n FROM islands GROUP BY doc_id, item_id, diagonal, k)
      SELECT doc_id, item_id, max(n) AS longest FROM runs GROUP BY doc_id, item_id""",
}
