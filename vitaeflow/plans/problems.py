"""Queries of the general data problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.periods import continuous_periods
from ..operators.skew import dominant_keys, grouped_by_hot_key
from ..sources.tables import table
from ..streaming.periods import settled_periods

#: Share of the rows from which a value counts as dominating.
HEAVY_SHARE = 0.02


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods and gaps of every person."""
    return continuous_periods(table(spark, d, "parsed_positions"), "person_id", "year_start", "year_end")


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per person: number of periods and gaps, years covered and open, longest gap."""
    length = F.col("year_to") - F.col("year_from") + 1
    is_gap = F.col("kind") == "gap"
    return (
        p1_found(spark, d)
        .groupBy("person_id")
        .agg(
            F.sum(F.when(is_gap, 0).otherwise(1)).alias("n_periods"),
            F.sum(F.when(is_gap, 1).otherwise(0)).alias("n_gaps"),
            F.sum(F.when(is_gap, 0).otherwise(length)).alias("years_covered"),
            F.sum(F.when(is_gap, length).otherwise(0)).alias("years_open"),
            F.max(F.when(is_gap, length).otherwise(0)).alias("longest_gap"),
        )
    )


def p1_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same periods and gaps from a stream over the positions, kept per person in keyed state."""
    rows = spark.readStream.schema(table(spark, d, "parsed_positions").schema).parquet(f"{d}/parsed_positions.parque[t]")
    return settled_periods(rows, "person_id", "year_start", "year_end")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The dominating foci and schools."""
    parts = [
        dominant_keys(table(spark, d, t), key, order, HEAVY_SHARE).select(F.lit(t).alias("table_name"), F.col("key").alias("key_value"))
        for t, key, order in (("tapado_edges", "focus", "seq"), ("education", "organization", "record_id"))
    ]
    return parts[0].unionByName(parts[1])


def p5_focus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per focus: rows, first and last edge, widest step between successive edges."""
    return grouped_by_hot_key(table(spark, d, "tapado_edges"), "focus", "seq").withColumnRenamed("key", "focus")


def p5_school_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per school: rows, records, first and last record, widest step between successive records."""
    return grouped_by_hot_key(table(spark, d, "education"), "organization", "record_id").withColumnRenamed("key", "organization")


QUERIES = {f.__name__: f for f in (p1_found, p1_coverage, p1_stream, p5_found, p5_focus_stats, p5_school_stats)}

_SPANS = """
WITH r AS (SELECT DISTINCT person_id, least(year_start, coalesce(year_end, year_start)) AS lo, greatest(year_start, coalesce(year_end, year_start)) AS hi
           FROM parsed_positions WHERE year_start IS NOT NULL AND person_id IS NOT NULL),
m AS (SELECT *, max(hi) OVER (PARTITION BY person_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT person_id, k, min(lo) AS a, max(hi) AS b FROM g GROUP BY person_id, k),
n AS (SELECT *, lead(a) OVER (PARTITION BY person_id ORDER BY k) AS nxt FROM p),
found AS (SELECT person_id, 'period' AS kind, CAST(a AS BIGINT) AS year_from, CAST(b AS BIGINT) AS year_to FROM n
          UNION ALL SELECT person_id, 'gap', CAST(b + 1 AS BIGINT), CAST(nxt - 1 AS BIGINT) FROM n WHERE nxt IS NOT NULL)
"""

_STEPS = """
WITH s AS (SELECT {key}, {order} - lag({order}) OVER (PARTITION BY {key} ORDER BY {order}) AS step, {order} AS o FROM {table} WHERE {key} IS NOT NULL)
SELECT {key}, count(*) AS n_rows, min(o) AS first_order, max(o) AS last_order, coalesce(max(step), 0) AS widest_step, count(DISTINCT o) AS n_orders FROM s GROUP BY {key}
"""

ORACLE = {
    "p1_found": _SPANS + "SELECT * FROM found",
    "p1_stream": _SPANS + "SELECT * FROM found",
    "p1_coverage": _SPANS
    + """SELECT person_id, CAST(sum(CASE WHEN kind = 'gap' THEN 0 ELSE 1 END) AS BIGINT) AS n_periods, CAST(sum(CASE WHEN kind = 'gap' THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps,
    CAST(sum(CASE WHEN kind = 'gap' THEN 0 ELSE year_to - year_from + 1 END) AS BIGINT) AS years_covered, CAST(sum(CASE WHEN kind = 'gap' THEN year_to - year_from + 1 ELSE 0 END) AS BIGINT) AS years_open,
    CAST(max(CASE WHEN kind = 'gap' THEN year_to - year_from + 1 ELSE 0 END) AS BIGINT) AS longest_gap FROM found GROUP BY person_id""",
    "p5_found": """SELECT 'tapado_edges' AS table_name, focus AS key_value FROM tapado_edges WHERE focus IS NOT NULL GROUP BY focus HAVING count(*) >= 0.02 * (SELECT count(focus) FROM tapado_edges)
    UNION ALL SELECT 'education', organization FROM education WHERE organization IS NOT NULL GROUP BY organization HAVING count(*) >= 0.02 * (SELECT count(organization) FROM education)""",
    "p5_focus_stats": _STEPS.format(key="focus", order="seq", table="tapado_edges"),
    "p5_school_stats": _STEPS.format(key="organization", order="record_id", table="education"),
}
