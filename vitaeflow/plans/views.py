"""Views that several queries share, once as frames and once as SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.relops import keep_first
from ..sources.tables import table


def _once(df: DataFrame, columns: Sequence[str], latest: str | None = None) -> DataFrame:
    """One row per record: the latest delivery, of equal ones the greatest; formed before the shuffle."""
    order = [latest] if latest in df.columns else []
    kept = df.groupBy("record_id").agg(F.max(F.struct(*order, *columns)).alias("r"))
    return kept.select("record_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def positions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Positions, each record once as delivered last; only the named columns are read."""
    return _once(table(spark, d, "parsed_positions"), columns, "loaded_at")


def domain(spark: SparkSession, d: str, field_type: str, *columns: str) -> DataFrame:
    """Positions of one field type; the filter reaches the scan."""
    return _once(table(spark, d, "parsed_positions").where(F.col("field_type") == field_type), columns, "loaded_at")


def education(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _once(table(spark, d, "education"), columns)


EDGE_KEYS = ("ego_id", "alter_id", "edge_type", "focus", "year_start", "year_end")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Network edges, each once under its first number."""
    return keep_first(table(spark, d, "tapado_edges").drop("loaded_at"), EDGE_KEYS, ["seq"])


def egos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "roster").select("person_id").distinct()


_NOT_BEFORE = re.compile(r"^(?:(?P<other>.+)\|)?(?P<word>\\b\w+\\b)\(\?!(?P<after>.+)\)$")


def matches(c: str, pattern: str) -> str:
    """The SQL form of a pattern; a word that must not stand before another is looked for where those are blotted out."""
    quote = lambda p: p.replace("'", "''")
    m = _NOT_BEFORE.match(pattern)
    if not m:
        return f"regexp_matches({c}, '(?i){quote(pattern)}')"
    blotted = f"regexp_replace({c}, '(?i){quote(m['word'] + m['after'])}', chr(1), 'g')"
    word = f"regexp_matches({blotted}, '(?i){quote(m['word'])}')"
    return f"(regexp_matches({c}, '(?i){quote(m['other'])}') OR {word})" if m["other"] else word


def case(c: str, labels: Sequence[tuple[str, str]], default: str | None = None) -> str:
    """The SQL form of an ordered cascade."""
    arms = " ".join(f"WHEN {matches(c, p)} THEN '{label}'" for label, p in labels)
    return f"(CASE {arms} ELSE {'NULL' if default is None else chr(39) + default + chr(39)} END)"


def like(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({c}, '(?i){pattern}'), false)"


def order_case(c: str, ranks: dict[str, int]) -> str:
    return "(CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in ranks.items()) + " ELSE 99 END)"


def contained_sql(c: str, entries: Sequence[tuple[str, str]]) -> str:
    return "(CASE " + " ".join(f"WHEN contains({c}, '{k}') THEN '{v}'" for k, v in entries) + " END)"


def plain_sql(c: str) -> str:
    return f"strip_accents(lower({c}))"


def state_sql(c: str) -> str:
    states = sorted([(k.lower(), v) for k, v in rules.STATE_VARIANTS], key=lambda e: -len(e[0]))
    cities = sorted(rules.CITY_STATE.items(), key=lambda e: -len(e[0]))
    federal = " OR ".join(f"contains({plain_sql(c)}, '{k}')" for k in rules.FEDERAL_WORDS)
    return f"coalesce({contained_sql(plain_sql(c), states)}, CASE WHEN {federal} THEN 'Federal District' END, {contained_sql(plain_sql(c), cities)})"


YEARS_SQL = r"""try_cast(coalesce(nullif(regexp_extract({c}, '(\d{{4}})\s*[-–]\s*(\d{{4}})', {g}), ''), list_last(regexp_extract_all({c}, '\b(1[89]\d\d|20[0-2]\d)\b', 1))) AS INTEGER)"""
STRIP_SQL = r"""nullif(trim(regexp_replace(trim(regexp_replace(CASE WHEN regexp_matches({c}, '\d{{4}}\s*[-–]\s*\d{{4}}') THEN regexp_replace({c}, ',?\s*\d{{4}}\s*[-–]\s*\d{{4}}', '', 'g')
 ELSE regexp_replace({c}, ',\s*\b(1[89]\d\d|20[0-2]\d)\b\s*$', '') END, ',\s*$', '')), '\s{{2,}}', ' ', 'g')), '')"""
PP = "pp AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM parsed_positions)"
ED = "ed AS (SELECT DISTINCT * FROM education)"
EDGES = f"eg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(EDGE_KEYS)} ORDER BY seq) AS rn FROM tapado_edges) WHERE rn = 1)"
TOKENS_SQL = r"""list_distinct(list_filter(string_split_regex(trim(regexp_replace(strip_accents(lower({c})), '[^a-z ]+', ' ', 'g')), ' +'), lambda x: length(x) >= 3 AND x NOT IN ('de','la','del','los','las','y','e','van','von','jr','sr')))"""
