"""Joins over closed year intervals; always with an equality key, so no nested loop is planned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column, within: int = 0) -> Column:
    """Whether two closed intervals meet, or miss each other by at most ``within``."""
    return (a0 <= b1 + within) & (b0 <= a1 + within)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], within: int = 0) -> DataFrame:
    """Pairs of equal keys whose intervals overlap.  The equality keys carry the join, the
    interval condition is checked where they meet."""
    return left.join(right, list(keys)).where(overlaps(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1]), within))


def bucketed_overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], within: int = 0, width: int = 10) -> DataFrame:
    """The same pairs for keys with very many intervals: both sides are cut into buckets of
    ``width`` years, meet per bucket, and a pair counts in the bucket of its later start only.
    Reversed years reach from the lesser to the greater one."""

    def cut(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        low, high = F.least(*ends), F.greatest(*ends) + within
        return df.where(low.isNotNull()).withColumn("_bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))

    met = cut(left, a).join(cut(right, b), [*keys, "_bucket"]).where(overlaps(F.col(a[0]), F.col(a[1]), F.col(b[0]), F.col(b[1]), within))
    later = F.greatest(F.least(*a), F.least(*b))
    return met.where(F.col("_bucket") == F.floor(later / width)).drop("_bucket")


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, band: int) -> DataFrame:
    """Pairs of equal keys whose values differ by at most ``band``; both sides meet in cells of
    that width, a value looks into its own and the two neighbouring cells."""
    lb = left.withColumn("_cell", F.floor(F.col(a) / band))
    rb = right.withColumn("_cell", F.explode(F.array(*[F.floor(F.col(b) / band) + d for d in (-1, 0, 1)])))
    return lb.join(rb, [*keys, "_cell"]).where(F.abs(F.col(a) - F.col(b)) <= band).drop("_cell")


def best_in_years(queries: DataFrame, records: DataFrame, key: str, year: str, start: str, end: str, score: str, seq: str, value: str, default: str = "") -> DataFrame:
    """``key, year, value``: of the records that cover the year, the one with the highest score; the first wins ties.

    Every record is expanded over the asked years it covers, so the join is an equality on (key, year)."""
    spans = records.where(F.col(start).isNotNull()).withColumn("_e", F.coalesce(end, start)).where(F.col(start) <= F.col("_e"))
    cover = spans.withColumn(year, F.explode(F.sequence(F.col(start), F.col("_e"))))
    best = cover.join(queries.select(key, year).distinct(), [key, year], "left_semi").groupBy(key, year).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(seq).alias("q"), F.col(value).alias("v")))["v"].alias(value))
    return queries.join(best, [key, year], "left").na.fill({value: default})
