"""Relational operators with stated order: keep-first, top-k, mode, best-by-order, change flags, upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given total order.

    An aggregation, not a window: partial minima are formed before the shuffle, so a key
    that holds a third of all rows moves one row per task."""
    row = F.struct(*order, *[c for c in df.columns if c not in (*keys, *order)])
    picked = df.groupBy(*keys).agg(F.min(row).alias("_row"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in df.columns])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_of_group(order: Column, value: Column) -> Column:
    """Value of the first row in ``order``, null if that row's value is null."""
    return F.min(F.struct(order.alias("o"), value.alias("v")))["v"]


def best_by_order(label: Column, ranks: Mapping[str, int], seq: Column, unknown: int = 99, skip: Sequence[str] = ()) -> Column:
    """Label of the best rank; labels without a rank count ``unknown``; the first row wins ties."""
    table = F.create_map(*[F.lit(x) for k, v in ranks.items() for x in (k, v)])
    ok = label.isNotNull() & ~label.isin(*skip) if skip else label.isNotNull()
    return F.min(F.when(ok, F.struct(F.coalesce(F.try_element_at(table, label), F.lit(unknown)).alias("r"), seq.alias("s"), label.alias("v"))))["v"]


def mode_first(df: DataFrame, key: str, value: str, seq: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value of each key; the value that appears first wins ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(seq).alias("s"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "s", F.col(value).alias("v")))["v"].alias(out))


def ever(condition: Column) -> Column:
    """1 if any row of the group fulfils the condition, else 0; unknown counts as no."""
    return F.max(F.when(condition, 1).otherwise(0))


def sorted_set(value: Column, sep: str = "|") -> Column:
    return F.nullif(F.array_join(F.array_sort(F.collect_set(value)), sep), F.lit(""))


def frequencies(df: DataFrame, key: str) -> DataFrame:
    """``key, n, pct`` of the non-null values."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("n") / F.col("_total"), 4)).drop("_total")


def changed(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """1 if any new value differs from its old one; null equals null only."""
    out = F.lit(False)
    for new, old in pairs:
        out = out | ~new.eqNullSafe(old)
    return out.cast("int")


def change_breakdown(df: DataFrame, old: str, new: str) -> DataFrame:
    """``old, new, n`` of the rows whose value changed; null groups are kept."""
    return df.where(~F.col(old).eqNullSafe(F.col(new))).groupBy(F.col(old).alias("old"), F.col(new).alias("new")).agg(F.count("*").alias("n"))


def upsert(df: DataFrame, fresh: DataFrame, replaced: Column) -> DataFrame:
    """Rows outside ``replaced`` and all fresh rows; missing columns become null."""
    return df.where(~F.coalesce(replaced, F.lit(False))).unionByName(fresh, allowMissingColumns=True)


def override(df: DataFrame, review: DataFrame, keys: Sequence[str], keep: Column, relabel: Mapping[str, Column]) -> DataFrame:
    """Rows a review keeps, with its labels where it gives some."""
    joined = df.join(review.where(keep), list(keys))
    for name, label in relabel.items():
        joined = joined.withColumn(name, F.coalesce(label, F.col(name)))
    return joined.select(*df.columns)


def with_verdicts(df: DataFrame, verdicts: DataFrame, keys: Sequence[str], defaults: Mapping[str, str]) -> DataFrame:
    """Answers of an external judge by key; a missing answer takes the default."""
    joined = df.join(verdicts.dropDuplicates(list(keys)), list(keys), "left")
    return joined.na.fill(dict(defaults))


def fill_from(df: DataFrame, answers: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Null fields taken from a table of answers; kept values stay."""
    a = answers.dropDuplicates([key]).select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(a, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}")))
    return out.select(*df.columns)


def surrogate_ids(df: DataFrame, key: str, order: str, out: str = "key_id") -> DataFrame:
    """``key, out``: rank of each key by first appearance, counted in range partitions.

    The rank is a prefix count over the ordered partitions, so no task sees all keys."""
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    return numbered(firsts, ["_first", key], out).drop("_first")


def numbered(df: DataFrame, order: Sequence[str], out: str = "row_id") -> DataFrame:
    """Rows numbered from 1 in a total order: range partitions, their sizes summed up, a count within each."""
    from ..session import cut_lineage

    parts = cut_lineage(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id()))
    sizes = parts.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    k = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return parts.join(F.broadcast(before), "_pid").withColumn(out, k + F.col("_before")).drop("_pid", "_before")


def split_entries(df: DataFrame, cell: str, sep: str = ";", least: int = 5, pos: str = "pos", entry: str = "entry") -> DataFrame:
    """One row per entry of a list in a cell, with its position; shorter entries fall away."""
    out = df.select("*", F.posexplode(F.split(cell, sep)).alias(pos, "_e")).withColumn(entry, F.trim("_e")).drop("_e")
    return out.where(F.length(entry) >= least)


def positional_wide(cell: Column, n: int, sep: str = ";") -> list[Column]:
    """The i-th entry of a list in a cell as its own column, null past the end."""
    parts = F.split(cell, sep)
    return [F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")) for i in range(n)]


def string_columns(df: DataFrame, f) -> DataFrame:
    """A function over all string columns."""
    return df.select(*[f(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def degenerate(c: Column) -> Column:
    """Texts whose letters are nothing or ``none``."""
    return F.coalesce(F.regexp_replace(F.lower(c), "[^a-z]", ""), F.lit("")).isin("", "none")


def focus_capped(df: DataFrame, focus: str, person: str, most: int, size: str = "focus_size") -> DataFrame:
    """Rows of the foci with at most ``most`` different persons, with that number."""
    sizes = df.where(F.col(focus).isNotNull()).groupBy(focus).agg(F.countDistinct(person).alias(size)).where(F.col(size) <= most)
    return df.join(sizes, focus)


def without_rows(df: DataFrame, unwanted: Column) -> DataFrame:
    """Rows for which a condition does not hold; where it is unknown the row stays."""
    return df.where(~F.coalesce(unwanted, F.lit(False)))
