"""Graph operators: connected components, edge and node tables, hubs and ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node that has an edge; the component is its smallest node.

    Alternating large-star and small-star rounds: every round is two shuffles over at
    most the number of edges, the number of rounds grows with the logarithm of the
    diameter, and neither a component nor the edge list is ever gathered in one place.
    A star centre with very many leaves is handled by the aggregation's partial step,
    since only the minimum of a neighbourhood is needed.  Self-loops and nulls are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut_lineage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    done = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        fresh = cut_lineage(small)
        state = fresh.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        e = fresh
        if state == done:
            break
        done = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()


def canonical_names(names: DataFrame, pairs: DataFrame, name: str, seq: str) -> DataFrame:
    """``name, canonical``: of each cluster of paired names the longest, the first seen among equals.

    ``names`` has one row per name with its first appearance."""
    comp = connected_components(pairs.select("a", "b"))
    grouped = names.join(comp.withColumnRenamed("node", name), name, "left").withColumn("component", F.coalesce("component", F.col(name)))
    best = grouped.groupBy("component").agg(F.max(F.struct(F.length(name).alias("l"), (-F.col(seq)).alias("s"), F.col(name).alias("n")))["n"].alias("canonical"))
    return grouped.join(best, "component").select(name, "canonical")


def co_location(records: DataFrame, egos: DataFrame, focus: str, person: str, start: str, end: str, role: str, most: int, within: int = 1) -> DataFrame:
    """Edges of egos to those who were at the same focus at overlapping times.

    ``records`` needs focus, person, start, end and role.  Foci with more than ``most``
    different persons are left out before the join, which bounds every ego's fan-out; the
    egos are cut out by a semi join first."""
    from .intervals import overlaps
    from .relops import focus_capped

    rec = focus_capped(records.where(F.col(focus).isNotNull() & F.col(start).isNotNull()).withColumn(end, F.coalesce(end, start)), focus, person, most)
    mine = rec.join(egos.select(F.col(person)).distinct(), person, "left_semi")
    e = mine.select(F.col(focus), "focus_size", F.col(person).alias("ego_id"), F.col(start).alias("_e0"), F.col(end).alias("_e1"), F.col(role).alias("ego_role"))
    a = rec.select(F.col(focus), F.col(person).alias("alter_id"), F.col(start).alias("_a0"), F.col(end).alias("_a1"), F.col(role).alias("alter_role"))
    met = e.join(a, focus).where((F.col("ego_id") != F.col("alter_id")) & overlaps(F.col("_e0"), F.col("_e1"), F.col("_a0"), F.col("_a1"), within))
    return met.select("ego_id", "alter_id", F.col(focus), "focus_size", "ego_role", "alter_role", F.greatest("_e0", "_a0").alias("year_start"), F.least("_e1", "_a1").alias("year_end"))


def nodes(edges: DataFrame, people: DataFrame, roster: DataFrame) -> DataFrame:
    """Node table of an edge list: name, whether the node is an ego, its elections and whether it won one."""
    ids = edges.select(F.col("ego_id").alias("person_id")).union(edges.select("alter_id")).where("person_id is not null").distinct()
    names = people.groupBy("person_id").agg(F.min("person_name").alias("name"))
    runs = roster.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("election").cast("string"))), ";").alias("election_year"), F.max("is_winner").alias("is_winner"))
    return ids.join(names, "person_id", "left").join(runs, "person_id", "left").select("person_id", "name", F.col("election_year").isNotNull().cast("int").alias("is_ego"), "election_year", F.coalesce("is_winner", F.lit(0)).alias("is_winner"))


def degrees(edges: DataFrame) -> DataFrame:
    """Per ego: edges and different alters."""
    return edges.groupBy("ego_id").agg(F.count("*").alias("n_edges"), F.countDistinct("alter_id").alias("n_alters"))


def popularity(edges: DataFrame) -> DataFrame:
    """Per alter: different egos."""
    return edges.groupBy("alter_id").agg(F.countDistinct("ego_id").alias("n_egos"))


def primary_ties(edges: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Per ego and alter the tie of the highest priority, the first among equals."""
    table = F.create_map(*[F.lit(x) for k, v in priority.items() for x in (k, v)])
    rank = F.coalesce(F.try_element_at(table, F.col("edge_type")), F.lit(99))
    return edges.groupBy("ego_id", "alter_id").agg(F.min(F.struct(rank.alias("p"), F.col("seq").alias("s"), F.col("edge_type").alias("t"), F.col("alter_name").alias("n"))).alias("m")).select("ego_id", "alter_id", F.col("m.n").alias("alter_name"), F.col("m.t").alias("edge_type"), F.col("m.p").alias("priority"))


def compared_hubs(ties: DataFrame, one: int, other: int) -> DataFrame:
    """Alters of two egos by side (shared, first only, second only) with their tie to each."""
    a = ties.where(F.col("ego_id") == one).select("alter_id", "alter_name", F.col("edge_type").alias("tie_one"), F.col("priority").alias("p1"))
    b = ties.where(F.col("ego_id") == other).select("alter_id", F.col("alter_name").alias("name2"), F.col("edge_type").alias("tie_other"), F.col("priority").alias("p2"))
    j = a.join(b, "alter_id", "full_outer")
    side = F.when(F.col("tie_one").isNotNull() & F.col("tie_other").isNotNull(), "shared").when(F.col("tie_one").isNotNull(), "one").otherwise("other")
    return j.select("alter_id", F.coalesce("alter_name", "name2").alias("alter_name"), side.alias("side"), "tie_one", "tie_other", F.least("p1", "p2").alias("priority"))


def stacked(df: DataFrame, group: str, order: list, height: float = 2.0) -> DataFrame:
    """Even vertical positions of the members of each group, from half the height down to minus half."""
    w = Window.partitionBy(group)
    k, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return df.withColumn("y", F.when(n > 1, F.round(height / 2 - height * k / (n - 1), 6)).otherwise(F.lit(height / 2)))
