"""Names matched by tokens: inverted-index joins instead of comparing all with all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import match_tokens, normal
from .relops import top_k


def token_match(queries: DataFrame, people: DataFrame, qid: str, qname: str, pid: str, pname: str, least: int = 2, cover: bool = True) -> DataFrame:
    """``qid, pid, overlap``: the person that shares most tokens with the query.

    Ties go to the name with fewer tokens, then to the smaller id.  At least ``least`` tokens
    must agree, with ``cover`` all of the query's tokens but one."""
    q = queries.select(F.col(qid).alias("qid"), match_tokens(F.col(qname)).alias("qt"))
    p = people.select(F.col(pid).alias("pid"), match_tokens(F.col(pname)).alias("pt"))
    hits = (
        q.select("qid", F.size("qt").alias("nq"), F.explode("qt").alias("t"))
        .join(p.select("pid", F.size("pt").alias("np"), F.explode("pt").alias("t")), "t")
        .groupBy("qid", "pid").agg(F.count("*").alias("overlap"), F.first("nq").alias("nq"), F.first("np").alias("np"))
    )
    hits = hits.where((F.col("overlap") >= least) & ((F.col("overlap") >= F.col("nq") - 1) if cover else F.lit(True)))
    return top_k(hits, ["qid"], [F.desc("overlap"), F.asc("np"), F.asc("pid")], 1).select(F.col("qid").alias(qid), F.col("pid").alias(pid), "overlap")


def substring_match(queries: DataFrame, people: DataFrame, qid: str, qname: str, pid: str, pname: str) -> DataFrame:
    """``qid, pid, score``: candidates share a word of three letters; the score is the number of the
    query's words that are substrings of the name; one hit is enough for queries of up to two words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(normal(c), "[^a-z ]+", " ")), " +"), lambda x: F.length(x) >= 3))
    q = queries.select(F.col(qid).alias("qid"), words(F.col(qname)).alias("qw"))
    p = people.select(F.col(pid).alias("pid"), normal(F.col(pname)).alias("nm"), words(F.col(pname)).alias("pw"))
    met = q.select("qid", "qw", F.explode("qw").alias("w")).join(p.select("pid", "nm", F.explode("pw").alias("w")), "w").select("qid", "qw", "pid", "nm").distinct()
    scored = met.withColumn("score", F.size(F.filter("qw", lambda w: F.contains(F.col("nm"), w)))).where(F.col("score") >= F.when(F.size("qw") <= 2, 1).otherwise(2))
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("pid")], 1).select(F.col("qid").alias(qid), F.col("pid").alias(pid), "score")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; two empty sets are unlike."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def organization_tokens(c: Column) -> Column:
    """Words of an organisation's name, each once: lower case without accents and signs, small words left out."""
    words = F.split(F.trim(F.regexp_replace(normal(c), r"[^a-z0-9\s]", "")), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*rules.ORGANIZATION_STOP)))


def organization_prefix(c: Column) -> Column:
    """The structural prefix of a name, the first of the list."""
    return F.coalesce(*[F.when(F.startswith(F.lower(c), F.lit(p)), F.lit(p)) for p in rules.ORGANIZATION_PREFIXES])


def _alike(sets: DataFrame, least: float, within: Sequence[str] = ()) -> DataFrame:
    """``a, b, similarity`` of names whose sets ``t`` are alike enough.

    Two sets of that similarity share one of the rarest words of each, so many as the
    threshold leaves, and meet in those words only: a word that a third of all names hold
    is reached by hardly any set."""
    words = sets.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    told = sets.select("n", F.explode("t").alias("w")).join(words, "w").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("o"))
    keep = F.size("t") - F.ceil(F.lit(least) * F.size("t") - F.lit(1e-9)).cast("int") + 1
    keyed = sets.join(told, "n").select("n", "t", *within, F.explode(F.transform(F.slice("o", 1, keep), lambda x: x["w"])).alias("w"))
    a, b = (keyed.select("w", *within, F.col("n").alias(s), F.col("t").alias(f"t{s}")) for s in "ab")
    near = (F.col("a") < F.col("b")) & (F.size("ta") >= least * F.size("tb") - 1e-9) & (F.size("tb") >= least * F.size("ta") - 1e-9)
    met = a.join(b, ["w", *within]).where(near).dropDuplicates(["a", "b"])
    return met.select("a", "b", F.round(jaccard(F.col("ta"), F.col("tb")), 6).alias("similarity")).where(F.col("similarity") >= least)


def similar_names(df: DataFrame, name: str, least_same: float = 0.6, least_other: float = 0.7) -> DataFrame:
    """``a, b, similarity``: different names whose words are alike enough.

    Names with the same structural prefix are compared without it, others in full."""
    names = df.where(F.col(name).isNotNull()).select(F.col(name).alias("n")).distinct()
    names = names.select("n", organization_tokens(F.col("n")).alias("t"), organization_prefix(F.col("n")).alias("p"))
    content = names.where("p is not null").select("n", F.array_except("t", F.split("p", " ")).alias("t"), "p").where(F.size("t") > 0)
    same = _alike(content, least_same, ["p"])
    prefixes = names.select(F.col("n").alias("a"), F.col("p").alias("pa")), names.select(F.col("n").alias("b"), F.col("p").alias("pb"))
    other = _alike(names.where(F.size("t") > 0).select("n", "t"), least_other).join(prefixes[0], "a").join(prefixes[1], "b").where("pa is null or pb is null or pa <> pb")
    return same.unionByName(other.select("a", "b", "similarity"))


def surname_pairs(egos: DataFrame, people: DataFrame, pid: str, name: str) -> DataFrame:
    """``ego_id, alter_id, shared``: people who share a surname token with an ego, each unordered pair once."""
    sur = lambda c: match_tokens(F.element_at(F.split(c, ",", 2), 1))
    e = egos.select(F.col(pid).alias("e"), F.explode(sur(F.col(name))).alias("t"))
    p = people.select(F.col(pid).alias("p"), F.explode(sur(F.col(name))).alias("t"))
    met = e.join(p, "t").where("e <> p")
    return met.groupBy(F.least("e", "p").alias("x"), F.greatest("e", "p").alias("y")).agg(F.min("e").alias("ego_id"), F.min("t").alias("shared")).select(
        "ego_id", F.when(F.col("ego_id") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("alter_id"), "shared")
