"""Names that stand word for word in large texts: a telling word of the name meets the words of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal


def _flat(c: Column) -> Column:
    """Words of a text between single blanks, one before and one after, accents and case aside."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(normal(c), r"[^a-z0-9]+", " ")), F.lit(" "))


def names_in_texts(names: DataFrame, name: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    """``name, key``: names whose words stand in sequence in the text.

    A name meets the texts that hold its longest word (the first of equals); where they meet
    the whole name is looked for.  Small words therefore never make candidates, and neither
    all texts nor all names are compared.  Nulls and names without a word match nothing."""
    n = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct().withColumn("flat", _flat(F.col("name"))).where("trim(flat) <> ''")
    longest = F.array_max(F.transform(F.split(F.trim("flat"), " "), lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    n = n.withColumn("word", longest)
    t = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), _flat(F.col(text)).alias("full"))
    words = t.select("key", F.explode(F.split(F.trim("full"), " ")).alias("word"))
    met = words.join(n, "word").select("name", "flat", "key").distinct()
    return met.join(t, "key").where(F.contains("full", "flat")).select(F.col("name").alias(name), F.col("key").alias(key)).distinct()
