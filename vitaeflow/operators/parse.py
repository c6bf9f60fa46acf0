"""Semi-structured biographies: splitting, names rebuilt from their neighbours, entries to dated records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .relops import numbered, split_entries

# Letters that mark the fields of a biography.
FIELDS = {
    "a": "birth_date", "b": "birthplace", "c": "education", "d": "public_positions", "e": "party_positions", "f": "govt_positions", "g": "labor_positions", "h": "other_positions", "i": "personal_info", "j": "field_j", "k": "field_k", "l": "sources",
}
ENTRY_FIELDS = ("public_positions", "party_positions", "govt_positions", "labor_positions", "other_positions", "education")
MARK = r"(?<![\p{L}\p{N}_])([a-l])[-–—]"


def split_biographies(df: DataFrame, text: str = "value", key: str = "path") -> DataFrame:
    """One row per biography of a whole text: its position, name and lettered fields.

    A biography starts at an ``a`` mark; its name is what stands before it on the line, or
    the line above (with the line above that, if a parenthesis was broken).  Of a field that
    comes twice the last one counts."""
    def pairs(body: Column) -> Column:
        parts = F.split(body, r"(?<![\p{L}\p{N}_])a[-–—]")
        n = F.size(parts) - 1
        return F.zip_with(F.slice(parts, 1, n), F.slice(parts, 2, n), lambda x, y: F.struct(x.alias("before"), y.alias("chunk")))

    found = X.bound(X.join_broken_words(X.page_noise(F.col(text))), pairs)
    chunks = df.select(F.col(key).alias("source_key"), F.posexplode(found).alias("k", "x")).select("source_key", (F.col("k") + 1).cast("long").alias("bio_row"), "x.before", "x.chunk")
    lines = F.filter(F.split("before", r"\n"), lambda x: F.trim(x) != "")
    # the name of the next biography stands at the end of this chunk and is cut off
    own = F.regexp_replace(F.concat(F.lit("a-"), F.col("chunk")), r"\s+", " ")
    marked = F.split(F.regexp_replace(own, MARK, "\u0001$1\u0002"), "\u0001")
    held = chunks.select("source_key", "bio_row", F.trim(F.try_element_at(lines, F.lit(-1))).alias("last"), F.trim(F.try_element_at(lines, F.lit(-2))).alias("prior"), F.filter(marked, lambda e: F.contains(e, F.lit("\u0002"))).alias("entries"))
    last, prior = F.col("last"), F.col("prior")
    broken = last.contains(")") & ~last.contains("(") & prior.contains("(") & ~prior.contains(")")
    name = F.when(broken, F.concat_ws(" ", prior, last)).otherwise(last)

    def field(letter: str) -> Column:
        mine = F.filter("entries", lambda e: F.startswith(e, F.lit(letter + "\u0002")))
        return F.trim(F.get(F.split(F.try_element_at(mine, F.lit(-1)), "\u0002"), F.lit(1)))

    return held.select("source_key", "bio_row", name.alias("name"), *[field(k).alias(v) for k, v in FIELDS.items()])


def rebuilt_names(df: DataFrame, order: str, name: str = "name", before: str = "sources", partition: str | None = None) -> DataFrame:
    """Names that were torn from their start, put together with the end of the previous row's field.

    The part after the last digit of the previous row's ``before`` is the start of the name.
    Rows are taken in order within ``partition`` (one biography file), or else over the whole table."""
    columns = df.columns
    if partition:
        df = df.withColumn("_prior", F.lag(before).over(Window.partitionBy(partition).orderBy(order)))
    else:
        n = numbered(df, [order], "_k")
        df = n.join(n.select((F.col("_k") + 1).alias("_k"), F.col(before).alias("_prior")), "_k", "left")
    head = F.trim(F.regexp_replace("_prior", r"^.*\d[.,;]?", ""))
    bad = X.corrupt_name(F.col(name))
    fixed = F.when(bad & (F.coalesce(head, F.lit("")) != "") & head.contains(","), F.trim(F.concat_ws(" ", head, F.col(name)))).otherwise(F.col(name))
    return df.select(*columns, bad.alias("was_corrupt"), X.death_note(X.missing_comma(fixed)).alias("rebuilt"))


def entries_to_records(bio: DataFrame, keys: Sequence[str], fields: Sequence[str] = ENTRY_FIELDS) -> DataFrame:
    """Dated records from list cells: one row per entry with its field, position, years, text and place."""
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f).alias("field_type"), F.col(f).alias("cell")) for i, f in enumerate(fields)]))
    rows = bio.select(*keys, kinds.alias("x")).select(*keys, "x.ordinal", "x.field_type", "x.cell").where("cell is not null")
    e = split_entries(rows, "cell").drop("cell")
    start, end = X.years(F.col("entry"))
    place = F.when(F.col("field_type") == "education", X.state_of_school(F.col("entry"))).when(F.col("field_type") == "public_positions", X.state_of_office(F.col("entry"))).otherwise(X.state_in_text(F.col("entry")))
    return e.select(*keys, "ordinal", "field_type", "pos", F.col("entry").alias("role_text_raw"), X.strip_years(F.col("entry")).alias("role_text"), start.alias("year_start"), end.alias("year_end"), place.alias("state"))


def mentions(df: DataFrame, keys: Sequence[str], text: str, patterns: Sequence[tuple[str, str]], tail: str, least: int = 4) -> DataFrame:
    """One row per relation named in a text: kind, position of the pattern and the name mentioned, trimmed."""


    def of(i: int, kind: str, pattern: str) -> Column:
        all_ = F.regexp_extract_all(F.col(text), F.lit("(?i)" + pattern), F.lit(1))
        return F.transform(all_, lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("pattern"), m.alias("m")))

    found = F.flatten(F.array(*[of(i, k, p) for i, (k, p) in enumerate(patterns)]))
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.explode(found).alias("x")).select(*keys, "x.kind", "x.pattern", F.trim(F.regexp_replace("x.m", "(?i)" + tail, "")).alias("mention"))
    return rows.where(F.length("mention") >= least)


def units_and_commanders(c: Column) -> Column:
    """Different military units and commanders named in a text."""
    unit = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(\d{1,3}(?:st|nd|rd|th)?\s+(?:Battalion|Regiment|Division|Brigade|Cavalry|Infantry|Corps|Military Zone))\b"), F.lit(1)), lambda m: F.initcap(F.regexp_replace(m, r"(?i)(\d+)(st|nd|rd|th)?\s+", "$1 ")))
    chief = F.transform(F.regexp_extract_all(c, F.lit(r"under (?:General|Gen\.?|Col\.?|Colonel|Brigadier(?: General)?) ([A-Z][\p{L}.]+(?:\s+[A-Z][\p{L}.]+){1,3})"), F.lit(1)), lambda m: F.concat(F.lit("under Gen. "), F.trim(m)))
    return F.array_distinct(F.concat(unit, chief))


def states_named(c: Column, variants: Sequence[tuple[str, str]]) -> Column:
    """Different states named in a text as whole words, unless a word for a unit follows."""
    unit = r"(?!\s+(brigade|battalion|regiment|division|corps|cavalry|infantry|zone))"

    def of(t: Column) -> Column:
        found = [F.when(t.rlike(r"\b" + k.lower().replace(".", r"\.") + r"\b" + unit), F.lit(v)) for k, v in X.longest_first(variants)]
        return F.array_distinct(F.filter(F.array(*found), lambda s: s.isNotNull()))

    return X.bound(X.normal(c), of)


def json_answers(c: Column, schema: str) -> Column:
    """Array of structs from a reply that may be fenced; junk gives null."""
    body = F.regexp_replace(F.regexp_replace(c, r"(?s)^\s*```(?:json)?", ""), r"(?s)```\s*$", "")
    return F.from_json(F.regexp_extract(body, r"(?s)(\[.*\])", 1), schema)
