"""Queries of the text problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .canonical import map_values
from .names import same_person, same_person_pairs
from .packing import fill_containers, fill_report
from .scans import scan_damage
from .spans import shared_characters, sharing_pairs
from .tokens import decoded, token_counts, token_ids
from .truncation import cut_records

#: Tokens one container holds.
CAPACITY = 2_048

# Further ways the reference states are written.
STATE_ALIASES = {
    "Federal District": ("Mexico, D.F.", "Mexico City", "Ciudad de Mexico", "Distrito Federal", "Mexico DF", "CDMX"),
    "Nuevo Leon": ("New Leon",), "Baja California": ("Baja Calif.",), "Baja California Sur": ("Baja Calif. Sur",),
    "Mexico": ("Edomex",), "San Luis Potosi": ("Sn Luis Potosi",), "Michoacan": ("Michoacan de Ocampo",),
}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of person ids that denote one person."""
    return same_person_pairs(table(spark, d, "biographies"), table(spark, d, "parsed_positions"))


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Per person with several ids: the smallest id and the number of ids."""
    m = same_person(table(spark, d, "biographies"), table(spark, d, "parsed_positions"))
    return m.groupBy("person").agg(F.count("*").alias("n_ids"))


def _cut(spark: SparkSession, d: str) -> DataFrame:
    bio, edu = table(spark, d, "biographies"), table(spark, d, "education")
    named = bio.select(F.lit("biographies").alias("tab"), F.col("bio_row").alias("rid"), F.col("name").alias("value"), F.col("intake").alias("source"))
    schools = edu.select(F.lit("education").alias("tab"), F.col("record_id").alias("rid"), F.col("organization").alias("value"), F.col("intake").alias("source"))
    people = table(spark, d, "parsed_positions").select(F.lit("biographies").alias("tab"), F.col("person_name").alias("value"))
    listed = table(spark, d, "ref_organizations").select(F.lit("education").alias("tab"), F.col("org_name").alias("value"))
    return cut_records(named.unionByName(schools).distinct(), people.unionByName(listed))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Names and schools that were cut on delivery."""
    return _cut(spark, d).where("is_cut").select(F.col("tab").alias("table_name"), F.col("rid").alias("row_id")).distinct()


def p3_sources(spark: SparkSession, d: str) -> DataFrame:
    """Per table and intake: records with a value, and how many of them are cut."""
    one = _cut(spark, d).groupBy("tab", "rid", "source").agg(F.max(F.col("is_cut").cast("int")).alias("c"))
    return one.groupBy(F.col("tab").alias("table_name"), F.col("source").alias("intake")).agg(F.count("*").alias("n_records"), F.sum("c").alias("n_cut"), F.round(F.avg("c"), 6).alias("share_cut"))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    pos, edu = table(spark, d, "parsed_positions"), table(spark, d, "education")
    return scan_damage(
        pos.select(F.lit("parsed_positions").alias("table_name"), "record_id", F.col("role_text_raw").alias("value"))
        .unionByName(edu.select(F.lit("education").alias("table_name"), "record_id", F.col("organization").alias("value"))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Role texts and schools that carry traces of the scanned pages."""
    return _scanned(spark, d).select("table_name", "record_id").distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The damaged values, each restored to one continuous line."""
    return _scanned(spark, d).select("table_name", "record_id", "repaired").distinct()


def _typed(spark: SparkSession, d: str) -> DataFrame:
    pos = table(spark, d, "parsed_positions").select("record_id", "field_type", "organization", "state")
    orgs, states = table(spark, d, "ref_organizations"), table(spark, d, "ref_states")
    own = F.when(~F.col("field_type").isin("education", "birthplace"), F.col("organization"))
    pairs = F.array(F.struct(F.lit("organization").alias("field"), own.alias("value")), F.struct(F.lit("state").alias("field"), F.col("state").alias("value")))
    values = pos.select("record_id", F.explode(pairs).alias("p")).select("record_id", "p.field", "p.value").where("value is not null")
    more = F.lit(None).cast("array<string>")
    for name, extra in STATE_ALIASES.items():
        more = F.when(F.col("state_name") == name, F.array(*map(F.lit, extra))).otherwise(more)
    refs = {
        "organization": orgs.select(F.col("org_id").alias("ref_id"), F.col("org_name").alias("name"), F.array("acronym").alias("aliases")),
        "state": states.select(F.col("state_id").alias("ref_id"), F.col("state_name").alias("name"), F.concat(F.array("abbrev"), F.coalesce(more, F.array().cast("array<string>"))).alias("aliases")),
    }
    exact = refs["organization"].select(F.lit("organization").alias("field"), F.col("name").alias("value")).union(refs["state"].select(F.lit("state").alias("field"), F.col("name").alias("value")))
    return map_values(values.join(exact, ["field", "value"], "left_anti"), refs)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Typed organisations and states that are no exact name, with the entry meant or -1."""
    return _typed(spark, d).select("record_id", "field", "ref_id").distinct()


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values without an entry, with the number of records that carry them."""
    return _typed(spark, d).where("ref_id = -1").groupBy("field", "value").agg(F.countDistinct("record_id").alias("n_records"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether every document comes back from its ids, with the number of its characters."""
    docs = table(spark, d, "documents")
    back = decoded(token_ids(docs)).withColumnRenamed("text", "again")
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).join(back, "doc_id").select("doc_id", (F.col("text") == F.col("again")).alias("same"), F.length("again").cast("long").alias("n_chars"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of every document, or of every part of a document longer than a container."""
    return fill_containers(token_counts(table(spark, d, "documents")), CAPACITY)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the lower bound, and the room left unused."""
    return fill_report(token_counts(table(spark, d, "documents")), CAPACITY)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a common substring of 200 or more characters."""
    return sharing_pairs(table(spark, d, "documents")).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """Per document: its characters, and how many of them also stand in another document."""
    return shared_characters(table(spark, d, "documents")).withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_clusters, p3_found, p3_sources, p4_found, p4_repaired, p6_found, p6_unmatched, p7_ids, p7_roundtrip, p8_containers, p8_report, p9_found, p9_shared)}
ORACLE: dict[str, str] = {"p7_roundtrip": "SELECT doc_id, true AS same, length(coalesce(text, '')) AS n_chars FROM documents"}
