"""Cleaning steps and word-for-word containment on stated cases."""

import pytest
from pyspark.sql import functions as F

from vitaeflow.functions import text as X
from vitaeflow.operators import clean
from vitaeflow.operators.containment import names_in_texts


def ask(spark, f, *values):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} {'boolean' if isinstance(v, bool) else 'string'}" for c, v in zip(cols, values)))
    return df.select(f(*map(F.col, cols)).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("f", "values", "want"),
    [
        (clean.organization_in, ("Adviser, Secretariat of Health, 1960", "govt_positions"), "Secretariat of Health"), (clean.organization_in, ("Mayor, 1950", "public_positions"), None), (clean.organization_in, (None, "x"), None),
        (clean.organization_in, ("secretary of the navy, 1960", "govt_positions"), "Secretariat of navy"), (clean.organization_in, ("inspector general of Tunnels, 1960", "govt_positions"), "Tunnels"), (clean.organization_in, ("justice, Supreme Court, First Circuit", None), "Supreme Court, First Circuit"),
        (clean.organization_in, ("director of medical services, PEMEX", "govt_positions"), "PEMEX"), (clean.organization_in, ("member of CNC", "party_positions"), "CNC"), (clean.organization_in, ("Union of Miners, 1960", "labor_positions"), "Union of Miners"), (clean.organization_in, ("born in PEMEX", "birthplace"), None),
        (clean.school_in, ("Law degree, National School of Law, UNAM, 1950",), "UNAM"), (clean.school_in, ("Law degree, University of Colima and Free School",), "University of Colima"),
        (clean.labor_organization, (None, "secretary, CTM, 1950"), "CTM"), (clean.labor_organization, ("Union X", "secretary, CTM"), "Union X"), (clean.labor_organization, ("ab", "Local No. 3, Union of Bakers, 1950"), "Union of Bakers"), (clean.labor_organization, (None, None), None),
        (clean.sub_department, ("Head, Department of Fisheries, 1950",), "Department of Fisheries"), (clean.sub_department, ("Head, Department of Tourism",), None),
        (clean.labor_is_national, (None, "Local No. 23"), False), (clean.labor_is_national, (None, "CTM of Sonora"), False), (clean.labor_is_national, (True, "Local No. 23"), True), (clean.labor_is_national, (None, "secretary"), None),
        (clean.filled_title, (None, "plurinominal senator"), "Senator"), (clean.filled_title, (None, "plurinominal federal deputy"), "Federal Deputy"), (clean.filled_title, ("Mayor  X", "y"), "Mayor X"),
        (clean.municipality, ("mayor, Hidalgo del Parral, Chihuahua, 1952", "Mayor"), "Hidalgo del Parral"), (clean.municipality, ("senator, 1950", None), None), (clean.municipality, (None, None), None),
        (clean.state_of_town, (None, "León"), "Guanajuato"), (clean.state_of_town, ("Sonora", "León"), "Sonora"), (clean.work_state_public, ("Senator", "Morelos"), "Federal District"), (clean.work_state_public, ("Mayor", "Morelos"), "Morelos"),
        (clean.in_scope, ("first cousins",), True), (clean.in_scope, ("distant cousins",), False), (clean.in_scope, ("third cousins",), False), (clean.in_scope, ("",), False), (clean.in_scope, (None,), False),
        (clean.displayed, ("Perez Gil, Ana",), "Ana Perez Gil"), (clean.displayed, ("Ana",), "Ana"), (clean.displayed, (None,), None), (X.strip_fragments, ("director of government 108 mexican political biographie newspaper",), "director of government newspaper"),
        (clean.filled_level, ("state", None, "x"), None), (clean.filled_level, (None, "Sonora", "x"), "state"), (clean.filled_level, (None, None, "Senate"), "national"), (clean.consistent_record, ("joined", "joined the presidential campaign"), "campaign"),
    ],
)
def test_step(spark, f, values, want):
    if f is clean.labor_is_national and values[0] is None:
        values = (None, values[1])
        df = spark.createDataFrame([values], "c0 boolean, c1 string")
        assert df.select(f(F.col("c0"), F.col("c1"))).first()[0] is want
    else:
        assert ask(spark, f, *values) == want


def test_years_are_read_again_only_after_a_change(spark):
    df = spark.createDataFrame([("a, 1950", "a, 1950", 1, 2), ("a x, 1950", "a, 1950", 1, 2), ("a x", "a", 1, 2), (None, None, 1, 2)], "o string, n string, s int, e int")
    a, b = clean.reextracted(F.col("o"), F.col("n"), F.col("s"), F.col("e"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [(1, 2), (1950, 1950), (1, 2), (1, 2)]


def test_names_in_texts(spark):
    names = spark.createDataFrame([("Leon",), ("San Juan del Rio",), ("San Juan del Rio el Alto",), (None,), ("...",), ("Leon",)], "name string")
    texts = spark.createDataFrame([(1, "Born in León; later San Juan del Río."), (2, "Napoleon"), (3, None), (4, ""), (5, "san juan del rio el alto, leon leon")], "doc_id long, text string")
    got = {tuple(r) for r in names_in_texts(names, "name", texts, "doc_id", "text").collect()}
    assert got == {("Leon", 1), ("San Juan del Rio", 1), ("San Juan del Rio", 5), ("San Juan del Rio el Alto", 5), ("Leon", 5)}
    assert names_in_texts(names.where("false"), "name", texts, "doc_id", "text").count() == 0
