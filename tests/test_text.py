"""Scalar text functions on stated cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from vitaeflow.functions import rules
from vitaeflow.functions import text as X


def ask(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(("given", "want"), [("salinas de gortari, carlos", "salinas de gortari carlos"), ("Bartlett (diaz), Manuel", "bartlett diaz manuel"), (None, None), ("", "")])
def test_normalize_name(spark, given, want):
    assert ask(spark, X.normalize_name, given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("Bartlett (diaz), Manuel (Deceased 1990)", "Bartlett Diaz, Manuel"), ("de la Madrid (hurtado), Miguel", "de la Madrid Hurtado, Miguel"), ("perez-gil, ana", "Perez-Gil, Ana"), (None, ""), ("  ,", "")],
)
def test_clean_person_name(spark, given, want):
    assert ask(spark, X.clean_person_name, given) == want


@pytest.mark.parametrize(
    ("given", "date", "precision", "decade"),
    [
        ("Mar. 4, 1906", datetime.date(1906, 3, 4), "full", 1900), ("June 14, 1949", datetime.date(1949, 6, 14), "full", 1940), ("1910", datetime.date(1910, 1, 1), "year_only", 1910), ("Nov., 1917", datetime.date(1917, 11, 1), "month_year", 1910),
        ("Jan. 31. 1951", datetime.date(1951, 1, 31), "full", 1950), ("1900s", None, "decade", 1900), ("Feb. 8, 1946; City", datetime.date(1946, 2, 8), "full", 1940), ("Sept. 10, 1926", datetime.date(1926, 9, 10), "full", 1920),
        ("mp, es", None, "unparseable", None), (None, None, "unparseable", None), ("Feb. 31, 1950", None, "unparseable", None), ("", None, "unparseable", None),
    ],
)
def test_parse_date(spark, given, date, precision, decade):
    assert tuple(ask(spark, X.parse_date, given)) == (date, precision, decade)


def test_split_person(spark):
    row = spark.createDataFrame([("aBitia arzoPalo, Jose (Deceased Apr. 19, 1989)",)], "v string").select(*[c.alias(n) for n, c in X.split_person(F.col("v")).items()]).first()
    assert tuple(row) == ("Abitia Arzopalo, Jose", True, 1989, datetime.date(1989, 4, 19))


@pytest.mark.parametrize(
    ("given", "text", "a", "b"),
    [("governor, Guerrero, 1963–1969", "governor, Guerrero", 1963, 1969), ("Medical degree, 1930, 1934", "Medical degree, 1930", 1934, 1934), ("no year", "no year", None, None), ("1950", "1950", 1950, 1950), ("", None, None, None), (None, None, None, None)],
)
def test_years(spark, given, text, a, b):
    df = spark.createDataFrame([(given,)], "v string")
    y0, y1 = X.years(F.col("v"))
    assert tuple(df.select(y0, y1, X.strip_years(F.col("v"))).first()) == (a, b, text)


def test_first_year_variant(spark):
    y0, y1 = X.years(F.col("v"), "first")
    assert tuple(spark.createDataFrame([("Medical degree, 1930, 1934",)], "v string").select(y0, y1).first()) == (1930, None)


@pytest.mark.parametrize(("given", "want"), [("director, Bank of Mexico", "Mexico"), ("director, Secretariat of Health", "Federal District"), ("mayor of León", "Guanajuato"), ("deputy, Baja California Sur", "Baja California Sur"), ("nowhere", None), (None, None)])
def test_state_in_text(spark, given, want):
    assert ask(spark, X.state_in_text, given) == want


@pytest.mark.parametrize(("given", "want"), [((1924, 1916), (1916, 1924)), ((1899, 1812), (1899, 1899)), ((None, 1950), (None, 1950)), ((1950, None), (1950, None))])
def test_military_years(spark, given, want):
    a, b = X.repaired_years(F.col("a"), F.col("b"), 1880, 2009)
    assert tuple(spark.createDataFrame([given], "a int, b int").select(a, b).first()) == want


def test_public_years_a_century_low(spark):
    a, b = X.repaired_years(F.col("a"), F.col("b"), 1880, 2015, century=True)
    assert tuple(spark.createDataFrame([(2009, 1912)], "a int, b int").select(a, b).first()) == (2009, 2012)


def test_first_label_wins(spark):
    assert ask(spark, lambda c: X.cascade(c, rules.MILITARY_RANK, "unknown"), "lieutenant colonel, 1920") == "colonel"
    assert ask(spark, lambda c: X.cascade(c, rules.GOVT_RANK, "other"), "Director General, IMSS") == "director_general"
    assert ask(spark, lambda c: X.cascade(c, rules.GOVT_RANK, "other"), None) == "other"


@pytest.mark.parametrize(("given", "want"), [("Secretary General, CTM, 1970–1976", "Secretary General"), ("Director General, IMSS", "Director General"), ("Federal Deputy from Jalisco, 1964", "Federal Deputy"), ("1950", None)])
def test_title_at_start(spark, given, want):
    assert ask(spark, X.title_at_start, given) == want


def test_names_put_right(spark):
    assert ask(spark, X.missing_comma, "BreMauntz (Martínez) alBerto (Deceased Dec. 9, 1978)") == "BreMauntz (Martínez), alBerto (Deceased Dec. 9, 1978)"
    assert ask(spark, X.death_note, "charis castro, heliodoro (1964)") == "charis castro, heliodoro (Deceased 1964)"
    for bad in ("9, 1965)", "(Deceased 1953)", "Manuel", "mp,", "es, 1935–2009", None):
        assert ask(spark, X.corrupt_name, bad) is True
    assert ask(spark, X.corrupt_name, "Bartlett (diaz), Manuel") is False


def test_accents(spark):
    assert ask(spark, X.strip_accents, "Éçolé ñandú ĳ é") == "Ecole nandu ij e"
    assert ask(spark, X.join_broken_words, "Guerr-\nero") == "Guerrero"


def test_tri_state(spark):
    df = spark.createDataFrame([(True, False), (True, True), (False, True), (False, False), (None, None)], "y boolean, n boolean")
    assert [r[0] for r in df.select(X.tri_state(F.col("y"), F.col("n"))).collect()] == [True, False, False, None, None]
