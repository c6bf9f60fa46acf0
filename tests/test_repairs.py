"""Repair chains on hand-made cases."""

from pyspark.sql import functions as F

from vitaeflow.functions import rules
from vitaeflow.functions import text as X
from vitaeflow.operators import repairs as R


def applied(spark, rows, schema, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_k int, " + schema)
    return [tuple(r)[0] if len(columns) == 1 else tuple(r) for r in df.orderBy("_k").select(*columns).collect()]


def test_schools(spark):
    cases = [
        ("UNAM 144 mexican political biographie", "UNAM", "UNAM"), ("Academy of San Carlos when it opened, 1910", "", "Academy of San Carlos"), ("3rd grade", "", None), ("University of Puebla, 1950-1952.", "", "University of Puebla"),
        ("National Preparatory School No. 9", "studied at National Preparatory School No 2, 1950", "National Preparatory School No. 2"), ("National Preparatory School No. 9", "National Preparatory School, 1950", "National Preparatory School"),
        ("National Preparatory School No. 9", "Preparatory School No. 4, Puebla", "Preparatory School No. 4"), ("Federal Secondary School No.", "attended Federal Secondary School No. 7, Toluca", "Federal Secondary School No. 7"), ("Jalapa", "primary, Jalapa", None),
        ("School of Law", "law degree, School of Law, National University of Mexico, 1940", "National University of Mexico"), ("School of Law", "law degree, School of Law, UNAM, 1940", "UNAM"), ("School of Law", "School of Law", "School of Law"),
        ("University of San", "studies, University of San Luis Potosi, 1930", "University of San Luis Potosi"), ("Metropolitan University", "professor, Metropolitan University, Iztapalapa Campus", "Autonomous Metropolitan University, Iztapalapa Campus"),
        (None, "Night Secondary School No. 12 for Boys, 1940", "Night Secondary School No. 12 for Boys"), (None, None, None), ("", "", None), ("ab", None, None), ("Free School (of) Law\\E.*", "", "Free School (of) Law\\E.*"),
    ]
    assert applied(spark, [c[:2] for c in cases], "o string, r string", R.school_repaired(F.col("o"), F.col("r"))) == [c[2] for c in cases]


def test_offices(spark):
    cases = [
        ("planning", None, "director of planning, Secretariat of Health, 1970", "Secretariat of Health"), ("planning", None, "director of planning, 1970", None), ("Puebla", None, "judge, District Court, Puebla, 1970", "District Court"),
        ("Puebla", None, "treasurer of Puebla, 1970", "Puebla"), ("Puebla", "x", "director, National Bank, 1970", "National Bank"), (None, None, "manager, Bank of Tula, Puebla, 1950", "Bank of Tula"), (None, None, "farmer, Puebla", None), (None, None, None, None),
        ("Secretariat of Health 120 mexican political biographies", None, "", "Secretariat of Health"), ("", None, "", None),
    ]
    got = applied(spark, [c[:3] for c in cases], "o string, a string, r string", R.office_repaired(F.col("o"), F.col("a"), F.col("r")))
    assert got == [c[3] for c in cases]


def test_party_ranks(spark):
    cases = [
        ("President of CEN", "CEN", "national", "cen_president"), ("President, state committee", "State Committee", "state", "state_president"), ("President", None, None, "state_president"), ("Secretary general of PAN", None, "national", "secretary_general_nat"),
        ("Director of IEPES", "IEPES", "national", "iepes_director"), ("General delegate of CEN", "CEN", "national", "national_delegate"), ("Secretary of Press, CEN", "CEN", "national", "cen_secretary"), ("Member of CEN", "CEN", None, "cen_member"),
        ("Coordinator of the presidential campaign", None, None, "campaign_leader"), ("Secretary of Press", "Regional Committee", None, "state_secretary"), ("Adviser", None, None, "adviser_member"), ("helped a campaign", None, None, "campaign_participant"),
        ("Joined PAN", None, None, "joined"), ("orator", None, None, "other"), (None, None, None, "other"), ("", None, None, "other"),
    ]
    assert applied(spark, [c[:3] for c in cases], "t string, b string, l string", R.party_rank(F.col("t"), F.col("b"), F.col("l"))) == [c[3] for c in cases]
    c = [F.col(x) for x in ("r", "k", "l", "t")]
    rows = [("other", "candidate", None, "candidate for mayor"), ("other", "x", None, "technical adviser to PAN"), ("other", "x", "state", "Director of PRI, Puebla"), ("other", "x", None, "organizer of many campaigns"), ("joined", "x", None, "adviser"), ("other", "x", None, None), ("other", "candidate", None, "precandidate for president of CEN")]
    assert applied(spark, rows, "r string, k string, l string, t string", R.party_rank_repaired(*c)) == ["candidate", "adviser_member", "state_president", "campaign_leader", "joined", "other", "cen_president"]
    levels = [("state", None, "other", "x"), ("state", "Guerrero", "other", "president in Acapulco"), (None, None, "state_president", ""), (None, None, "other", "delegate to the Senate"), (None, "Puebla", "other", ""), (None, None, "other", None)]
    assert applied(spark, levels, "l string, s string, r string, t string", R.party_level_repaired(*[F.col(x) for x in "lsrt"])) == [None, "local", "state", "national", "state", None]
    parties = [(None, "PMS", "x"), ("PAN", "PMS", "x"), (None, None, "member of PP"), (None, None, None)]
    assert applied(spark, parties, "p string, o string, t string", R.minor_party(*[F.col(x) for x in "pot"])) == ["PMS", "PAN", "PP", None]


def test_years_and_degrees(spark):
    rows = [("Thesis, with a thesis on the Constitution, 1857, 1950", 1860, 1860), ("law degree, 1950-1940", 1950, 1940), ("studies since 1910, 1931", 1870, 1870), ("plain, 1950", 1950, 1950), (None, None, None), ("144 mexican political biographies law, 1933", 1, 2)]
    assert applied(spark, rows, "r string, a int, b int", *R.education_years(F.col("r"), F.col("a"), F.col("b"))) == [(None, None), (1950, 1940), (1931, 1931), (1950, 1950), (None, None), (1933, 1933)]
    y = [(2003, 1912), (1950, 1940), (1700, 1900), (1700, 1750), (1990, 2050), (None, 1900), (1900, None), (None, None), (2050, 2060)]
    a, b = F.col("a"), F.col("b")
    assert applied(spark, y, "a int, b int", *R.public_years(a, b)) == [(2003, 2012), (1940, 1950), *y[2:]]
    assert applied(spark, y, "a int, b int", *R.other_years(a, b)) == [(2003, 2012), (1940, 1950), (1900, 1900), (None, None), (1990, 1990), (None, 1900), (1900, None), (None, None), (None, None)]
    f = [("business", "public policy"), ("other", "urban planning"), ("law", "governance"), (None, "diplomacy"), ("business", None)]
    assert applied(spark, f, "f string, t string", R.degree_field(F.col("f"), F.col("t"))) == ["political_sci", "architecture", "law", None, "business"]
    d = [(True, None, None), (False, "Harvard and UNAM", None), (False, "Harvard", None), (None, "UNAM", "Yale"), (None, None, None)]
    assert applied(spark, d, "k boolean, t string, o string", R.degree_abroad(F.col("k"), F.col("t"), F.col("o"))) == [True, False, True, True, None]


def test_labels(spark):
    rows = [("director_general", "PEMEX", "x"), ("head", None, " chief of staff "), ("head", None, ""), ("other", None, None)]
    assert applied(spark, rows, "r string, i string, t string", R.post_label(F.col("r"), F.col("i"), F.col("t")), R.post_weight(F.col("r"))) == [("Director General, PEMEX", 4), ("Chief of staff", 3), ("Head", 3), ("Other", 1)]
    rows = [("Governor", "Puebla"), (None, None), ("Mayor", "")]
    assert applied(spark, rows, "t string, s string", R.office_label(F.col("t"), F.col("s")), R.office_weight(F.col("t"))) == [("Governor (Puebla)", 6), ("Elected office", 2), ("Mayor", 3)]


def test_pages(spark):
    df = spark.createDataFrame([(1, "left", "a"), (1, "right", "b "), (2, "left", " "), (3, "right", "c"), (9, "left", "d"), (None, "left", "e"), (3, "left", None)], "page int, side string, text string")
    assert sorted(map(tuple, R.pages_joined(df, 1, 3).collect())) == [(1, "--- PAGE 1 ---\na\n\nb"), (3, "--- PAGE 3 ---\nc")]
    assert R.pages_joined(df.where("false"), 1, 3).count() == 0
    assert applied(spark, [("x Foot\nnote 1999 y Foot 2000",)], "t string", R.without_footer(F.col("t"), "foot", r"\d{4}")) == ["x  y "]


def test_labels_of_whole_lists(spark):
    """Cases that the lists must tell apart, whatever their form."""
    mil = [("general staff",), ("promoted to general in 1920",), ("major general",), ("rank of major",), ("2nd captain",), ("lieutenant colonel",)]
    assert applied(spark, mil, "t string", X.cascade(F.col("t"), rules.MILITARY_RANK, "unknown")) == ["unknown", "general", "general", "major", "captain", "colonel"]
    assert applied(spark, [("PT 4",), ("PT, Puebla",), ("PT",)], "t string", X.cascade(F.col("t"), rules.PARTY)) == [None, "PT", "PT"]
    edu = [("no degree",), ("professor of law",), ("2nd year of school",), ("semesters at UNAM",), ("x",)]
    assert applied(spark, edu, "t string", X.cascade(F.col("t"), rules.EDU_RECORD, "other")) == ["unknown", "academic_role", "pre_university", "degree", "other"]
    assert applied(spark, [("secretarygeneral",)], "t string", X.cascade(F.col("t"), rules.GOVT_RANK), X.cascade(F.col("t"), rules.LABOR_RANK)) == [("secretary_general", "secretary_general")]
