"""A reference list in shards gives what the whole list gives."""

import pytest

from vitaeflow.llm.canonical import Matcher, map_by_join, map_values

ORGS = [
    (1, "Civic Concord Party", ["CCP"]), (2, "Secretariat of Public Granaries", ["SPG"]), (3, "Chamber of Aviation Industries", ["CAI"]), (4, "Institute of Coffee", [None]), (5, "Secretariat of Coffee", []),
    (6, "Union of Salt Workers", ["USW", "Salt Union"]), (7, "Union of Silk Workers", ["USW", "Silk Union"]), (8, "National Bank of Livestock", None), (9, "Board of Northern Roads", ["Northern Board"]), (10, "Board of Nordic Roads", ["Northern Board"]),
    (11, "Bank of the North", ["Coffee Board"]), (12, "Coffee Board", []), (13, "Élan Society", []), (14, "Common Fund", []), (15, "Common Fund", []),
]
VALUES = {
    "Civic Cnocord Party": 1, "offices of the civic concord party": 1, "Civic Concord Party - legal affairs": 1, "C.C.P.": 1, "c c p": 1, "Public Granaries, Secretariat of": 2, "Chmbr. of Aviation Ind.": 3, "Secr of Pub. Granaries": 2,
    "Hacienda Mora": -1, "none": -1, "?": -1, "": -1, "Institute of Astronomy of Zalco": -1, "Institute of Coffee and Secretariat of Coffee": -1, "Civic ConcordParty": 1, "Party": -1, "x" * 10_000: -1, "word " * 500: -1,
    "sria of Coffee": 5, "Sria de Public Granaries": 2, "Elan Socieyt": 13, "USW": -1, "Union of Slt Workers": 6, "Banco Nacional Livestock": 8, "Northern Board": -1, "the Coffee Board": 12, "hivic Concord Party": 1, "Common Fund": -1, "Union of Sxlk Workers": 7, "Union of Sakt Workers and Union of Silk Workers": 7,
}


@pytest.mark.parametrize("most", [1, 4, 50_000])
def test_long_list_gives_the_same(spark, most):
    df = spark.createDataFrame([(i, "o", v) for i, v in enumerate([*VALUES, "Civic Cnocord Party"])], "record_id long, field string, value string")
    ref = spark.createDataFrame(ORGS, "ref_id long, name string, aliases array<string>")
    got = {r.record_id: r.ref_id for r in map_by_join(df, ref, most).collect()}
    held = {r.record_id: r.ref_id for r in map_values(df, {"o": ref}).collect()}
    assert got == held and len(got) == len(VALUES) + 1
    assert {v: got[i] for i, v in enumerate(VALUES)} == VALUES


def test_every_token_that_agrees_is_found():
    from vitaeflow.llm.canonical import token_score

    m = Matcher([(i, n, tuple(a for a in al or () if a)) for i, n, al in ORGS])
    for q in {t for v in VALUES for t in v.lower().split()[:20] if t.isalnum()} | {"b", "nl", "unoin", "wrkrs", "rods"}:
        hits = m._alike(q)
        assert all(hits.get(t, 0) == token_score(q, t) for t in m.by_token)
