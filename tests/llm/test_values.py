"""Canonical values, cut values and scan damage."""

import random

import pytest

from vitaeflow.llm.canonical import Matcher, _Words, map_by_join, map_values
from vitaeflow.llm.scans import Held, damage, scan_damage, train_editor, word_counts, word_marks
from vitaeflow.llm.strings import edits
from vitaeflow.llm.truncation import cut_records, open_text, prefix_table

ORGS = [(1, "Civic Concord Party", ("CCP",)), (2, "Secretariat of Public Granaries", ("SPG",)), (3, "Chamber of Aviation Industries", ("CAI",)), (4, "Institute of Coffee", (None,)), (5, "Secretariat of Coffee", ())]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Civic Cnocord Party", 1), ("offices of the civic concord party", 1), ("Civic Concord Party - legal affairs", 1), ("C.C.P.", 1), ("c c p", 1), ("Public Granaries, Secretariat of", 2), ("Chmbr. of Aviation Ind.", 3), ("Secr of Pub. Granaries", 2),
        ("Hacienda Mora", -1), ("none", -1), ("?", -1), ("", -1), ("Institute of Astronomy of Zalco", -1), ("Institute of Coffee and Secretariat of Coffee", -1), ("Civic ConcordParty", 1), ("Party", -1), ("x" * 100_000, -1), ("word " * 5_000, -1),
    ],
)
def test_find(value, want):
    m = Matcher([(i, n, tuple(a for a in al if a)) for i, n, al in ORGS])
    assert m.find(value) == want and m.find(value) == want


def frames(spark, values):
    df = spark.createDataFrame([(i, "o", v, 7) for i, v in enumerate(values)], "record_id long, field string, value string, ref_id int")
    return df, spark.createDataFrame([(i, n, list(a)) for i, n, a in ORGS], "ref_id long, name string, aliases array<string>")


def test_both_ways_agree(spark):
    df, ref = frames(spark, ["Civic Cnocord Party", "Hacienda Mora", None, "SPG", "Aviation Industries, Chamber of", "Civic Cnocord Party", ""])
    a = sorted(map(tuple, map_values(df, {"o": ref}).collect()))
    b = sorted(map(tuple, map_by_join(df.where("value is not null"), ref).collect()))
    assert a == b and len(a) == 6 and [r[3] for r in a] == [1, -1, 2, 3, 1, -1]


def test_aliases_of_any_length():
    m = Matcher([(1, "National Company of Staples", ("CONASUPO",)), (2, "Institute of Social Security", ("IMSS",)), (3, "Fund of Workers' Housing", ("INFONAVIT", "Housing Fund")), (4, "Oaxaca", ("Oax.",)), (5, "Institute of Coffee", ("IC",))])
    values = {"CONASUPO": 1, "conasupo": 1, "Director, IMSS": 2, "director, imss": -1, "INFONAVIT": 3, "the Housing Fund": 3, "Tlaxiaco, Oax.": 4, "Institute of Coffee, IMSS": 5, "IMSS and CONASUPO": -1, "XIMSSX": -1, "Znstitute of Coffee": 5, "Instituteof Cofee": 5}
    assert {v: m.find(v) for v in values} == values


def test_near_words_equal_a_full_search():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 24))) for _ in range(400)})
    index = _Words(words)
    for q in [*words[::9], *("".join(rng.choice("abc") for _ in range(n)) for n in range(1, 26))]:
        assert {w for w in words if edits(q, w, 2) <= 2} <= {index.words[i] for i in index.near(q)}


def test_no_reference_and_no_values(spark):
    df, ref = frames(spark, ["Civic Concord Party"])
    assert [r.ref_id for r in map_values(df, {"o": ref.where("false")}).collect()] == [-1]
    assert map_values(df.where("false"), {"o": ref}).count() == 0


def test_prefix_keys_agree_on_common_prefixes():
    (_, long, _), (_, own, _) = prefix_table([open_text("Heroic Military College of (Montelar)")]), prefix_table([open_text("heroic military college of monte")], own=True)
    assert set(own) <= set(long) and len(own) == 2 and len(prefix_table(["abc"])[0]) == 0


def test_cut_values(spark):
    rng = random.Random(1)
    schools = ["Heroic Military College of Montelar", "National University of Altepan", "Free School of Law", "Normal School of Tesbehuil", "University of Plonsucalli"]
    rows = [("e", i, rng.choice(schools), "book") for i in range(400)]
    rows += [("e", 1000 + i, rng.choice(schools)[:24], "cards") for i in range(200)]
    rows += [("e", 2000, "National Univer", "book"), ("e", 2001, "Free School of", "book"), ("e", 2002, None, "book"), ("e", 2003, " ", "book"), ("e", 2004, "Free School of Law (Dece", None), ("e", 2005, "Qwertz", None)]
    df = spark.createDataFrame(rows + rows[:20], "tab string, rid long, value string, source string")
    got = {r.rid: r.is_cut for r in cut_records(df).collect()}
    assert 2002 not in got and 2003 not in got
    assert [got[i] for i in (2000, 2001, 2004, 2005)] == [True, True, True, False]
    assert not any(got[i] for i in range(400))
    cut = {rid: len(v) == 24 and v not in schools for _, rid, v, s in rows if s == "cards"}
    assert all(got[rid] == c for rid, c in cut.items())
    assert cut_records(df.where("false")).count() == 0
    long_ = spark.createDataFrame([("e", 1, "ab " * 20_000, "s"), ("e", 2, "ab " * 10_000 + "abc", "s")], df.schema)
    assert cut_records(long_).count() == 2


ROLES = ["Federal Deputy", "Secretary of Press and Propaganda", "Member of the Executive Committee", "Director General", "Private Secretary"]
PLACES = ["School of Agronomy", "National Bank of Livestock", "Union of Public Granaries Workers", "University of Santa Gorande"]
NOTES = ["for pre- and post-primary instruction", "recorded in file 214 of the registry", "under the Ibero-Antillean cooperation agreement", "page 27 to page 64"]


def corpus(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice(ROLES)}, {rng.choice(PLACES)}, {rng.choice(NOTES)}, {rng.randint(1900, 1990)}-{rng.randint(1990, 2000)}" for _ in range(n)]


def test_editor_on_held_out_damage():
    import re
    from collections import Counter

    lines = corpus(3000, 1)
    counts = Counter(w for x in lines for w in re.findall(r"[^\W_]+-[^\W_]+|[^\W_]+", x))
    for x in lines:
        counts.update(re.findall(r"[^\W_]+", x))
    editor = train_editor(dict(counts), sorted(set(lines))[:600], {"# annals of the republic": (40, 0.05), "la sierra, #": (9, 0.002)})
    assert editor.headers == ["# annals of the republic"]
    rng = random.Random(9)
    right = total = 0
    for line in sorted(set(corpus(400, 2))):
        assert editor.damaged(line) is None, line
        bad, _ = damage(line, rng, misread=0.01)
        if bad != line:
            total += 1
            right += editor.repair(bad) == line
    assert right / total > 0.85
    assert editor.repair("Federal\nThe Biographies   721\nDeputy, 1950") == "Federal Deputy, 1950"
    assert editor.repair("Federal\n- 278 -\nDepufy, 1950") == "Federal Deputy, 1950"
    assert editor.repair("Secretary of Press and Propa-\r\nganda") == "Secretary of Press and Propaganda"
    # a header of the corpus inside a line, cut, on a line of its own, broken, and around another mark
    for text in ("Director of 174 annals of the republic General", "Director of 174 Annals of the Republ General", "Director of\n12 ANNALS OF THE REPUBLIC\nGeneral", "Director of\n--- 3 annals of the republic PAGE 9 ---\nGeneral"):
        assert editor.repair(text) == "Director of General", text
    # headers of forms that no training has seen, known from their place and build
    for header in ("Chapter 12   Lives of Note", "LIVES OF THE SENATORS 88", "77   Who Was Who", "Part 3 - 118", "~ 45 ~"):
        assert editor.repair(f"Federal\n{header}\nDeputy, 1950") == "Federal Deputy, 1950", header
        assert editor.repair(f"Secretary of Press and Propa-\n{header}\nganda") == "Secretary of Press and Propaganda", header
    # text that begins with a number, or looks like a part of a header, stays
    assert editor.repair("Notary Public No.\n27, Department of Water, 1950") == "Notary Public No. 27, Department of Water, 1950"
    assert editor.repair("recorded in file\n214 of the registry") == "recorded in file 214 of the registry"
    # lost letters are put back, and a run that is no word is left alone
    assert editor.repair("Secretary of Pres and Propaganda, 1950") == "Secretary of Press and Propaganda, 1950"
    assert editor.repair("Federal Deputy, " + "lrn" * 20_000) == "Federal Deputy, " + "lrn" * 20_000
    long_ = "Federal Deputy, School of Agronomy, " * 8_000 + "Fed-\neral"
    assert editor.repair(long_).endswith("Federal")


def test_scan_damage_frame(spark):
    lines = corpus(1500, 3)
    rows = [("p", i, v, "x") for i, v in enumerate(lines)] + [("p", 9000, "Federal\n[12]\nDeputy", "x"), ("p", 9001, None, "x"), ("p", 9002, "", "x"), ("p", 9003, "Federal Depufy", "x"), ("p", 9003, "Federal Depufy", "x")]
    df = spark.createDataFrame(rows, "table_name string, record_id long, value string, repaired string")
    got = sorted((r.record_id, r.repaired) for r in scan_damage(df, 400).collect())
    assert got == [(9000, "Federal Deputy"), (9003, "Federal Deputy"), (9003, "Federal Deputy")]
    joined = sorted((r.record_id, r.repaired) for r in scan_damage(df, 400, most_words=0).collect())
    assert joined == got
    assert scan_damage(df.where("false")).count() == 0
    assert word_counts(df).where("word = 'Ibero-Antillean'").count() == 1


def test_scan_damage_whatever_the_words_sent(spark):
    # words that only come about when a line between their parts is removed, or when another word is repaired first
    broken = ["Federal De-\n[12]\npufy, 1950", "Fed-\neral De-\n12\nputy, 1950", "Fed-\neral De-\n[12]\n- 7 -\npufy", "Secretary of Propa-\n\n[3]\ngan-\nda", "School of Agrono-\n- 278 -\nmy, De-\n[4]\nputy"]
    lines = corpus(1500, 3)
    torn = [v.replace(" ", "\n", k % 4 + 1) for k, v in enumerate(lines[:1000])]  # lines of many shapes
    rows = [("p", i, v) for i, v in enumerate(broken + torn + lines)]
    df = spark.createDataFrame(rows, "table_name string, record_id long, value string")
    want = sorted(tuple(r) for r in scan_damage(df, 400).collect())
    assert [f for _, i, _, f in want if i < 2] == ["Federal Deputy, 1950"] * 2
    for sent in (0, 12):
        assert sorted(tuple(r) for r in scan_damage(df, 400, most_words=sent).collect()) == want, sent


def test_word_marks(spark):
    words = [f"word{i}é" for i in range(3000)]
    held = Held({"of": 9}, word_marks(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), len(words)))
    assert all(map(held.may, words)) and sum(held.may(f"other{i}") for i in range(3000)) < 30
    held.hold({"word1é": 0})
    assert (held.get("of"), held.get("word1é"), held.get("word2é"), held.get("nowhere")) == (9, 0, 0, 0) and held.missing == {"word2é"}
