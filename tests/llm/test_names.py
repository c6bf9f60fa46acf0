"""Name variants: string measures, name forms, links and clusters."""

import datetime
import random
from collections import Counter

import pytest

from vitaeflow.llm.names import _keys, _vague_keys, accepted, name_agreement, same_person, same_person_pairs, split_name
from vitaeflow.llm.strings import edits, jaro_winkler, phonetic

BIO = "person_id long, name string, birth_date string, birthplace string, pid string"
POS = "person_id long, person_name string, birth_date_clean date, birth_date_precision string, name string"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Bartlett (diaz), Manuel (Deceased 1990)", (("bartlett", "diaz"), ("manuel",))), ("Lic. Ramon Groldallamo Chuspazueta", (("groldallamo", "chuspazueta"), ("ramon",))), ("DE RUSARILLO VUNFARILLO Enrique", (("rusarillo", "vunfarillo"), ("enrique",))),
        ("E. Grosotezco Leririllo", (("grosotezco", "leririllo"), ("e",))), ("Mavarte Tetosa, Jesus (Deceased Aug. 1", (("mavarte", "tetosa"), ("jesus",))), ("de la Madrid Hurtado, Miguel", (("madrid", "hurtado"), ("miguel",))), ("", ((), ())), ("?", ((), ())),
    ],
)
def test_split_name(raw, want):
    assert split_name(raw) == want


def test_measures():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1
    assert [edits("abcd", "abdc", 2), edits("abc", "abc", 0), edits("abc", "xyz", 2), edits("", "ab", 3)] == [1, 0, 3, 2]
    assert phonetic("zulvextla") == phonetic("sulbextla") and phonetic("quesada") == phonetic("kesada")


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Robildana N., Francisco Horacio", "Robildana Ninsandara, Pancho Horacio", True), ("Zadilgedo, Rafael Alfredo", "Zadilgedo Sencegocha, Rafael", True), ("Condara Gonzero, Melquiades Carlos", "Condara Gonzero, Carlos Melquiades", True),
        ("Durrincibia Busnudalba, Miguel", "Durrinciibia Busnudalba, Miguel", True), ("Pissiruyo Gizueta, Enrique", "Pissiruyo Gizueta, Alfredo", False), ("Vasquil P., Manuel", "Vasquil Mora, Manuel", False),
    ],
)
def test_name_agreement(a, b, same):
    sur, giv, full = name_agreement(split_name(a), split_name(b))
    assert bool(sur and giv and full) is same


def tables(spark, positions, bios=()):
    return spark.createDataFrame(list(bios), BIO), spark.createDataFrame(list(positions), POS)


def test_variants_are_linked_and_namesakes_stay_apart(spark):
    d = datetime.date
    pos = [
        (1, "Tresmolgedo Tonzero, Francisco", d(1886, 4, 9), "full", "x"), (2, "F. Tresmolgedo Tonzero", d(1886, 4, 9), "full", "x"), (3, "Tresmolgedo Tonzero, Pancho", d(1886, 4, 1), "month_year", "x"),
        (4, "Tresmolgedo Tonzero, Francisco", d(1931, 1, 5), "full", "x"), (5, "Tresmolgedo Tonzero, Hector", d(1886, 4, 9), "full", "x"), (6, None, None, None, None), (7, "Other Name, Ana", None, None, None),
        (8, "Tresmolgedo Tonzero, Francisco", None, "unparseable", "x"),
    ]
    bio, p = tables(spark, pos + pos[:3])
    assert {tuple(r) for r in same_person_pairs(bio, p).collect()} == {(1, 2), (1, 3), (2, 3)}  # 8 could be two people


def test_one_class_of_a_third_of_all_rows(spark):
    d = datetime.date(1900, 1, 1)
    pos = [(i, "Hot Name, Juan", d, "full", None) for i in range(300)] + [(1000, "Quesada Mora, Ana", d, "full", None), (1001, "Villa Ibarra, Luis", d, "full", None)]
    bio, p = tables(spark, pos)
    m = same_person(bio, p).collect()
    assert {r.pid for r in m} == set(range(300)) and {r.person for r in m} == {0}


def test_names_of_nothing(spark):
    bio, p = tables(spark, [])
    assert same_person_pairs(bio, p).count() == 0
    bio, p = tables(spark, [(1, "", None, None, None), (2, "  ,", None, None, None), (3, "x " * 3000, None, None, None), (4, "x " * 3000, None, None, None)], [(9, None, None, None, None)])
    assert same_person_pairs(bio, p).count() <= 2


def test_every_accepted_pair_meets():
    """Whatever is accepted between generated variants shares a block key, with and without a birth year."""
    rng = random.Random(4)
    sur = ["Tresmolgedo", "Tonzero", "Quesada", "Mora", "Villasana", "Yanez"]
    giv = ["Francisco", "Pancho", "Jose", "Pepe", "Luis", "Antonio", "Tono", "Enrique"]

    def typo(w):
        i = rng.randint(1, len(w) - 2)
        return w if rng.random() < 0.8 else w[:i] + w[i + 1] + w[i] + w[i + 2 :]

    def name():
        s, g = [typo(rng.choice(sur)) for _ in range(rng.randint(1, 2))], [typo(rng.choice(giv)) for _ in range(rng.randint(1, 2))]
        return split_name(f"{' '.join(s)}, {' '.join(g)}")

    seen = missed = 0
    for _ in range(6000):
        a, b = name(), name()
        agree = name_agreement(a, b)
        if accepted(*agree, 0.6, 0):
            seen += 1
            missed += not _keys(*a, 19000101, "year_only") & _keys(*b, 19000101, "year_only")
        if accepted(*agree, 0.2, 0) or accepted(*agree, 0.2, 1):
            place = "Puebla" if accepted(*agree, 0.2, 1) else None
            seen += 1
            missed += not _vague_keys(*a, place) & _vague_keys(*b, place)
    assert seen > 300 and missed <= 0.05 * seen


def test_long_names_link(spark):
    d = datetime.date(1900, 1, 1)
    tail = "Beltran Cordero Duarte Esparza Fuentes Galvan Huerta Ibarra Juarez Lozano"
    pos = [(1, f"Zamora Quintana {tail}, Ana", d, "full", None), (2, f"Zamorra Quintana {tail}, Ana", d, "full", None), (3, "Zamora Quintana, Ana", d, "full", None)]
    bio, p = tables(spark, pos)
    assert {tuple(r) for r in same_person_pairs(bio, p).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_common_surname_without_births_is_split():
    """People of one surname and unknown births meet in many small blocks, not in one."""
    firsts = [a + b for a in ("al", "be", "ci", "do", "er", "fi", "ga", "ho", "il", "ju") for b in ("berto", "nando", "rico", "seo", "tavio")]
    seconds = [a + b for a in ("mo", "pe", "ra", "so", "ti", "va", "ya", "zu", "ce", "di") for b in ("lina", "rera", "tosa", "vedo", "xtra")]
    people = [(("hernandez", s), (f,)) for s in seconds for f in firsts]
    blocks = Counter(k for p in people for k in _vague_keys(*p, None))
    old = Counter(k for (s, g) in people for k in {"|".join(sorted((phonetic(s[0]), phonetic(g[0])))), f"{phonetic(s[0])}|{g[0][0]}"})
    assert sum(n * n for n in blocks.values()) < 0.5 * sum(n * n for n in old.values()) and max(blocks.values()) < max(old.values())
