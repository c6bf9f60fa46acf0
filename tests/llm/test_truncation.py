"""A cut value whose longer copy is not the most frequent value of its bands."""

from itertools import permutations

from vitaeflow.llm.truncation import aligned_end, cut_records, open_text, prefix_table

CUT = "Royal Academy of Law and Letters of Altepan in Montelar"


def alike_but_other():
    """The words in another order with the same band keys; its alignment fails."""
    words = CUT.split()
    keys = set(prefix_table([open_text(CUT)], own=True)[1])
    for p in permutations(words[:-3]):
        other = " ".join([*p, *words[-3:]])
        if other != CUT and keys & set(prefix_table([open_text(other)], own=True)[1]):
            return other
    raise AssertionError("no other order with these keys")


def cut(spark, n_true):
    rows = [("e", i, f"{alike_but_other()} Seminary", None) for i in range(90)] + [("e", 100 + i, f"{CUT} Province", None) for i in range(n_true)] + [("e", 200 + i, f"College {i % 7} in Montelar", None) for i in range(40)]
    df = spark.createDataFrame([*rows, ("e", 300, CUT, None)], "tab string, rid long, value string, source string")
    return [r.rid for r in cut_records(df).where("is_cut").collect()]


def test_longer_copy_behind_a_more_frequent_value(spark):
    assert cut(spark, 60) == [300]


def test_only_true_continuations_count(spark):
    assert cut(spark, 5) == []


def test_swapped_last_letters_are_no_cut():
    assert aligned_end("calfilmego rurza, rodolof", "calfilmego rurza, rodolfo deceased 2003") == "border"
    assert aligned_end("abc", "abc") is None and aligned_end("abcdef", "abxdefgh") is None


def test_paths(spark):
    """Values with a copy are found by it; only the others by their closing word."""
    schools = ["Heroic Military College of Montelar", "National University of Altepan", "Normal School of Tesbehuil"]
    rows = [("e", i, schools[i % 3], "book") for i in range(300)] + [("e", 1000 + i, schools[i % 3][:22], "cards") for i in range(60)]
    rows += [("e", 2000, "Lyceum of Zalco (Nigh", "book"), ("e", 2001, "Academy of Natio", "book")]
    df = spark.createDataFrame(rows, "tab string, rid long, value string, source string")
    got = {r.rid: r.path for r in cut_records(df).where("is_cut").collect()}
    assert all(got.get(1000 + i) == "copy" for i in range(60)) and got[2000] == got[2001] == "closing" and len(got) == 62


def test_whole_form_of_the_lexicon(spark):
    df = spark.createDataFrame([("e", 1, "Royal Academy of Let", "a"), ("e", 2, "Royal Academy of Mines", "a")], "tab string, rid long, value string, source string")
    whole = spark.createDataFrame([("e", "Royal Academy of Letters"), ("e", None), ("e", " ")], "tab string, value string")
    assert [r.is_cut for r in cut_records(df, whole).orderBy("rid").collect()] == [True, False]
    assert [r.path for r in cut_records(df, whole).orderBy("rid").collect()] == ["copy", None]
