"""Relational, interval, graph and parsing operators on small fixtures."""

import random

from pyspark.sql import functions as F

from vitaeflow.functions import rules
from vitaeflow.operators import fuzzy, graph, intervals, parse, relops
from vitaeflow.sources import tables


def test_keep_first_does_not_depend_on_the_partitioning(spark):
    rows = [(i % 7, 1000 - i, None if i % 5 == 0 else f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, s int, v string")
    a = sorted(map(tuple, relops.keep_first(df.repartition(1), ["k"], ["s"]).collect()), key=str)
    b = sorted(map(tuple, relops.keep_first(df.repartition(4, "v"), ["k"], ["s"]).collect()), key=str)
    assert a == b and len(a) == 7


def test_best_and_mode_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, 5, "director_general"), (1, 3, "assistant_attorney_general"), (1, 9, None), (2, 1, "odd")], "p int, s int, r string")
    best = {r[0]: r[1] for r in df.groupBy("p").agg(relops.best_by_order(F.col("r"), rules.GOVT_ORDER, F.col("s"))).collect()}
    assert best == {1: "assistant_attorney_general", 2: "odd"}
    assert {r[0]: r[1] for r in relops.mode_first(df, "p", "r", "s").collect()} == {1: "assistant_attorney_general", 2: "odd"}


def test_changed_knows_null(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, None), (None, 1)], "a int, b int")
    assert [r[0] for r in df.select(relops.changed([(F.col("a"), F.col("b"))])).collect()] == [0, 1, 0, 1]


def test_surrogate_ids_follow_first_appearance(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "n string, s long")
    assert {r[0]: r[1] for r in relops.surrogate_ids(df, "n", "s").collect()} == {"b": 1, "a": 2, "c": 3}


def test_overlap_is_symmetric_and_buckets_agree(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(rng.randint(0, 3), i, s := rng.randint(1900, 1960), s + rng.randint(0, 15)) for i in range(80)], "k int, x int, a0 int, a1 int")
    right = spark.createDataFrame([(rng.randint(0, 3), i, s := rng.randint(1900, 1960), s + rng.randint(0, 15)) for i in range(80)], "k int, y int, b0 int, b1 int")
    plain = {(r.x, r.y) for r in intervals.overlap_join(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 1).collect()}
    cut = [(r.x, r.y) for r in intervals.bucketed_overlap_join(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), 1, 7).collect()]
    assert len(cut) == len(set(cut)) and set(cut) == plain
    back = {(r.x, r.y) for r in intervals.overlap_join(right, left, ["k"], ("b0", "b1"), ("a0", "a1"), 1).collect()}
    assert back == plain
    row = spark.createDataFrame([(1940, 1945, 1946, 1950, 1947)], "a int, b int, c int, d int, e int")
    assert tuple(row.select(intervals.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 1), intervals.overlaps(F.col("a"), F.col("b"), F.col("e"), F.col("d"), 1)).first()) == (True, False)


def test_band_join_equals_all_pairs(spark):
    rng = random.Random(4)
    xs, ys = [(0, rng.randint(1850, 1950)) for _ in range(60)], [(0, rng.randint(1850, 1950)) for _ in range(60)]
    a, b = spark.createDataFrame(xs, "k int, x int"), spark.createDataFrame(ys, "k int, y int")
    got = sorted((r.x, r.y) for r in intervals.band_join(a, b, ["k"], "x", "y", 10).collect())
    assert got == sorted((x, y) for _, x in xs for _, y in ys if abs(x - y) <= 10)


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(500, 500 + i) for i in range(1, 40)] + [(i, i + 1) for i in range(700, 730)] + [(None, 3), (9, 9)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    want = {x: root(x) for x in parent}
    got = {r[0]: r[1] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_match_breaks_ties_by_length_and_id(spark):
    q = spark.createDataFrame([("Carlos Salinas de Gortari",), ("Nobody Known",), (None,)], "name string")
    p = spark.createDataFrame([(3, "Salinas Gortari, Carlos"), (1, "Salinas Gortari, Carlos Pedro"), (2, "Salinas Gortari, Carlos"), (4, None)], "pid long, nm string")
    assert [tuple(r) for r in fuzzy.token_match(q, p, "name", "name", "pid", "nm").select("name", "pid").collect()] == [("Carlos Salinas de Gortari", 2)]


def test_biographies_are_split_into_fields(spark):
    text = "--- PAGE 3 ---\nabascal carranza, carlos (Deceased\nDec. 2, 2008)\na-June 14, 1949 b-Mexico City c-Law degree, Free School; PhD l-CB, 1988\nbaez, ana\na–1950 b–Leon, Guerr-\nero b–Puebla"
    df = spark.createDataFrame([("f", text)], "path string, value string")
    rows = {r.bio_row: r for r in parse.split_biographies(df).collect()}
    assert rows[1].name == "abascal carranza, carlos (Deceased Dec. 2, 2008)"
    assert rows[1].birth_date == "June 14, 1949" and rows[1].education == "Law degree, Free School; PhD"
    assert rows[2].name == "baez, ana" and rows[2].birthplace == "Puebla"
    assert parse.split_biographies(spark.createDataFrame([("f", "no marks")], "path string, value string")).count() == 0


def test_mentions_are_trimmed(spark):
    df = spark.createDataFrame([(1, "Son of Juan Perez, governor; married Ana Lopez who was a teacher; student of Al"), (2, None)], "id int, t string")
    got = {(r.kind, r.mention) for r in parse.mentions(df, ["id"], "t", rules.MENTIONS, rules.MENTION_TAIL).collect()}
    assert got == {("family", "Juan Perez"), ("family", "Ana Lopez")}


def test_json_answers(spark):
    df = spark.createDataFrame([('```json\n[{"id": 1, "related": "yes"}]\n```',), ("junk",), (None,)], "v string")
    got = [r[0] for r in df.select(parse.json_answers(F.col("v"), "array<struct<id:int,related:string>>")).collect()]
    assert got[0][0].related == "yes" and got[1:] == [None, None]


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", None), (2, 'q "x"', "y")], "id int, t string, u string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.csv(spark, str(tmp_path / "c"), "id int, t string, u string").collect())) == sorted(map(tuple, df.collect()))
    p = str(tmp_path / "t")
    df.write.parquet(p)
    tables.swap_in(spark.read.parquet(p).withColumn("id", F.col("id") + 1), p)
    assert sorted(r.id for r in spark.read.parquet(p).collect()) == [2, 3]
    assert tables.optional(spark, str(tmp_path / "none"), "a int").count() == 0
    tables.write_partitioned(df, str(tmp_path / "p"), "id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_positions_by_year(spark):
    q = spark.createDataFrame([(1, y) for y in (1990, 1995, 2005)], "p int, year int")
    r = spark.createDataFrame([(1, 1988, 1996, 1, 2, "low"), (1, 1994, None, 1, 3, "tie"), (1, 1995, 1999, 5, 4, "high"), (1, 1999, 1990, 9, 1, "reversed"), (1, None, 1995, 9, 1, "no start")], "p int, a int, b int, s int, q int, v string")
    got = {x.year: x.v for x in intervals.best_in_years(q, r, "p", "year", "a", "b", "s", "q", "v").collect()}
    assert got == {1990: "low", 1995: "high", 2005: ""}


def test_units_states_and_commanders(spark):
    df = spark.createDataFrame([("fought in Sonora and Baja California Sur under General Alvaro Obregon, 31st Infantry, Sonora Brigade",), (None,)], "t string")
    states = [r[0] for r in df.select(parse.states_named(F.col("t"), rules.STATE_VARIANTS)).collect()]
    assert sorted(states[0]) == ["Baja California", "Baja California Sur", "Sonora"]
    assert df.select(parse.units_and_commanders(F.col("t"))).first()[0] == ["31 Infantry", "under Gen. Alvaro Obregon"]
