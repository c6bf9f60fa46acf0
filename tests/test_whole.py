"""Queries that take every row, on fixtures worked out by hand."""

from vitaeflow.plans import catalog


def folder(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def result(spark, d, name):
    return sorted(map(tuple, catalog.QUERIES[name](spark, d).collect()))


ROLES = [
    (1, "governor, Guerrero, 1963–1969"), (2, "governor,\nGuerrero, 1963–\n1969"), (3, "deputy,\r\nJalisco, 1950"), (4, None), (5, "director\nof press"), (6, "senator,\n 1958"),
    (7, "judge\n214 mexican\npolitical biographies court"), (8, "mayor s, 1935–2009\nof Leon"),
]


def test_texts_of_several_lines_get_years(spark, tmp_path):
    d = folder(spark, tmp_path, parsed_positions=([*ROLES, ROLES[1]], "record_id long, role_text_raw string"))
    assert result(spark, d, "year_extract")[:6] == [
        (1, 1963, 1969, "governor, Guerrero"), (2, 1963, 1969, "governor,\nGuerrero"), (3, 1950, 1950, "deputy, Jalisco"), (4, None, None, None), (5, None, None, "director\nof press"), (6, 1958, 1958, "senator"),
    ]
    assert [r[0] for r in result(spark, d, "year_extract")] == [i for i, _ in ROLES]


def test_texts_of_several_lines_lose_fragments(spark, tmp_path):
    d = folder(spark, tmp_path, parsed_positions=(ROLES, "record_id long, role_text_raw string"))
    got = dict(result(spark, d, "fragments_stripped"))
    assert sorted(got) == [i for i, _ in ROLES] and got[4] is None and got[5] == "director\nof press"
    assert got[7] == "judge court" and got[8] == "mayor of Leon"


def test_entries_of_several_lines_are_parsed(spark, tmp_path):
    cells = [(1, "governor,\nGuerrero, 1963–1969; deputy, 1950", None, "judge\rof Leon, 1970", None, "abc")]
    d = folder(spark, tmp_path, biographies=(cells, "bio_row long, public_positions string, party_positions string, govt_positions string, labor_positions string, other_positions string"))
    assert result(spark, d, "entries_parsed") == [
        (1, 0, "public_positions", 0, "governor,\nGuerrero, 1963–1969", "governor,\nGuerrero", 1963, 1969), (1, 0, "public_positions", 1, "deputy, 1950", "deputy", 1950, 1950),
        (1, 2, "govt_positions", 0, "judge\rof Leon, 1970", "judge\rof Leon", 1970, 1970),
    ]


def test_accents_of_every_script_go(spark, tmp_path):
    texts = ["Cafe\u0301 nin\u0303o", "Café", "東京 México", "Киев, йод и и\u0306", "ά ᾷ", "Việt Nam", "ok \u2713 \U0001f5f3\ufe0f", "\ufeffá\u200b", "한글", "", None]
    want = ["Cafe nino", "Cafe", "東京 Mexico", "Киев, иод и и", "α α", "Viet Nam", "ok \u2713 \U0001f5f3", "\ufeffa\u200b", "한글", ""]
    d = folder(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert result(spark, d, "accents_stripped") == list(enumerate(want))


def test_torn_name_after_many_rows_is_rebuilt(spark, tmp_path):
    rows = [(i, f"Perez, Juan {'abcdefghij'[i % 10]}", "who, 1984. Lopez,") for i in range(4_998, 5_003)]
    rows[2] = (5_000, "Manuel", None)
    d = folder(spark, tmp_path, biographies=(rows, "bio_row long, name string, sources string"))
    got = {r[0]: r[1:] for r in result(spark, d, "names_rebuilt")}
    assert len(got) == 5 and got[5_000] == (True, "Lopez, Manuel") and not got[4_999][0]


def test_units_and_commanders_come_out(spark, tmp_path):
    rows = [(1, "captain, 4th Battalion, under General Juan Perez, 1914", None), (2, "major", "fought under Col. Ana Maria Ruiz; 11 Regiment"), (3, None, "12 Regiment")]
    d = folder(spark, tmp_path, biographies=(rows, "bio_row long, field_j string, govt_positions string"))
    assert result(spark, d, "multi_match_explode") == [(1, "4 Battalion"), (1, "under Gen. Juan Perez"), (2, "11 Regiment"), (2, "under Gen. Ana Maria Ruiz")]
