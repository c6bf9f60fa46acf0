"""Continuous periods and skew-safe per-key results against brute force and on edge cases."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from vitaeflow.operators.periods import IntervalMap, continuous_periods
from vitaeflow.operators.skew import dominant_keys, grouped_by_hot_key

SCHEMA = "who long, a int, b int, kind string, lo string, entity string"


def brute(rows):
    out = set()
    by = {}
    for who, a, b, *_ in rows:
        if who is not None and a is not None:
            b = a if b is None else b
            by.setdefault(who, set()).update(range(min(a, b), max(a, b) + 1))
    for who, years in by.items():
        ys = sorted(years)
        start = prev = ys[0]
        spans = []
        for y in ys[1:]:
            if y != prev + 1:
                spans.append((start, prev))
                start = y
            prev = y
        spans.append((start, prev))
        out |= {(who, "period", s, e) for s, e in spans}
        out |= {(who, "gap", e + 1, s - 1) for (_, e), (s, _) in zip(spans, spans[1:])}
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 8)), max_size=20))
def test_interval_map_equals_brute_force(spans):
    m = IntervalMap()
    for a, n in spans:
        m.insert(a, a + n)
    found = {(1, "period", *p) for p in m.periods()} | {(1, "gap", *g) for g in m.gaps()}
    assert found == brute([(1, a, a + n) for a, n in spans])


def test_periods_with_hot_person_nulls_and_clashing_columns(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(1900, 1990)]), rng.choice([None, *range(1900, 1990)]), "k", "x", "y") for _ in range(400)]
    df = spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(4)
    got = {tuple(r) for r in continuous_periods(df, "who", "a", "b", flush_at=5).collect()}
    assert got == brute(rows)


def test_periods_of_nothing(spark):
    assert continuous_periods(spark.createDataFrame([], SCHEMA), "who", "a", "b").count() == 0
    assert continuous_periods(spark.createDataFrame([(1, None, 5, None, None, None)], SCHEMA), "who", "a", "b").count() == 0


def test_skewed_groups_equal_plain_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None, ""]), rng.choice([None, *range(300)]), "n") for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, n string")
    got = {r["key"]: tuple(r)[1:] for r in grouped_by_hot_key(df, "k", "o", 7).collect()}
    want = {}
    for k in {r[0] for r in rows} - {None}:
        mine = [r[1] for r in rows if r[0] == k]
        os_ = sorted(o for o in mine if o is not None)
        step = max([b - a for a, b in zip(os_, os_[1:])], default=0)
        want[k] = (len(mine), os_[0] if os_ else None, os_[-1] if os_ else None, step, len(set(os_)))
    assert got == want


def test_dominant_keys(spark):
    df = spark.createDataFrame([("a", i) for i in range(98)] + [("b", 1), ("c", 2), (None, 3)], "k string, o long")
    assert {r[0] for r in dominant_keys(df, "k", "o", 0.02).collect()} == {"a"}
    assert dominant_keys(df.where("k = 'z'"), "k", "o", 0.02).count() == 0


def test_rows_without_order_count_as_rows_only(spark):
    df = spark.createDataFrame([("a", None)] * 50 + [("a", 5), ("a", 9), ("b", None)], "k string, o long")
    assert {tuple(r) for r in grouped_by_hot_key(df, "k", "o", 6).collect()} == {("a", 52, 5, 9, 4, 2), ("b", 1, None, None, 0, 0)}
