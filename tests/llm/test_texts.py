"""Tokens, containers and shared spans."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from vitaeflow.llm import packing
from vitaeflow.llm.packing import best_fit, fill_containers, fill_histogram, fill_report, lower_bound
from vitaeflow.llm.spans import FMIndex, shared_characters, sharing_pairs, suffix_array, winnowed
from vitaeflow.llm.tokens import TOKENIZERS, Encoder, decoded, rank_file, token_counts, token_ids

TEXTS = ["", None, "  \t\n", "Hello world, it's 1998!", "<|endoftext|>", "señor Ñandú – 日本 ½ Ⅷ \x1c _x_", "a" * 5000, "don't we'll 'S\r\n\r\n x"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(rank_file())


def test_ids_equal_the_public_encoder(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(0)
    made = ["".join(chr(rng.choice([32, 10, *range(39, 127), *range(0xC0, 0x180), 0x4E00, 0x1F600])) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for x in [x for x in TEXTS if x] + made:
        assert encoder.encode(x) == t.encode(x, add_special_tokens=False).ids
        assert encoder.decode(encoder.encode(x)) == x


def test_token_frames(spark, encoder):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)] + [(None, "x", None), (3, TEXTS[3], None)], "doc_id long, text string, ids array<int>")
    got = token_ids(df)
    rows = {r.doc_id: r.ids for r in got.collect()}
    assert rows == {i: encoder.encode(t) for i, t in enumerate(TEXTS)} | {None: encoder.encode("x")} and got.count() == len(TEXTS) + 2
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {k: len(v) for k, v in rows.items()}
    assert {r.doc_id: r.text for r in decoded(got).collect()} == {i: t or "" for i, t in enumerate(TEXTS)} | {None: "x"}
    assert token_ids(df.where("false")).count() == 0


def optimum(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[i] and rooms[j] not in rooms[:j]:
                rooms[j] -= items[i]
                place(i + 1, rooms)
                rooms[j] += items[i]
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def held(plan, capacity):
    out = Counter()
    for times, sizes in plan:
        assert times > 0 and sum(sizes) <= capacity
        for s in sizes:
            out[s] += times
    return out


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(1)
    for _ in range(150):
        items = [rng.randint(1, 25) for _ in range(rng.randint(1, 11))]
        counts = Counter(items)
        got, fit = fill_histogram(counts, 25), best_fit(counts, 25)
        assert held(got.plan, 25) == counts == held(fit, 25) and got.nodes > 0
        assert got.containers == got.bound == optimum(items, 25) <= sum(t for t, _ in fit) and lower_bound(counts, 25) <= got.bound
    assert fill_histogram({}, 5) == ([], 0, 0)


def plain_best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - x)
    return len(rooms)


def test_best_fit_over_a_histogram_is_best_fit():
    rng = random.Random(8)
    for _ in range(200):
        items = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))] * rng.randint(1, 3)
        assert sum(t for t, _ in best_fit(Counter(items), 40)) == plain_best_fit(items, 40)


def test_triplets_are_filled_without_waste():
    for seed in range(3):
        rng, items = random.Random(seed), []
        for _ in range(40):
            a = rng.randint(380, 490)
            b = rng.randint(250, (1000 - a) // 2)
            items += [a, b, 1000 - a - b]
        got = fill_histogram(Counter(items), 1000)
        assert got.containers == got.bound == 40 < sum(t for t, _ in best_fit(Counter(items), 1000)) and held(got.plan, 1000) == Counter(items)


def test_effort_is_bounded_and_the_gap_is_told(spark):
    rng, items = random.Random(1), []
    for _ in range(40):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        items += [a, b, 1000 - a - b]
    got = fill_histogram(Counter(items), 1000, most_nodes=500)
    assert got.nodes <= 500 and 41 <= got.containers <= sum(t for t, _ in best_fit(Counter(items), 1000)) and got.bound == 40
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "doc_id long, n_tokens long")
    assert fill_report(df, 1000, most_nodes=500).first() == (got.containers, 40, got.containers - 40, 120, 40_000, (got.containers - 40) * 1_000) and fill_report(df.where("false"), 1000).first() == (0, 0, 0, 0, 0, 0)


def test_undominated_fillings_equal_a_full_enumeration():
    rng = random.Random(6)
    for _ in range(60):
        counts = Counter(rng.randint(1, 12) for _ in range(rng.randint(1, 7)))
        left = packing._Left(counts, 20)
        room, waste = rng.randint(1, 20), rng.randint(0, 3)
        got = [f for _, f in packing.fillings(left, room, waste)]
        every = {c for n in range(8) for c in combinations(sorted(counts.elements(), reverse=True), n) if 0 <= room - sum(c) <= waste}
        assert len(got) == len(set(got)) and set(got) <= every
        wastes = [room - sum(f) for f in got]
        assert wastes == sorted(wastes) and bool(got) == bool([f for f in every if not packing._dominated(left, f, room - sum(f))])


def test_histogram_plan_holds_every_item():
    rng = random.Random(2)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    got = fill_histogram(counts, 2048)
    assert held(got.plan, 2048) == counts and got.containers == got.bound


def test_assignment_depends_on_the_items_alone(spark):
    df = spark.createDataFrame([(i, 10 + i % 7) for i in range(300)], "doc_id long, n_tokens long")
    a, b = (fill_containers(df.repartition(n, "n_tokens"), 64).orderBy("doc_id").collect() for n in (1, 7))
    assert a == b


def test_containers_frame(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, None, 5, 64, 100, 101, 250, rng.randint(1, 100)]), 1) for i in range(700)] + [(9, 50, 1), (None, 3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, container int").repartition(3)
    out = fill_containers(df, 100).collect()
    room = Counter()
    for r in out:
        room[r.container] += r.n_tokens
    assert max(room.values()) <= 100 and set(room) == set(range(max(room) + 1))
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((d, min(100, n - 100 * p) if n else 0) for d, n, _ in rows for p in range(max(1, -(-(n or 0) // 100))))
    assert fill_containers(df.where("false"), 100).count() == 0


def test_suffix_array_and_index():
    rng = np.random.default_rng(4)
    for n, sigma in ((1, 1), (50, 2), (400, 3), (3000, 60)):
        text = np.append(rng.integers(1, sigma + 1, n), 0).astype(np.int32)
        if n == 3000:
            text[1000:2000] = text[:1000]
        sa = suffix_array(text)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        index = FMIndex(text)
        assert index.locate(np.arange(n + 1)).tolist() == sa.tolist()
        for size in (1, 3, 20):
            start = rng.integers(0, max(1, n - size))
            word = text[start : start + size]
            lo, hi = np.array([0]), np.array([n + 1])
            for c in word[::-1]:
                lo, hi = index.step(lo, hi, np.array([int(c)]))
            want = [i for i in range(n + 1) if text[i : i + len(word)].tolist() == word.tolist()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_winnowing_keeps_a_common_hash_of_every_common_span():
    rng = np.random.default_rng(5)
    for _ in range(40):
        span = rng.integers(97, 123, 60).astype(np.uint32)
        a = np.concatenate([rng.integers(97, 123, rng.integers(0, 90)).astype(np.uint32), span, rng.integers(97, 123, 50).astype(np.uint32)])
        b = np.concatenate([rng.integers(97, 123, rng.integers(0, 90)).astype(np.uint32), span])
        assert set(winnowed(a, 36, 25)[0].tolist()) & set(winnowed(b, 36, 25)[0].tolist())


def brute(texts, least):
    where = {}
    for d, t in texts.items():
        for p in range(len(t) - least + 1):
            where.setdefault(t[p : p + least], set()).add(d)
    pairs = {(a, b) for ds in where.values() for a in ds for b in ds if a < b}
    shared = {}
    for d, t in texts.items():
        mark = [False] * len(t)
        for p in range(len(t) - least + 1):
            if len(where[t[p : p + least]]) > 1:
                mark[p : p + least] = [True] * least
        shared[d] = sum(mark)
    return pairs, shared


def test_spans_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghij é日") for _ in range(n))
    pool = [word(60) for _ in range(12)]
    texts = {}
    for i in range(120):
        parts = [word(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(pool)
            cut = rng.randint(0, 30)
            parts += [s[cut : cut + rng.randint(25, 60)], word(rng.randint(0, 25))]
        texts[i] = "".join(parts)
    for i in range(120, 160):
        texts[i] = texts[rng.randint(0, 20)]  # copies, of one text many
    texts[200], texts[201] = "z" * 300, "y" + "z" * 45  # repeats inside one document
    least = 40
    rows = [(i, t, 0) for i, t in texts.items()] + [(300, None, 0), (301, "", 0), (302, "short", 0), (None, texts[0], 0), (5, texts[5], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc int").repartition(3)
    pairs, shared = brute(texts, least)
    assert {tuple(r) for r in sharing_pairs(df, least=least).collect()} == pairs
    got = {r.doc: r.n_shared for r in shared_characters(df, least=least).collect()}
    assert got == shared | {300: 0, 301: 0, 302: 0}
    assert sharing_pairs(df.where("false")).count() == 0


def test_one_text_copied_by_a_third_of_the_rows(spark):
    rng = random.Random(7)
    same = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, same) for i in range(60)] + [(1000 + i, "".join(rng.choice("abcdefgh ") for _ in range(300))) for i in range(60)] + [(5000, "head " + same[100:320])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in sharing_pairs(df).collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60)} | {(a, 5000) for a in range(60)}
