"""Freely typed values to the entries of a reference list.

An Aho-Corasick automaton over the names and all aliases finds every embedded mention that
starts and ends at a word boundary; the longest non-overlapping mentions win, and a value
whose winning mentions name one entry is that entry.  A short alias (an acronym, an
abbreviation) counts inside a longer value only where it is written as in the list and no
name is mentioned.  Remaining values go to token-set similarity: tokens agree if equal, if one abbreviates the other (same first letter, its
letters in order), if they translate each other, or up to one or two edits; a value is
mapped if its best entry covers the entry's tokens and leaves little of the value over.
Anything else is reported as having no entry (-1).

The reference list is held by every task, so its size is checked; a longer list is cut into
shards that each value meets one by one (:func:`map_by_join`).  What a shard says of a value
is kept as evidence, from which the same rules settle the value over all shards.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .strings import edits, letters, plain

#: Entries up to which the reference list is sent to every task.
MOST_ENTRIES = 50_000
#: Distinct values a task remembers.
REMEMBERED = 200_000
#: Distinct values, and their bytes, that meet a shard of a long reference list in one task.
BUCKET, BUCKET_BYTES = 20_000, 16_000_000
#: Share of agreeing token weight from which a value counts as its best entry.
ENOUGH = 0.72

# Words that carry no content, and words of other languages for words of the lists.
STOP = frozenset("of the for and de del la las los y f a to in".split())
WORDS = {
    "nac": "national", "nacional": "national", "nal": "national", "nat": "national", "natl": "national", "ntl": "national", "banco": "bank", "bco": "bank", "direccion": "directorate", "dir": "directorate",
    "instituto": "institute", "inst": "institute", "comision": "commission", "cmsn": "commission", "comm": "commission", "com": "commission", "secretaria": "secretariat", "sria": "secretariat",
    "departamento": "department", "depto": "department", "dept": "department", "dpto": "department", "sindicato": "union", "confederacion": "confederation", "camara": "chamber", "partido": "party", "frente": "front",
    "alianza": "alliance", "fondo": "fund", "fideicomiso": "trust", "junta": "board", "bd": "board", "federal": "federal", "gral": "general", "gen": "general", "edo": "state", "estado": "state", "trabajadores": "workers", "productores": "producers",
}


def flat(value: str) -> str:
    """Lower case without accents; signs become blanks; blanks squeezed."""
    return re.sub(r"[^\w]+", " ", plain(value)).replace("_", " ").strip()


def tokens(value: str) -> list[str]:
    return [t for t in flat(value.replace("'", "")).split() if t not in STOP]


def _abbreviates(short: str, long: str) -> bool:
    if not short or short[0] != long[0] or len(short) >= len(long):
        return False
    i = 0
    for c in long:
        if i < len(short) and c == short[i]:
            i += 1
    return i == len(short)


def token_score(q: str, e: str) -> float:
    """Agreement of a typed token with a token of an entry."""
    if q == e:
        return 1.0
    if WORDS.get(q) == e:
        return 0.95
    if len(q) < len(e) and _abbreviates(q, e) and len(q) <= max(4, len(e) - 2):
        return 0.9 if e.startswith(q) and len(q) > 1 else 0.8 if len(q) > 1 else 0.75
    n = min(len(q), len(e))
    if n >= 4:
        most = 1 if n < 7 else 2
        k = edits(q, e, most)
        if k <= most:
            return 1.0 - 0.1 * k
    if n >= 3 and q[0] == e[0] and edits(q, e, 1) <= 1:
        return 0.8
    return 0.0


def _shorter(word: str, most: int) -> set[str]:
    """The word and what deleting up to ``most`` of its characters leaves."""
    out, level = {word}, {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


#: Longest word whose deletions are indexed; longer ones are found by their parts.
LONGEST = 16


class _Words:
    """Words under their deletions (short ones) or their parts (long ones), so that words within two edits
    are met without going through all of them; and by first letter, for abbreviations."""

    def __init__(self, words: list[str]):
        self.words = words
        self.near_: dict[str, list[int]] = defaultdict(list)
        self.part: dict[str, list[int]] = defaultdict(list)
        self.first: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            self.first[w[0]].append(i)
            if len(w) <= LONGEST:
                for d in _shorter(w, 2):
                    self.near_[d].append(i)
            for part, _ in _parts(w) if len(w) >= LONGEST - 2 else ():
                self.part[part].append(i)
        self.bits = np.array([letters(w) for w in words], np.uint64)
        self.initial = {c: np.array(at) for c, at in self.first.items()}

    def near(self, q: str) -> set[int]:
        """Words that can be within two edits of ``q``."""
        out: set[int] = set()
        if len(q) <= LONGEST:
            for d in _shorter(q, 2):
                out.update(self.near_.get(d, ()))
        if len(q) >= LONGEST - 2:  # two edits leave one of three parts whole, shifted by two at most
            for w in {(at + shift, n) for n0 in range(len(q) - 2, len(q) + 3) for at, n in _cuts(n0) for shift in range(-2, 3)}:
                at, n = w
                if at >= 0 and (hits := self.part.get(q[at : at + n])):
                    out.update(i for i in hits if abs(len(self.words[i]) - len(q)) <= 2)
        return out

    def longer(self, q: str) -> set[int]:
        """Words that can have this abbreviation."""
        at = self.initial.get(q[0])
        if at is None:
            return set()
        b = np.uint64(letters(q))
        return {int(i) for i in at[self.bits[at] & b == b] if len(self.words[i]) > len(q)}


def _cuts(n: int) -> list[tuple[int, int]]:
    """Start and length of the three parts of a word of ``n`` characters."""
    third = n // 3
    return [(0, third), (third, third), (2 * third, n - 2 * third)]


def _parts(word: str) -> list[tuple[str, int]]:
    return [(word[at : at + n], at) for at, n in _cuts(len(word))]


def _one(refs: set[int]) -> int:
    return next(iter(refs)) if len(refs) == 1 else -1


#: Rank of a mention: by a name, by an alias of several words, by a short alias.
NAME, ALIAS, SHORT = range(3)


def mentioned(spans: list[tuple[int, int, int, int]]) -> set[int]:
    """Entries of the longest non-overlapping mentions ``(length, start, rank, entry)``; of equal texts a name goes
    before an alias, and short aliases count only where nothing else is mentioned."""
    places: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    least = min((s[2] for s in spans), default=NAME)
    for n, at, rank, ref in spans:
        if rank < SHORT or least == SHORT:
            places[-n, at].append((rank, ref))
    taken, out = [], set()
    for (n, at), who in sorted(places.items()):
        if all(at - n <= s or at >= e for s, e in taken):
            taken.append((at, at - n))
            out.update(ref for rank, ref in who if rank == min(who)[0])
    return out


def settle(parts: list[dict], enough: float = ENOUGH) -> int:
    """The entry meant, or -1, from what every shard of the reference list says of a value (:meth:`Matcher.evidence`)."""
    if short := {r for p in parts for r in p["short"]}:
        return _one(short)
    if refs := mentioned([tuple(s.values()) for p in parts for s in p["spans"]]):
        return _one(refs)
    scores = sorted(((s, p["ref"]) for p in parts for s in (p["best"], p["second"])), reverse=True)
    if scores and scores[0][0] >= enough and scores[0][0] > scores[1][0] + 1e-9:
        return scores[0][1]
    least = min((p["k"] for p in parts if p["near"]), default=0)
    return _one({r for p in parts if p["k"] == least for r in p["near"]})


def _written(alias: str, value: str) -> bool:
    """Whether a value holds an alias as it is written in the list, between signs or blanks."""
    at = value.find(alias)
    while at >= 0:
        end = at + len(alias)
        if not value[at - 1 : at].isalnum() and not value[end : end + 1].isalnum():
            return True
        at = value.find(alias, at + 1)
    return False


class Matcher:
    """Reference entries ``(id, name, aliases)``; ``find`` gives the id meant or -1."""

    def __init__(self, entries: list[tuple[int, str, tuple[str, ...]]], enough: float = ENOUGH):
        self.enough = enough
        self.short: dict[str, set[int]] = defaultdict(set)
        self.entry: dict[int, list[str]] = {}
        self.distinct: dict[int, set[str]] = {}
        self.by_token: dict[str, set[int]] = defaultdict(set)
        automaton = ahocorasick.Automaton()
        forms: dict[str, dict[int, dict[int, set[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for ref, name, aliases in entries:
            self.entry[ref] = tokens(name)
            self.distinct[ref] = set(self.entry[ref])
            for t in self.distinct[ref]:
                self.by_token[t].add(ref)
            forms[flat(name)][NAME][ref].add(name)
            for a in aliases:
                text = flat(a)
                key = text.replace(" ", "")
                if not key:
                    continue
                self.short[key].add(ref)
                forms[text][ALIAS if " " in text and len(key) > 5 else SHORT][ref].add(a.strip(" ."))
        self.words = _Words(list(self.by_token))
        self.squashed: dict[str, set[int]] = defaultdict(set)
        some = False
        for text, ranks in forms.items():
            if text:
                # of equal texts only the best rank counts
                rank = min(ranks)
                automaton.add_word(f" {text} ", (len(text), rank, [(ref, sorted(ranks[rank][ref])) for ref in sorted(ranks[rank])]))
                some = True
                if rank < SHORT:
                    self.squashed[text.replace(" ", "")].update(*(ranks[r] for r in ranks if r < SHORT))
        self.automaton = automaton if some else None
        if self.automaton is not None:
            automaton.make_automaton()
        self.whole = _Words(list(self.squashed))
        self.memo: dict[str, int] = {}
        self.alike: dict[str, dict[str, float]] = {}

    def spans(self, text: str, value: str) -> list[tuple[int, int, int, int]]:
        """Mentions in a flat text and the value it comes from: length, start, rank, entry."""
        if self.automaton is None:
            return []
        out = []
        for end, (n, rank, refs) in self.automaton.iter(f" {text} "):
            out.extend((n, end - n - 1, rank, ref) for ref, written in refs if rank < SHORT or any(_written(w, value) for w in written))
        return out

    def _candidates(self, qs: list[str]) -> dict[str, dict[str, float]]:
        return {q: self._alike(q) for q in set(qs)}

    def _alike(self, q: str) -> dict[str, float]:
        """Tokens of the entries that agree with a typed token; remembered, since typed tokens repeat."""
        hits = self.alike.get(q)
        if hits is None:
            hits = {}
            for i in self.words.near(q) | self.words.longer(q):
                t = self.words.words[i]
                if s := token_score(q, t):
                    hits[t] = s
            if q in self.by_token:
                hits[q] = 1.0
            if (w := WORDS.get(q)) and w in self.by_token:
                hits[w] = max(hits.get(w, 0), 0.95)
            if len(self.alike) >= REMEMBERED:
                self.alike.clear()
            self.alike[q] = hits
        return hits

    def similar(self, value: str) -> tuple[int, float, float]:
        """Best entry by token-set similarity, its score and the next one's."""
        qs = tokens(value)
        found = self._candidates(qs)
        # only an entry whose tokens are all met can be meant
        met: dict[int, set[str]] = defaultdict(set)
        for hits in found.values():
            for t in hits:
                for ref in self.by_token[t]:
                    met[ref].add(t)
        refs = [ref for ref, ts in met.items() if len(ts) == len(self.distinct[ref])]
        best, second = (0.0, -1), 0.0
        for ref in refs:
            es = self.entry[ref]
            pairs = sorted(((found[q].get(e, 0.0), len(e), i, j) for i, q in enumerate(qs) for j, e in enumerate(es) if e in found[q]), reverse=True)
            used_q, used_e, hit, worst = set(), set(), 0.0, 1.0
            for s, n, i, j in pairs:
                if i not in used_q and j not in used_e:
                    used_q.add(i)
                    used_e.add(j)
                    hit += s
            if len(used_e) < len(es):
                continue
            if len(es) > 1 and not any(len(qs[i]) >= 4 for i in used_q):
                continue
            rest = len(qs) - len(used_q)
            score = hit / (len(es) + 0.5 * rest)
            if score > best[0]:
                second, best = best[0], (score, ref)
            elif score > second:
                second = score
        return best[1], best[0], second

    def misspaced(self, text: str) -> tuple[int, set[int]]:
        """Fewest edits, one or two at most, to a name with blanks left out of both, and the entries so near."""
        key = text.replace(" ", "")
        most = 1 if len(key) < 12 else 2
        best, refs = most + 1, set()
        if len(key) >= 6:
            for i in self.whole.near(key):
                name = self.whole.words[i]
                if (k := edits(key, name, min(most, best))) <= min(most, best):
                    refs = self.squashed[name] if k < best else refs | self.squashed[name]
                    best = k
        return best, refs

    def evidence(self, value: str, all_of_it: bool = True) -> dict:
        """What these entries say of a value; unless all of it, what cannot matter if there are no other entries is left out."""
        text = flat(value)
        key = text.replace(" ", "")
        out = {"short": sorted(self.short.get(key, ())), "spans": [], "best": 0.0, "second": 0.0, "ref": -1, "k": 0, "near": []}
        if out["short"]:
            return out
        out["spans"] = [{"n": n, "at": at, "rank": rank, "ref": ref} for n, at, rank, ref in self.spans(text, value)]
        if out["spans"]:
            return out
        ref, best, second = self.similar(value)
        if best >= self.enough:
            out |= {"ref": ref, "best": best, "second": second}
        if all_of_it or best < self.enough or best <= second + 1e-9:
            k, near = self.misspaced(text)
            out |= {"k": k, "near": sorted(near)}
        return out

    def find(self, value: str) -> int:
        got = self.memo.get(value)
        if got is not None:
            return got
        got = settle([self.evidence(value, all_of_it=False)], self.enough)
        if len(self.memo) >= REMEMBERED:
            self.memo.clear()
        if len(value) <= 256:
            self.memo[value] = got
        return got


def _mapper(make: Callable[[], dict[str, Matcher]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = make()
        for b in batches:
            rec, field, value = (c.to_pylist() for c in b.columns)
            out = [matchers[f].find(v) for f, v in zip(field, value)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64())], names=["record_id", "field", "value", "ref_id"])

    return run


def map_values(values: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """``record_id, field, value`` with the ``ref_id`` meant, -1 if the list has none.

    ``references`` has for each field a frame ``ref_id, name, aliases``.  Defined results:
    null values are no case and come out not at all; an empty or signs-only value is
    reported with -1; a value whose mentions name several entries is reported with -1; an
    empty reference list reports all; repeated records come out as often as they came in.
    Reference lists above :data:`MOST_ENTRIES` rows go through :func:`map_by_join`.
    """
    values = values.where("value is not null").select("record_id", "field", "value")
    held, parts = {}, []
    for f, ref in references.items():
        rows = ref.limit(MOST_ENTRIES + 1).collect()
        if len(rows) > MOST_ENTRIES:
            parts.append(map_by_join(values.where(F.col("field") == f), ref))
        else:
            held[f] = [(r[0], r[1], tuple(a for a in r[2] or () if a)) for r in rows if r[1]]
    if held:
        here = values.where(F.col("field").isin(*held))
        parts.append(here.mapInArrow(_mapper(lambda: {f: Matcher(e) for f, e in held.items()}), "record_id long, field string, value string, ref_id long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_EVIDENCE = "value string, short array<long>, spans array<struct<n: int, at: int, rank: int, ref: long>>, best double, second double, ref long, k int, near array<long>"


def _shard_evidence(values: pa.Table, entries: pa.Table) -> pa.Table:
    """Evidence of one shard on one bucket of values; values of which it says nothing fall away."""
    span = pa.struct([("n", pa.int32()), ("at", pa.int32()), ("rank", pa.int32()), ("ref", pa.int64())])
    kinds = pa.schema([("value", pa.string()), ("short", pa.list_(pa.int64())), ("spans", pa.list_(span)), ("best", pa.float64()), ("second", pa.float64()), ("ref", pa.int64()), ("k", pa.int32()), ("near", pa.list_(pa.int64()))])
    out = []
    if values.num_rows and entries.num_rows:
        m = Matcher([(ref, name, tuple(a for a in aliases or () if a)) for ref, name, aliases in zip(*(entries[c].to_pylist() for c in ("ref_id", "name", "aliases")))])
        for v in values["value"].to_pylist():
            e = m.evidence(v)
            if e["short"] or e["spans"] or e["best"] or e["near"]:
                out.append({"value": v} | e)
    return pa.Table.from_pylist(out, kinds)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([settle(p) for p in b.column(1).to_pylist()], pa.int64())], names=["value", "meant"])


def map_by_join(values: DataFrame, ref: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """The same mapping for a reference list of any length: every distinct value meets every
    shard of about ``most`` entries, and the evidence of all shards settles it."""
    entries = ref.toDF("ref_id", "name", "aliases").where("name <> ''")
    distinct = values.select("value").where("value is not null").distinct()
    n, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    shards, buckets = max(1, -(-entries.count() // most)), 1 + max(n // BUCKET, size // BUCKET_BYTES)
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = distinct.withColumn("bucket", part("value", buckets)).withColumn("shard", each(shards))
    right = entries.withColumn("shard", part("ref_id", shards)).withColumn("bucket", each(buckets))
    said = left.groupBy("bucket", "shard").cogroup(right.groupBy("bucket", "shard")).applyInArrow(_shard_evidence, _EVIDENCE)
    gathered = said.groupBy("value").agg(F.collect_list(F.struct(*[c for c in said.columns if c != "value"])).alias("parts"))
    settled = gathered.mapInArrow(_settled, "value string, meant long")
    return values.join(settled, "value", "left").select("record_id", "field", "value", F.coalesce("meant", F.lit(-1).cast("long")).alias("ref_id"))
