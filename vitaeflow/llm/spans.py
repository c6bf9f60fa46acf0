"""Long exact spans shared between texts, found with FM-indexes over shards of candidates.

1. Every text is hashed at all positions over ``K`` characters and winnowed: the smallest
   hash of every ``least - K + 1`` successive ones is kept, so any common span of ``least``
   characters leaves a common hash in both texts.  Texts whose hashes occur nowhere else
   share nothing and go no further.  A task hands on a copied text once, and a hash group
   never holds more than one row per text and task.
2. Candidates that are copies of one another are represented by the smallest id.  Each
   representative is indexed in one shard of bounded size; it is streamed against the
   shards that hold a text with a hash of its own, and no others.
3. A shard is an FM-index: the Burrows-Wheeler transform in a wavelet matrix of packed bits
   with block counts, and a sampled suffix array.  Windows of a streamed text are searched
   backward, all windows of a batch at once; windows still alive after their whole length
   are located and extended on both sides to the maximal match, in bounded blocks of
   occurrences.  Matches of ``least`` and more characters are reported with their interval in the streamed text.
4. Copies are given back at the end: as members of their class or, where pairs are asked
   for, as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.periods import continuous_periods
from ..session import cut_lineage, parallelism

#: Characters a common span must have.
LEAST = 200
#: Characters under one hash, as a share of the least span.
HASHED = 0.6
#: Characters of the texts that one shard indexes.
SHARD_CHARS = 1_000_000
#: Occurrences that are located and extended at once.
BLOCK = 200_000
#: Characters streamed against one copy of a shard before the stream is split.
STREAM_CHARS = 8_000_000
#: Ids and hashes up to which they are sent to every task to pick rows; more are joined.
MOST_SENT = 500_000

_BASE = np.uint64(0x100000001B3)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept per worker."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def winnowed(codes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes over ``k`` codes that are the smallest of some ``window`` successive ones, and where that window starts."""
    n = len(codes) - k + 1
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _powers(len(codes))
    x = (codes.astype(np.uint64) + np.uint64(1)) * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x *= up
    c = np.empty(len(codes) + 1, np.uint64)
    c[0] = 0
    np.cumsum(x, out=c[1:])
    h = c[k:] - c[:-k]
    h *= down[:n]
    h ^= h >> np.uint64(31)
    h *= _M1
    h ^= h >> np.uint64(30)
    m, span = h, 1
    while span * 2 <= window:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < window:
        m = np.minimum(m[: len(m) - (window - span)], m[window - span :])
    first = np.concatenate(([True], m[1:] != m[:-1]))
    at = np.flatnonzero(first)
    return m[at], at


def _fingerprints(k: int, window: int):
    least = k + window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()

        def out(docs: list[int], texts: list[str]) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], np.int64)
            codes = _codes("".join(texts))
            hashes, at = winnowed(codes, k, window)
            ends = np.cumsum(lengths)
            owner = np.searchsorted(ends, at, side="right")
            inside = at + least <= ends[np.minimum(owner, len(ends) - 1)] if len(at) else np.empty(0, bool)
            starts = ends - lengths
            # a window that begins a text is kept even if its hash equals that of the window before it
            miss = np.setdiff1d(starts, at, assume_unique=False)
            if len(miss):
                back = np.searchsorted(at, miss, side="right") - 1
                ok = back >= 0
                at2, h2 = miss[ok], hashes[back[ok]]
                own2 = np.searchsorted(ends, at2, side="right")
                hashes, owner, inside = np.concatenate((hashes, h2)), np.concatenate((owner, own2)), np.concatenate((inside, at2 + least <= ends[np.minimum(own2, len(ends) - 1)]))
            ids = np.asarray(docs, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes[inside].view(np.int64)), pa.array(ids[owner[inside]])], names=["h", "doc"])

        docs, texts, size = [], [], 0
        for b in batches:
            for doc, mark, text in zip(*(c.to_pylist() for c in b.columns)):
                if mark in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(mark)
                docs.append(doc)
                texts.append(text)
                size += len(text)
                if size > 1_000_000:
                    yield out(docs, texts)
                    docs, texts, size = [], [], 0
        if docs:
            yield out(docs, texts)

    return run


class Bits:
    """Packed bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """FM-index of an array of small symbols that ends in a unique smallest symbol 0."""

    STEP = 8

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.n = n
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.depth = max(1, int(text.max()).bit_length())
        self.levels = []
        level = bwt.astype(np.int64)
        for d in range(self.depth - 1, -1, -1):
            bit = (level >> d) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        counts = np.bincount(text, minlength=1 << self.depth)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.base = self._descend(np.zeros(1 << self.depth, np.int64), np.arange(1 << self.depth))
        marked = sa % self.STEP == 0
        self.marked = Bits(marked.astype(np.uint8))
        self.samples = sa[marked]

    def _descend(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        for d, bits in zip(range(self.depth - 1, -1, -1), self.levels):
            one = bits.ones(i)
            i = np.where((c >> d) & 1 == 1, bits.zeros + one, i - one)
        return i

    def rank(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` in the transform before ``i``."""
        return self._descend(i, c) - self.base[c]

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for d, bits in zip(range(self.depth - 1, -1, -1), self.levels):
            b = bits.get(i)
            one = bits.ones(i)
            i = np.where(b, bits.zeros + one, i - one)
            c |= b.astype(np.int64) << d
        return c

    def step(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after one more symbol on the left."""
        return self.first[c] + self.rank(lo, c), self.first[c] + self.rank(hi, c)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array."""
        out = np.full(len(row), -1, np.int64)
        open_, steps, at = np.arange(len(row)), np.zeros(len(row), np.int64), row.copy()
        while len(open_):
            hit = self.marked.get(at)
            done = open_[hit]
            out[done] = self.samples[self.marked.ones(at[hit])] + steps[done]
            open_, at = open_[~hit], at[~hit]
            if len(open_):
                c = self.access(at)
                at = self.first[c] + self.rank(at, c)
                steps[open_] += 1
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only suffixes still tied are sorted again."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    per = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for i in range(per):
        key <<= bits
        key[: n - i] |= text[i:].astype(np.int64)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(new)
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    k = per
    while True:
        sizes = np.diff(np.append(starts, n))
        tied_groups = sizes > 1
        if not tied_groups.any():
            return sa
        slots = np.flatnonzero(np.repeat(tied_groups, sizes))
        sub = sa[slots]
        behind = sub + k
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        order = np.lexsort((second, rank[sub]))
        sub, second, lead = sub[order], second[order], rank[sub][order]
        sa[slots] = sub
        fresh = np.concatenate(([True], (lead[1:] != lead[:-1]) | (second[1:] != second[:-1])))
        head = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[sub] = head
        all_new = np.zeros(n, bool)
        all_new[starts] = True
        all_new[slots[fresh]] = True
        starts = np.flatnonzero(all_new)
        k *= 2


class Shard:
    """Indexed texts of one shard, and the search of other texts in it."""

    def __init__(self, docs: list[int], texts: list[str], least: int):
        self.docs, self.least = np.asarray(docs, np.int64), least
        joined = [_codes(t) for t in texts]
        self.alphabet = np.unique(np.concatenate(joined))
        parts = []
        for c in joined:
            parts.append(np.searchsorted(self.alphabet, c) + 2)
            parts.append(np.array([1]))
        parts.append(np.array([0]))
        self.text = np.concatenate(parts).astype(np.int32)
        self.starts = np.cumsum([0] + [len(c) + 1 for c in joined])[:-1]
        self.index = FMIndex(self.text)

    def _symbols(self, codes: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[k] == codes, k + 2, -1).astype(np.int32)

    def matches(self, docs: list[int], texts: list[str]) -> tuple[np.ndarray, ...]:
        """Maximal common spans of ``least`` and more: streamed doc, indexed doc, first and last position in the streamed one."""
        size = self.least // 2
        queries = [self._symbols(_codes(t)) for t in texts]
        flat = np.concatenate(queries)
        begins = np.cumsum([0] + [len(q) for q in queries])
        where = np.concatenate([b + np.arange(0, len(q) - size + 1, size) for b, q in zip(begins, queries) if len(q) >= size] or [np.empty(0, np.int64)]).astype(np.int64)
        lo, hi = np.zeros(len(where), np.int64), np.full(len(where), self.index.n, np.int64)
        for i in range(size - 1, -1, -1):
            c = flat[where + i].astype(np.int64)
            alive = c >= 0
            where, lo, hi, c = where[alive], lo[alive], hi[alive], c[alive]
            lo, hi = self.index.step(lo, hi, c)
            alive = lo < hi
            where, lo, hi = where[alive], lo[alive], hi[alive]
            if not len(where):
                break
        if not len(where):
            return tuple(np.empty(0, np.int64) for _ in range(4))
        owner = np.asarray(docs, np.int64)
        out = [np.empty((4, 0), np.int64)]
        n = hi - lo
        before = np.concatenate(([0], np.cumsum(n)))
        total, at = int(before[-1]), 0
        while at < total:  # occurrences are located and extended in bounded blocks, wherever one window's begin and end
            end = min(total, at + BLOCK)
            k = np.arange(at, end)
            w = np.searchsorted(before, k, side="right") - 1
            out.append(self._extend(owner, flat, begins, where[w], self.index.locate(lo[w] + k - before[w])))
            at = end
        return tuple(np.unique(np.concatenate(out, axis=1), axis=1))

    def _extend(self, owner: np.ndarray, flat: np.ndarray, begins: np.ndarray, seeds: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Maximal matches around seeds: streamed doc, indexed doc, first and last position in the streamed one."""
        q = np.searchsorted(begins, seeds, side="right") - 1
        s = np.searchsorted(self.starts, spots, side="right") - 1
        other = owner[q] != self.docs[s]
        seeds, spots, q, s = seeds[other], spots[other], q[other], s[other]
        # of successive windows on one diagonal the first stands for all that its match reaches
        order = np.lexsort((seeds, spots - seeds, s, q))
        seeds, spots, q, s = seeds[order], spots[order], q[order], s[order]
        size = self.least // 2
        follows = np.zeros(len(seeds), bool)
        follows[1:] = (q[1:] == q[:-1]) & (s[1:] == s[:-1]) & (spots[1:] - seeds[1:] == spots[:-1] - seeds[:-1]) & (seeds[1:] - seeds[:-1] == size)
        seeds, spots, q, s = seeds[~follows], spots[~follows], q[~follows], s[~follows]
        left = _reach(flat, self.text, seeds - 1, spots - 1, np.minimum(seeds - begins[q], spots - self.starts[s]), -1)
        ends = np.append(self.starts[1:], len(self.text) - 1)[s] - 1  # where the sign after the indexed text stands
        right = _reach(flat, self.text, seeds, spots, np.minimum(begins[q + 1] - seeds, ends - spots), 1)
        first = seeds - left - begins[q]
        enough = left + right >= self.least
        return np.stack((owner[q], self.docs[s], first, first + left + right - 1))[:, enough]


def _reach(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many characters agree from positions ``i`` and ``j`` on in direction ``step``, for all pairs at once."""
    out = np.zeros(len(i), np.int64)
    open_ = np.flatnonzero(most > 0)
    width = 16
    while len(open_):
        offset = np.arange(width)[None, :]
        at = out[open_, None] + offset
        inside = at < most[open_, None]
        at = np.minimum(at, most[open_, None] - 1) * step
        same = (x[i[open_, None] + at] == y[j[open_, None] + at]) & inside
        run = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        out[open_] += run
        open_ = open_[(run == width) & (out[open_] < most[open_])]
        width = min(1024, width * 4) if len(open_) * width < 4_000_000 else width
    return out


def _search(least: int, batch_chars: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, kept, waiting, size = None, None, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, waiting, size
            if shard is None:
                shard = Shard([k[0] for k in kept], [k[1] for k in kept], least)
            cols = shard.matches([w[0] for w in waiting], [w[1] for w in waiting])
            waiting, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "other", "lo", "hi"])

        for b in batches:
            for part, kind, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                if part != current:
                    if waiting and kept:
                        yield flush()
                    current, shard, kept, waiting, size = part, None, [], [], 0
                if kind == 0:
                    kept.append((doc, text))
                else:
                    waiting.append((doc, text))
                    size += len(text)
                    if size > batch_chars and kept:
                        yield flush()
        if waiting and kept:
            yield flush()

    return run


def text_classes(texts: DataFrame, least: int) -> DataFrame:
    """``doc, rep`` of every text of ``least`` characters and more: the smallest id with exactly this text."""
    marks = texts.where(F.length("text") >= least).select("doc", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u"))
    reps = marks.groupBy("t", "u").agg(F.min("doc").alias("rep"))
    return marks.join(reps, ["t", "u"]).select("doc", "rep")


def shared_spans(texts: DataFrame, least: int = LEAST, both: bool = True, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, DataFrame]:
    """Maximal spans ``doc, other, lo, hi`` shared by different texts, and the classes ``doc, rep`` of equal texts.

    ``lo`` and ``hi`` are the first and last position in ``doc``; both documents are
    representatives of their class.  With ``both`` each pair is reported in both directions,
    else from the greater id to the smaller only."""
    k = max(1, int(least * HASHED))
    spark = texts.sparkSession
    n = parallelism(spark)
    long_ = texts.where(F.length("text") >= least)
    prints = long_.select("doc", F.xxhash64("text").alias("mark"), "text").mapInArrow(_fingerprints(k, least - k + 1), "h long, doc long")
    common = _met(cut_lineage(prints))
    classes = cut_lineage(text_classes(texts, least))
    own = _met(cut_lineage(common.join(classes, "doc").select("h", F.col("rep").alias("doc")).distinct()))
    ids = cut_lineage(own.select("doc").distinct())
    picked = cut_lineage(long_.join(_sent(ids), "doc", "left_semi").select("doc", "text"))
    chars = picked.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-int(chars) // shard_chars))
    home = F.pmod(F.xxhash64("doc"), F.lit(shards))
    homes = own.withColumn("shard", home)
    held = homes.groupBy("h", "shard").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    met = own.join(held, "h")
    met = met.where("low <> high or low <> doc") if both else met.where("low < doc")
    routes = cut_lineage(met.select("doc", "shard").distinct())
    lengths = picked.select("doc", F.length("text").alias("n"))
    splits = routes.join(lengths, "doc").groupBy("shard").agg(F.ceil(F.sum("n") / STREAM_CHARS).cast("int").alias("splits"))
    streamed = routes.join(splits, "shard").select("doc", F.concat_ws("/", "shard", F.pmod(F.xxhash64(F.lit(7), "doc"), F.col("splits"))).alias("part"), F.lit(1).alias("kind"))
    indexed = picked.select("doc", home.alias("shard")).join(splits, "shard").select("doc", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("s"), "shard").select("doc", F.concat_ws("/", "shard", "s").alias("part"), F.lit(0).alias("kind"))
    rows = indexed.union(streamed.select(*indexed.columns)).join(picked, "doc").select("part", "kind", "doc", "text")
    spans = rows.repartition(max(n, shards), "part").sortWithinPartitions("part", "kind").mapInArrow(_search(least), "doc long, other long, lo long, hi long")
    return spans, classes


def _sent(ids: DataFrame) -> DataFrame:
    """Ids for a semi join: sent to every task if they are few, else joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def _met(prints: DataFrame) -> DataFrame:
    """Rows whose hash occurs in more than one document.  Minimum and maximum are formed before the
    shuffle, so a hash that a third of all documents hold moves one row per task."""
    hashes = prints.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("h")
    return prints.join(_sent(cut_lineage(hashes)), "h", "left_semi")


def _texts(df: DataFrame, doc: str, text: str) -> DataFrame:
    return df.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))


def sharing_pairs(df: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Pairs ``a < b`` of documents with a common substring of ``least`` and more characters.

    Defined results: null and shorter texts share nothing; equal texts share all of
    themselves; a repeat inside one document is no case; a document id that stands on
    several rows is one document; an empty table gives no pairs."""
    spans, classes = shared_spans(_texts(df, doc, text), least, both=False)
    classes = classes.distinct()
    linked = spans.select(F.col("doc").alias("x"), F.col("other").alias("y")).distinct()
    across = linked.join(classes.select(F.col("rep").alias("x"), F.col("doc").alias("a")), "x").join(classes.select(F.col("rep").alias("y"), F.col("doc").alias("b")), "y").select("a", "b")
    several = classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    members = classes.join(several, "rep")
    within = members.select("rep", F.col("doc").alias("a")).join(members.select("rep", F.col("doc").alias("b")), "rep").where("a < b").select("a", "b")
    return across.union(within).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared_characters(df: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc, n_chars, n_shared`` of every document: characters that stand in a span of ``least`` and more
    shared with another document; 0 for null and shorter texts.  An id on several rows counts by its longest text."""
    spans, classes = shared_spans(_texts(df, doc, text), least, both=True)
    covered = continuous_periods(spans, "doc", "lo", "hi").where("kind = 'period'").groupBy("doc").agg(F.sum(F.col("year_to") - F.col("year_from") + 1).alias("n")).withColumnRenamed("doc", "rep")
    several = classes.distinct().groupBy("rep").agg((F.count("*") > 1).alias("copied"))
    by_doc = classes.distinct().join(several, "rep").join(covered, "rep", "left").groupBy("doc").agg(F.max("copied").alias("copied"), F.max(F.coalesce("n", F.lit(0))).alias("n"))
    sizes = df.where(F.col(doc).isNotNull()).groupBy(F.col(doc).cast("long").alias("doc")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("n_chars"))
    return sizes.join(by_doc, "doc", "left").select("doc", "n_chars", F.coalesce(F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("n")), F.lit(0)).cast("long").alias("n_shared"))
