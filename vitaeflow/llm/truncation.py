"""Values that were cut at a field limit or mid-transfer.

1. Near-copies: the prefixes of every value are kept under banded min-hash keys over
   character 3-grams (each band is the smallest hash of the prefix, with one of the two
   stretches of letters before its end, so that prefixes that end alike meet); a value probes
   with its own keys and meets values whose prefix is alike.  Longer values that are equal
   up to two characters beyond come out of a band as one, with their total weight.  The
   value is aligned with every one of them, none is left out; where the alignment ends early,
   inside a word or at its border, the longer value is a continuation and the value its copy.
2. Copies that end inside a word tell how often each source cuts, and at which lengths.  A
   value that sources which hardly cut give often enough beside its continuations is whole.
3. Copies are judged by their alignment: cut inside a word, or at a border where the value
   next to never stands alone.  Only values without a copy, or whose alignment ends at a
   border, are scored by their closing word: how often it closes values, whether it is only
   the start of known words, whether a bracket or a clause is left open; an unknown closing
   word counts where the copies of the source at this length are mostly cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, parallelism
from .strings import edits, plain

#: Characters up to which every prefix gets its keys; beyond, those about as long as some value.
DENSE = 256
#: Shortest prefix that is compared.
SHORTEST = 6
#: Shortest value that may differ from its copy, by one edit for so many characters.
FUZZY = 16
#: Letters of each of the two stretches before the end of a prefix.
STRETCH = 6
#: Share of cut records from which a source counts as one that cuts.
CUTS = 0.05
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def normal(value: str) -> str:
    """Lower case without accents, words joined where they were broken over a line, blanks squeezed."""
    joined = re.sub(r"(?<=[^\W\d_])[-¬\xad‐][ \t]*(?:\r?\n[ \t]*|[ \t]+)(?=[^\W\d_])", "", value)
    return re.sub(r"\s+", " ", plain(joined)).strip()


def open_text(value: str) -> str:
    """The text that is compared: normal, and brackets dissolved, which copies set or leave out."""
    return re.sub(r"\s+", " ", re.sub(r"[()\[\]]", " ", normal(value))).strip()


def _mixed(x: np.ndarray, seed: int = _SEEDS[0]) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def prefix_table(texts: list[str], lengths: np.ndarray | None = None, own: bool = False) -> tuple[np.ndarray, ...]:
    """``row, key, mark`` of the prefixes of texts, a row for each band.

    ``own`` takes each text itself instead of its proper prefixes.  ``mark`` stands for the
    text up to two characters beyond the prefix.  Above :data:`DENSE` characters only the
    given lengths count, and those one more or less."""
    out: list[list[np.ndarray]] = []
    order = sorted((i for i, t in enumerate(texts) if len(t) >= SHORTEST), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        width = len(texts[order[at]])
        end = at + 1
        while end < len(order) and (end - at + 1) * len(texts[order[end]]) <= 400_000 and len(texts[order[end]]) <= 2 * width:
            end += 1
        out.append(_block([texts[i] for i in order[at:end]], np.asarray(order[at:end]), lengths, own))
        at = end
    return tuple(np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in range(3))


def _block(texts: list[str], rows: np.ndarray, lengths: np.ndarray | None, own: bool) -> list[np.ndarray]:
    n = np.array([len(t) for t in texts], np.int64)
    width = int(n.max())
    c = np.zeros((len(texts), width + 2), np.uint64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.arange(width + 2)[None, :] < n[:, None]
    c[inside] = flat
    place = np.arange(1, width + 3).astype(np.uint64)
    sums = np.cumsum(np.where(inside, _mixed(c) * (_mixed(place + np.uint64(1 << 32)) | np.uint64(1)), np.uint64(0)), axis=1, dtype=np.uint64)
    whole = _mixed(sums ^ (place << np.uint64(40)))  # a hash of the text up to each character
    g = (c[:, :-2] << np.uint64(42)) ^ (c[:, 1:-1] << np.uint64(21)) ^ c[:, 2:]
    stretch = np.zeros((len(texts), width), np.uint64)  # stretch[:, i]: letters i .. i + STRETCH - 1
    for k in range(STRETCH):
        stretch[:, : width - k] = stretch[:, : width - k] * np.uint64(0x100000001B3) + c[:, k:width] + np.uint64(7)
    size = np.arange(SHORTEST, width + 1)
    keep = (size[None, :] == n[:, None]) if own else (size[None, :] < n[:, None])
    if not own and lengths is not None and width > DENSE:
        keep &= (size <= DENSE) | np.isin(size, np.concatenate((lengths - 1, lengths, lengths + 1)))
    r, s = np.nonzero(keep)
    s = size[s]
    exact = s < FUZZY  # too short for a misread letter: the text itself
    head = np.maximum(s - 2 * STRETCH - 3, 0)  # last 3-gram before both stretches
    keys = []
    for j in range(2):
        key = stretch[r, np.maximum(s - STRETCH * (j + 1), 0)]
        for seed in _SEEDS[2 * j : 2 * j + 2]:
            key = _mixed(key ^ np.minimum.accumulate(_mixed(g, seed), axis=1)[r, head], _SEEDS[j])
        keys.append(np.where(exact, whole[r, s - 1], key).view(np.int64))
    mark = whole[r, np.minimum(s + 2, n[r]) - 1].view(np.int64)
    first = np.ones(2 * len(r), bool)
    first[1::2] = ~exact  # one band is enough for an exact prefix
    return [x[first] for x in (np.repeat(rows[r], 2), np.stack(keys, 1).reshape(-1), np.repeat(mark, 2))]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([open_text(v) for v in b.column("value").to_pylist()], pa.string())], names=[*b.schema.names, "text"])


@lru_cache(maxsize=1024)
def hash_of(table: str) -> int:
    """A number for the name of a table, so that equal texts of two tables have different keys."""
    return int.from_bytes(hashlib.blake2b(table.encode(), digest_size=8).digest(), "little", signed=True)


#: Keys a task gathers before it joins the equal ones and hands them on.
GATHERED = 1_500_000


def _keyed(lengths: np.ndarray, own: bool):
    """Keys of every text itself, or of its proper prefixes: one row for equal texts of a task, with their weight."""

    def joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        key, mark, tid, weight = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((-weight, mark, key))
        key, mark, tid, weight = key[order], mark[order], tid[order], weight[order]
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]))))
        return key[starts], mark[starts], tid[starts], np.add.reduceat(weight, starts)

    def out(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(cols[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in cols], names=["key", "mark", "tid", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for b in batches:
            tid, n = (b.column(c).to_numpy() for c in ("tid", "n"))
            row, key, mark = prefix_table(b.column("text").to_pylist(), lengths, own)
            table = np.array([hash_of(t) for t in b.column("tab").to_pylist()], np.int64)
            cols = (key ^ table[row], mark, tid[row], n[row])
            if own:
                yield from out(cols)
                continue
            parts.append(cols)
            held += len(row)
            if held > GATHERED:
                parts = [joined(parts)]
                if len(parts[0][0]) > GATHERED // 2:  # little was equal
                    yield from out(parts[0])
                    parts = []
                held = len(parts[0][0]) if parts else 0
        if held:
            yield from out(joined(parts))

    return run


def _closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each value its words with their role: inner or closing."""
    for b in batches:
        out = []
        for tab, value, n, whole in zip(*(c.to_pylist() for c in b.columns)):
            t = normal(value)
            ws = re.findall(r"[^\W\d_]+|\d+", t)
            comma = "," in t
            for i, w in enumerate(ws):
                w = "#" if w.isdigit() else w
                out.append((tab, w, comma, n, 0) if i < len(ws) - 1 else (tab, w, comma, 0, whole))
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names=["tab", "word", "comma", "inner", "close"])


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for tab, value, vid in zip(*(b.column(c).to_pylist() for c in ("tab", "value", "vid"))):
            t = normal(value)
            ws = re.findall(r"[^\W\d_]+|\d+", t)
            w = ws[-1] if ws else ""
            depth = t.rfind("(") > t.rfind(")") or t.rfind("[") > t.rfind("]")
            mark = "open" if depth or t[-1:] in ",(;" else "dot" if t.endswith(".") and len(w) == 1 else "word" if t[-1:].isalnum() or t.endswith(".") else "other"
            out.append((tab, vid, "#" if w.isdigit() else w, "," in t, mark, t.endswith(".")))
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_()))], names=["tab", "vid", "word", "comma", "mark", "stop"])


def aligned_end(v: str, u: str) -> str | None:
    """How the alignment of a text with a longer one ends: ``inside`` a word, at a ``border``, or not at all."""
    if len(u) <= len(v):
        return None
    most = len(v) // FUZZY
    if u.startswith(v):
        at = len(v)
    else:
        at = next((k for k in (len(v), len(v) + 1, len(v) - 1) if most and k < len(u) and (u[k - 1] == v[-1] or u[k - 2 : k] == v[:-3:-1]) and edits(v, u[:k], most) <= most), 0)
    if not at or at >= len(u):
        return None
    return "inside" if u[at].isalnum() and v[-1].isalnum() else "border"


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [aligned_end(v, u) for v, u in zip(*(b.column(c).to_pylist() for c in ("text", "longer_text")))]
        yield pa.RecordBatch.from_arrays([b.column("tid"), b.column("weight"), pa.array(out, pa.string())], names=["tid", "weight", "kind"])


def continuations(texts: DataFrame) -> DataFrame:
    """``tid, inside, border``: weight of the longer texts with which each of ``tab, tid, text, n, asked`` aligns
    up to its end, by where that end lies in them.  Only texts that are asked for are compared."""
    sizes = texts.where(F.length("text") > DENSE).select(F.length("text").alias("size")).distinct()
    lengths = np.array([r[0] for r in sizes.collect()], np.int64)  # at most as many as the longest text has characters
    parts = parallelism(texts.sparkSession)
    kinds = "key long, mark long, tid long, n long"
    probes = texts.where("asked").mapInArrow(_keyed(lengths, True), kinds).select("key", F.col("tid").alias("pid")).repartition(parts, "key")
    targets = texts.mapInArrow(_keyed(lengths, False), kinds).repartition(parts, "key")
    sought = targets.join(probes.select("key").distinct(), "key", "left_semi")
    bands = sought.groupBy("key", "mark").agg(F.sum("n").alias("weight"), F.max(F.struct("n", "tid")).alias("most"))
    met = bands.join(probes, "key").groupBy(F.col("pid").alias("tid"), "mark").agg(F.max("most.tid").alias("longer"), F.max("weight").alias("weight"))
    text = texts.select("tid", "text")
    pairs = met.join(text, "tid").join(text.select(F.col("tid").alias("longer"), F.col("text").alias("longer_text")), "longer")
    found = pairs.select("tid", "weight", "text", "longer_text").mapInArrow(_align, "tid long, weight long, kind string").where("kind is not null")
    return found.groupBy("tid").agg(*[F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0)).alias(k) for k in ("inside", "border")])


def field_limits(judged: DataFrame, share: float = 0.5, least: int = 5) -> DataFrame:
    """``tab, source, limit, n_cut``: lengths at which most records of a source are cut, from judged records."""
    sizes = judged.groupBy("tab", "source", F.length("value").alias("limit")).agg(F.count("*").alias("n"), F.sum(F.col("is_cut").cast("int")).alias("n_cut"))
    return sizes.where((F.col("n_cut") >= least) & (F.col("n_cut") >= share * F.col("n"))).drop("n")


def cut_records(records: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``tab, rid, source, value, is_cut, path`` of every record with a value.

    ``records`` has tab, rid, value and source; ``lexicon`` (tab, value) adds values of the
    same kind that are no cases themselves.  ``path`` says what found a cut record: ``copy``
    (the alignment with a longer near-copy) or ``closing`` (its closing word).  Defined
    results: null and blank values are no case; repeated rows come out as often as they came
    in; records without a source make a source of their own; an empty table gives no rows; a
    value with a final abbreviation point is not cut by that."""
    rec = records.where(F.trim("value") != "").select("tab", "rid", "value", F.coalesce("source", F.lit("")).alias("s"), "source", F.xxhash64("tab", "value").alias("vid"))
    counted = rec.groupBy("tab", "vid", "s").agg(F.min("value").alias("value"), F.count("*").alias("n"))
    if lexicon is not None:
        more = lexicon.where(F.trim("value") != "").select("tab", "value").distinct()
        counted = counted.unionByName(more.select("tab", F.xxhash64("tab", "value").alias("vid"), F.lit(None).cast("string").alias("s"), "value", F.lit(1).cast("long").alias("n")))
    counted = cut_lineage(counted)
    spread = parallelism(records.sparkSession)
    values = counted.groupBy("tab", "vid").agg(F.min("value").alias("value"), F.sum("n").alias("n"), F.max(F.col("s").isNotNull()).alias("asked")).repartition(spread, "vid")
    values = cut_lineage(values.mapInArrow(_opened, "tab string, vid long, value string, n long, asked boolean, text string").withColumn("tid", F.xxhash64("tab", "text")))
    texts = cut_lineage(values.groupBy("tid").agg(F.first("tab").alias("tab"), F.first("text").alias("text"), F.sum("n").alias("n"), F.max("asked").alias("asked")).repartition(spread, "tid"))
    copies = cut_lineage(continuations(texts))

    def words_of(whole: DataFrame) -> DataFrame:
        return whole.mapInArrow(_closing, "tab string, word string, comma boolean, inner long, close long").groupBy("tab", "word", "comma").agg(F.sum("inner").alias("inner"), F.sum("close").alias("close"))

    # How words stand inside values, and of which longer words they are the start.
    by_style = cut_lineage(words_of(values.where("asked").select("tab", "value", "n", F.lit(0).cast("long").alias("whole"))))
    inner = by_style.groupBy("tab", "word").agg(F.sum("inner").alias("inner"))
    closes = values.select("tab", "value", "vid", "n").mapInArrow(_last, "tab string, vid long, word string, comma boolean, mark string, stop boolean")
    ends = cut_lineage(closes.join(values.select("tab", "vid", "tid", "n", "asked"), ["tab", "vid"]))
    every = inner.union(ends.groupBy("tab", "word").agg(F.sum("n"))).groupBy("tab", "word").agg(F.sum("inner").alias("n"))
    starts = every.where("length(word) > 1").select("tab", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", 1, k))).alias("word"))
    longer_words = starts.groupBy("tab", "word").agg(F.sum("n").alias("ext"))
    facts = ends.join(copies, "tid", "left").join(inner, ["tab", "word"], "left").join(longer_words, ["tab", "word"], "left").na.fill(0, ["inside", "border", "inner", "ext"])
    seldom = F.col("inner") <= 0.02 * F.greatest(F.col("ext"), F.lit(50))
    ends_inside = (F.col("inside") > 0) & (F.col("inside") >= F.col("border")) & seldom & ~F.col("stop")
    facts = cut_lineage(facts.where("asked").withColumn("ends_inside", ends_inside))

    # How often a source cuts, and at which lengths, as the copies that end inside a word say.
    told = counted.where("s is not null").join(facts.select("tab", "vid", "ends_inside"), ["tab", "vid"])
    at_length = told.groupBy("tab", "s", F.length("value").alias("size")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ends_inside"), F.col("n")).otherwise(0)).alias("cut"))
    rates = at_length.groupBy("tab", "s").agg((F.sum("cut") / F.sum("n")).alias("rate"))
    prior = cut_lineage(at_length.join(rates, ["tab", "s"]).select("tab", "s", "size", "rate", ((F.col("cut") + F.col("rate")) / (F.col("n") + 1)).alias("prior")))
    trusted = told.join(prior.select("tab", "s", "rate").distinct(), ["tab", "s"]).groupBy("tab", "vid").agg(F.sum(F.when(F.col("rate") < CUTS, F.col("n")).otherwise(0)).alias("trusted"))

    # Closing words of values that sources which hardly cut have given.
    whole_ends = facts.join(trusted, ["tab", "vid"])
    closing = whole_ends.where("not ends_inside").groupBy("tab", "word", "comma").agg(F.sum("n").alias("s_close"), F.sum("trusted").alias("s_trusted"))
    style = by_style.select("tab", "word", "comma", F.col("inner").alias("s_inner"))
    close_all = closing.groupBy("tab", "word").agg(F.sum("s_trusted").alias("close"))
    f = whole_ends.join(style, ["tab", "word", "comma"], "left").join(closing, ["tab", "word", "comma"], "left").join(close_all, ["tab", "word"], "left").na.fill(0, ["s_inner", "s_close", "s_trusted", "close"])
    weight = F.col("inside") + F.col("border")
    whole_value = (F.col("trusted") >= 3) & (F.col("trusted") >= 0.1 * weight)
    seen = F.col("s_inner") + F.col("s_trusted")
    terminal = F.when(seen > 0, F.col("s_trusted") / seen).otherwise(F.lit(0.0))
    piece = (F.col("ext") >= 3) & (F.col("inner") <= 0.02 * F.col("ext")) & (F.col("close") <= 0.1 * F.col("ext")) & (F.col("word") != "#")
    none = weight == 0
    word_end = F.col("mark") == "word"
    by_copy = (F.col("mark") != "dot") & ~whole_value & (F.col("ends_inside") | ((F.col("border") >= 50) & (F.col("trusted") < 0.02 * F.col("border"))))
    never_closes = (seen >= 20) & (terminal < 0.03) & word_end
    by_word = (F.col("mark") == "open") | ((F.col("mark") != "dot") & ((none & piece & ~F.col("stop") & ~whole_value) | never_closes))
    weak_copy = word_end & ~F.col("stop") & ~none & (F.col("trusted") == 0) & (terminal < 0.5)
    weak_word = word_end & ~F.col("stop") & none & (F.col("inner") == 0) & (F.col("close") == 0)
    verdict = f.select("tab", "vid", by_copy.alias("by_copy"), by_word.alias("by_word"), weak_copy.alias("weak_copy"), weak_word.alias("weak_word"))
    judged = rec.withColumn("size", F.length("value")).join(verdict, ["tab", "vid"]).join(prior, ["tab", "s", "size"])
    likely = F.col("prior") >= 0.5
    path = F.when(F.col("by_copy") | (F.col("weak_copy") & likely), "copy").when(F.col("by_word") | (F.col("weak_word") & likely), "closing")
    return judged.withColumn("path", path).select("tab", "rid", "source", "value", F.col("path").isNotNull().alias("is_cut"), "path")
