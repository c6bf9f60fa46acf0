"""Encoding of whole texts with a byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece becomes a doubly linked list of
bytes whose neighbours wait in a priority queue by merge rank.  The lowest rank is merged
first, entries whose symbols have changed since are skipped as stale.  Pieces repeat, so a
task remembers the ids of those it has seen as packed integers, and the ids of a text are
the concatenation of packed pieces.  Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("VITAEFLOW_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: A vocabulary file is sent to every task, so its size is checked.
MOST_BYTES = 64 << 20
#: Pieces a task remembers before it starts anew.
REMEMBERED = 300_000
# Fixed value: the pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for texts in which the two engines agree on letters, digits and blanks.
_QUICK = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


def _odd_characters() -> frozenset[str]:
    """Characters that the quick pattern would put into another class."""
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    odd: set[str] = set()
    for exact, quick in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s")):
        odd |= set(regex.findall(exact, everything)) ^ set(re.findall(quick, everything))
    return frozenset(odd)


class Pieces(dict):
    """Piece to its ids, packed as 32-bit integers; filled by merging on first sight."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)
        packed = array("i", [whole] if whole is not None else merge(raw, self.ranks)).tobytes()
        if len(raw) <= 256:
            self[piece] = packed
        return packed


def merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: lowest merge rank first, leftmost among equals."""
    n = len(raw)
    symbol: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        r = ranks.get(raw[i : i + 2])
        if r is not None:
            queue.append((r, i, 2))
    heapq.heapify(queue)
    while queue:
        _, i, size = heapq.heappop(queue)
        left = symbol[i]
        if left is None or (j := after[i]) >= n or len(left) + len(symbol[j]) != size:
            continue  # stale: one of the two has been merged since
        symbol[i] = left + symbol[j]
        symbol[j] = None
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            r = ranks.get(symbol[i] + symbol[k])
            if r is not None:
                heapq.heappush(queue, (r, i, size + len(symbol[k])))
        h = before[i]
        if h >= 0:
            r = ranks.get(symbol[h] + symbol[i])
            if r is not None:
                heapq.heappush(queue, (r, h, len(symbol[h]) + size))
    return [ranks[s] for s in symbol if s is not None]


class Encoder:
    """Byte-level BPE over a rank file (one base64 token and its rank per line)."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        self.strings = {r: t for t, r in self.ranks.items()}
        self.pieces = Pieces(self.ranks)
        self.odd = _odd_characters()
        self.exact = regex.compile(PATTERN)

    def packed(self, text: str) -> bytes:
        split = _QUICK if self.odd.isdisjoint(text) else self.exact
        return b"".join(map(self.pieces.__getitem__, split.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return list(array("i", self.packed(text))) if text else []

    def decode(self, ids) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", errors="replace")


def rank_file(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    path = os.path.join(folder, name)
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is too large to send to every task")
    with open(path, "rb") as f:
        return f.read()


_ENCODERS: dict[int, Encoder] = {}


def _encoder(handle) -> Encoder:
    """The worker's encoder of a broadcast vocabulary; made once per worker process."""
    data = handle.value
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def _flags(df: DataFrame, doc: str, text: str, folder: str, name: str):
    spark: SparkSession = df.sparkSession
    return df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), spark.sparkContext.broadcast(rank_file(folder, name))


def token_ids(df: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids`` of every row.

    Defined results: an empty and a null text give an empty list, blank texts are encoded
    as they are; strings of special tokens in a text are ordinary text; repeated rows come
    out repeated; a null document id stays null."""
    rows, handle = _flags(df, doc, text, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(handle)
        for b in batches:
            parts = [enc.packed(t) if t else b"" for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(df: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of every row; 0 for empty and null texts."""
    rows, handle = _flags(df, doc, text, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(handle)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(enc.packed(t)) // 4 if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def decoded(df: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; ids outside the vocabulary are an error."""
    handle = df.sparkSession.sparkContext.broadcast(rank_file(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(handle)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(i) if i is not None else None for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
