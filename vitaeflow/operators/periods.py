"""Overlapping and gapped time intervals: continuous periods and gaps per entity.

An ordered map of disjoint closed intervals is kept per entity.  Inserting an interval
finds the first and last stored interval that it meets by binary search and replaces
them by their union; the gaps are the holes between neighbours and change with it.

Maps merge: the map of all intervals equals the map of the intervals of partial maps.
So every task first folds its own rows into maps (an entity that holds a third of all
rows shrinks to a few disjoint intervals before anything is shuffled), and only those
intervals are moved to the entity's task, sorted by entity, one map in memory at a time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import parallelism


class IntervalMap:
    """Ordered disjoint closed integer intervals; ``touch`` is the distance that still joins."""

    __slots__ = ("starts", "ends", "touch")

    def __init__(self, touch: int = 1, starts=(), ends=()):
        self.starts, self.ends, self.touch = list(starts), list(ends), touch

    def insert(self, lo: int, hi: int) -> None:
        i = bisect_left(self.ends, lo - self.touch)
        j = bisect_right(self.starts, hi + self.touch)
        if i < j:
            lo, hi = min(lo, self.starts[i]), max(hi, self.ends[j - 1])
        self.starts[i:j] = [lo]
        self.ends[i:j] = [hi]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return [(e + 1, s - 1) for e, s in zip(self.ends, self.starts[1:])]


#: Disjoint intervals a map task may hold before it hands its partial maps on.
FLUSH_AT = 100_000


def _fold(touch: int, flush_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        held = 0

        def out() -> pa.RecordBatch:
            keys, lo, hi = [], [], []
            for key, m in state.items():
                keys.extend([key] * len(m.starts))
                lo.extend(m.starts)
                hi.extend(m.ends)
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["entity", "lo", "hi"])

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            for key, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                m = state.get(key)
                if m is None:
                    m = state[key] = IntervalMap(touch)
                before = len(m.starts)
                m.insert(lo, hi)
                held += len(m.starts) - before
            if held > flush_at:
                yield out()
                state.clear()
                held = 0
        if state:
            yield out()

    return run


def _finish(touch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, m, key_type = None, None, None
        keys, kinds, lo, hi = [], [], [], []

        def emit() -> None:
            if m is not None:
                for kind, spans in (("period", m.periods()), ("gap", m.gaps())):
                    for a, b in spans:
                        keys.append(current)
                        kinds.append(kind)
                        lo.append(a)
                        hi.append(b)

        def out() -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(kinds, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["entity", "kind", "lo", "hi"])
            for x in (keys, kinds, lo, hi):
                x.clear()
            return r

        for b in batches:
            key_type = b.column(0).type
            for key, a, z in zip(*(c.to_pylist() for c in b.columns)):
                if m is None or key != current:
                    emit()
                    current, m = key, IntervalMap(touch)
                m.insert(a, z)
            if len(keys) > 20_000:
                yield out()
        if m is not None:
            emit()
            yield out()

    return run


def continuous_periods(
    df: DataFrame,
    entity: str,
    start: str,
    end: str,
    out: tuple[str, str, str] = ("kind", "year_from", "year_to"),
    touch: int = 1,
    flush_at: int = FLUSH_AT,
) -> DataFrame:
    """Maximal covered runs (``period``) and the holes between them (``gap``) of each entity.

    Defined results: a row counts if entity and start are not null; a null end means the
    single unit ``start``; reversed bounds are swapped; repeated rows change nothing; an
    entity without a counting row gives no rows; an empty table gives an empty result.
    Other columns of ``df`` are ignored, whatever their names.
    """
    lo, hi = F.col(start).cast("long"), F.coalesce(F.col(end), F.col(start)).cast("long")
    kind = df.schema[entity].dataType
    counting = F.col(start).isNotNull() & F.col(entity).isNotNull()
    rows = df.where(counting).select(F.col(entity).alias("entity"), F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"))
    parts = T.StructType([T.StructField("entity", kind), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    done = T.StructType([T.StructField("entity", kind), T.StructField("kind", T.StringType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    folded = rows.mapInArrow(_fold(touch, flush_at), parts)
    merged = folded.repartition(parallelism(df.sparkSession), "entity").sortWithinPartitions("entity").mapInArrow(_finish(touch), done)
    return merged.select(F.col("entity").alias(entity), F.col("kind").alias(out[0]), F.col("lo").alias(out[1]), F.col("hi").alias(out[2]))
