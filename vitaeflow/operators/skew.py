"""Per-key results when a few keys hold most rows.

Rows are range-partitioned on (key, secondary order); Spark takes the split points from
sampled quantiles of the composite, so a key that holds half of the rows is cut into
pieces of ordinary size.  Each piece is folded, in order, into one partial state; the
states of one key are then stitched in order (the step from the last row of one piece to
the first of the next is accounted for at the seam).  No task sees more than its range,
and what is stitched is one state per key and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage, parallelism


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, order) rows to one state per run of equal keys: rows, first, last, widest step, distinct orders.

    Rows without an order count as rows only; they stand before the others of their key."""
    open_key, st = None, None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        cols = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["key", "n", "first", "last", "step", "orders"])

    for b in batches:
        if not b.num_rows:
            continue
        code = pc.run_end_encode(b.column(0))
        order = b.column(1)
        start = 0
        for name, end in zip(code.values.to_pylist(), np.asarray(code.run_ends)):
            rows = int(end) - start
            part = order.slice(start, rows).drop_null().to_numpy(zero_copy_only=False)
            start = int(end)
            if st is None or name != open_key:
                if st is not None:
                    done.append((open_key, *st))
                open_key, st = name, [0, None, None, 0, 0]
            st[0] += rows
            if len(part):
                diff = np.diff(part)
                seam = int(part[0]) - st[2] if st[2] is not None else 0
                st[3] = max(st[3], seam, int(diff.max()) if len(diff) else 0)
                st[4] += int((diff != 0).sum()) + (st[2] is None or seam != 0)
                st[1], st[2] = int(part[0]) if st[1] is None else st[1], int(part[-1])
        if len(done) > 20_000:
            yield out()
    if st is not None:
        done.append((open_key, *st))
    if done:
        yield out()


def partial_states(df: DataFrame, key: str, order: str, partitions: int | None = None) -> DataFrame:
    """One state per key and range partition: ``key, n, first, last, step, orders``."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("ord"))
    n = partitions or parallelism(df.sparkSession)
    schema = T.StructType([T.StructField("key", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("n", "first", "last", "step", "orders")])
    return rows.repartitionByRange(n, "key", "ord").sortWithinPartitions("key", "ord").mapInArrow(_states, schema)


def stitched(states: DataFrame) -> DataFrame:
    """States of one key, stitched in order: rows, first and last order, widest step, distinct orders."""
    before = Window.partitionBy("key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    seam = F.col("first") - F.last("last", ignorenulls=True).over(before)
    return (
        states.withColumn("seam", seam)
        .groupBy("key")
        .agg(
            F.sum("n").alias("n_rows"),
            F.min("first").alias("first_order"),
            F.max("last").alias("last_order"),
            F.max(F.greatest(F.col("step"), F.coalesce(F.col("seam"), F.lit(0)))).alias("widest_step"),
            (F.sum("orders") - F.sum(F.when(F.col("seam") == 0, 1).otherwise(0))).alias("n_orders"),
        )
    )


def grouped_by_hot_key(df: DataFrame, key: str, order: str, partitions: int | None = None) -> DataFrame:
    """Per-key ordered summary without one task per hot key.

    Defined results: rows with a null key are left out; rows without an order count
    as rows and nowhere else; ties in the order and repeated rows all count; an empty table
    gives no rows.  Values of the order must be integral.
    """
    return stitched(partial_states(df, key, order, partitions))


def dominant_keys(df: DataFrame, key: str, order: str, share: float, partitions: int | None = None) -> DataFrame:
    """Keys that hold at least ``share`` of the rows with a non-null key: ``key, n_rows``."""
    states = cut_lineage(partial_states(df, key, order, partitions))  # one row per key and partition
    total = states.agg(F.sum("n").alias("total"))
    return stitched(states).crossJoin(F.broadcast(total)).where(F.col("n_rows") >= F.lit(share) * F.col("total")).select("key", "n_rows")
