"""Continuous periods over a stream: an ordered disjoint-interval map per entity in keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.periods import IntervalMap
from ..session import ensure_checkpoint_dir

#: The state store that keyed map state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Periods(StatefulProcessor):
    """Keeps the disjoint intervals of an entity as a map from start to end; only entries that change are written."""

    def __init__(self, entity: str, touch: int):
        self.entity, self.touch = entity, touch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getMapState("spans", "start long", "end long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = sorted((int(k[0]), int(v[0])) for k, v in self.spans.iterator())
        m = IntervalMap(self.touch, [a for a, _ in held], [z for _, z in held])
        for b in rows:
            for a, z in zip(b["lo"].tolist(), b["hi"].tolist()):
                m.insert(int(a), int(z))
        before, now = dict(held), dict(m.periods())
        for a in before.keys() - now.keys():
            self.spans.removeKey((a,))
        for a, z in now.items():
            if before.get(a) != z:
                self.spans.updateValue((a,), (z,))
        out = [("period", *p) for p in m.periods()] + [("gap", *g) for g in m.gaps()]
        yield pd.DataFrame({self.entity: [key[0]] * len(out), "kind": [s[0] for s in out], "year_from": [s[1] for s in out], "year_to": [s[2] for s in out]})

    def close(self) -> None:
        pass


def stream_periods(df: DataFrame, entity: str, start: str, end: str, touch: int = 1) -> DataFrame:
    """Of every entity that a micro-batch touches, all its periods and gaps as they stand now.

    Output mode ``update``: the last rows of an entity replace its earlier ones.  Late and
    repeated rows need no watermark, since an interval map does not depend on the order of
    its insertions.  Rows without entity or start change nothing;
    a null end is the start; reversed bounds are swapped.  Needs the state store :data:`STORE`."""
    lo, hi = F.col(start).cast("long"), F.coalesce(F.col(end), F.col(start)).cast("long")
    kind = df.schema[entity].dataType
    rows = df.where(F.col(start).isNotNull() & F.col(entity).isNotNull()).select(F.col(entity).alias("entity"), F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"))
    out = T.StructType([T.StructField(entity, kind), T.StructField("kind", T.StringType()), T.StructField("year_from", T.LongType()), T.StructField("year_to", T.LongType())])
    return rows.groupBy("entity").transformWithStateInPandas(statefulProcessor=Periods(entity, touch), outputStructType=out, outputMode="Update", timeMode="None")


def settled_periods(df: DataFrame, entity: str, start: str, end: str, touch: int = 1) -> DataFrame:
    """Runs a stream over what its source holds now and gives the periods and gaps of every entity at its end.

    Every micro-batch is written to the shared folder; of an entity its last batch counts."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/periods-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    q = stream_periods(df, entity, start, end, touch).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    kind = f"{entity} {df.schema[entity].dataType.simpleString()}, kind string, year_from long, year_to long, batch int"
    spark.createDataFrame([], kind).write.partitionBy("batch").mode("append").parquet(f"{folder}/out")  # there may be no batch
    told = spark.read.schema(kind).parquet(f"{folder}/out")
    last = told.groupBy(entity).agg(F.max("batch").alias("batch"))
    return told.join(last, [entity, "batch"]).drop("batch")


def distinct_edges(df: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """First delivery of each key within the watermark; what arrives later than ``delay`` is dropped."""
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
