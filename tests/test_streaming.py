"""The streaming operators end in what the batch operators give."""

import random

from vitaeflow.operators.periods import continuous_periods
from vitaeflow.streaming.periods import STORE, distinct_edges, settled_periods, stream_periods

SCHEMA = "person_id long, a int, b int, loaded_at timestamp"


def rows(seed, n=80):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(1900, 1960)]), rng.choice([None, *range(1900, 1960)])) for _ in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    source, seen = str(tmp_path / "in"), []
    batches = [spark.createDataFrame([(*r, None) for r in rows(i)], SCHEMA) for i in range(3)]
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = stream_periods(stream, "person_id", "a", "b").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: seen.append((i, df.collect()))).start()
    q.processAllAvailable()
    q.stop()
    latest = {}
    for i, part in sorted(seen, key=lambda x: x[0]):
        touched = {r.person_id for r in part}
        latest = {k: v for k, v in latest.items() if k not in touched} | {p: {tuple(r) for r in part if r.person_id == p} for p in touched}
    whole = batches[0].union(batches[1]).union(batches[2])
    assert set().union(*latest.values()) == {tuple(r) for r in continuous_periods(whole, "person_id", "a", "b").collect()}


def test_settled_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(*r, None) for r in rows(i)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    want = {tuple(r) for r in continuous_periods(spark.read.parquet(source), "person_id", "a", "b").collect()}
    assert {tuple(r) for r in settled_periods(stream(), "person_id", "a", "b").collect()} == want
    assert settled_periods(stream().where("false"), "person_id", "a", "b").count() == 0


def test_repeated_deliveries_come_once(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.sql("SELECT id % 5 AS seq, timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS at FROM range(20)")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    q = distinct_edges(stream, ["seq"], "at", "1 hour").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.seq for r in spark.sql("SELECT seq FROM once").collect()) == [0, 1, 2, 3, 4]
