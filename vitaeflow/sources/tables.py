"""Reading and writing the tables the operators work on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *keys: str, latest: str | None = None) -> DataFrame:
    """One row per key where rows are delivered again with the same values."""
    if latest is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys and c != latest]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(latest)).alias("_r"), F.min(latest).alias(latest))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest], latest).select(*df.columns)


def csv(spark: SparkSession, path: str, schema: T.StructType | str, null: str = "") -> DataFrame:
    """CSV with a header and a fixed schema (no inference pass)."""
    return spark.read.csv(path, header=True, schema=schema, nullValue=null, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header; with ``bom`` the first header name carries a byte order mark."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").csv(path, header=True, nullValue="", escape='"')


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``path, value``."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def optional(spark: SparkSession, path: str | None, schema: T.StructType | str) -> DataFrame:
    """A parquet table if the path exists, else an empty one of the same schema."""
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def swap_in(df: DataFrame, path: str) -> None:
    """Replace a table by a frame that may read it: written beside it, then renamed."""
    spark = df.sparkSession
    fresh, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(fresh)
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(P(old), True)
    if fs.exists(P(path)):
        fs.rename(P(path), P(old))
    fs.rename(P(fresh), P(path))
    fs.delete(P(old), True)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """One folder per combination of ``by``, after deleting what stood there."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def roster_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Candidate roster ``election, name, is_winner``; a check mark after the name marks the winner.

    Reads parquet or CSV; an xlsx file needs openpyxl, which is only used if it is installed.
    """
    if path.endswith(".xlsx"):
        try:
            import openpyxl
        except ImportError as e:  # pragma: no cover
            raise RuntimeError("reading xlsx needs openpyxl") from e
        sheet = openpyxl.load_workbook(path, read_only=True).active
        rows = [(r[0], r[1]) for r in sheet.iter_rows(min_row=3, max_col=2, values_only=True) if r[1]]
        df = spark.createDataFrame(rows, "election int, name string")
    elif os.path.splitext(path)[1] == ".csv":
        df = csv(spark, path, "election int, name string")
    else:
        df = spark.read.parquet(path).select("election", "name")
    mark = F.col("name").contains("✓")
    return df.where(F.trim("name") != "").select("election", F.trim(F.regexp_replace("name", "✓", "")).alias("name"), mark.cast("int").alias("is_winner"))
