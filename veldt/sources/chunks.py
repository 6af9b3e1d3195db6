"""Landed chunks with a manifest, so that a failed or broken one is left out and reported.

A chunk is a folder of its own.  Its manifest row is written after it, with the
rows that were written, or with the error of a fetch that failed; landing a chunk
again replaces both.  On reading, unreadable files are passed over, and a chunk
counts as whole only if as many rows are read as its manifest promises.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "chunk string, expected bigint, error string"


def folder(base: str, chunk: str) -> str:
    return f"{base}/data/chunk={chunk}"


def land(base: str, chunk: str, rows: DataFrame) -> bool:
    """Write one chunk and its manifest row; an error of the job that makes the rows is recorded, not raised."""
    spark, error, expected = rows.sparkSession, None, None
    try:
        rows.write.mode("overwrite").parquet(folder(base, chunk))
        expected = spark.read.schema(rows.schema).parquet(folder(base, chunk)).count()
    except PySparkException as e:
        error = str(e).splitlines()[0][:500]
    row = spark.createDataFrame([(chunk, expected, error)], MANIFEST).coalesce(1)
    row.write.mode("overwrite").parquet(f"{base}/manifest/of={chunk}")
    return error is None


def read(spark: SparkSession, base: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all complete chunks with their ``chunk``, report: chunk, state, expected, found, error).

    States: complete, corrupt (fewer or more rows than promised can be read), failed (the fetch failed)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{base}/manifest/*")
    rows = spark.read.schema(f"{schema}, chunk string").option("ignoreCorruptFiles", True).parquet(f"{base}/data")
    found = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("found"))
    whole = F.col("found") == F.col("expected")
    state = F.when(F.col("expected").isNull(), "failed").when(whole, "complete").otherwise("corrupt")
    report = manifest.join(found, "chunk", "left").withColumn("found", F.coalesce("found", F.lit(0))).select(
        "chunk", state.alias("state"), "expected", "found", "error")
    return rows.join(report.where("state = 'complete'").select("chunk"), "chunk", "left_semi"), report
