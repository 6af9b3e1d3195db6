"""Parquet scans of the driver tables (A3).

Every reader returns a lazily-planned DataFrame; callers select the columns
they need so Catalyst prunes the parquet ``ReadSchema`` and pushes filters.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(path(sf_dir, name))
    return df.select(*cols) if cols else df


def write_parquet(df: DataFrame, out: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """Parquet sink (A3/S1): always partitioned output, never a size switch."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(out)
