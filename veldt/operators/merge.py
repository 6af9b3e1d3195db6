"""Idempotent table maintenance on plain DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of rows that differ, the smallest by the other columns in order, NULLs
    last (T3: the choice is explicit, so a retried task makes the same one)."""
    rest = [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in rest]) if rest else None
    if w is None:
        return df.dropDuplicates(keys)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not stored yet (S3/C9): left-anti join."""
    return first_by(new, keys).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Overwrite on match (S4): union, newest ``version`` per key wins."""
    u = existing.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return u.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest_version(table: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Read view of an append-only versioned table: newest row per key."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return table.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def update_only(existing: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Matched rows take the new values, unmatched existing rows stay, new-only rows are ignored."""
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = existing.join(n, keys, "left")
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c))).drop(f"_new_{c}")
    return j


def dedupe_within_watermark(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Streaming duplicate suppression on keys, state bounded by the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
