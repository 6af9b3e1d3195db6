"""Sorted Parquet files and scans that their footers prune.

``write`` deals rows to files by ranges of the keys and sorts inside each, so
files and row groups hold narrow key ranges; a scan with key predicates reads
the row groups whose minimum and maximum admit them, and the rows come in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, keys: Sequence[str], files: int, group_bytes: int = 128 << 20, mode: str = "overwrite") -> None:
    """At most ``files`` files in rising key order (NULLs first), row groups of about ``group_bytes``."""
    (df.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
       .write.mode(mode).option("parquet.block.size", group_bytes).parquet(path))


def scan(df: DataFrame, among: Mapping[str, Sequence], between: tuple | None = None, present: Sequence[str] = ()) -> DataFrame:
    """Rows whose columns hold one of the given values, whose date lies in the inclusive ``(column, lo, hi)``
    (either end may be None) and whose ``present`` columns are not NULL, sorted by those keys (A13)."""
    out, keys = df, list(among)
    for c, values in among.items():
        out = out.where(F.col(c).isin(list(values)))
    if between:
        c, lo, hi = between
        keys.append(c)
        if lo is not None:
            out = out.where(F.col(c) >= F.lit(lo).cast("date"))
        if hi is not None:
            out = out.where(F.col(c) <= F.lit(hi).cast("date"))
    for c in present:
        out = out.where(F.col(c).isNotNull())
    return out.orderBy(*keys)


def order_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row on files as they lie: n_rows, rows_out_of_order (smaller than the row before in their file) and
    files_that_overlap (begin before an earlier file ends)."""
    key = F.struct(*keys)
    rows = df.select(key.alias("k"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    w = Window.partitionBy("file").orderBy("at")
    per = rows.withColumn("before", F.lag("k").over(w)).groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") < F.col("before")).alias("bad"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    over_files = Window.partitionBy(F.lit(1)).orderBy("lo", "hi")  # one row a file
    per = per.withColumn("ended", F.max("hi").over(over_files.rowsBetween(Window.unboundedPreceding, -1)))
    return per.agg(F.sum("n").alias("n_rows"), F.sum("bad").alias("rows_out_of_order"), F.count_if(F.col("lo") < F.col("ended")).alias("files_that_overlap"))
