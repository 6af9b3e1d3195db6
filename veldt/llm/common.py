"""Helpers shared by the text operators: scratch tables, Arrow text access,
word hashing in numpy and distributed connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.session import checkpoint_dir

#: bytes of text handled at once inside a task (a longer text is handled alone)
SLICE_BYTES = 4 << 20
#: rows of an Arrow batch; long texts make batches large, so the count is kept low
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a table of its own in the shared checkpoint folder and
    read it back: lineage ends there, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/veldt-llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veldt_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_veldt_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch (a setting of the session, not of the data)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


# ------------------------------------------------------------- Arrow text

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - first


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes together (or one row)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ------------------------------------------------------------- word hashes

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), element by element."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, inner: np.ndarray | None = None):
    """Start, end and row of every word: a run of bytes outside ``inner`` blanks
    (default ``[\\x20\\x09-\\x0D]``), never across rows."""
    solid = ~(_BLANK if inner is None else inner)[data]
    rows = np.flatnonzero(np.diff(offsets) > 0)
    if not len(rows):
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before[offsets[rows]] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after[offsets[rows + 1] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    act, at = np.arange(len(starts)), starts
    left = length
    while len(act):
        h[act] = mix(h[act] ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        act, at, left = act[more], at[more] + 8, left[more] - 8
    return h


# ------------------------------------------------------------- components

def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) rows of longs.

    Alternating large-star and small-star rounds: every round links each node
    to the smallest node it knows, until nothing changes.  All state stays in
    written tables; only two totals a round reach the driver.
    """
    cur = materialize(edges.where("a is not null and b is not null and a <> b")
                      .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        new = materialize(small, "edges")
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = new
        if mark == tuple(seen):
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(seen)
