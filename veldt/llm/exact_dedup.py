"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every input partition fingerprints its normalised texts, keeps the distinct
   fingerprints of each owner (a range of the fingerprint space) in order, and
   sends them as one Golomb-Rice coded list.
2. Each owner decodes its lists, marks the fingerprints that came from more
   than one partition, and answers every list with a bitmap.
3. A partition reads its bitmap (plus its own repeats) and only the rows it
   then suspects are shuffled, grouped by the bytes of their normalised text.

A text that a third of all rows share costs an owner one entry per partition,
and grouping by bytes combines copies before the shuffle.

Defined cases: null text counts as empty; texts are equal when identical after
the blanks ``[\\x20\\x09-\\x0D]`` are deleted; the row with the most code points
in its original text stays, then the smallest doc_id (null last), then the
first in input order; rows that repeat are copies of each other; other columns
do not matter; an empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm import common as C
from veldt.session import checkpoint_dir

BLANKS = b" \t\n\x0b\x0c\r"
#: a row that has no copy is suspected with a chance of 2^-SPARE_BITS
SPARE_BITS = 14
#: fingerprints that one owner answers for, on average
ROWS_PER_OWNER = 500_000

_ROWS = ("part int, pos long, doc_id long, chars long, sha binary, norm binary, fp long, "
         "owner int, code binary, again binary")


# ------------------------------------------------------------ Golomb-Rice

def golomb_encode(values: np.ndarray) -> bytes:
    """Strictly rising uint64 values as gaps: count, parameter, unary quotients, remainders."""
    n = len(values)
    gaps = values.astype(np.uint64).copy()
    gaps[1:] -= values[:-1] + np.uint64(1)
    mean = float(gaps.astype(np.float64).mean()) if n else 0.0
    k = max(0, int(math.floor(math.log2(mean)))) if mean >= 1 else 0
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    rest = np.zeros(0, np.uint8)
    if k:
        shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
        rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return (n.to_bytes(4, "little") + bytes([k]) + len(unary).to_bytes(8, "little")
            + np.packbits(unary).tobytes() + np.packbits(rest).tobytes())


def golomb_decode(code: bytes) -> np.ndarray:
    n, k, bits = int.from_bytes(code[:4], "little"), code[4], int.from_bytes(code[5:13], "little")
    cut = 13 + (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(code[13:cut], np.uint8), count=bits)
    stops = np.flatnonzero(unary == 0)
    gaps = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        rest = np.unpackbits(np.frombuffer(code[cut:], np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
        low = (rest << np.arange(k - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        gaps = (gaps << np.uint64(k)) | low
    return np.cumsum(gaps + np.uint64(1), dtype=np.uint64) - np.uint64(1)


# ------------------------------------------------------------ tasks

def _fingerprint(bits: int, owner_bits: int):
    schema = pa.schema([("part", pa.int32()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("chars", pa.int64()),
                        ("sha", pa.binary()), ("norm", pa.binary()), ("fp", pa.int64()),
                        ("owner", pa.int32()), ("code", pa.binary()), ("again", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, seen = TaskContext.get().partitionId(), 0, []
        for b in batches:
            data, off = C.utf8(b.column(1))
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            raw, n = data.tobytes(), b.num_rows
            norm = [raw[off[i]:off[i + 1]].translate(None, BLANKS) for i in range(n)]
            sha = [hashlib.sha256(t).digest() for t in norm]
            fp = np.array([int.from_bytes(s[:8], "big") >> (64 - bits) for s in sha], np.int64)
            seen.append(fp)
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), b.column(0),
                 pa.array(lead[off[1:]] - lead[off[:-1]]), pa.array(sha, pa.binary()), pa.array(norm, pa.binary()),
                 pa.array(fp), pa.nulls(n, pa.int32()), none, none], schema=schema)
            pos += n
        if not seen:
            return
        own, times = np.unique(np.concatenate(seen).astype(np.uint64), return_counts=True)
        owner = (own >> np.uint64(bits - owner_bits)).astype(np.int64)
        for o in np.unique(owner):
            at = owner == o
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                 pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([o], pa.int32()),
                 pa.array([golomb_encode(own[at])], pa.binary()),
                 pa.array([np.packbits(times[at] > 1).tobytes()], pa.binary())], schema=schema)

    return run


def _answer(lists: pd.DataFrame) -> pd.DataFrame:
    """Owner: a bitmap for each list that holds a fingerprint some other list holds too."""
    values = [golomb_decode(c) for c in lists["code"]]
    every, times = np.unique(np.concatenate(values), return_counts=True)
    shared, out = every[times > 1], []
    for part, owner, v in zip(lists["part"], lists["owner"], values, strict=True):
        hit = np.isin(v, shared, assume_unique=True)
        if hit.any():
            out.append((part, owner, np.packbits(hit).tobytes()))
    return pd.DataFrame(out, columns=["part", "owner", "shared"])


def _suspects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partition: the fingerprints that its bitmap or its own repeats mark."""
    for lists in frames:
        for part, code, again, shared in zip(lists["part"], lists["code"], lists["again"], lists["shared"], strict=True):
            v = golomb_decode(code)
            hit = np.unpackbits(np.frombuffer(again, np.uint8), count=len(v)).astype(bool)
            if shared is not None:
                hit |= np.unpackbits(np.frombuffer(shared, np.uint8), count=len(v)).astype(bool)
            if hit.any():
                yield pd.DataFrame({"part": np.int32(part), "fp": v[hit].astype(np.int64)})


# ------------------------------------------------------------ operator

def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    C.small_batches(spark)
    n = max(1, docs.count())
    bits = min(62, math.ceil(math.log2(n + 1)) + SPARE_BITS)
    owner_bits = min(bits, max(6, math.ceil(math.log2(max(1, n / ROWS_PER_OWNER)))))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")) \
               .mapInArrow(_fingerprint(bits, owner_bits), _ROWS)
    # A table bucketed by the partition that wrote a row: what comes back to a
    # partition joins its rows where they lie, without moving any text.
    name = f"veldt_fp_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/veldt-llm/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "part").option("path", path).saveAsTable(name)
    stored = spark.table(name)

    lists = stored.where("code is not null").select("part", "owner", "code", "again")
    answers = lists.select("part", "owner", "code").groupBy("owner").applyInPandas(
        _answer, "part int, owner int, shared binary")
    marked = C.materialize(lists.join(answers, ["part", "owner"], "left").mapInPandas(_suspects, "part int, fp long"),
                           "marked")

    held = stored.where("sha is not null")
    fewer = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(fewer, "true")
    spark.conf.set(fewer, "false")  # (part, fp) meet where `part` lies already
    try:
        by_bytes = (held.join(marked.hint("shuffle_hash"), ["part", "fp"], "semi").groupBy("sha", "norm").agg(
            F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id", "part", "pos")).alias("k"),
            F.count(F.lit(1)).alias("group_size")))
        groups = C.materialize(by_bytes.where("group_size > 1").select(
            "sha", "group_size", F.col("k.doc_id").alias("keep_id"), F.col("k.part").alias("kp"), F.col("k.pos").alias("kq")), "groups")
    finally:
        spark.conf.set(fewer, before)
    thin = held.select("part", "pos", "doc_id", "sha").join(groups, "sha", "left")
    return thin.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce((F.col("part") == F.col("kp")) & (F.col("pos") == F.col("kq")), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
