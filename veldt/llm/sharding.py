"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone; no table of
ranges or ring positions exists.  Adding a shard at the end moves a row only
into the new shard, and moves the expected 1 / (n + 1) of all rows.

Everything is DataFrame expressions.  Defined cases: a null key hashes as key
0; repeated keys share a shard and get different slots; null text has 0 bytes
and the checksum 0; columns of the input beside key and text do not matter, and
an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: generator of the published jump consistent hash: state' = state * MUL + 1 mod 2^64
JUMP_MUL = 2862933555777941757
SHARDS = 24
#: a bin of keys holds so many rows on average; each (shard, bin) is numbered on its own
ROWS_PER_BIN = 200_000


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a bigint key (taken as unsigned 64 bits).

    The state is a DECIMAL: state * MUL stays under 2^126 and the remainder by
    2^64 is exact, so no step can overflow in ANSI mode.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def whole(n: int) -> Column:
        return F.lit(str(n)).cast(f"decimal({len(str(n))},0)")

    signed = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)")
    state = F.when(signed < 0, signed + whole(1 << 64)).otherwise(signed).cast("decimal(20,0)")

    def jump(s: Column, _: Column) -> Column:
        k = ((s["k"] * whole(JUMP_MUL) + whole(1)) % whole(1 << 64)).cast("decimal(20,0)")
        top = F.floor(k / whole(1 << 33)).cast("double") + 1.0
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / top)).cast("bigint")
        return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), k.alias("k"), to.alias("j"))).otherwise(s)

    begin = F.struct(F.lit(-1).cast("bigint").alias("b"), state.alias("k"), F.lit(0).cast("bigint").alias("j"))
    # every jump goes on by a shard at least, so `shards` rounds always reach the end
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), begin, jump, lambda s: s["b"]).cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text",
           rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers the rows of a shard without gaps.  No task sees a whole
    shard: rows are counted by (shard, bin of the key's hash), the counts are
    summed up per shard, and each (shard, bin) numbers its own rows by key.
    The number of bins grows with the rows.
    """
    bins = max(1, -(-docs.count() // rows_per_bin))
    k = F.col(key).cast("bigint")
    rows = docs.select(
        k.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("bigint").alias("text_crc32"),
        jump_hash(k, shards).alias("shard"),
        jump_hash(k, shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(k), F.lit(bins)).alias("bin"))
    order = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    base = (rows.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("c"))
            .select("shard", "bin", F.coalesce(F.sum("c").over(order), F.lit(0)).alias("base")))
    own = Window.partitionBy("shard", "bin").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (rows.withColumn("own", F.row_number().over(own)).join(base, ["shard", "bin"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("base") + F.col("own") - 1).cast("bigint").alias("slot"), "grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id",
                 max_rows_per_file: int = 1_000_000) -> None:
    """Write the rows (all columns, plus ``_shard``) to one folder per shard."""
    (docs.withColumn("_shard", jump_hash(F.col(key), shards))
     .repartition("_shard", F.pmod(F.xxhash64(F.col(key)), F.lit(8)))
     .write.option("maxRecordsPerFile", max_rows_per_file).partitionBy("_shard").parquet(path))
