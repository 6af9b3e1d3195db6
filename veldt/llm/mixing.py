"""Mixing sources to target weights by weighted fair queueing.

Each source plays its documents in a shuffled order, up to ``max_passes``
times.  A copy's virtual finish time is the source's words played up to and
with it, divided by the source's weight.  Sorting all copies by that time and
cutting the order at the total budget gives every source the share that its
weight asks for, and a source that runs out leaves its share to the others.

The order is never sorted as a whole: times fall into equal ranges, only the
ranges' totals are summed up, and the range in which the budget ends is sorted
to find the cut.  A source's running totals are taken per (source, range of
the shuffle hash), so a source with a third of all rows is spread over tasks.

Defined cases: null text has size 0; a null source is a source, last in order;
documents of size 0 are taken in no more than ``max_passes`` passes and add no
words; repeated rows are separate documents; a null doc_id sorts first among
equal hashes; other columns do not matter; an empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm import common as C

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
SEED = "mix-1"
#: rows of one range on average, for running totals and for the cut
ROWS_PER_BIN = 20_000
MIN_BINS = 64
#: tables of at most so many sources are broadcast, larger ones are joined by shuffle
BROADCAST_SOURCES = 10_000

_FIRST = Window.unboundedPreceding


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size) -> source, source_size, rank, weight, target, level, budget.

    Targets share the total of all sizes by weight; none exceeds ``max_passes``
    times its source, and what is cut off is shared out again.  With sources in
    the order of capacity per weight, taking out a source that fills up raises
    the words left per unit of weight and taking out one that does not lowers
    them, so ``level`` is their maximum.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.withColumn("rank", F.row_number().over(by_name)) \
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))) \
        .withColumn("cap", F.lit(max_passes) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy()
    src = src.withColumn("budget", F.sum("source_size").over(every)) \
        .withColumn("spent", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(_FIRST, -1)), F.lit(0))) \
        .withColumn("shared", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))) \
        .withColumn("v", (F.col("budget") - F.col("spent")).cast("double") / F.col("shared"))
    src = src.withColumn("level", F.max("v").over(every))
    return src.withColumn("target", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double"))) \
              .select("source", "source_size", "rank", "weight", "target", "level", "budget")


def _queued(rows: DataFrame, src: DataFrame, few: bool, bins: int) -> DataFrame:
    """rows (doc_id, source, size, h, bin, ...) with the source's figures and ``cum``, the
    words of the source up to and with the row in shuffled order."""
    totals = rows.groupBy("source", "bin").agg(F.sum("size").alias("s"))
    base = totals.select("source", "bin", F.coalesce(F.sum("s").over(
        Window.partitionBy("source").orderBy("bin").rowsBetween(_FIRST, -1)), F.lit(0)).alias("base"))
    base = base.join(src, base["source"].eqNullSafe(src["source"])).drop(src["source"])
    order = Window.partitionBy("source", "bin").orderBy("h", "doc_id", "size").rowsBetween(_FIRST, 0)
    r, b = rows.withColumn("own", F.sum("size").over(order)).alias("r"), (F.broadcast(base) if few else base).alias("b")
    out = r.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.bin") == F.col("b.bin")))
    return out.select("r.*", "b.source_size", "b.rank", "b.weight", "b.target",
                      (F.col("b.base") + F.col("r.own")).alias("cum"))


def _finish(p: Column) -> Column:
    return (p * F.col("source_size") + F.col("cum")).cast("double") / F.col("weight")


def schedule(docs: DataFrame, weights: tuple = WEIGHTS, max_passes: int = MAX_PASSES, seed: str = SEED,
             whole_rows: bool = False, key: str = "doc_id", text: str = "text", source: str = "source",
             rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken
    (and ``row``, the whole input row, with ``whole_rows``)."""
    base = [F.col(key).cast("bigint").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")]
    thin = C.materialize(docs.select(*base), "sizes")
    n, most = thin.agg(F.count(F.lit(1)), F.max("size")).first()
    bins = max(MIN_BINS, -(-n // rows_per_bin))

    def ordered(df: DataFrame) -> DataFrame:
        h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
        part = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")
        return df.withColumn("h", h).withColumn("bin", F.floor(part * F.lit(bins) / F.lit(float(1 << 32))).cast("bigint"))

    src = C.materialize(source_targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_passes), "sources")
    sources, level, budget = src.agg(F.count(F.lit(1)), F.max("level"), F.max("budget")).first()
    few = sources * bins <= BROADCAST_SOURCES
    cut = None
    if n and budget:
        # no copy that finishes later than `horizon` can come before the cut
        horizon = level + most / min(weights)
        ranges = max(1, -(-max_passes * n // rows_per_bin))
        copies = (_queued(ordered(thin), src, few, bins)
                  .withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1)))).withColumn("t", _finish(F.col("p")))
                  .where(F.col("t") <= F.lit(horizon))
                  .withColumn("range", F.floor(F.col("t") * F.lit(ranges / (horizon + 1.0))).cast("bigint"))
                  .select("range", "t", "rank", "p", "h", "doc_id", "size"))
        copies = C.materialize(copies, "copies")
        sums = copies.groupBy("range").agg(F.sum("size").alias("s"))
        upto = sums.select("range", (F.sum("s").over(Window.orderBy("range").rowsBetween(_FIRST, 0))).alias("to"),
                           "s").where(F.col("to") > budget).orderBy("range").limit(1).first()
        if upto is not None:
            within = Window.orderBy("t", "rank", "p", "h", "doc_id", "size").rowsBetween(_FIRST, 0)
            left = budget - (upto["to"] - upto["s"])
            cut = (copies.where(F.col("range") == upto["range"]).withColumn("c", F.sum("size").over(within))
                   .where(F.col("c") > left).orderBy("t", "rank", "p", "h", "doc_id", "size").limit(1).first())
        C.discard(copies)
    full = docs.select(*base, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if whole_rows else thin
    out = _queued(ordered(full), src, few, bins)
    count = F.lit(0)
    for p in range(max_passes):
        here = F.lit(True)
        if cut is not None:
            t = _finish(F.lit(p))
            at = F.struct(t.alias("t"), F.col("rank"), F.lit(p).alias("p"), F.col("h"), F.coalesce("doc_id", F.lit(-(1 << 63)))
                          .alias("d"), F.col("size"))
            end = F.struct(F.lit(cut["t"]).alias("t"), F.lit(cut["rank"]).alias("rank"), F.lit(cut["p"]).alias("p"),
                           F.lit(cut["h"]).alias("h"), F.lit(-(1 << 63) if cut["doc_id"] is None else cut["doc_id"]).cast("bigint").alias("d"),
                           F.lit(cut["size"]).cast("bigint").alias("size"))
            here = at < end
        count = count + F.when(here, 1).otherwise(0)
    return out.withColumn("copies", count).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), *(["row"] if whole_rows else []))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: every input row as often as the mix takes it, input columns only."""
    return (schedule(docs, whole_rows=True, **options).where("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"))
