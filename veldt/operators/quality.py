"""Data-quality and profiling aggregates.

All profiles are single-pass ``groupBy``/``agg`` (partial aggregation on the
map side), with ``rollup``/``cube`` where the report needs pooled totals and
``unpivot`` for long-form outputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt import config as C
from veldt.functions import scalar as S


def label_base_rates(labelled: DataFrame, labels=None, key: str = "entity") -> DataFrame:
    """rows, labelled count, positives and rate per label; pooled row via rollup."""
    labels = labels or C.LABEL_COLS
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for lab in labels:
        short = lab.replace("_within_30d", "")
        aggs += [F.count(lab).alias(f"{short}_labeled"),
                 F.sum(lab).alias(f"{short}_pos"),
                 F.avg(lab).alias(f"{short}_rate")]
    return labelled.rollup(key).agg(*aggs)


def summary_report(labelled: DataFrame, labels=None) -> DataFrame:
    """Per-entity report with rates rendered as ``x.x%`` strings, N/A when unlabelled."""
    labels = labels or C.LABEL_COLS
    cols = [F.count(F.lit(1)).alias("n_rows")]
    for lab in labels:
        short = lab.replace("_within_30d", "")
        n_lab = F.count(lab)
        pos = F.coalesce(F.sum(lab), F.lit(0))
        cols += [pos.alias(f"{short}_positive"),
                 F.when(n_lab > 0, F.format_string("%.1f%%", F.lit(100.0) * pos / n_lab))
                  .otherwise(F.lit("N/A")).alias(f"{short}_rate")]
    return labelled.groupBy("entity", "ecosystem").agg(*cols)


def missing_fraction(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of NULLs per column, > 0 only, descending (D8): one agg pass + unpivot."""
    wide = df.agg(*[F.avg(F.isnull(c).cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column_name", "missing_frac")
    return long.where(F.col("missing_frac") > 0)


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """count/mean/std/min/max/missing% per column (D9) as long rows."""
    structs = []
    for c in cols:
        structs.append(F.struct(
            F.lit(c).alias("column_name"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
            (F.lit(100.0) * F.avg(F.isnull(c).cast("double"))).alias("missing_pct")))
    return df.agg(F.array(*structs).alias("a")).select(F.inline("a"))


def table_extent(df: DataFrame, key: str = "entity", day: str = "day", splits: tuple = ()) -> DataFrame:
    """Row count, distinct entities, date range, rows of each split."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_entities"),
                  F.min(day).alias("first_day"), F.max(day).alias("last_day"),
                  *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in splits])


def source_coverage(panel: DataFrame) -> DataFrame:
    """NDVI share, fire days and rows per entity."""
    return panel.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col("ndvi").isNotNull().cast("double")).alias("ndvi_coverage"),
        F.count_if(F.col("firms_count") > 0).alias("fire_days"))


def split_crosstab(featured: DataFrame, splits=("train", "val", "test")) -> DataFrame:
    """Split x entity counts with row totals and a pooled total row (D6):
    conditional counts under ``rollup`` (pivot cannot follow a rollup)."""
    return featured.rollup("entity").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in splits],
        F.count(F.lit(1)).alias("total"))


def test_positives(featured: DataFrame, min_pos: int = 30) -> DataFrame:
    """Test-split positives per entity x threat with a < min_pos flag (D7): unpivot + pivot."""
    t = featured.where(F.col("split") == "test")
    long = t.select("entity", *C.LABEL_COLS).unpivot(["entity"], C.LABEL_COLS, "label", "y")
    wide = long.groupBy("entity").pivot("label", C.LABEL_COLS).agg(F.coalesce(F.sum("y"), F.lit(0)))
    out = wide
    for lab in C.LABEL_COLS:
        short = lab.replace("_within_30d", "")
        out = (out.withColumnRenamed(lab, f"{short}_pos")
                  .withColumn(f"{short}_low", (F.col(f"{short}_pos") < min_pos)))
    return out


def monthly_seasonality(labelled: DataFrame) -> DataFrame:
    """Month-of-year label rates pooled over entities."""
    return labelled.groupBy(F.month("day").alias("month")).agg(
        *[F.avg(c).alias(c.replace("_within_30d", "_rate")) for c in C.LABEL_COLS])


def exact_mean(c: str, scale: int = 9):
    """Mean accumulated exactly on a 1e-9 fixed-point grid (DECIMAL sum):
    independent of partitioning and summation order."""
    return F.sum(F.col(c).cast(f"decimal(38,{scale})")).cast("double") / F.count(c)


def month_entity_stats(featured: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and sample std per entity x month."""
    aggs = []
    for c in cols:
        aggs += [exact_mean(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return featured.groupBy("entity", F.month("day").alias("month")).agg(*aggs)


def weekly_resample(labelled: DataFrame) -> DataFrame:
    """Weekly (Mon..Sun, labelled by the Sunday) mean of labels per entity."""
    wk = F.date_add(F.date_trunc("week", F.col("day")).cast("date"), 6)
    return labelled.groupBy("entity", wk.alias("week_end")).agg(
        *[F.avg(c).alias(c.replace("_within_30d", "_rate")) for c in C.LABEL_COLS])


def ndvi_coverage(featured: DataFrame) -> DataFrame:
    """NDVI availability per entity, overall and per month 1..12 pivoted."""
    by_month = (featured.withColumn("month_key", F.month("day").cast("string"))
                        .groupBy("entity").pivot("month_key", [str(m) for m in range(1, 13)])
                        .agg(F.lit(1.0) - F.avg("ndvi_missing")))
    overall = featured.groupBy("entity").agg((F.lit(1.0) - F.avg("ndvi_missing")).alias("coverage"))
    return by_month.join(overall, "entity")


def ecosystem_summary(featured: DataFrame, cols: list[str]) -> DataFrame:
    """'mean ± std' strings per ecosystem on clean train rows."""
    clean = featured.where((F.col("split") == "train") & (F.col("ndvi_missing") == 0))
    return clean.groupBy("ecosystem").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.concat(_fmt2(exact_mean(c)), F.lit(" ± "), _fmt2(F.stddev_samp(c))).alias(c) for c in cols])


def _fmt2(x):
    """'%.2f' text; NULL renders 'nan' (format_string would print 'nu')."""
    return F.when(x.isNull(), F.lit("nan")).otherwise(F.format_string("%.2f", x))


def box_stats(featured: DataFrame, cols: list[str]) -> DataFrame:
    """Q1/median/Q3 (linear interpolation) and 1.5*IQR whiskers per entity x feature."""
    long = featured.select("entity", *cols).unpivot(["entity"], cols, "feature", "value").where(
        F.col("value").isNotNull())
    q = long.groupBy("entity", "feature").agg(
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select("entity", "feature", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"))
    j = long.join(q, ["entity", "feature"])
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - F.lit(1.5) * iqr, F.col("q3") + F.lit(1.5) * iqr
    inside = (F.col("value") >= lo) & (F.col("value") <= hi)
    return j.groupBy("entity", "feature", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))


def co_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete moments of every pair of columns in one block (D16, D17): a, b (in the order of
    ``cols``, a = b included), n, sa, sb, saa, sbb, sab of the values less each column's minimum.

    A task multiplies its rows' matrix with itself and sends one small block (a row per pair), whatever
    it has read; blocks add up, so the input is neither widened nor shuffled.  NULL and NaN are missing."""
    low = df.agg(*[F.min(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in cols]).first()  # one row
    shift = np.array([0.0 if low[c] is None else low[c] for c in cols])
    i, j = np.triu_indices(len(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(i)))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1).astype(float) - shift
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            n, s, q, p = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
            total += np.stack([n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(v) for v in total]], names=["i", "j", *_MOMENTS])

    blocks = df.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(run, "i long, j long, " + ", ".join(f"{m} double" for m in _MOMENTS))
    names = F.array(*[F.lit(c) for c in cols])
    return blocks.groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in _MOMENTS]).select(
        F.get(names, F.col("i").cast("int")).alias("a"), F.get(names, F.col("j").cast("int")).alias("b"), *_MOMENTS)


_MOMENTS = ["n", "sa", "sb", "saa", "sbb", "sab"]


def pearson() -> Column:
    """r from the moments; NULL for fewer than two rows or a column without variance."""
    n = F.nullif(F.col("n"), F.lit(0.0))

    def spread(ss: str, s: str) -> Column:  # NULL where only rounding is left
        v = F.col(ss) - F.col(s) * F.col(s) / n
        return F.when(v > 1e-14 * F.col(ss), v)

    return F.when(F.col("n") > 1, (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(spread("saa", "sa") * spread("sbb", "sb")))


def point_biserial(featured: DataFrame, cols: list[str], min_n: int = 30, top: int = 5) -> DataFrame:
    """Feature-label correlation r with n, t and the exact two-sided p; NULL under min_n pairs; top-k by |r|."""
    m = co_moments(featured, [*cols, *C.LABEL_COLS]).where(F.col("a").isin(cols) & F.col("b").isin(C.LABEL_COLS))
    n = F.col("n").cast("bigint")
    long = m.select(F.col("b").alias("label"), F.col("a").alias("feature"), n.alias("n"), F.when(n >= min_n, pearson()).alias("r"))
    long = long.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(F.lit(1.0) - F.col("r") * F.col("r"), F.lit(0.0))))
    long = long.withColumn("p_value", F.when(F.abs("r") == 1, F.lit(0.0)).otherwise(S.student_t_p(F.col("t"), F.col("n") - 2)))
    w = Window.partitionBy("label").orderBy(F.abs(F.col("r")).desc_nulls_last(), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r of all column pairs, both ways and with the diagonal (D17): feature_a, feature_b, r, n."""
    half = co_moments(df, cols).select(F.col("a").alias("feature_a"), F.col("b").alias("feature_b"), pearson().alias("r"),
                                       F.col("n").cast("bigint").alias("n"))
    both = F.array(F.struct("feature_a", "feature_b"), F.struct(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b")))
    sides = F.when(F.col("feature_a") == F.col("feature_b"), F.slice(both, 1, 1)).otherwise(both)
    return half.select(F.inline(sides), "r", "n")


def correlation_pairs(df: DataFrame, cols: list[str], threshold: float = 0.80) -> DataFrame:
    """Feature pairs with |r| > threshold, from the same block."""
    st = co_moments(df, cols).where("a <> b").select(F.col("a").alias("feature_a"), F.col("b").alias("feature_b"), pearson().alias("r"))
    return st.where(F.abs(F.col("r")) > threshold)
