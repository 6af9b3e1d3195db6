"""Classifier evaluation over a long table ``(keys..., threat, y, p)``.

* confusion counts and threshold metrics are one grouped aggregate (J12/J13);
* ROC-AUC is the tie-aware Mann-Whitney statistic and average precision the
  step-wise sum over distinct scores, both from distributed prefix sums over
  the sorted distinct scores (J14/J15) — no per-threat single-task window;
* lead time and persistence are per-entity windows over the evaluation
  order (T8: never across entities) (E15-E17);
* the F2 bootstrap resamples the four confusion cells as a multinomial —
  exactly the row bootstrap's distribution for a confusion-count metric —
  so its cost is O(resamples), not O(rows x resamples) (J17).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt import config as C
from veldt.functions.ranking import prefix_sums


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0 for a zero denominator (zero_division=0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def fbeta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b2 = beta * beta
    return _div0(F.lit(1.0 + b2) * tp, F.lit(b2) * (tp + fn) + (tp + fp))


def to_long(df: DataFrame, keys: list[str], threats=None) -> DataFrame:
    """(keys, label cols, prob cols) -> (keys, threat, y, p) with known labels only."""
    threats = threats or list(zip(C.THREATS, C.LABEL_COLS, C.PROB_COLS))
    arr = F.array(*[F.struct(F.lit(t).alias("threat"), F.col(y).cast("int").alias("y"),
                             F.col(p).cast("double").alias("p")) for t, y, p in threats])
    return df.select(*keys, F.inline(arr)).where(F.col("y").isNotNull())


def confusion(long: DataFrame, keys=("threat",), thr: float = C.DECISION_THRESHOLD) -> DataFrame:
    """tp/fp/fn/tn at p >= thr plus n and Brier sum."""
    pred = F.col("p") >= F.lit(thr)
    pos = F.col("y") == 1
    return long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(pos & pred).alias("tp"), F.count_if(~pos & pred).alias("fp"),
        F.count_if(pos & ~pred).alias("fn"), F.count_if(~pos & ~pred).alias("tn"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))


def metrics(long: DataFrame, keys=("threat",), thr: float = C.DECISION_THRESHOLD) -> DataFrame:
    """n, positives, prevalence, precision, recall, F1, F2, accuracy, Brier."""
    c = confusion(long, keys, thr)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *keys, "n", (tp + fn).alias("n_pos"), (fp + tn).alias("n_neg"),
        _div0(tp + fn, F.col("n")).alias("prevalence"),
        _div0(tp, tp + fp).alias("precision"), _div0(tp, tp + fn).alias("recall"),
        fbeta(tp, fp, fn, 1.0).alias("f1"), fbeta(tp, fp, fn, 2.0).alias("f2"),
        _div0(tp + tn, F.col("n")).alias("accuracy"), "brier", "tp", "fp", "fn", "tn")


def auc_ap(long: DataFrame, keys=("threat",)) -> DataFrame:
    """ROC-AUC (NULL for one class) and step average precision per key."""
    keys = list(keys)
    g = long.groupBy(*keys, "p").agg(F.sum("y").cast("bigint").alias("pos"),
                                     (F.count(F.lit(1)) - F.sum("y")).cast("bigint").alias("neg"))
    cum = prefix_sums(g, keys, "p", ["pos", "neg"])
    tot = g.groupBy(*keys).agg(F.sum("pos").alias("tot_pos"), F.sum("neg").alias("tot_neg"))
    x = cum.join(tot, keys)
    P, N = F.col("tot_pos"), F.col("tot_neg")
    below_neg = F.col("cum_neg") - F.col("neg")
    # descending inclusive counts at threshold p: everything with score >= p
    tp_at = P - (F.col("cum_pos") - F.col("pos"))
    fp_at = N - (F.col("cum_neg") - F.col("neg"))
    x = x.select(*keys, "tot_pos", "tot_neg",
                 (F.col("pos") * (below_neg + F.lit(0.5) * F.col("neg"))).alias("_mw"),
                 (F.col("pos").cast("double") / F.nullif(P, F.lit(0)) * tp_at / (tp_at + fp_at)).alias("_ap"))
    r = x.groupBy(*keys, "tot_pos", "tot_neg").agg(F.sum("_mw").alias("_mw"), F.sum("_ap").alias("_ap"))
    ok = (P > 0) & (N > 0)
    return r.select(*keys, F.when(ok, F.col("_mw") / (P * N)).alias("roc_auc"),
                    F.when(ok, F.col("_ap")).alias("pr_auc"))


def per_class_report(m: DataFrame, keys=("threat",)) -> DataFrame:
    """precision/recall/F1/support for classes 0 and 1, macro and weighted avg."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c1 = F.struct(F.lit("1").alias("cls"), _div0(tp, tp + fp).alias("precision"), _div0(tp, tp + fn).alias("recall"),
                  fbeta(tp, fp, fn, 1.0).alias("f1"), (tp + fn).cast("double").alias("support"))
    c0 = F.struct(F.lit("0").alias("cls"), _div0(tn, tn + fn).alias("precision"), _div0(tn, tn + fp).alias("recall"),
                  fbeta(tn, fn, fp, 1.0).alias("f1"), (tn + fp).cast("double").alias("support"))
    x = m.select(*keys, "n", c0.alias("c0"), c1.alias("c1"))

    def avg(field, weighted):
        if weighted:
            return _div0(F.col(f"c0.{field}") * F.col("c0.support") + F.col(f"c1.{field}") * F.col("c1.support"),
                         F.col("n"))
        return (F.col(f"c0.{field}") + F.col(f"c1.{field}")) / F.lit(2.0)
    macro = F.struct(F.lit("macro avg").alias("cls"), avg("precision", False).alias("precision"),
                     avg("recall", False).alias("recall"), avg("f1", False).alias("f1"),
                     F.col("n").cast("double").alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("cls"), avg("precision", True).alias("precision"),
                        avg("recall", True).alias("recall"), avg("f1", True).alias("f1"),
                        F.col("n").cast("double").alias("support"))
    return x.select(*keys, F.inline(F.array("c0", "c1", macro, weighted)))


def lead_time(long: DataFrame, entity: str = "entity", order: str = "day",
              thr: float = C.LEAD_THRESHOLD, window: int = C.LEAD_WINDOW) -> DataFrame:
    """Mean days of warning before each event onset, per threat.

    Onset = first 1 of a run in the per-entity evaluation order; lead = rows
    back to the nearest prior row (<= window back) with p >= thr, else 0."""
    w = Window.partitionBy(entity, "threat").orderBy(order)
    x = long.withColumn("_i", F.row_number().over(w))
    onset = (F.col("y") == 1) & (F.coalesce(F.lag("y", 1).over(w), F.lit(0)) == 0)
    hit = F.last(F.when(F.col("p") >= F.lit(thr), F.col("_i")), ignorenulls=True).over(w.rowsBetween(-window, -1))
    x = x.withColumn("_onset", onset).withColumn("_hit", hit)
    lead = F.when(F.col("_hit").isNotNull(), F.col("_i") - F.col("_hit")).otherwise(F.lit(0))
    # over all rows: a threat without an onset keeps its row (NULL lead, 0 onsets)
    return x.groupBy("threat").agg(F.avg(F.when(F.col("_onset"), lead.cast("double"))).alias("lead_time_days"),
                                   F.count_if("_onset").alias("n_onsets"))


def persistence(long: DataFrame, entity: str = "entity", order: str = "day") -> DataFrame:
    """Previous row's label as the prediction, per entity; first row dropped."""
    w = Window.partitionBy(entity, "threat").orderBy(order)
    prev = F.lag("y", 1).over(w)
    return (long.withColumn("p", prev.cast("double")).where(F.col("p").isNotNull())
                .select(entity, order, "threat", "y", "p"))


def reliability(long: DataFrame, bins: int = 10) -> DataFrame:
    """Uniform-bin reliability curve; a score on an edge belongs to the lower bin; empty bins absent."""
    step = 1.0 / bins
    b = F.lit(0)
    for k in range(1, bins):
        b = b + F.when(F.col("p") > F.lit(k * step), 1).otherwise(0)
    return long.groupBy("threat", b.alias("bin")).agg(
        F.avg("p").alias("mean_pred"), F.avg("y").alias("observed"), F.count(F.lit(1)).alias("n"))


def evaluation(long: DataFrame, entity: str = "entity", order: str = "day") -> DataFrame:
    """Full per-threat evaluation: metrics + AUC/AP + lead time + persistence F2 + beats flag."""
    m = metrics(long)
    a = auc_ap(long)
    lt = lead_time(long, entity, order)
    pers = metrics(persistence(long, entity, order)).select("threat", F.col("f2").alias("persistence_f2"))
    out = m.join(a, "threat").join(lt, "threat", "left").join(pers, "threat", "left")
    return out.withColumn("beats_baseline", F.col("f2") > F.col("persistence_f2"))


# ----------------------------------------------------------------- J17 bootstrap

def bootstrap_f2(m: DataFrame, resamples: int = C.BOOTSTRAP_RESAMPLES, seed: int = 42,
                 alpha: float = 0.05, keys=("threat",)) -> DataFrame:
    """F2 point estimate and percentile CI from confusion-cell multinomial resamples.

    A row bootstrap of a confusion-count metric only depends on how many
    draws land in each (label, prediction) cell, i.e. Multinomial(n, cell
    shares): one small pandas batch per key (resamples rows) does it exactly.
    Degenerate resamples (no positives or no negatives) are skipped."""
    keys = list(keys)
    lo_q, hi_q = 100 * alpha / 2, 100 * (1 - alpha / 2)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        n = int(r["n"])
        cells = np.array([r["tp"], r["fp"], r["fn"], r["tn"]], dtype=float)
        key_seed = zlib.crc32("|".join(str(r[k]) for k in keys).encode())
        rng = np.random.default_rng([seed, key_seed])
        draws = rng.multinomial(n, cells / max(n, 1), size=resamples) if n > 0 else np.zeros((resamples, 4))
        tp, fp, fn, tn = draws.T
        pos = tp + fn
        keep = (pos > 0) & (pos < n)
        den = 5 * tp + 4 * fn + fp
        f2 = np.where(den > 0, 5 * tp / np.where(den > 0, den, 1), 0.0)[keep]
        point = 5 * r["tp"] / (5 * r["tp"] + 4 * r["fn"] + r["fp"]) if (5 * r["tp"] + 4 * r["fn"] + r["fp"]) else 0.0
        lo = float(np.percentile(f2, lo_q)) if f2.size else np.nan
        hi = float(np.percentile(f2, hi_q)) if f2.size else np.nan
        out = {k: [r[k]] for k in keys}
        out.update({"f2_point": [float(point)], "ci_lower": [lo], "ci_upper": [hi], "n_valid": [int(f2.size)]})
        return pd.DataFrame(out)

    schema = ", ".join(f"{k} string" for k in keys) + \
        ", f2_point double, ci_lower double, ci_upper double, n_valid bigint"
    src = m.select(*[F.col(k).cast("string") for k in keys], "n", "tp", "fp", "fn", "tn")
    return src.groupBy(*keys).applyInPandas(run, schema)
