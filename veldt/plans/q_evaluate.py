"""Registered queries: evaluation of the deterministic forecasts on the test split."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt import config as C
from veldt.operators import evaluate as EV
from veldt.plans import panels
from veldt.plans.registry import query
from veldt.plans.sql_base import with_base


def _long(spark, sf):
    return panels.eval_long(spark, sf)


def _fb(tp, fp, fn, b2):
    return (f"CASE WHEN {b2} * ({tp} + {fn}) + ({tp} + {fp}) = 0 THEN 0.0 "
            f"ELSE (1.0 + {b2}) * {tp} / ({b2} * ({tp} + {fn}) + ({tp} + {fp})) END")


def _d0(a, b):
    return f"CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


def confusion_sql(src: str = "ev", keys: str = "threat") -> str:
    return f"""(SELECT {keys}, count(*) AS n,
  count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y <> 1 AND p >= 0.5) AS fp,
  count(*) FILTER (WHERE y = 1 AND NOT p >= 0.5) AS fn, count(*) FILTER (WHERE y <> 1 AND NOT p >= 0.5) AS tn,
  avg((p - y) * (p - y)) AS brier FROM {src} GROUP BY {keys})"""


def metrics_sql(src: str = "ev", keys: str = "threat") -> str:
    return f"""(SELECT {keys}, n, tp + fn AS n_pos, fp + tn AS n_neg, {_d0('tp + fn', 'n')} AS prevalence,
  {_d0('tp', 'tp + fp')} AS precision, {_d0('tp', 'tp + fn')} AS recall, {_fb('tp', 'fp', 'fn', '1.0')} AS f1,
  {_fb('tp', 'fp', 'fn', '4.0')} AS f2, {_d0('tp + tn', 'n')} AS accuracy, brier, tp, fp, fn, tn
FROM {confusion_sql(src, keys)})"""


def auc_sql(src: str = "ev", keys: str = "threat") -> str:
    return f"""(WITH g AS (SELECT {keys}, p, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg
            FROM {src} GROUP BY {keys}, p),
  c AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg FROM g
        WINDOW w AS (PARTITION BY {keys} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  t AS (SELECT {keys}, sum(pos) AS tot_pos, sum(neg) AS tot_neg FROM g GROUP BY {keys})
SELECT {keys}, CASE WHEN tot_pos > 0 AND tot_neg > 0
                    THEN sum(pos * (cum_neg - neg + 0.5 * neg)) / (tot_pos * tot_neg) END AS roc_auc,
  CASE WHEN tot_pos > 0 AND tot_neg > 0 THEN sum(CAST(pos AS DOUBLE) / tot_pos * (tot_pos - (cum_pos - pos))
       / ((tot_pos - (cum_pos - pos)) + (tot_neg - (cum_neg - neg)))) END AS pr_auc
FROM c JOIN t USING ({keys}) GROUP BY {keys}, tot_pos, tot_neg)"""


PERSIST_SQL = """pers AS (
  SELECT entity, day, threat, y, CAST(lag(y, 1) OVER (PARTITION BY entity, threat ORDER BY day) AS DOUBLE) AS p
  FROM ev QUALIFY lag(y, 1) OVER (PARTITION BY entity, threat ORDER BY day) IS NOT NULL)"""

LEAD_SQL = """lt AS (
  SELECT threat, avg(CAST(CASE WHEN hit IS NULL THEN 0 ELSE i - hit END AS DOUBLE)) FILTER (onset) AS lead_time_days,
    count(*) FILTER (onset) AS n_onsets
  FROM (SELECT *, y = 1 AND coalesce(lag(y, 1) OVER (PARTITION BY entity, threat ORDER BY day), 0) = 0 AS onset,
          max(CASE WHEN p >= 0.7 THEN i END) OVER (PARTITION BY entity, threat ORDER BY day
                                                   ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS hit
        FROM (SELECT *, row_number() OVER (PARTITION BY entity, threat ORDER BY day) AS i FROM ev))
  GROUP BY threat)"""


@query("j12_confusion", sql=with_base(f"SELECT threat, n, tp, fp, fn, tn FROM {confusion_sql()}"))
def j12_confusion(spark, sf):
    """Confusion counts at p >= 0.5 per threat."""
    return EV.confusion(_long(spark, sf)).select("threat", "n", "tp", "fp", "fn", "tn")


@query("j13_metrics", sql=with_base(f"SELECT * FROM {metrics_sql()}"))
def j13_metrics(spark, sf):
    """Threshold metrics and Brier per threat on known labels only."""
    return EV.metrics(_long(spark, sf))


@query("j14_roc_auc", sql=with_base(f"SELECT threat, roc_auc FROM {auc_sql()}"))
def j14_roc_auc(spark, sf):
    """Tie-aware Mann-Whitney ROC-AUC per threat."""
    return EV.auc_ap(_long(spark, sf)).select("threat", "roc_auc")


@query("j15_average_precision", sql=with_base(f"SELECT threat, pr_auc FROM {auc_sql()}"))
def j15_average_precision(spark, sf):
    """Step-wise average precision per threat."""
    return EV.auc_ap(_long(spark, sf)).select("threat", "pr_auc")


@query("j16_class_report", sql=with_base(f"""
SELECT threat, cls, precision, recall, f1, support FROM (
  SELECT threat, '1' AS cls, {_d0('tp', 'tp + fp')} AS precision, {_d0('tp', 'tp + fn')} AS recall,
    {_fb('tp', 'fp', 'fn', '1.0')} AS f1, CAST(tp + fn AS DOUBLE) AS support FROM {confusion_sql()}
  UNION ALL
  SELECT threat, '0', {_d0('tn', 'tn + fn')}, {_d0('tn', 'tn + fp')}, {_fb('tn', 'fn', 'fp', '1.0')},
    CAST(tn + fp AS DOUBLE) FROM {confusion_sql()}
  UNION ALL
  SELECT threat, 'macro avg', ({_d0('tn', 'tn + fn')} + {_d0('tp', 'tp + fp')}) / 2.0,
    ({_d0('tn', 'tn + fp')} + {_d0('tp', 'tp + fn')}) / 2.0,
    ({_fb('tn', 'fn', 'fp', '1.0')} + {_fb('tp', 'fp', 'fn', '1.0')}) / 2.0, CAST(n AS DOUBLE) FROM {confusion_sql()}
  UNION ALL
  SELECT threat, 'weighted avg',
    CASE WHEN n = 0 THEN 0.0 ELSE ({_d0('tn', 'tn + fn')} * CAST(tn + fp AS DOUBLE)
      + {_d0('tp', 'tp + fp')} * CAST(tp + fn AS DOUBLE)) / CAST(n AS DOUBLE) END,
    CASE WHEN n = 0 THEN 0.0 ELSE ({_d0('tn', 'tn + fp')} * CAST(tn + fp AS DOUBLE)
      + {_d0('tp', 'tp + fn')} * CAST(tp + fn AS DOUBLE)) / CAST(n AS DOUBLE) END,
    CASE WHEN n = 0 THEN 0.0 ELSE ({_fb('tn', 'fn', 'fp', '1.0')} * CAST(tn + fp AS DOUBLE)
      + {_fb('tp', 'fp', 'fn', '1.0')} * CAST(tp + fn AS DOUBLE)) / CAST(n AS DOUBLE) END,
    CAST(n AS DOUBLE) FROM {confusion_sql()})"""))
def j16_class_report(spark, sf):
    """Per-class precision/recall/F1/support with macro and weighted averages."""
    return EV.per_class_report(EV.metrics(_long(spark, sf))).withColumnRenamed("cls", "cls")


@query("j17_bootstrap_ci", no_oracle="seeded multinomial resampling (NumPy) inside applyInPandas; "
                                     "point estimate equals j13 f2, see tests")
def j17_bootstrap_ci(spark, sf):
    """F2 point estimate with 1000-resample 95 % percentile CI per threat."""
    return EV.bootstrap_f2(EV.metrics(_long(spark, sf)))


@query("e15_event_onsets", sql=with_base("""
SELECT entity, threat, count(*) AS n_onsets FROM (
  SELECT *, y = 1 AND coalesce(lag(y, 1) OVER (PARTITION BY entity, threat ORDER BY day), 0) = 0 AS onset FROM ev)
WHERE onset GROUP BY entity, threat"""))
def e15_event_onsets(spark, sf):
    """Event onsets (first 1 of every run) per entity and threat."""
    from pyspark.sql import Window
    lg = _long(spark, sf)
    w = Window.partitionBy("entity", "threat").orderBy("day")
    onset = (F.col("y") == 1) & (F.coalesce(F.lag("y", 1).over(w), F.lit(0)) == 0)
    return (lg.withColumn("_onset", onset).where("_onset")
              .groupBy("entity", "threat").agg(F.count(F.lit(1)).alias("n_onsets")))


@query("e16_lead_time", sql=with_base("SELECT * FROM lt", extra=LEAD_SQL))
def e16_lead_time(spark, sf):
    """Mean warning lead (rows) before onsets at p >= 0.7 within 30 rows."""
    return EV.lead_time(_long(spark, sf))


@query("e17_persistence", sql=with_base(f"SELECT threat, n, f1, f2, precision, recall FROM {metrics_sql('pers')}",
                                        extra=PERSIST_SQL))
def e17_persistence(spark, sf):
    """Persistence baseline (previous row's label) metrics per threat."""
    return EV.metrics(EV.persistence(_long(spark, sf))).select("threat", "n", "f1", "f2", "precision", "recall")


@query("j18_evaluation", sql=with_base(f"""
SELECT m.*, a.roc_auc, a.pr_auc, lt.lead_time_days, lt.n_onsets, pm.f2 AS persistence_f2,
  m.f2 > pm.f2 AS beats_baseline
FROM {metrics_sql()} m JOIN {auc_sql()} a USING (threat) LEFT JOIN lt USING (threat)
LEFT JOIN {metrics_sql('pers')} pm USING (threat)""", extra=PERSIST_SQL + "," + LEAD_SQL))
def j18_evaluation(spark, sf):
    """Full per-threat evaluation: metrics, AUC, AP, lead time, persistence, beats flag."""
    return EV.evaluation(_long(spark, sf))


@query("j19_entity_metrics", sql=with_base(f"""
SELECT m.*, a.roc_auc, a.pr_auc FROM {metrics_sql('ev', 'entity, threat')} m
JOIN {auc_sql('ev', 'entity, threat')} a USING (entity, threat)"""))
def j19_entity_metrics(spark, sf):
    """Metrics and AUC/AP per entity x threat."""
    lg = _long(spark, sf)
    return EV.metrics(lg, ("entity", "threat")).join(EV.auc_ap(lg, ("entity", "threat")), ["entity", "threat"])


@query("j20_mean_f2", sql=with_base(f"SELECT avg(f2) AS mean_f2, count(*) AS n_threats FROM {metrics_sql()}"))
def j20_mean_f2(spark, sf):
    """Unweighted mean F2 across threats."""
    return EV.metrics(_long(spark, sf)).agg(F.avg("f2").alias("mean_f2"), F.count(F.lit(1)).alias("n_threats"))


_BIN_SQL = "(" + " + ".join(f"CAST(p > {k * 0.1!r}::DOUBLE AS INTEGER)" for k in range(1, 10)) + ")"


@query("j21_reliability", sql=with_base(f"""
SELECT threat, {_BIN_SQL} AS bin, avg(p) AS mean_pred, avg(y) AS observed,
  count(*) AS n FROM ev GROUP BY threat, {_BIN_SQL}"""))
def j21_reliability(spark, sf):
    """10-bin reliability curve per threat, empty bins dropped."""
    return EV.reliability(_long(spark, sf))


def _configs(spark, sf):
    lg = _long(spark, sf)
    score = EV.metrics(lg).select(F.lit("score").alias("config"), "threat", "f2", "recall")
    pers = EV.metrics(EV.persistence(lg)).select(F.lit("persistence").alias("config"), "threat", "f2", "recall")
    return score.unionByName(pers)


_CFG_SQL = ("cfg AS (SELECT 'score' AS config, threat, f2, recall FROM " + metrics_sql()
            + " UNION ALL SELECT 'persistence', threat, f2, recall FROM " + metrics_sql("pers") + ")")


@query("d22_f2_pivot", sql=with_base("""
SELECT config, max(f2) FILTER (WHERE threat = 'fire') AS fire, max(f2) FILTER (WHERE threat = 'drought') AS drought,
  max(f2) FILTER (WHERE threat = 'vegetation') AS vegetation FROM cfg GROUP BY config""",
    extra=PERSIST_SQL + "," + _CFG_SQL))
def d22_f2_pivot(spark, sf):
    """Long (config, threat, f2) -> wide per-threat columns."""
    return _configs(spark, sf).groupBy("config").pivot("threat", ["fire", "drought", "vegetation"]).agg(F.max("f2"))


@query("d22_accuracy_pivot", sql=with_base("""
SELECT config, """ + ", ".join(f"max(accuracy) FILTER (WHERE threat = '{t}') AS {t}" for t in C.THREATS) + """ FROM (
  SELECT 'score' AS config, threat, accuracy FROM """ + metrics_sql() + " UNION ALL SELECT 'persistence', threat, accuracy FROM "
    + metrics_sql("pers") + ") GROUP BY config", extra=PERSIST_SQL))
def d22_accuracy_pivot(spark, sf):
    """Accuracy of each configuration, one column per threat."""
    lg = _long(spark, sf)
    both = EV.metrics(lg).withColumn("config", F.lit("score")).unionByName(EV.metrics(EV.persistence(lg)).withColumn("config", F.lit("persistence")))
    return both.groupBy("config").pivot("threat", C.THREATS).agg(F.max("accuracy"))


@query("d22_entity_f2_pivot", sql=with_base("SELECT entity, " + ", ".join(f"max(f2) FILTER (WHERE threat = '{t}') AS {t}" for t in C.THREATS)
    + f" FROM {metrics_sql('ev', 'entity, threat')} GROUP BY entity"))
def d22_entity_f2_pivot(spark, sf):
    """F2 per entity, one column per threat."""
    return EV.metrics(_long(spark, sf), keys=("entity", "threat")).groupBy("entity").pivot("threat", C.THREATS).agg(F.max("f2"))


@query("d22_lead_time_pivot", sql=with_base("SELECT " + ", ".join(f"max(lead_time_days) FILTER (WHERE threat = '{t}') AS {t}" for t in C.THREATS)
    + " FROM lt", extra=LEAD_SQL))
def d22_lead_time_pivot(spark, sf):
    """Mean days of warning, one column per threat."""
    lt = EV.lead_time(_long(spark, sf))
    return lt.agg(*[F.max(F.when(F.col("threat") == t, F.col("lead_time_days"))).alias(t) for t in C.THREATS])


@query("j18_evaluation_with_ci", no_oracle="bootstrap interval by seeded resampling; the point equals j18_evaluation")
def j18_evaluation_with_ci(spark, sf):
    """Full per-threat evaluation with the F2 bootstrap interval."""
    lg = _long(spark, sf)
    return EV.evaluation(lg).join(EV.bootstrap_f2(EV.metrics(lg)).drop("f2_point"), "threat")


@query("f04_leaderboard", sql=with_base("""
SELECT config, mean_f2, row_number() OVER (ORDER BY mean_f2 DESC, config) AS rank
FROM (SELECT config, avg(f2) AS mean_f2 FROM cfg GROUP BY config)""", extra=PERSIST_SQL + "," + _CFG_SQL))
def f04_leaderboard(spark, sf):
    """Configurations ranked by mean F2, highest first."""
    from veldt.functions.ranking import global_row_number
    m = _configs(spark, sf).groupBy("config").agg(F.avg("f2").alias("mean_f2"))
    return global_row_number(m, [F.col("mean_f2").desc(), F.col("config")], out="rank")


@query("c15_config_delta", sql=with_base("""
SELECT a.threat, a.f2 AS f2_score, b.f2 AS f2_persistence, a.f2 - b.f2 AS delta_f2, a.recall - b.recall AS delta_recall
FROM cfg a JOIN cfg b ON a.threat = b.threat AND a.config = 'score' AND b.config = 'persistence'""",
    extra=PERSIST_SQL + "," + _CFG_SQL))
def c15_config_delta(spark, sf):
    """Self-join of two configurations on threat with F2 / recall deltas."""
    c = _configs(spark, sf)
    a = c.where("config = 'score'").select("threat", F.col("f2").alias("f2_score"), F.col("recall").alias("ra"))
    b = c.where("config = 'persistence'").select("threat", F.col("f2").alias("f2_persistence"),
                                                  F.col("recall").alias("rb"))
    j = a.join(b, "threat")
    return j.select("threat", "f2_score", "f2_persistence", (F.col("f2_score") - F.col("f2_persistence")).alias("delta_f2"),
                    (F.col("ra") - F.col("rb")).alias("delta_recall"))
