"""Model fitting, calibration and scoring on Spark ML.

* J1  median imputation fitted on clean train rows (exact, distributed, interpolated);
* J2  balanced class weights n / (k * n_c) as a weight column;
* J3/J4 per-threat RandomForest / GBT ensembles over an explicit validation
  grid (chronological split, mean-F2 selection) on a bounded number of labelled
  rows; one fit serves all ensemble sizes of a point, fits run side by side;
* J5/J6 self-training with a confidence gate, one pool for all threats or one
  for each; every round's state is checkpointed (reliable, in the shared
  checkpoint folder) to cut lineage;
* J8  Platt scaling (``LogisticRegression`` on the score) with a temperature
  fallback when the slope is <= 0 (J9: grid argmin of NLL, refined twice);
* J10 isotonic calibration; J11 a stored scorer: impute -> model -> calibrate -> clip.
"""

from __future__ import annotations

import itertools
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt import config as C
from veldt.functions import scalar as S
from veldt.operators import evaluate as EV
from veldt.session import checkpoint_dir

IMPUTED = [f"{c}__i" for c in C.FEATURE_COLS]

#: labelled rows, and rows of the unlabelled pool, that fits learn from at most
LABELLED_ROWS = 1500
#: the parameter that counts the trees of an ensemble; depth 30 is the deepest that Spark grows
SIZE = {"rf": "numTrees", "gbt": "maxIter"}
RF_GRID = {"numTrees": [200, 300], "maxDepth": [30, 20], "minInstancesPerNode": [1, 5]}
GBT_GRID = {"maxIter": [200, 300], "maxDepth": [4, 6], "stepSize": [0.05, 0.1]}


def medians(train_clean: DataFrame, cols=None) -> DataFrame:
    """Exact per-feature medians (interpolated, like NumPy) on clean train rows."""
    from veldt.functions.ranking import exact_quantiles
    cols = cols or C.FEATURE_COLS
    long = train_clean.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"),
                                                          F.col(c).cast("double").alias("value")) for c in cols])))
    return exact_quantiles(long, ["feature"], "value", 0.5, out="median")


def fit_medians(train_clean: DataFrame) -> dict:
    """The 20 medians as model parameters (a bounded, feature-sized vector)."""
    return {r["feature"]: r["median"] for r in medians(train_clean).collect()}


def impute(df: DataFrame, med: dict) -> DataFrame:
    """NULL feature -> fitted median (J1), into the ``__i`` columns."""
    return df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(med.get(c))).alias(f"{c}__i")
                            for c in C.FEATURE_COLS])


def class_weights(df: DataFrame, label: str, out: str = "w") -> DataFrame:
    """Balanced class weights n / (k * n_c) as a column (J2): one small
    aggregate (one row per class) broadcast back onto the rows."""
    from pyspark.sql import Window
    cnt = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    over_classes = Window.partitionBy(F.lit(1))      # spans the k (<= 2) class rows only
    wt = cnt.select(label, (F.sum("_nc").over(over_classes)
                            / (F.count(F.lit(1)).over(over_classes) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(wt), label, "left")


def positive_weights(long: DataFrame) -> DataFrame:
    """(threat, y) rows -> threat, n_neg / n_pos, 1 where a threat has no positive row."""
    n_pos, n_neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    return long.groupBy("threat").agg(F.when(n_pos > 0, n_neg / F.nullif(n_pos, F.lit(0))).otherwise(F.lit(1.0)).alias("pos_weight"))


def bounded(train: DataFrame, rows: int = LABELLED_ROWS, keys=("entity", "day")) -> DataFrame:
    """At most ``rows`` labelled rows: those whose keys have the smallest hashes (the same in every
    run), in one partition, since every level of every tree is a job over them."""
    return train.orderBy(F.xxhash64(*keys), *keys).limit(rows).coalesce(1)


# ----------------------------------------------------------------- models

@dataclass
class Ensemble:
    """Fitted pipelines whose positive-class probabilities are averaged by weight."""
    parts: list  # of (PipelineModel, weight)


def _prepared(train: DataFrame, label: str, kind: str) -> DataFrame:
    """(label, features, w): balanced weights for forests, n_neg / n_pos on positives for boosting."""
    df = train.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double"))
    if kind == "rf":
        df = class_weights(df, label)
    else:
        pos = positive_weights(df.select(F.lit("one").alias("threat"), F.col(label).alias("y"))).select("pos_weight")
        df = df.join(F.broadcast(pos)).withColumn("w", F.when(F.col("label") == 1, F.col("pos_weight")).otherwise(F.lit(1.0)))  # one row
    return _assembler().transform(df).select("label", "features", "w")


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=IMPUTED, outputCol="features", handleInvalid="keep")


def _learner(kind: str, params: dict, seed: int):
    if kind == "rf":
        return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="w", seed=seed, **params)
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="w", seed=seed, subsamplingRate=0.8,
                         featureSubsetStrategy="0.8", **params)


def first_rounds(model: PipelineModel, rounds: int) -> PipelineModel:
    """A boosted pipeline cut after its first ``rounds`` trees: what a fit of that many rounds gives."""
    whole = model.stages[-1]
    sc = SparkSession.active().sparkContext
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(sc._jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(whole.trees[:rounds], whole.treeWeights[:rounds], strict=True)):
        trees[i], weights[i] = tree._java_obj, weight
    cut = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{whole.uid}_{rounds}", trees, weights)
    return PipelineModel([*model.stages[:-1], GBTClassificationModel(cut)])


def fit_staged(train: DataFrame, label: str, kind: str, params: dict, sizes: list[int], seed: int = 42) -> dict:
    """One model per ensemble size for the price of the largest (J3/J4): a larger forest is a smaller
    one and more trees; the boosted ensembles are the first rounds of the longest."""
    df = _prepared(train, label, kind).persist()
    try:
        if df.select("label").distinct().count() < 2:  # every tree is the same leaf: one says it all
            one = PipelineModel([_assembler(), _learner(kind, params | {SIZE[kind]: 1}, seed).fit(df)])
            return dict.fromkeys(sizes, Ensemble([(one, 1.0)]))
        out, grown, before = {}, [], 0
        for k, size in enumerate(sorted(sizes)):
            if kind == "rf":
                more = _learner(kind, params | {"numTrees": size - before}, seed + k).fit(df)
                grown.append((PipelineModel([_assembler(), more]), float(size - before)))
                out[size], before = Ensemble(list(grown)), size
        if kind != "rf":
            whole = PipelineModel([_assembler(), _learner(kind, params | {"maxIter": max(sizes)}, seed).fit(df)])
            out = {size: Ensemble([(first_rounds(whole, min(size, len(whole.stages[-1].trees))), 1.0)]) for size in sizes}
        return out
    finally:
        df.unpersist()


def fit_classifier(train: DataFrame, label: str, kind: str = "rf", params: dict | None = None, seed: int = 42) -> Ensemble:
    """assemble -> classifier pipeline for one threat on imputed columns."""
    params = dict(params or {})
    size = params.pop(SIZE[kind], 20)
    return fit_staged(train, label, kind, params, [size], seed)[size]


def predict(model: Ensemble, df: DataFrame, out: str) -> DataFrame:
    """Positive-class probability of a fitted ensemble as a DOUBLE column."""
    names = []
    for k, (part, _) in enumerate(model.parts):
        # a single-class training label gives a 1-element vector: P(positive) = 0
        pos = F.coalesce(F.get(vector_to_array("probability"), 1), F.lit(0.0))
        names.append(f"__{out}_{k}")
        df = part.transform(df).withColumn(names[-1], pos).drop("features", "rawPrediction", "probability", "prediction")
    total = sum(w for _, w in model.parts)
    mean = reduce(lambda a, b: a + b, [F.col(n) * F.lit(w) for n, (_, w) in zip(names, model.parts, strict=True)]) / F.lit(total)
    return df.withColumn(out, mean).drop(*names)


def fit_bundle(train: DataFrame, kind: str = "rf", params: dict | None = None, parallelism: int = 3) -> dict:
    """Per-threat models with a common predict interface."""
    models = _together(lambda lab: fit_classifier(train, lab, kind, params), C.LABEL_COLS, parallelism)
    return dict(zip(C.THREATS, models, strict=True))


def predict_bundle(bundle: dict, df: DataFrame, prefix: str = "raw_") -> DataFrame:
    out = df
    for t, prob in zip(C.THREATS, C.PROB_COLS):
        out = predict(bundle[t], out, f"{prefix}{prob}")
    return out


def _together(fn, items, parallelism: int) -> list:
    """``fn`` of every item, several Spark jobs at a time, results in order."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(fn), items))


@dataclass
class Grid:
    """Points in grid order with their validation scores; ``best`` is the first of the highest mean F2."""
    points: list
    bundles: list

    @property
    def best(self) -> int:
        return max(range(len(self.points)), key=lambda i: (self.points[i]["mean_f2"], -i))


def grid_search(train: DataFrame, val: DataFrame, kind: str = "rf", grid: dict | None = None, parallelism: int = 6) -> Grid:
    """Every point of the grid fitted per threat and scored by validation mean F2.

    Points that differ in the ensemble's size only share a fit; fits run side by side.  ``train`` should be
    bounded (:func:`bounded`), validation rows are all used."""
    grid = grid or (RF_GRID if kind == "rf" else GBT_GRID)
    size = SIZE[kind]
    keys = [k for k in grid if k != size]
    fixed = [dict(zip(keys, c, strict=True)) for c in itertools.product(*[grid[k] for k in keys])]
    train, val = train.persist(), val.select(*C.LABEL_COLS, *IMPUTED).persist()
    try:
        jobs = [(f, lab) for f in fixed for lab in C.LABEL_COLS]
        fitted = _together(lambda j: fit_staged(train, j[1], kind, j[0], grid[size]), jobs, parallelism)
        models = {(i // len(C.LABEL_COLS), C.THREATS[i % len(C.LABEL_COLS)]): m for i, m in enumerate(fitted)}
        at = [(n, f) for n in grid[size] for f in range(len(fixed))]
        bundles = [{t: models[f, t][n] for t in C.THREATS} for n, f in at]

        def score(bundle):
            got = EV.metrics(EV.to_long(predict_bundle(bundle, val, prefix=""), [])).select("threat", "f2").collect()  # one row a threat
            return {r["threat"]: r["f2"] for r in got}

        scores = _together(score, bundles, parallelism)
        points = [{"params": {size: n} | fixed[f], "f2": s, "mean_f2": sum(s.values()) / max(len(s), 1)} for (n, f), s in zip(at, scores, strict=True)]
        return Grid(points, bundles)
    finally:
        train.unpersist()
        val.unpersist()


# ----------------------------------------------------------------- stored pipeline

@dataclass
class Scorer:
    """impute -> model -> calibrate -> clip, as fitted."""
    bundle: dict
    medians: dict
    calibration: dict

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` (feature columns) with the calibrated probabilities of all threats."""
        out = predict_bundle(self.bundle, impute(df, self.medians), prefix="").drop(*IMPUTED)
        for t, p in zip(C.THREATS, C.PROB_COLS, strict=True):
            out = out.withColumn(p, S.clip(calibrated(F.col(p), self.calibration.get(t))))
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        for t, model in self.bundle.items():
            for k, (part, _) in enumerate(model.parts):
                part.write().overwrite().save(f"{path}/models/{t}-{k}")
        meta = {"parts": {t: [w for _, w in m.parts] for t, m in self.bundle.items()}, "medians": self.medians, "calibration": self.calibration}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scorer:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        bundle = {t: Ensemble([(PipelineModel.load(f"{path}/models/{t}-{k}"), w) for k, w in enumerate(ws)]) for t, ws in meta["parts"].items()}
        return cls(bundle, meta["medians"], {t: tuple(c) for t, c in meta["calibration"].items()})


# ----------------------------------------------------------------- calibration

def temperature(long_val: DataFrame, lo: float = 0.1, hi: float = 10.0, steps: int = 100,
                refine: int = 2) -> DataFrame:
    """T minimising validation NLL of sigmoid(logit(p)/T) per threat.

    Each pass evaluates a T grid with ONE aggregate (grid values are exploded
    per row and partially aggregated per (threat, T)); the next pass zooms into
    +-1 cell around the best T."""
    base = long_val.select("threat", "y", S.logit(F.col("p")).alias("_z"))
    best = _t_pass(base.withColumn("_lo", F.lit(lo)).withColumn("_hi", F.lit(hi)), steps)
    width = (hi - lo) / steps
    for _ in range(refine):
        b = base.join(F.broadcast(best), "threat")   # one row per threat
        b = (b.withColumn("_lo", F.greatest(F.lit(lo), F.col("T") - F.lit(width)))
              .withColumn("_hi", F.least(F.lit(hi), F.col("T") + F.lit(width))).drop("T"))
        best = _t_pass(b, steps)
        width = 2 * width / steps
    return best


def _t_pass(x: DataFrame, steps: int) -> DataFrame:
    ts = F.transform(F.sequence(F.lit(0), F.lit(steps)),
                     lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i.cast("double") / F.lit(float(steps)))
    x = x.select("threat", "y", "_z", F.explode(ts).alias("T"))
    q = S.clip(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z") / F.col("T"))), 1e-7, 1 - 1e-7)
    nll = -(F.col("y") * F.log(q) + (F.lit(1) - F.col("y")) * F.log(F.lit(1.0) - q))
    g = x.groupBy("threat", "T").agg(F.avg(nll).alias("nll"))
    return g.groupBy("threat").agg(F.min_by("T", F.struct("nll", "T")).alias("T"))


def platt(long_val: DataFrame) -> dict:
    """Per-threat Platt scaler; slope <= 0 falls back to temperature scaling.

    Returns {threat: ("platt", intercept, slope) | ("temperature", T)}; the
    LogisticRegression runs distributed over the validation rows."""
    out = {}
    temps = None
    for t in C.THREATS:
        d = (long_val.where(F.col("threat") == t)
                     .select(F.col("y").cast("double").alias("label"), F.array(F.col("p")).alias("_a")))
        n = d.count()
        if n == 0:
            continue
        d = d.withColumn("features", array_to_vector("_a"))
        lr = LogisticRegression(regParam=1.0 / (1e5 * n), standardization=False, maxIter=500).fit(d)
        slope = float(lr.coefficients[0])
        if slope <= 0:
            if temps is None:
                temps = {r["threat"]: r["T"] for r in temperature(long_val).collect()}
            out[t] = ("temperature", temps[t])
        else:
            out[t] = ("platt", float(lr.intercept), slope)
    return out


def calibrated(p: Column, fitted: tuple | None) -> Column:
    """Probability through one fitted scaler (J8/J9); without one, as it is."""
    if fitted is None:
        return p
    if fitted[0] == "platt":
        return S.sigmoid(F.lit(fitted[1]) + F.lit(fitted[2]) * p)
    return S.sigmoid(S.logit(p) / F.lit(fitted[1]))


def apply_calibration(long: DataFrame, cal: dict, out: str = "p_cal") -> DataFrame:
    """Calibrated probability per threat through the fitted scalers (J8/J9), clipped."""
    e = F.col("p")
    for t, c in cal.items():
        e = F.when(F.col("threat") == t, calibrated(F.col("p"), c)).otherwise(e)
    return long.withColumn(out, S.clip(e))


def isotonic(long_val: DataFrame) -> dict:
    """Per-threat isotonic calibrators."""
    models = {}
    for t in C.THREATS:
        d = long_val.where(F.col("threat") == t).select(F.col("p").alias("features"),
                                                        F.col("y").cast("double").alias("label"))
        models[t] = IsotonicRegression(isotonic=True, featuresCol="features", labelCol="label").fit(d)
    return models


def apply_isotonic(long: DataFrame, models: dict, out: str = "p_cal") -> DataFrame:
    parts = []
    for t, m in models.items():
        x = m.setFeaturesCol("p").setPredictionCol(out).transform(long.where(F.col("threat") == t))
        parts.append(x.withColumn(out, S.clip(F.col(out))))
    return reduce(lambda a, b: a.unionByName(b), parts)


# ----------------------------------------------------------------- self-training

def _confident(p: Column, gate: float) -> Column:
    return F.greatest(p, F.lit(1.0) - p) > F.lit(gate)


def self_train(train: DataFrame, pool: DataFrame, kind: str = "rf", params: dict | None = None,
               gate: float = 0.9, rounds: int = 5) -> tuple[dict, list]:
    """Self-training with one pool (J5, G3): fit on rows whose labels are all known, move pool rows
    that are confident in every threat (max(p, 1-p) > gate) over with their pseudo labels, refit;
    stop after ``rounds`` or when nothing is confident.  Both sets are checkpointed every round."""
    checkpoint_dir(train.sparkSession)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in C.LABEL_COLS])
    lab, history = train.where(known), []
    left = pool.withColumn("_pool_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    bundle = fit_bundle(lab, kind, params)
    for r in range(rounds):
        scored = predict_bundle(bundle, left, prefix="")
        sure = reduce(lambda a, b: a & b, [_confident(F.col(p), gate) for p in C.PROB_COLS])
        take = scored.where(sure).checkpoint(eager=True)
        added = take.count()
        if not added:
            break
        history.append({"round": r + 1, "added": added})
        for c, p in zip(C.LABEL_COLS, C.PROB_COLS, strict=True):
            take = take.withColumn(c, (F.col(p) > 0.5).cast("int"))
        lab = lab.unionByName(take.select(*lab.columns)).checkpoint(eager=True)
        left = left.join(take.select("_pool_id"), "_pool_id", "left_anti").checkpoint(eager=True)
        bundle = fit_bundle(lab, kind, params)
    return bundle, history


def self_train_per_threat(train: DataFrame, pool: DataFrame, kind: str = "rf", params: dict | None = None,
                          gate: float = 0.9, rounds: int = 5) -> tuple[dict, DataFrame]:
    """Self-training with a pool for each threat (J6, G3), all of them advanced in one loop.

    The state is one table of (threat, _pool_id, y, round): a row leaves the pool of a threat when
    that threat's model is sure of it, and stays in the others'.  Returns the models and the
    sizes: threat, round, added, left.  A threat without new rows is not fitted again."""
    spark = train.sparkSession
    checkpoint_dir(spark)
    base = pool.withColumn("_pool_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    taken = spark.createDataFrame([], "threat string, _pool_id long, y int, round int")
    total, columns = base.count(), train.columns
    bundle, open_, sizes, moved = {}, list(C.THREATS), [], dict.fromkeys(C.THREATS, 0)
    label = dict(zip(C.THREATS, C.LABEL_COLS, strict=True))
    for r in range(rounds + 1):
        def fit(t, taken=taken):
            own = taken.where(F.col("threat") == t).select("_pool_id", F.col("y").alias("_y"))
            pseudo = base.join(own, "_pool_id").withColumn(label[t], F.col("_y")).select(*columns)
            return fit_classifier(train.where(F.col(label[t]).isNotNull()).unionByName(pseudo), label[t], kind, params)

        bundle |= dict(zip(open_, _together(fit, open_, len(C.THREATS)), strict=True))
        if r == rounds:
            break
        scored = base
        for t in open_:
            scored = predict(bundle[t], scored, f"_p_{t}")
        long = scored.select("_pool_id", F.inline(F.array(*[F.struct(F.lit(t).alias("threat"), F.col(f"_p_{t}").alias("p")) for t in open_])))
        sure = long.join(taken, ["threat", "_pool_id"], "left_anti").where(_confident(F.col("p"), gate))
        new = sure.select("threat", "_pool_id", (F.col("p") > 0.5).cast("int").alias("y"), F.lit(r + 1).alias("round")).checkpoint(eager=True)
        added = {x["threat"]: x["n"] for x in new.groupBy("threat").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a threat
        open_ = [t for t in open_ if added.get(t)]
        if not open_:
            break
        for t in open_:
            moved[t] += added[t]
            sizes.append((t, r + 1, added[t], total - moved[t]))
        taken = taken.unionByName(new).checkpoint(eager=True)
    return bundle, spark.createDataFrame(sizes, "threat string, round int, added long, left long")
