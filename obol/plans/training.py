"""E1 training plan: loans -> features -> WoE on the train split -> model
matrix -> models -> stacking -> threshold search on validation -> persisted
state.  Every step is a library operator; this module only wires them."""

from __future__ import annotations

import json
import math
import random

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.tables import attach
from ..operators import cleaning, encoders, features, history, metrics, ml, neighbors, search, split
from ..session import materialize, stored
from ..sources import fixtures as fx


def feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned, labelled loans with ``split`` (stratified three ways), row, overdue and client-history features.

    The split comes first: the medians that fill gaps are those of the train rows."""
    l = stored(cleaning.with_label(fx.loans(spark, sf)))  # the split reads it several times
    # ranks leave a class in one task, and so all that is made of it up to the next shuffle
    l = split.stratified_three_way(l) if l.count() > search.FIT_ROWS else split.ranked_three_way(l)
    l = materialize(l)
    l = cleaning.fill_zero(l)
    l = l.withColumn("month_salary", cleaning.parse_number("salary_raw"))
    med = cleaning.fit_medians(l.where(F.col("split") == "train"), ["month_salary", "job_tenure"])
    l = cleaning.apply_medians(l, med)
    l = cleaning.fill_constant(l, ["main_business", "education"])
    l = features.repayment_features(l)
    l = features.overdue_features(l)
    return history.client_history(l)


def training_frame(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str], DataFrame]:
    """Three-way stratified split, WoE fitted on train only, model matrix.
    Returns (matrix with ``split``, feature columns, WoE table)."""
    f = materialize(feature_frame(spark, sf))
    woe = encoders.woe_fit(f.where(F.col("split") == "train"), C.CATEGORICAL_FEATURES)
    woe = materialize(woe)
    f = encoders.woe_apply(f, woe, C.CATEGORICAL_FEATURES)
    cats, nums, _ = cleaning.resolve_feature_lists(f)
    feats = nums + [f"{c}_woe" for c in cats if f"{c}_woe" in f.columns]
    m = ml.model_matrix(f, feats, keep=(C.KEY, C.LABEL, "split"))
    return materialize(m), feats, woe


_TRAINED: dict[tuple, tuple] = {}


def trained(spark: SparkSession, sf: str, trees: int | None = None):
    """M4/M5: the three base learners with their tuned parameters, fitted at once on the train split.

    Returns (models, matrix with ``split`` and class ``weight``, feature
    columns, WoE table).  The fits of an application are kept by input folder,
    as several queries report on the same models.
    """
    at = (spark.sparkContext.applicationId, sf, trees)
    if at not in _TRAINED:
        m, feats, woe = training_frame(spark, sf)
        weights = split.class_weights(m.where(F.col("split") == "train")).select(C.LABEL, F.col("balanced_weight").alias("weight"))
        m = materialize(m.join(F.broadcast(weights), C.LABEL, "left"))  # one row a class
        rows = m.where(F.col("split") == "train")
        est = ml.base_learners(weight_col="weight", trees=trees)
        _TRAINED[at] = ml.fit_all(rows, feats, est, len(est)), m, feats, woe
    return _TRAINED[at]


def long_predictions(models: dict, rows: DataFrame) -> DataFrame:
    """(model, key, y, p) of every model, all models applied in one scan."""
    wide = ml.StackingModel(models).base_probabilities(rows)
    return wide.select(C.KEY, F.col(C.LABEL).alias("y"), *[F.col(f"p_{n}").alias(n) for n in models]).unpivot([C.KEY, "y"], list(models), "model", "p")


def train_eval(spark: SparkSession, sf: str, trees: int | None = None):
    """M4/M5: models, their long predictions on the test split, feature columns and matrix."""
    models, m, feats, _ = trained(spark, sf, trees)
    return models, long_predictions(models, m.where(F.col("split") == "test")), feats, m


def stacking_eval(spark: SparkSession, sf: str, trees: int | None = None, k: int = C.KFOLDS) -> DataFrame:
    """M13 + M11/M12: stacking fitted on train (out-of-fold meta features),
    threshold tuned on validation, metrics reported on test next to the bases."""
    models, m, feats, _ = trained(spark, sf, trees)
    tr, va, te = (m.where(F.col("split") == s) for s in ("train", "val", "test"))
    st = ml.fit_stacking(tr, feats, ml.base_learners(weight_col="weight", trees=trees), k=k, bases=models, parallelism=8)

    def long(df):
        p = st.transform(df).withColumnRenamed("p", "p_Stacking")
        names = [*st.bases, "Stacking"]
        return p.select(C.KEY, F.col(C.LABEL).alias("y"), *[F.col(f"p_{n}").alias(n) for n in names]).unpivot([C.KEY, "y"], names, "model", "p")

    val_long, test_long = long(va), materialize(long(te))
    opt = metrics.optimal_threshold(val_long, "f2").select("model", F.col("threshold").alias("val_threshold"))
    at = test_long.join(F.broadcast(opt), "model")
    counts = at.groupBy("model", "val_threshold").agg(
        F.count(F.when((F.col("p") >= F.col("val_threshold")) & (F.col("y") == 1), 1)).alias("tp"),
        F.count(F.when((F.col("p") >= F.col("val_threshold")) & (F.col("y") != 1), 1)).alias("fp"),
        F.count(F.when((F.col("p") < F.col("val_threshold")) & (F.col("y") == 1), 1)).alias("fn"),
        F.count(F.when((F.col("p") < F.col("val_threshold")) & (F.col("y") != 1), 1)).alias("tn"))
    pm = metrics.point_metrics_from_counts(counts)
    return metrics.auc(test_long).join(pm, "model")


def sweep_settings(runs: int, seed: int = 42) -> list[dict]:
    """The drawn settings of every run; equal seeds draw equal runs, and more runs keep the earlier ones."""
    out = []
    for r in range(runs):
        rng = random.Random(f"{seed}|{r}")
        cfg = {}
        for name, space in C.SWEEP_SPACE.items():
            if isinstance(space, list):
                cfg[name] = rng.choice(space)
            elif len(space) == 3:
                cfg[name] = math.exp(rng.uniform(math.log(space[0]), math.log(space[1])))
            else:
                cfg[name] = rng.uniform(*space)
        out.append(cfg)
    return out


SWEEP_RESULT = "settings string, n_features int, n_train long, shallow_auc double, deep_auc double, val_auc double"


def sweep(spark: SparkSession, sf: str, runs: int = C.SWEEP_RUNS, seed: int = 42, trees: int | None = None, parallelism: int = 4,
          path: str | None = None) -> DataFrame:
    """Joint sweep over feature sets (target encoding, geographic risk), SMOTE, class weights and tree parameters.

    Every run fits two boosted learners and is scored by the validation AUC of
    their soft vote; the best run is flagged (ties: the earlier).  Encoders are
    fitted on the train split only.  Each run's row goes to the run table at
    ``path``, from which a broken sweep continues.  ``trees`` caps the trees of
    a trial run; by default the drawn numbers hold.
    """
    base = materialize(feature_frame(spark, sf))
    tr = base.where(F.col("split") == "train")
    woe = materialize(encoders.woe_fit(tr, C.CATEGORICAL_FEATURES))
    te_enc = materialize(encoders.target_fit(tr, C.CATEGORICAL_FEATURES))
    geo = materialize(encoders.geo_fit(tr))
    full = encoders.woe_apply(base, woe, C.CATEGORICAL_FEATURES)
    full = encoders.target_apply(full, te_enc, C.CATEGORICAL_FEATURES)
    full = encoders.geo_apply(full, geo)
    cats, nums, _ = cleaning.resolve_feature_lists(full)
    woe_cols = [f"{c}_woe" for c in cats if f"{c}_woe" in full.columns]
    te_cols = [f"{c}_target_enc" for c in cats]
    geo_cols = ["res_risk_score", "perm_risk_score", "city_risk_score", "address_stability_risk"]
    mat = materialize(ml.model_matrix(full, nums + woe_cols + te_cols + geo_cols, keep=(C.KEY, C.LABEL, "split")))
    train, val = mat.where(F.col("split") == "train"), mat.where(F.col("split") == "val")
    table = search.RunTable(spark, path or ml.state_path(spark, "sweep"), SWEEP_RESULT)

    def columns(target_enc: bool, geo_risk: bool) -> list[str]:
        return nums + woe_cols + (te_cols if target_enc else []) + (geo_cols if geo_risk else [])

    def train_rows(target_enc: bool, geo_risk: bool, smote: bool) -> DataFrame:
        feats = columns(target_enc, geo_risk)
        t = train.select(C.KEY, C.LABEL, *feats)
        if smote:
            t = neighbors.smote(t, C.LABEL, feats, C.KEY, k=5, ratio=C.SWEEP_SMOTE_RATIO, seed=seed)
        t = search.assembled(split.with_weights(t), feats, C.KEY, C.LABEL, "weight")
        return search.evenly(t)

    def job(name: str, cfg: dict):
        def run() -> None:
            feats = columns(cfg["use_target_enc"], cfg["use_geo"])
            rows = sets[cfg["use_target_enc"], cfg["use_geo"], cfg["use_smote"]]
            rows = rows.select(C.LABEL, "weight", F.when(F.col(C.LABEL) == 1, cfg["scale_pos_weight"]).otherwise(1.0).alias("positive"), "features")
            held = helds[cfg["use_target_enc"], cfg["use_geo"]]
            most = lambda n: min(n, trees) if trees else n
            common = dict(labelCol=C.LABEL, featuresCol="features", seed=seed, maxBins=64)
            shallow = GBTClassifier(maxIter=most(cfg["shallow_trees"]), maxDepth=cfg["shallow_depth"], stepSize=cfg["shallow_step"],
                                    subsamplingRate=cfg["shallow_rows"], featureSubsetStrategy=str(cfg["shallow_columns"]),
                                    minInstancesPerNode=cfg["shallow_min_rows"], weightCol="positive", **common)
            deep = GBTClassifier(maxIter=most(cfg["deep_trees"]), maxDepth=cfg["deep_depth"], stepSize=cfg["deep_step"],
                                 subsamplingRate=C.SWEEP_ROW_SHARE, featureSubsetStrategy=str(C.SWEEP_COLUMN_SHARE),
                                 minInstancesPerNode=cfg["deep_min_rows"], weightCol="weight", **common)
            n_train = rows.count()
            models = {n: PipelineModel([e.fit(rows)]) for n, e in (("shallow", shallow), ("deep", deep))}
            scored = held.select(C.KEY, F.col(C.LABEL).alias("y"), "features")
            for n, m in models.items():
                scored = ml.positive_probability(m.transform(scored), n).drop("rawPrediction", "probability", "prediction")
            voted = metrics.soft_vote(scored.drop("features"), list(models), out="vote")
            auc = {r["model"]: r["auc"] for r in metrics.auc(voted.unpivot([C.KEY, "y"], ["shallow", "deep", "vote"], "model", "p")).collect()}  # three numbers
            table.add(name, (json.dumps(cfg, sort_keys=True), len(feats), n_train, float(auc["shallow"]), float(auc["deep"]), float(auc["vote"])))
        return run

    settings = {f"{r:03d}": cfg for r, cfg in enumerate(sweep_settings(runs, seed))}
    done = table.done()
    left = {n: cfg for n, cfg in settings.items() if n not in done}
    # runs of equal columns and rows share them: each is made, and over-sampled, once
    wanted = sorted({(c["use_target_enc"], c["use_geo"], c["use_smote"]) for c in left.values()})
    sets = dict(zip(wanted, search.in_parallel(spark, [lambda w=w: train_rows(*w) for w in wanted], parallelism), strict=True))
    helds = {w: search.assembled(val, columns(*w), C.KEY, C.LABEL) for w in sorted({w[:2] for w in wanted})}
    most_levels = lambda c: c["shallow_trees"] * c["shallow_depth"] + c["deep_trees"] * c["deep_depth"]
    search.in_parallel(spark, [job(n, left[n]) for n in sorted(left, key=lambda n: -most_levels(left[n]))], parallelism)  # the longest first
    res = table.rows().withColumn("run", F.col("run").cast("int")).where(F.col("run") < runs)
    best = res.agg(F.min_by("run", F.struct(-F.col("val_auc"), "run")).alias("_best"))
    return attach(res, best).withColumn("best", (F.col("run") == F.col("_best")).cast("int")).drop("_best")


def batch_scoring(spark: SparkSession, sf: str, trees: int | None = None) -> DataFrame:
    """Persist the fitted model, WoE table and threshold,
    load them back, score the test split and apply R1-R7."""
    from ..operators import scoring
    models, m, feats, woe = trained(spark, sf, trees)
    va, te = (m.where(F.col("split") == s) for s in ("val", "test"))
    model = ml.save_model(models["GBT_shallow"], ml.state_path(spark, "model"))
    ml.save_table(woe, ml.state_path(spark, "woe"))
    vp = ml.positive_probability(model.transform(va)).select(F.col(C.LABEL).alias("y"), "p")
    best = metrics.optimal_threshold(vp, "f2")
    cfg = best.select(F.col("threshold").alias("recommended_threshold"), F.col("model").alias("recommended_model"))
    tpath = ml.state_path(spark, "threshold")
    scoring.write_threshold(cfg, tpath)
    t = scoring.load_threshold(spark, tpath)
    scored = ml.positive_probability(model.transform(te)).drop("features", "rawPrediction", "probability", "prediction")
    return scoring.score(scored, t, prob="p")
