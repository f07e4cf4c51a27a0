"""Models on Spark ML.

Boosted trees from third-party libraries are not available; the three base
learners are two ``GBTClassifier`` configurations and a
``RandomForestClassifier``.  Training frames are cut with a reliable
checkpoint before iterative fitting so a lost executor does not replay the
feature pipeline.  Only model metadata (parameter maps, importances: one
number per feature) ever reaches the driver.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.tables import attach
from ..session import ensure_checkpoint_dir, materialize
from . import metrics
from .cleaning import exact_quantiles_multi, existing
from .running import running


# ------------------------------------------------------------ M1 / M2
def fit_robust_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M1 fit: exact median and IQR per column -> (column, median, iqr)."""
    q = exact_quantiles_multi(df, cols, [0.25, 0.5, 0.75])
    return q.groupBy("column").agg(
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"),
        (F.max(F.when(F.col("q") == 0.75, F.col("value"))) - F.max(F.when(F.col("q") == 0.25, F.col("value"))))
        .alias("iqr"))


def apply_robust_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M1 apply: (x - median) / IQR, IQR 0 -> 1 (one broadcast stats row)."""
    wide = stats.groupBy().pivot("column", list(cols)).agg(F.first("median").alias("m"), F.first("iqr").alias("s"))
    out = attach(df, wide)
    for c in cols:
        s = F.when(F.col(f"{c}_s") == 0, F.lit(1.0)).otherwise(F.col(f"{c}_s"))
        out = out.withColumn(c, (F.col(c) - F.col(f"{c}_m")) / s)
    return out.drop(*[f"{c}_{x}" for c in cols for x in ("m", "s")])


def fit_one_hot_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """M2 fit: sorted levels per column (null -> 'missing').  The levels become
    output columns, so they are schema, however many."""
    levels: dict[str, list[str]] = {}
    long = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value").distinct()
    for r in long.collect():  # one row per output column
        levels.setdefault(r["column"], []).append(r["value"])
    return {c: sorted(v) for c, v in levels.items()}


def apply_one_hot(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = True) -> DataFrame:
    """M2 apply: one 0/1 column per level, the first (sorted) level dropped;
    unknown levels -> all zero."""
    out = df
    for c, lv in levels.items():
        v = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
        keep = lv[1:] if drop_first else lv
        out = out.withColumns({f"{c}__{x}": (v == F.lit(x)).cast("int") for x in keep})
    return out


def fit_one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M2 fit without a level limit: the table (column, value, idx, n_levels), null as 'missing'.

    ``idx`` counts down from the first sorted level, so that the level to drop
    is the last one, as Spark's encoder has it.  The table stays a table: no
    level reaches the driver."""
    long = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in cols]).unpivot(
        [], list(cols), "column", "value").distinct()
    ranked = running(materialize(long), ["column"], ["value"])
    n = ranked.groupBy("column").agg(F.count(F.lit(1)).alias("n_levels"))  # one row a column
    return materialize(ranked.join(F.broadcast(n), "column").select("column", "value", (F.col("n_levels") - F.col("_rn")).alias("idx"), "n_levels"))


def one_hot_vectors(df: DataFrame, levels: DataFrame, cols: Sequence[str], out: str = "one_hot") -> DataFrame:
    """M2 apply: one sparse vector with a slot for every level but each column's first sorted one; unknown levels -> all zero.

    Level numbers come from a join with the level table, one a column, which
    Spark broadcasts only where it is small; vectors are put together in the JVM."""
    sizes = {r["column"]: r["n_levels"] for r in levels.groupBy("column").agg(F.max("n_levels").alias("n_levels")).collect()}  # one row a column
    known = [c for c in cols if sizes.get(c, 0) > 1]
    d = df
    for i, c in enumerate(known):
        own = levels.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("idx").cast("double").alias(f"_i{i}"))
        d = d.join(own, F.coalesce(F.col(c).cast("string"), F.lit("missing")) == F.col(f"_v{i}"), "left").drop(f"_v{i}") \
            .withColumn(f"_i{i}", F.coalesce(f"_i{i}", F.lit(float(sizes[c] - 1))))
    if not known:
        return df.withColumn(out, array_to_vector(F.array().cast("array<double>")))
    # the encoder learns its sizes from one row that has every column's last number
    top = df.sparkSession.createDataFrame([tuple(float(sizes[c] - 1) for c in known)], [f"_i{i}" for i in range(len(known))])
    enc = OneHotEncoder(inputCols=[f"_i{i}" for i in range(len(known))], outputCols=[f"_o{i}" for i in range(len(known))], dropLast=True).fit(top)
    joined = VectorAssembler(inputCols=[f"_o{i}" for i in range(len(known))], outputCol=out).transform(enc.transform(d))
    return joined.drop(*[f"_{x}{i}" for i in range(len(known)) for x in "io"])


def vector_entries(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., position, value) of every non-zero entry of a sparse or dense vector column, without filling it up."""
    parts = F.from_json(F.to_json(F.struct(F.col(column).alias("v"))), "v struct<type:int,size:int,indices:array<int>,values:array<double>>")["v"]
    at = F.when(parts["type"] == 0, parts["indices"]).otherwise(F.sequence(F.lit(0), F.size(parts["values"]) - 1))
    return df.select(*keep, F.explode(F.arrays_zip(at.alias("position"), parts["values"].alias("value"))).alias("e")) \
        .select(*keep, "e.position", "e.value").where("value <> 0")


# ------------------------------------------------------------- M4 / M5
def base_learners(seed: int = 42, weight_col: str | None = None, label: str = C.LABEL, trees: int | None = None) -> dict[str, object]:
    """M4: the three base learners with their tuned parameters.

    ``weight_col`` goes to the learners that balance classes.  ``trees`` (trial
    runs and tests) replaces the number of trees of all three.
    """
    out = {}
    for name, params in C.MODEL_PARAMS.items():
        common = dict(labelCol=label, featuresCol="features", seed=seed)
        if weight_col and name in C.BALANCED:
            common["weightCol"] = weight_col
        if name == "RandomForest":
            out[name] = RandomForestClassifier(**common, **(params | ({"numTrees": trees} if trees else {})))
        else:
            out[name] = GBTClassifier(**common, **({"maxBins": 64} | params | ({"maxIter": trees} if trees else {})))
    return out


def with_early_stopping(est, indicator: str = "is_validation", tol: float = 0.01):
    """M4 early stopping: a GBT fitted on train + validation rows stops adding
    trees when the validation error stops improving (``validationTol``);
    rows flagged by ``indicator`` are used only for that check."""
    if isinstance(est, GBTClassifier):
        est = est.copy()
        est.setValidationIndicatorCol(indicator)
        est.set(est.validationTol, tol)
    return est


def assembler(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


def model_matrix(df: DataFrame, feature_cols: Sequence[str], keep: Sequence[str] = (C.KEY, C.LABEL)) -> DataFrame:
    """Numeric + WoE columns as doubles, null or NaN -> 0 (the assembler input)."""
    cols = existing(df, feature_cols)
    return df.select(*[c for c in keep if c in df.columns],
                     *[F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)).alias(c)
                       for c in cols])


def fit(df: DataFrame, feature_cols: Sequence[str], estimator) -> PipelineModel:
    """M5: assemble + estimator as one pipeline."""
    return Pipeline(stages=[assembler(feature_cols), estimator]).fit(df)


def fit_all(df: DataFrame, feature_cols: Sequence[str], learners: dict[str, object], parallelism: int = 4) -> dict[str, PipelineModel]:
    """M5: one pipeline of assembler + estimator a learner, fitted at once on rows that are assembled once for all."""
    from .search import assembled, evenly, in_parallel
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = evenly(assembled(df, feature_cols, *[c for c in df.columns if c not in feature_cols]), least=cores)
    fits = in_parallel(df.sparkSession, [lambda e=e: e.fit(rows) for e in learners.values()], parallelism)
    return {n: PipelineModel([assembler(feature_cols), m]) for n, m in zip(learners, fits, strict=True)}


def positive_probability(pred: DataFrame, out: str = "p") -> DataFrame:
    """P(y = 1) from the probability vector (JVM-side, no UDF)."""
    return pred.withColumn(out, vector_to_array(F.col("probability")).getItem(1))


def train_and_evaluate(train: DataFrame, test: DataFrame, feature_cols: Sequence[str],
                       learners: dict[str, object], label: str = C.LABEL) -> tuple[dict, DataFrame]:
    """M5: fit every learner on train, score test; return models and the long
    prediction frame (model, key, y, p)."""
    models, parts = {}, []
    for name, est in learners.items():
        m = fit(train, feature_cols, est)
        models[name] = m
        pred = positive_probability(m.transform(test))
        parts.append(pred.select(F.lit(name).alias("model"), C.KEY, F.col(label).alias("y"), "p"))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return models, long


# ------------------------------------------------------------------ M13
class StackingModel:
    """Base pipelines refit on all training rows + a logistic meta learner
    over their out-of-fold probabilities."""

    def __init__(self, bases: dict[str, PipelineModel], meta: PipelineModel | None = None, oof: DataFrame | None = None):
        self.bases, self.meta, self.oof = bases, meta, oof

    def base_probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p_<name>`` of every base; bases that assemble the same columns share one assembly."""
        scores = ("rawPrediction", "probability", "prediction")
        fronts = [m.stages[0] for m in self.bases.values() if len(m.stages) == 2 and isinstance(m.stages[0], VectorAssembler)]
        front = ("inputCols", "outputCol", "handleInvalid")
        same = len(fronts) == len(self.bases) > 1 and len({str([a.getOrDefault(p) for p in front]) for a in fronts}) == 1
        out = fronts[0].transform(df) if same else df
        for name, m in self.bases.items():
            scored = (m.stages[1] if same else m).transform(out)
            out = positive_probability(scored, f"p_{name}").drop(*scores, *(() if same else ("features",)))
        return out.drop("features") if same else out

    def transform(self, df: DataFrame) -> DataFrame:
        b = self.base_probabilities(df)
        return positive_probability(self.meta.transform(b)).drop("features", "rawPrediction", "probability", "prediction")


def fit_stacking(train: DataFrame, feature_cols: Sequence[str], learners: dict[str, object], k: int = C.KFOLDS,
                 label: str = C.LABEL, seed: int = 42, bases: dict[str, PipelineModel] | None = None, parallelism: int = 4) -> StackingModel:
    """K stratified folds (X3); every base is fit on k-1 folds and scores
    the held-out fold; the out-of-fold probabilities train a
    ``LogisticRegression(maxIter=1000)``; bases are then refit on all rows
    unless they are given.  A fold's rows pass through the fold's models one
    after the other in one scan: no join by key, no row scored twice."""
    from .search import assembled, evenly, in_parallel, levels
    from .split import stratified_folds
    spark = train.sparkSession
    folded = evenly(materialize(stratified_folds(train, k, label=label, seed=seed)))
    rows = assembled(folded, feature_cols, *[c for c in folded.columns if c not in feature_cols])
    jobs = [(n, f) for f in range(k) for n in learners]
    if bases is None:
        jobs += [(n, None) for n in learners]
    jobs.sort(key=lambda j: -levels(learners[j[0]]))  # the longest begin first
    fits = [lambda n=n, f=f: learners[n].fit(rows if f is None else rows.where(F.col("fold") != f)) for n, f in jobs]
    done = {j: PipelineModel([assembler(feature_cols), m]) for j, m in zip(jobs, in_parallel(spark, fits, parallelism), strict=True)}
    oof = None
    for f in range(k):
        part = StackingModel({n: done[n, f] for n in learners}).base_probabilities(folded.where(F.col("fold") == f))
        oof = part if oof is None else oof.unionByName(part)
    pcols = [f"p_{n}" for n in learners]
    oof = materialize(oof.select(C.KEY, label, "fold", *pcols))
    meta = Pipeline(stages=[assembler(pcols), LogisticRegression(labelCol=label, featuresCol="features",
                                                                  maxIter=1000)]).fit(oof)
    return StackingModel(bases or {n: done[n, None] for n in learners}, meta, oof)


# ------------------------------------------------------------------ M17
def feature_importances(models: dict[str, PipelineModel], feature_cols: Sequence[str],
                        spark: SparkSession) -> DataFrame:
    """Tree importances per model (+ mean over models), long form."""
    rows = []
    for name, pm in models.items():
        imp = pm.stages[-1].featureImportances.toArray()
        rows += [(name, f, float(v)) for f, v in zip(feature_cols, imp)]
    df = spark.createDataFrame(rows, "model string, feature string, importance double")
    mean = df.groupBy("feature").agg(F.avg("importance").alias("importance")).withColumn("model", F.lit("mean"))
    return df.unionByName(mean.select("model", "feature", "importance"))


# ------------------------------------------------------------------ M18
def permuted(df: DataFrame, column: str, key: str = C.KEY, seed: int = 7, block: int = 1024) -> DataFrame:
    """A random permutation of one column, built from bounded groups: rows are
    hashed into blocks of about ``block`` rows and, inside a block, each row
    takes the value of the next row in hash order (cyclically).  Marginals are
    preserved and every window group is one block."""
    n = df.count()
    nb = max(1, n // block)
    h = F.xxhash64(F.col(key), F.lit(f"{column}|{seed}"))
    d = df.withColumn("_blk", F.pmod(h, F.lit(nb))).withColumn("_h", h)
    w = Window.partitionBy("_blk").orderBy("_h", key)
    nxt = F.coalesce(F.lead(column).over(w), F.first(column).over(w.rowsBetween(Window.unboundedPreceding,
                                                                                Window.unboundedFollowing)))
    return d.withColumn(column, nxt).drop("_blk", "_h")


def with_permuted(df: DataFrame, columns: Sequence[str], key: str = C.KEY, seed: int = 7, block: int = 1024) -> DataFrame:
    """``df`` with ``_next_<c>`` for every column: its value in the next row of a random order inside blocks of about
    ``block`` rows (cyclic).  One window over one block id serves all columns."""
    nb = max(1, df.count() // block)
    h = F.xxhash64(F.col(key), F.lit(seed))
    d = df.withColumns({"_blk": F.pmod(h, F.lit(nb)), "_h": h})
    w = Window.partitionBy("_blk").orderBy("_h", key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct(*columns)
    d = d.withColumn("_n", F.coalesce(F.lead(row).over(w), F.first(row).over(whole)))
    return d.select(*df.columns, *[F.col(f"_n.{c}").alias(f"_next_{c}") for c in columns])


def permutation_importance(models: dict[str, PipelineModel], df: DataFrame, feature_cols: Sequence[str], label: str = C.LABEL,
                           key: str = C.KEY) -> DataFrame:
    """AUC drop of every model when one feature is permuted: (model, feature, importance, rank), and model ``mean``.

    Every row is scored as it is and once for each feature, the copies being
    made lazily inside the scoring pass, in which all models follow one
    another; ranks go by falling importance (ties: name)."""
    cols = list(feature_cols)
    d = with_permuted(df.select(key, label, *cols), cols, key).withColumn("_f", F.explode(F.sequence(F.lit(-1), F.lit(len(cols) - 1))))
    d = d.select(key, label, "_f", *[F.when(F.col("_f") == i, F.col(f"_next_{c}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(cols)])
    scored = StackingModel(models).base_probabilities(d)
    long = scored.select(F.col(label).alias("y"), "_f", *[F.col(f"p_{n}").alias(n) for n in models]).unpivot(["y", "_f"], list(models), "name", "p")
    a = metrics.auc(long.select(F.concat_ws("|", "_f", "name").alias("model"), "y", "p"))
    cut = F.split("model", r"\|", 2)
    a = materialize(a.select(cut[0].cast("int").alias("_f"), cut[1].alias("model"), "auc"))  # one row a model and feature
    base = a.where(F.col("_f") == -1).select("model", F.col("auc").alias("_base"))
    names = F.array(*[F.lit(c) for c in cols])
    each = a.where(F.col("_f") >= 0).join(F.broadcast(base), "model").select("model", F.get(names, F.col("_f")).alias("feature"),
                                                                         (F.col("_base") - F.col("auc")).alias("importance"))
    both = each.unionByName(each.groupBy("feature").agg(F.avg("importance").alias("importance")).select(F.lit("mean").alias("model"), "feature", "importance"))
    w = Window.partitionBy("model").orderBy(F.col("importance").desc(), "feature")  # one row a feature
    return both.withColumn("rank", F.row_number().over(w))


def linear_attribution(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """M18 (linear part): mean |w_j (x_j - mean x_j)| per feature."""
    cols = list(weights)
    means = df.agg(*[F.avg(c).alias(c) for c in cols])
    j = attach(df.select(*cols), means.select(*[F.col(c).alias(f"__m_{c}") for c in cols]))
    row = j.agg(*[F.avg(F.abs(F.lit(weights[c]) * (F.col(c) - F.col(f"__m_{c}")))).alias(c) for c in cols])
    return row.unpivot([], cols, "feature", "importance")


# ------------------------------------------------------------ S8 / S9
def state_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for persisted state under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/obol-state/{name}-{uuid.uuid4().hex}"


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Persist a fitted table (encoder, thresholds) as Parquet and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> PipelineModel:
    """Persist a pipeline and load it back."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)
