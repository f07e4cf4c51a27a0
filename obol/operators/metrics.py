"""Evaluation metrics, threshold search and model comparison
(SURVEY §2.12 M6-M12, M14, M19; §2.7 T4; R14; D9).

Everything reduces to counts over distinct scores, which are cumulated with
the skew-safe running helper; no metric gathers the scores on one task or on
the driver.  Inputs are long frames ``(model, y, p)``; a frame without a
``model`` column is one model.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.tables import attach
from ..session import materialize
from .running import running

EPS = 2.220446049250313e-16  # float64 machine epsilon (log-loss clip)


def _with_model(df: DataFrame, model: str | None) -> DataFrame:
    return df if "model" in df.columns else df.withColumn("model", F.lit(model or "model"))


def score_counts(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(model, p, pos, neg) per distinct score; partial aggregation absorbs ties."""
    d = _with_model(df, None)
    return d.groupBy("model", F.col(p).alias("p")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum((1 - F.col(y)).cast("long")).alias("neg"))


# ------------------------------------------------------------------ AUC
def auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """ROC AUC with tied scores averaged (Mann-Whitney).

    The counts are cut from their lineage: ``running`` reads them twice, and what they come from may be a scoring pass."""
    sc = materialize(score_counts(df, y, p))
    r = running(sc, ["model"], ["p"], sums=["neg"])
    contrib = F.col("pos") * (F.coalesce(F.col("_cum_neg"), F.lit(0)) + F.col("neg") * 0.5)
    a = r.groupBy("model").agg(F.sum(contrib).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return a.select("model", F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                    F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc"))


def average_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Area under the precision-recall curve (step-wise average precision)."""
    sc = score_counts(df, y, p).withColumn("_np", -F.col("p")).withColumn("_pp", F.col("pos") + F.col("neg"))
    r = running(sc, ["model"], ["_np"], sums=["pos", "_pp"])
    tp = F.coalesce(F.col("_cum_pos"), F.lit(0)) + F.col("pos")
    pp = F.coalesce(F.col("_cum__pp"), F.lit(0)) + F.col("_pp")
    a = r.groupBy("model").agg(F.sum(F.col("pos") * (tp / pp)).alias("_s"), F.sum("pos").alias("_P"))
    return a.select("model", F.when(F.col("_P") > 0, F.col("_s") / F.col("_P")).alias("auc_pr"))


# ---------------------------------------------------- point metrics at t
def _counts_at(df: DataFrame, t: Column, y: str, p: str) -> DataFrame:
    d = _with_model(df, None)
    hat = (F.col(p) >= t)
    yy = F.col(y) == 1
    return d.groupBy("model").agg(
        F.count(F.when(hat & yy, 1)).alias("tp"), F.count(F.when(hat & ~yy, 1)).alias("fp"),
        F.count(F.when(~hat & yy, 1)).alias("fn"), F.count(F.when(~hat & ~yy, 1)).alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def point_metrics_from_counts(c: DataFrame) -> DataFrame:
    """M7: accuracy, precision, recall, F1, F2 from confusion counts (0 when undefined)."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    pos, pp = tp + fn, tp + fp
    b2 = C.F_BETA ** 2
    return c.withColumns({
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "precision": _ratio(tp, pp),
        "recall": _ratio(tp, pos),
        "f1": _ratio(2.0 * tp, pos + pp),
        "f2": _ratio((1 + b2) * tp, b2 * pos + pp),
    })


def point_metrics(df: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """M7 at a fixed threshold."""
    return point_metrics_from_counts(_counts_at(df, F.lit(threshold), y, p))


def log_loss(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """M8: mean negative log likelihood with p clipped to [eps, 1 - eps]."""
    d = _with_model(df, None)
    q = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    ll = F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q)
    return d.groupBy("model").agg((-F.avg(ll)).alias("log_loss"))


def brier(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Brier score."""
    d = _with_model(df, None)
    return d.groupBy("model").agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def confusion(df: DataFrame, thresholds: Mapping[str, float] | DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """M9: (model, threshold_name, actual, predicted, n) with every cell present.

    The counts of each distinct probability and the thresholds are put in one
    order; what lies before a threshold is predicted 0.  One pass for any
    number of thresholds, none of which reaches the driver."""
    d = _with_model(df, None)
    if not isinstance(thresholds, DataFrame):
        thresholds = df.sparkSession.createDataFrame([(k, float(v)) for k, v in thresholds.items()], "threshold_name string, t double")
    yy = F.col(y).cast("int")
    counts = d.where(F.col(p).isNotNull()).groupBy("model", F.col(p).cast("double").alias("_p")).agg(
        F.count(F.when(yy == 1, 1)).alias("_one"), F.count(F.when(yy == 0, 1)).alias("_zero"))
    totals = d.where(F.col(p).isNotNull()).groupBy("model").agg(F.count(F.when(yy == 1, 1)).alias("_ones"), F.count(F.when(yy == 0, 1)).alias("_zeros"))
    named = thresholds.select("threshold_name", F.col("t").cast("double").alias("_p"))
    # one probe a model and threshold; a probe stands before equal probabilities
    probes = named.crossJoin(F.broadcast(d.select("model").distinct()))  # one row a model
    none = F.lit(0).cast("long")
    both = counts.select("model", "_p", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("threshold_name"), "_one", "_zero") \
        .unionByName(probes.select("model", "_p", F.lit(0).alias("_kind"), "threshold_name", none.alias("_one"), none.alias("_zero")))
    before = running(both, ["model"], ["_p", "_kind", "threshold_name"], sums=["_one", "_zero"]).where("_kind = 0") \
        .select("model", "threshold_name", F.coalesce("_cum__one", none).alias("_fn"), F.coalesce("_cum__zero", none).alias("_tn"))
    wide = before.join(totals, "model", "left")
    cell = lambda a, b, n: F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), n.alias("n"))
    fn, tn = F.col("_fn"), F.col("_tn")
    ones, zeros = F.coalesce("_ones", none), F.coalesce("_zeros", none)
    return wide.select("model", "threshold_name", F.explode(F.array(cell(0, 0, tn), cell(0, 1, zeros - tn), cell(1, 0, fn), cell(1, 1, ones - fn)))
                       .alias("cell")).select("model", "threshold_name", "cell.*")


def class_report(df: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages."""
    c = _counts_at(df, F.lit(threshold), y, p)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    def cls(name, tp_, fp_, fn_):
        return c.select("model", F.lit(name).alias("label"), _ratio(tp_, tp_ + fp_).alias("precision"),
                        _ratio(tp_, tp_ + fn_).alias("recall"), _ratio(2.0 * tp_, 2 * tp_ + fp_ + fn_).alias("f1"),
                        (tp_ + fn_).alias("support"))
    per = cls("0", tn, fn, fp).unionByName(cls("1", tp, fp, fn))
    macro = per.groupBy("model").agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                                     F.sum("support").alias("support"))
    w = F.col("support") / F.sum("support").over(Window.partitionBy("model"))
    weighted = per.withColumn("_w", w).groupBy("model").agg(
        F.lit("weighted avg").alias("label"), F.sum(F.col("precision") * F.col("_w")).alias("precision"),
        F.sum(F.col("recall") * F.col("_w")).alias("recall"), F.sum(F.col("f1") * F.col("_w")).alias("f1"),
        F.sum("support").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


# --------------------------------------------------------- threshold search
def threshold_value(i: Column) -> Column:
    """i-th grid threshold, computed like numpy's arange fill: start + i * delta."""
    start = C.THRESHOLD_START
    delta = (start + C.THRESHOLD_STEP) - start
    return F.lit(start) + i.cast("double") * F.lit(delta)


def threshold_grid(spark: SparkSession) -> DataFrame:
    return spark.range(C.THRESHOLD_COUNT).select(F.col("id").cast("int").alias("i")).withColumn(
        "threshold", threshold_value(F.col("i")))


def _grid_index(p: Column) -> Column:
    """Number of grid thresholds <= p, minus one (-1 below the grid), exact."""
    start = C.THRESHOLD_START
    delta = (start + C.THRESHOLD_STEP) - start
    n = C.THRESHOLD_COUNT
    guess = F.least(F.greatest(F.floor((p - F.lit(start)) / F.lit(delta)), F.lit(-1)), F.lit(n - 1)).cast("int")
    up = F.when((guess + 1 < n) & (threshold_value(guess + 1) <= p), 1).otherwise(0)
    down = F.when((guess >= 0) & (threshold_value(guess) > p), 1).otherwise(0)
    return guess + up - down


def threshold_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """M11 curve: one pass buckets every row by its grid index, then reverse
    cumulative sums over at most 81 buckets give TP / predicted-positive
    counts at all 80 thresholds."""
    d = _with_model(df, None)
    b = d.groupBy("model", _grid_index(F.col(p)).alias("idx")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("cnt"))
    totals = b.groupBy("model").agg(F.sum("pos").alias("P"), F.sum("cnt").alias("N"))
    # the 80 grid thresholds of every model: one row per model, exploded
    grid = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(C.THRESHOLD_COUNT - 1)))).withColumn(
        "threshold", threshold_value(F.col("i")))
    # bounded: (#models x 80) grid rows against (#models x 81) bucket rows
    j = grid.join(F.broadcast(b.withColumnRenamed("model", "_m")),
                  (F.col("_m") == F.col("model")) & (F.col("idx") >= F.col("i")), "left")
    c = j.groupBy("model", "i", "threshold", "P", "N").agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("pp"))
    c = c.withColumns({"fp": F.col("pp") - F.col("tp"), "fn": F.col("P") - F.col("tp")})
    c = c.withColumn("tn", F.col("N") - F.col("tp") - F.col("fp") - F.col("fn"))
    return point_metrics_from_counts(c).withColumn(
        "balanced", (F.col("precision") + F.col("recall")) / 2)


def optimal_threshold(df: DataFrame, metric: str = "f2", y: str = "y", p: str = "p") -> DataFrame:
    """First grid threshold with the highest score, and the metrics
    at that threshold (one row per model)."""
    curve = threshold_curve(df, y, p)
    w = Window.partitionBy("model").orderBy(F.col(metric).desc(), F.col("i"))
    best = curve.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)  # <= 80 rows per model
    return best.select("model", "threshold", F.col(metric).alias("score"), "accuracy", "precision", "recall",
                       "f1", "f2", "tp", "pp", "P")


# ----------------------------------------------------------- comparisons
def soft_vote(df: DataFrame, prob_cols: Sequence[str], weights: Sequence[float] | None = None,
              out: str = "p_vote") -> DataFrame:
    """(weighted) average of model probabilities."""
    w = list(weights) if weights else [1.0] * len(prob_cols)
    tot = float(sum(w))
    expr = sum((F.col(c) * F.lit(wi) for c, wi in zip(prob_cols, w)), F.lit(0.0)) / tot
    return df.withColumn(out, expr)


def model_metrics(df: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """One row per model: auc, accuracy, precision, recall, f1, log loss."""
    pm = point_metrics(df, threshold, y, p).select("model", "accuracy", "precision", "recall", "f1")
    # one row per model on every side (broadcast: bounded by the model count)
    return auc(df, y, p).join(F.broadcast(pm), "model").join(F.broadcast(log_loss(df, y, p)), "model")


def metrics_long(metrics: DataFrame, split: str = "test") -> DataFrame:
    """Long metrics table (model, split, metric, value)."""
    cols = [c for c in metrics.columns if c != "model"]
    return metrics.select("model", *[F.col(c).cast("double") for c in cols]).unpivot(
        ["model"], cols, "metric", "value").withColumn("split", F.lit(split))


def best_model(metrics: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """Arg-max AUC (ties -> earlier in ``priority``, then name) and the
    recommendation text by AUC cut."""
    pr = {m: i for i, m in enumerate(priority)}
    prio = F.lit(len(pr))
    for m, i in pr.items():
        prio = F.when(F.col("model") == m, F.lit(i)).otherwise(prio)
    ranked = metrics.withColumn("_prio", prio)
    best = ranked.agg(F.min_by(F.struct("model", "auc"), F.struct(-F.col("auc"), F.col("_prio"), F.col("model"))).alias("b"))
    a = F.col("b.auc")
    txt = C.REPORT_TEXT
    rec = F.when(a >= C.REPORT_AUC_GOOD, txt[0]).when(a >= C.REPORT_AUC_FAIR, txt[1]).otherwise(txt[2])
    return best.select(F.col("b.model").alias("best_model"), a.alias("best_auc"), rec.alias("recommendation"))


def recommend(optimal: DataFrame, metrics: DataFrame, preferred: str = "Stacking") -> DataFrame:
    """Recommended model/threshold: the preferred (stacking) model if
    present, else the best model by AUC."""
    b = best_model(metrics)
    j = attach(optimal, b)
    pick = F.when(F.col("model") == preferred, 0).when(F.col("model") == F.col("best_model"), 1).otherwise(2)
    w = Window.orderBy(pick, F.col("model"))  # one row per model: bounded
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        F.col("model").alias("recommended_model"), F.col("threshold").alias("recommended_threshold"))
