"""Profiles and grouped aggregations.

Single-pass aggregations: statistics over several columns (missing counts,
distinct counts, quartiles) are computed for all of them in one ``agg`` or
one unpivot + ``groupBy``, not one job per column.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.tables import attach
from .cleaning import exact_quantiles, exact_quantiles_multi


def label_distribution(df: DataFrame, label: str = C.LABEL, by: str | None = "split") -> DataFrame:
    """N, defaults, rate (per split when given)."""
    g = df.groupBy(by) if by else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("defaults"),
                 F.avg(F.col(label).cast("double")).alias("default_rate"))


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count per column in one pass, as (column, n_missing, missing_rate)."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    return row.unpivot(["__n"], cols, "column", "n_missing").select(
        "column", "n_missing", (F.col("n_missing") / F.col("__n")).alias("missing_rate"))


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column (exact; ``approx`` uses HLL++)."""
    f = F.approx_count_distinct if approx else F.count_distinct
    row = df.agg(*[f(F.col(c)).alias(c) for c in cols])
    return row.unpivot([], list(cols), "column", "n_distinct")


def quartiles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A16 fit: exact linear Q1/Q3 per column -> (column, q1, q3)."""
    q = exact_quantiles_multi(df, cols, [0.25, 0.75])
    return q.groupBy("column").agg(F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"),
                                   F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"))


def outlier_flags(df: DataFrame, cols: Sequence[str] = C.OUTLIER_COLUMNS,
                  k: float = C.OUTLIER_IQR_MULTIPLIER) -> DataFrame:
    """``<col>_outlier`` = outside [Q1 - k IQR, Q3 + k IQR] (broadcast of one stats row)."""
    q = quartiles(df, cols)
    wide = q.groupBy().pivot("column", list(cols)).agg(F.first("q1").alias("q1"), F.first("q3").alias("q3"))
    out = attach(df, wide)
    for c in cols:
        q1, q3 = F.col(f"{c}_q1"), F.col(f"{c}_q3")
        iqr = q3 - q1
        out = out.withColumn(f"{c}_outlier", ((F.col(c) < q1 - k * iqr) | (F.col(c) > q3 + k * iqr)).cast("int"))
    return out.drop(*[f"{c}_q1" for c in cols], *[f"{c}_q3" for c in cols])


def quantile_bins(df: DataFrame, column: str, labels: Sequence[str], out: str) -> DataFrame:
    """Equal-frequency bins on exact linear quantile edges, right-closed,
    the first bin closed on both sides (ties always share a bin)."""
    k = len(labels)
    edges = exact_quantiles(df.select(column), column, [i / k for i in range(k + 1)])
    wide = edges.groupBy().pivot("q", [i / k for i in range(k + 1)]).agg(F.first("value"))
    names = wide.columns
    wide = wide.toDF(*[f"__e{i}" for i in range(len(names))])
    j = attach(df, wide)
    x = F.col(column)
    expr = F.lit(None).cast("string")
    for i in reversed(range(k)):
        lo, hi = F.col(f"__e{i}"), F.col(f"__e{i + 1}")
        cond = ((x >= lo) if i == 0 else (x > lo)) & (x <= hi)
        expr = F.when(cond, F.lit(labels[i])).otherwise(expr)
    return j.withColumn(out, expr).drop(*[f"__e{i}" for i in range(k + 1)])


def group_rate(df: DataFrame, keys: Sequence[str], label: str, prefix: str = "group") -> DataFrame:
    """Default rate and size per key group, merged back on the keys."""
    stats = df.groupBy(*keys).agg(F.avg(F.col(label).cast("double")).alias(f"{prefix}_default_rate"),
                                  F.count(F.lit(1)).alias(f"{prefix}_size"))
    return df.join(stats, list(keys), "left")


def feature_category(name_col) -> F.Column:
    """Ordered category rules over a feature name (first match wins)."""
    n = F.lower(F.col(name_col) if isinstance(name_col, str) else name_col)
    expr = F.lit(C.OTHER_CATEGORY)
    for cat, frags in reversed(C.FEATURE_CATEGORIES):
        cond = None
        for f in frags:
            c = n.contains(f)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(cat)).otherwise(expr)
    return expr


def importance_rollup(imp: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    """Importance summed/counted/averaged per feature category."""
    return imp.withColumn("category", feature_category(feature)).groupBy("category").agg(
        F.sum(value).alias("total_importance"), F.count(F.lit(1)).alias("n_features"),
        F.avg(value).alias("avg_importance"))


def rank_features(imp: DataFrame, feature: str = "feature", value: str = "importance",
                  per_category_top: int | None = None) -> DataFrame:
    """rank = number of features with importance >= this one (competition
    rank); optional top-k per category.  Importance tables have one row per
    feature (bounded by the schema)."""
    out = imp.withColumn("rank", F.rank().over(Window.orderBy(F.col(value).desc())))
    if per_category_top:
        out = out.withColumn("category", feature_category(feature)).withColumn(
            "category_rank", F.row_number().over(Window.partitionBy("category").orderBy(F.col(value).desc(), F.col(feature))))
        out = out.where(F.col("category_rank") <= per_category_top)
    return out


def time_range(df: DataFrame, date_col: str = C.DATE) -> DataFrame:
    """Min, max, count of valid dates and span in days."""
    d = F.col(date_col).cast("date")
    return df.where(d.isNotNull()).agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"),
                                       F.count(F.lit(1)).alias("total_samples")).withColumn(
        "date_range_days", F.datediff("max_date", "min_date"))


def dataset_info(split_df: DataFrame, label: str = C.LABEL, n_categorical: int = 0, n_numeric: int = 0) -> DataFrame:
    """Totals, split sizes, feature counts and default rate in one row."""
    return split_df.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count(F.when(F.col("split") == "train", 1)).alias("train_samples"),
        F.count(F.when(F.col("split") == "val", 1)).alias("val_samples"),
        F.count(F.when(F.col("split") == "test", 1)).alias("test_samples"),
        F.avg(F.col(label).cast("double")).alias("default_rate"),
    ).withColumns({"n_categorical": F.lit(n_categorical), "n_numeric": F.lit(n_numeric),
                   "n_features": F.lit(n_categorical + n_numeric)})


def experiment_record(split_df: DataFrame, experiment_id: str, model_name: str, date_col: str = C.DATE,
                      metrics: DataFrame | None = None, features_used: Sequence[str] | None = None,
                      dataset_version: str | None = None) -> DataFrame:
    """One row: per-split sample counts and date periods, dataset
    version, features used (array) and metrics (map from a long metrics
    table: a handful of rows)."""
    d = F.col(date_col).cast("date")
    per = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(d).alias("start"), F.max(d).alias("end"))
    splits = ["train", "val", "test"]
    wide = per.groupBy().pivot("split", splits).agg(F.first("n").alias("samples"), F.first("start").alias("period_start"),
                                                    F.first("end").alias("period_end"))
    rec = wide.select(
        F.lit(experiment_id).alias("experiment_id"), F.lit(model_name).alias("model_name"),
        *[F.coalesce(F.col(f"{s}_samples"), F.lit(0)).cast("bigint").alias(f"{s}_samples") for s in splits],
        *[F.col(f"{s}_period_{e}").alias(f"{s}_period_{e}") for s in splits for e in ("start", "end")])
    if dataset_version is not None:
        rec = rec.withColumn("dataset_version", F.lit(dataset_version))
    if features_used is not None:
        rec = rec.withColumn("features_used", F.array(*[F.lit(f) for f in features_used]))
    if metrics is not None:
        m = metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
        rec = attach(rec, m)
    return rec


def enrich(left, right, left_key: str, right_key: str, source: str = "crm"):
    """Left join of an enrichment source by key, plus the match-rate
    report ``(source, total, matched, match_rate)`` over the left rows."""
    r = right.withColumn("__matched", F.lit(1))
    j = left.join(r, left[left_key] == r[right_key], "left")
    report = j.agg(F.count(F.lit(1)).alias("total"), F.count("__matched").alias("matched")).select(
        F.lit(source).alias("source"), "total", "matched", (F.col("matched") / F.col("total")).alias("match_rate"))
    return j.drop("__matched"), report
