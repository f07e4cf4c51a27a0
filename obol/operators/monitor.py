"""Rules declared in configuration/docs without code behind them
(SURVEY §2.15 D1-D8), built as plain aggregations and projections."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.tables import attach
from .profile import quartiles


def provision_tier(p) -> tuple[F.Column, F.Column, F.Column, F.Column]:
    """(tier, action, review frequency, provision rate) by default probability."""
    x = F.col(p) if isinstance(p, str) else p
    tiers = C.PROVISION_TIERS
    last = tiers[-1]
    outs = [F.lit(last[1]), F.lit(last[2]), F.lit(last[3]), F.lit(last[4])]
    for bound, tier, action, review, rate in reversed(tiers[:-1]):
        cond = x < bound
        outs = [F.when(cond, F.lit(v)).otherwise(o) for v, o in zip((tier, action, review, rate), outs)]
    return tuple(outs)


def provisions(df: DataFrame, p: str, exposure: str) -> DataFrame:
    """Per tier count, exposure and provision = sum(exposure * rate)."""
    tier, action, review, rate = provision_tier(p)
    t = df.withColumns({"tier": tier, "portfolio_action": action, "review_frequency": review, "provision_rate": rate})
    return t.groupBy("tier", "portfolio_action", "review_frequency", "provision_rate").agg(
        F.count(F.lit(1)).alias("n"), F.sum(exposure).alias("exposure"),
        F.sum(F.col(exposure) * F.col("provision_rate")).alias("provision"))


def feature_screen(df: DataFrame, cols: Sequence[str], var_min: float = C.VARIANCE_MIN,
                   corr_max: float = C.CORRELATION_MAX) -> tuple[DataFrame, DataFrame]:
    """One pass of ``var_samp`` per column and ``corr`` per pair.
    Returns (variance table with low-variance flag, correlated pairs above the cut)."""
    row = df.agg(*[F.var_samp(c).alias(f"v__{c}") for c in cols],
                 *[F.corr(a, b).alias(f"c__{a}__{b}") for a, b in combinations(cols, 2)])
    var = row.unpivot([], [f"v__{c}" for c in cols], "k", "variance").select(
        F.regexp_replace("k", "^v__", "").alias("feature"), "variance",
        (F.coalesce(F.col("variance"), F.lit(0.0)) < var_min).cast("int").alias("low_variance"))
    pairs = [f"c__{a}__{b}" for a, b in combinations(cols, 2)]
    cor = row.unpivot([], pairs, "k", "corr").select(
        F.split("k", "__").getItem(1).alias("feature_a"), F.split("k", "__").getItem(2).alias("feature_b"), "corr"
    ).where(F.abs("corr") > corr_max)
    return var, cor


def correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Correlation matrix from one Gram matrix: each task sums the outer products of its rows, only sums are shuffled.

    Columns are shifted by their means first, which keeps the sums exact
    enough; a null or NaN counts as the column's mean.  The result is one
    number per pair of columns; a constant column has no correlation (0)."""
    num = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols]
    d = df.select(*num)
    m = d.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cols]).first()  # one row
    centred = d.select(F.array(*[F.coalesce(F.col(c) - F.lit(m[c]), F.lit(0.0)) for c in cols]).alias("x"))
    width = len(cols)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width), pa.int32()),
                                          pa.array(np.tile(np.arange(width), width), pa.int32()), pa.array(total.reshape(-1))], names=["i", "j", "s"])

    out = np.zeros((width, width))
    for r in centred.mapInArrow(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # one row a pair
        out[r["i"], r["j"]] = r["s"]
    size = np.sqrt(np.diag(out))
    return np.divide(out, np.outer(size, size), out=np.zeros_like(out), where=np.outer(size, size) > 0)


def feature_selection(df: DataFrame, cols: Sequence[str], var_min: float = C.VARIANCE_MIN, corr_max: float = C.CORRELATION_MAX,
                      most: int = C.MAX_FEATURES) -> DataFrame:
    """Which features stay: (position, feature, variance, kept, reason, partner).

    Features are tried in the order given (put the better ones first).  One is
    dropped for ``variance`` (below ``var_min``), for ``correlation`` (beyond
    ``corr_max`` with a feature kept before; the first such is ``partner``) or
    for the ``limit`` once ``most`` are kept; so the kept ones are the greedy
    independent set of the correlation graph in that order."""
    row = df.agg(*[F.var_samp(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c) for c in cols]).first()
    corr = correlations(df, cols)
    kept: list[int] = []
    out = []
    for i, c in enumerate(cols):
        v = 0.0 if row[c] is None else float(row[c])
        near = [j for j in kept if abs(corr[i, j]) > corr_max]
        reason = "variance" if v < var_min else "correlation" if near else "limit" if len(kept) >= most else None
        if reason is None:
            kept.append(i)
        out.append((i + 1, c, v, int(reason is None), reason, cols[near[0]] if reason == "correlation" else None))
    return df.sparkSession.createDataFrame(out, "position int, feature string, variance double, kept int, reason string, partner string")


def cap_outliers(df: DataFrame, cols: Sequence[str], method: str = "iqr",
                 k: float = C.OUTLIER_IQR_MULTIPLIER, z: float = C.ZSCORE_THRESHOLD) -> DataFrame:
    """D3: cap to [Q1 - k IQR, Q3 + k IQR] (``iqr``) or mean +- z std (``zscore``)."""
    if method == "iqr":
        q = quartiles(df, cols)
        lo, hi = F.col("q1") - k * (F.col("q3") - F.col("q1")), F.col("q3") + k * (F.col("q3") - F.col("q1"))
        b = q.select("column", lo.alias("lo"), hi.alias("hi"))
    else:
        row = df.agg(*[F.avg(c).alias(f"m__{c}") for c in cols], *[F.stddev_samp(c).alias(f"s__{c}") for c in cols])
        parts = [row.select(F.lit(c).alias("column"), (F.col(f"m__{c}") - z * F.col(f"s__{c}")).alias("lo"),
                            (F.col(f"m__{c}") + z * F.col(f"s__{c}")).alias("hi")) for c in cols]
        b = parts[0]
        for p in parts[1:]:
            b = b.unionByName(p)
    wide = b.groupBy().pivot("column", list(cols)).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    out = attach(df, wide)
    for c in cols:
        out = out.withColumn(c, F.least(F.greatest(F.col(c), F.col(f"{c}_lo")), F.col(f"{c}_hi")))
    return out.drop(*[f"{c}_{s}" for c in cols for s in ("lo", "hi")])


def data_quality(df: DataFrame, label: str, date_col: str, cols: Sequence[str]) -> DataFrame:
    """Rule results as (check, subject, value, passed)."""
    n = F.count(F.lit(1))
    miss = df.agg(n.alias("__n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).unpivot(
        ["__n"], list(cols), "subject", "n_missing").withColumn("rate", F.col("n_missing") / F.col("__n"))
    drop = miss.select(F.lit("drop_column_missing_gt_50pct").alias("check"), "subject",
                       F.col("rate").alias("value"), (F.col("rate") <= C.MAX_MISSING_DROP).cast("int").alias("passed"))
    alert = miss.select(F.lit("missing_alert_gt_10pct").alias("check"), "subject",
                        F.col("rate").alias("value"), (F.col("rate") <= C.MISSING_ALERT).cast("int").alias("passed"))
    tot = df.agg(n.alias("n"), F.avg(F.col(label).cast("double")).alias("pos"))
    rows = tot.select(F.lit("min_rows").alias("check"), F.lit("table").alias("subject"),
                      F.col("n").cast("double").alias("value"), (F.col("n") >= C.MIN_ROWS).cast("int").alias("passed"))
    pos = tot.select(F.lit("min_positive_share").alias("check"), F.lit(label).alias("subject"),
                     F.col("pos").alias("value"), (F.col("pos") >= C.MIN_POSITIVE_SHARE).cast("int").alias("passed"))
    per_year = df.groupBy(F.year(F.col(date_col).cast("date")).cast("string").alias("subject")).agg(n.alias("n")).select(
        F.lit("min_rows_per_year").alias("check"), "subject", F.col("n").cast("double").alias("value"),
        (F.col("n") >= C.MIN_ROWS_PER_YEAR).cast("int").alias("passed"))
    return drop.unionByName(alert).unionByName(rows).unionByName(pos).unionByName(per_year)


def psi(expected: DataFrame, actual: DataFrame, p: str, bins: int = 10) -> DataFrame:
    """D5 drift: population stability index over fixed equal-width score bins,
    shares floored at 1e-4."""
    def shares(df, name):
        b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
        c = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        # at most ``bins`` rows: a global window over them is bounded
        return c.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy())).select("bin", name)
    e, a = shares(expected, "e"), shares(actual, "a")
    j = e.join(a, "bin", "full").select(F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(1e-4)).alias("e"),
                                        F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(1e-4)).alias("a"))
    return j.agg(F.sum((F.col("a") - F.col("e")) * F.ln(F.col("a") / F.col("e"))).alias("psi"))


def monitoring_alerts(metrics: DataFrame, base_rate: DataFrame, cur_rate: DataFrame, drift: DataFrame) -> DataFrame:
    """Alerts from a one-row metrics table, default-rate deviation and drift."""
    j = attach(attach(attach(metrics, base_rate.select(F.col("default_rate").alias("base_rate"))),
                      cur_rate.select(F.col("default_rate").alias("cur_rate"))), drift)
    return j.select(
        (F.col("auc") < C.MONITOR_MIN_AUC).cast("int").alias("alert_auc"),
        (F.col("accuracy") < C.MONITOR_MIN_ACCURACY).cast("int").alias("alert_accuracy"),
        (F.col("log_loss") > C.MONITOR_MAX_LOG_LOSS).cast("int").alias("alert_log_loss"),
        (F.abs(F.col("cur_rate") - F.col("base_rate")) > C.MONITOR_RATE_DEVIATION).cast("int").alias("alert_default_rate"),
        (F.col("psi") > C.MONITOR_DRIFT).cast("int").alias("alert_drift"))


def auto_decision(df: DataFrame) -> DataFrame:
    """Auto-reject (DTI above 0.6, six or more late payments, no credit
    history, a bankruptcy within 2 or a foreclosure within 3 years) and
    conditional approval (high income, excellent payment rate, low
    utilisation, two years in the job) over the client schema.

    ``years_since_bankruptcy``, ``years_since_foreclosure`` (null: none) and
    ``employment_months`` are used where the table has them."""
    c = F.col
    reject = (c("debt_to_income_ratio") > C.AUTO_REJECT_DTI) | (c("late_payments_count") >= C.AUTO_REJECT_CONSECUTIVE_LATE) \
        | (F.coalesce(c("credit_history_months"), F.lit(0)) == 0)
    for name, years in (("years_since_bankruptcy", C.AUTO_REJECT_BANKRUPTCY_YEARS), ("years_since_foreclosure", C.AUTO_REJECT_FORECLOSURE_YEARS)):
        if name in df.columns:
            reject = reject | F.coalesce(c(name) <= years, F.lit(False))
    cond_ok = (c("annual_income") >= C.COND_HIGH_INCOME) | (c("on_time_payment_rate") >= C.COND_PAYMENT_RATE) \
        | (c("credit_utilization_rate") < C.COND_LOW_UTILIZATION)
    if "employment_months" in df.columns:
        cond_ok = cond_ok | F.coalesce(c("employment_months") >= C.COND_STABLE_EMPLOYMENT_MONTHS, F.lit(False))
    base_fail = (c("late_payments_count") > C.MAX_LATE_PAYMENTS) | (c("missed_payments_count") > C.MAX_MISSED_PAYMENTS)
    decision = F.when(reject, "reject").when(base_fail & cond_ok, "conditional").when(base_fail, "review").otherwise("approve")
    return df.withColumn("decision", decision)


def temporal_features(df: DataFrame, date_col: str = C.DATE, as_of: str | None = None) -> DataFrame:
    """Year, month, quarter, day of year, days/months since application
    (relative to ``as_of`` or the table's max date, broadcast as one row)."""
    d = F.col(date_col).cast("date")
    ref = (df.sparkSession.createDataFrame([(as_of,)], "r string").select(F.col("r").cast("date").alias("__ref"))
           if as_of else df.agg(F.max(d).alias("__ref")))
    out = attach(df, ref)
    return out.withColumns({
        "year": F.year(d), "month": F.month(d), "quarter": F.quarter(d), "day_of_year": F.dayofyear(d),
        "days_since_application": F.datediff("__ref", d),
        "months_since_application": F.floor(F.months_between("__ref", d)).cast("int"),
    }).drop("__ref")


def business_metrics(scored: DataFrame, label: str, band: str = "risk_grade", approve: str = "predicted_default_optimal") -> DataFrame:
    """Per score band: n, approval rate (not flagged), default rate."""
    return scored.groupBy(band).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(approve) == 0).cast("double")).alias("approval_rate"),
        F.avg(F.col(label).cast("double")).alias("default_rate"))
