"""Row-local features: repayment/stability ratios (P15-P20), client-table
features (P28-P31), and the overdue-series features (SURVEY §2.3 O1-O18).

All are single projections; the overdue features are built from whichever of
the eight period columns exist (O17) and stay inside whole-stage codegen.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.columns import (acceleration, clip, count_positive, ema, flag, longest_positive_run, mean,
                                 parse_number, payment_progress, safe_clip, sample_std, total)
from ..session import stored
from .cleaning import existing

#: Long rows of overdue series in one partition.
LONG_ROWS = 1_000_000


# --------------------------------------------------------------- loan table
def repayment_features(df: DataFrame, stable_codes: Sequence[str] = C.STABLE_RESIDENCE) -> DataFrame:
    """Payment progress, job stability, address match, residence
    stability, clipped DTI and payment pressure."""
    cols = {
        "payment_progress_ratio": payment_progress("paid_installments", "loan_term"),
        "job_stable": flag(F.col("job_tenure") >= 1),
        "address_match": flag(F.col("post_perm") == F.col("post_res")),
        "residence_stable": flag(F.col("residence_status").isin(list(stable_codes))),
    }
    types = dict(df.dtypes)

    def num(c):  # strings are coerced (P9); numeric columns are used as they are
        return F.col(c).cast("double") if types[c] != "string" else c

    if "debt_to_income_ratio" in df.columns:
        cols["dti_ratio"] = safe_clip(num("debt_to_income_ratio"), *C.DTI_CLIP)
    if "payment_to_income_ratio" in df.columns:
        cols["payment_pressure"] = safe_clip(num("payment_to_income_ratio"), *C.PTI_CLIP)
    return df.withColumns(cols)


def upstream_ratios(df: DataFrame, loan="loan_amount", payment="monthly_payment",
                    month_salary="month_salary") -> DataFrame:
    """P20: annual salary, DTI (cap 100), PTI (cap 10) and income level bands."""
    annual = F.col(month_salary) * 12
    income_10k = annual / 10000.0
    return df.withColumns({
        "annual_salary": annual,
        "dti_upstream": F.least(F.try_divide(F.col(loan), annual), F.lit(100.0)),
        "pti_upstream": F.least(F.try_divide(F.col(payment), F.col(month_salary)), F.lit(10.0)),
        "income_level": F.when(income_10k.isNull(), F.lit(None))
        .when(income_10k < 3, "<3").when(income_10k < 5, "3-5").when(income_10k < 8, "5-8").otherwise(">8"),
    })


# ------------------------------------------------------------ overdue series
def overdue_features(df: DataFrame, cols: Sequence[str] = C.OVERDUE_COLS) -> DataFrame:
    """O1-O17 from the period columns that exist; none -> frame unchanged."""
    have = existing(df, cols)
    if not have:
        return df
    early, late = existing(df, C.EARLY), existing(df, C.LATE)
    critical, warning = existing(df, C.CRITICAL), existing(df, C.WARNING)
    out: dict[str, object] = {}
    if early:
        out["early_overdue_count"] = total(early)
    if late:
        out["late_overdue_count"] = total(late)
    if early and late:
        out["overdue_trend"] = total(late) - total(early)
        out["overdue_worsening"] = flag(total(late) - total(early) > 0)
    out["max_overdue_in_month"] = F.greatest(*[F.col(c) for c in have]) if len(have) > 1 else F.col(have[0])
    std = sample_std(have)
    out["overdue_std"] = F.coalesce(std, F.lit(0.0))
    if len(have) > 1:
        out["overdue_consistency"] = flag(F.greatest(*[F.col(c) for c in have]) == F.least(*[F.col(c) for c in have]))
    else:
        out["overdue_consistency"] = F.lit(1)
    out["overdue_frequency"] = count_positive(have)
    out["overdue_freq_ratio"] = count_positive(have) / float(len(have))
    if late:
        out["recent_overdue_severity"] = mean(late)
    out["max_consecutive_overdue"] = longest_positive_run(have)
    out["total_overdue_count"] = total(have)
    out["has_overdue"] = flag(total(have) > 0)
    out["overdue_acceleration"] = acceleration(have)
    if len(critical) >= 2:
        out["critical_period_overdue"] = total(critical)
    if len(late) >= 2:
        out["late_stage_persistence"] = count_positive(late)
        out["late_stage_persistent_flag"] = flag(count_positive(late) >= C.LATE_PERSIST_MIN)
    if early and late:
        out["overdue_recovery"] = total(early) - total(late)
        out["overdue_improving"] = flag(total(early) - total(late) > 0)
    if len(warning) >= 2:
        out["early_warning_score"] = total(warning)
        out["early_warning_flag"] = flag(total(warning) >= C.EARLY_WARNING_MIN)
    w = C.ROLLING_WINDOW
    out["rolling_3m_overdue_avg"] = mean(have[-w:]) if len(have) >= w else F.col(have[-1]).cast("double")
    out["ema_overdue"] = ema(have)
    return df.withColumns(out)


OVERDUE_FEATURES = [
    "early_overdue_count", "late_overdue_count", "overdue_trend", "overdue_worsening",
    "max_overdue_in_month", "overdue_std", "overdue_consistency", "overdue_frequency",
    "overdue_freq_ratio", "recent_overdue_severity", "max_consecutive_overdue",
    "total_overdue_count", "has_overdue", "overdue_acceleration", "critical_period_overdue",
    "late_stage_persistence", "late_stage_persistent_flag", "overdue_recovery", "overdue_improving",
    "early_warning_score", "early_warning_flag", "rolling_3m_overdue_avg", "ema_overdue",
]


def overdue_long(df: DataFrame, key: str = C.KEY, cols: Sequence[str] = C.OVERDUE_COLS) -> DataFrame:
    """Long form ``(key, period, n)`` of the series (any length).

    The series are dealt by key into partitions of about ``LONG_ROWS`` long rows, so what a task sorts does not grow
    with the table; windows and groups by key need no further shuffle."""
    have = existing(df, cols)
    wide = stored(df.select(key, *have))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-wide.count() * len(have) // LONG_ROWS))
    stacked = wide.repartition(parts, key).select(key, F.posexplode(F.array(*[F.col(c).cast("double") for c in have])).alias("period", "n"))
    return stacked


def overdue_long_features(long: DataFrame, key: str = C.KEY, alpha: float = C.EMA_ALPHA,
                          window: int = C.ROLLING_WINDOW) -> DataFrame:
    """Streak, EMA, rolling mean, trend stats from the long form through windows.

    Series are short per key (bounded by the number of periods), so a window
    per key is a bounded group.  EMA uses its closed form
    ``(1-a)^(L-1) x0 + sum_{i>=1} a (1-a)^(L-1-i) x_i``; the longest streak is a
    gaps-and-islands count.
    """
    w = Window.partitionBy(key).orderBy("period")
    pos = (F.col("n") > 0)
    g = (long
         .withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(key)))
         .withColumn("_pos_rank", F.sum(pos.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_island", F.col("period") - F.col("_pos_rank"))
         .withColumn("_roll", F.avg("n").over(w.rowsBetween(-(window - 1), 0))))
    keep = 1.0 - alpha
    weight = F.when(F.col("period") == 0, F.pow(F.lit(keep), F.col("_len") - 1)).otherwise(
        F.lit(alpha) * F.pow(F.lit(keep), F.col("_len") - 1 - F.col("period")))
    runs = g.where(pos).groupBy(key, "_island").agg(F.count(F.lit(1)).alias("_run"))
    best = runs.groupBy(key).agg(F.max("_run").alias("max_consecutive_overdue"))
    agg = g.groupBy(key).agg(
        F.sum("n").alias("total_overdue_count"),
        F.max("n").alias("max_overdue_in_month"),
        F.sum(pos.cast("int")).alias("overdue_frequency"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("overdue_std"),
        F.sum(F.col("n") * weight).alias("ema_overdue"),
        F.max_by("_roll", "period").alias("rolling_3m_overdue_avg"),
    )
    return agg.join(best, key, "left").withColumn(
        "max_consecutive_overdue", F.coalesce(F.col("max_consecutive_overdue"), F.lit(0).cast("bigint")))


# -------------------------------------------------------------- client table
def client_ratio_features(df: DataFrame) -> DataFrame:
    """P28 ratio/interaction features and P29 composite scores (second schema)."""
    c = F.col
    monthly = c("monthly_income") if "monthly_income" in df.columns else c("annual_income") / 12.0
    return df.withColumns({
        "income_per_age": F.try_divide(c("annual_income"), c("age")),
        "loan_amount_per_credit_limit": F.try_divide(c("loan_amount"), c("total_credit_limit") + 1),
        "payment_burden_ratio": F.try_divide(F.try_divide(c("loan_amount"), c("loan_term_months")), monthly),
        "payment_risk_score": c("late_payments_count") * 0.3 + c("missed_payments_count") * 0.7
        + (1 - c("on_time_payment_rate")) * 0.5,
        "financial_stability_score": c("savings_to_income_ratio") * 0.4
        + clip(F.try_divide(c("avg_monthly_balance"), monthly), 0.0, 5.0) * 0.3
        + (1 - c("credit_utilization_rate")) * 0.3,
        "credit_experience_score": F.log1p(c("credit_history_months")) * 0.4 + F.log1p(c("previous_loans_count")) * 0.6,
    })


def age_group(df: DataFrame, age: str = "age") -> DataFrame:
    """Right-closed fixed bins (0,25] (25,35] (35,45] (45,55] (55,100]."""
    e, labels = C.AGE_BINS, C.AGE_BIN_LABELS
    expr = F.lit(None).cast("string")
    for lo, hi, lab in reversed(list(zip(e[:-1], e[1:], labels))):
        expr = F.when((F.col(age) > lo) & (F.col(age) <= hi), F.lit(lab)).otherwise(expr)
    return df.withColumn("age_group", expr)


def cyclic_month(df: DataFrame, month: str = "loan_origination_month") -> DataFrame:
    """sin/cos of 2*pi*m/12."""
    ang = F.lit(2 * math.pi) * F.col(month) / 12.0
    return df.withColumns({"loan_month_sin": F.sin(ang), "loan_month_cos": F.cos(ang)})
