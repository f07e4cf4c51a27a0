"""Ingest, cleaning and projection operators.

Every function is ``DataFrame -> DataFrame`` (plus plan-time helpers that only
look at the schema).  Statistics (median, mode, max date) are fitted as small
tables and applied with a broadcast of a one-row table, so scoring can reuse
training statistics.
"""

from __future__ import annotations

import re
from typing import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.tables import attach
from ..functions.columns import flag, parse_number
from .running import running


# ---------------------------------------------------------------- schema ops
def normalize_headers(df: DataFrame, snake_case: bool = False) -> DataFrame:
    """Strip blanks/newlines from column names (optionally snake_case them)."""
    def norm(name: str) -> str:
        n = name.strip()
        if snake_case:
            n = re.sub(r"\s+", "_", n).lower()
        return n
    return df.toDF(*[norm(c) for c in df.columns])


def find_column(df: DataFrame, keyword: str) -> str | None:
    """First column whose lower-cased name contains ``keyword`` (schema only)."""
    kw = keyword.lower()
    return next((c for c in df.columns if kw in c.lower()), None)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns absent from the frame, in contract order."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Reject a frame that misses any required column."""
    miss = missing_columns(df, required)
    if miss:
        raise ValueError(f"missing required columns: {', '.join(miss)}")
    return df


def fill_optional_columns(df: DataFrame, optional: Sequence[str], default=0) -> tuple[DataFrame, list[str]]:
    """Add absent optional columns with a default; return the warning list."""
    absent = [c for c in optional if c not in df.columns]
    if absent:
        df = df.withColumns({c: F.lit(default) for c in absent})
    return df, absent


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Keep only listed columns that exist, in list order."""
    have = set(df.columns)
    return [c for c in names if c in have]


def resolve_feature_lists(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Categorical, numeric and optional feature lists restricted to the frame."""
    return (existing(df, C.CATEGORICAL_FEATURES), existing(df, C.NUMERIC_FEATURES),
            existing(df, C.OPTIONAL_FEATURES))


def drop_internal(df: DataFrame, internal: Sequence[str]) -> DataFrame:
    """Drop internal columns from a published result."""
    return df.drop(*[c for c in internal if c in df.columns])


# ------------------------------------------------------------------- filling
def fill_zero(df: DataFrame, cols: Sequence[str] = ("paid_installments", *C.OVERDUE_COLS)) -> DataFrame:
    """P5: null -> 0 for paid installments and the overdue counts."""
    return df.fillna(0, subset=existing(df, cols))


def exact_quantiles_multi(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of several columns in one pass.

    Values are unpivoted and counted per (column, distinct value) with
    partial aggregation; the value-count table is checkpointed, cumulated per
    column with the skew-safe running helper, and the two neighbours of each
    target position ``q * (n - 1)`` are picked.  A column's distinct values
    share one task only while they fit the per-task row budget; beyond it they
    are range-split.  Output: ``(column, q, value)``.
    """
    from ..session import materialize
    cols = list(cols)
    v = F.col("v")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "v")
    vc = materialize(long.where(v.isNotNull() & ~F.isnan(v)).groupBy("column", "v").count())
    r = running(vc, ["column"], ["v"], sums=["count"])
    r = r.withColumn("_start", F.coalesce(F.col("_cum_count"), F.lit(0))).withColumn(
        "_end", F.col("_start") + F.col("count"))
    n = vc.groupBy(F.col("column").alias("_c")).agg(F.sum("count").alias("_n"))
    spark = df.sparkSession
    targets = (n.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in probs])))
               .withColumn("_pos", F.col("q") * (F.col("_n") - 1))
               .withColumn("_lo", F.floor("_pos"))
               .withColumn("_hi", F.ceil("_pos")))
    has_lo = (F.col("_lo") >= F.col("_start")) & (F.col("_lo") < F.col("_end"))
    has_hi = (F.col("_hi") >= F.col("_start")) & (F.col("_hi") < F.col("_end"))
    # bounded broadcast: one row per (column, prob)
    hits = r.join(F.broadcast(targets), (F.col("column") == F.col("_c")) & (has_lo | has_hi))
    picked = hits.groupBy("column", "q", "_pos", "_lo").agg(
        F.max(F.when(has_lo, v)).alias("_vlo"), F.max(F.when(has_hi, v)).alias("_vhi"))
    frac = F.col("_pos") - F.col("_lo")
    value = F.when(F.col("_vlo") == F.col("_vhi"), F.col("_vlo")).otherwise(
        F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * frac)
    grid = spark.createDataFrame([(c, float(q)) for c in cols for q in probs], "column string, q double")
    return grid.join(picked.select("column", "q", value.alias("value")), ["column", "q"], "left")


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of one column: ``(q, value)``."""
    return exact_quantiles_multi(df, [column], probs).select("q", "value")


def fit_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P6 fit: one-row table of exact medians (pandas ``median`` semantics)."""
    cols = existing(df, cols)
    types = dict(df.dtypes)
    num = df.select(*[(parse_number(c) if types[c] == "string" else F.col(c).cast("double")).alias(c) for c in cols])
    q = exact_quantiles_multi(num, cols, [0.5])
    return q.groupBy().pivot("column", cols).agg(F.first("value"))


def apply_medians(df: DataFrame, medians: DataFrame) -> DataFrame:
    """P6 apply: numeric coercion, then null or NaN -> fitted median (broadcast one row)."""
    cols = [c for c in medians.columns if c in df.columns]
    types = dict(df.dtypes)
    m = medians.select(*[F.col(c).alias(f"__med_{c}") for c in cols])
    out = attach(df, m)
    value = {c: parse_number(c) if types[c] == "string" else F.col(c).cast("double") for c in cols}
    out = out.withColumns({c: F.when(v.isNotNull() & ~F.isnan(v), v).otherwise(F.col(f"__med_{c}")) for c, v in value.items()})
    return out.drop(*[f"__med_{c}" for c in cols])


def fit_modes(df: DataFrame, cols: Sequence[str], fallback: Mapping[str, str] | None = None) -> DataFrame:
    """P7 fit: most frequent non-null value per column, ties -> smallest value.

    One ``groupBy(column, value)`` over an unpivot (partial aggregation keeps
    hot values cheap), then ``min_by`` over (-count, value) per column.
    """
    cols = existing(df, cols)
    fallback = dict(fallback or {})
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").count()
    best = counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode"))
    row = best.groupBy().pivot("column", cols).agg(F.first("mode"))
    return row.select(*[F.coalesce(F.col(c), F.lit(fallback.get(c))).alias(c) for c in cols])


def apply_modes(df: DataFrame, modes: DataFrame) -> DataFrame:
    """P7 apply: null -> fitted mode."""
    cols = [c for c in modes.columns if c in df.columns]
    m = modes.select(*[F.col(c).alias(f"__mode_{c}") for c in cols])
    out = attach(df, m)
    out = out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.col(f"__mode_{c}")) for c in cols})
    return out.drop(*[f"__mode_{c}" for c in cols])


def fill_constant(df: DataFrame, cols: Sequence[str], value: str = C.OTHER_LEVEL) -> DataFrame:
    """Null category -> constant."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in existing(df, cols)})


def categoricals_as_string(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P10: cast to string with an explicit missing level."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING_LEVEL))
                           for c in existing(df, cols)})


def drop_header_rows(df: DataFrame, numeric_cols: Sequence[str]) -> DataFrame:
    """Drop rows whose numeric columns are all present and none parses (a translated header)."""
    cols = existing(df, numeric_cols)
    if not cols:
        return df
    is_header = None
    for c in cols:
        cond = F.col(c).isNotNull() & parse_number(c).isNull()
        is_header = cond if is_header is None else (is_header & cond)
    return df.where(~F.coalesce(is_header, F.lit(False)))


def filter_recent_years(df: DataFrame, date_col: str = C.DATE, years: int = C.RECENT_YEARS) -> DataFrame:
    """Keep rows with date >= max(date) - N years; null/unparseable dates dropped."""
    d = F.col(date_col).cast("date") if dict(df.dtypes)[date_col] != "string" else F.try_to_date(F.col(date_col))
    valid = df.withColumn("__d", d).where(F.col("__d").isNotNull())
    mx = valid.agg(F.max("__d").alias("__mx"))
    out = attach(valid, mx).where(F.col("__d") >= F.add_months(F.col("__mx"), -12 * years))
    return out.drop("__d", "__mx")


# ------------------------------------------------------------------- labels
def with_label(df: DataFrame, status: str = "overdue_status", out: str = C.LABEL, rule: str = "m1") -> DataFrame:
    """P11 (``rule='m1'``) / P12 (``rule='buckets'``) default label."""
    from ..functions.columns import label_buckets, label_m1
    expr = label_m1(status) if rule == "m1" else label_buckets(status)
    return df.withColumn(out, expr)


# ------------------------------------------------------------ rule checks
def violations(df: DataFrame, rules: Sequence[tuple[str, object]], out: str = "violations") -> DataFrame:
    """Rule list (code, bad-condition) -> array of violated codes."""
    arr = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules]))
    return df.withColumn(out, arr)


def input_rules(allowed: Mapping[str, Sequence[str]] | None = None) -> list[tuple[str, object]]:
    """P25: loan input checks: non-negative amounts, term >= 1, paid <= term, allowed codes."""
    c = F.col
    rules: list[tuple[str, object]] = [
        ("month_salary_negative", c("month_salary") < 0),
        ("job_tenure_negative", c("job_tenure") < 0),
        ("loan_term_below_1", c("loan_term") < 1),
        ("paid_installments_negative", c("paid_installments") < 0),
        ("paid_above_term", c("paid_installments") > c("loan_term")),
        ("dti_negative", c("debt_to_income_ratio") < 0),
        ("pti_negative", c("payment_to_income_ratio") < 0),
    ]
    rules += [(f"{o}_negative", c(o) < 0) for o in C.OVERDUE_COLS]
    for column, codes in (allowed or {}).items():
        rules.append((f"{column}_unknown_code", ~c(column).isin(list(codes)) | c(column).isNull()))
    return rules


def eligibility_rules() -> list[tuple[str, object]]:
    """Client eligibility; a missing value counts as 0."""
    z = lambda n: F.coalesce(F.col(n), F.lit(0))
    return [
        ("age_below_min", z("age") < C.MIN_AGE),
        ("age_above_max", z("age") > C.MAX_AGE),
        ("income_below_min", z("annual_income") < C.MIN_INCOME),
        ("dti_above_max", z("debt_to_income_ratio") > C.MAX_DTI),
        ("credit_history_too_short", z("credit_history_months") < C.MIN_CREDIT_HISTORY_MONTHS),
    ]


def validate_clients(df: DataFrame) -> DataFrame:
    """Adds ``errors`` (array) and ``is_valid`` (int)."""
    out = violations(df, eligibility_rules(), "errors")
    return out.withColumn("is_valid", flag(F.size("errors") == 0))


def model_input_dti(df: DataFrame, dti="debt_to_income_ratio", debt="debt", income="annual_income") -> DataFrame:
    """Missing DTI derived from debt / income."""
    derived = F.try_divide(F.col(debt), F.col(income)) if debt in df.columns else F.lit(None)
    return df.withColumn(dti, F.coalesce(F.col(dti), derived))
