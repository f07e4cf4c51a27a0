"""Risk scoring and business rules, score outputs
(S4-S7, S10), dimension lookups (J6, P23, P24) and score summaries (A19, A20).

Scoring is one projection over (probability, optimal threshold, early-warning
flag, worsening flag); the threshold arrives as a one-row table and is
broadcast, so the plan never collects it.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.tables import attach
from ..functions.columns import flag, round_half_even


# -------------------------------------------------------- threshold config
def threshold_config(spark: SparkSession, recommended: float | None, model: str | None = None) -> DataFrame:
    """One-row threshold table (recommended threshold and model)."""
    return spark.createDataFrame([(recommended, model)], "recommended_threshold double, recommended_model string")


def read_threshold(cfg: DataFrame | None, spark: SparkSession) -> DataFrame:
    """S7 reader: first row, fallback 0.5 when absent or null."""
    if cfg is None:
        return spark.createDataFrame([(C.FALLBACK_THRESHOLD,)], "optimal_threshold double")
    one = cfg.select(F.col("recommended_threshold").alias("t")).limit(1)
    fallback = spark.createDataFrame([(C.FALLBACK_THRESHOLD,)], "fb double")
    return fallback.join(one, how="left").select(F.coalesce("t", "fb").alias("optimal_threshold"))


def write_threshold(cfg: DataFrame, path: str) -> None:
    cfg.coalesce(1).write.mode("overwrite").json(path)


def load_threshold(spark: SparkSession, path: str) -> DataFrame:
    try:
        cfg = spark.read.schema("recommended_threshold double, recommended_model string").json(path)
    except Exception:  # missing file -> fallback
        cfg = None
    return read_threshold(cfg, spark)


# --------------------------------------------------------------- R1-R7
def grade_expr(score: Column, t_opt: Column) -> Column:
    """A if score >= (1 - t*) * 100 else >= 60 B, >= 40 C, >= 20 D, else E."""
    a_cut = (1 - t_opt) * 100
    g = C.GRADES
    return (F.when(score >= a_cut, g[0]).when(score >= C.GRADE_CUTS[0], g[1])
            .when(score >= C.GRADE_CUTS[1], g[2]).when(score >= C.GRADE_CUTS[2], g[3]).otherwise(g[4]))


def alert_expr(score: Column, t_opt: Column) -> Column:
    """Same cuts as the grade, five alert levels."""
    a_cut = (1 - t_opt) * 100
    a = C.ALERTS
    return (F.when(score >= a_cut, a[0]).when(score >= C.GRADE_CUTS[0], a[1])
            .when(score >= C.GRADE_CUTS[1], a[2]).when(score >= C.GRADE_CUTS[2], a[3]).otherwise(a[4]))


def action_expr(grade: Column, warn: Column, worse: Column) -> Column:
    """Action by grade; B splits on early warning, C on worsening."""
    g = C.GRADES
    return (F.when(grade == g[0], C.ACT_NORMAL)
            .when(grade == g[1], F.when(warn == 1, C.ACT_EARLY).otherwise(C.ACT_WATCH))
            .when(grade == g[2], F.when(worse == 1, C.ACT_DETERIORATION).otherwise(C.ACT_ENHANCED))
            .when(grade == g[3], C.ACT_INTERVENE)
            .otherwise(C.ACT_FORCED))


def action_optimal_expr(grade: Column, warn: Column, worse: Column, high: Column) -> Column:
    """Escalation when predicted_default_optimal = 1."""
    g = C.GRADES
    return (F.when(grade == g[0], F.when(high == 1, C.ACT_WATCH).otherwise(C.ACT_NORMAL))
            .when(grade == g[1], F.when(high == 1, F.when(warn == 1, C.ACT_ENHANCED_EARLY).otherwise(C.ACT_ENHANCED_PREP))
                  .otherwise(F.when(warn == 1, C.ACT_EARLY).otherwise(C.ACT_WATCH)))
            .when(grade == g[2], F.when(high == 1, F.when(worse == 1, C.ACT_COLLECT_NOW).otherwise(C.ACT_INTERVENE_PREP))
                  .otherwise(F.when(worse == 1, C.ACT_DETERIORATION).otherwise(C.ACT_ENHANCED)))
            .when(grade == g[3], F.when(high == 1, C.ACT_FORCED).otherwise(C.ACT_INTERVENE))
            .otherwise(C.ACT_FORCED))


def score(df: DataFrame, threshold: DataFrame, prob: str = "probability",
          standard: float = C.STANDARD_THRESHOLD) -> DataFrame:
    """Append default_probability (%), predicted flags, risk score,
    grade, alert and both actions.  ``threshold`` is a one-row table with
    ``optimal_threshold``; flags default to 0 when the feature is absent."""
    p = F.col(prob)
    t = F.col("optimal_threshold")
    warn = F.coalesce(F.col("early_warning_flag"), F.lit(0)) if "early_warning_flag" in df.columns else F.lit(0)
    worse = F.coalesce(F.col("overdue_worsening"), F.lit(0)) if "overdue_worsening" in df.columns else F.lit(0)
    out = attach(df, threshold.select("optimal_threshold").limit(1))
    out = out.withColumns({
        "default_probability": round_half_even(p * 100, 2),
        "predicted_default": flag(p >= standard),
        "predicted_default_optimal": flag(p >= t),
        "risk_score": ((1 - p) * 100).cast("int"),  # R3: truncation
    })
    out = out.withColumn("threshold_difference", flag(F.col("predicted_default") != F.col("predicted_default_optimal")))
    out = out.withColumn("risk_grade", grade_expr(F.col("risk_score"), t))
    out = out.withColumn("risk_alert", alert_expr(F.col("risk_score"), t))
    out = out.withColumn("risk_action", action_expr(F.col("risk_grade"), warn, worse))
    out = out.withColumn("risk_action_optimal",
                         action_optimal_expr(F.col("risk_grade"), warn, worse, F.col("predicted_default_optimal")))
    return out.drop("optimal_threshold")


# --------------------------------------------------------- R9-R13 (clients)
def score_band(score_col) -> Column:
    """Inclusive integer bands; a value in no band (e.g. 79.5) -> BAD."""
    s = F.col(score_col) if isinstance(score_col, str) else score_col
    expr = F.lit("BAD")
    for name, lo, hi in reversed(C.SCORE_BANDS):
        expr = F.when((s >= lo) & (s <= hi), F.lit(name)).otherwise(expr)
    return expr


def good_bad(prob) -> Column:
    """Bad when p >= 0.5."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.when(p >= C.GOOD_BAD_THRESHOLD, "Bad").otherwise("Good")


def risk_adjusted_score(base, age, employment, education) -> Column:
    """Base * employment multiplier + (age adj + education adj) * 100, clamped."""
    a = F.col(age)
    age_adj = None
    for bound, adj in C.AGE_ADJUSTMENTS:
        if bound is None:
            age_adj = age_adj.otherwise(F.lit(adj))
        elif age_adj is None:
            age_adj = F.when(a <= bound, F.lit(adj))
        else:
            age_adj = age_adj.when(a <= bound, F.lit(adj))
    emp = F.lit(1.0)
    for code, mult in sorted(C.EMPLOYMENT_MULTIPLIERS.items(), reverse=True):
        emp = F.when(F.col(employment) == code, F.lit(mult)).otherwise(emp)
    edu = F.lit(0.0)
    for code, adj in sorted(C.EDUCATION_ADJUSTMENTS.items(), reverse=True):
        edu = F.when(F.col(education) == code, F.lit(adj)).otherwise(edu)
    b = F.col(base) if isinstance(base, str) else base
    raw = b * emp + (age_adj + edu) * 100
    return F.greatest(F.lit(float(C.SCORE_MIN)), F.least(F.lit(float(C.SCORE_MAX)), raw))


def batch_client_scoring(df: DataFrame, prob_cols: Sequence[str], id_col: str = "customer_id") -> DataFrame:
    """Per client the mean of model probabilities, score, Good/Bad
    category (R10) and score band (R9); an ineligible client (P26) gets score 0,
    category ERROR and p = 1 for every model."""
    from .cleaning import validate_clients
    v = validate_clients(df)
    ok = F.col("is_valid") == 1
    mean_p = sum((F.col(c) for c in prob_cols), F.lit(0.0)) / float(len(prob_cols))
    risk = ((1 - mean_p) * 100).cast("int")
    cols = [F.col(id_col).alias("client_id"),
            F.when(ok, risk).otherwise(F.lit(0)).alias("risk_score"),
            F.when(ok, good_bad(mean_p)).otherwise(F.lit("ERROR")).alias("risk_category"),
            F.when(ok, score_band(risk)).otherwise(F.lit("ERROR")).alias("score_grade"),
            F.when(ok, mean_p).otherwise(F.lit(1.0)).alias("default_probability")]
    cols += [F.when(ok, F.col(c)).otherwise(F.lit(1.0)).alias(c) for c in prob_cols]
    return v.select(*cols, F.col("is_valid"))


# ------------------------------------------------------ output contracts
KEY_COLUMNS = ["serial_number", "application_date", "applicant", "id", "historical_default_rate",
               "default_probability", "risk_score", "risk_grade", "risk_action", "risk_action_optimal",
               "risk_alert", "predicted_default", "predicted_default_optimal", "threshold_difference"]

EXPORT_HEADERS = {
    "serial_number": "serial number", "application_date": "application date", "applicant": "applicant",
    "id": "ID", "default_probability": "default_probability", "risk_score": "risk_score",
    "risk_grade": "risk_grade", "risk_action_optimal": "risk_action_optimal", "risk_alert": "risk_alert",
}


def key_columns(df: DataFrame) -> DataFrame:
    """Rename ``default_rate`` -> ``historical_default_rate``; key columns
    that exist, in fixed order, de-duplicated."""
    if "default_rate" in df.columns and "historical_default_rate" not in df.columns:
        df = df.withColumnRenamed("default_rate", "historical_default_rate")
    seen, cols = set(), []
    for c in KEY_COLUMNS:
        if c in df.columns and c not in seen:
            cols.append(c)
            seen.add(c)
    return df.select(*cols)


def simplified_output(df: DataFrame) -> DataFrame:
    """Identity columns + nine result columns (+ two flags when present),
    with column descriptions attached as metadata."""
    keys = key_columns(df).columns
    extra = [c for c in ("early_warning_flag", "overdue_worsening") if c in df.columns and c not in keys and "serial_number" in keys]
    out = df.select(*keys, *extra)
    desc = {
        "default_probability": "predicted probability of default, percent",
        "risk_score": "0-100, higher is safer",
        "risk_grade": "A best .. E worst",
    }
    return out.select(*[F.col(c).alias(c, metadata={"comment": desc[c]}) if c in desc else F.col(c)
                        for c in out.columns])


def export_projection(df: DataFrame) -> DataFrame:
    """Nine export columns, renamed to export headers."""
    cols = [c for c in EXPORT_HEADERS if c in df.columns]
    return df.select(*[F.col(c).alias(EXPORT_HEADERS[c]) for c in cols])


def write_csv(df: DataFrame, path: str) -> None:
    """S4 sink: header CSV (one file per task; the driver never gathers rows)."""
    df.write.mode("overwrite").option("header", True).csv(path)


# ---------------------------------------------------------- dimensions
def grade_dimension(spark: SparkSession, threshold: DataFrame) -> DataFrame:
    """Grade legend whose A/B bounds depend on the threshold."""
    rows = [(i, g[0], g, a, lab) for i, (g, a, lab) in enumerate(zip(C.GRADES, C.ALERTS, C.RISK_LABELS))]
    dim = spark.createDataFrame(rows, "grade_order int, grade_letter string, risk_grade string, risk_alert string, risk_label string")
    t = threshold.select("optimal_threshold").limit(1)
    a_cut = ((1 - F.col("optimal_threshold")) * 100).cast("int")
    lo = F.when(F.col("grade_order") == 0, a_cut).when(F.col("grade_order") == 1, F.lit(60)).when(
        F.col("grade_order") == 2, F.lit(40)).when(F.col("grade_order") == 3, F.lit(20)).otherwise(F.lit(0))
    hi = F.when(F.col("grade_order") == 0, F.lit(100)).when(F.col("grade_order") == 1, a_cut - 1).when(
        F.col("grade_order") == 2, F.lit(59)).when(F.col("grade_order") == 3, F.lit(39)).otherwise(F.lit(19))
    return attach(dim, t).select("grade_order", "grade_letter", "risk_grade", "risk_alert",
                                                 "risk_label", lo.alias("score_min"), hi.alias("score_max"))


def code_dimension(spark: SparkSession, mapping: Mapping[str, str], name: str = "code") -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), f"{name} string, label string")


def translate(df: DataFrame, column: str, dim: DataFrame, out: str | None = None) -> DataFrame:
    """Value translation by code table (broadcast; dims are tiny and
    fixed-size), unmapped values kept."""
    code = dim.columns[0]
    d = dim.select(F.col(code).alias("__code"), F.col(dim.columns[1]).alias("__label"))
    j = df.join(F.broadcast(d), F.col(column) == F.col("__code"), "left")
    return j.withColumn(out or column, F.coalesce(F.col("__label"), F.col(column))).drop("__code", "__label")


def translate_columns(df: DataFrame, tables: Mapping[str, DataFrame | Mapping[str, str]], reverse: bool = False, suffix: str = "") -> DataFrame:
    """P23 for many columns at once: ``tables`` names each column's code table.

    All tables travel as one broadcast row of maps, so any number of columns
    costs one map-side lookup each: no shuffle and no row is multiplied.  Codes
    are looked up without surrounding blanks; unmapped and null values stay as
    they are, and columns the frame lacks are skipped.  ``reverse`` goes from
    labels to codes (the first code of a label).  A table given as a frame has
    the columns (code, label) and must be a dimension: one row a code."""
    spark = df.sparkSession
    row = None
    for i, (c, table) in enumerate(tables.items()):
        if c not in df.columns:
            continue
        t = code_dimension(spark, table) if isinstance(table, Mapping) else table
        key, value = t.columns[:2][::-1] if reverse else t.columns[:2]
        pairs = t.groupBy(F.col(key).alias("k")).agg(F.min(value).alias("v"))
        one = pairs.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(f"_codes{i}"))  # one map of a dimension
        row = one if row is None else row.crossJoin(F.broadcast(one))
    if row is None:
        return df
    out = attach(df, row)
    for i, c in enumerate(tables):
        if c in df.columns:
            out = out.withColumn(c + suffix, F.coalesce(F.try_element_at(F.col(f"_codes{i}"), F.trim(F.col(c).cast("string"))), F.col(c).cast("string")))
    return out.drop(*row.columns)


def convert_currency(c, rate: float = C.USD_PER_NTD) -> Column:
    """Amount / rate rounded half-even to an integer."""
    x = F.col(c) if isinstance(c, str) else c
    return F.rint(x / rate).cast("bigint")


# -------------------------------------------------------------- summaries
def batch_summary(scored: DataFrame) -> DataFrame:
    """N, counts by grade letter, avg/max/min probability rounded to 2
    decimals half-even (one pass)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for g in C.GRADES:
        aggs.append(F.count(F.when(F.col("risk_grade") == g, 1)).alias(f"grade_{g[0]}"))
    aggs += [round_half_even(F.avg("default_probability"), 2).alias("avg_probability"),
             round_half_even(F.max("default_probability"), 2).alias("max_probability"),
             round_half_even(F.min("default_probability"), 2).alias("min_probability")]
    return scored.agg(*aggs)


def prediction_summary(scored: DataFrame) -> DataFrame:
    """Predicted counts/shares under both thresholds, disagreements, and
    grade / action distributions, as one GROUPING SETS aggregation.
    Output: (dimension, value, n, share)."""
    import uuid
    view = f"scored_{uuid.uuid4().hex}"
    scored.createOrReplaceTempView(view)
    spark = scored.sparkSession
    return spark.sql(f"""
        WITH g AS (
          SELECT CASE WHEN grouping(risk_grade) = 0 THEN 'risk_grade'
                      WHEN grouping(risk_action) = 0 THEN 'risk_action'
                      WHEN grouping(risk_action_optimal) = 0 THEN 'risk_action_optimal'
                      WHEN grouping(predicted_default) = 0 THEN 'predicted_default'
                      WHEN grouping(predicted_default_optimal) = 0 THEN 'predicted_default_optimal'
                      ELSE 'threshold_difference' END AS dimension,
                 coalesce(risk_grade, risk_action, risk_action_optimal,
                          cast(predicted_default AS string), cast(predicted_default_optimal AS string),
                          cast(threshold_difference AS string)) AS value,
                 count(*) AS n
          FROM {view}
          GROUP BY GROUPING SETS ((risk_grade), (risk_action), (risk_action_optimal), (predicted_default),
                                  (predicted_default_optimal), (threshold_difference)))
        SELECT dimension, value, n, n / sum(n) OVER (PARTITION BY dimension) AS share FROM g
        ORDER BY dimension, n DESC, value
    """)


# ---------------------------------------------------- S10 / R15 helpers
COLUMN_NOTES = [  # column, description, calculation ("{t}" = optimal threshold, "{a}" = A-grade cut)
    ("serial_number", "case number", "input column"),
    ("application_date", "application date", "input column"),
    ("id", "client id", "input column"),
    ("default_probability", "predicted probability of default (0-100%)", "model probability x 100, 2 decimals"),
    ("risk_score", "risk score (0-100, higher is safer)", "(1 - probability) x 100, truncated"),
    ("risk_grade", "risk grade A best .. E worst", "A >= {a}, B >= 60, C >= 40, D >= 20, E < 20"),
    ("risk_action", "management action at the standard threshold 0.5", "by grade and warning flags"),
    ("risk_action_optimal", "management action at the optimal threshold {t}", "escalated when flagged at {t}"),
    ("risk_alert", "five-level alert", "same cuts as the grade"),
    ("predicted_default", "high-risk flag at 0.5", "probability >= 0.5"),
    ("predicted_default_optimal", "high-risk flag at {t}", "probability >= {t}"),
    ("threshold_difference", "flags disagree", "predicted_default != predicted_default_optimal"),
]


def column_dictionary(scored: DataFrame, threshold: DataFrame) -> DataFrame:
    """Description and calculation of every result column present in the
    scored frame, with the threshold-dependent values filled in (one broadcast
    threshold row; the dictionary has one row per column)."""
    spark = scored.sparkSession
    rows = [(i, c, d, k) for i, (c, d, k) in enumerate(COLUMN_NOTES) if c in scored.columns]
    dim = spark.createDataFrame(rows, "column_order int, column_name string, description string, calculation string")
    t = threshold.select(F.format_string("%.3f", F.col("optimal_threshold")).alias("__t"),
                         ((1 - F.col("optimal_threshold")) * 100).cast("int").cast("string").alias("__a")).limit(1)
    j = attach(dim, t)

    def fill(c):
        return F.replace(F.replace(F.col(c), F.lit("{t}"), F.col("__t")), F.lit("{a}"), F.col("__a"))

    return j.select("column_order", "column_name", fill("description").alias("description"),
                    fill("calculation").alias("calculation"))


SUMMARY_ITEMS = ["education", "month_salary", "job_tenure", "residence_status", "main_business", "product",
                 "loan_term", "paid_installments", "debt_to_income_ratio", "payment_to_income_ratio",
                 "post_perm", "post_res"]


def input_summary(df: DataFrame, key: str = "serial_number") -> DataFrame:
    """Per-client input summary as (key, item, value) rows, including the
    total overdue count; ratios shown with 2 decimals (half-even)."""
    from .. import config as C
    items = [c for c in SUMMARY_ITEMS if c in df.columns]
    types = dict(df.dtypes)

    def text(c):
        if c in ("debt_to_income_ratio", "payment_to_income_ratio"):
            return round_half_even(F.col(c).cast("double"), 2).cast("string")
        if c == "month_salary":
            return F.col(c).cast("bigint").cast("string")
        return F.col(c).cast("string") if types[c] != "string" else F.col(c)

    overdue = [c for c in C.OVERDUE_COLS if c in df.columns]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in overdue), F.lit(0)).cast("string")
    wide = df.select(key, *[text(c).alias(c) for c in items], total.alias("total_overdue_count"))
    return wide.unpivot([key], items + ["total_overdue_count"], "item", "value")
