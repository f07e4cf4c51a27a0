"""Independent ANSI-SQL oracles (DuckDB) for the registered queries.

Each oracle is written from the operator definitions, not from the Spark
code: brute force where that is simplest (e.g. the threshold search
evaluates all 80 thresholds against all rows).  Exponent literals keep both
engines in DOUBLE; integer outputs are cast to BIGINT/INTEGER explicitly.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- fixtures
_PER = ",\n".join(
    f"    count(CASE WHEN l_returnflag = 'R' AND l_linenumber = {i + 1} THEN 1 END) AS o{i}" for i in range(7))

LOANS = f"""
per AS (
  SELECT l_orderkey,
{_PER},
    count(CASE WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 1 END) AS o7,
    count(*) AS items
  FROM lineitem GROUP BY l_orderkey),
fx_b0 AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
         c.c_acctbal, c.c_mktsegment, c.c_nationkey,
         {", ".join(f"coalesce(p.o{i}, 0) AS o{i}" for i in range(8))}, coalesce(p.items, 0) AS items,
         20000 + (o.o_custkey * 37) % 60000 AS sal
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN per p ON p.l_orderkey = o.o_orderkey),
fx_b AS (SELECT *, o0 + o1 + o2 + o3 + o4 + o5 + o6 + o7 AS tot FROM fx_b0),
loans AS (
  SELECT o_orderkey AS serial_number, o_custkey AS id, CAST(o_orderdate AS DATE) AS application_date,
    CASE WHEN tot >= 2 AND o_orderstatus = 'P' THEN concat('M', CAST(1 + o_orderkey % 3 AS VARCHAR))
         WHEN o_totalprice > 400000 AND o_orderstatus = 'F' THEN 'M1'
         WHEN o_orderkey % 50 = 0 THEN 'M1-1'
         WHEN o_orderstatus = 'F' THEN 'M0' ELSE 'Current' END AS overdue_status,
    tot * 15e0 AS overdue_days,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderpriority END AS education,
    CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE c_mktsegment END AS main_business,
    CASE o_orderkey % 5 WHEN 0 THEN 'owned' WHEN 1 THEN 'rented' WHEN 2 THEN 'spouse'
         WHEN 3 THEN 'family' ELSE 'dormitory' END AS residence_status,
    concat('P', CAST(o_custkey % 6 AS VARCHAR)) AS product,
    CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE CAST(sal AS VARCHAR) END AS salary_raw,
    CASE WHEN c_acctbal < 0 THEN NULL ELSE sal * 1e0 END AS month_salary,
    (o_custkey % 13) / 2e0 AS job_tenure,
    CAST(10000 + c_nationkey * 300 AS VARCHAR) AS post_perm,
    CAST(10000 + c_nationkey * 300 + (o_orderkey % 7) * 10 AS VARCHAR) AS post_res,
    CAST(CASE WHEN o_orderkey % 401 = 0 THEN 0 ELSE 12 + 6 * (o_orderkey % 5) END AS BIGINT) AS loan_term,
    CAST(items * 3 AS BIGINT) AS paid_installments,
    o_totalprice / (sal * 12e0) AS debt_to_income_ratio,
    o_totalprice / 48e0 / sal AS payment_to_income_ratio,
    {", ".join(f"CAST(o{i} AS BIGINT) AS o{i}" for i in range(8))},
    least(98e-2, 5e-2 + 12e-2 * tot + 10e-2 * (CASE WHEN o5 + o6 + o7 > o0 + o1 + o2 + o3 THEN 1 ELSE 0 END)) AS score_p
  FROM fx_b),
labeled AS (
  SELECT *, CAST(coalesce(TRY_CAST(regexp_extract(regexp_replace(overdue_status, '^\\s+|\\s+$', '', 'g'),
                 '^M\\s*([+-]?[0-9]+)$', 1) AS INTEGER) >= 1, false) AS INTEGER) AS default_flag
  FROM loans)"""

CLIENTS = """
cstats AS (
  SELECT o_custkey, count(*) AS n,
         count(CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 1 END) AS bad,
         count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS urg
  FROM orders GROUP BY o_custkey),
clients AS (
  SELECT c_custkey AS customer_id, 16 + (c_custkey * 7) % 65 AS age, c_mktsegment AS job_category,
    CAST(1 + c_nationkey % 5 AS INTEGER) AS education_level, CAST(1 + c_custkey % 6 AS INTEGER) AS employment_status,
    (12000 + (c_custkey * 911) % 120000) * 1e0 AS annual_income,
    (5000 + (c_custkey * 3571) % 90000) * 1e0 AS loan_amount,
    12 * (1 + c_custkey % 5) AS loan_term_months,
    (c_custkey * 13) % 120 AS credit_history_months,
    CAST(coalesce(s.n, 0) AS BIGINT) AS previous_loans_count,
    (1000 + (c_custkey * 257) % 50000) * 1e0 AS total_credit_limit,
    CAST(coalesce(s.urg, 0) AS BIGINT) AS late_payments_count,
    CAST(coalesce(s.bad, 0) % 4 AS BIGINT) AS missed_payments_count,
    1e0 - ((c_custkey * 3) % 40) / 1e2 AS on_time_payment_rate,
    ((c_custkey * 11) % 100) / 1e2 AS credit_utilization_rate,
    ((c_custkey * 17) % 50) / 1e2 AS savings_to_income_ratio,
    ((c_custkey * 29) % 80) / 1e2 AS debt_to_income_ratio,
    greatest(c_acctbal, 0e0) AS avg_monthly_balance,
    1 + c_custkey % 12 AS loan_origination_month,
    CAST(CASE WHEN coalesce(s.bad, 0) >= 3 THEN 1 ELSE 0 END AS INTEGER) AS is_default,
    (12000 + (c_custkey * 911) % 120000) * 1e0 / 12e0 AS monthly_income
  FROM customer LEFT JOIN cstats s ON s.o_custkey = c_custkey)"""

# 80-point grid, numpy arange fill: start + i * ((start + step) - start)
GRID = """
grid AS (SELECT CAST(i AS INTEGER) AS i, 1e-1 + CAST(i AS DOUBLE) * ((1e-1 + 1e-2) - 1e-1) AS threshold
         FROM range(80) t(i))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


# ============================================================ first slice
ORACLE["label_m1"] = with_(LOANS) + " SELECT serial_number, overdue_status, default_flag FROM labeled"

_E = "(o0 + o1 + o2 + o3)"
_L = "(o5 + o6 + o7)"
_ALL = "(o0 + o1 + o2 + o3 + o4 + o5 + o6 + o7)"
_MEAN = f"({_ALL} / 8e0)"
_SS = " + ".join(f"(o{i} - {_MEAN}) * (o{i} - {_MEAN})" for i in range(8))
_POS = lambda cols: " + ".join(f"CAST({c} > 0 AS INTEGER)" for c in cols)
_BITS = "concat(" + ", ".join(f"CASE WHEN o{i} > 0 THEN '1' ELSE '0' END" for i in range(8)) + ")"
_EMA = "CAST(o0 AS DOUBLE)"
for _i in range(1, 8):
    _EMA = f"(3e-1 * o{_i} + 7e-1 * {_EMA})"
_G = ", ".join(f"o{i}" for i in range(8))

OVERDUE_SELECT = f"""
  {_E} AS early_overdue_count, {_L} AS late_overdue_count, {_L} - {_E} AS overdue_trend,
  CAST({_L} - {_E} > 0 AS INTEGER) AS overdue_worsening,
  greatest({_G}) AS max_overdue_in_month,
  sqrt(({_SS}) / 7e0) AS overdue_std,
  CAST(greatest({_G}) = least({_G}) AS INTEGER) AS overdue_consistency,
  ({_POS([f"o{i}" for i in range(8)])}) AS overdue_frequency,
  ({_POS([f"o{i}" for i in range(8)])}) / 8e0 AS overdue_freq_ratio,
  {_L} / 3e0 AS recent_overdue_severity,
  CAST(list_max(list_transform(string_split({_BITS}, '0'), lambda x: length(x))) AS INTEGER) AS max_consecutive_overdue,
  {_ALL} AS total_overdue_count, CAST({_ALL} > 0 AS INTEGER) AS has_overdue,
  ((o7 - o6) - (o1 - o0)) / 6e0 AS overdue_acceleration,
  (o2 + o3 + o4 + o5) AS critical_period_overdue,
  ({_POS(["o5", "o6", "o7"])}) AS late_stage_persistence,
  CAST(({_POS(["o5", "o6", "o7"])}) >= 2 AS INTEGER) AS late_stage_persistent_flag,
  {_E} - {_L} AS overdue_recovery, CAST({_E} - {_L} > 0 AS INTEGER) AS overdue_improving,
  (o0 + o1 + o2) AS early_warning_score, CAST((o0 + o1 + o2) >= 3 AS INTEGER) AS early_warning_flag,
  {_L} / 3e0 AS rolling_3m_overdue_avg,
  {_EMA} AS ema_overdue"""

ORACLE["overdue_pattern"] = with_(LOANS) + f" SELECT serial_number, {OVERDUE_SELECT} FROM loans"

CATS = ["post_res", "main_business", "residence_status", "education", "product"]
_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), '(missing)') AS value, default_flag AS y FROM labeled"
    for c in CATS)
WOE = f"""
cat_long AS ({_LONG}),
cat_stats AS (SELECT feature, value, count(*) AS n, sum(y) AS bad FROM cat_long GROUP BY feature, value),
cat_tot AS (SELECT feature, sum(n - bad) AS tg, sum(bad) AS tb FROM cat_stats GROUP BY feature),
woe0 AS (
  SELECT s.feature, s.value, s.n, s.bad, s.n - s.bad AS good,
         CASE WHEN (s.n - s.bad) / t.tg = 0 THEN 1e-4 ELSE (s.n - s.bad) / t.tg END AS good_pct,
         CASE WHEN s.bad / t.tb = 0 THEN 1e-4 ELSE s.bad / t.tb END AS bad_pct
  FROM cat_stats s JOIN cat_tot t USING (feature) WHERE t.tg > 0 AND t.tb > 0),
woe AS (SELECT *, ln(good_pct / bad_pct) AS woe, (good_pct - bad_pct) * ln(good_pct / bad_pct) AS iv_part FROM woe0)"""

ORACLE["woe_table"] = with_(LOANS, WOE) + """
SELECT feature, value, CAST(n AS BIGINT) AS n, CAST(bad AS BIGINT) AS bad, CAST(good AS BIGINT) AS good,
       round(good_pct, 9) AS good_pct, round(bad_pct, 9) AS bad_pct, round(woe, 9) AS woe,
       round(iv_part, 9) AS iv_part FROM woe"""

IV = """
iv AS (SELECT feature, sum(iv_part) AS iv FROM woe GROUP BY feature)"""

ORACLE["iv_summary"] = with_(LOANS, WOE, IV) + """
SELECT feature, round(iv, 6) AS iv,
       CASE WHEN iv > 3e-1 THEN 'Strong' WHEN iv > 1e-1 THEN 'Medium' WHEN iv > 2e-2 THEN 'Weak' ELSE 'Very Weak' END AS strength,
       CAST(row_number() OVER (ORDER BY iv DESC, feature) AS INTEGER) AS iv_rank,
       CAST(iv >= 2e-2 AS INTEGER) AS selected
FROM iv"""

THRESH = """
ts_lab AS (SELECT score_p AS p, default_flag AS y FROM labeled),
ts_tot AS (SELECT sum(y) AS P, count(*) AS N FROM ts_lab),
ts_cnt AS (SELECT i, threshold,
                  sum(CASE WHEN p >= threshold AND y = 1 THEN 1 ELSE 0 END) AS tp,
                  sum(CASE WHEN p >= threshold THEN 1 ELSE 0 END) AS pp
           FROM grid, ts_lab GROUP BY i, threshold),
ts_m AS (
  SELECT i, threshold, tp, pp, P, N, pp - tp AS fp, P - tp AS fn, N - pp - (P - tp) AS tn,
         CASE WHEN 4e0 * P + pp > 0 THEN 5e0 * tp / (4e0 * P + pp) ELSE 0e0 END AS f2,
         CASE WHEN P + pp > 0 THEN 2e0 * tp / (P + pp) ELSE 0e0 END AS f1,
         CASE WHEN pp > 0 THEN tp / pp ELSE 0e0 END AS precision,
         CASE WHEN P > 0 THEN tp / P ELSE 0e0 END AS recall,
         (tp + (N - pp - (P - tp))) / N AS accuracy
  FROM ts_cnt, ts_tot),
ts_best AS (SELECT * FROM ts_m ORDER BY f2 DESC, i LIMIT 1)"""

ORACLE["threshold_search"] = with_(LOANS, GRID, THRESH) + """
SELECT threshold, round(f2, 12) AS f2_score, round(accuracy, 12) AS accuracy, round(precision, 12) AS precision,
       round(recall, 12) AS recall, round(f1, 12) AS f1, CAST(tp AS BIGINT) AS tp, CAST(pp AS BIGINT) AS pp,
       CAST(P AS BIGINT) AS positives
FROM ts_best"""

SCORED = f"""
feat AS (SELECT l.*, {OVERDUE_SELECT} FROM labeled l),
sc0 AS (SELECT f.*, b.threshold AS t, CAST(trunc((1e0 - f.score_p) * 100) AS INTEGER) AS risk_score,
               CAST(f.score_p >= 5e-1 AS INTEGER) AS predicted_default,
               CAST(f.score_p >= b.threshold AS INTEGER) AS predicted_default_optimal
        FROM feat f, ts_best b),
sc1 AS (SELECT *, CASE WHEN risk_score >= (1 - t) * 100 THEN 'A (Excellent)' WHEN risk_score >= 60 THEN 'B (Moderate)'
                       WHEN risk_score >= 40 THEN 'C (Warning)' WHEN risk_score >= 20 THEN 'D (Poor)' ELSE 'E (Critical)' END AS risk_grade,
                  CASE WHEN risk_score >= (1 - t) * 100 THEN 'LOW RISK' WHEN risk_score >= 60 THEN 'MEDIUM-HIGH RISK'
                       WHEN risk_score >= 40 THEN 'HIGH RISK' WHEN risk_score >= 20 THEN 'VERY HIGH RISK' ELSE 'CRITICAL RISK' END AS risk_alert
        FROM sc0),
scored AS (
  SELECT *, round_even(score_p * 100e0 * 100e0, 0) / 100e0 AS default_probability,
         CAST(predicted_default <> predicted_default_optimal AS INTEGER) AS threshold_difference,
         CASE risk_grade WHEN 'A (Excellent)' THEN 'Normal Monitoring'
              WHEN 'B (Moderate)' THEN CASE WHEN early_warning_flag = 1 THEN 'Early Warning' ELSE 'Watch List' END
              WHEN 'C (Warning)' THEN CASE WHEN overdue_worsening = 1 THEN 'Deterioration Alert' ELSE 'Enhanced Monitoring' END
              WHEN 'D (Poor)' THEN 'Immediate Intervention' ELSE 'Forced Collection' END AS risk_action,
         CASE risk_grade WHEN 'A (Excellent)' THEN CASE WHEN predicted_default_optimal = 1 THEN 'Watch List' ELSE 'Normal Monitoring' END
              WHEN 'B (Moderate)' THEN CASE WHEN predicted_default_optimal = 1
                   THEN CASE WHEN early_warning_flag = 1 THEN 'Enhanced Monitoring + Early Warning' ELSE 'Enhanced Monitoring / Collection Prep' END
                   ELSE CASE WHEN early_warning_flag = 1 THEN 'Early Warning' ELSE 'Watch List' END END
              WHEN 'C (Warning)' THEN CASE WHEN predicted_default_optimal = 1
                   THEN CASE WHEN overdue_worsening = 1 THEN 'Immediate Collection' ELSE 'Immediate Intervention / Collection Prep' END
                   ELSE CASE WHEN overdue_worsening = 1 THEN 'Deterioration Alert' ELSE 'Enhanced Monitoring' END END
              WHEN 'D (Poor)' THEN CASE WHEN predicted_default_optimal = 1 THEN 'Forced Collection' ELSE 'Immediate Intervention' END
              ELSE 'Forced Collection' END AS risk_action_optimal
  FROM sc1)"""

ORACLE["risk_scoring"] = with_(LOANS, GRID, THRESH, SCORED) + """
SELECT serial_number, default_probability, predicted_default, predicted_default_optimal, threshold_difference,
       risk_score, risk_grade, risk_alert, risk_action, risk_action_optimal FROM scored"""


# ====================================================== batch 2: cleaning
LOAN_COLUMNS = ["serial_number", "id", "application_date", "overdue_status", "overdue_days", "education",
                "main_business", "residence_status", "product", "salary_raw", "month_salary", "job_tenure",
                "post_perm", "post_res", "loan_term", "paid_installments", "debt_to_income_ratio",
                "payment_to_income_ratio"] + [f"o{i}" for i in range(8)] + ["score_p"]
NUMRE = r"'^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"

ORACLE["label_buckets"] = with_(LOANS) + """
SELECT serial_number, overdue_status,
       CAST(coalesce(overdue_status IN ('M1-1', 'M1-2', 'M2', 'M3', 'M4', 'M5', 'M6'), false) AS INTEGER) AS default_bucket
FROM loans"""

ORACLE["clean_loans"] = with_(LOANS, f"""
c0 AS (SELECT *, CASE WHEN regexp_full_match(salary_raw, {NUMRE}) THEN TRY_CAST(trim(salary_raw) AS DOUBLE) END AS salary
       FROM loans),
c_med AS (SELECT median(salary) AS m_sal, median(job_tenure) AS m_ten FROM c0),
c_edu AS (SELECT education AS v FROM c0 WHERE education IS NOT NULL GROUP BY education ORDER BY count(*) DESC, education LIMIT 1),
c_res AS (SELECT residence_status AS v FROM c0 WHERE residence_status IS NOT NULL GROUP BY residence_status
          ORDER BY count(*) DESC, residence_status LIMIT 1)""") + """
SELECT serial_number, coalesce(salary, m_sal) AS salary, coalesce(job_tenure, m_ten) AS job_tenure,
       coalesce(education, (SELECT v FROM c_edu), 'unknown') AS education,
       coalesce(residence_status, (SELECT v FROM c_res), 'rented') AS residence_status,
       coalesce(main_business, 'other') AS main_business, coalesce(post_res, '(missing)') AS post_res,
       coalesce(product, '(missing)') AS product, coalesce(paid_installments, 0) AS paid_installments
FROM c0, c_med"""

ORACLE["header_contract"] = with_(LOANS) + """
SELECT serial_number, month_salary, o0, o1, o2, o3, o4, o5, o6, o7, CAST(0 AS INTEGER) AS debt_to_income_ratio,
       CAST(0 AS INTEGER) AS payment_to_income_ratio FROM labeled"""

ROW_FEATURES = """
  coalesce(CASE WHEN CAST(loan_term AS DOUBLE) = 0 THEN CASE WHEN CAST(paid_installments AS DOUBLE) > 0 THEN 1e0 ELSE 0e0 END
           ELSE least(greatest(CAST(paid_installments AS DOUBLE) / CAST(loan_term AS DOUBLE), 0e0), 1e0) END, 0e0) AS payment_progress_ratio,
  CAST(coalesce(job_tenure >= 1, false) AS INTEGER) AS job_stable,
  CAST(coalesce(post_perm = post_res, false) AS INTEGER) AS address_match,
  CAST(coalesce(residence_status IN ('owned', 'spouse', 'family'), false) AS INTEGER) AS residence_stable,
  least(greatest(coalesce(debt_to_income_ratio, 0e0), 0e0), 2e0) AS dti_ratio,
  least(greatest(coalesce(payment_to_income_ratio, 0e0), 0e0), 1e0) AS payment_pressure"""

ORACLE["row_features"] = with_(LOANS) + f"SELECT serial_number, {ROW_FEATURES} FROM loans"

ORACLE["upstream_ratios"] = with_(CLIENTS) + """
SELECT customer_id, monthly_income * 12 AS annual_salary,
       round(least(loan_amount / (monthly_income * 12), 100e0), 12) AS dti_upstream,
       round(least((loan_amount / loan_term_months) / monthly_income, 10e0), 12) AS pti_upstream,
       CASE WHEN monthly_income * 12 / 10000e0 < 3 THEN '<3' WHEN monthly_income * 12 / 10000e0 < 5 THEN '3-5'
            WHEN monthly_income * 12 / 10000e0 < 8 THEN '5-8' ELSE '>8' END AS income_level
FROM clients"""

ORACLE["recent_years"] = with_(LOANS, """
ry AS (SELECT max(application_date) AS mx FROM loans)""") + """
SELECT serial_number, CAST(application_date AS VARCHAR) AS application_date FROM loans, ry
WHERE application_date IS NOT NULL AND application_date >= CAST(mx - INTERVAL 60 MONTH AS DATE)"""

_RULES = [("month_salary_negative", "month_salary < 0"), ("job_tenure_negative", "job_tenure < 0"),
          ("loan_term_below_1", "loan_term < 1"), ("paid_installments_negative", "paid_installments < 0"),
          ("paid_above_term", "paid_installments > loan_term"), ("dti_negative", "debt_to_income_ratio < 0"),
          ("pti_negative", "payment_to_income_ratio < 0")] + [(f"o{i}_negative", f"o{i} < 0") for i in range(8)] + [
          ("residence_status_unknown_code",
           "NOT (residence_status IN ('owned', 'rented', 'spouse', 'family', 'dormitory')) OR residence_status IS NULL")]
_VLIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _RULES) + "], lambda x: x IS NOT NULL)"
ORACLE["input_rules"] = with_(LOANS) + f"""
SELECT serial_number, array_to_string({_VLIST}, ',') AS violations, CAST(len({_VLIST}) AS INTEGER) AS n_violations,
       CAST(len({_VLIST}) = 0 AS INTEGER) AS valid FROM loans"""

_ELIG = [("age_below_min", "coalesce(age, 0) < 18"), ("age_above_max", "coalesce(age, 0) > 75"),
         ("income_below_min", "coalesce(annual_income, 0) < 20000"),
         ("dti_above_max", "coalesce(debt_to_income_ratio, 0) > 5e-1"),
         ("credit_history_too_short", "coalesce(credit_history_months, 0) < 6")]
ELIG_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _ELIG) + "], lambda x: x IS NOT NULL)"
ORACLE["client_eligibility"] = with_(CLIENTS) + f"""
SELECT customer_id, array_to_string({ELIG_LIST}, ',') AS errors, CAST(len({ELIG_LIST}) = 0 AS INTEGER) AS is_valid
FROM clients"""

ORACLE["client_features"] = with_(CLIENTS) + """
SELECT customer_id, annual_income / age AS income_per_age, loan_amount / (total_credit_limit + 1) AS loan_amount_per_credit_limit,
  round((loan_amount / loan_term_months) / monthly_income, 12) AS payment_burden_ratio,
  round(late_payments_count * 3e-1 + missed_payments_count * 7e-1 + (1 - on_time_payment_rate) * 5e-1, 12) AS payment_risk_score,
  round(savings_to_income_ratio * 4e-1 + least(greatest(avg_monthly_balance / monthly_income, 0e0), 5e0) * 3e-1
        + (1 - credit_utilization_rate) * 3e-1, 12) AS financial_stability_score,
  round(ln(1 + credit_history_months) * 4e-1 + ln(1 + previous_loans_count) * 6e-1, 9) AS credit_experience_score,
  CASE WHEN age > 0 AND age <= 25 THEN 'Young' WHEN age > 25 AND age <= 35 THEN 'Young_Adult'
       WHEN age > 35 AND age <= 45 THEN 'Middle_Age' WHEN age > 45 AND age <= 55 THEN 'Mature'
       WHEN age > 55 AND age <= 100 THEN 'Senior' END AS age_group,
  round(sin(2e0 * pi() * loan_origination_month / 12e0), 9) + 0e0 AS loan_month_sin,
  round(cos(2e0 * pi() * loan_origination_month / 12e0), 9) + 0e0 AS loan_month_cos
FROM clients"""

_OUT = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3"
                 for c in ["annual_income", "loan_amount", "debt_to_income_ratio"])
ORACLE["client_outliers"] = with_(CLIENTS, f"qq AS (SELECT {_OUT} FROM clients)") + " SELECT customer_id, " + ", ".join(
    f"CAST({c} < {c}_q1 - 15e-1 * ({c}_q3 - {c}_q1) OR {c} > {c}_q3 + 15e-1 * ({c}_q3 - {c}_q1) AS INTEGER) AS {c}_outlier"
    for c in ["annual_income", "loan_amount", "debt_to_income_ratio"]) + " FROM clients, qq"


def _qbins(col, labels):
    k = len(labels)
    edges = ", ".join(f"quantile_cont({col}, {i / k!r}) AS {col}_e{i}" for i in range(k + 1))
    cases = " ".join(
        f"WHEN {col} {'>=' if i == 0 else '>'} {col}_e{i} AND {col} <= {col}_e{i + 1} THEN '{lab}'"
        for i, lab in enumerate(labels))
    return edges, f"CASE {cases} END"


_IE, _IC = _qbins("annual_income", ["Low", "Lower_Mid", "Mid", "Upper_Mid", "High"])
_LE, _LC = _qbins("loan_amount", ["Small", "Medium", "Large"])
ORACLE["client_quantile_bins"] = with_(CLIENTS, f"qe AS (SELECT {_IE}, {_LE} FROM clients)") + f"""
SELECT customer_id, {_IC} AS income_quintile, {_LC} AS loan_size_category FROM clients, qe"""

ORACLE["client_group_rate"] = with_(CLIENTS) + """
SELECT customer_id, round(avg(is_default) OVER (PARTITION BY job_category, education_level), 12) AS group_default_rate,
       count(*) OVER (PARTITION BY job_category, education_level) AS group_size FROM clients"""


# ======================================================= batch 2: encoders
def woe_ctes(src: str, p: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), '(missing)') AS value, default_flag AS y FROM {src}"
        for c in CATS)
    return f"""
{p}_long AS ({long}),
{p}_stats AS (SELECT feature, value, count(*) AS n, sum(y) AS bad FROM {p}_long GROUP BY feature, value),
{p}_tot AS (SELECT feature, sum(n - bad) AS tg, sum(bad) AS tb FROM {p}_stats GROUP BY feature),
{p}_w0 AS (
  SELECT s.feature, s.value, s.n, s.bad,
         CASE WHEN (s.n - s.bad) / t.tg = 0 THEN 1e-4 ELSE (s.n - s.bad) / t.tg END AS good_pct,
         CASE WHEN s.bad / t.tb = 0 THEN 1e-4 ELSE s.bad / t.tb END AS bad_pct
  FROM {p}_stats s JOIN {p}_tot t USING (feature) WHERE t.tg > 0 AND t.tb > 0),
{p} AS (SELECT *, ln(good_pct / bad_pct) AS woe FROM {p}_w0)"""


SPLIT_X1 = """
strat AS (SELECT *, row_number() OVER (PARTITION BY default_flag ORDER BY md5(CAST(serial_number AS VARCHAR) || '|42'), serial_number) AS rk,
                 count(*) OVER (PARTITION BY default_flag) AS nc FROM labeled),
split_x1 AS (SELECT *, CASE WHEN rk <= floor(nc * 2e-1 + 5e-1) THEN 'test' ELSE 'train' END AS split FROM strat),
train_x1 AS (SELECT * FROM split_x1 WHERE split = 'train')"""


def _lookup_joins(src: str, enc: str, val: str, suffix: str, default: str) -> tuple[str, str]:
    joins, cols = [], []
    for i, c in enumerate(CATS):
        joins.append(f"LEFT JOIN {enc} j{i} ON j{i}.feature = '{c}' AND j{i}.value = coalesce(CAST({src}.{c} AS VARCHAR), '(missing)')")
        cols.append(f"coalesce(j{i}.{val}, {default}) AS {c}_{suffix}")
    return " ".join(joins), ", ".join(cols)


_J, _C = _lookup_joins("split_x1", "wtr", "woe", "woe", "0e0")
ORACLE["woe_apply"] = with_(LOANS, SPLIT_X1, woe_ctes("train_x1", "wtr")) + f"""
SELECT serial_number, split, {', '.join(f'round({c}_woe, 9) AS {c}_woe' for c in CATS)} FROM (
  SELECT split_x1.serial_number, split_x1.split, {_C} FROM split_x1 {_J})"""

TE = """
te_long AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), '(missing)') AS value, default_flag AS y FROM labeled"
    for c in CATS) + """),
te_stats AS (SELECT feature, value, count(*) AS n, sum(y) AS bad FROM te_long GROUP BY feature, value),
te_g AS (SELECT avg(default_flag) AS gm FROM labeled),
te AS (SELECT feature, value, n, (n * (bad / n) + 1e0 * gm) / (n + 1e0) AS enc, n / (SELECT count(*) FROM labeled) AS freq
       FROM te_stats, te_g)"""
_PARTS = [_lookup_joins("split_x1", *x) for x in (("wtr", "woe", "woe", "0e0"), ("te", "enc", "target_enc", "(SELECT gm FROM te_g)"), ("te", "freq", "freq", "0e0"))]
ORACLE["encoder_pipeline"] = with_(LOANS, SPLIT_X1, woe_ctes("train_x1", "wtr"), TE.replace("FROM labeled", "FROM train_x1")) + f"""
SELECT a.serial_number, a.split, {', '.join(f'round({c}_{x}, 9) AS {c}_{x}' for x in ('woe', 'target_enc', 'freq') for c in CATS)}
FROM (SELECT split_x1.serial_number, split_x1.split, {_PARTS[0][1]} FROM split_x1 {_PARTS[0][0]}) a
JOIN (SELECT split_x1.serial_number, {_PARTS[1][1]} FROM split_x1 {_PARTS[1][0]}) b USING (serial_number)
JOIN (SELECT split_x1.serial_number, {_PARTS[2][1]} FROM split_x1 {_PARTS[2][0]}) c USING (serial_number)"""
_J, _C = _lookup_joins("labeled", "te", "enc", "target_enc", "(SELECT gm FROM te_g)")
ORACLE["target_encoding"] = with_(LOANS, TE) + f"""
SELECT serial_number, {', '.join(f'round({c}_target_enc, 9) AS {c}_target_enc' for c in CATS)} FROM (
  SELECT labeled.serial_number, {_C} FROM labeled {_J})"""
_J, _C = _lookup_joins("labeled", "te", "freq", "freq", "0e0")
ORACLE["frequency_encoding"] = with_(LOANS, TE) + f"""
SELECT serial_number, {', '.join(f'round({c}_freq, 12) AS {c}_freq' for c in CATS)} FROM (
  SELECT labeled.serial_number, {_C} FROM labeled {_J})"""

GEO = """
g_long AS (SELECT 'res' AS feature, coalesce(post_res, '(missing)') AS value, default_flag AS y FROM labeled
           UNION ALL SELECT 'perm', coalesce(post_perm, '(missing)'), default_flag FROM labeled
           UNION ALL SELECT 'city', coalesce(substr(post_res, 1, 3), '(missing)'), default_flag FROM labeled),
g_s AS (SELECT feature, value, count(*) AS n, avg(y) AS rate FROM g_long GROUP BY feature, value),
g_g AS (SELECT avg(default_flag) AS gr FROM labeled),
geo AS (SELECT g_s.*, gr, CASE WHEN n < (CASE WHEN feature = 'city' THEN 50 ELSE 10 END) THEN gr ELSE rate END AS risk
        FROM g_s, g_g),
geo_applied AS (
  SELECT l.serial_number, coalesce(r.risk, g.gr) AS res_risk_score, coalesce(p.risk, g.gr) AS perm_risk_score,
         coalesce(c.risk, g.gr) AS city_risk_score, CAST(coalesce(l.post_perm = l.post_res, false) AS INTEGER) AS address_match
  FROM labeled l CROSS JOIN g_g g
  LEFT JOIN geo r ON r.feature = 'res' AND r.value = coalesce(l.post_res, '(missing)')
  LEFT JOIN geo p ON p.feature = 'perm' AND p.value = coalesce(l.post_perm, '(missing)')
  LEFT JOIN geo c ON c.feature = 'city' AND c.value = substr(l.post_res, 1, 3))"""

ORACLE["geo_risk"] = with_(LOANS, GEO) + """
SELECT serial_number, round(res_risk_score, 12) AS res_risk_score, round(perm_risk_score, 12) AS perm_risk_score,
       round(city_risk_score, 12) AS city_risk_score,
       CASE WHEN res_risk_score > 0e0 AND res_risk_score <= 3e-2 THEN 'low'
            WHEN res_risk_score > 3e-2 AND res_risk_score <= 6e-2 THEN 'medium'
            WHEN res_risk_score > 6e-2 AND res_risk_score <= 1e-1 THEN 'high'
            WHEN res_risk_score > 1e-1 AND res_risk_score <= 1e0 THEN 'very_high' END AS res_risk_level,
       round((1 - address_match) * 3e-1 + res_risk_score * 7e-1, 12) AS address_stability_risk
FROM geo_applied"""

ORACLE["geo_top_areas"] = with_(LOANS, GEO) + """
SELECT value, n, round(risk, 12) AS risk FROM geo WHERE feature = 'res' ORDER BY risk DESC, n DESC, value LIMIT 5"""

ORACLE["geo_summary"] = with_(LOANS, GEO) + """
SELECT feature, count(*) AS unique_values, round(min(risk), 12) AS min_risk, round(max(risk), 12) AS max_risk
FROM geo GROUP BY feature"""


# ======================================================== batch 2: history
def _hist_out(src: str) -> str:
    return f"""
SELECT serial_number, CAST(n_prev = 0 AS INTEGER) AS is_new_customer,
       CAST(CASE WHEN n_prev = 0 THEN 0 ELSE CAST(n_def > 0 AS INTEGER) END AS INTEGER) AS historical_default,
       CASE WHEN n_prev = 0 THEN 0e0 ELSE coalesce(last_od, 0e0) END AS prev_overdue_days,
       CASE WHEN n_prev = 0 THEN 0e0 ELSE coalesce(last_ratio, 0e0) END AS prev_payment_ratio,
       CAST(n_prev AS BIGINT) AS cumulative_loans, CAST(CASE WHEN n_prev = 0 THEN 0 ELSE n_def END AS BIGINT) AS cumulative_defaults,
       round(CASE WHEN n_prev = 0 THEN 0e0 ELSE n_def / n_prev END, 12) AS customer_default_rate
FROM {src}"""


HX = """
hx AS (SELECT *, CASE WHEN loan_term > 0 THEN CAST(coalesce(paid_installments, 0) AS DOUBLE) / loan_term ELSE 0e0 END AS ratio
       FROM labeled)"""

W1 = """
w1 AS (SELECT serial_number, id, default_flag,
              count(*) OVER (PARTITION BY id, CASE WHEN id IS NULL THEN serial_number END ORDER BY application_date, serial_number
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_prev,
              sum(default_flag) OVER (PARTITION BY id, CASE WHEN id IS NULL THEN serial_number END ORDER BY application_date, serial_number
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_def,
              lag(overdue_days) OVER (PARTITION BY id, CASE WHEN id IS NULL THEN serial_number END ORDER BY application_date, serial_number) AS last_od,
              lag(ratio) OVER (PARTITION BY id, CASE WHEN id IS NULL THEN serial_number END ORDER BY application_date, serial_number) AS last_ratio
       FROM hx)"""
ORACLE["client_history"] = with_(LOANS, HX, W1) + _hist_out("w1")


def _asof_pairs(actual: str, probes: str, lag: int) -> str:
    return f"""
pairs AS (SELECT x.serial_number AS s, e.serial_number AS es, e.application_date AS ed, e.default_flag AS ey,
                 e.overdue_days AS eod, e.ratio AS er
          FROM {probes} x JOIN {actual} e ON e.id = x.id AND e.application_date + {lag} <= x.application_date),
pagg AS (SELECT s, count(*) AS n_prev, sum(ey) AS n_def FROM pairs GROUP BY s),
plast AS (SELECT s, eod, er FROM pairs QUALIFY row_number() OVER (PARTITION BY s ORDER BY ed DESC, es DESC) = 1),
asof_h AS (SELECT x.serial_number, coalesce(a.n_prev, 0) AS n_prev, coalesce(a.n_def, 0) AS n_def,
                b.eod AS last_od, b.er AS last_ratio
         FROM {probes} x LEFT JOIN pagg a ON a.s = x.serial_number LEFT JOIN plast b ON b.s = x.serial_number)"""


ORACLE["client_history_asof"] = with_(LOANS, HX, _asof_pairs("hx", "hx", 30)) + _hist_out("asof_h")
_W3 = "PARTITION BY id, CASE WHEN id IS NULL THEN serial_number END ORDER BY application_date, serial_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
ORACLE["history_new_applications"] = with_(LOANS, HX, f"""
both3 AS (SELECT *, application_date < DATE '1997-01-01' AS known FROM hx),
w3 AS (SELECT serial_number, known, count(*) OVER ({_W3}) AS n_prev, count(CASE WHEN known THEN 1 END) OVER ({_W3}) AS n_known,
              coalesce(sum(CASE WHEN known THEN default_flag END) OVER ({_W3}), 0) AS n_def,
              last_value(CASE WHEN known THEN overdue_days END IGNORE NULLS) OVER ({_W3}) AS last_od,
              last_value(CASE WHEN known THEN ratio END IGNORE NULLS) OVER ({_W3}) AS last_ratio FROM both3),
h3 AS ({_hist_out("w3")} WHERE NOT known),
r3 AS (SELECT serial_number, round(CASE WHEN n_known > 0 THEN n_def / n_known ELSE 0e0 END, 12) AS rate FROM w3)""") + """
SELECT h3.* EXCLUDE (customer_default_rate), rate AS customer_default_rate FROM h3 JOIN r3 USING (serial_number)"""

ORACLE["client_repeat_stats"] = with_(LOANS, "rp AS (SELECT id, count(*) AS n FROM loans GROUP BY id)") + """
SELECT count(*) AS total_customers, count(CASE WHEN n > 1 THEN 1 END) AS repeat_customers,
       round(count(CASE WHEN n > 1 THEN 1 END) / count(*), 12) AS repeat_share FROM rp"""

ORACLE["default_rate_by_client_type"] = with_(LOANS, HX, W1) + """
SELECT CASE WHEN n_prev = 0 THEN 'new' WHEN n_def > 0 THEN 'repeat_defaulted' ELSE 'repeat_clean' END AS client_type,
       count(*) AS n, round(avg(default_flag), 12) AS default_rate
FROM w1 GROUP BY 1"""


# ========================================================= batch 2: splits
SPLIT_W4 = """
w4 AS (SELECT *, row_number() OVER (ORDER BY application_date, serial_number) AS rn, count(*) OVER () AS n FROM loans),
split_w4 AS (SELECT *, CASE WHEN rn <= floor(n * 7e-1) THEN 'train' WHEN rn <= floor(n * 7e-1) + floor(n * 15e-2) THEN 'val'
                            ELSE 'test' END AS split FROM w4)"""
ORACLE["split_chronological"] = with_(LOANS, SPLIT_W4) + " SELECT serial_number, split FROM split_w4"
ORACLE["split_stratified"] = with_(LOANS, SPLIT_X1) + " SELECT serial_number, split FROM split_x1"
SPLIT_X2 = """
x2 AS (SELECT *, floor(nc * 2e-1 + 5e-1) AS nt FROM strat),
split_x2 AS (SELECT *, CASE WHEN rk <= nt THEN 'test' WHEN rk <= nt + floor((nc - nt) * (1e-1 / (1e0 - 2e-1)) + 5e-1) THEN 'val'
                            ELSE 'train' END AS split FROM x2)"""
ORACLE["split_three_way"] = with_(LOANS, SPLIT_X1, SPLIT_X2) + " SELECT serial_number, split FROM split_x2"
ORACLE["split_kfold"] = with_(LOANS, SPLIT_X1) + " SELECT serial_number, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM strat"
ORACLE["undersample"] = with_(LOANS, SPLIT_X1) + """
SELECT serial_number, default_flag FROM strat WHERE rk <= (SELECT min(nc) FROM strat)"""
ORACLE["class_weights"] = with_(LOANS, """
cw AS (SELECT default_flag, count(*) AS n_class FROM labeled GROUP BY default_flag)""") + """
SELECT default_flag, n_class, round((SELECT sum(n_class) FROM cw) / ((SELECT count(*) FROM cw) * n_class), 12) AS balanced_weight,
       round((SELECT sum(n_class) FROM cw WHERE default_flag = 0) / (SELECT sum(n_class) FROM cw WHERE default_flag = 1), 12)
         AS scale_pos_weight
FROM cw"""
ORACLE["bounded_sample"] = with_(LOANS) + """
SELECT serial_number FROM loans ORDER BY md5(CAST(serial_number AS VARCHAR) || '|42'), serial_number LIMIT 1000"""


# ======================================================= batch 2: profiles
ORACLE["label_distribution"] = with_(LOANS, SPLIT_X1) + """
SELECT split, count(*) AS n, CAST(sum(default_flag) AS BIGINT) AS defaults, round(avg(default_flag), 12) AS default_rate
FROM split_x1 GROUP BY split"""

ORACLE["missing_counts"] = with_(LOANS) + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*), 12) AS missing_rate FROM loans"
    for c in LOAN_COLUMNS)

ORACLE["distinct_counts"] = with_(LOANS) + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_distinct FROM loans" for c in CATS + ["post_perm"])

ORACLE["time_range"] = with_(LOANS) + """
SELECT CAST(min(application_date) AS VARCHAR) AS min_date, CAST(max(application_date) AS VARCHAR) AS max_date,
       count(*) AS total_samples, CAST(date_diff('day', min(application_date), max(application_date)) AS INTEGER) AS date_range_days
FROM loans WHERE application_date IS NOT NULL"""

ORACLE["dataset_info"] = with_(LOANS, SPLIT_X1, SPLIT_X2) + """
SELECT count(*) AS total_samples, count(CASE WHEN split = 'train' THEN 1 END) AS train_samples,
       count(CASE WHEN split = 'val' THEN 1 END) AS val_samples, count(CASE WHEN split = 'test' THEN 1 END) AS test_samples,
       round(avg(default_flag), 12) AS default_rate, CAST(5 AS INTEGER) AS n_categorical, CAST(31 AS INTEGER) AS n_numeric,
       CAST(36 AS INTEGER) AS n_features
FROM split_x2"""

ORACLE["experiment_record"] = with_(LOANS, """
w4l AS (SELECT *, row_number() OVER (ORDER BY application_date, serial_number) AS rn, count(*) OVER () AS n FROM labeled),
split_w4 AS (SELECT *, CASE WHEN rn <= floor(n * 7e-1) THEN 'train' WHEN rn <= floor(n * 7e-1) + floor(n * 15e-2) THEN 'val'
                            ELSE 'test' END AS split FROM w4l),
te AS (SELECT score_p AS p, default_flag AS y FROM split_w4 WHERE split = 'test'),
tdv AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM te GROUP BY p),
em AS (SELECT
  (SELECT sum(a.pos * b.neg * CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 5e-1 ELSE 0e0 END)
          / ((SELECT sum(pos) FROM tdv) * (SELECT sum(neg) FROM tdv)) FROM tdv a, tdv b) AS auc,
  count(CASE WHEN p >= 5e-1 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p >= 5e-1 AND y <> 1 THEN 1 END) AS fp,
  count(CASE WHEN p < 5e-1 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN p < 5e-1 AND y <> 1 THEN 1 END) AS tn,
  -avg(y * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
       + (1 - y) * ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS log_loss
  FROM te),
emv AS (SELECT auc, log_loss, CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0e0 END AS accuracy,
               CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS precision,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall,
               CASE WHEN (tp + fn) + (tp + fp) > 0 THEN 2e0 * tp / ((tp + fn) + (tp + fp)) ELSE 0e0 END AS f1 FROM em)""") + """
SELECT 'exp-1' AS experiment_id, 'fixture_score' AS model_name, 'recent_5_years' AS dataset_version,
       'post_res,main_business,residence_status,education,product' AS features_used,
       (SELECT 'accuracy=' || printf('%.9f', round(accuracy, 9)) || ';auc=' || printf('%.9f', round(auc, 9))
               || ';f1=' || printf('%.9f', round(f1, 9)) || ';log_loss=' || printf('%.9f', round(log_loss, 9))
               || ';precision=' || printf('%.9f', round(precision, 9)) || ';recall=' || printf('%.9f', round(recall, 9))
        FROM emv) AS metrics,
       count(CASE WHEN split = 'train' THEN 1 END) AS train_samples, count(CASE WHEN split = 'val' THEN 1 END) AS val_samples,
       count(CASE WHEN split = 'test' THEN 1 END) AS test_samples,
       CAST(min(CASE WHEN split = 'train' THEN application_date END) AS VARCHAR) AS train_period_start,
       CAST(max(CASE WHEN split = 'train' THEN application_date END) AS VARCHAR) AS train_period_end,
       CAST(min(CASE WHEN split = 'val' THEN application_date END) AS VARCHAR) AS val_period_start,
       CAST(max(CASE WHEN split = 'val' THEN application_date END) AS VARCHAR) AS val_period_end,
       CAST(min(CASE WHEN split = 'test' THEN application_date END) AS VARCHAR) AS test_period_start,
       CAST(max(CASE WHEN split = 'test' THEN application_date END) AS VARCHAR) AS test_period_end
FROM split_w4"""

IMP_NUMS = ["month_salary", "job_tenure", "payment_progress_ratio", "job_stable", "address_match", "residence_stable", "dti_ratio",
            "payment_pressure", "total_overdue_count", "has_overdue", "early_overdue_count", "late_overdue_count",
            "overdue_worsening", "max_overdue_in_month", "overdue_std", "overdue_consistency", "overdue_frequency",
            "overdue_freq_ratio", "recent_overdue_severity", "max_consecutive_overdue", "overdue_acceleration",
            "critical_period_overdue", "late_stage_persistence", "late_stage_persistent_flag", "overdue_recovery",
            "overdue_improving", "early_warning_score", "early_warning_flag", "ema_overdue", "loan_term",
            "paid_installments"]
IMP = f"""
featl AS (SELECT l.*, {ROW_FEATURES}, {OVERDUE_SELECT} FROM labeled l),
imp AS (SELECT feature || '_woe' AS feature, iv AS importance FROM iv
        UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', coalesce(abs(corr(CAST({c} AS DOUBLE), CAST(default_flag AS DOUBLE))), 0e0) FROM featl" for c in IMP_NUMS) + """),
impc AS (SELECT *, CASE """ + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(feature), '{f}')" for f in frags) + f" THEN '{cat}'"
    for cat, frags in [
        ("Tier 2: Advanced Time Series", ["critical_period", "acceleration", "late_stage", "early_warning", "rolling",
                                          "ema", "recovery", "improving"]),
        ("Tier 1: Overdue Patterns", ["overdue_trend", "overdue_worsening", "max_consecutive", "overdue_frequency",
                                      "overdue_std", "late_overdue", "early_overdue", "total_overdue", "has_overdue",
                                      "recent_overdue"]),
        ("Customer History", ["historical", "prev_", "cumulative", "is_new_customer", "customer_default"]),
        ("WoE Encoded (Categorical)", ["woe"]),
        ("Financial Capability", ["dti", "payment_pressure", "salary", "job"])]) + """ ELSE 'Other Features' END AS category FROM imp)"""

ORACLE["importance_rollup"] = with_(LOANS, WOE, IV, IMP) + """
SELECT category, round(sum(importance), 6) AS total_importance, count(*) AS n_features, round(avg(importance), 6) AS avg_importance
FROM impc GROUP BY category"""

ORACLE["feature_ranking"] = with_(LOANS, WOE, IV, IMP) + """
SELECT feature, importance, rank, category, category_rank FROM (
  SELECT feature, importance, CAST(rank() OVER (ORDER BY importance DESC) AS INTEGER) AS rank, category,
         CAST(row_number() OVER (PARTITION BY category ORDER BY importance DESC, feature) AS INTEGER) AS category_rank
  FROM (SELECT feature, round(importance, 6) AS importance, category FROM impc)) WHERE category_rank <= 3"""


# ======================================================== batch 3: metrics
_FREQ = "(" + " + ".join(f"CAST(o{i} > 0 AS INTEGER)" for i in range(8)) + ") / 8e0"
SM = f"""
featm AS (SELECT serial_number, default_flag AS y, score_p, {_FREQ} AS freq FROM labeled),
sm AS (SELECT 'fixture_score' AS model, serial_number, y, score_p AS p FROM featm
       UNION ALL SELECT 'overdue_freq', serial_number, y, freq FROM featm
       UNION ALL SELECT 'soft_vote', serial_number, y, ((0e0 + score_p * 1e0) + freq * 1e0) / 2e0 FROM featm),
dv AS (SELECT model, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM sm GROUP BY model, p),
auc_u AS (SELECT a.model, sum(a.pos * b.neg * CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 5e-1 ELSE 0e0 END) AS u
          FROM dv a JOIN dv b ON a.model = b.model GROUP BY a.model),
auc_t AS (SELECT model, sum(pos) AS P, sum(neg) AS N FROM dv GROUP BY model),
auc AS (SELECT model, u / (P * N) AS auc FROM auc_u JOIN auc_t USING (model)),
pm AS (SELECT model, count(CASE WHEN p >= 5e-1 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN p >= 5e-1 AND y <> 1 THEN 1 END) AS fp,
              count(CASE WHEN p < 5e-1 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN p < 5e-1 AND y <> 1 THEN 1 END) AS tn
       FROM sm GROUP BY model),
pmm AS (SELECT *, CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0e0 END AS accuracy,
               CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS precision,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall,
               CASE WHEN (tp + fn) + (tp + fp) > 0 THEN 2e0 * tp / ((tp + fn) + (tp + fp)) ELSE 0e0 END AS f1,
               CASE WHEN 4e0 * (tp + fn) + (tp + fp) > 0 THEN 5e0 * tp / (4e0 * (tp + fn) + (tp + fp)) ELSE 0e0 END AS f2
        FROM pm),
ll AS (SELECT model, -avg(y * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
                         + (1 - y) * ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS log_loss
       FROM sm GROUP BY model)"""

ORACLE["auc"] = with_(LOANS, SM) + " SELECT model, round(auc, 12) AS auc FROM auc"
ORACLE["point_metrics"] = with_(LOANS, SM) + """
SELECT model, tp, fp, fn, tn, round(accuracy, 12) AS accuracy, round(precision, 12) AS precision, round(recall, 12) AS recall,
       round(f1, 12) AS f1, round(f2, 12) AS f2 FROM pmm"""
ORACLE["log_loss"] = with_(LOANS, SM) + " SELECT model, round(log_loss, 9) AS log_loss FROM ll"

ORACLE["confusion_matrix"] = with_(LOANS, GRID, THRESH, """
cth AS (SELECT 'default' AS threshold_name, 5e-1 AS t UNION ALL SELECT 'optimal', threshold FROM ts_best),
cells AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted)),
cc AS (SELECT threshold_name, default_flag AS actual, CAST(score_p >= t AS INTEGER) AS predicted, count(*) AS n
       FROM labeled, cth GROUP BY ALL)""") + """
SELECT cth.threshold_name, CAST(cells.actual AS INTEGER) AS actual, CAST(cells.predicted AS INTEGER) AS predicted,
       coalesce(cc.n, 0) AS n
FROM cth CROSS JOIN cells LEFT JOIN cc ON cc.threshold_name = cth.threshold_name AND cc.actual = cells.actual
     AND cc.predicted = cells.predicted"""

ORACLE["class_report"] = with_(LOANS, """
cr0 AS (SELECT count(CASE WHEN score_p >= 5e-1 AND default_flag = 1 THEN 1 END) AS tp,
               count(CASE WHEN score_p >= 5e-1 AND default_flag <> 1 THEN 1 END) AS fp,
               count(CASE WHEN score_p < 5e-1 AND default_flag = 1 THEN 1 END) AS fn,
               count(CASE WHEN score_p < 5e-1 AND default_flag <> 1 THEN 1 END) AS tn FROM labeled),
crc AS (SELECT '0' AS label, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0e0 END AS precision,
               CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0e0 END AS recall,
               CASE WHEN 2 * tn + fn + fp > 0 THEN 2e0 * tn / (2 * tn + fn + fp) ELSE 0e0 END AS f1, tn + fp AS support FROM cr0
        UNION ALL
        SELECT '1', CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END,
               CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0e0 END, tp + fn FROM cr0),
crall AS (SELECT * FROM crc
          UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM crc
          UNION ALL SELECT 'weighted avg', sum(precision * (support / (SELECT sum(support) FROM crc))),
                           sum(recall * (support / (SELECT sum(support) FROM crc))),
                           sum(f1 * (support / (SELECT sum(support) FROM crc))), sum(support) FROM crc)""") + """
SELECT label, round(precision, 12) AS precision, round(recall, 12) AS recall, round(f1, 12) AS f1,
       CAST(support AS BIGINT) AS support FROM crall"""

ORACLE["threshold_curve"] = with_(LOANS, GRID, THRESH) + """
SELECT i, threshold, CAST(tp AS BIGINT) AS tp, CAST(pp AS BIGINT) AS pp, round(precision, 12) AS precision,
       round(recall, 12) AS recall, round(f1, 12) AS f1, round(f2, 12) AS f2,
       round((precision + recall) / 2, 12) AS balanced FROM ts_m"""

ORACLE["model_comparison"] = with_(LOANS, SM, """
mc AS (SELECT model, auc, accuracy, precision, recall, f1, log_loss FROM auc JOIN pmm USING (model) JOIN ll USING (model))""") + """
SELECT model, 'test' AS split, metric, round(value, 9) AS value FROM (
  SELECT model, 'auc' AS metric, auc AS value FROM mc UNION ALL SELECT model, 'accuracy', accuracy FROM mc
  UNION ALL SELECT model, 'precision', precision FROM mc UNION ALL SELECT model, 'recall', recall FROM mc
  UNION ALL SELECT model, 'f1', f1 FROM mc UNION ALL SELECT model, 'log_loss', log_loss FROM mc)"""

ORACLE["best_model_report"] = with_(LOANS, SM) + """
SELECT model AS best_model, round(auc, 12) AS best_auc,
       CASE WHEN round(auc, 12) >= 85e-2 THEN 'ready to deploy' WHEN round(auc, 12) >= 75e-2 THEN 'tune further' ELSE 'retrain' END
         AS recommendation
FROM auc ORDER BY round(auc, 12) DESC, CASE WHEN model = 'soft_vote' THEN 0 ELSE 1 END, model LIMIT 1"""

MT = """
mt_tot AS (SELECT model, sum(y) AS P, count(*) AS N FROM sm GROUP BY model),
mt_cnt AS (SELECT model, i, threshold, sum(CASE WHEN p >= threshold AND y = 1 THEN 1 ELSE 0 END) AS tp,
                  sum(CASE WHEN p >= threshold THEN 1 ELSE 0 END) AS pp FROM grid, sm GROUP BY model, i, threshold),
mt_m AS (SELECT c.*, t.P, CASE WHEN 4e0 * t.P + c.pp > 0 THEN 5e0 * c.tp / (4e0 * t.P + c.pp) ELSE 0e0 END AS f2,
                CASE WHEN t.P + c.pp > 0 THEN 2e0 * c.tp / (t.P + c.pp) ELSE 0e0 END AS f1,
                CASE WHEN c.pp > 0 THEN c.tp / c.pp ELSE 0e0 END AS precision,
                CASE WHEN t.P > 0 THEN c.tp / t.P ELSE 0e0 END AS recall
         FROM mt_cnt c JOIN mt_tot t USING (model)),
mt_best AS (SELECT * FROM mt_m QUALIFY row_number() OVER (PARTITION BY model ORDER BY f2 DESC, i) = 1)"""
ORACLE["recommended_threshold"] = with_(LOANS, GRID, SM, MT) + """
SELECT model, threshold, round(f2, 12) AS f2_score, round(recall, 12) AS recall, round(precision, 12) AS precision,
       round(f1, 12) AS f1, CAST(model = 'soft_vote' AS INTEGER) AS recommended FROM mt_best"""

ORACLE["soft_vote"] = with_(LOANS, SM) + """
SELECT serial_number, round(((0e0 + score_p * 2e0) + freq * 1e0) / 3e0, 12) AS p_vote FROM featm"""

ORACLE["brier_aucpr"] = with_(LOANS, SM, """
br AS (SELECT model, avg((p - y) * (p - y)) AS brier FROM sm GROUP BY model),
apc AS (SELECT model, pos, sum(pos) OVER (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
               sum(pos + neg) OVER (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cpp
        FROM dv),
ap AS (SELECT model, sum(pos * (ctp / cpp)) / sum(pos) AS auc_pr FROM apc GROUP BY model)""") + """
SELECT model, round(brier * (1 + 1e-12), 9) AS brier, round(auc_pr * (1 + 1e-12), 9) AS auc_pr FROM br JOIN ap USING (model)"""


# ================================================== batch 3: score outputs
_SC = (LOANS, GRID, THRESH, SCORED)
_KEY = """serial_number, CAST(application_date AS VARCHAR) AS application_date, id, default_probability, risk_score,
       risk_grade, risk_action, risk_action_optimal, risk_alert, predicted_default, predicted_default_optimal,
       threshold_difference"""
ORACLE["score_output_contract"] = with_(*_SC) + f" SELECT {_KEY} FROM scored"
ORACLE["simplified_output"] = with_(*_SC) + f" SELECT {_KEY}, early_warning_flag, overdue_worsening FROM scored"
ORACLE["score_export"] = with_(*_SC) + """
SELECT serial_number AS "serial number", CAST(application_date AS VARCHAR) AS "application date", id AS "ID",
       default_probability, risk_score, risk_grade, risk_action_optimal, risk_alert FROM scored"""

ORACLE["grade_legend"] = with_(*_SC, """
gd AS (SELECT * FROM (VALUES (0, 'A', 'A (Excellent)', 'LOW RISK', 'Very Low Risk'),
                             (1, 'B', 'B (Moderate)', 'MEDIUM-HIGH RISK', 'Moderate Risk'),
                             (2, 'C', 'C (Warning)', 'HIGH RISK', 'High Risk'),
                             (3, 'D', 'D (Poor)', 'VERY HIGH RISK', 'Very High Risk'),
                             (4, 'E', 'E (Critical)', 'CRITICAL RISK', 'Critical Risk'))
       v(grade_order, grade_letter, risk_grade, risk_alert, risk_label)),
gcut AS (SELECT CAST(trunc((1 - threshold) * 100) AS INTEGER) AS a FROM ts_best),
gn AS (SELECT risk_grade, count(*) AS n FROM scored GROUP BY risk_grade)""") + """
SELECT CAST(grade_order AS INTEGER) AS grade_order, grade_letter, gd.risk_grade, risk_alert, risk_label,
       CAST(CASE grade_order WHEN 0 THEN a WHEN 1 THEN 60 WHEN 2 THEN 40 WHEN 3 THEN 20 ELSE 0 END AS INTEGER) AS score_min,
       CAST(CASE grade_order WHEN 0 THEN 100 WHEN 1 THEN a - 1 WHEN 2 THEN 59 WHEN 3 THEN 39 ELSE 19 END AS INTEGER) AS score_max,
       coalesce(gn.n, 0) AS n_loans
FROM gd CROSS JOIN gcut LEFT JOIN gn ON gn.risk_grade = gd.risk_grade"""

ORACLE["grade_translation"] = with_(*_SC) + """
SELECT serial_number, substr(risk_grade, 1, 1) AS grade_letter,
       CASE substr(risk_grade, 1, 1) WHEN 'A' THEN 'Very Low Risk' WHEN 'B' THEN 'Moderate Risk' WHEN 'C' THEN 'High Risk'
            WHEN 'D' THEN 'Very High Risk' WHEN 'E' THEN 'Critical Risk' ELSE substr(risk_grade, 1, 1) END AS risk_label,
       CAST(round_even(month_salary / 31e-3, 0) AS BIGINT) AS salary_converted FROM scored"""

ORACLE["batch_summary"] = with_(*_SC) + """
SELECT count(*) AS n, """ + ", ".join(
    f"count(CASE WHEN risk_grade = '{g}' THEN 1 END) AS grade_{g[0]}"
    for g in ["A (Excellent)", "B (Moderate)", "C (Warning)", "D (Poor)", "E (Critical)"]) + """,
       round_even(max(default_probability) * 100e0, 0) / 100e0 AS max_probability,
       round_even(min(default_probability) * 100e0, 0) / 100e0 AS min_probability,
       round_even(avg(default_probability) * 100e0, 0) / 100e0 AS avg_probability FROM scored"""

_DIMS = ["risk_grade", "risk_action", "risk_action_optimal", "predicted_default", "predicted_default_optimal",
         "threshold_difference"]
ORACLE["prediction_summary"] = with_(*_SC, "psd AS (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS n FROM scored GROUP BY {d}" for d in _DIMS)
    + ")") + """
SELECT dimension, value, n, round(n / sum(n) OVER (PARTITION BY dimension), 12) AS share FROM psd"""

ORACLE["business_metrics"] = with_(*_SC) + """
SELECT risk_grade, count(*) AS n, round(avg(CAST(predicted_default_optimal = 0 AS DOUBLE)), 12) AS approval_rate,
       round(avg(default_flag), 12) AS default_rate FROM scored GROUP BY risk_grade"""


# ================================================= batch 3: client scoring
CP = f"""
cp AS (SELECT c.*, avg(is_default) OVER (PARTITION BY job_category) AS p_job,
              avg(is_default) OVER (PARTITION BY education_level) AS p_education,
              avg(is_default) OVER (PARTITION BY employment_status) AS p_employment FROM clients c),
cb AS (SELECT *, ((0e0 + p_job) + p_education) + p_employment AS psum, len({ELIG_LIST}) = 0 AS ok FROM cp),
cb2 AS (SELECT *, psum / 3e0 AS mp, CAST(trunc((1 - psum / 3e0) * 100) AS INTEGER) AS rs FROM cb)"""
ORACLE["client_batch_scoring"] = with_(CLIENTS, CP) + """
SELECT customer_id AS client_id, CASE WHEN ok THEN rs ELSE 0 END AS risk_score,
       CASE WHEN NOT ok THEN 'ERROR' WHEN mp >= 5e-1 THEN 'Bad' ELSE 'Good' END AS risk_category,
       CASE WHEN NOT ok THEN 'ERROR' WHEN rs >= 80 AND rs <= 100 THEN 'EXCELLENT' WHEN rs >= 60 AND rs <= 79 THEN 'GOOD'
            WHEN rs >= 40 AND rs <= 59 THEN 'FAIR' WHEN rs >= 20 AND rs <= 39 THEN 'POOR' ELSE 'BAD' END AS score_grade,
       round(CASE WHEN ok THEN mp ELSE 1e0 END, 12) AS default_probability,
       round(CASE WHEN ok THEN p_job ELSE 1e0 END, 12) AS p_job,
       round(CASE WHEN ok THEN p_education ELSE 1e0 END, 12) AS p_education,
       round(CASE WHEN ok THEN p_employment ELSE 1e0 END, 12) AS p_employment,
       CAST(ok AS INTEGER) AS is_valid,
       CASE WHEN (CASE WHEN ok THEN mp ELSE 1e0 END) >= 5e-1 THEN 'Bad' ELSE 'Good' END AS classification
FROM cb2"""

ORACLE["risk_adjusted_score"] = with_(CLIENTS, CP, """
ra AS (SELECT customer_id, 300e0 + 550e0 * (1 - mp) AS base,
              CASE WHEN age <= 25 THEN 15e-2 WHEN age <= 35 THEN 5e-2 WHEN age <= 50 THEN 0e0 WHEN age <= 65 THEN -5e-2 ELSE 1e-1 END AS aa,
              CASE employment_status WHEN 1 THEN 1e0 WHEN 2 THEN 12e-1 WHEN 3 THEN 15e-1 WHEN 4 THEN 2e0 ELSE 1e0 END AS em,
              CASE education_level WHEN 1 THEN 2e-1 WHEN 2 THEN 1e-1 WHEN 3 THEN 0e0 WHEN 4 THEN -5e-2 WHEN 5 THEN -1e-1 ELSE 0e0 END AS ea
       FROM cb2)""") + """
SELECT customer_id, round(base, 9) AS base_score,
       round(greatest(300e0, least(850e0, base * em + (aa + ea) * 100)), 9) AS adjusted_score FROM ra"""

ORACLE["provision_tiers"] = with_(CLIENTS, CP, """
pt AS (SELECT loan_amount, CASE WHEN mp < 2e-2 THEN 0 WHEN mp < 5e-2 THEN 1 WHEN mp < 1e-1 THEN 2 WHEN mp < 2e-1 THEN 3
                                WHEN mp < 35e-2 THEN 4 WHEN mp < 6e-1 THEN 5 ELSE 6 END AS k FROM cb2),
tiers AS (SELECT * FROM (VALUES (0, 'Excellent', 'Maintain', 'Annual', 1e-3), (1, 'Good', 'Maintain', 'Annual', 5e-3),
                                (2, 'Satisfactory', 'Monitor', 'Semi-Annual', 1e-2), (3, 'Watch', 'Enhanced Monitor', 'Quarterly', 3e-2),
                                (4, 'Substandard', 'Restructure', 'Monthly', 1e-1), (5, 'Doubtful', 'Workout', 'Weekly', 5e-1),
                                (6, 'Loss', 'Write-off', 'Daily', 1e0)) v(k, tier, portfolio_action, review_frequency, provision_rate))""") + """
SELECT tier, portfolio_action, review_frequency, provision_rate, count(*) AS n, round(sum(loan_amount), 6) AS exposure,
       round(sum(loan_amount * provision_rate), 6) AS provision
FROM pt JOIN tiers USING (k) GROUP BY ALL"""

ORACLE["auto_decision"] = with_(CLIENTS) + """
SELECT customer_id, CASE
  WHEN debt_to_income_ratio > 6e-1 OR late_payments_count >= 6 OR coalesce(credit_history_months, 0) = 0 THEN 'reject'
  WHEN (late_payments_count > 3 OR missed_payments_count > 1)
       AND (annual_income >= 100000 OR on_time_payment_rate >= 95e-2 OR credit_utilization_rate < 3e-1) THEN 'conditional'
  WHEN late_payments_count > 3 OR missed_payments_count > 1 THEN 'review' ELSE 'approve' END AS decision
FROM clients"""


ORACLE["auto_decision_history"] = with_(CLIENTS, """
adh AS (SELECT *, CASE WHEN customer_id % 11 = 0 THEN customer_id % 7 END AS bankrupt, CASE WHEN customer_id % 13 = 0 THEN customer_id % 8 END AS foreclosed,
               CASE WHEN customer_id % 5 <> 0 THEN (customer_id * 19) % 60 END AS employed FROM clients)""") + """
SELECT customer_id, CASE
  WHEN debt_to_income_ratio > 6e-1 OR late_payments_count >= 6 OR coalesce(credit_history_months, 0) = 0
       OR coalesce(bankrupt, 99) <= 2 OR coalesce(foreclosed, 99) <= 3 THEN 'reject'
  WHEN (late_payments_count > 3 OR missed_payments_count > 1)
       AND (annual_income >= 100000 OR on_time_payment_rate >= 95e-2 OR credit_utilization_rate < 3e-1 OR coalesce(employed, 0) >= 24) THEN 'conditional'
  WHEN late_payments_count > 3 OR missed_payments_count > 1 THEN 'review' ELSE 'approve' END AS decision
FROM adh"""


# ======================================================== batch 3: monitor
SCREEN = ["annual_income", "loan_amount", "credit_history_months", "total_credit_limit", "on_time_payment_rate",
          "credit_utilization_rate", "savings_to_income_ratio", "debt_to_income_ratio", "monthly_income"]
ORACLE["feature_variance"] = with_(CLIENTS) + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_samp({c}), 3) AS variance, CAST(coalesce(var_samp({c}), 0e0) < 1e-2 AS INTEGER) AS low_variance FROM clients"
    for c in SCREEN)
_PAIRS = [(a, b) for i, a in enumerate(SCREEN) for b in SCREEN[i + 1:]]
ORACLE["feature_correlation"] = with_(CLIENTS, "fc AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM clients" for a, b in _PAIRS) + ")") + """
SELECT feature_a, feature_b, round(corr, 6) AS corr FROM fc WHERE abs(corr) > 95e-2"""

_FS = ["debt_to_income_ratio", "late_payments_count", "missed_payments_count", "on_time_payment_rate", "savings_to_income_ratio",
       "credit_utilization_rate", "is_default", "annual_income", "monthly_income", "loan_amount", "loan_term_months",
       "credit_history_months", "total_credit_limit", "previous_loans_count", "avg_monthly_balance", "age", "half_income", "tiny"]
ORACLE["feature_selection"] = "WITH RECURSIVE " + CLIENTS.strip() + """,
fsc AS (SELECT *, annual_income / 2 + age AS half_income, credit_utilization_rate / 10 AS tiny FROM clients),
fsv AS (""" + " UNION ALL ".join(f"SELECT {i + 1} AS i, '{c}' AS f, coalesce(var_samp({c}), 0e0) AS v FROM fsc" for i, c in enumerate(_FS)) + """),
fsr AS (""" + " UNION ALL ".join(f"SELECT {i + 1} AS i, {j + 1} AS j, corr({a}, {b}) AS c FROM fsc"
                                 for i, a in enumerate(_FS) for j, b in enumerate(_FS) if j < i) + """),
near AS (SELECT i, list(j ORDER BY j) AS js FROM fsr WHERE abs(c) > 95e-2 GROUP BY i),
walk AS (
  SELECT 0 AS i, CAST([] AS INTEGER[]) AS kept, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS INTEGER) AS partner
  UNION ALL
  SELECT n.i, CASE WHEN n.reason IS NULL THEN list_append(n.kept, n.i) ELSE n.kept END, n.reason, n.partner FROM (
    SELECT v.i, w.kept, CASE WHEN v.v < 1e-2 THEN 'variance'
                             WHEN len(list_intersect(coalesce(x.js, CAST([] AS INTEGER[])), w.kept)) > 0 THEN 'correlation'
                             WHEN len(w.kept) >= 12 THEN 'limit' END AS reason,
           CASE WHEN v.v >= 1e-2 THEN list_min(list_intersect(coalesce(x.js, CAST([] AS INTEGER[])), w.kept)) END AS partner
    FROM walk w JOIN fsv v ON v.i = w.i + 1 LEFT JOIN near x ON x.i = v.i) n)
SELECT w.i AS position, v.f AS feature, CAST(reason IS NULL AS INTEGER) AS kept, reason, p.f AS partner
FROM walk w JOIN fsv v ON v.i = w.i LEFT JOIN fsv p ON p.i = w.partner"""

ORACLE["outlier_capping"] = with_(CLIENTS, f"qq AS (SELECT {_OUT} FROM clients)") + " SELECT customer_id, " + ", ".join(
    f"round(least(greatest({c}, {c}_q1 - 15e-1 * ({c}_q3 - {c}_q1)), {c}_q3 + 15e-1 * ({c}_q3 - {c}_q1)), 9) AS {c}"
    for c in ["annual_income", "loan_amount", "debt_to_income_ratio"]) + " FROM clients, qq"

_DQC = ["serial_number", "id", "application_date", "overdue_status", "overdue_days", "education", "main_business", "residence_status",
        "product", "salary_raw", "month_salary", "job_tenure", "post_perm", "post_res", "loan_term", "paid_installments",
        "debt_to_income_ratio", "payment_to_income_ratio", *[f"o{i}" for i in range(8)], "default_flag"]
ORACLE["data_quality"] = with_(LOANS, "dq AS (SELECT count(*) AS n, avg(default_flag) AS pos FROM labeled)") + " " + " UNION ALL ".join(
    [f"SELECT 'drop_column_missing_gt_50pct' AS check, '{c}' AS subject, round((count(*) - count({c})) / count(*), 9) AS value, "
     f"CAST((count(*) - count({c})) / count(*) <= 5e-1 AS INTEGER) AS passed FROM labeled" for c in _DQC]
    + [f"SELECT 'missing_alert_gt_10pct', '{c}', round((count(*) - count({c})) / count(*), 9), "
       f"CAST((count(*) - count({c})) / count(*) <= 1e-1 AS INTEGER) FROM labeled" for c in _DQC]
    + ["SELECT 'min_rows', 'table', round(CAST(n AS DOUBLE), 9), CAST(n >= 1000 AS INTEGER) FROM dq",
       "SELECT 'min_positive_share', 'default_flag', round(pos, 9), CAST(pos >= 5e-2 AS INTEGER) FROM dq",
       "SELECT 'min_rows_per_year', CAST(year(application_date) AS VARCHAR), round(CAST(count(*) AS DOUBLE), 9), "
       "CAST(count(*) >= 1000 AS INTEGER) FROM labeled GROUP BY year(application_date)"])

ORACLE["monitoring_alerts"] = with_(LOANS, """
w4l AS (SELECT *, row_number() OVER (ORDER BY application_date, serial_number) AS rn, count(*) OVER () AS n FROM labeled),
s4 AS (SELECT *, CASE WHEN rn <= floor(n * 7e-1) THEN 'train' WHEN rn <= floor(n * 7e-1) + floor(n * 15e-2) THEN 'val'
                      ELSE 'test' END AS split FROM w4l),
te AS (SELECT score_p AS p, default_flag AS y FROM s4 WHERE split = 'test'),
tr AS (SELECT score_p AS p, default_flag AS y FROM s4 WHERE split = 'train'),
tdv AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM te GROUP BY p),
tauc AS (SELECT sum(a.pos * b.neg * CASE WHEN a.p > b.p THEN 1e0 WHEN a.p = b.p THEN 5e-1 ELSE 0e0 END)
                / ((SELECT sum(pos) FROM tdv) * (SELECT sum(neg) FROM tdv)) AS auc FROM tdv a, tdv b),
tacc AS (SELECT avg(CAST((p >= 5e-1) = (y = 1) AS DOUBLE)) AS accuracy,
                -avg(y * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
                     + (1 - y) * ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS log_loss FROM te),
eb AS (SELECT least(floor(p * 10), 9) AS bin, count(*) / (SELECT count(*) FROM tr) AS e FROM tr GROUP BY 1),
ab AS (SELECT least(floor(p * 10), 9) AS bin, count(*) / (SELECT count(*) FROM te) AS a FROM te GROUP BY 1),
psi AS (SELECT sum((greatest(coalesce(a, 0e0), 1e-4) - greatest(coalesce(e, 0e0), 1e-4))
                   * ln(greatest(coalesce(a, 0e0), 1e-4) / greatest(coalesce(e, 0e0), 1e-4))) AS psi
        FROM eb FULL OUTER JOIN ab USING (bin))""") + """
SELECT CAST(auc < 75e-2 AS INTEGER) AS alert_auc, CAST(accuracy < 8e-1 AS INTEGER) AS alert_accuracy,
       CAST(log_loss > 5e-1 AS INTEGER) AS alert_log_loss,
       CAST(abs((SELECT avg(y) FROM te) - (SELECT avg(y) FROM tr)) > 5e-2 AS INTEGER) AS alert_default_rate,
       CAST(psi > 1e-1 AS INTEGER) AS alert_drift, round(psi, 9) AS psi
FROM tauc, tacc, psi"""

ORACLE["temporal_features"] = with_(LOANS, "tref AS (SELECT max(application_date) AS r FROM loans)") + """
SELECT serial_number, CAST(year(application_date) AS INTEGER) AS year, CAST(month(application_date) AS INTEGER) AS month,
       CAST(quarter(application_date) AS INTEGER) AS quarter, CAST(dayofyear(application_date) AS INTEGER) AS day_of_year,
       CAST(date_diff('day', application_date, r) AS INTEGER) AS days_since_application,
       CAST(12 * (year(r) - year(application_date)) + (month(r) - month(application_date))
            - CASE WHEN day(r) < day(application_date)
                        AND NOT (r = last_day(r) AND application_date = last_day(application_date)) THEN 1 ELSE 0 END
            AS INTEGER) AS months_since_application
FROM loans, tref"""

ORACLE["overdue_long"] = with_(LOANS) + f"""
SELECT serial_number, CAST({_ALL} AS DOUBLE) AS total_overdue_count, CAST(greatest({_G}) AS DOUBLE) AS max_overdue_in_month,
       CAST({_POS([f"o{i}" for i in range(8)])} AS BIGINT) AS overdue_frequency,
       round(sqrt(({_SS}) / 7e0), 9) AS overdue_std, round({_EMA}, 9) AS ema_overdue,
       round({_L} / 3e0, 9) AS rolling_3m_overdue_avg,
       CAST(list_max(list_transform(string_split({_BITS}, '0'), lambda x: length(x))) AS BIGINT) AS max_consecutive_overdue
FROM loans"""


# ====================================================== streaming re-aims
ORACLE["stream_scoring"] = ORACLE["risk_scoring"]

ORACLE["stream_overdue_features"] = """
WITH ev AS (SELECT user_id, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01 00:00:00') / (90 * 3600)) AS INTEGER) AS period
            FROM events WHERE event_type = 'error'),
cnt AS (SELECT user_id, period, count(*) AS n FROM ev WHERE period >= 0 AND period < 8 GROUP BY ALL),
w AS (SELECT user_id, """ + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN period = {i} THEN n END), 0) AS BIGINT) AS o{i}" for i in range(8)) + """
      FROM cnt GROUP BY user_id)
SELECT user_id, o0, o1, o2, o3, o4, o5, o6, o7, """ + f"""{_ALL} AS total_overdue_count,
       CAST(list_max(list_transform(string_split({_BITS}, '0'), lambda x: length(x))) AS INTEGER) AS max_consecutive_overdue,
       CAST((o0 + o1 + o2) >= 3 AS INTEGER) AS early_warning_flag, CAST({_L} - {_E} > 0 AS INTEGER) AS overdue_worsening,
       round({_EMA}, 9) AS ema_overdue
FROM w"""

ORACLE["stream_overdue_counts"] = """
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01 00:00:00') / (90 * 3600)) AS INTEGER) AS period,
       CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error' GROUP BY ALL"""


# ======================================================== sources / sinks
ORACLE["csv_roundtrip"] = ORACLE["score_export"]
ORACLE["loan_source"] = with_(LOANS) + """
SELECT serial_number, id, CAST(application_date AS VARCHAR) AS application_date, overdue_status, month_salary, post_res,
       loan_term, o0, o1, o2, o3, o4, o5, o6, o7 FROM loans"""
ORACLE["metrics_sink"] = ORACLE["model_comparison"]
ORACLE["threshold_config"] = with_(LOANS, GRID, THRESH) + """
SELECT 'saved' AS source, threshold AS optimal_threshold FROM ts_best UNION ALL SELECT 'missing', 5e-1"""
_J, _C = _lookup_joins("labeled", "wall", "woe", "woe", "0e0")
ORACLE["encoder_persistence"] = with_(LOANS, woe_ctes("labeled", "wall")) + f"""
SELECT serial_number, {', '.join(f'round({c}_woe, 9) AS {c}_woe' for c in CATS)} FROM (
  SELECT labeled.serial_number, {_C} FROM labeled {_J})"""


# ===================================================================== ML
ORACLE["robust_scale"] = with_(CLIENTS, "rq AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_s"
    for c in ["annual_income", "loan_amount", "credit_history_months"]) + " FROM clients)") + " SELECT customer_id, " + ", ".join(
    f"round(({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1e0 ELSE {c}_s END, 9) AS {c}"
    for c in ["annual_income", "loan_amount", "credit_history_months"]) + " FROM clients, rq"

_OH = {"residence_status": ["dormitory", "family", "owned", "rented", "spouse"],
       "product": ["P0", "P1", "P2", "P3", "P4", "P5"],
       "education": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "missing"]}
ORACLE["one_hot"] = with_(LOANS) + " SELECT serial_number, " + ", ".join(
    f"CAST(coalesce(CAST({c} AS VARCHAR), 'missing') = '{x}' AS INTEGER) AS \"{c}__{x}\""
    for c, levels in _OH.items() for x in levels[1:]) + " FROM loans"

_SP = ["residence_status", "product", "education", "id"]
ORACLE["one_hot_sparse"] = with_(LOANS, *[
    f"sl{i} AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'missing') AS v FROM loans))"
    for i, c in enumerate(_SP)], "so AS (SELECT " + ", ".join(f"(SELECT max(n) FROM sl{i}) AS n{i}" for i in range(4)) + ")") + " " + " UNION ALL ".join(
    f"SELECT l.serial_number, CAST(n - r + {' + '.join(['0'] + [f'so.n{j} - 1' for j in range(i)])} AS BIGINT) AS position "
    f"FROM loans l JOIN sl{i} ON v = coalesce(CAST({c} AS VARCHAR), 'missing'), so WHERE r > 1" for i, c in enumerate(_SP))

ORACLE["linear_attribution"] = with_(CLIENTS) + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(abs({w} * ({c} - (SELECT avg({c}) FROM clients)))), 9) AS importance FROM clients"
    for c, w in {"annual_income": "2e-5", "loan_amount": "-5e-5", "debt_to_income_ratio": "3e0", "late_payments_count": "75e-2",
                 "credit_utilization_rate": "-125e-2"}.items())


# ======================================================= remaining rows
ORACLE["crm_enrichment"] = with_(LOANS, CLIENTS) + """
SELECT l.serial_number, l.id, c.age, c.annual_income, c.job_category FROM loans l LEFT JOIN clients c ON c.customer_id = l.id"""
ORACLE["crm_match_rate"] = with_(LOANS, CLIENTS) + """
SELECT 'crm' AS source, count(*) AS total, count(c.customer_id) AS matched, round(count(c.customer_id) / count(*), 12) AS match_rate
FROM loans l LEFT JOIN clients c ON c.customer_id = l.id"""

_MN = [*IMP_NUMS, "is_new_customer", "historical_default", "prev_overdue_days", "prev_payment_ratio",
       "cumulative_loans", "cumulative_defaults", "customer_default_rate"]
_J, _C = _lookup_joins("featm2", "wall", "woe", "woe", "0e0")
ORACLE["model_matrix"] = with_(LOANS, woe_ctes("labeled", "wall"), HX, W1, f"""
whist AS ({_hist_out("w1")}),
featm2 AS (SELECT l.*, {ROW_FEATURES}, {OVERDUE_SELECT}, h.* EXCLUDE (serial_number) FROM labeled l JOIN whist h USING (serial_number)),
mm AS (SELECT featm2.*, {_C} FROM featm2 {_J})""") + " SELECT serial_number, " + ", ".join(
    f"round(coalesce(CAST({c} AS DOUBLE), 0e0), 9) AS {c}" for c in _MN + [f"{c}_woe" for c in CATS]) + " FROM mm"

ORACLE["client_model_input"] = with_(CLIENTS) + """
SELECT customer_id, coalesce(debt_to_income_ratio, CASE WHEN annual_income <> 0 THEN loan_amount / annual_income END)
       AS debt_to_income_ratio, annual_income, loan_amount FROM clients"""

ORACLE["outlier_capping_zscore"] = with_(CLIENTS, "zs AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in ["annual_income", "loan_amount", "debt_to_income_ratio"])
    + " FROM clients)") + " SELECT customer_id, " + ", ".join(
    f"round(least(greatest({c}, {c}_m - 3e0 * {c}_s), {c}_m + 3e0 * {c}_s), 6) AS {c}"
    for c in ["annual_income", "loan_amount", "debt_to_income_ratio"]) + " FROM clients, zs"


ORACLE["upload_scoring"] = with_(*_SC) + """
SELECT serial_number, id, default_probability, risk_score, risk_grade, risk_alert, risk_action, risk_action_optimal,
       0e0 AS payment_pressure FROM scored"""


_UP = {
    "education": [("Grad+", "研究所以上"), ("Master", "碩士"), ("College/Univ", "專科/大學"), ("University", "大學"), ("College", "專科"),
                  ("HS/Voc", "高中/職"), ("High School", "高中"), ("Elementary", "小學"), ("Other", "其他"), (" HS/Voc ", "高中/職"), ("PhD", None)],
    "residence_status": [("Owned", "自有"), ("Rented", "租屋"), ("Spouse", "配偶"), ("Family", "親屬"), ("Dormitory", "宿舍"), (" Owned", "自有"),
                         ("Tent", None)],
    "main_business": [("Manufacturing", "製造業"), ("Services", "服務業"), ("Commerce", "商業"), ("Tech", "科技業"), ("Finance", "金融業"),
                      ("Insurance", "保險業"), ("Securities", "證券及期貨業"), ("Gov/Education", "公教人員"), ("Military", "軍人"), ("F&B", "餐飲業"),
                      ("Transport", "運輸業"), ("Construction", "營造業"), ("Real Estate", "不動產業"), ("Warehousing", "倉儲業"), ("Telecom", "通信業"),
                      ("Utilities", "水電燃氣業"), ("Agriculture", "農牧林漁"), ("Fishery", "漁業"), ("Mining", "礦業及土石採取業"),
                      ("Professional", "專業人士"), ("Freelance", "自由業"), ("E-commerce", "網拍業"), ("Student", "學生"), ("Homemaker", "家管"),
                      ("Social/Personal", "社會團體即個人服務"), ("Other", "其他"), ("Circus", None)],
    "product": [("Beauty", "瘦身美容"), ("3C/Appliance", "3C家電"), ("Personal", "個人用品"), ("Other", "其他"), ("Yacht", None)],
}
_UPK = {c: f"CASE WHEN serial_number % 97 <> 0 THEN ([{', '.join(repr(z or e) for e, z in v)}])[serial_number % {len(v)} + 1] END" for c, v in _UP.items()}
_UPB = {c: f"CASE WHEN serial_number % 97 <> 0 THEN ([{', '.join(repr(e.strip()) for e, _ in v)}])[serial_number % {len(v)} + 1] END" for c, v in _UP.items()}
_UPBAD = {c: f"(serial_number % 97 = 0 OR serial_number % {len(v)} = {len(v) - 1})" for c, v in _UP.items()}
_UPV = "list_filter([" + ", ".join(
    [f"CASE WHEN {b} THEN '{k}' END" for k, b in _RULES if "residence" not in k and k != "month_salary_negative"]
    + [f"CASE WHEN {b} THEN '{c}_unknown_code' END" for c, b in _UPBAD.items()]) + "], lambda x: x IS NOT NULL)"
ORACLE["upload_translation"] = with_(LOANS) + f"""
SELECT serial_number, CAST(round_even(month_salary * 31e-3 / 31e-3, 0) AS BIGINT) AS month_salary, array_to_string({_UPV}, ',') AS violations,
  {', '.join(f'{x} AS {c}_known' for c, x in _UPK.items())}, {', '.join(f'{x} AS {c}' for c, x in _UPB.items())} FROM loans"""

_ZH_GRADE = [("A (Excellent)", "A (優良)"), ("B (Moderate)", "B (中等)"), ("C (Warning)", "C (警戒)"), ("D (Poor)", "D (不良)"), ("E (Critical)", "E (危險)")]
_ZH_ACT = [("Normal Monitoring", "正常監控"), ("Watch List", "關注名單"), ("Early Warning", "早期預警"), ("Enhanced Monitoring", "加強監控"),
           ("Deterioration Alert", "惡化警示"), ("Immediate Intervention", "立即介入"), ("Forced Collection", "強制催收"),
           ("Enhanced Monitoring + Early Warning", "加強監控+早期預警"), ("Enhanced Monitoring / Collection Prep", "加強監控/催收準備"),
           ("Immediate Collection", "立即催收"), ("Immediate Intervention / Collection Prep", "立即介入/催收準備")]
_zh = lambda c, t: f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t) + f" ELSE {c} END AS {c}"
ORACLE["upload_scoring_zh"] = with_(*_SC) + f"""
SELECT serial_number, {_zh('risk_grade', _ZH_GRADE)}, {_zh('risk_action', _ZH_ACT)}, {_zh('risk_action_optimal', _ZH_ACT)}, 'kept' AS my_remark FROM scored"""


# =================================================== nearest neighbours
_KF = ["job_tenure", "loan_term", "paid_installments", "overdue_days", "debt_to_income_ratio", "payment_to_income_ratio"]
_KD = " + ".join(f"(CAST(a.{c} AS DOUBLE) - CAST(b.{c} AS DOUBLE)) * (CAST(a.{c} AS DOUBLE) - CAST(b.{c} AS DOUBLE))" for c in _KF)
ORACLE["knn_impute"] = with_(LOANS, f"""
kr AS (SELECT * FROM loans WHERE month_salary IS NULL),
kd AS (SELECT * FROM loans WHERE month_salary IS NOT NULL),
kp AS (SELECT a.serial_number AS s, b.serial_number AS ds, b.month_salary AS y, sqrt({_KD}) AS dist FROM kr a, kd b),
kt AS (SELECT s, y FROM kp QUALIFY row_number() OVER (PARTITION BY s ORDER BY dist, ds) <= 5),
ki AS (SELECT s, avg(y) AS y FROM kt GROUP BY s)""") + """
SELECT l.serial_number, round(coalesce(l.month_salary, ki.y), 6) AS month_salary
FROM loans l LEFT JOIN ki ON ki.s = l.serial_number"""


_IC = ["month_salary", "job_tenure", "loan_term", "paid_installments", "overdue_days", "debt_to_income_ratio",
       "payment_to_income_ratio", *[f"o{i}" for i in range(8)]]
_ISQ = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0e0)" for c in _IC)
_IN = " + ".join(f"CAST(a.{c} IS NOT NULL AND b.{c} IS NOT NULL AS INTEGER)" for c in _IC)
_IGAPS = ["month_salary", "loan_term", "debt_to_income_ratio", "payment_to_income_ratio"]  # the others have no gaps here
ORACLE["knn_impute_columns"] = with_(LOANS, f"""
ia AS MATERIALIZED (SELECT serial_number, month_salary, job_tenure, CASE WHEN loan_term > 0 THEN loan_term * 1e0 END AS loan_term,
       paid_installments * 1e0 AS paid_installments, overdue_days,
       CASE WHEN month_salary IS NOT NULL THEN debt_to_income_ratio END AS debt_to_income_ratio,
       CASE WHEN month_salary IS NOT NULL THEN payment_to_income_ratio END AS payment_to_income_ratio,
       {', '.join(f'o{i} * 1e0 AS o{i}' for i in range(8))} FROM loans),
ip AS MATERIALIZED (SELECT a.serial_number AS s, b.serial_number AS ds, sqrt({len(_IC)}e0 / ({_IN}) * ({_ISQ})) AS dist,
       {', '.join(f'CASE WHEN a.{c} IS NULL THEN b.{c} END AS {c}' for c in _IGAPS)}
       FROM ia a, ia b WHERE {' OR '.join(f'a.{c} IS NULL AND b.{c} IS NOT NULL' for c in _IGAPS)}),
{', '.join(f"""i_{c} AS (SELECT s, avg(v) AS v FROM (SELECT s, {c} AS v FROM ip WHERE {c} IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY s ORDER BY dist, ds) <= 5) GROUP BY s)""" for c in _IGAPS)}""") + f"""
SELECT ia.serial_number, {', '.join(f'round(coalesce(ia.{c}, i_{c}.v), 6) AS {c}' if c in _IGAPS else f'round(ia.{c}, 6) AS {c}' for c in _IC)}
FROM ia {' '.join(f'LEFT JOIN i_{c} ON i_{c}.s = ia.serial_number' for c in _IGAPS)}"""


def _u(expr: str, salt: str) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({expr} AS VARCHAR) || '|42|{salt}'), 1, 13)) AS BIGINT) / 4503599627370496e0)"


ORACLE["smote"] = with_(LOANS, f"""
mino AS (SELECT serial_number, {', '.join(_KF)} FROM labeled WHERE default_flag = 1),
cnt AS (SELECT count(*) FILTER (WHERE default_flag = 1) AS nmin, count(*) FILTER (WHERE default_flag = 0) AS nmaj FROM labeled),
mpos AS (SELECT *, row_number() OVER (ORDER BY serial_number) - 1 AS pos FROM mino),
nnp AS (SELECT a.serial_number AS q, b.serial_number AS nk, sqrt({_KD}) AS dist FROM mino a, mino b
        WHERE a.serial_number <> b.serial_number),
nn AS (SELECT q, nk, row_number() OVER (PARTITION BY q ORDER BY dist, nk) AS r FROM nnp QUALIFY r <= 3),
gen AS (SELECT i, CAST(floor({_u('i', 'row')} * nmin) AS BIGINT) AS pos, CAST(floor({_u('i', 'nn')} * 3) + 1 AS BIGINT) AS r,
               {_u('i', 'gap')} AS u
        FROM cnt, range(CAST((SELECT greatest(nmaj - nmin, 0) FROM cnt) AS BIGINT)) t(i)),
syn AS (SELECT -(g.i + 1) AS serial_number, {', '.join(f'm.{c} + g.u * (b.{c} - m.{c}) AS {c}' for c in _KF)}
        FROM gen g JOIN mpos m ON m.pos = g.pos JOIN nn ON nn.q = m.serial_number AND nn.r = g.r
        JOIN mino b ON b.serial_number = nn.nk)""") + f"""
SELECT serial_number, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _KF)}, 0 AS synthetic, default_flag FROM labeled
UNION ALL
SELECT serial_number, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _KF)}, 1, 1 FROM syn"""


# ================================================ S10 dictionary / R15 summary
ORACLE["column_dictionary"] = with_(LOANS, GRID, THRESH, """
cn AS (SELECT * FROM (VALUES
  (0, 'serial_number', 'case number', 'input column'),
  (1, 'application_date', 'application date', 'input column'),
  (2, 'id', 'client id', 'input column'),
  (3, 'default_probability', 'predicted probability of default (0-100%)', 'model probability x 100, 2 decimals'),
  (4, 'risk_score', 'risk score (0-100, higher is safer)', '(1 - probability) x 100, truncated'),
  (5, 'risk_grade', 'risk grade A best .. E worst', 'A >= {a}, B >= 60, C >= 40, D >= 20, E < 20'),
  (6, 'risk_action', 'management action at the standard threshold 0.5', 'by grade and warning flags'),
  (7, 'risk_action_optimal', 'management action at the optimal threshold {t}', 'escalated when flagged at {t}'),
  (8, 'risk_alert', 'five-level alert', 'same cuts as the grade'),
  (9, 'predicted_default', 'high-risk flag at 0.5', 'probability >= 0.5'),
  (10, 'predicted_default_optimal', 'high-risk flag at {t}', 'probability >= {t}'),
  (11, 'threshold_difference', 'flags disagree', 'predicted_default != predicted_default_optimal'))
  v(column_order, column_name, description, calculation)),
tt AS (SELECT printf('%.3f', threshold) AS t, CAST(CAST(trunc((1 - threshold) * 100) AS INTEGER) AS VARCHAR) AS a FROM ts_best)""") + """
SELECT CAST(column_order AS INTEGER) AS column_order, column_name,
       replace(replace(description, '{t}', t), '{a}', a) AS description,
       replace(replace(calculation, '{t}', t), '{a}', a) AS calculation
FROM cn, tt"""

_SUMM = {"education": "education", "month_salary": "CAST(CAST(month_salary AS BIGINT) AS VARCHAR)",
         "job_tenure": "CAST(job_tenure AS VARCHAR)", "residence_status": "residence_status",
         "main_business": "main_business", "product": "product", "loan_term": "CAST(loan_term AS VARCHAR)",
         "paid_installments": "CAST(paid_installments AS VARCHAR)",
         "debt_to_income_ratio": "CAST(round_even(debt_to_income_ratio * 100e0, 0) / 100e0 AS VARCHAR)",
         "payment_to_income_ratio": "CAST(round_even(payment_to_income_ratio * 100e0, 0) / 100e0 AS VARCHAR)",
         "post_perm": "post_perm", "post_res": "post_res",
         "total_overdue_count": "CAST(o0 + o1 + o2 + o3 + o4 + o5 + o6 + o7 AS VARCHAR)"}
ORACLE["input_summary"] = with_(LOANS) + " " + " UNION ALL ".join(
    f"SELECT serial_number, '{k}' AS item, {v} AS value FROM loans" for k, v in _SUMM.items())
