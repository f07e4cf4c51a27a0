"""E3 upload scoring: the batch an operator uploads, taken through the same
library operators as training, then trimmed for business users."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import config as C
from ..operators import cleaning, features, scoring


CATEGORY_TABLES = dict.fromkeys(C.CODE_COLUMNS, C.CODES)
RESULT_TABLES = {"risk_grade": C.GRADE_CODES, "risk_action": C.ACTION_CODES, "risk_action_optimal": C.ACTION_CODES}


def incoming(df: DataFrame, lang: str) -> DataFrame:
    """An upload's codes as the models know them; salaries of English uploads from dollars."""
    d = scoring.translate_columns(df, CATEGORY_TABLES)
    if lang == "en" and "month_salary" in d.columns:
        d = d.withColumn("month_salary", scoring.convert_currency("month_salary"))
    return d


def outgoing(df: DataFrame, lang: str) -> DataFrame:
    """A result in the user's language: English codes back, or grades and actions from English."""
    return scoring.translate_columns(df, CATEGORY_TABLES, reverse=True) if lang == "en" else scoring.translate_columns(df, RESULT_TABLES)


def checked(df: DataFrame) -> DataFrame:
    """P25: rule violations of an upload, all code lists among the rules."""
    have = {c: codes for c, codes in C.ALLOWED_CODES.items() if c in df.columns}
    rules = cleaning.input_rules(have)
    numeric = {code.removesuffix("_negative") for code, _ in rules if code.endswith("_negative")}
    alias = {"dti": "debt_to_income_ratio", "pti": "payment_to_income_ratio"}
    absent = {f"{c}_negative" for c in numeric if alias.get(c, c) not in df.columns}
    return cleaning.violations(df, [r for r in rules if r[0] not in absent])


def upload_scoring(df: DataFrame, threshold: DataFrame, prob: str = "probability",
                   scorer=None, lang: str | None = None) -> tuple[DataFrame, list[str]]:
    """P1 strip headers -> P3 required columns -> P4 optional defaults (warning
    list returned) -> P23/P24 codes and currency -> P5 zero fill -> P15-P19 and
    O1-O17 features -> model probability (``scorer`` or an existing column) ->
    R1-R7 -> P27 drop -> P23 result in the user's language.  Columns that no
    model reads stay in the result.  Without ``lang`` nothing is translated."""
    d = cleaning.normalize_headers(df, snake_case=True)
    d = cleaning.require_columns(d, C.REQUIRED_UPLOAD_COLUMNS)
    d, warned = cleaning.fill_optional_columns(d, C.OPTIONAL_UPLOAD_COLUMNS, 0)
    if lang is not None:
        d = incoming(d, lang)
    d = cleaning.fill_zero(d)
    d = features.overdue_features(features.repayment_features(d))
    if scorer is not None:
        d = scorer(d)
    s = scoring.score(d, threshold, prob=prob)
    out = cleaning.drop_internal(s, C.INTERNAL_RESULT_COLUMNS)
    return (out if lang is None else outgoing(out, lang)), warned
