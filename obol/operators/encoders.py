"""Fitted encoders and their lookup joins.

Fit = one aggregation producing a small *encoder table*; apply = a left join
of that table plus a default for unseen values.  All categorical features are
unpivoted once so a single ``groupBy(feature, value)`` (with map-side partial
aggregation, so a hot category costs nothing extra) feeds WoE, target,
frequency and geography tables.

Encoder tables are bounded by the categories' cardinality, not by the data;
``lookup`` still checks the row count before it broadcasts and falls back to
a shuffle join above ``MAX_BROADCAST_ROWS``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.tables import attach
from .cleaning import existing

MAX_BROADCAST_ROWS = 2_000_000


def sized_broadcast(small: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, n_rows: int | None = None) -> DataFrame:
    """Broadcast hint only when the table's row count is within the bound."""
    n = small.count() if n_rows is None else n_rows
    return F.broadcast(small) if n <= max_rows else small


class Fitted:
    """A fitted encoder table cut from its lineage once (reliable checkpoint),
    with its per-feature row counts, so lookups neither recompute the fit nor
    count it again."""

    def __init__(self, table: DataFrame):
        from ..session import materialize
        self.table = materialize(table)
        # one row per fitted feature: bounded by the schema
        self.rows = {r["feature"]: r["n"] for r in
                     self.table.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}

    def lookup(self, df: DataFrame, feature: str, value_col: str, out: str, default,
               source: str | None = None, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
        return lookup(df, self.table, feature, value_col, out, default, source, max_rows,
                      n_rows=self.rows.get(feature, 0))


def fitted(table) -> "Fitted":
    return table if isinstance(table, Fitted) else Fitted(table)


def _long(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    feats = existing(df, features)
    return (df.select(F.col(label).cast("double").alias("_y"),
                      *[F.coalesce(F.col(f).cast("string"), F.lit(C.MISSING_LEVEL)).alias(f) for f in feats])
            .unpivot(["_y"], feats, "feature", "value"))


def category_stats(df: DataFrame, features: Sequence[str], label: str = C.LABEL) -> DataFrame:
    """Shared fit pass: (feature, value, n, bad) in one shuffle."""
    return _long(df, features, label).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("bad"))


# ----------------------------------------------------------------- WoE / IV
def woe_fit(df: DataFrame, features: Sequence[str], label: str = C.LABEL,
            stats: DataFrame | None = None) -> DataFrame:
    """A1/A2 fit: per (feature, value) WoE and IV part.

    good% = good/sum(good), bad% = bad/sum(bad), zero shares -> 0.0001,
    WoE = ln(good%/bad%), IV part = (good% - bad%) * WoE.  A feature whose
    total good or total bad is 0 is skipped (no rows).
    """
    s = stats if stats is not None else category_stats(df, features, label)
    s = s.withColumn("good", F.col("n") - F.col("bad"))
    totals = s.groupBy("feature").agg(F.sum("good").alias("tg"), F.sum("bad").alias("tb"))
    floor = F.lit(C.WOE_FLOOR)
    j = s.join(F.broadcast(totals), "feature").where((F.col("tg") > 0) & (F.col("tb") > 0))
    gp = F.col("good") / F.col("tg")
    bp = F.col("bad") / F.col("tb")
    j = j.withColumn("good_pct", F.when(gp == 0, floor).otherwise(gp)).withColumn(
        "bad_pct", F.when(bp == 0, floor).otherwise(bp))
    j = j.withColumn("woe", F.ln(F.col("good_pct") / F.col("bad_pct")))
    j = j.withColumn("iv_part", (F.col("good_pct") - F.col("bad_pct")) * F.col("woe"))
    return j.select("feature", "value", F.col("n").cast("bigint").alias("n"),
                    F.col("bad").cast("bigint").alias("bad"), F.col("good").cast("bigint").alias("good"),
                    "good_pct", "bad_pct", "woe", "iv_part")


def iv_summary(woe: DataFrame) -> DataFrame:
    """Total IV per feature, strength label, rank (desc), selection flag."""
    iv = woe.groupBy("feature").agg(F.sum("iv_part").alias("iv"))
    strength = (F.when(F.col("iv") > C.IV_STRONG, "Strong").when(F.col("iv") > C.IV_MEDIUM, "Medium")
                .when(F.col("iv") > C.IV_WEAK, "Weak").otherwise("Very Weak"))
    from pyspark.sql import Window
    rank = F.row_number().over(Window.orderBy(F.col("iv").desc(), F.col("feature")))  # one row per feature
    return iv.select("feature", "iv", strength.alias("strength"), rank.alias("iv_rank"),
                     (F.col("iv") >= C.IV_SELECT_THRESHOLD).cast("int").alias("selected"))


def lookup(df: DataFrame, table: DataFrame, feature: str, value_col: str, out: str, default,
           source: str | None = None, max_rows: int = MAX_BROADCAST_ROWS, n_rows: int | None = None) -> DataFrame:
    """Left join one feature's encoder rows, unseen -> default.  The
    encoder side is broadcast only when its row count is within the bound;
    above it the join shuffles both sides on the value."""
    src = source or feature
    t = table.where(F.col("feature") == feature).select(
        F.col("value").alias("__v"), F.col(value_col).alias(out))
    t = sized_broadcast(t, max_rows, n_rows)
    key = F.coalesce(F.col(src).cast("string"), F.lit(C.MISSING_LEVEL))
    j = df.withColumn("__k", key).join(t, F.col("__k") == F.col("__v"), "left").drop("__k", "__v")
    dflt = default if hasattr(default, "alias") else F.lit(default)
    return j.withColumn(out, F.coalesce(F.col(out), dflt))


def woe_apply(df: DataFrame, woe: DataFrame, features: Sequence[str]) -> DataFrame:
    """A2 transform: ``<feature>_woe`` for every fitted feature, unseen -> 0."""
    enc = fitted(woe)
    out = df
    for f in existing(df, features):
        if f in enc.rows:
            out = enc.lookup(out, f, "woe", f"{f}_woe", 0.0)
    return out


# --------------------------------------------------------- target encoding
def target_fit(df: DataFrame, features: Sequence[str], label: str = C.LABEL,
               smoothing: float = C.TARGET_SMOOTHING, stats: DataFrame | None = None) -> DataFrame:
    """A5 fit: (sum y + s * mean y) / (n + s); also carries the global mean."""
    s = stats if stats is not None else category_stats(df, features, label)
    g = df.agg(F.avg(F.col(label).cast("double")).alias("global_mean"))
    j = attach(s, g)
    enc = (F.col("n") * (F.col("bad") / F.col("n")) + F.lit(smoothing) * F.col("global_mean")) / (F.col("n") + F.lit(smoothing))
    return j.select("feature", "value", "n", enc.alias("target_enc"), "global_mean")


def target_apply(df: DataFrame, enc: DataFrame, features: Sequence[str]) -> DataFrame:
    """A5 transform: ``<feature>_target_enc``; unseen -> global mean."""
    enc = fitted(enc)
    g = enc.table.agg(F.first("global_mean").alias("global_mean"))  # one row, of null, for an empty fit, too
    out = attach(df, g.withColumnRenamed("global_mean", "__gm"))
    for f in existing(df, features):
        out = enc.lookup(out, f, "target_enc", f"{f}_target_enc", F.col("__gm"))
    return out.drop("__gm")


# ------------------------------------------------------- frequency encoding
def frequency_fit(df: DataFrame, features: Sequence[str], stats: DataFrame | None = None,
                  label: str = C.LABEL) -> DataFrame:
    """D10 fit: share of rows per category."""
    s = stats if stats is not None else category_stats(df, features, label)
    tot = s.groupBy("feature").agg(F.sum("n").alias("__t"))
    return s.join(F.broadcast(tot), "feature").select("feature", "value", "n", (F.col("n") / F.col("__t")).alias("freq"))


def frequency_apply(df: DataFrame, enc: DataFrame, features: Sequence[str]) -> DataFrame:
    enc = fitted(enc)
    out = df
    for f in existing(df, features):
        out = enc.lookup(out, f, "freq", f"{f}_freq", 0.0)
    return out


# ------------------------------------------------------- geographic risk
def geo_fit(df: DataFrame, label: str = C.LABEL, res: str = "post_res", perm: str = "post_perm",
            min_samples: int = C.GEO_MIN_SAMPLES) -> DataFrame:
    """A6/A7 fit: one table ``(feature, value, n, rate, risk, global_rate)`` for
    residential postcode, permanent postcode and city (first 3 characters).
    Groups below the sample minimum (city: 5x) get the global rate."""
    y = F.col(label).cast("double")
    base = df.select(
        y.alias("_y"),
        F.coalesce(F.col(res).cast("string"), F.lit(C.MISSING_LEVEL)).alias("res"),
        F.coalesce(F.col(perm).cast("string"), F.lit(C.MISSING_LEVEL)).alias("perm"),
        F.coalesce(F.substring(F.col(res).cast("string"), 1, C.CITY_PREFIX_LEN), F.lit(C.MISSING_LEVEL)).alias("city"),
    )
    long = base.unpivot(["_y"], ["res", "perm", "city"], "feature", "value")
    s = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate"))
    g = df.agg(F.avg(y).alias("global_rate"))
    minimum = F.when(F.col("feature") == "city", F.lit(min_samples * C.GEO_CITY_FACTOR)).otherwise(F.lit(min_samples))
    return attach(s, g).withColumn(
        "risk", F.when(F.col("n") < minimum, F.col("global_rate")).otherwise(F.col("rate")))


def risk_level(c) -> object:
    """Right-closed bins; exactly 0 (or outside (0, 1]) -> null."""
    e, lab = C.RISK_LEVEL_EDGES, C.RISK_LEVEL_LABELS
    x = F.col(c) if isinstance(c, str) else c
    expr = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(e[:-1], e[1:], lab))):
        expr = F.when((x > lo) & (x <= hi), F.lit(name)).otherwise(expr)
    return expr


def geo_apply(df: DataFrame, geo: DataFrame, res: str = "post_res", perm: str = "post_perm") -> DataFrame:
    """A6-A9 transform: res/perm/city risk (unseen -> global), risk level,
    address stability risk = 0.3 * (1 - match) + 0.7 * res risk."""
    enc = fitted(geo)
    g = enc.table.agg(F.first("global_rate").alias("__g"))  # one row, of null, for an empty fit, too
    out = attach(df, g)
    out = enc.lookup(out, "res", "risk", "res_risk_score", F.col("__g"), source=res)
    out = out.withColumn("__city", F.substring(F.col(res).cast("string"), 1, C.CITY_PREFIX_LEN))
    out = enc.lookup(out, "perm", "risk", "perm_risk_score", F.col("__g"), source=perm)
    out = enc.lookup(out, "city", "risk", "city_risk_score", F.col("__g"), source="__city")
    out = out.withColumn("res_risk_level", risk_level("res_risk_score"))
    if "address_match" in out.columns:
        out = out.withColumn("address_stability_risk",
                             (1 - F.col("address_match")) * C.ADDRESS_WEIGHT + F.col("res_risk_score") * C.RES_RISK_WEIGHT)
    return out.drop("__g", "__city")


def geo_top_areas(geo: DataFrame, k: int = 5, feature: str = "res") -> DataFrame:
    """Top-k areas by risk (ties by n desc, then value)."""
    return (geo.where(F.col("feature") == feature)
            .orderBy(F.col("risk").desc(), F.col("n").desc(), F.col("value")).limit(k)
            .select("value", "n", "risk"))


def geo_summary(geo: DataFrame) -> DataFrame:
    """A10: unique counts and min/max risk per geography level."""
    return geo.groupBy("feature").agg(F.count(F.lit(1)).alias("unique_values"),
                                      F.min("risk").alias("min_risk"), F.max("risk").alias("max_risk"))
