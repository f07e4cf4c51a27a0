"""Hand-computed edge fixtures (FIXTURES.md F4) and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obol import config as C
from obol.functions.columns import label_m1, parse_number, payment_progress
from obol.operators import cleaning, encoders, features, history, metrics, scoring
from obol.operators.running import running


def test_label_m1(spark):
    vals = ["Current", "M0", "M1", "M32", " M2 ", "M1-1", "M", "m3", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")
    got = [r["y"] for r in df.select("i", label_m1("s").alias("y")).orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 1, 0, 0, 0, 0, 0]


def test_parse_number(spark):
    vals = ["5", " 5 ", "1e3", "1d", "1f", "12,000", "", "nan", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x string")
    got = [r["v"] for r in df.select("i", parse_number("x").alias("v")).orderBy("i").collect()]
    assert got == [5.0, 5.0, 1000.0, None, None, None, None, None, None]


def test_payment_progress(spark):
    rows = [(0, 5, 10), (1, 12, 10), (2, 3, 0), (3, 0, 0), (4, None, 10)]
    df = spark.createDataFrame(rows, "i int, paid long, term long")
    got = [r["v"] for r in df.select("i", payment_progress("paid", "term").alias("v")).orderBy("i").collect()]
    assert got == [0.5, 1.0, 1.0, 0.0, 0.0]


def _py_overdue(x):
    early, late = sum(x[0:4]), sum(x[5:8])
    runs, cur = 0, 0
    for v in x:
        cur = cur + 1 if v > 0 else 0
        runs = max(runs, cur)
    e = float(x[0])
    for v in x[1:]:
        e = 0.3 * v + 0.7 * e
    vel = [x[i + 1] - x[i] for i in range(7)]
    acc = [vel[i + 1] - vel[i] for i in range(6)]
    return {
        "early_overdue_count": early, "late_overdue_count": late, "overdue_trend": late - early,
        "overdue_worsening": int(late - early > 0), "max_overdue_in_month": max(x),
        "overdue_std": float(np.std(x, ddof=1)), "overdue_consistency": int(np.std(x, ddof=1) == 0),
        "overdue_frequency": sum(v > 0 for v in x), "overdue_freq_ratio": sum(v > 0 for v in x) / 8,
        "recent_overdue_severity": late / 3, "max_consecutive_overdue": runs, "total_overdue_count": sum(x),
        "has_overdue": int(sum(x) > 0), "overdue_acceleration": float(np.mean(acc)),
        "critical_period_overdue": sum(x[2:6]), "late_stage_persistence": sum(v > 0 for v in x[5:8]),
        "late_stage_persistent_flag": int(sum(v > 0 for v in x[5:8]) >= 2), "overdue_recovery": early - late,
        "overdue_improving": int(early - late > 0), "early_warning_score": sum(x[0:3]),
        "early_warning_flag": int(sum(x[0:3]) >= 3), "rolling_3m_overdue_avg": float(np.mean(x[-3:])),
        "ema_overdue": e,
    }


def test_overdue_features_match_definition(spark):
    series = [[0] * 8, [3] * 8, [0, 2, 1, 1, 0, 1, 0, 0], [2, 3, 2, 1, 1, 1, 0, 0], [0, 0, 0, 0, 0, 1, 2, 3],
              [None, 1, None, 0, 2, None, 0, 1]]
    rows = [(i, *s) for i, s in enumerate(series)]
    df = spark.createDataFrame(rows, "serial_number long, " + ", ".join(f"o{i} long" for i in range(8)))
    out = features.overdue_features(cleaning.fill_zero(df)).orderBy("serial_number").collect()
    for r, s in zip(out, series):
        want = _py_overdue([v or 0 for v in s])
        for k, v in want.items():
            assert math.isclose(float(r[k]), float(v), rel_tol=1e-12, abs_tol=1e-12), (k, s, r[k], v)
    # O15 = O7 when all eight exist; O10 closed form = definition (checked above)
    for r in out:
        assert r["rolling_3m_overdue_avg"] == r["recent_overdue_severity"]


def test_overdue_partial_columns(spark):
    df = spark.createDataFrame([(1, 1, 0, 2)], "serial_number long, o0 long, o5 long, o6 long")
    out = features.overdue_features(df).first()
    assert out["early_overdue_count"] == 1 and out["late_overdue_count"] == 2
    assert "critical_period_overdue" not in out.asDict()  # fewer than 2 critical columns
    none = spark.createDataFrame([(1,)], "serial_number long")
    assert features.overdue_features(none).columns == ["serial_number"]


def test_overdue_long_form_matches_wide(spark):
    rng = random.Random(3)
    rows = [(i, *[rng.choice([0, 0, 1, 2, 3]) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "serial_number long, " + ", ".join(f"o{i} long" for i in range(8)))
    wide = {r["serial_number"]: r for r in features.overdue_features(df).collect()}
    lf = features.overdue_long_features(features.overdue_long(df)).collect()
    for r in lf:
        w = wide[r["serial_number"]]
        assert r["max_consecutive_overdue"] == w["max_consecutive_overdue"]
        assert math.isclose(r["ema_overdue"], w["ema_overdue"], abs_tol=1e-9)
        assert math.isclose(r["overdue_std"], w["overdue_std"], abs_tol=1e-9)
        assert math.isclose(r["rolling_3m_overdue_avg"], w["rolling_3m_overdue_avg"], abs_tol=1e-12)


def test_woe_edge_cases(spark):
    rows = [("a", 1), ("a", 1), ("b", 0), ("b", 0), ("b", 1), (None, 0), (None, 1), ("c", 0)]
    df = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(rows)], "serial_number long, v string, default_flag int")
    w = {r["value"]: r for r in encoders.woe_fit(df, ["v"]).collect()}
    tg, tb = 4, 4
    assert w["a"]["good_pct"] == 0.0001 and w["a"]["bad_pct"] == 2 / tb
    assert w["c"]["bad_pct"] == 0.0001
    assert C.MISSING_LEVEL in w
    assert math.isclose(sum(r["good_pct"] for r in w.values() if r["good"] > 0), 1.0)
    iv = encoders.iv_summary(encoders.woe_fit(df, ["v"])).first()["iv"]
    assert iv >= 0
    new = spark.createDataFrame([(100, "zzz"), (101, None)], "serial_number long, v string")
    a = {r["serial_number"]: r["v_woe"] for r in encoders.woe_apply(new, encoders.woe_fit(df, ["v"]), ["v"]).collect()}
    assert a[100] == 0.0 and a[101] == w[C.MISSING_LEVEL]["woe"]
    single = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "serial_number long, v string, default_flag int")
    assert encoders.woe_fit(single, ["v"]).count() == 0  # feature skipped


def test_geo_thresholds(spark):
    rows = []
    k = 0
    for post, n, bad in (("10001", 9, 9), ("10002", 10, 0), ("10003", 11, 1), ("20001", 49, 2)):
        for i in range(n):
            rows.append((k, post, post, int(i < bad)))
            k += 1
    df = spark.createDataFrame(rows, "serial_number long, post_res string, post_perm string, default_flag int")
    g = {(r["feature"], r["value"]): r for r in encoders.geo_fit(df).collect()}
    glob = sum(r[3] for r in rows) / len(rows)
    assert math.isclose(g[("res", "10001")]["risk"], glob)       # n = 9 < 10 -> global
    assert g[("res", "10002")]["risk"] == 0.0                     # n = 10 -> own rate
    assert math.isclose(g[("res", "10003")]["risk"], 1 / 11)
    assert math.isclose(g[("city", "200")]["risk"], glob)         # n = 49 < 50 -> global
    lv = spark.createDataFrame([(0.0,), (0.03,), (0.06,), (0.10,), (0.5,)], "r double")
    got = [r["l"] for r in lv.select(encoders.risk_level("r").alias("l")).collect()]
    assert got == [None, "low", "medium", "high", "very_high"]


def _py_history(rows):
    out = {}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        prev = by.setdefault(r[1], [])
        if not prev:
            out[r[0]] = (1, 0, 0.0, 0.0, 0, 0, 0.0)
        else:
            last = prev[-1]
            nd = sum(p[3] for p in prev)
            out[r[0]] = (0, int(nd > 0), float(last[4]), (last[5] / last[6]) if last[6] > 0 else 0.0,
                         len(prev), nd, nd / len(prev))
        prev.append(r)
    return out


@pytest.mark.parametrize("strategy,max_rows", [("window", None), ("ranged", None), ("auto", 5)])
def test_history_strategies(spark, strategy, max_rows):
    import datetime as dt
    rng = random.Random(11)
    rows = []
    for k in range(400):
        cid = 7 if k % 3 == 0 else rng.randint(1, 40)   # one hot client holds a third of the rows
        d = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 30))   # many tied dates
        rows.append((k, cid, d, rng.randint(0, 1), float(rng.randint(0, 90)), rng.randint(0, 12), rng.choice([0, 6, 12])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "serial_number long, id long, application_date date, default_flag int, "
                                     "overdue_days double, paid_installments long, loan_term long").repartition(5)
    kw = {"max_group_rows": max_rows} if max_rows else {}
    h = history.client_history(df, strategy=strategy, **kw).collect()
    want = _py_history(rows)
    assert len(h) == len(rows)
    for r in h:
        w = want[r["serial_number"]]
        got = (r["is_new_customer"], r["historical_default"], r["prev_overdue_days"], r["prev_payment_ratio"],
               r["cumulative_loans"], r["cumulative_defaults"], r["customer_default_rate"])
        assert got[:2] == w[:2] and got[4:6] == w[4:6], (r, w)
        assert math.isclose(got[2], w[2]) and math.isclose(got[3], w[3]) and math.isclose(got[6], w[6])


def test_running_global_and_keyed_agree(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c"]), rng.randint(0, 50), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g string, o long, m long")
    res = {}
    for strat in ("window", "ranged"):
        r = running(df, ["g"], ["o", "k"], sums=["m"], lasts=["m"], maxes=["o"], strategy=strat, buckets=7)
        res[strat] = sorted(tuple(x) for x in r.select("k", "_rn", "_cum_m", "_prev_m", "_max_o").collect())
    assert res["window"] == res["ranged"]
    g1 = sorted(tuple(x) for x in running(df, [], ["o", "k"], sums=["m"], strategy="window").select("k", "_rn", "_cum_m").collect())
    g2 = sorted(tuple(x) for x in running(df, [], ["o", "k"], sums=["m"], strategy="ranged", buckets=6).select("k", "_rn", "_cum_m").collect())
    assert g1 == g2


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 20, 300), rng.normal(size=101)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["q"]: r["value"] for r in cleaning.exact_quantiles(df, "x", probs).collect()}
    for q in probs:
        assert math.isclose(got[q], float(np.quantile(x, q)), rel_tol=1e-12, abs_tol=1e-12)


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "e string")
    assert cleaning.fit_modes(df, ["e"]).first()["e"] == "a"
    allnull = spark.createDataFrame([(None,)], "e string")
    assert cleaning.fit_modes(allnull, ["e"], {"e": "fallback"}).first()["e"] == "fallback"


def test_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,), (None,)], "x double")
    assert cleaning.fit_medians(df, ["x"]).first()["x"] == 6.0


def test_scoring_cuts(spark):
    ps = [0, .05, .0999, .1, .1001, .4, .40001, .6, .8, 1]
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(ps)], "i int, probability double")
    # (1 - 0.8) * 100 = 19.999... truncates to 19 -> E; with t* = 0.5 grade B is unreachable
    for t, want in ((0.1, "AAAABBCCEE"), (0.5, "AAAAAAACEE")):
        th = spark.createDataFrame([(t,)], "optimal_threshold double")
        got = "".join(r["risk_grade"][0] for r in scoring.score(df, th).orderBy("i").collect())
        assert got == want, (t, got)
    s = scoring.score(df, spark.createDataFrame([(0.1,)], "optimal_threshold double")).orderBy("i").collect()
    assert [r["risk_score"] for r in s] == [100, 95, 90, 90, 89, 60, 59, 40, 19, 0]
    assert [r["default_probability"] for r in s][:3] == [0.0, 5.0, 9.99]


def test_score_band_gap(spark):
    df = spark.createDataFrame([(79.5,), (80.0,), (19.0,), (-1.0,)], "s double")
    assert [r["b"] for r in df.select(scoring.score_band("s").alias("b")).collect()] == ["BAD", "EXCELLENT", "BAD", "BAD"]


def test_metrics_edge_cases(spark):
    def auc(rows):
        df = spark.createDataFrame(rows, "y int, p double")
        return metrics.auc(df).first()["auc"]
    assert auc([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)]) == 1.0
    assert auc([(0, 0.9), (0, 0.8), (1, 0.1), (1, 0.2)]) == 0.0
    assert auc([(0, 0.5), (1, 0.5), (1, 0.5), (0, 0.5)]) == 0.5
    assert auc([(1, 0.3), (1, 0.4)]) is None
    # ties: pos {0.5, 0.7, 0.5} vs neg {0.5, 0.2}: (0.5+1) + (1+1) + (0.5+1) = 5 of 6
    assert auc([(1, 0.5), (0, 0.5), (1, 0.7), (0, 0.2), (1, 0.5)]) == 5 / 6


def test_auc_matches_bruteforce(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = metrics.auc(df).first()["auc"]
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    u = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    assert got == pytest.approx(u / (len(pos) * len(neg)), abs=1e-15)


GOLDEN = [  # model, threshold, TP, predicted positive, F1, F2 (554 positives)
    ("XGBoost", 0.18999999999999995, 477, 892, 0.6597510373443983, 0.7673745173745173),
    ("LightGBM", 0.2699999999999999, 494, 1006, 0.6333333333333333, 0.7666045934202359),
    ("CatBoost", 0.3699999999999999, 507, 1048, 0.6329588014981273, 0.7766544117647058),
    ("Stacking", 0.1, 492, 983, 0.6402081977878985, 0.7689903094717099),
]


def test_golden_f_scores_and_grid(spark):
    rows = [(m, tp, pp - tp, 554 - tp, 2671 - 554 - (pp - tp)) for m, _, tp, pp, _, _ in GOLDEN]
    c = spark.createDataFrame(rows, "model string, tp long, fp long, fn long, tn long")
    got = {r["model"]: r for r in metrics.point_metrics_from_counts(c).collect()}
    for m, _, _, _, f1, f2 in GOLDEN:
        assert got[m]["f1"] == f1 and got[m]["f2"] == f2
    grid = {r["i"]: r["threshold"] for r in metrics.threshold_grid(spark).collect()}
    assert len(grid) == 80
    for m, t, *_ in GOLDEN:
        assert t in grid.values(), t
    assert grid[9] == 0.18999999999999995


def test_threshold_search_matches_bruteforce(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.3), rng.choice([0.05, 0.1, 0.18999999999999995, 0.19, 0.35, rng.random()]))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    best = metrics.optimal_threshold(df, "f2").first()
    start, delta = 0.1, (0.1 + 0.01) - 0.1
    P = sum(y for y, _ in rows)
    scores = []
    for i in range(80):
        t = start + i * delta
        tp = sum(1 for y, p in rows if p >= t and y == 1)
        pp = sum(1 for y, p in rows if p >= t)
        scores.append((5 * tp / (4 * P + pp)) if (4 * P + pp) else 0.0)
    i = int(np.argmax(scores))
    assert best["threshold"] == start + i * delta and best["score"] == scores[i]


def test_eligibility_limits(spark):
    rows = [(1, 18, 20000.0, 0.5, 6), (2, 17, 20000.0, 0.5, 6), (3, 76, 19999.0, 0.51, 5), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "customer_id long, age long, annual_income double, debt_to_income_ratio double, "
                                     "credit_history_months long")
    v = {r["customer_id"]: r for r in cleaning.validate_clients(df).collect()}
    assert v[1]["is_valid"] == 1 and v[1]["errors"] == []
    assert v[2]["errors"] == ["age_below_min"]
    assert v[3]["errors"] == ["age_above_max", "income_below_min", "dti_above_max", "credit_history_too_short"]
    assert v[4]["errors"] == ["age_below_min", "income_below_min", "credit_history_too_short"]


# ---------------------------------------------------------------- nulls and small inputs
def test_loans_without_id_are_each_new(spark):
    from obol.operators import history
    rows = [(1, None, "2024-01-01", 1, 5.0, 1, 2), (2, None, "2024-02-01", 0, 0.0, 1, 2), (3, "a", "2024-01-01", 1, 3.0, 2, 2),
            (4, "a", "2024-03-01", 0, 0.0, 1, 2)]
    df = spark.createDataFrame(rows, "serial_number long, id string, application_date string, default_flag int, overdue_days double, "
                                     "paid_installments int, loan_term int").withColumn("application_date", F.to_date("application_date"))
    for strategy in ("window", "ranged", "auto"):
        h = {r.serial_number: r for r in history.client_history(df, id_col="id", strategy=strategy).collect()}
        assert [h[i].is_new_customer for i in (1, 2, 3, 4)] == [1, 1, 1, 0]
        assert h[4].cumulative_defaults == 1 and h[2].cumulative_defaults == 0
    for lag in (0, 10):
        h = {r.serial_number: r for r in history.client_history_asof(df, lag, id_col="id").collect()}
        assert h[1].is_new_customer == h[2].is_new_customer == 1
    assert history.repeat_stats(df, "id").first().total_customers == 1


def test_knn_impute_ignores_rows_without_features(spark):
    from obol.operators import neighbors
    rows = [(1, 1.0, 1.0, None), (2, 1.0, 2.0, 10.0), (3, 2.0, 1.0, 20.0), (4, None, 1.0, 999.0), (5, float("nan"), 1.0, 998.0),
            (6, None, 2.0, None)]
    df = spark.createDataFrame(rows, "k long, a double, b double, t double")
    got = {r.k: r.t for r in neighbors.knn_impute(df, "t", ["a", "b"], "k", k=2).collect()}
    assert got[1] == 15.0 and got[6] is None


def test_smote_with_a_small_minority_is_complete(spark):
    from obol.operators import neighbors
    rows = [(i, float(i), 0) for i in range(38)] + [(100, 1.0, 1), (101, 2.0, 1)]
    df = spark.createDataFrame(rows, "k long, x double, y int")
    out = neighbors.smote(df, "y", ["x"], "k", k=3)
    assert out.where("synthetic = 1").count() == 36


def test_empty_encoder_keeps_rows(spark):
    from obol.operators import encoders
    df = spark.createDataFrame([("a", 1), ("b", 0)], "c string, default_flag int")
    enc = encoders.target_fit(df.where("false"), ["c"])
    assert encoders.target_apply(df, enc, ["c"]).count() == 2
    geo = spark.createDataFrame([("123", "456", 1)], "post_res string, post_perm string, default_flag int")
    assert encoders.geo_apply(geo, encoders.geo_fit(geo.where("false"))).count() == 1


def test_nan_counts_as_missing(spark):
    from obol.functions import columns
    from obol.operators import cleaning, ml
    df = spark.createDataFrame([(1, float("nan")), (2, 1.5)], "k long, x double")
    assert [r[0] for r in df.select(columns.safe_clip(F.col("x"), 0.0, 2.0)).collect()] == [0.0, 1.5]
    assert {r.k: r.x for r in cleaning.apply_medians(df, cleaning.fit_medians(df, ["x"])).collect()}[1] == 1.5
    assert {r.k: r.x for r in ml.model_matrix(df, ["x"], keep=("k",)).collect()}[1] == 0.0


def test_many_levels_and_thresholds(spark):
    from obol.operators import metrics, ml
    df = spark.createDataFrame([(i, f"v{i:04d}") for i in range(1001)], "k long, c string")
    levels = ml.fit_one_hot_levels(df, ["c"])
    assert len(levels["c"]) == 1001
    d = spark.createDataFrame([(0, 0.2), (1, 0.8)], "y int, p double")
    t = spark.createDataFrame([(f"t{i}", i / 100) for i in range(101)], "threshold_name string, t double")
    assert metrics.confusion(d, t).count() == 404


def test_stratified_split_of_repeated_and_missing_keys_ranks_only_ties(spark, monkeypatch):
    from obol.operators import split
    rows = [(i % 40, i % 3 and 1) for i in range(400)] + [(None, 1)] * 50 + [(None, 0)] * 3 + [(7, None)] * 5
    df = spark.createDataFrame(rows, "serial_number long, default_flag int")
    sizes = {(0, "test"): 27, (1, "test"): 63}  # 137 and 316 rows
    for got in (split.stratified_split(df), split.stratified_three_way(df)):
        c = {(r[0], r[1]): r[2] for r in got.groupBy("default_flag", "split").count().collect()}
        assert {k: c[k] for k in sizes} == sizes
        assert sum(c.values()) == 453 and got.columns == ["default_flag", "serial_number", "split"]
    assert c[0, "val"] == 14 and c[1, "val"] == 32
    ranked = []
    monkeypatch.setattr(split, "running", lambda d, *a: ranked.append(d.count()) or pytest.fail("all rows ranked"))
    single = spark.range(5000).selectExpr("id as serial_number", "cast(id % 4 = 0 as int) as default_flag")
    got = split.stratified_three_way(single).groupBy("default_flag", "split").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(0, "test"): 750, (0, "val"): 375, (0, "train"): 2625, (1, "test"): 250, (1, "val"): 125, (1, "train"): 875}
    assert not ranked


def test_overdue_long_partitions_grow_with_the_rows(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id as serial_number", *[f"cast((id + {i}) % 3 as bigint) as o{i}" for i in range(8)])
    want = {r["serial_number"]: r for r in features.overdue_long_features(features.overdue_long(df)).collect()}
    monkeypatch.setattr(features, "LONG_ROWS", 1000)
    long = features.overdue_long(df)
    assert long.rdd.getNumPartitions() == 24
    assert max(long.groupBy(F.spark_partition_id()).count().toPandas()["count"]) < 2000
    got = {r["serial_number"]: r for r in features.overdue_long_features(long).collect()}
    assert got == want
