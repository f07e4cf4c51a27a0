"""Operator behaviour beyond the SQL oracles: sources/sinks, splits, history
as-of, metrics against brute force, encoders, monitoring rules."""

import datetime as dt
import math
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from obol import config as C
from obol.operators import cleaning, encoders, history, metrics, ml, monitor, profile, scoring, split
from obol.sources import io as sio


def test_permissive_csv_keeps_bad_rows(spark):
    d = tempfile.mkdtemp(prefix="obol-csv-", dir="/tmp")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write("a,b\n1,x\nnot_a_number,y\n3,z\n")
    from pyspark.sql import types as T
    df = sio.read_csv(spark, p, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())]))
    rows = sorted(df.collect(), key=lambda r: r["b"])
    assert [r["a"] for r in rows] == [1, None, 3]
    assert rows[1][sio.CORRUPT] == "not_a_number,y" and rows[0][sio.CORRUPT] is None


def test_threshold_config_roundtrip_and_fallback(spark):
    cfg = scoring.threshold_config(spark, 0.27, "Stacking")
    p = ml.state_path(spark, "t")
    scoring.write_threshold(cfg, p)
    assert scoring.load_threshold(spark, p).first()["optimal_threshold"] == 0.27
    assert scoring.load_threshold(spark, ml.state_path(spark, "none")).first()["optimal_threshold"] == 0.5
    assert scoring.read_threshold(scoring.threshold_config(spark, None), spark).first()["optimal_threshold"] == 0.5


def test_model_save_load_same_predictions(spark):
    rng = random.Random(1)
    rows = [(i, int(x + rng.random() > 1.0), x, rng.random()) for i, x in ((i, rng.random()) for i in range(300))]
    df = spark.createDataFrame(rows, "serial_number long, default_flag int, a double, b double")
    m = ml.fit(df, ["a", "b"], ml.base_learners(trees=20)["GBT_shallow"])
    m2 = ml.save_model(m, ml.state_path(spark, "m"))
    p1 = ml.positive_probability(m.transform(df)).select("serial_number", "p").orderBy("serial_number").collect()
    p2 = ml.positive_probability(m2.transform(df)).select("serial_number", "p").orderBy("serial_number").collect()
    assert p1 == p2


@pytest.fixture(scope="module")
def labeled(spark):
    rng = random.Random(2)
    rows = [(i, int(rng.random() < 0.2), dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 99))) for i in range(1003)]
    return spark.createDataFrame(rows, "serial_number long, default_flag int, application_date date")


def test_stratified_split_exact_and_disjoint(labeled):
    s = split.stratified_split(labeled).groupBy("default_flag", "split").count().collect()
    n = {(r["default_flag"], r["split"]): r["count"] for r in s}
    for y in (0, 1):
        tot = n[(y, "test")] + n[(y, "train")]
        assert n[(y, "test")] == math.floor(tot * 0.2 + 0.5)
    three = split.stratified_three_way(labeled)
    assert three.count() == labeled.count() and three.select("serial_number").distinct().count() == labeled.count()
    folds = split.stratified_folds(labeled).groupBy("default_flag", "fold").count().collect()
    by = {}
    for r in folds:
        by.setdefault(r["default_flag"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by.values())


def test_chronological_split_sizes(labeled):
    s = split.chronological_split(labeled)
    n = labeled.count()
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c["train"] == int(n * 0.7) and c["val"] == int(n * 0.15) and c["test"] == n - int(n * 0.7) - int(n * 0.15)
    mx_train = s.where("split = 'train'").agg(F.max("application_date")).first()[0]
    mn_test = s.where("split = 'test'").agg(F.min("application_date")).first()[0]
    assert mx_train <= mn_test


def test_undersample_and_weights(labeled):
    u = split.undersample(labeled).groupBy("default_flag").count().collect()
    assert len({r["count"] for r in u}) == 1
    w = {r["default_flag"]: r for r in split.class_weights(labeled).collect()}
    n0, n1 = w[0]["n_class"], w[1]["n_class"]
    assert w[1]["scale_pos_weight"] == n0 / n1
    assert math.isclose(w[0]["balanced_weight"], (n0 + n1) / (2 * n0))


def test_bounded_sample(labeled):
    s = split.bounded_sample(labeled, 17)
    assert s.count() == 17


def test_asof_history_matches_bruteforce(spark):
    rng = random.Random(8)
    rows = []
    for k in range(300):
        cid = rng.randint(1, 20)
        d = dt.date(2021, 1, 1) + dt.timedelta(days=rng.randint(0, 200))
        rows.append((k, cid, d, rng.randint(0, 1), float(rng.randint(0, 60)), rng.randint(0, 10), rng.choice([0, 10])))
    df = spark.createDataFrame(rows, "serial_number long, id long, application_date date, default_flag int, "
                                     "overdue_days double, paid_installments long, loan_term long")
    got = {r["serial_number"]: r for r in history.client_history_asof(df, 30, strategy="ranged").collect()}
    for r in rows:
        prev = [e for e in rows if e[1] == r[1] and e[2] + dt.timedelta(days=30) <= r[2]]
        g = got[r[0]]
        assert g["cumulative_loans"] == len(prev)
        assert g["cumulative_defaults"] == sum(e[3] for e in prev)
        if prev:
            last = max(prev, key=lambda e: (e[2], e[0]))
            assert g["prev_overdue_days"] == last[4]
            assert g["prev_payment_ratio"] == ((last[5] / last[6]) if last[6] > 0 else 0.0)
        else:
            assert g["is_new_customer"] == 1


def test_history_for_new_clients(spark):
    past = spark.createDataFrame([(1, 10, dt.date(2020, 1, 1), 1, 30.0, 3, 6)],
                                 "serial_number long, id long, application_date date, default_flag int, "
                                 "overdue_days double, paid_installments long, loan_term long")
    new = spark.createDataFrame([(2, 10, dt.date(2021, 1, 1)), (3, 99, dt.date(2021, 1, 1))],
                                "serial_number long, id long, application_date date")
    got = {r["serial_number"]: r for r in history.history_for_new(past, new).collect()}
    assert got[2]["historical_default"] == 1 and got[2]["prev_payment_ratio"] == 0.5 and got[2]["cumulative_loans"] == 1
    assert got[3]["is_new_customer"] == 1 and got[3]["cumulative_loans"] == 0


def test_new_applications_see_each_other_but_no_outcome(spark):
    past = spark.createDataFrame([(1, 10, dt.date(2020, 1, 1), 1, 30.0, 3, 6), (2, 10, dt.date(2020, 6, 1), 0, 5.0, 6, 6),
                                  (9, 10, dt.date(2022, 1, 1), 1, 99.0, 1, 6)],
                                 "serial_number long, id long, application_date date, default_flag int, "
                                 "overdue_days double, paid_installments long, loan_term long")
    new = spark.createDataFrame([(3, 10, dt.date(2021, 1, 1)), (4, 10, dt.date(2021, 2, 1)), (5, 77, dt.date(2021, 1, 1)),
                                 (6, 77, dt.date(2021, 1, 1)), (7, None, dt.date(2021, 1, 1)), (8, None, dt.date(2021, 1, 2))],
                                "serial_number long, id long, application_date date")
    for strategy in ("window", "ranged"):
        got = {r["serial_number"]: r for r in history.history_for_new(past, new, strategy=strategy).collect()}
        assert set(got) == {3, 4, 5, 6, 7, 8}
        assert [got[i]["cumulative_loans"] for i in (3, 4, 5, 6, 7, 8)] == [2, 3, 0, 1, 0, 0]
        assert got[4]["customer_default_rate"] == 0.5 and got[4]["cumulative_defaults"] == 1
        assert got[4]["prev_overdue_days"] == 5.0 and got[4]["prev_payment_ratio"] == 1.0  # of the last loan with an outcome
        assert got[6]["is_new_customer"] == 0 and got[6]["historical_default"] == 0 and got[6]["customer_default_rate"] == 0.0


def test_average_precision_and_log_loss(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(200)] + [(1, 1.0), (0, 0.0)]
    df = spark.createDataFrame(rows, "y int, p double")
    ap = metrics.average_precision(df).first()["auc_pr"]
    order = sorted(set(p for _, p in rows), reverse=True)
    P = sum(y for y, _ in rows)
    tp = pp = 0
    want = 0.0
    for t in order:
        grp = [y for y, p in rows if p == t]
        tp += sum(grp)
        pp += len(grp)
        want += sum(grp) / P * (tp / pp)
    assert ap == pytest.approx(want, abs=1e-12)
    ll = metrics.log_loss(df).first()["log_loss"]
    eps = np.finfo(float).eps
    q = np.clip(np.array([p for _, p in rows]), eps, 1 - eps)
    y = np.array([y for y, _ in rows])
    assert ll == pytest.approx(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)), rel=1e-12)


def test_confusion_cells_zero_filled(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8)], "y int, p double")
    c = metrics.confusion(df, {"default": 0.5}).collect()
    cells = {(r["actual"], r["predicted"]): r["n"] for r in c}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_one_hot_unknown_and_robust_zero_iqr(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "k long, c string")
    lv = ml.fit_one_hot_levels(df, ["c"])
    assert lv == {"c": ["a", "b", "missing"]}
    new = spark.createDataFrame([(4, "zzz")], "k long, c string")
    r = ml.apply_one_hot(new, lv).first()
    assert r["c__b"] == 0 and r["c__missing"] == 0
    z = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "k long, x double")
    s = ml.apply_robust_scaler(z, ml.fit_robust_scaler(z, ["x"]), ["x"]).collect()
    assert all(r["x"] == 0.0 for r in s)


def test_quantile_bins_ties_share_bin(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 1, 2, 3, 4, 5, 6, 7])], "k long, x double")
    b = profile.quantile_bins(df, "x", ["lo", "mid", "hi"], "bin").collect()
    ones = {r["bin"] for r in b if r["x"] == 1.0}
    assert len(ones) == 1 and all(r["bin"] is not None for r in b)


def test_permutation_keeps_marginals(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "serial_number long, x double")
    p = ml.permuted(df, "x", block=50)
    a = sorted(r["x"] for r in df.collect())
    b = sorted(r["x"] for r in p.collect())
    assert a == b and p.count() == 500


def test_feature_category_order(spark):
    df = spark.createDataFrame([("early_warning_score",), ("early_overdue_count",), ("prev_overdue_days",),
                                ("education_woe",), ("dti_ratio",), ("loan_term",)], "feature string")
    got = [r["c"] for r in df.select(profile.feature_category("feature").alias("c")).collect()]
    assert got == ["Tier 2: Advanced Time Series", "Tier 1: Overdue Patterns", "Customer History",
                   "WoE Encoded (Categorical)", "Financial Capability", "Other Features"]


def test_months_since_end_of_month_rule(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 31)), (2, dt.date(2024, 1, 30)), (3, dt.date(2024, 2, 29))],
                               "serial_number long, application_date date")
    t = {r["serial_number"]: r for r in monitor.temporal_features(df, as_of="2024-02-29").collect()}
    assert t[1]["months_since_application"] == 1      # both month ends -> whole month
    assert t[2]["months_since_application"] == 0      # 30 Jan -> 29 Feb is not a whole month
    assert t[3]["days_since_application"] == 0


def test_header_helpers_and_contract(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long").toDF("\nloan term ", "paid installments")
    n = cleaning.normalize_headers(df, snake_case=True)
    assert n.columns == ["loan_term", "paid_installments"]
    assert cleaning.find_column(n, "PAID") == "paid_installments"
    assert cleaning.missing_columns(n, ["loan_term", "product"]) == ["product"]
    with pytest.raises(ValueError):
        cleaning.require_columns(n, ["product"])
    filled, warned = cleaning.fill_optional_columns(n, ["o0", "loan_term"], 0)
    assert warned == ["o0"] and filled.first()["o0"] == 0


def test_drop_header_rows(spark):
    df = spark.createDataFrame([("month salary", "loan term"), ("25000", "12"), ("n/a", "6")], "s string, t string")
    assert cleaning.drop_header_rows(df, ["s", "t"]).count() == 2


def test_psi_and_provisions(spark):
    a = spark.createDataFrame([(0.05,), (0.15,), (0.15,), (0.95,)], "p double")
    assert monitor.psi(a, a, "p").first()["psi"] == 0.0
    pr = {r["tier"]: r for r in monitor.provisions(
        spark.createDataFrame([(0.01, 100.0), (0.02, 100.0), (0.7, 10.0)], "p double, e double"), "p", "e").collect()}
    assert pr["Excellent"]["n"] == 1 and pr["Good"]["n"] == 1          # 0.02 falls in the next tier
    assert pr["Loss"]["provision"] == 10.0


def test_enrich_match_rate(spark):
    l = spark.createDataFrame([(1, 10), (2, 11), (3, 99)], "serial_number long, id long")
    c = spark.createDataFrame([(10, "a"), (11, "b")], "customer_id long, job string")
    j, rep = profile.enrich(l, c, "id", "customer_id")
    r = rep.first()
    assert (r["total"], r["matched"]) == (3, 2) and j.count() == 3


def test_event_time_independent_of_session_time_zone(spark):
    from obol.plans.queries import QUERIES
    from tests.oracle_harness import compare, duck_connect
    con = duck_connect("/root/testdata/sf0.001")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("Asia/Taipei", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            for name in ("stream_overdue_features", "temporal_features", "time_range"):
                r = compare(spark, con, name, "/root/testdata/sf0.001")
                assert r["status"] == "ok", (tz, name, r.get("problems"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
