"""Sparse one-hot, joined thresholds, feature selection, decision rules and permutation importance on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obol import config as C
from obol.operators import metrics, ml, monitor


def test_sparse_one_hot_without_a_level_limit(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("k"), F.format_string("v%06d", F.col("id") % 15_000).alias("c"),
                               F.when(F.col("id") % 3 == 0, F.lit("a")).alias("d"), F.lit("only").alias("e"))
    levels = ml.fit_one_hot(df, ["c", "d", "e"])
    assert levels.count() == 15_003
    v = ml.one_hot_vectors(df, levels, ["c", "d", "e"])
    assert v.columns == ["k", "c", "d", "e", "one_hot"]
    row = v.where("k = 4").first()["one_hot"]
    # 14,999 slots of c (the first level has none), one of d, none of e
    assert row.size == 15_000 and row.indices.tolist() == [14_999 - 4, 14_999]
    got = ml.vector_entries(v, "one_hot", ["k"]).groupBy("position").count()
    want = {14_999 - k % 15_000: 0 for k in range(1, 15_000)}
    counts = {r["position"]: r["count"] for r in got.collect()}
    assert set(counts) == set(want) | {14_999} and counts[14_999] == n - (n + 2) // 3
    assert counts[14_999 - 1] == 2 and counts[14_999 - 6000] == 1


def test_sparse_one_hot_unknown_null_and_single_levels(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "k long, c string")
    levels = ml.fit_one_hot(df, ["c"])
    new = spark.createDataFrame([(4, "zzz"), (5, "a"), (6, None), (7, "b")], "k long, c string")
    got = {r["k"]: r["one_hot"].toArray().tolist() for r in ml.one_hot_vectors(new, levels, ["c"]).collect()}
    assert got == {4: [0, 0], 5: [0, 0], 6: [1, 0], 7: [0, 1]}
    one = ml.fit_one_hot(df.where("k = 1"), ["c"])
    assert ml.one_hot_vectors(new, one, ["c"]).first()["one_hot"].size == 0


def test_confusion_against_counts_for_many_thresholds(spark):
    rng = random.Random(2)
    rows = [(m, rng.randint(0, 1), rng.choice([0.0, 0.25, 0.5, 0.5, 1.0, round(rng.random(), 2)])) for m in "ab" for _ in range(200)]
    df = spark.createDataFrame([*rows, ("a", 1, None)], "model string, y int, p double")
    names = {f"t{i}": i / 50 for i in range(51)}
    t = spark.createDataFrame(list(names.items()), "threshold_name string, t double")
    for thresholds in (names, t):
        got = {(r.model, r.threshold_name, r.actual, r.predicted): r.n for r in metrics.confusion(df, thresholds).collect()}
        assert len(got) == 2 * 51 * 4
        for (m, name, a, b), n in got.items():
            assert n == sum(x == m and y == a and int(p >= names[name]) == b for x, y, p in rows)
    assert metrics.confusion(df.limit(0), names).count() == 0


def test_feature_selection_order_reasons_and_limit(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        a, b, c = rng.gauss(0, 3), rng.gauss(5, 2), rng.gauss(0, 1)
        rows.append((a, b, c, 2 * a + 1, -b + 0.01 * c, 0.001 * c, None if i % 2 else a, 1.0))
    cols = ["a", "b", "c", "twin", "mirror", "flat", "gaps", "const"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = {r.feature: r for r in monitor.feature_selection(df, cols).collect()}
    assert [got[c].kept for c in cols] == [1, 1, 1, 0, 0, 0, 1, 0]
    assert (got["twin"].reason, got["twin"].partner) == ("correlation", "a") and got["mirror"].partner == "b"
    assert got["flat"].reason == got["const"].reason == "variance"
    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    assert np.allclose(monitor.correlations(df, cols)[:7, :7], np.corrcoef(x[:, :7].T), atol=1e-9)
    few = {r.feature: r.reason for r in monitor.feature_selection(df, ["c", "twin", "a", "b"], most=2).collect()}
    assert few == {"c": None, "twin": None, "a": "correlation", "b": "limit"}
    assert all(r.reason == "variance" for r in monitor.feature_selection(df.limit(0), cols).collect())


def test_decision_uses_the_history_a_table_has(spark):
    base = dict(debt_to_income_ratio=0.1, late_payments_count=4, credit_history_months=9, annual_income=1.0, on_time_payment_rate=0.1,
                credit_utilization_rate=0.9, missed_payments_count=0)
    cases = [(None, None, 24, "conditional"), (None, None, 23, "review"), (None, None, None, "review"), (2, None, 30, "reject"),
             (3, None, 30, "conditional"), (None, 3, 30, "reject"), (None, 4, 30, "conditional")]
    df = spark.createDataFrame([(*base.values(), *c) for c in cases],
                               ", ".join(f"{k} {'int' if isinstance(v, int) else 'double'}" for k, v in base.items())
                               + ", years_since_bankruptcy int, years_since_foreclosure int, employment_months int, want string")
    assert all(r.decision == r.want for r in monitor.auto_decision(df).collect())
    assert all(r.decision == "review" for r in monitor.auto_decision(df.select(*base)).collect())


def test_permutation_importance_of_three_models(spark):
    rng = random.Random(8)
    rows = [(i, int(a > 0.6), a, rng.random(), rng.random()) for i in range(600) for a in [rng.random()]]
    df = spark.createDataFrame(rows, f"{C.KEY} long, {C.LABEL} int, a double, b double, c double").repartition(3)
    moved = ml.with_permuted(df, ["a", "b"], block=50)
    for c in ("a", "b"):
        assert sorted(r[c] for r in moved.collect()) == sorted(r[f"_next_{c}"] for r in moved.collect())
    # one permutation for all columns: a row's next values come from one row
    pairs = {(r["a"], r["b"]) for r in moved.collect()}
    assert all((r["_next_a"], r["_next_b"]) in pairs for r in moved.collect())
    models = {n: ml.fit(df, ["a", "b", "c"], e) for n, e in ml.base_learners(trees=3).items()}
    got = ml.permutation_importance(models, df, ["a", "b", "c"]).collect()
    assert len(got) == 12
    for m in [*models, "mean"]:
        own = {r.feature: r for r in got if r.model == m}
        assert own["a"].rank == 1 and own["a"].importance > 0.2 and abs(own["b"].importance) < 0.1
    for f in "abc":
        assert next(r.importance for r in got if (r.model, r.feature) == ("mean", f)) == pytest.approx(
            np.mean([r.importance for r in got if r.feature == f and r.model != "mean"]))
