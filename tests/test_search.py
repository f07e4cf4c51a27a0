"""Random search, sweep and stacking: resumption, repeatability, folds kept apart, metrics over predictions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obol import config as C
from obol.operators import metrics, ml, search, split
from obol.plans import training

SMALL = {"GBT_shallow": {"maxIter": [2, 3], "maxDepth": [2, 3]}, "RandomForest": {"numTrees": [3, 5], "maxDepth": [2, 4]}}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(400):
        a, b = rng.random(), rng.random()
        out.append((i, int(a + 0.3 * rng.random() > 0.85), a, b, rng.random()))
    return spark.createDataFrame(out, f"{C.KEY} long, {C.LABEL} int, a double, b double, c double").repartition(3)


def _learners(weight="weight"):
    return {n: e for n, e in ml.base_learners(weight_col=weight, trees=3).items() if n in SMALL}


def test_learners_have_the_tuned_parameters(spark):
    est = ml.base_learners(weight_col="w")
    assert [est[n].getOrDefault("maxIter") for n in ("GBT_shallow", "GBT_deep")] == [200, 300]
    assert est["RandomForest"].getNumTrees() == 100 and est["RandomForest"].getMaxBins() == 254
    assert not est["GBT_shallow"].isSet("weightCol") and est["GBT_deep"].getOrDefault("weightCol") == "w"


def test_draws_are_different_points_and_repeat():
    space = C.SEARCH_SPACES["GBT_deep"]
    one, two = search.draws(space, C.SEARCH_DRAWS, 42, "x"), search.draws(space, C.SEARCH_DRAWS, 42, "x")
    assert one == two and len({json.dumps(p) for p in one}) == 20 and one != search.draws(space, 20, 43, "x")
    assert all(p[k] in v for p in one for k, v in space.items())
    assert len(search.draws({"a": [1, 2]}, 20, 1, "x")) == 2


def test_random_search_scores_every_learner_and_resumes(spark, rows, tmp_path):
    path = str(tmp_path / "runs")
    res, models = search.random_search(rows, ["a", "b", "c"], _learners(), SMALL, n_draws=2, folds=3, path=path)
    got = {(r.learner, r.draw): r for r in res.collect()}
    assert set(got) == {(n, d) for n in SMALL for d in range(2)} and all(r.folds == 3 for r in got.values())
    for n in SMALL:
        own = [r for (name, _), r in got.items() if name == n]
        assert [r.best for r in sorted(own, key=lambda r: (-r.cv_auc, r.draw))] == [1, 0]
        p = json.loads(next(r.params for r in own if r.best))
        m = models[n].stages[-1]
        assert all(m.getOrDefault(k) == v for k, v in p.items())
        assert metrics.auc(ml.positive_probability(models[n].transform(rows)).select(F.col(C.LABEL).alias("y"), "p")).first()["auc"] > 0.8
    # a broken search: one run is lost, one row is marked; only the lost one is fitted again
    kept = search.RunTable(spark, path, "learner string, draw int, fold int, params string, auc double")
    kept.add("GBT_shallow-0-0", ("GBT_shallow", 0, 0, got["GBT_shallow", 0].params, 7.0))
    again, _ = search.random_search(rows, ["a", "b", "c"], _learners(), SMALL, n_draws=2, folds=3, path=path)
    new = {(r.learner, r.draw): r for r in again.collect()}
    assert new["GBT_shallow", 0].cv_auc > 2 and new["RandomForest", 1] == got["RandomForest", 1]
    # a fold's score is that of a model fitted without the fold
    f = split.stratified_folds(rows, 3)
    d = split.with_weights(f)
    values = json.loads(got["RandomForest", 0].params)
    est = search.fitted_with(_learners()["RandomForest"], values)
    aucs = []
    for k in range(3):
        m = ml.fit(d.where(F.col("fold") != k), ["a", "b", "c"], est)
        aucs.append(search.auc_of(m.transform(d.where(F.col("fold") == k)), C.LABEL))
    assert got["RandomForest", 0].cv_auc == pytest.approx(np.mean(aucs), abs=0.05)


def test_parallel_jobs_keep_order_and_raise(spark):
    assert search.in_parallel(spark, [lambda i=i: spark.range(i).count() for i in range(5)], 3) == list(range(5))
    with pytest.raises(ZeroDivisionError):
        search.in_parallel(spark, [lambda: 1 // 0, lambda: 2], 2)


def test_stacking_scores_each_row_once_outside_its_fold(spark, rows):
    st = ml.fit_stacking(split.with_weights(rows), ["a", "b", "c"], _learners(), k=3)
    oof = st.oof.collect()
    assert len(oof) == 400 and len({r[C.KEY] for r in oof}) == 400
    fold = {r[C.KEY]: r["fold"] for r in split.stratified_folds(rows, 3).collect()}
    assert all(fold[r[C.KEY]] == r["fold"] for r in oof)
    # the probabilities of a fold are those of a base fitted on the other folds
    d = split.with_weights(split.stratified_folds(rows, 3))
    m = ml.fit(d.where("fold <> 1"), ["a", "b", "c"], _learners()["GBT_shallow"])
    want = {r[C.KEY]: r["p"] for r in ml.positive_probability(m.transform(d.where("fold = 1"))).collect()}
    assert np.corrcoef([want[r[C.KEY]] for r in oof if r["fold"] == 1], [r["p_GBT_shallow"] for r in oof if r["fold"] == 1])[0, 1] > 0.9
    p = st.transform(rows).select("p").collect()
    assert len(p) == 400 and all(0 <= r["p"] <= 1 for r in p)


def test_trained_models_and_their_metrics(spark):
    sf = "/root/testdata/sf0.001"
    models, long, feats, m = training.train_eval(spark, sf, trees=3)
    assert training.trained(spark, sf, 3)[0] is models  # fitted once an application
    pred = long.toPandas()
    n_test = m.where("split = 'test'").count()
    assert list(models) == list(C.MODEL_PARAMS) and len(pred) == 3 * n_test and pred.p.between(0, 1).all()
    got = {r.model: r for r in metrics.model_metrics(long, 0.5).collect()}
    for name, own in pred.groupby("model"):
        pos, neg = own.p[own.y == 1].to_numpy(), own.p[own.y == 0].to_numpy()
        wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
        assert got[name].auc == pytest.approx(wins)
        assert got[name].accuracy == pytest.approx(((own.p >= 0.5) == (own.y == 1)).mean())
    weight = {r[C.LABEL]: r["w"] for r in m.where("split = 'train'").groupBy(C.LABEL).agg(F.first("weight").alias("w"), F.count("*").alias("n")).collect()}
    assert weight[1] > weight[0]
    assert len(feats) == len(set(feats))


def test_medians_come_from_the_train_rows(spark):
    f = training.feature_frame(spark, "/root/testdata/sf0.001")
    from obol.sources import fixtures as fx
    raw = fx.loans(spark, "/root/testdata/sf0.001").select(C.KEY, F.col("month_salary").alias("raw")).join(f.select(C.KEY, "split", "month_salary"), C.KEY)
    filled = {r[0] for r in raw.where("raw is null").select("month_salary").distinct().collect()}
    train = np.median([r[0] for r in raw.where("split = 'train' and raw is not null").select("raw").collect()])
    assert filled == {train}


def test_sweep_resumes_and_flags_the_best(spark, tmp_path):
    assert training.sweep_settings(3) == training.sweep_settings(5)[:3]
    path = str(tmp_path / "sweep")
    one = {r.run: r for r in training.sweep(spark, "/root/testdata/sf0.001", runs=1, trees=2, path=path).collect()}
    two = {r.run: r for r in training.sweep(spark, "/root/testdata/sf0.001", runs=2, trees=2, path=path, parallelism=2).collect()}
    assert set(two) == {0, 1} and two[0].val_auc == one[0].val_auc and sum(r.best for r in two.values()) == 1
    best = max(two.values(), key=lambda r: (r.val_auc, -r.run))
    assert best.best == 1
    for r in two.values():
        cfg = json.loads(r.settings)
        assert set(cfg) == set(C.SWEEP_SPACE) and 0 <= r.val_auc <= 1
