"""What fits and scores read: each row scored once, assembled once, folds dealt evenly."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from obol import config as C
from obol.operators import metrics, ml, search
from obol.plans import queries, training

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    out = [(i, int(rng.random() > 0.7), rng.random(), rng.random(), float(i % 3)) for i in range(300)]
    return spark.createDataFrame(out, f"{C.KEY} long, {C.LABEL} int, a double, b double, c double") \
        .withColumn("weight", F.lit(1.0)).repartition(3, C.KEY)


@pytest.fixture(scope="module")
def models(rows):
    return ml.fit_all(rows, COLS, ml.base_learners(weight_col="weight", trees=3))


def _counted(spark, df, column):
    """``df`` whose ``column`` passes through a function that counts its rows, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x
    return df.withColumn(column, F.udf(same, "double").asNondeterministic()(column)), seen


def test_auc_evaluates_its_input_once(spark):
    df = spark.range(50).select(F.lit("m").alias("model"), (F.col("id") % 2).alias("y"), (F.col("id") / 50).alias("p"))
    d, seen = _counted(spark, df, "p")
    assert metrics.auc(d).first()["auc"] == metrics.auc(df).first()["auc"]
    assert seen.value == 50


def test_train_eval_scores_each_row_once(spark, rows, models, monkeypatch):
    d, seen = _counted(spark, training.long_predictions(models, rows), "p")
    monkeypatch.setattr(training, "train_eval", lambda *a, **k: (models, d, COLS, rows))
    assert queries.q_ml_train_eval(spark, "").count() == 3
    assert seen.value == 3 * 300


def test_bases_of_the_same_columns_share_one_assembly(rows, models):
    wide = ml.StackingModel(models).base_probabilities(rows)
    assert wide.columns == [*rows.columns, *(f"p_{n}" for n in models)]
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS features#") == 1
    got = {r[C.KEY]: r for r in wide.collect()}
    for n, m in models.items():
        for r in ml.positive_probability(m.transform(rows)).collect():
            assert got[r[C.KEY]][f"p_{n}"] == r["p"]


def test_bases_of_different_columns_are_assembled_apart(rows, models):
    other = ml.fit(rows, ["c", "a"], ml.base_learners(trees=2)["GBT_shallow"])
    both = {"GBT_deep": models["GBT_deep"], "other": other}
    got = {r[C.KEY]: r for r in ml.StackingModel(both).base_probabilities(rows).collect()}
    for n, m in both.items():
        for r in ml.positive_probability(m.transform(rows)).collect():
            assert got[r[C.KEY]][f"p_{n}"] == r["p"]


def test_fits_on_shared_rows_are_those_of_single_pipelines(rows, models):
    for n, e in ml.base_learners(weight_col="weight", trees=3).items():
        assert isinstance(models[n].stages[0], VectorAssembler)
        assert models[n].stages[-1].toDebugString.split("\n")[1:] == ml.fit(rows, COLS, e).stages[-1].toDebugString.split("\n")[1:]


def test_rows_of_one_task_are_dealt_evenly(spark):
    df = spark.range(1000).select(F.col("id").alias(C.KEY)).coalesce(1)
    assert search.evenly(df, most=1000) is df
    dealt = search.evenly(df, most=100)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200 and sum(sizes) == 1000
    assert sorted(r[0] for r in dealt.collect()) == list(range(1000))
    assert search.evenly(df.limit(0)).count() == 0
