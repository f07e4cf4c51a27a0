"""Encoder stages: fit, save and load against the plain encoder functions."""

import os
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from obol.operators import encoders, stages

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COLS = ["edu", "product"]
SCHEMA = "k long, edu string, product string, post_res string, post_perm string, address_match int, y int"


def _rows(n=240):
    return [(i, None if i % 11 == 0 else f"e{i % 4}", f"p{i % 3}", f"{100000 + i % 5}", f"{100000 + i % 7}", i % 2,
             int((i * 7 + i % 4) % 5 < 2)) for i in range(n)]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def new(spark):
    return spark.createDataFrame([(1, "e1", "p2", "100001", "100003", 1, None), (2, "never", "p0", "999999", None, 0, None),
                                  (3, None, None, None, "100002", None, None)], SCHEMA)


def _pipeline():
    feats = [f"{c}_{s}" for c in COLS for s in ("woe", "target_enc", "freq")] + ["res_risk_score", "perm_risk_score", "city_risk_score"]
    return Pipeline(stages=[
        stages.WoeEncoder(inputCols=COLS, labelCol="y"), stages.TargetEncoder(inputCols=COLS, labelCol="y", smoothing=5.0),
        stages.FrequencyEncoder(inputCols=COLS, labelCol="y"), stages.GeoRiskEncoder(labelCol="y"),
        VectorAssembler(inputCols=feats, outputCol="features"), LogisticRegression(labelCol="y", maxIter=10, regParam=0.1)])


def _scores(model, df):
    out = model.transform(df).select("k", vector_to_array("probability")[1].alias("p"), "edu_woe", "product_target_enc", "edu_freq", "res_risk_score")
    return sorted(tuple(r) for r in out.collect())


def test_stages_equal_the_encoder_functions(train, new):
    cases = [
        (stages.WoeEncoder(inputCols=COLS, labelCol="y"), encoders.woe_apply(new, encoders.woe_fit(train, COLS, "y"), COLS)),
        (stages.TargetEncoder(inputCols=COLS, labelCol="y", smoothing=5.0),
         encoders.target_apply(new, encoders.target_fit(train, COLS, "y", 5.0), COLS)),
        (stages.FrequencyEncoder(inputCols=COLS, labelCol="y"), encoders.frequency_apply(new, encoders.frequency_fit(train, COLS, label="y"), COLS)),
        (stages.GeoRiskEncoder(labelCol="y"), encoders.geo_apply(new, encoders.geo_fit(train, "y"))),
    ]
    for est, want in cases:
        got = est.fit(train).transform(new)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), type(est).__name__


def test_rows_without_a_label_are_not_learned_from(train, new):
    a, b = (stages.FrequencyEncoder(inputCols=COLS, labelCol="y").fit(d) for d in (train, train.union(new)))
    assert sorted(map(str, a.table.collect())) == sorted(map(str, b.table.collect()))


def test_pipeline_saved_and_loaded_again(spark, train, new, tmp_path):
    model = _pipeline().fit(train)
    want = _scores(model, new)
    path = str(tmp_path / "scoring")
    back = stages.saved_round_trip(model, path, spark)
    assert _scores(back, new) == want
    assert [s.uid for s in back.stages] == [s.uid for s in model.stages]
    assert back.stages[1].getInputCols() == COLS and back.stages[3].getInputCols() == ["post_res", "post_perm"]
    stages.saved_round_trip(back, str(tmp_path / "copy"), spark)
    assert _scores(PipelineModel.load(path), new) == want
    again = Pipeline.load(_save(_pipeline(), str(tmp_path / "unfitted"))).fit(train)
    assert _scores(again, new) == want


def _save(pipeline, path):
    pipeline.write().overwrite().save(path)
    return path


def test_saved_pipeline_scores_alike_in_a_new_session(train, new, tmp_path):
    model = _pipeline().fit(train)
    path, rows = str(tmp_path / "model"), str(tmp_path / "rows")
    model.write().save(path)
    new.write.parquet(rows)
    code = ("import sys; from pyspark.ml import PipelineModel; from pyspark.ml.functions import vector_to_array as a\n"
            "from obol.session import local_session; s = local_session('2', app='reload')\n"
            f"out = PipelineModel.load({path!r}).transform(s.read.parquet({rows!r}))\n"
            "print('SCORES', sorted((r.k, r.p) for r in out.select('k', a('probability')[1].alias('p')).collect()))")
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=180, check=True)
    line = next(x for x in run.stdout.splitlines() if x.startswith("SCORES"))
    assert line == f"SCORES {[(k, p) for k, p, *_ in _scores(model, new)]}"


def test_empty_fit_and_empty_input(spark, train, new):
    empty = train.limit(0)
    for est in (stages.WoeEncoder(inputCols=COLS, labelCol="y"), stages.TargetEncoder(inputCols=COLS, labelCol="y"),
                stages.FrequencyEncoder(inputCols=COLS, labelCol="y"), stages.GeoRiskEncoder(labelCol="y")):
        assert est.fit(empty).transform(new).count() == 3
        assert est.fit(train).transform(new.limit(0)).count() == 0
    woe = stages.WoeEncoder(inputCols=COLS, labelCol="y").fit(train.where(F.col("y") == 1)).transform(new)
    assert {r.edu_woe for r in woe.collect()} == {0.0}
