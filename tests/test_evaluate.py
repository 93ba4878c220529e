import math

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from ranksmith.operators import coldstart_report, predict, rmse
from ranksmith.operators import sizes

PAIRS = [(1, 100, 5.0), (1, 9999, 6.0), (9999, 100, 7.0), (9999, 9999, 8.0), (2, 101, 3.0)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "user_id int, item_id int, rating double")


def test_prediction_is_the_dot_product(model, ratings, factors):
    users, items = factors
    for r in predict(model, ratings).collect():
        assert abs(r["prediction"] - users[r["user_id"]] @ items[r["item_id"]]) < 1e-4


def test_prediction_matches_the_library_model(model, ratings):
    ours = predict(model, ratings).withColumnRenamed("prediction", "ours")
    both = model.als_model.transform(ours)
    assert both.agg(F.max(F.abs(F.col("ours") - F.col("prediction")))).first()[0] < 1e-4


def test_prediction_without_broadcast(model, ratings, monkeypatch):
    first = {tuple(r) for r in predict(model, ratings).collect()}
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in predict(model, ratings).collect()} == first


def test_cold_pairs_are_dropped_or_nan(model, pairs):
    dropped = {(r["user_id"], r["item_id"]) for r in predict(model, pairs).collect()}
    assert dropped == {(1, 100), (2, 101)}
    marked = {(r["user_id"], r["item_id"]): r["prediction"] for r in predict(model, pairs, "nan").collect()}
    assert len(marked) == 5
    assert {p for p, v in marked.items() if not math.isnan(v)} == dropped
    with pytest.raises(ValueError):
        predict(model, pairs, "keep")


def test_rmse_equals_the_library_evaluator(model, ratings):
    scored = predict(model, ratings)
    expected = RegressionEvaluator(
        metricName="rmse", labelCol="rating", predictionCol="prediction"
    ).evaluate(scored)
    found = rmse(scored).first()
    assert found["n_rows"] == ratings.count()
    assert abs(found["rmse"] - expected) < 1e-9


def test_rmse_by_group(spark):
    scored = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 3.0, 0.0), ("b", 5.0, 5.0)], "g string, rating double, prediction double"
    )
    assert {(r["g"], r["n_rows"], r["rmse"]) for r in rmse(scored, "g").collect()} == {
        ("a", 2, math.sqrt(5.0)),
        ("b", 1, 0.0),
    }


def test_nothing_to_evaluate_is_no_error(model, pairs):
    cold = pairs.where("user_id = 9999")
    found = rmse(predict(model, cold)).first()
    assert (found["n_rows"], found["rmse"]) == (0, None)
    report = coldstart_report(model, cold).first()
    assert (report["n_test"], report["n_scored"], report["n_dropped"], report["rmse"]) == (2, 0, 2, None)


def test_coldstart_report(model, pairs):
    report = coldstart_report(model, pairs).first()
    assert (report["n_test"], report["n_scored"], report["n_dropped"]) == (5, 2, 3)
    assert abs(report["rmse"] - rmse(predict(model, pairs)).first()["rmse"]) < 1e-9
