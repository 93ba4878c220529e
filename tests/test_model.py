import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.operators import (
    GLOBAL,
    SEGMENT,
    AlsParams,
    fit_als,
    fit_als_per_segment,
    with_item_type,
)
from ranksmith.operators.model import als_estimator, block_count


def vectors(table):
    return {r["id"]: np.array(r["features"], dtype=np.float64) for r in table.collect()}


def worst_gap(ratings, users, items, reg):
    """Largest error of (sum v v' + reg n I) x = sum r v over all users."""
    worst = 0.0
    rows = ratings.toPandas()
    for user, own in rows.groupby("user_id"):
        v = np.stack([items[i] for i in own["item_id"]])
        left = v.T @ v + reg * len(own) * np.eye(v.shape[1])
        worst = max(worst, np.abs(left @ users[user] - v.T @ own["rating"].to_numpy()).max())
    return worst


def test_presets():
    assert (GLOBAL.max_iter, GLOBAL.reg, GLOBAL.rank) == (10, 0.1, 10)
    assert (SEGMENT.max_iter, SEGMENT.reg) == (5, 0.01)


def test_factor_tables(model, ratings):
    assert model.user_factors.dtypes == [("id", "int"), ("features", "array<float>")]
    assert (model.n_users, model.n_items) == (60, model.item_factors.count())
    assert model.user_factors.count() == 60
    assert all(len(r["features"]) == 10 for r in model.item_factors.collect())


def test_user_factors_solve_their_equations(ratings, factors):
    users, items = factors
    assert worst_gap(ratings, users, items, GLOBAL.reg) < 1e-3


def test_same_seed_same_model_whatever_the_partitioning(ratings, factors):
    again = vectors(fit_als(ratings.repartition(5, "rating")).item_factors)
    assert max(np.abs(again[i] - v).max() for i, v in factors[1].items()) < 1e-4


def test_another_seed_another_model(ratings, factors):
    other = vectors(fit_als(ratings, AlsParams(seed=1)).item_factors)
    assert max(np.abs(other[i] - v).max() for i, v in factors[1].items()) > 1e-2


def test_bad_rows_are_refused(spark, ratings):
    bad = ratings.unionByName(spark.createDataFrame([(1, None, 3.0)], ratings.schema))
    with pytest.raises(ValueError, match="1 of"):
        fit_als(bad)
    with pytest.raises(ValueError, match="no ratings"):
        fit_als(ratings.where("user_id < 0"))
    for value in (float("inf"), float("-inf"), 1e39):
        with pytest.raises(ValueError, match="infinite"):
            fit_als(ratings.unionByName(spark.createDataFrame([(1, 100, value)], ratings.schema)))


def test_wide_ids_are_narrowed(ratings, factors):
    wide = ratings.withColumn("user_id", F.col("user_id").cast("bigint"))
    assert set(vectors(fit_als(wide).user_factors)) == set(factors[0])


def test_one_solver_whatever_the_size(ratings, model):
    assert model.als_model is not None
    estimator = als_estimator(AlsParams(blocks=3, storage="DISK_ONLY", checkpoint_interval=4))
    assert estimator.getNumUserBlocks() == estimator.getNumItemBlocks() == 3
    assert estimator.getFinalStorageLevel() == estimator.getIntermediateStorageLevel() == "DISK_ONLY"
    assert estimator.getCheckpointInterval() == 4


def test_block_count_grows_with_rows_only():
    assert [block_count(n) for n in (1, 60_000, 10**9, 10**12)] == [8, 8, 200, 200_000]


def test_duplicates_count_each(spark):
    twice = spark.createDataFrame([(1, 1, 8.0), (1, 1, 9.0), (1, 2, 4.0), (2, 1, 6.0)], "user_id int, item_id int, rating double")
    found = fit_als(twice, AlsParams(rank=2, max_iter=3))
    users, items = vectors(found.user_factors), vectors(found.item_factors)
    assert worst_gap(twice, users, items, 0.1) < 1e-4


def test_one_model_per_segment(ratings, catalog):
    typed = with_item_type(ratings, catalog)
    models = fit_als_per_segment(typed, ["TV", "Movie", "Opera"])
    assert list(models) == ["TV", "Movie"]
    tv = typed.where("Type = 'TV'")
    assert {r["id"] for r in models["TV"].item_factors.collect()} == {
        r["item_id"] for r in tv.select("item_id").distinct().collect()
    }
    alone = vectors(fit_als(tv, SEGMENT).user_factors)
    assert max(np.abs(alone[u] - v).max() for u, v in vectors(models["TV"].user_factors).items()) < 1e-4


def test_a_large_fit_keeps_one_round_of_shuffles(spark, ratings, factors, monkeypatch):
    from ranksmith.operators import model as module

    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()

    def standing():
        return tracker.shuffleStatuses().size()

    monkeypatch.setattr(module, "SMALL_FIT", 0)
    before = standing()
    found = fit_als(ratings)
    # The blocks' own, and those of the last round; ten rounds make twenty.
    assert standing() - before < 10
    for table, known in zip((found.user_factors, found.item_factors), factors):
        assert max(np.abs(known[i] - v).max() for i, v in vectors(table).items()) < 1e-4
