"""A user, an item or a pair that holds a third of all rows must change nothing but the counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.operators import (
    AlsParams,
    coldstart_report,
    first_per_list,
    fit_als,
    predict,
    profile_ratings,
    resolve_duplicates,
    rmse,
    top_items,
    with_item_type,
)
from ranksmith.operators import sizes

N = 30_000


def skewed(spark, kind):
    """A third of the rows belongs to user 7, to item 8, or to the pair of both."""
    key = F.col("id")
    hot = key % 3 == 0
    user = (F.xxhash64(key, F.lit(1)) % 500 + 500).cast("int")
    item = (F.xxhash64(key, F.lit(2)) % 150 + 150).cast("int")
    if kind in ("user", "pair"):
        user = F.when(hot, 7).otherwise(user)
    if kind in ("item", "pair"):
        item = F.when(hot, 8).otherwise(item)
    rating = (F.pmod(F.xxhash64(key, F.lit(3)), F.lit(10)) + 1).cast("double")
    return spark.range(N).select(user.alias("user_id"), item.alias("item_id"), rating.alias("rating"))


@pytest.fixture(scope="module", params=["user", "item", "pair"])
def table(request, spark):
    return skewed(spark, request.param).cache()


def test_profile_sees_it(table):
    found = profile_ratings(table)
    assert max(found.max_user_rows, found.max_item_rows) >= N // 3


def test_lists_and_errors(table, monkeypatch):
    model = fit_als(table, AlsParams(max_iter=2, rank=4))
    lists = {tuple(r) for r in top_items(model, 5, exclude_seen=table).collect()}
    error = rmse(predict(model, table)).first()
    report = coldstart_report(model, table).first()
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in top_items(model, 5, exclude_seen=table).collect()} == lists
    again = rmse(predict(model, table)).first()
    assert again["n_rows"] == error["n_rows"] == report["n_scored"] == N
    assert abs(again["rmse"] - error["rmse"]) < 1e-9
    seen = table.select("user_id", "item_id").distinct().groupBy("user_id").count()
    left = {r["user_id"]: model.n_items - r["count"] for r in seen.collect()}
    sizes_of = {}
    for user, *_ in lists:
        sizes_of[user] = sizes_of.get(user, 0) + 1
    assert sizes_of == {u: min(5, n) for u, n in left.items() if n}


def test_first_of_each_list(spark, table):
    catalog = spark.range(0, 400).select(
        F.col("id").cast("int").alias("ID"), F.when(F.col("id") % 2 == 0, "TV").otherwise("Movie").alias("Type")
    )
    scored = with_item_type(resolve_duplicates(table, "mean"), catalog).withColumnRenamed("rating", "score")
    found = first_per_list(scored, 3).toPandas()
    rows = scored.toPandas().sort_values(["user_id", "Type", "score", "item_id"], ascending=[True, True, False, True])
    expected = rows.groupby(["user_id", "Type"]).head(3)
    keys = ["user_id", "Type", "item_id"]
    assert sorted(map(tuple, found[keys].to_numpy())) == sorted(map(tuple, expected[keys].to_numpy()))
    assert np.isclose(found["score"].sum(), expected["score"].sum())
