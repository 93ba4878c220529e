from collections import Counter

import pytest
from pyspark.sql import functions as F

from ranksmith.operators import hash_split, in_training, random_split


@pytest.fixture(scope="module")
def grid(spark):
    return spark.range(200_000).select(
        (F.col("id") % 400).cast("int").alias("user_id"),
        (F.col("id") / 400).cast("int").alias("item_id"),
        F.lit(5.0).alias("rating"),
    )


def test_fraction_overall_and_per_id(grid):
    chosen = grid.withColumn("t", in_training().cast("int"))
    assert abs(chosen.agg(F.avg("t")).first()[0] - 0.8) < 0.005
    for column in ("user_id", "item_id"):
        shares = [r[0] for r in chosen.groupBy(column).agg(F.avg("t").alias("s")).select("s").collect()]
        assert 0.70 < min(shares) and max(shares) < 0.90


def test_neighbouring_items_are_chosen_independently(grid):
    pairs = grid.withColumn("t", in_training().cast("int")).alias("a").join(
        grid.withColumn("t", in_training().cast("int")).alias("b"),
        (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.item_id") + 1 == F.col("b.item_id")),
    )
    assert abs(pairs.agg(F.corr("a.t", "b.t")).first()[0]) < 0.02


def test_split_is_complete_and_ignores_partitioning(ratings):
    first = hash_split(ratings)
    again = hash_split(ratings.repartition(3, "rating"))
    for a, b in zip(first, again):
        assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
    assert first[0].count() + first[1].count() == ratings.count()


def test_duplicates_stay_on_one_side(ratings):
    training, test = hash_split(ratings)
    assert training.join(test, ["user_id", "item_id"], "left_semi").count() == 0


def test_seed_changes_the_choice(grid):
    both = grid.select(in_training(seed=1).alias("a"), in_training(seed=2).alias("b"))
    assert abs(both.agg(F.avg((F.col("a") & F.col("b")).cast("int"))).first()[0] - 0.64) < 0.01


def test_negative_and_large_ids(spark):
    ids = spark.createDataFrame([(-5, 3), (2**31 - 1, 2**31 - 1), (-(2**31), 0)], "user_id int, item_id int")
    assert ids.where(in_training().isNull()).count() == 0


def test_random_split(ratings):
    training, test = random_split(ratings)
    assert training.count() + test.count() == ratings.count()
    assert 0.7 < training.count() / ratings.count() < 0.9
