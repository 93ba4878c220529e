import pytest
from pyspark.sql import functions as F

from ranksmith.operators import (
    catalog_items,
    distinct_ids,
    merge_ratings,
    of_type,
    profile_ratings,
    resolve_duplicates,
    target_users,
    with_item_type,
)
from ranksmith.operators.model import check_profile

SCHEMA = "user_id int, item_id int, rating double"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_keeps_duplicates_and_matches_by_name(spark):
    one = table(spark, [(9.0, 2, 1), (8.0, 2, 1)], "rating double, item_id int, user_id int")
    merged = merge_ratings(table(spark, [(1, 2, 8.0)]), one)
    assert rows(merged) == [(1, 2, 8.0), (1, 2, 8.0), (1, 2, 9.0)]


def test_item_type_drops_uncatalogued_items_only(spark, catalog):
    rated = table(spark, [(1, 100, 5.0), (1, 139, 6.0), (1, 999, 7.0)])
    found = with_item_type(rated, catalog)
    assert found.columns == ["user_id", "item_id", "rating", "Type"]
    assert {(r["item_id"], r["Type"]) for r in found.collect()} == {(100, "Movie"), (139, None)}


def test_type_filter_is_exact(spark):
    types = table(spark, [(1, "TV"), (2, "tv"), (3, None), (4, "TV ")], "ID int, Type string")
    assert rows(of_type(types, "TV")) == [(1, "TV")]


def test_targets_by_id_list_and_table(spark):
    rated = table(spark, [(1, 10, 5.0), (2, 10, 6.0), (3, 10, 7.0)])
    wanted = table(spark, [(2,), (2,), (77,)], "user_id int")
    assert rows(target_users(rated, 1)) == [(1, 10, 5.0)]
    assert rows(target_users(rated, [1, 3])) == [(1, 10, 5.0), (3, 10, 7.0)]
    assert rows(target_users(rated, wanted)) == [(2, 10, 6.0)]


def test_catalog_items_by_list_and_table(spark, catalog):
    ids = table(spark, [(101,), (101,), (5,)], "ID int")
    assert [r["ID"] for r in catalog_items(catalog, ids).collect()] == [101]
    assert sorted(r["ID"] for r in catalog_items(catalog, [102, 100, 5]).collect()) == [100, 102]


def test_distinct_ids_takes_the_smallest(spark):
    rated = table(spark, [(5, 1, 1.0), (3, 1, 1.0), (5, 2, 1.0), (4, 1, 1.0)])
    assert [r[0] for r in distinct_ids(rated, "user_id", 2).collect()] == [3, 4]
    assert rows(distinct_ids(rated)) == [(3,), (4,), (5,)]


def test_duplicates(spark):
    rated = table(
        spark,
        [(1, 2, 8.0, 10), (1, 2, 9.0, 20), (1, 2, 3.0, 20), (1, 3, 4.0, 5)],
        SCHEMA + ", ts bigint",
    )
    assert resolve_duplicates(rated, "keep").count() == 4
    assert rows(resolve_duplicates(rated, "latest")) == [(1, 2, 9.0, 20), (1, 3, 4.0, 5)]
    assert rows(resolve_duplicates(rated, "mean")) == [(1, 2, 20.0 / 3), (1, 3, 4.0)]
    with pytest.raises(ValueError):
        resolve_duplicates(rated, "first")


def test_profile_counts(spark):
    rated = table(spark, [(1, 10, 5.0), (1, 11, 6.0), (1, 11, 7.0), (2, 11, 7.0)])
    found = profile_ratings(rated)
    assert (found.n_rows, found.n_users, found.n_items) == (4, 2, 2)
    assert (found.max_user_rows, found.max_item_rows, found.n_bad) == (3, 3, 0)


@pytest.mark.parametrize(
    "schema,row",
    [
        (SCHEMA, (None, 1, 5.0)),
        (SCHEMA, (1, None, 5.0)),
        (SCHEMA, (1, 1, None)),
        (SCHEMA, (1, 1, float("nan"))),
        ("user_id bigint, item_id bigint, rating double", (2**31, 1, 5.0)),
        ("user_id bigint, item_id bigint, rating double", (1, -(2**31) - 1, 5.0)),
        ("user_id double, item_id int, rating double", (1.5, 1, 5.0)),
    ],
)
def test_unusable_rows_are_counted_and_refused(spark, schema, row):
    good = tuple(float(v) if schema.startswith("user_id double") and i == 0 else v for i, v in enumerate((1, 2, 5.0)))
    found = profile_ratings(table(spark, [good, row, good], schema))
    assert (found.n_rows, found.n_bad) == (3, 1)
    with pytest.raises(ValueError, match="1 of 3 ratings"):
        check_profile(found)


def test_empty_table_is_refused(spark):
    found = profile_ratings(table(spark, []))
    assert found.n_rows == 0
    with pytest.raises(ValueError, match="no ratings"):
        check_profile(found)


def test_hot_pair_is_combined_before_the_shuffle(spark):
    rated = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("user_id"),
        F.when(F.col("id") % 3 == 0, 8).otherwise(F.col("id") % 50).cast("int").alias("item_id"),
        (F.col("id") % 10 + 1).cast("double").alias("rating"),
    )
    assert profile_ratings(rated).max_user_rows >= 10_000
    plan = resolve_duplicates(rated, "mean")._jdf.queryExecution().toString()
    assert "partial_avg" in plan
