"""What the plans must look like, whatever the data size."""

import pytest

from ranksmith.operators import of_type, target_users
from ranksmith.workload import tables as t

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rating_view_reads_only_its_columns(spark):
    text = plan(t.triples(spark, SF_DIR))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_filters_reach_the_scan(spark):
    assert "EqualTo(p_type,ECONOMY)" in plan(of_type(t.catalog(spark, SF_DIR), "ECONOMY"))
    assert "o_custkey" in plan(target_users(t.triples(spark, SF_DIR), 5)).split("PartitionFilters")[0]


@pytest.mark.parametrize("name", ["ratings_with_type", "catalog_left_join", "first_of_each_list", "media_cells"])
def test_no_cross_joins_and_no_python(spark, name):
    from ranksmith.workload.queries import QUERIES

    text = plan(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInArrow"):
        assert word not in text


def test_pairs_to_leave_out_are_shuffled_once(spark):
    from ranksmith.workload.queries import QUERIES

    # The middle tables, as the smallest make one task.
    text = plan(QUERIES["scored_unseen_items_per_user"](spark, "/root/testdata/sf0.1"))
    exchanges = [line for line in text.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    # One to the tasks for the sources, one for the pairs, one for the candidates' blocks, and none between the pairs' groupings.
    assert sum("shufflepartitionidpassthrough" in line for line in exchanges) == 2
    assert len(exchanges) == 3 and "collect_set(pair" in text


def test_a_fit_counts_its_ratings_without_a_shuffle_of_ids(spark):
    from ranksmith.operators.ratings import bad_rating
    from pyspark.sql import functions as F

    rows = t.table(spark, SF_DIR, "lineitem").select(
        F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("rating")
    )
    text = plan(rows.agg(F.count(F.lit(1)), F.count_if(bad_rating(rows))))
    assert "hashpartitioning" not in text


def test_ratings_go_to_their_users_before_they_are_summed(spark):
    from ranksmith.workload.queries import QUERIES

    # The sums of a user are many times as wide as the ratings with their factors, and must not be shuffled.
    text = plan(QUERIES["als_normal_equations"](spark, SF_DIR))
    assert not [line for line in text.splitlines() if "hashpartitioning(id" in line and "ENSURE_REQUIREMENTS" in line]
    assert "hashpartitioning(user_id" in text and "REPARTITION_BY_COL" in text


def test_predictions_stay_with_their_items_and_are_summed_where_they_end(spark):
    from ranksmith.operators.sizes import BROADCAST_SETTING
    from ranksmith.workload.queries import QUERIES

    settings = {BROADCAST_SETTING: "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        text = plan(QUERIES["als_prediction_is_dot"](spark, SF_DIR))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    # Both models' two factor tables, and rows that go to their users, items and users again.
    assert text.count("Exchange hashpartitioning") == 7
