"""Predictions, cold starts and RMSE."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ranksmith.columns import ITEM, PREDICTION, RATING, USER
from ranksmith.functions.vectors import dot
from ranksmith.operators.model import FactorModel
from ranksmith.operators.sizes import broadcast_if_small, factor_bytes


def predict(model: FactorModel, pairs: DataFrame, cold: str = "drop") -> DataFrame:
    """Add ``prediction float``, the dot product of the pair's factors.

    Pairs with an unseen user or item are dropped, or get NaN with ``cold="nan"``.
    Factor tables are broadcast only below the size limit; otherwise both joins
    shuffle the pairs and Spark splits hot ids. Items come first, as a model's own transform leaves its rows by item,
    which then stay where they are; afterwards they lie by user, ready to be summed per user.
    """
    if cold not in ("drop", "nan"):
        raise ValueError(f"cold must be drop or nan, not {cold!r}")
    how = "inner" if cold == "drop" else "left"
    users = model.user_factors.select(F.col("id").alias(USER), F.col("features").alias("user_features"))
    items = model.item_factors.select(F.col("id").alias(ITEM), F.col("features").alias("item_features"))
    users = broadcast_if_small(users, factor_bytes(model.n_users, model.rank))
    items = broadcast_if_small(items, factor_bytes(model.n_items, model.rank))
    joined = pairs.join(items, ITEM, how).join(users, USER, how)
    score = dot(F.col("user_features"), F.col("item_features"), model.rank).cast("float")
    if cold == "nan":
        score = F.coalesce(score, F.lit(float("nan")).cast("float"))
    return joined.select(*[F.col(f"`{c}`") for c in pairs.columns], score.alias(PREDICTION))


def rmse(predictions: DataFrame, by: str | None = None) -> DataFrame:
    """Row count and RMSE, overall or per group; NULL over no rows instead of an error."""
    gap = F.col(RATING).cast("double") - F.col(PREDICTION).cast("double")
    measures = [F.count(F.lit(1)).alias("n_rows"), F.sqrt(F.avg(gap * gap)).alias("rmse")]
    return (predictions.groupBy(by) if by else predictions.groupBy()).agg(*measures)


def coldstart_report(model: FactorModel, test: DataFrame) -> DataFrame:
    """One row: test pairs, those scored, those dropped as cold, RMSE of the scored. One pass."""
    scored = predict(model, test, cold="nan")
    warm = ~F.isnan(PREDICTION)
    gap = F.col(RATING).cast("double") - F.col(PREDICTION).cast("double")
    return scored.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(warm).alias("n_scored"),
        F.count_if(~warm).alias("n_dropped"),
        F.sqrt(F.avg(F.when(warm, gap * gap))).alias("rmse"),
    )
