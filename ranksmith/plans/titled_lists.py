"""Ratings given as text lines, titles from a lookup: the best items for a few users."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ranksmith.operators import (
    SEGMENT,
    AlsParams,
    als_estimator,
    check_counts,
    coldstart_report,
    counted_copy,
    distinct_ids,
    fit_als,
    hash_split,
    in_training,
    top_items,
    with_lookup_title,
)
from ranksmith.plans.global_lists import Recommendation
from ranksmith.storage import owned


def titled_lists(
    ratings: DataFrame,
    lookup: DataFrame,
    n_users: int = 3,
    k: int = 10,
    params: AlsParams = SEGMENT,
    train: float = 0.8,
    seed: int = 42,
    keep_copy: bool = False,
) -> Recommendation:
    """Top ``k`` for the ``n_users`` smallest user ids, with a title per item."""
    with owned(ratings.sparkSession, "titled-lists") as folder:
        n_rows = None
        if keep_copy:
            ratings, n_rows, n_bad = counted_copy(ratings, in_training(train, seed))
            check_counts(n_rows, n_bad)
        training, test = hash_split(ratings, train, seed)
        model = fit_als(training, params, n_rows=n_rows)
        users = distinct_ids(ratings, als_estimator(params).getUserCol(), n_users)
        lists = with_lookup_title(top_items(model, k, users), lookup)
        return Recommendation(lists, coldstart_report(model, test), model, folder)
