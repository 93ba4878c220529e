"""Split by item type first, train one model per type, list each model's best items."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ranksmith.columns import ITEM, RANK, SCORE, TYPE, USER
from ranksmith.operators import (
    SEGMENT,
    AlsParams,
    coldstart_report,
    fit_als_per_segment,
    hash_split,
    reusable,
    top_items,
    with_item_type,
    with_titles,
)
from ranksmith.storage import owned, remove, written


@dataclass(frozen=True)
class SegmentLists:
    """Lists and holdout reports; unpacks to the two. ``close`` removes the copies behind them."""

    lists: DataFrame
    holdout: DataFrame
    folder: str

    def __iter__(self):
        return iter((self.lists, self.holdout))

    def close(self) -> None:
        remove(self.lists.sparkSession, self.folder)

    def __enter__(self) -> SegmentLists:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def segment_lists(
    ratings: DataFrame,
    catalog: DataFrame,
    users,
    segments: Iterable[str] = ("Movie", "TV"),
    n: int = 5,
    titles: Sequence[str] = ("Name", "Japanese name"),
    params: AlsParams = SEGMENT,
    train: float = 0.8,
    seed: int = 42,
) -> SegmentLists:
    """Lists and holdout reports of all segments, each with its segment in ``Type``.

    Scores of different models are not comparable, so ranks stay within a
    segment. A segment nobody rated contributes nothing; when that goes for
    all of them, both tables are empty.
    """
    names, users = list(segments), reusable(users)
    with owned(ratings.sparkSession, "segment-lists") as folder:
        # Every segment reads its rows several times; one copy, split by type, joins once.
        wanted = with_item_type(ratings, catalog).where(F.col(TYPE).isin(names))
        typed = written(wanted, "typed", by=TYPE)
        training, test = hash_split(typed, train, seed)
        models = fit_als_per_segment(training, names, params)
        spark = ratings.sparkSession
        lists = spark.createDataFrame([], f"{USER} int, {RANK} int, {ITEM} int, {SCORE} double, {TYPE} string")
        reports = spark.createDataFrame(
            [], f"n_test bigint, n_scored bigint, n_dropped bigint, rmse double, {TYPE} string"
        )
        for segment, model in models.items():
            lists = lists.unionByName(top_items(model, n, users).withColumn(TYPE, F.lit(segment)))
            holdout = test.where(F.col(TYPE) == segment)
            reports = reports.unionByName(coldstart_report(model, holdout).withColumn(TYPE, F.lit(segment)))
        return SegmentLists(with_titles(lists, catalog, titles), reports, folder)
