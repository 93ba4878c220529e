"""Relational steps on rating tables, and the check that precedes a fit."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from numbers import Integral

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ranksmith.columns import CATALOG_ID, ITEM, RATING, TS, TYPE, USER
from ranksmith.storage import written

MAX_ID = 2**31 - 1
MAX_FLOAT = 3.4028234663852886e38


def merge_ratings(all_ratings: DataFrame, one_user: DataFrame) -> DataFrame:
    """All ratings plus one user's, duplicates kept."""
    return all_ratings.unionByName(one_user)


def with_item_type(ratings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ratings of catalogued items, with the item's type. Others are dropped.

    No join hint: Spark broadcasts the catalog when its measured size allows
    and otherwise shuffles, splitting a hot item's rows at run time.
    """
    types = catalog.select(F.col(CATALOG_ID), F.col(TYPE)).alias("c")
    rated = ratings.alias("r")
    return rated.join(types, F.col(f"r.{ITEM}") == F.col(f"c.{CATALOG_ID}")).select("r.*", f"c.{TYPE}")


def of_type(table: DataFrame, wanted: str) -> DataFrame:
    """Rows of exactly this type; a NULL type never matches."""
    return table.where(F.col(TYPE) == wanted)


def id_list(ids: int | Iterable[int]) -> list[int]:
    """One id or several, as a list without repeats."""
    return [int(ids)] if isinstance(ids, Integral) else list(dict.fromkeys(map(int, ids)))


def rows_of(table: DataFrame, column: str, ids: int | Iterable[int] | DataFrame) -> DataFrame:
    """Rows whose ``column`` is one of ``ids``: one id, a few ids, or a table with that column."""
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(ids.columns[0] if len(ids.columns) == 1 else column).alias(column))
        return table.join(keys, column, "left_semi")
    return table.where(F.col(column).isin(id_list(ids)))


def target_users(ratings: DataFrame, users: int | Iterable[int] | DataFrame) -> DataFrame:
    """The ratings of the target user or users."""
    return rows_of(ratings, USER, users)


def catalog_items(catalog: DataFrame, items: int | Iterable[int] | DataFrame) -> DataFrame:
    """The catalog rows of these items, whatever their rank."""
    return rows_of(catalog, CATALOG_ID, items)


def distinct_ids(table: DataFrame, column: str = USER, n: int | None = None) -> DataFrame:
    """Distinct ids; with ``n`` the ``n`` smallest, so that the choice is the same every time."""
    ids = table.select(column).distinct()
    return ids if n is None else ids.orderBy(column).limit(n)


def resolve_duplicates(ratings: DataFrame, how: str = "keep") -> DataFrame:
    """Several ratings of one item by one user: ``keep`` all, ``latest``, or their ``mean``.

    ``latest`` needs the ``ts`` column; of ratings given at the same moment the highest stays.
    """
    if how == "keep":
        return ratings
    pairs = ratings.groupBy(USER, ITEM)
    if how == "mean":
        return pairs.agg(F.avg(RATING).alias(RATING))
    if how == "latest":
        # Two grouped maxima of numbers are hashed; the maximum of a struct would sort all rows.
        highest = ratings.groupBy(USER, ITEM, TS).agg(F.max(RATING).alias(RATING))
        moment = F.coalesce(F.col(TS), F.lit(-(2**63)))
        last = highest.groupBy(USER, ITEM).agg(F.max_by(RATING, moment).alias(RATING), F.max(TS).alias(TS))
        return last.select(USER, ITEM, RATING, TS)
    raise ValueError(f"how must be keep, latest or mean, not {how!r}")


@dataclass(frozen=True)
class RatingProfile:
    """Counts that decide how a table can be trained on."""

    n_rows: int
    n_users: int
    n_items: int
    max_user_rows: int
    max_item_rows: int
    n_bad: int


def bad_rating(ratings: DataFrame) -> Column:
    """True for a row no factor model can use: a NULL, a NaN, a rating infinite as a float, an id that is not a 32-bit integer."""
    kinds = dict(ratings.dtypes)
    value = F.col(RATING).cast("double")
    bad = F.col(USER).isNull() | F.col(ITEM).isNull() | value.isNull() | F.isnan(value)
    bad = bad | F.coalesce(F.abs(value) > MAX_FLOAT, F.lit(False))
    for column in (USER, ITEM):
        if kinds[column] not in ("tinyint", "smallint", "int"):
            number = F.col(column).cast("double")
            bad = bad | F.coalesce((F.abs(number) > MAX_ID) | (number != F.floor(number)), F.lit(False))
    return bad


def count_ratings(ratings: DataFrame) -> tuple[int, int]:
    """How many ratings there are, and how many of them no factor model can use. One scan, no shuffle but of one row a task."""
    return tuple(ratings.agg(F.count(F.lit(1)), F.count_if(bad_rating(ratings))).first())


def counted_copy(ratings: DataFrame, chosen: Column) -> tuple[DataFrame, int, int]:
    """A written copy of the ratings, and ``count_ratings`` of the chosen rows, counted while they are written."""
    seen = Observation()
    bad = F.count_if(chosen & bad_rating(ratings)).alias("bad")
    copy = written(ratings.observe(seen, F.count_if(chosen).alias("rows"), bad), "ratings")
    found = seen.get
    return copy, found["rows"], found["bad"]


def profile_ratings(ratings: DataFrame) -> RatingProfile:
    """Row, user, item and hottest-id counts in one job.

    Counts are combined before the shuffle, so a hot id costs one row per
    task. The items' half reads the item column alone.
    """

    def totals(column: str, bad: Column) -> DataFrame:
        per_id = ratings.groupBy(column).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")
        )
        return per_id.agg(
            F.lit(column).alias("side"),
            F.count(F.lit(1)).alias("ids"),
            F.coalesce(F.max("n"), F.lit(0)).alias("hottest"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        )

    both = totals(USER, bad_rating(ratings)).unionByName(totals(ITEM, F.lit(False)))
    found = {row["side"]: row for row in both.collect()}
    users, items = found[USER], found[ITEM]
    return RatingProfile(
        n_rows=users["n_rows"],
        n_users=users["ids"],
        n_items=items["ids"],
        max_user_rows=users["hottest"],
        max_item_rows=items["hottest"],
        n_bad=users["bad"],
    )
