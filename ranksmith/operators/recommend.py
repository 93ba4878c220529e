"""Ranked lists: items per user, users per item, items per user and type."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from ranksmith.columns import CATALOG_ID, ITEM, RANK, SCORE, TYPE, USER
from ranksmith.operators.model import FactorModel
from ranksmith.operators.ratings import id_list, rows_of, target_users
from ranksmith.operators.score import CANDIDATE, SEGMENT, SOURCE, best_candidates
from ranksmith.storage import written

Ids = int | Iterable[int] | DataFrame | None


def _chosen(factors: DataFrame, n_factors: int, ids: Ids, column: str) -> tuple[DataFrame, int]:
    """Factor rows of the wanted ids and how many there are at most.

    Repeated ids collapse and unknown ids have no factors, so neither shows up.
    """
    if ids is None:
        return factors, n_factors
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(column).alias("id"))
        # Counted and read again: a copy saves the second join.
        chosen = written(factors.join(keys, "id", "left_semi"), "targets")
        return chosen, chosen.count()
    wanted = id_list(ids)
    return rows_of(factors, "id", wanted), len(wanted)


def reusable(ids: Ids) -> Ids:
    """Ids that may be gone through more than once."""
    return ids if ids is None or isinstance(ids, DataFrame) else id_list(ids)


def _seen(ratings: DataFrame | None, users: Ids) -> DataFrame | None:
    """The pairs to leave out; named users are looked up in the scan."""
    if ratings is None:
        return None
    if users is not None and not isinstance(users, DataFrame):
        ratings = target_users(ratings, users)
    return ratings.select(F.col(USER).alias(SOURCE), F.col(ITEM).alias(CANDIDATE))


def top_items(
    model: FactorModel, k: int, users: Ids = None, exclude_seen: DataFrame | None = None
) -> DataFrame:
    """``user_id, rank, item_id, score``: the ``k`` best items for all users or the given ones.

    Rated items stay in the lists unless ``exclude_seen`` names the ratings to leave out.
    """
    users = reusable(users)
    sources, n_sources = _chosen(model.user_factors, model.n_users, users, USER)
    found = best_candidates(
        sources,
        model.item_factors,
        k,
        model.rank,
        n_sources,
        model.n_items,
        exclude=_seen(exclude_seen, users),
    )
    return found.withColumnsRenamed({SOURCE: USER, CANDIDATE: ITEM})


def top_users(model: FactorModel, k: int, items: Ids = None) -> DataFrame:
    """``item_id, rank, user_id, score``: the ``k`` best users for all items or the given ones."""
    sources, n_sources = _chosen(model.item_factors, model.n_items, items, ITEM)
    found = best_candidates(sources, model.user_factors, k, model.rank, n_sources, model.n_users)
    return found.withColumnsRenamed({SOURCE: ITEM, CANDIDATE: USER})


def top_items_by_type(
    model: FactorModel,
    catalog: DataFrame,
    types: Iterable[str],
    n: int = 5,
    users: Ids = None,
    exclude_seen: DataFrame | None = None,
    candidate_k: int | None = None,
) -> DataFrame:
    """``user_id, Type, rank, item_id, score``: the ``n`` best items of each type per user.

    Exact by default: only items of the wanted types are scored, each type on its own.
    With ``candidate_k`` the types are picked out of the ``candidate_k`` best items
    overall, which is what a single long list gives and may come out short.
    """
    types = list(dict.fromkeys(types))
    wanted = catalog.where(F.col(TYPE).isin(types)).select(F.col(CATALOG_ID).cast("int").alias("id"), F.col(TYPE))
    wanted = wanted.distinct()
    if candidate_k is not None:
        long_list = top_items(model, candidate_k, users, exclude_seen).drop(RANK)
        typed = long_list.join(wanted.withColumnRenamed("id", ITEM), ITEM)
        return first_per_list(typed, n)
    users = reusable(users)
    sources, n_sources = _chosen(model.user_factors, model.n_users, users, USER)
    candidates = model.item_factors.join(wanted, "id").withColumnRenamed(TYPE, SEGMENT)
    found = best_candidates(
        sources,
        candidates,
        n,
        model.rank,
        n_sources,
        model.n_items,
        exclude=_seen(exclude_seen, users),
        n_segments=len(types),
    )
    return found.withColumnsRenamed({SOURCE: USER, CANDIDATE: ITEM, SEGMENT: TYPE})


def first_per_list(scored: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each user's list of each type, ranked by score, then by item."""
    order = Window.partitionBy(USER, TYPE).orderBy(F.desc(SCORE), F.asc(ITEM))
    return (
        scored.withColumn(RANK, F.row_number().over(order))
        .where(F.col(RANK) <= n)
        .select(USER, TYPE, RANK, ITEM, SCORE)
    )


def as_arrays(lists: DataFrame, owner: str = USER) -> DataFrame:
    """One row per owner with ``recommendations array<struct<id, rating>>``, best first."""
    other = ITEM if owner == USER else USER
    entry = F.struct(F.col(RANK), F.col(other), F.col(SCORE).cast("float").alias("rating"))
    ranked = F.array_sort(F.collect_list(entry))
    plain = F.transform(ranked, lambda e: F.struct(e[other].alias(other), e["rating"].alias("rating")))
    return lists.groupBy(owner).agg(plain.alias("recommendations"))


def flatten_lists(arrays: DataFrame, owner: str = USER) -> DataFrame:
    """The reverse of ``as_arrays``, also for Spark ML's own output: one row per entry, with its rank."""
    other = ITEM if owner == USER else USER
    rows = arrays.select(owner, F.posexplode("recommendations").alias("position", "entry"))
    return rows.select(
        owner,
        (F.col("position") + 1).alias(RANK),
        F.col(f"entry.{other}").alias(other),
        F.col("entry.rating").cast("double").alias(SCORE),
    )
