"""Explicit-feedback ALS: one model for all ratings, or one per segment."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from contextvars import copy_context
from dataclasses import dataclass, field
from math import ceil
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ranksmith.columns import ITEM, RATING, TYPE, USER
from ranksmith.operators.ratings import RatingProfile, count_ratings
from ranksmith.storage import checkpoint_dir, written


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class AlsParams:
    """Settings of a fit. The model depends on the first four, and on ``blocks`` through its random start.

    ``blocks`` is the number of blocks per side, by default one for every ``ROWS_PER_BLOCK`` ratings; ``storage`` is
    where Spark ML keeps blocks and factors between rounds, ``checkpoint_interval`` the rounds between cuts of the lineage,
    which also delete the files of the rounds before; by default as ``rounds_kept`` says.
    """

    max_iter: int = 10
    reg: float = 0.1
    rank: int = 10
    seed: int = 42
    blocks: int | None = None
    storage: str = "MEMORY_AND_DISK"
    checkpoint_interval: int | None = None


# The two parameter sets in use.
GLOBAL = AlsParams(max_iter=10, reg=0.1)
SEGMENT = AlsParams(max_iter=5, reg=0.01)

# Spark ML keeps all ratings of a block, hence of an id, in arrays of one task.
ROWS_PER_BLOCK = 5_000_000
MIN_BLOCKS = 8

# Up to so many ratings, what ten rounds shuffle may lie on disk together.
SMALL_FIT = 1_000_000
SMALL_FIT_ROUNDS = 10


@dataclass(frozen=True)
class FactorModel:
    """Fitted factors: two tables ``id int, features array<float>`` and their sizes."""

    user_factors: DataFrame
    item_factors: DataFrame
    rank: int
    n_users: int
    n_items: int
    params: AlsParams
    als_model: ALSModel | None = field(default=None, repr=False)  # None for factors from elsewhere


def block_count(n_rows: int) -> int:
    """Blocks per side from the row count alone, so that the model does not depend on the cluster."""
    return max(MIN_BLOCKS, ceil(n_rows / ROWS_PER_BLOCK))


def rounds_kept(n_rows: int) -> int:
    """Rounds whose shuffle files may stand at a time.

    Every round sends all factors to the blocks that have a rating of their ids, and Spark ML deletes what was sent only at a
    checkpoint. That of a large fit is written in every round, so that disk does not grow with the rounds.
    """
    return SMALL_FIT_ROUNDS if n_rows <= SMALL_FIT else 1


def als_estimator(params: AlsParams, blocks: int = MIN_BLOCKS, interval: int = SMALL_FIT_ROUNDS) -> ALS:
    blocks, interval = params.blocks or blocks, params.checkpoint_interval or interval
    # Spark ML writes a checkpoint in the first of every ``interval`` rounds; where there are no more rounds than that, it
    # would cut nothing.
    interval = interval if params.max_iter > interval else -1
    return ALS(
        rank=params.rank,
        maxIter=params.max_iter,
        regParam=params.reg,
        seed=params.seed,
        userCol=USER,
        itemCol=ITEM,
        ratingCol=RATING,
        coldStartStrategy="drop",
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        checkpointInterval=interval,
        intermediateStorageLevel=params.storage,
        finalStorageLevel=params.storage,
    )


def check_counts(n_rows: int, n_bad: int) -> None:
    """One bad row would abort the training job half way, so refuse it beforehand, with a count."""
    if n_bad:
        raise ValueError(f"{n_bad} of {n_rows} ratings have a missing or infinite value or an id beyond 32 bits")
    if n_rows == 0:
        raise ValueError("no ratings to train on")


def check_profile(profile: RatingProfile) -> None:
    """``check_counts`` of a profile, which also says how uneven the ids are."""
    check_counts(profile.n_rows, profile.n_bad)
    log.info(
        "%d ratings; the hottest user has %d, the hottest item %d, each in one task",
        profile.n_rows,
        profile.max_user_rows,
        profile.max_item_rows,
    )


def fit_als(
    ratings: DataFrame,
    params: AlsParams = GLOBAL,
    profile: RatingProfile | None = None,
    n_rows: int | None = None,
) -> FactorModel:
    """Fit one model on all the given ratings with Spark ML's ALS; duplicates of a pair each count.

    A count of all and of unusable rows, one scan without a shuffle, comes first: it rejects a bad table and sizes the blocks. Callers
    that have counted hand in ``profile`` or, for ratings known to be usable, ``n_rows``. The ratings are read
    again by the fit, so hand in a table rather than the plan of a large join. Spark ML holds all ratings of
    one id in one task; a ``profile`` names how many that are at most in the log.
    """
    if profile is not None:
        check_profile(profile)
        n_rows = profile.n_rows
    elif n_rows is None:
        n_rows, n_bad = count_ratings(ratings)
        check_counts(n_rows, n_bad)
    triples = ratings.select(
        F.col(USER).cast("int").alias(USER),
        F.col(ITEM).cast("int").alias(ITEM),
        F.col(RATING).cast("float").alias(RATING),
    )
    # Spark ML cuts its lineage now and then, but only where a folder is set.
    checkpoint_dir(ratings.sparkSession)
    als_model = als_estimator(params, block_count(n_rows), rounds_kept(n_rows)).fit(triples)

    def copied(side: str) -> tuple[DataFrame, int]:
        factors = written(als_model.userFactors if side == "users" else als_model.itemFactors, side)
        return factors, factors.count()  # of files: their footers alone are read

    # The factors hang on every shuffle of the training run. Written copies keep the
    # loss of an executor during scoring from repeating the training.
    (users, n_users), (items, n_items) = side_by_side(ratings.sparkSession, copied, ["users", "items"], 2)
    return FactorModel(
        user_factors=users,
        item_factors=items,
        rank=params.rank,
        n_users=n_users,
        n_items=n_items,
        params=params,
        als_model=als_model,
    )


def side_by_side(spark: SparkSession, run: Callable, names: list[str], parallelism: int) -> list:
    """The results of small jobs that do not depend on each other and fill each other's gaps."""
    with ThreadPool(max(1, min(parallelism, len(names)))) as pool:
        contexts = [copy_context() for _ in names]
        call = inheritable_thread_target(spark)(lambda context, name: context.run(run, name))
        return pool.starmap(call, zip(contexts, names))


def fit_als_per_segment(
    typed_ratings: DataFrame,
    segments: Iterable[str],
    params: AlsParams = SEGMENT,
    segment_column: str = TYPE,
    parallelism: int = 2,
) -> dict[str, FactorModel]:
    """One model per segment value; a segment without ratings gets none.

    The fits are independent, so a few run side by side and fill each other's gaps.
    """
    names = list(dict.fromkeys(segments))

    def fit(segment: str) -> FactorModel | None:
        rows = typed_ratings.where(F.col(segment_column) == segment)
        n_rows, n_bad = count_ratings(rows)
        if not n_rows:
            return None
        check_counts(n_rows, n_bad)
        return fit_als(rows, params, n_rows=n_rows)

    models = side_by_side(typed_ratings.sparkSession, fit, names, parallelism)
    return {name: model for name, model in zip(names, models) if model is not None}
