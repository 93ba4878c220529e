"""Training and test rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ranksmith.columns import ITEM, USER

# Fixed values of the split's hash: a prime below 2^31 and two multipliers below 2^30,
# so that every product of two remainders fits a bigint.
HASH_PRIME = 2147483647
USER_FACTOR = 774596669
ITEM_FACTOR = 536439473


def in_training(train: float = 0.8, seed: int = 42, user: str = USER, item: str = ITEM) -> Column:
    """True for rows that belong to the training part.

    The choice depends only on the pair of ids and the seed: not on row order
    or partitioning, and all ratings of one pair fall on the same side. The hash is
    plain integer arithmetic, so other engines can repeat it.
    """
    prime = F.lit(HASH_PRIME).cast("bigint")
    user_part = F.pmod(F.col(user).cast("bigint"), prime) * F.lit(USER_FACTOR).cast("bigint")
    item_part = F.pmod(F.col(item).cast("bigint"), prime) * F.lit(ITEM_FACTOR).cast("bigint")
    line = F.pmod(user_part + item_part + F.lit(seed).cast("bigint"), prime)
    # Squaring breaks the line up; otherwise one user's items would alternate regularly.
    spread = F.pmod(line * line, prime)
    return spread < F.lit(round(train * HASH_PRIME)).cast("bigint")


def hash_split(ratings: DataFrame, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by ``in_training``: two filters, no shuffle."""
    chosen = in_training(train, seed)
    return ratings.where(chosen), ratings.where(~chosen)


def random_split(ratings: DataFrame, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Spark's sampling split; which rows it picks depends on their partitioning."""
    training, test = ratings.randomSplit([train, 1.0 - train], seed)
    return training, test
