"""Size checks in front of every broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# A table may be broadcast while its estimated size stays below this, or below what the session's setting says.
BROADCAST_BYTES = 64 * 2**20
BROADCAST_SETTING = "spark.ranksmith.broadcastBytes"


def factor_bytes(n_ids: int, rank: int) -> int:
    """Rough size of a factor table as joined: the floats plus row overhead."""
    return n_ids * (4 * rank + 48)


def broadcast_limit() -> int:
    session = SparkSession.getActiveSession()
    return BROADCAST_BYTES if session is None else int(session.conf.get(BROADCAST_SETTING, str(BROADCAST_BYTES)))


def is_small(n_bytes: int, limit: int | None = None) -> bool:
    return n_bytes <= (broadcast_limit() if limit is None else limit)


def broadcast_if_small(table: DataFrame, n_bytes: int, limit: int | None = None) -> DataFrame:
    """Hint a broadcast for a table of known size, or leave the join to Spark."""
    return F.broadcast(table) if is_small(n_bytes, limit) else table
