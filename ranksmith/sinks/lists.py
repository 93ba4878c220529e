"""Finished lists on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ranksmith.columns import RANK, TYPE, USER

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def write_lists(
    lists: DataFrame, path: str, fmt: str = "csv", by: str = TYPE, mode: str = "errorifexists"
) -> None:
    """Write lists to any URI, one folder per type, each file in list order.

    The rebalance gathers a type's rows into files of sensible size and splits a type
    that is much larger than the others, so neither tiny files nor one huge
    task come out of a lopsided type.
    """
    order = [c for c in (by, USER, RANK) if c in lists.columns]
    placed = lists.hint("rebalance", by).sortWithinPartitions(*order)
    writer = placed.write.partitionBy(by).mode(mode)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(fmt).save(path)
