"""Steps that several operators share.

Everywhere in this package: a null text counts as empty, input columns that are not asked about are
passed on, and a result column takes the place of an input column of the same name (in any case).
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ranksmith.storage import remove, scratch_path, written

# Texts are handled in pieces of about this many bytes, so a worker's memory follows this and the longest text.
SLICE_BYTES = 8 << 20

# The white space of the word rule: space and \x09 to \x0D.
SPACE = r"\x20\x09-\x0D"


def worker_state() -> dict:
    """What outlives a task in a Python worker that Spark uses again."""
    return vars(sys.modules.setdefault("_ranksmith_worker", types.ModuleType("_ranksmith_worker")))


class Copies:
    """Copies of tables in the shared folder, for steps that follow each other; each is dropped when the next ones stand."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def __call__(self, table: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        copy = written(table, label, path=path)
        self.paths[id(copy)] = (copy, path)
        return copy

    def drop(self, *copies: DataFrame) -> None:
        for copy in copies:
            remove(self.spark, self.paths.pop(id(copy))[1])


def kept_columns(table: DataFrame, taken: Iterable[str], keep: Iterable[str] | None = None) -> list[str]:
    """The columns to pass on: ``keep`` or all, without those whose names the results take."""
    taken = {c.lower() for c in taken}
    return [c for c in (table.columns if keep is None else keep) if c.lower() not in taken]


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit, prepend=-1))
        if not len(starts) or starts[0]:
            starts = np.insert(starts, 0, 0)
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_results(
    table: DataFrame,
    results: Callable[[pa.Array], list[pa.Array]],
    fields: str,
    text: str = "text",
    keep: Iterable[str] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """The rows, one for one, with columns ``fields`` that ``results`` makes of the texts of a piece of about ``limit`` bytes."""
    new = T.StructType.fromDDL(fields)
    passed = kept_columns(table, new.names, keep)
    schema = T.StructType([table.schema[c] for c in passed] + list(new))
    names = schema.names

    def run(batches):
        for piece in slices(batches, text, limit):
            arrays = [piece.column(c) for c in passed] + results(piece.column(text))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    wanted = list(dict.fromkeys([*passed, text]))
    return table.select(*[f"`{c}`" for c in wanted]).mapInArrow(run, schema)


def row_keys(*columns: str) -> dict[str, Column]:
    """128 bits, ``k1`` and ``k2``, that stand for the values of a row's columns; rows that agree in them share both."""
    given = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return {"k1": F.xxhash64(*given), "k2": F.xxhash64(F.lit(1), *given)}


def guarded(table: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table under names of our own that no result can clash with, and the way back to its own names."""
    own = table.columns
    safe = [f"_rs_{k}" for k in range(len(own))]

    def back(found: DataFrame) -> DataFrame:
        return found.select(*safe).toDF(*own)

    return table.toDF(*safe), back


def guarded_name(table: DataFrame, column: str) -> str:
    """The name that ``guarded`` gives a column; names match in any case, as in Spark."""
    return f"_rs_{[c.lower() for c in table.columns].index(column.lower())}"
