"""Arithmetic on factor arrays, kept as plain column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def dot(left: Column, right: Column, rank: int) -> Column:
    """Dot product of two arrays of known length, unrolled so that it stays in codegen."""
    products = [left[i].cast("double") * right[i].cast("double") for i in range(rank)]
    return reduce(add, products)
