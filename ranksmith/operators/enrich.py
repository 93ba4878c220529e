"""Titles, media links and finished cells for ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ranksmith.columns import CATALOG_ID, ITEM, RANK, TYPE, USER
from ranksmith.functions.cells import (
    AUTOPLAY_SUFFIX,
    image_cell,
    link_text,
    strip_literal,
    trailer_cell,
)


def with_titles(
    lists: DataFrame, catalog: DataFrame, columns: Sequence[str] = ("Name", "Japanese name")
) -> DataFrame:
    """Add catalog columns by item id; items missing from the catalog keep NULLs.

    No hint: the catalog is broadcast where its size allows. Otherwise the join
    shuffles, and an item on most lists is split by the adaptive skew join.
    """
    titles = catalog.select(
        F.col(f"`{CATALOG_ID}`").cast("int").alias(ITEM), *[F.col(f"`{c}`") for c in columns]
    )
    return lists.join(titles, ITEM, "left")


def with_lookup_title(lists: DataFrame, lookup: DataFrame) -> DataFrame:
    """Add ``title`` from an ``item_id, title`` table."""
    return lists.join(lookup.select(ITEM, "title"), ITEM, "left")


def with_media(lists: DataFrame, media: DataFrame, suffix: str = AUTOPLAY_SUFFIX) -> DataFrame:
    """Add ``image_url`` and ``trailer_url`` by item id, the trailer without the autoplay suffix."""
    links = media.select(
        F.col(ITEM).cast("int").alias(ITEM),
        "image_url",
        strip_literal(F.col("trailer_url"), suffix).alias("trailer_url"),
    )
    return lists.join(links, ITEM, "left")


def text_cells(lists: DataFrame) -> DataFrame:
    """Plain ``Image`` and ``Trailer`` columns in place of the links."""
    return _cells(lists, link_text, link_text)


def markup_cells(lists: DataFrame) -> DataFrame:
    """``Image`` and ``Trailer`` as tags in place of the links."""
    return _cells(lists, image_cell, trailer_cell)


def output_columns(lists: DataFrame, titles: Sequence[str] = ("Name", "Japanese name")) -> DataFrame:
    """A finished list's columns in their usual order, with user and rank in front."""
    named = lists.withColumnRenamed(ITEM, CATALOG_ID)
    names = [USER, RANK, CATALOG_ID, *titles, TYPE, "Image", "Trailer"]
    return named.select(*[F.col(f"`{c}`") for c in names])


def _cells(lists: DataFrame, image, trailer) -> DataFrame:
    return lists.withColumns(
        {"Image": image(F.col("image_url")), "Trailer": trailer(F.col("trailer_url"))}
    ).drop("image_url", "trailer_url")
