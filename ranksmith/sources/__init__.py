"""Readers. Paths may be any URI the session's Hadoop file systems know."""

from ranksmith.sources.catalog import catalog_from_text, read_catalog, read_title_lookup
from ranksmith.sources.ratings import (
    parse_rating_lines,
    rating_schema,
    read_rating_lines,
    read_ratings,
    read_user_ratings,
)

__all__ = [
    "catalog_from_text",
    "parse_rating_lines",
    "rating_schema",
    "read_catalog",
    "read_rating_lines",
    "read_ratings",
    "read_title_lookup",
    "read_user_ratings",
]
