"""Column expressions."""

from ranksmith.functions.casts import instant, strict_cast
from ranksmith.functions.cells import (
    AUTOPLAY_SUFFIX,
    image_cell,
    link_text,
    strip_literal,
    trailer_cell,
)
from ranksmith.functions.vectors import dot

__all__ = [
    "AUTOPLAY_SUFFIX",
    "dot",
    "image_cell",
    "instant",
    "link_text",
    "strict_cast",
    "strip_literal",
    "trailer_cell",
]
