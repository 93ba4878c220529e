"""Text and markup cells of a finished list."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The link suffix to remove, the text for a missing link, and the
# markup around image and trailer links.
AUTOPLAY_SUFFIX = "?enablejsapi=1&wmode=opaque&autoplay=1"
MISSING_TEXT = "None"
IMAGE_OPEN = '<img src="'
IMAGE_CLOSE = '" />'
TRAILER_OPEN = '<iframe height="318" width="565.33" src="'
TRAILER_CLOSE = '"></iframe>'
TRAILER_MISSING = "<p>Trailer no encontrado</p>"


def strip_literal(text: Column, literal: str) -> Column:
    """Remove every occurrence of ``literal``, taken as plain text."""
    return F.replace(text, F.lit(literal), F.lit(""))


def link_text(link: Column) -> Column:
    """The link, or the fixed text when there is none."""
    return F.coalesce(link, F.lit(MISSING_TEXT))


def image_cell(link: Column) -> Column:
    return F.concat(F.lit(IMAGE_OPEN), link_text(link), F.lit(IMAGE_CLOSE))


def trailer_cell(link: Column) -> Column:
    text = link_text(link)
    frame = F.concat(F.lit(TRAILER_OPEN), text, F.lit(TRAILER_CLOSE))
    return F.when(text == MISSING_TEXT, F.lit(TRAILER_MISSING)).otherwise(frame)
