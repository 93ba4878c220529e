"""Casts that fail on junk, whatever the session's ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strict_cast(text: Column, type_name: str) -> Column:
    """Cast a string column; blanks around the value are fine, anything else raises.

    A missing field raises too: a rating line without it is broken.
    """
    message = F.concat(F.lit(f"not a valid {type_name}: "), F.coalesce(text, F.lit("missing field")))
    return F.coalesce(text.try_cast(type_name), F.raise_error(message))


def whole_number(value: Column, type_name: str, least: int, most: int) -> Column:
    """Narrow a number to an integer type; one outside its range or with a fraction raises, NULL stays NULL."""
    fits = value.between(least, most) & (value == F.floor(value))
    message = F.concat(F.lit(f"not a valid {type_name}: "), value.cast("string"))
    return F.when(value.isNull() | fits, value.try_cast(type_name)).otherwise(
        F.raise_error(message).cast(type_name)
    )


def instant(epoch_seconds: Column) -> Column:
    """Epoch seconds as a timestamp."""
    return F.timestamp_seconds(epoch_seconds)
