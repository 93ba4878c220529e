"""Rating tables from CSV, parquet and raw text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ranksmith.columns import ITEM, RATING, TS, USER
from ranksmith.functions.casts import strict_cast, whole_number

# The ranges of the integer types in use.
RANGES = {"int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}


def rating_schema(
    user: str = USER, item: str = ITEM, rating: str = RATING, ts: str | None = None
) -> StructType:
    fields = [
        StructField(user, IntegerType()),
        StructField(item, IntegerType()),
        StructField(rating, DoubleType()),
    ]
    if ts is not None:
        fields.append(StructField(ts, LongType()))
    return StructType(fields)


def _standard_names(df: DataFrame, schema: StructType) -> DataFrame:
    names = [USER, ITEM, RATING, TS]
    return df.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(schema.fields, names)])


def _checked(loaded: DataFrame, wanted: StructField) -> Column:
    """A column as the wanted type; a value that does not fit raises whatever the ANSI setting. NULL stays NULL."""
    column, kind = F.col(f"`{wanted.name}`"), loaded.schema[wanted.name].dataType
    type_name = wanted.dataType.simpleString()
    if kind == wanted.dataType:
        return column
    if kind.simpleString() == "string":
        return F.when(column.isNotNull(), strict_cast(column, type_name))
    if type_name in RANGES:
        return whole_number(column, type_name, *RANGES[type_name])
    return column.cast(wanted.dataType)


def read_ratings(
    spark: SparkSession,
    path: str,
    user: str = USER,
    item: str = "anime_id",
    rating: str = RATING,
    ts: str | None = None,
    fmt: str = "csv",
) -> DataFrame:
    """Ratings with a header (CSV) or by name (parquet, ORC, JSON), under the standard names.

    The schema is given, never inferred. A CSV whose header differs from it, or
    a value that does not parse, fails the read instead of turning into NULLs.
    """
    schema = rating_schema(user, item, rating, ts)
    if fmt == "csv":
        table = spark.read.schema(schema).csv(
            path,
            header=True,
            enforceSchema=False,
            mode="FAILFAST",
            ignoreLeadingWhiteSpace=True,
            ignoreTrailingWhiteSpace=True,
        )
    else:
        loaded = spark.read.format(fmt).load(path)
        table = loaded.select(*[_checked(loaded, f).alias(f.name) for f in schema.fields])
    return _standard_names(table, schema)


def read_user_ratings(spark: SparkSession, path: str) -> DataFrame:
    """One user's ratings: no header, columns by position, blanks around numbers allowed."""
    return spark.read.schema(rating_schema()).csv(
        path,
        header=False,
        mode="FAILFAST",
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )


def parse_rating_lines(lines: DataFrame, column: str = "value", header: str = "userId") -> DataFrame:
    """Typed ratings from ``user,item,rating,seconds`` lines.

    A line whose first field is the header's is dropped, so every file of a
    folder may carry one. Any other line that does not parse raises, a NULL line too.
    """
    line = F.col(column)
    # Only lines that begin like the header are looked at twice, and a line is split once.
    is_header = F.ltrim(line).startswith(header) & (F.trim(F.substring_index(line, ",", 1)) == header)
    fields = lines.where(~F.coalesce(is_header, F.lit(False))).select(F.split(line, ",").alias("fields"))
    return fields.select(
        strict_cast(F.get("fields", F.lit(0)), "int").alias(USER),
        strict_cast(F.get("fields", F.lit(1)), "int").alias(ITEM),
        strict_cast(F.get("fields", F.lit(2)), "double").alias(RATING),
        strict_cast(F.get("fields", F.lit(3)), "bigint").alias(TS),
    )


def read_rating_lines(spark: SparkSession, path: str, header: str = "userId") -> DataFrame:
    """``parse_rating_lines`` over the text files at ``path``."""
    return parse_rating_lines(spark.read.text(path), header=header)
