"""Item catalog and title lookups from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ranksmith.columns import CATALOG_ID
from ranksmith.functions.casts import strict_cast

# Doubled quotes inside a quoted title stand for one quote; commas inside quotes belong to the title.
CSV_DIALECT = {"sep": ",", "quote": '"', "escape": '"', "encoding": "UTF-8"}


def read_catalog(spark: SparkSession, path: str, id_column: str = CATALOG_ID) -> DataFrame:
    """Catalog CSV with a header, columns found by name.

    Only the header line is read up front: every column starts as text and the
    id alone is cast, so no pass over the data infers types, and columns that
    a query does not use are not parsed.
    """
    text = spark.read.csv(path, header=True, inferSchema=False, **CSV_DIALECT)
    return text.withColumn(id_column, strict_cast(F.col(f"`{id_column}`"), "int"))


def catalog_from_text(lines: DataFrame, schema: StructType, column: str = "value") -> DataFrame:
    """Catalog rows from a text column holding one CSV record per row, without a header."""
    record = F.from_csv(F.col(column), schema.toDDL(), {**CSV_DIALECT, "mode": "FAILFAST"})
    return lines.select(record.alias("record")).select("record.*")


TITLE_LOOKUP_SCHEMA = StructType(
    [
        StructField("movieId", IntegerType()),
        StructField("title", StringType()),
        StructField("genres", StringType()),
    ]
)


def read_title_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Item id to title from a ``movieId,title,genres`` CSV, as a table to join with."""
    movies = spark.read.schema(TITLE_LOOKUP_SCHEMA).csv(
        path, header=True, enforceSchema=False, mode="FAILFAST", **CSV_DIALECT
    )
    return movies.select(F.col("movieId").alias("item_id"), "title")
