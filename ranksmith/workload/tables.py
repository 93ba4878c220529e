"""The driver's tables seen as ratings, catalog and media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ranksmith.columns import ITEM, RATING, TS, USER

SERIES, MOVIE = "ECONOMY", "PROMO"
TYPES = [SERIES, MOVIE]
ALT_TITLE = "Alternative name"
TITLES = ["Name", ALT_TITLE]
TARGET, TARGET_ALIAS = 5, 666666
URL_SUFFIX = "#top"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rate the parts they ordered, 1 to 10 by quantity, at the order's date."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("int").alias(USER),
        F.col("l_partkey").cast("int").alias(ITEM),
        F.ceil(F.col("l_quantity") / 5).cast("double").alias(RATING),
        F.timestamp_diff("SECOND", epoch, F.col("o_orderdate").cast("timestamp_ntz")).alias(TS),
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).drop(TS)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("ID"),
        F.col("p_name").alias("Name"),
        F.col("p_brand").alias(ALT_TITLE),
        F.col("p_type").alias("Type"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per item; every third page has no trailer, as real items may lack one."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("int").alias(ITEM),
        url.alias("image_url"),
        F.when(F.col("page_id") % 3 != 0, url).alias("trailer_url"),
    )


def one_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target's own ratings under the id they are merged with."""
    own = triples(spark, sf_dir).where(F.col(USER) == TARGET)
    return own.withColumn(USER, F.lit(TARGET_ALIAS))
