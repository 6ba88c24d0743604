"""Substring search over an index of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.operators.report import search_text

BUCKETS = 64


def searched(title: str = "title", description: str = "description") -> Column:
    """The text that `report.search_text` looks into."""
    return F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(description, F.lit(""))))


def grams(text: Column) -> Column:
    """The different strings of three letters of a text."""
    # A look ahead of three letters holds at every place but the last two.
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_index(feed: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> None:
    """Write rows (gram, key) in folders by bucket of the gram, so that a search reads a few of them.

    A gram that many records have lies in as many files as tasks found it.
    """
    rows = feed.select(F.col(key).alias("key"), F.explode(grams(searched())).alias("gram")).withColumn("bucket", bucket(F.col("gram"), buckets))
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def search_index(spark: SparkSession, path: str, feed: DataFrame, key: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """What `report.search_text` finds, by the records that have all trigrams of the query.

    Queries of fewer than three letters are searched in the feed itself. Keys
    must tell records apart; records with a null key are not found by the index.
    """
    text = query.lower()
    if len(text) < 3:
        return search_text(feed, query)
    wanted = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    places = [r["b"] for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(bucket(F.col("g"), buckets).alias("b")).distinct().collect()]
    index = spark.read.parquet(path).filter(F.col("bucket").isin(places) & F.col("gram").isin(wanted))
    hits = index.groupBy("key").agg(F.count("gram").alias("n")).filter(F.col("n") == len(wanted))
    return search_text(feed.join(hits.select(F.col("key").alias(key)), key, "left_semi"), query)
