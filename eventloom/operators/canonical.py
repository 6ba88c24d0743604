"""From heterogeneous raw events to one record shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from eventloom.functions.text import base_confidence, source_type, type_priority
from eventloom.schemas import FEED_SCHEMA, MERGED_FIELDS, RAW_FIELDS
from eventloom.storage import cut_lineage

# Ranks pack (100 - priority, ingest_ord) in one BIGINT; the order must stay below this.
RANK_STEP = 10**17


def per_source_limit(df: DataFrame, n: int, source: str = "source", order: str = "ord") -> DataFrame:
    """First `n` rows of each source in listing order.

    Spark keeps only `n` rows per source and task before the shuffle, so one
    huge source does not end up in one task.
    """
    w = Window.partitionBy(source).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def monitored(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows of the monitored groups or hashtags only."""
    return df.join(dimension.select(key).distinct(), key, "left_semi")


def union_feeds(feeds: dict[int, DataFrame], tiers: list[int] | None = None) -> DataFrame:
    """Bag union of the selected tiers; a column a feed lacks is NULL there."""
    chosen = [
        df.withColumn("tier", F.lit(tier))
        for tier, df in sorted(feeds.items())
        if tiers is None or tier in tiers
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)


def with_ingest_order(df: DataFrame, *order: str) -> DataFrame:
    """Add `ingest_ord`, increasing along `order`, without a single-task sort.

    The result is a written table: a lost executor must not renumber records.
    """
    return cut_lineage(df.orderBy(*order).withColumn("ingest_ord", F.monotonically_increasing_id()))


def to_canonical(raw: DataFrame) -> DataFrame:
    """Canonical records from raw events holding a unique BIGINT `ingest_ord`.

    An order that is missing, negative or too large for a rank fails the job;
    `check_order` does so for repeated ones.

    An absent key (NULL or no such column) falls back; an empty one does not.
    Adds source_type, confidence and rank: the order in which records are
    resolved, trusted sources first and ingest order within them.
    """
    absent = [F.lit(None).cast("string").alias(c) for c in RAW_FIELDS if c not in raw.columns]
    # Numbers and nulls in coordinates are read as text.
    given = [F.col(c).cast("string").alias(c) for c in RAW_FIELDS if c in raw.columns]
    rows = raw.select(F.col("ingest_ord").cast("bigint").alias("ingest_ord"), *given, *absent)
    kind, empty = F.col("source_type"), F.lit("")
    order = F.col("ingest_ord")
    fits = order.isNotNull() & (order >= 0) & (order < RANK_STEP)
    order = F.when(fits, order).otherwise(F.raise_error(F.lit("ingest_ord must be from 0 to 10 ** 17 - 1")).cast("bigint"))
    fallback = {
        "start_date": F.coalesce("start_date", "date_raw", empty),
        "venue_name": F.coalesce("venue_name", "location_raw", empty),
        "country": F.coalesce("country", F.lit("IE")),
        "source": F.coalesce("source", "source_type"),
    }
    return (
        rows.withColumn("source_type", source_type(F.col("source"), F.col("url")))
        .select(
            "ingest_ord",
            *[fallback.get(c, F.coalesce(c, empty)).alias(c) for c in MERGED_FIELDS + ["source"]],
            "source_type",
            base_confidence(kind).alias("confidence"),
            ((100 - type_priority(kind)) * F.lit(RANK_STEP) + order).alias("rank"),
        )
    )


def check_order(canonical: DataFrame) -> DataFrame:
    """The records as they are; raises if two have the same rank."""
    if not canonical.groupBy("rank").count().filter("count > 1").isEmpty():
        raise ValueError("ingest_ord is not unique")
    return canonical


def feed_columns(df: DataFrame) -> DataFrame:
    """The 18 feed columns, confidence to two decimals."""
    return df.select(
        *[F.round("confidence", 2).alias(c) if c == "confidence" else F.col(c) for c in FEED_SCHEMA.names]
    )
