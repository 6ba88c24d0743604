"""Reports on several levels from one scan, and counts that can be added up later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions.text import strip

LEVELS = ["county", "city", "source_type"]


def _named(c: str) -> Column:
    """The place as reports name it."""
    return F.coalesce(F.nullif(strip(F.col(c)), F.lit("")), F.lit("Unknown"))


def count_levels(feed: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """Counts per (county, city, type), per (county, city), per county, and in total.

    (level, *levels, n, n_titles, first_day, best): level is the number of
    columns that are told apart, the others are null; n_titles are exactly the
    different titles.
    """
    rows = feed.withColumns({c: _named(c) for c in levels})
    sets = [levels[:n] for n in range(len(levels), -1, -1)]
    told = F.lit(len(levels)) - sum((F.grouping(c).cast("int") for c in levels), F.lit(0))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in levels]).agg(
        told.cast("int").alias("level"),
        F.count("*").alias("n"),
        F.count_distinct("title").alias("n_titles"),
        F.min(F.nullif("start_date", F.lit(""))).alias("first_day"),
        F.max("confidence").alias("best"),
    )


def level_sketches(feed: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """(*levels, n, titles): counts of the finest level with a sketch of the titles, to be kept with a feed."""
    rows = feed.withColumns({c: _named(c) for c in levels})
    return rows.groupBy(*levels).agg(F.count("*").alias("n"), F.hll_sketch_agg("title", F.lit(14)).alias("titles"))


def from_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """(*by, n, n_titles) from kept sketches, of several feeds too: n is exact, n_titles within about one in a hundred."""
    united = F.hll_sketch_estimate(F.hll_union_agg("titles")).alias("n_titles")
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), united)
