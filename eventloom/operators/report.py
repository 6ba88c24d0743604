"""Feed queries: order, counts, upcoming window, search and filters."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.functions.dates import written_date
from eventloom.functions.text import normalize_location, strip


def feed_order(feed: DataFrame, tie: str = "cluster_id") -> DataFrame:
    """By start date as written, then by confidence, then by rank."""
    return feed.orderBy("start_date", F.desc("confidence"), tie)


def api_order(feed: DataFrame, tie: str = "cluster_id") -> DataFrame:
    return feed.orderBy(F.coalesce("start_date", F.lit("")), tie)


def stage_counts(**stages: DataFrame) -> DataFrame:
    """Rows per stage: (stage, n)."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def feed_health(feed: DataFrame) -> DataFrame:
    return feed.agg(F.count("*").alias("events_count")).select(F.lit("ok").alias("status"), "events_count")


def count_by_source(feed: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Records per provenance entry, most frequent first.

    `sources` are the rows of `merge.feed_sources`, for a feed without lists; a
    record that has no list counts under its source.
    """
    if sources is None:
        entries = F.coalesce("all_sources", F.array(F.coalesce("source", F.lit("unknown"))))
        found = feed.select(F.explode(entries).alias("source"))
    else:
        found = sources.filter("kind = 'source'").select(F.col("value").alias("source"))
    return (
        found.groupBy("source").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "source")
    )


def count_by_location(feed: DataFrame, n: int = 10, seen: str = "cluster_id") -> DataFrame:
    """Records per county, else city; the `n` largest, ties by first appearance."""
    place = F.coalesce(
        F.nullif(strip(F.col("county")), F.lit("")), F.nullif(strip(F.col("city")), F.lit("")), F.lit("Unknown")
    )
    return (
        feed.groupBy(place.alias("place"))
        .agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))
        .orderBy(F.desc("n"), "first_seen")
        .limit(n)
        .select("place", "n")
    )


def upcoming(feed: DataFrame, ref_date: datetime.date, first_day: int = 1, last_day: int = 15) -> DataFrame:
    """Records starting tomorrow up to 15 days ahead; unparsable dates do not count."""
    days = F.datediff(written_date(F.col("start_date")), F.lit(ref_date))
    return feed.filter(days.between(first_day, last_day))


def upcoming_shown(feed: DataFrame, ref_date: datetime.date, n: int = 10, tie: str = "cluster_id") -> DataFrame:
    return feed_order(upcoming(feed, ref_date), tie).limit(n).select(
        "start_date", F.substring("title", 1, 60).alias("title")
    )


def sample_feed(feed: DataFrame, n: int = 5, urls: int = 3, tie: str = "cluster_id") -> DataFrame:
    """First `n` records of the feed with their first `urls` URLs."""
    return feed_order(feed, tie).limit(n).select(
        "title", "start_date", "venue_name", "city", "county", "all_sources",
        F.slice("all_urls", 1, urls).alias("all_urls"),
    )


def search_text(feed: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search over title and description; '' keeps all."""
    if not query:
        return feed
    text = F.concat(
        F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    )
    return feed.filter(text.contains(query.lower()))


def age_range(c: Column) -> tuple[Column, Column]:
    """Lowest and highest age named in a text such as `Ages 2-10` or `10+`."""
    low = F.nullif(F.regexp_extract(c, r"(\d{1,3})", 1), F.lit("")).cast("int")
    high = F.nullif(F.regexp_extract(c, r"\d{1,3}\s*[-–]\s*(\d{1,3})", 1), F.lit("")).cast("int")
    open_end = c.rlike(r"\d\s*\+")
    return low, F.when(high.isNotNull(), high).when(open_end, F.lit(999)).otherwise(low)


def filter_age(feed: DataFrame, band: str, column: str = "age_group") -> DataFrame:
    """Records whose ages overlap a band such as '2-5' or '10+'; '' keeps all."""
    if not band:
        return feed
    first, _, last = band.partition("-")
    lo = int(first.rstrip("+"))
    hi = int(last) if last else 999
    low, high = age_range(F.col(column))
    return feed.filter((low <= hi) & (high >= lo))


def filter_county(feed: DataFrame, county: str) -> DataFrame:
    """Records whose county or city names the county; '' keeps all."""
    if not county:
        return feed
    places = F.concat_ws(" ", F.lit(""), normalize_location(F.col("county")), normalize_location(F.col("city")), F.lit(""))
    return feed.filter(places.contains(f" {county.lower()} "))


def display(feed: DataFrame) -> DataFrame:
    """Add date_label (`Thu 30 Oct 2025`, else the text as is) and source_badge."""
    label = F.date_format(written_date(F.col("start_date")), "EEE d MMM yyyy")
    return feed.withColumns(
        {
            "date_label": F.coalesce(label, "start_date"),
            "source_badge": F.split_part("source", F.lit(":"), F.lit(1)),
        }
    )


def search_feed(feed: DataFrame, query: str = "", county: str = "", age: str = "", tie: str = "cluster_id") -> DataFrame:
    """The feed as listed to a reader: filtered, ordered, with display columns."""
    return api_order(display(filter_age(filter_county(search_text(feed, query), county), age)), tie)
