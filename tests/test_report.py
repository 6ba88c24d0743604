import datetime

import naive
import pytest
from pyspark.sql import functions as F

from eventloom.operators import report
from eventloom.plans.catalog import QUERIES
from eventloom.plans.integrate import build_feed
from eventloom.plans.oracle import ORACLE
from eventloom.schemas import FEED_SCHEMA

REF = datetime.date(2026, 5, 1)


@pytest.fixture(scope="module")
def feed(spark):
    rows = [
        (1, "Bubble Brunch", "2026-05-02", " ", "Dublin ", "Ages 2-10", 0.9, ["allevents"]),
        (2, "Farm", "2026-05-01T10:00", "County Cork", "", "5+", 0.9, ["allevents", "facebook:1"]),
        (3, "Disco", "2026-05-16", "", "", "", 1.0, ["yourdaysout"]),
        (4, "Trail", "2026-05-17", "Cork", "", "age 1", 1.0, None),
        (5, "Walk", "Thu, Oct 30", "", "Dublin", "0-1", 0.3, ["instagram"]),
        (6, "Late", "2026-05-16", "", "Cork", None, 0.5, ["facebook"]),
    ]
    df = spark.createDataFrame(
        rows, "cluster_id long, title string, start_date string, county string, city string, age_group string, confidence double, all_sources array<string>"
    )
    return df.withColumns({"source": F.lit("blog:1"), "description": F.concat(F.lit("Fun at "), "city"), "venue_name": F.lit(""), "all_urls": F.array(*[F.lit(c) for c in "abcd"])})


def ids(df):
    return [r.cluster_id for r in df.collect()]


def test_orders(feed):
    assert ids(report.feed_order(feed)) == [2, 1, 3, 6, 4, 5]
    assert ids(report.api_order(feed)) == [2, 1, 3, 6, 4, 5]


def test_counts(feed):
    assert [tuple(r) for r in report.count_by_source(feed).collect()][0] == ("allevents", 2)
    assert ("blog:1", 1) in [tuple(r) for r in report.count_by_source(feed).collect()]
    assert [tuple(r) for r in report.count_by_location(feed, 3).collect()] == [("Dublin", 2), ("Cork", 2), ("County Cork", 1)]
    assert report.feed_health(feed).first().events_count == 6
    assert {r.stage: r.n for r in report.stage_counts(a=feed, b=feed.limit(2)).collect()} == {"a": 6, "b": 2}


def test_upcoming_starts_tomorrow(feed):
    assert sorted(ids(report.upcoming(feed, REF))) == [1, 3, 6]
    assert [r.title for r in report.upcoming_shown(feed, REF, 2).collect()] == ["Bubble Brunch", "Disco"]


def test_filters(feed):
    assert ids(report.search_text(feed, "BRUNCHfun")) == [1]
    assert len(ids(report.search_text(feed, ""))) == 6
    assert sorted(ids(report.filter_age(feed, "0-2"))) == [1, 4, 5]
    assert sorted(ids(report.filter_age(feed, "10+"))) == [1, 2]
    assert sorted(ids(report.filter_county(feed, "Cork"))) == [2, 4, 6]
    assert ids(report.search_feed(feed, query="fun", county="Dublin", age="2-5")) == [1]


def test_display_and_sample(feed):
    labels = {r.cluster_id: (r.date_label, r.source_badge) for r in report.display(feed).collect()}
    assert labels[1] == ("Sat 2 May 2026", "blog") and labels[5][0] == "Thu, Oct 30"
    first = report.sample_feed(feed).first()
    assert first.title == "Farm" and first.all_urls == ["a", "b", "c"]


def raw_of(spark, events):
    fields = naive.MERGED + ["source"]
    schema = ", ".join(f"{f} string" for f in fields) + ", ingest_ord bigint"
    return spark.createDataFrame([tuple(e[f] for f in fields) + (e["ingest_ord"],) for e in events], schema)


def test_unique_events_stay_as_they_are(spark):
    """Similar titles at one place, days apart, are different events."""
    base = {f: "" for f in naive.MERGED}
    events = [
        dict(base, title="Neon Evening: Stars", start_date="2026-04-11", latitude="53.34", longitude="-6.26", url="https://allevents.in/1", source="", ingest_ord=1),
        dict(base, title="Neon Evening: Penguins at Sea", start_date="2026-04-19", latitude="53.34", longitude="-6.26", url="https://allevents.in/2", source="", ingest_ord=2),
    ]
    raw = raw_of(spark, events)
    feed = build_feed(raw, REF)
    assert [r.title for r in feed.collect()] == [e["title"] for e in events]
    again = feed.select(*naive.MERGED, "source", F.col("cluster_id").alias("ingest_ord"))
    assert again.count() == 2
    assert set(FEED_SCHEMA.names) <= set(feed.columns)


def test_every_expected_result_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
