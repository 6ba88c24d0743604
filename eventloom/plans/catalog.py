"""Registered queries: (spark, sf_dir) -> DataFrame, each over whole driver tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, functions as F

from eventloom.functions.dates import parse_any_date
from eventloom.functions.text import (
    base_confidence,
    canonical_url,
    confidence_decay,
    normalize_location,
    normalize_title,
    prefix_priority,
    source_type,
    url_domain,
)
from eventloom.operators import report
from eventloom.operators.canonical import (
    RANK_STEP,
    feed_columns,
    monitored,
    per_source_limit,
    to_canonical,
    union_feeds,
)
from eventloom.operators.changes import feed_difference
from eventloom.operators.levels import count_levels
from eventloom.operators.match import edit_similarity
from eventloom.operators.merge import cluster_sources, survivors
from eventloom.operators.resolve import earliest_matches, leader_assignment, match_evidence, membership
from eventloom.operators.search import search_index, write_index
from eventloom.plans import renderings as r
from eventloom.plans.integrate import build_feed, pass_through, resolve_events
from eventloom.plans.renderings import REF_DATE, digest, order_day, table
from eventloom.sources import captions, lines, pages
from eventloom.schemas import FEED_SCHEMA
from eventloom.streaming.captures import changed_captures
from eventloom.streaming.refresh import refresh
from eventloom.storage import cut_lineage, read_current, read_feed, replace_feed, run_dir, split_records, write_feed


def joined(c):
    return F.array_join(c, "|")


def ids(df: DataFrame, *columns: str) -> DataFrame:
    """Ranks back to ingest order."""
    return df.withColumns({c: F.col(c) % RANK_STEP for c in columns})


# -- pages --------------------------------------------------------------------


def page_links(spark, sf):
    return pages.page_links(table(spark, sf, "pages"), pattern='href="(/[^"]+)"').select("page_id", "pos", "link")


def data_links(spark, sf):
    k = F.col("page_id").cast("string")
    cards = [
        F.concat(F.lit('<a data-link="https://allevents.in/x/'), k, F.lit(tail), F.lit('">'))
        for tail in ("/1?ref=a", "/2//", "/1/", "/3#top")
    ]
    found = table(spark, sf, "pages").withColumn("html", F.concat("html", *cards))
    return pages.data_links(found).select("page_id", "pos", "link")


def url_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))


def url_domains(spark, sf):
    return table(spark, sf, "pages").select("page_id", url_domain(F.col("url")).alias("domain"))


def url_first_seen(spark, sf):
    links = pages.page_links(table(spark, sf, "pages"), pattern='href="(/[^"]+)"')
    by_path = links.withColumn("path", F.regexp_replace("link", "^https://[^/]+", ""))
    return pages.first_seen(by_path, "path", "page_id")


def jsonld_events(spark, sf):
    return pages.page_events(r.document_pages(spark, sf))


def listing_limit(spark, sf):
    return per_source_limit(table(spark, sf, "documents").select("source", "doc_id"), 5, "source", "doc_id")


def monitored_entities(spark, sf):
    building = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    rows = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return monitored(rows, building, "c_custkey").select("o_orderkey", "c_custkey")


def feed_union(spark, sf):
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_name").alias("title"),
        F.lit("Thu, Oct 30, 2025").alias("date_raw"),
        F.concat(F.lit("facebook:"), F.col("s_suppkey").cast("string")).alias("source"),
        F.lit("Hall").alias("location_raw"),
        F.col("s_suppkey").alias("ingest_ord"),
    )
    customers = table(spark, sf, "customer").select(
        F.col("c_name").alias("title"),
        F.lit("").alias("start_date"),
        F.lit("XX").alias("country"),
        F.concat(F.lit("https://allevents.in/"), F.col("c_custkey").cast("string")).alias("url"),
        F.col("c_acctbal").alias("latitude"),
        (F.col("c_custkey") + 1_000_000_000).alias("ingest_ord"),
    )
    dropped = customers.withColumn("title", F.lit("not selected"))
    raw = union_feeds({2: suppliers, 1: customers, 3: dropped}, tiers=[1, 2])
    return to_canonical(raw).select(
        "title", "start_date", "venue_name", "country", "latitude", "url", "source", "source_type", "confidence", "rank"
    )


def quarantine(spark, sf):
    broken = F.when(F.col("event_id") % 10 == 3, F.replace("props", F.lit("}"))).when(
        F.col("event_id") % 10 == 4, F.lit("not json")
    ).otherwise(F.col("props"))
    rows = table(spark, sf, "events").select("event_id", broken.alias("props"))
    good, bad = split_records(rows, "props", "k int")
    return good.select("event_id", "k", F.lit(True).alias("parsed")).unionByName(
        bad.select("event_id", F.lit(None).cast("int").alias("k"), F.lit(False).alias("parsed"))
    )


# -- page text ----------------------------------------------------------------


def line_table(spark, sf):
    return lines.numbered_lines(table(spark, sf, "conversations"), "text").select("conv_id", "turn", "pos", "line")


def noise_filter(spark, sf):
    text = F.concat("text", F.lit("\n Log in \nSEE MORE\n"), "role", F.lit("\nAbout"))
    rows = lines.numbered_lines(table(spark, sf, "conversations").select("conv_id", "turn", text.alias("t")), "t")
    return rows.filter(~lines.is_noise(F.col("line"))).select("conv_id", "turn", "pos", "line")


def sections(spark, sf):
    found = lines.line_sections(r.document_group_pages(spark, sf).drop("html"))
    return found.groupBy("group_id", "section").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("line").alias("last_line")
    )


def event_ids(spark, sf):
    found = lines.page_event_ids(F.col("html"))
    return r.document_group_pages(spark, sf).select("group_id", F.posexplode(found).alias("pos", "event_id"))


def date_title_pairs(spark, sf):
    return lines.page_entries(r.document_group_pages(spark, sf).drop("html"))


def id_zip(spark, sf):
    return lines.group_events(r.document_group_pages(spark, sf)).select(
        "group_id", "idx", "date_raw", "title", "event_id", "url", "source"
    )


# -- captions -----------------------------------------------------------------


def caption_fields(spark, sf):
    return captions.with_caption_fields(r.order_posts(spark, sf)).select(
        F.col("ingest_ord").alias("o_orderkey"),
        "title", "date_raw", "time_raw", "location_raw", "cost", "age_group",
        joined("hashtags").alias("hashtags"),
    )


def caption_documents(spark, sf):
    found = captions.with_caption_fields(table(spark, sf, "documents"), caption="text")
    return found.select("doc_id", "title", "date_raw", "location_raw", joined("hashtags").alias("hashtags"))


def hashtags(spark, sf):
    tagged = F.concat(F.lit("#"), F.replace("text", F.lit(" "), F.lit(" #")))
    found = captions.hashtags(tagged)
    return table(spark, sf, "documents").select("doc_id", F.size(found).alias("n"), joined(found).alias("tags"))


def post_events(spark, sf):
    return captions.post_events(r.order_posts(spark, sf)).select(
        "ingest_ord", "title", "description", "url", "source", "image_url", "timestamp"
    )


# -- normalisation ------------------------------------------------------------


def source_types(spark, sf):
    k = F.col("doc_id")
    key = k.cast("string")
    source = (
        F.when(k % 7 == 0, F.concat(F.lit("x:"), key))
        .when(k % 7 == 1, F.concat(F.lit("https://allevents.in/"), key))
        .when(k % 7 == 2, F.concat(F.lit("facebook:"), key))
        .when(k % 7 == 3, F.concat(F.lit("instagram:"), F.col("source"), F.lit(":"), key))
        .when(k % 7 == 4, F.concat("source", F.lit(":"), key))
        .when(k % 7 == 5, F.lit(""))
        .otherwise(F.lit("instagram:allevents"))
    )
    url = F.when(k % 7 == 0, F.lit("https://www.yourdaysout.com/")).otherwise(F.lit(""))
    tagged = table(spark, sf, "documents").select("doc_id", source.alias("s"), url.alias("u"))
    kind = tagged.withColumn("source_type", source_type(F.col("s"), F.col("u")))
    return kind.select(
        "doc_id",
        "source_type",
        base_confidence(F.col("source_type")).alias("confidence"),
        prefix_priority(F.col("s")).alias("priority"),
    )


def title_norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalize_title(F.col("text")).alias("title_n"))


def location_norm(spark, sf):
    k = F.col("c_custkey")
    prefix = F.when(k % 4 == 0, "  County ").when(k % 4 == 1, "City of ").when(k % 4 == 2, "The").otherwise("the county, ")
    place = F.concat(prefix, F.col("n_name"), F.lit(" - "), F.col("c_mktsegment"))
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", normalize_location(place).alias("place_n"))


def date_parse(spark, sf):
    day, k = order_day(), F.col("o_orderkey") % 8
    dutch = F.get(
        F.array(*[F.lit(m) for m in "jan feb mrt apr mei jun jul aug sep okt nov dec".split()]), F.month(day) - 1
    )
    text = (
        F.when(k == 0, F.concat(day.cast("string"), F.lit("T18:00:00+01:00")))
        .when(k == 1, F.concat(F.date_format(day, "EEE, MMM d, yyyy"), F.lit(" at 3:00 PM GMT")))
        .when(k == 2, F.date_format(day, "MMM d, yyyy"))
        .when(k == 3, F.concat(F.date_format(day, "MMM d"), F.lit("th")))
        .when(k == 4, F.concat(F.date_format(day, "MMMM d"), F.lit("th 3pm")))
        .when(k == 5, F.concat(F.lit("do, "), F.date_format(day, "d "), dutch, F.lit(". "), F.date_format(day, "yyyy")))
        .when(k == 6, F.date_format(day, "EEE, MMM d"))
        .otherwise(F.date_format(day, "EEE d MMMM yyyy"))
    )
    parsed = parse_any_date(F.col("t"), REF_DATE)
    return table(spark, sf, "orders", spread=True).select("o_orderkey", text.alias("t")).select(
        "o_orderkey", parsed.cast("string").alias("parsed")
    )


def decay(spark, sf):
    age = F.datediff(F.lit(REF_DATE), order_day())
    return table(spark, sf, "orders").select("o_orderkey", confidence_decay(age).alias("weight"))


# -- matching -----------------------------------------------------------------


def _earliest(raw: DataFrame) -> DataFrame:
    return ids(earliest_matches(to_canonical(raw), REF_DATE), "other_id", "earliest_id")


def match_url(spark, sf):
    rows = table(spark, sf, "events", spread=True).select(
        F.concat(F.lit("https://x.example/"), F.col("user_id").cast("string")).alias("url"),
        F.col("event_type").alias("title"),
        F.col("event_id").alias("ingest_ord"),
    )
    return _earliest(rows)


def match_date_band(spark, sf):
    rows = table(spark, sf, "orders", spread=True).select(
        digest(F.col("o_custkey") % 50).alias("title"),
        order_day().cast("string").alias("start_date"),
        F.col("o_orderkey").alias("ingest_ord"),
    )
    return _earliest(rows)


def match_place(spark, sf):
    rows = table(spark, sf, "orders", spread=True).select(
        digest(F.col("o_custkey")).alias("title"),
        digest(F.col("o_orderpriority")).alias("city"),
        F.col("o_orderkey").alias("ingest_ord"),
    )
    return _earliest(rows)


def match_geo(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        digest(F.col("c_nationkey")).alias("title"),
        (5300 + k % 40).cast("string").alias("lat"),
        (600 + k % 30).cast("string").alias("lon"),
        k.alias("ingest_ord"),
    )
    degrees = rows.select(
        "title",
        F.concat(F.substring("lat", 1, 2), F.lit("."), F.substring("lat", 3, 2)).alias("latitude"),
        F.concat(F.lit("-"), F.substring("lon", 1, 1), F.lit("."), F.substring("lon", 2, 2)).alias("longitude"),
        "ingest_ord",
    )
    return _earliest(degrees)


def match_rules(spark, sf):
    return _earliest(r.document_listings(spark, sf))


def _evidence(raw: DataFrame) -> DataFrame:
    canonical = cut_lineage(to_canonical(raw))
    found = match_evidence(canonical, earliest_matches(canonical, REF_DATE), REF_DATE)
    return ids(found, "other_id", "earliest_id").select("other_id", "earliest_id", "rule", F.col("title_sim").alias("ratio"))


def match_title_date(spark, sf):
    return _evidence(r.worded_orders(spark, sf).select("title", F.col("day").alias("start_date"), "ingest_ord"))


def match_title_place(spark, sf):
    """Every twentieth customer by place names, the others by position."""
    named = F.col("customer") % 20 == 0
    rows = r.worded_orders(spark, sf).select(
        "title",
        F.when(named, F.col("place")).otherwise("").alias("city"),
        F.when(named, "").otherwise(F.col("lat")).alias("latitude"),
        F.when(named, "").otherwise(F.col("lon")).alias("longitude"),
        "ingest_ord",
    )
    return _evidence(rows)


def match_nearby(spark, sf):
    rows = r.worded_orders(spark, sf).select(
        "title", F.col("day").alias("start_date"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "ingest_ord"
    )
    return _evidence(rows)


def match_same_day(spark, sf):
    """Matches of title and date, and whether the title is all but the same on the same day."""
    raw = r.worded_orders(spark, sf).select("title", F.col("day").alias("start_date"), "ingest_ord")
    canonical = cut_lineage(to_canonical(raw))
    found = match_evidence(canonical, earliest_matches(canonical, REF_DATE), REF_DATE)
    return ids(found, "other_id", "earliest_id").select("other_id", "earliest_id", "rule", "same_title_and_day")


def match_metric(spark, sf):
    """Earliest matches of title and date with the edit similarity in place of the ratio."""
    raw = r.worded_orders(spark, sf).select("title", F.col("day").alias("start_date"), "ingest_ord")
    return ids(earliest_matches(to_canonical(raw), REF_DATE, metric=edit_similarity), "other_id", "earliest_id")


def resolve_fuzzy(spark, sf):
    raw = r.worded_orders(spark, sf).select("title", F.col("day").alias("start_date"), "ingest_ord")
    canonical = cut_lineage(to_canonical(raw))
    return ids(membership(canonical, leader_assignment(canonical, REF_DATE)), "event_id", "cluster_id")


# -- resolution ---------------------------------------------------------------


def leaders_url(spark, sf):
    rows = table(spark, sf, "events", spread=True).select(
        F.concat(F.lit("https://x.example/"), F.col("user_id").cast("string")).alias("url"),
        F.col("event_id").alias("ingest_ord"),
    )
    canonical = to_canonical(rows)
    return ids(membership(canonical, leader_assignment(canonical, REF_DATE)), "event_id", "cluster_id")


def _flat(feed: DataFrame) -> DataFrame:
    return feed.withColumns({c: joined(c) for c in feed.columns if c in ("all_sources", "all_urls", "source_types")})


def resolve_orders(spark, sf):
    found = resolve_events(r.weekly_orders(spark, sf), REF_DATE)
    return ids(_flat(found), "cluster_id").select(
        "title", "description", "start_date", "cost", "source", "confidence", "all_sources", "n_members", "cluster_id"
    )


def resolve_documents(spark, sf):
    """Flagship: two captures of every document, extracted, resolved, merged, ordered."""
    return _flat(build_feed(r.document_listings(spark, sf), datetime.date(2026, 1, 1)))


def _customer_clusters(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "allevents:").when(k % 3 == 1, "instagram:").otherwise("https://x.example/")
    return table(spark, sf, "customer").select(
        F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("cluster"),
        k.alias("rank"),
        F.concat(kind, (k % 20).cast("string")).alias("source"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("c_name")).alias("title"),
        F.when(k % 3 == 2, F.col("c_acctbal").cast("string")).otherwise(F.lit("")).alias("cost"),
        F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("")).alias("city"),
        F.concat(F.lit("u"), (k % 30).cast("string")).alias("url"),
    )


def merge_survivorship(spark, sf):
    rows = _customer_clusters(spark, sf).withColumn("priority", prefix_priority(F.col("source")))
    return survivors(rows, "cluster", fields=["title", "cost", "city"])


def provenance(spark, sf):
    rows = _customer_clusters(spark, sf).withColumn("source_type", source_type(F.col("source"), F.col("url")))
    heads = rows.groupBy("cluster").agg(F.min("rank").alias("leader"))
    return cluster_sources(rows.join(heads, "cluster")).filter("kind <> 'type'").select(
        F.col("leader").alias("cluster_id"), "kind", "value"
    )


# -- feed ---------------------------------------------------------------------


def feed_order(spark, sf):
    listed = report.feed_order(r.customer_feed(spark, sf))
    return listed.select("start_date", "confidence", "cluster_id", "title")


def feed_output(spark, sf):
    found = merge_single(to_canonical(r.weekly_orders(spark, sf)))
    return _flat(feed_columns(found)).select("title", "start_date", "country", "source", "confidence", "all_sources", "all_urls")


def merge_single(canonical: DataFrame) -> DataFrame:
    """Canonical records as feed records without resolution."""
    return canonical.withColumns({"all_sources": F.array("source_type"), "all_urls": F.array("url")})


def stage_counts(spark, sf):
    raw = r.weekly_orders(spark, sf)
    return report.stage_counts(raw=raw, canonical=to_canonical(raw), resolved=resolve_events(raw, REF_DATE))


def resolved_by_source(spark, sf):
    return report.count_by_source(resolve_events(r.weekly_orders(spark, sf), REF_DATE))


def feed_roundtrip(spark, sf):
    """The feed written, read again and counted by day; a path without files is an empty feed."""
    path = f"{run_dir(spark)}/feed-{uuid.uuid4().hex}"
    rows = r.customer_feed(spark, sf)
    absent = [F.lit("").alias(c) for c in FEED_SCHEMA.names if c not in rows.columns]
    write_feed(rows.select("*", *absent), path)
    back = read_feed(spark, path, multi_line=False).unionByName(read_feed(spark, path + "-none"))
    return back.groupBy("start_date").agg(
        F.count("*").alias("n"),
        F.min("title").alias("first_title"),
        F.max(joined("all_urls")).alias("last_urls"),
        F.round(F.max("confidence"), 2).alias("best"),
    )


def feed_health(spark, sf):
    return report.feed_health(r.customer_feed(spark, sf))


def sample_feed(spark, sf):
    return _flat(report.sample_feed(r.customer_feed(spark, sf)))


def count_by_source(spark, sf):
    return report.count_by_source(r.customer_feed(spark, sf))


def count_by_location(spark, sf):
    return report.count_by_location(r.customer_feed(spark, sf))


def upcoming(spark, sf):
    rows = report.upcoming(r.customer_feed(spark, sf), REF_DATE)
    return rows.select("cluster_id", "start_date", F.substring("title", 1, 60).alias("title"))


def upcoming_shown(spark, sf):
    return report.upcoming_shown(r.customer_feed(spark, sf), REF_DATE)


def search_text(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("description")
    )
    return report.search_text(rows, "Tion The").select("doc_id")


def age_band(spark, sf):
    size = F.col("p_size")
    ages = (
        F.when(size % 4 == 0, F.concat(F.lit("Ages "), size.cast("string"), F.lit("-"), (size + 3).cast("string")))
        .when(size % 4 == 1, F.concat(size.cast("string"), F.lit("+")))
        .when(size % 4 == 2, F.concat(F.lit("age "), size.cast("string")))
        .otherwise(F.lit("all"))
    )
    parts = table(spark, sf, "part").select("p_partkey", ages.alias("age_group"))
    bands = [report.filter_age(parts, b).withColumn("band", F.lit(b)) for b in ("0-2", "2-5", "5-10", "10+")]
    return bands[0].unionByName(bands[1]).unionByName(bands[2]).unionByName(bands[3])


def county_filter(spark, sf):
    return report.filter_county(r.customer_feed(spark, sf), "NATION_7").select("cluster_id", "county")


def display(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("start_date"),
        F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("source"),
    )
    return report.display(rows).select("event_id", "date_label", "source_badge")


def search_feed(spark, sf):
    listed = report.search_feed(r.customer_feed(spark, sf), query="customer", county="NATION_3")
    return listed.select("cluster_id", "title", "start_date", "date_label", "source_badge")


def pass_through_counts(spark, sf):
    """Two of three tiers written without resolution, counted as read back."""
    feeds = {
        1: table(spark, sf, "supplier").select(F.col("s_name").alias("title"), F.col("s_acctbal").cast("string").alias("cost")),
        2: table(spark, sf, "customer").select(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("city")),
        3: table(spark, sf, "part").select(F.col("p_name").alias("title")),
    }
    rows = pass_through(feeds, f"{run_dir(spark)}/events-{uuid.uuid4().hex}", tiers=[1, 2])
    return rows.groupBy("tier").agg(
        F.count("*").alias("n"), F.min("title").alias("first_title"), F.max("cost").alias("last_cost"), F.count_distinct("city").alias("cities")
    )


def _refreshed_customers(spark, sf) -> DataFrame:
    """Customers as a later capture would have them: some gone, some changed, some twice, some new."""
    k = F.col("cluster_id")
    rows = _customer_records(spark, sf).filter(k % 17 != 0)
    rows = rows.withColumns({
        "city": F.when(k % 5 == 0, F.lit("Moved")).otherwise(F.col("city")),
        "confidence": F.when(k % 10 == 5, F.lit(None)).otherwise(F.col("confidence")),
    })
    again = rows.filter(k % 19 == 1)
    return rows.unionByName(again).unionByName(again.filter(k % 2 == 0).withColumn("cluster_id", -k))


def _customer_records(spark, sf) -> DataFrame:
    return r.customer_feed(spark, sf).select("cluster_id", "title", "start_date", "city", "confidence")


def feed_changes(spark, sf):
    """Customers that a refresh added, removed and changed, with the fields."""
    return feed_difference(_customer_records(spark, sf), _refreshed_customers(spark, sf), ["cluster_id"])


def count_by_level(spark, sf):
    """Customers per county, city and type, per county and city, per county, and in total."""
    feed = r.customer_feed(spark, sf).withColumn("source_type", F.element_at("all_sources", 2))
    return count_levels(feed.withColumn("title", F.substring("title", -2, 2)))


def search_by_index(spark, sf):
    """`search_text` by an index of the documents' trigrams."""
    feed = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("description"))
    path = f"{run_dir(spark)}/index-{uuid.uuid4().hex}"
    write_index(feed, "doc_id", path)
    return search_index(spark, path, feed, "doc_id", "Tion The").select("doc_id")


def replaced_feed(spark, sf):
    """The current feed after two versions, by day."""
    path = f"{run_dir(spark)}/versions-{uuid.uuid4().hex}"
    rows = _customer_records(spark, sf)
    replace_feed(rows, path)
    replace_feed(rows.filter("cluster_id % 3 <> 0"), path)
    return read_current(spark, path).groupBy("start_date").agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


def page_changes(spark, sf):
    """Two captures of every page as a stream, the second with other content for every fourth: what goes on."""
    folder = f"{run_dir(spark)}/captures-{uuid.uuid4().hex}"
    first = table(spark, sf, "pages").select("page_id", "url", "html", F.lit("2026-01-01 12:00:00").cast("timestamp").alias("captured"))
    html = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("<!-- new -->"))).otherwise(F.col("html"))
    again = first.withColumns({"html": html, "captured": F.col("captured") + F.expr("interval 1 day")})
    for rows in (first, again):
        rows.write.mode("append").parquet(f"{folder}/in")
        refresh(spark, f"{folder}/in", "page_id bigint, url string, html string, captured timestamp",
                lambda new: changed_captures(new, "page_id", ["url", "html"], "captured"), f"{folder}/out", f"{folder}/progress")
    return spark.read.parquet(f"{folder}/out").select("page_id", F.dayofmonth("captured").alias("day"))


QUERIES = {
    f.__name__: f
    for f in [
        page_links, data_links, url_canonical, url_domains, url_first_seen, jsonld_events, listing_limit,
        monitored_entities, feed_union, quarantine, line_table, noise_filter, sections, event_ids,
        date_title_pairs, id_zip, caption_fields, caption_documents, hashtags, post_events, source_types,
        title_norm, location_norm, date_parse, decay, match_url, match_date_band, match_place, match_geo,
        match_title_date, match_title_place, match_nearby, resolve_fuzzy, match_rules, leaders_url, resolve_orders, resolve_documents, merge_survivorship, provenance,
        feed_order, feed_output, stage_counts, resolved_by_source, feed_roundtrip, feed_health, sample_feed, count_by_source, count_by_location,
        upcoming, upcoming_shown, search_text, age_band, county_filter, display, search_feed,
        match_same_day, match_metric, pass_through_counts, feed_changes, count_by_level, search_by_index, replaced_feed, page_changes,
    ]
}
