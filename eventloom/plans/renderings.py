"""Raw listings derived from the driver tables: pages, posts and feeds as they would be captured."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.operators.canonical import union_feeds
from eventloom.sources.captions import post_events
from eventloom.sources.lines import group_events
from eventloom.sources.pages import page_events

# Renderings cost more than a row's bytes suggest, so the rows of these tables are dealt out by key.
DEALT_BY = {
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "conversations": ["conv_id", "turn"],
    "orders": ["o_orderkey"],
    "events": ["event_id"],
}
REF_DATE = datetime.date(1998, 9, 2)


def table(spark: SparkSession, sf: str, name: str, spread: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    costly = spread or name in ("documents", "pages", "conversations")
    return df.repartition(*DEALT_BY[name]) if costly else df


def line_of(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def text_of(*lines) -> Column:
    return F.concat_ws("\n", *lines)


def order_day() -> Column:
    return F.col("o_orderdate").cast("date")


def order_posts(spark, sf) -> DataFrame:
    """Orders as captions; every seventh has no date emoji, every eleventh no title."""
    k, day = F.col("o_orderkey"), order_day()
    title = F.when(k % 11 == 0, F.lit("#untitled")).otherwise(line_of("Order party ", k.cast("string"), "!"))
    date = F.when(k % 7 == 0, line_of("see you ", F.date_format(day, "MMMM d"), "th")).otherwise(
        line_of("📅 ", F.date_format(day, "MMM d"), "th 3pm-5:30pm")
    )
    caption = text_of(
        title,
        date,
        line_of("📍 ", F.col("o_orderpriority"), ", Dublin"),
        line_of("🎟️ €", F.col("o_custkey").cast("string"), " per child"),
        line_of("👶 Ages ", (k % 5).cast("string"), "-", (k % 5 + 4).cast("string")),
        line_of("#kids #", F.col("o_orderstatus"), "_", (k % 10).cast("string")),
    )
    return table(spark, sf, "orders", spread=True).select(
        F.lit("kids").alias("hashtag"),
        F.when(k % 13 != 0, k.cast("string")).alias("code"),
        caption.alias("caption"),
        F.lit(None).cast("string").alias("media_url"),
        F.col("o_orderdate").alias("timestamp"),
        k.alias("ingest_ord"),
    )


def document_group_pages(spark, sf) -> DataFrame:
    """Documents as community pages: date, noise and header lines between their sentences."""
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\nThu, Oct 30\nFri, Oct 31, 2025\n More \n"))
    text = F.replace(text, F.lit(" the "), F.lit(" \nPast events (3)\n Sat, 1 nov. 2025\nab\n"))
    text = F.replace(text, F.lit(" la "), F.lit("\nAanstaande evenementen\ndo, 30 okt. 2025\n"))
    k = F.col("doc_id").cast("string")
    ids = [line_of(f'<a href="/events/{d}', F.lpad(k, 15, "1"), '">x</a>') for d in (7, 8, 7, 9)]
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("group_id"), F.concat(*ids).alias("html"), text.alias("visible_text")
    )


def document_pages(spark, sf) -> DataFrame:
    """Documents as detail pages holding JSON-LD, in eight shapes by key."""
    k = F.col("doc_id")
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("n_chars").cast("int"))
    address = F.struct(
        F.col("source").alias("streetAddress"), F.col("lang").alias("addressLocality"), F.lit("IE").alias("addressCountry")
    )
    geo = F.struct((53 + k % 7 / 10).alias("latitude"), (-6 - k % 3 / 10).alias("longitude"))
    event = F.struct(
        F.lit("Event").alias("@type"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("name"),
        F.col("text").alias("description"),
        day.cast("string").alias("startDate"),
        F.struct(line_of("Hall ", F.col("source")).alias("name"), address.alias("address"), geo.alias("geo")).alias("location"),
    )
    one = F.to_json(event)
    flat = F.to_json(event.withField("location", F.struct(F.lit("Barn").alias("name"), F.col("source").alias("address"))))
    loose = F.to_json(event.withField("location", F.lit("Town Square")))

    def script(body):
        return F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))

    shape = k % 8
    html = (
        F.when(shape == 0, script(one))
        .when(shape == 1, script(F.concat(F.lit('[7, {"@type": "Place"}, '), one, F.lit("]"))))
        .when(shape == 2, F.concat(script(F.lit('{"@type": "Event", broken')), script(flat)))
        .when(shape == 3, script(F.replace(loose, F.lit("\\n"), F.lit("\n"))))
        .when(shape == 4, F.concat(script(F.lit('{"@type": "MusicEvent", "name": "x"}')), script(one)))
        # More than one value in a block is no JSON; the next block counts.
        .when(shape == 5, F.concat(script(F.concat(F.lit('{"@type": "Place"},'), loose)), script(one)))
        .when(shape == 6, F.concat(script(F.concat(F.lit("["), one, F.lit("] garbage"))), script(flat)))
        .otherwise(F.concat(script(F.concat(one, F.lit("],[1"))), script(loose)))
    )
    return table(spark, sf, "documents").select(
        k.alias("page_id"),
        F.concat(F.lit("https://allevents.in/dublin/"), k.cast("string")).alias("url"),
        F.concat(F.lit("<html><body>"), html, F.lit("</body></html>")).alias("html"),
    )


def document_notices(spark, sf) -> DataFrame:
    """Documents as community pages with a dated entry on top; odd ones have no event id."""
    k = F.col("doc_id")
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("n_chars").cast("int"))
    link = line_of('<a href="/events/7', F.lpad(k.cast("string"), 15, "1"), '">x</a>')
    return table(spark, sf, "documents").select(
        k.alias("group_id"),
        F.when(k % 2 == 0, link).otherwise(F.lit("")).alias("html"),
        text_of(F.lit("Upcoming events"), F.date_format(day, "EEE, MMM d, yyyy"), F.col("text")).alias("visible_text"),
    )


def document_posts(spark, sf) -> DataFrame:
    """Documents as captions of posts, with a date line."""
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("n_chars").cast("int"))
    return table(spark, sf, "documents").select(
        F.col("source").alias("hashtag"),
        F.col("doc_id").cast("string").alias("code"),
        text_of(F.col("text"), line_of("📅 ", F.date_format(day, "MMM d yyyy"))).alias("caption"),
        F.lit(None).cast("string").alias("media_url"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.col("doc_id"),
    )


def document_listings(spark, sf) -> DataFrame:
    """Every document three times: detail page (tier 1), community page entries (2), post (3)."""
    pages = page_events(document_pages(spark, sf)).withColumn("ingest_ord", F.col("page_id") * 2)
    pages = pages.drop("page_id")
    posts = post_events(document_posts(spark, sf)).withColumn("ingest_ord", F.col("doc_id") * 2 + 1)
    groups = group_events(document_notices(spark, sf))
    # A page has far fewer entries than 10 ** 5.
    groups = groups.withColumn("ingest_ord", F.lit(10**16) + F.col("group_id") * 10**5 + F.col("idx")).drop("group_id", "idx")
    return union_feeds({1: pages, 2: groups, 3: posts.drop("doc_id")})


def digest(c: Column) -> Column:
    """Names that are either equal or far from similar."""
    return F.md5(c.cast("string"))


def weekly_orders(spark, sf) -> DataFrame:
    """Orders as events: one title per customer, dates moved to the start of a seven-day step."""
    k = F.col("o_orderkey")
    days = F.datediff(order_day(), F.lit("1992-01-01").cast("date"))
    kind = F.when(k % 4 == 0, "yourdaysout").when(k % 4 == 1, "allevents").when(k % 4 == 2, "facebook").otherwise("instagram")
    return table(spark, sf, "orders", spread=True).select(
        digest(F.col("o_custkey")).alias("title"),
        F.when(k % 3 != 0, F.col("o_orderpriority")).otherwise(F.lit("")).alias("description"),
        F.date_add(F.lit("1992-01-01").cast("date"), days - days % 7).cast("string").alias("start_date"),
        F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(F.lit("")).alias("cost"),
        F.concat(kind, F.lit(":"), k.cast("string")).alias("source"),
        F.lit("").alias("url"),
        k.alias("ingest_ord"),
    )


def letters(c: Column) -> Column:
    """32 letters from a to p."""
    return F.translate(F.md5(c.cast("string")), "0123456789abcdef", "abcdefghijklmnop")


def worded_orders(spark, sf) -> DataFrame:
    """Orders with titles whose ratio has a closed form: a beginning of their customer's letters, then a run of another.

    With b letters in common at the beginning and r in runs of the same letter,
    two titles of a customer have 2 (b + r) of all their letters in common.
    """
    k, g = F.col("o_orderkey"), F.col("o_custkey")
    run = F.repeat(F.get(F.array(F.lit("q"), F.lit("r"), F.lit("s")), (F.floor(k / 114) % 3).cast("int")), (1 + F.floor(k / 19) % 6).cast("int"))
    step = (k % 3 * 3).cast("string")
    return table(spark, sf, "orders", spread=True).select(
        F.concat(F.substring(letters(g), F.lit(1), (14 + k % 19).cast("int")), run).alias("title"),
        F.date_add(F.lit("2000-01-01").cast("date"), (g % 3000 * 10 + k % 6).cast("int")).cast("string").alias("day"),
        F.substring(letters(F.concat(F.lit("p"), g.cast("string"))), F.lit(1), (6 + F.floor(k / 7) % 12).cast("int")).alias("place"),
        F.concat((g % 160 - 80).cast("string"), F.lit(".0"), step).alias("lat"),
        (F.floor(g / 160) % 340 - 170).cast("string").alias("lon"),
        g.alias("customer"),
        k.alias("ingest_ord"),
    )


def customer_feed(spark, sf) -> DataFrame:
    """A feed of customers x nations with counties, cities and ages missing here and there."""
    k = F.col("c_custkey")
    nation = table(spark, sf, "nation")
    day = F.date_add(F.lit("1998-08-25").cast("date"), (k % 40).cast("int")).cast("string")
    # Beginnings of dates, and dates not where they belong, are no dates.
    start = (
        F.when(k % 41 == 7, F.substring(day, 1, 4))
        .when(k % 41 == 8, F.substring(day, 1, 7))
        .when(k % 41 == 9, F.concat(F.lit(" "), day))
        .when(k % 41 == 10, F.concat(F.substring(day, 1, 5), F.lit("9-01T10:00")))
        .otherwise(day)
    )
    return (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_name").alias("title"),
            F.col("c_mktsegment").alias("description"),
            start.alias("start_date"),
            F.when(k % 3 == 0, F.lit("\t ")).otherwise(F.concat(F.lit("County "), "n_name")).alias("county"),
            F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).alias("city"),
            F.lit("").alias("venue_name"),
            F.concat(F.lit("allevents:"), k.cast("string")).alias("source"),
            (F.pmod(k, F.lit(10)) / 10).alias("confidence"),
            F.array(F.lit("allevents"), F.col("c_mktsegment")).alias("all_sources"),
            F.array(*[F.concat(F.lit(f"u{i}/"), k.cast("string")) for i in range(4)]).alias("all_urls"),
            k.alias("cluster_id"),
        )
    )
