import json

from pyspark.sql import functions as F

from eventloom.sources import captions, lines, pages
from eventloom.storage import read_feed, read_raw_json, write_feed
from eventloom.operators.canonical import monitored, per_source_limit, to_canonical, union_feeds, with_ingest_order

CAPTION = "Halloween Disco\n📅 Oct 30th 3pm-5:30pm\n📍 Community Center, Dublin\n🎟️ €5 per child\n👶 Ages 2-10\n#a #b_é"


def captioned(spark, *texts, **kw):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, caption string")
    return [r.asDict() for r in captions.with_caption_fields(df, **kw).orderBy("i").collect()]


def test_caption_fields(spark):
    full, bare, none, late, long = captioned(
        spark, CAPTION, "#x\nTime: 3\n\n see you MARVELLOUS 12th", None, "A\n📅 Sat, Nov 1 2025 | 3pm\n📅 second", "x" * 200
    )
    assert full["title"] == "Halloween Disco"
    assert full["date_raw"] == "Oct 30th 3pm-5:30pm"
    assert full["time_raw"] == "3pm-5:30pm"
    assert full["location_raw"] == "Community Center, Dublin"
    assert full["cost"] == "€5 per child"
    assert full["age_group"] == "Ages 2-10"
    assert full["hashtags"] == ["#a", "#b_é"]
    assert (bare["title"], bare["date_raw"]) == ("see you MARVELLOUS 12th", "MARVELLOUS 12th")
    assert {none[k] for k in ("title", "date_raw", "cost")} == {""} and none["hashtags"] == []
    assert (late["date_raw"], late["time_raw"]) == ("Nov 1 2025 | 3pm", "3pm")
    assert len(long["title"]) == 120
    assert captioned(spark, CAPTION, keep_variation_selector=True)[0]["cost"].startswith("️")


def test_post_events(spark):
    rows = [("kids", "c1", CAPTION * 40, "m", None), ("kids", None, "", None, None)]
    df = spark.createDataFrame(rows, "hashtag string, code string, caption string, media_url string, timestamp timestamp")
    first, second = captions.post_events(df).collect()
    assert first.url == "https://www.instagram.com/p/c1/" and first.source == "instagram:kids:c1"
    assert first.description == (CAPTION * 40)[:500]
    assert second.title == "Instagram post #kids" and second.url == "https://www.instagram.com/p//"


def entries(spark, text, html=""):
    df = spark.createDataFrame([("g", html, text)], "group_id string, html string, visible_text string")
    return [tuple(r) for r in lines.group_events(df).select("idx", "date_raw", "title", "section", "event_id").orderBy("idx").collect()]


def test_group_entries(spark):
    html = '<a href="/events/123456789012345"></a>/events/123456789012345 /events/223456789012345 /events/99'
    text = (
        "Log in\nThu, Jul 1\nUpcoming events\nThu, Jul 23\nFri, Jul 24\nA party\nMore\nSat, 1 nov. 2025\nmore\nab\nBig party\n"
        "Past events\nThu, Oct 30, 2025"
    )
    assert entries(spark, text, html) == [
        (0, "Thu, Jul 23", "Fri, Jul 24", "upcoming", "123456789012345"),
        (1, "Sat, 1 nov. 2025", "Big party", "upcoming", "223456789012345"),
        (2, "Thu, Oct 30, 2025", "", "past", ""),
    ]


def test_group_entries_without_header_drop_the_first_line(spark):
    assert entries(spark, "Thu, Jul 1\nThu, Jul 23\nTitle") == [(0, "Thu, Jul 23", "Title", "all", "")]
    assert entries(spark, "") == []


def test_dutch_headers_and_titles_out_of_reach(spark):
    text = "Geplande evenementen\ndo, 30 okt. 2025\nab\ncd\nmore\nToo late\nVerleden\nThu, Jul 1\nGeen aankomende"
    assert entries(spark, text) == [(0, "do, 30 okt. 2025", "", "upcoming", ""), (1, "Thu, Jul 1", "", "past", "")]


def test_date_lines(spark):
    cases = {
        "Thu, Sep 24 at 8:00 PM IST": (True, True), "Thu, Jul 23": (True, True), "do, 30 okt. 2025": (True, True),
        "Sa. x": (True, False), "Summer Camp 2026": (True, False), "Hello world": (False, False), "A 12": (False, False),
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, v string")
    got = df.select(lines.is_date_line(F.col("v")), lines.is_date_line(F.col("v"), strict=True)).collect()
    assert [tuple(r) for r in got] == list(cases.values())


def script(body):
    return f'<script id=1 type="application/ld+json" data-x>{body}</script>'


def test_page_events(spark):
    nested = {
        "@type": "Event", "@id": "id:1", "name": "A\nB", "startDate": "2025-01-01",
        "location": {"name": "V", "address": {"streetAddress": "s", "addressLocality": "Dublin"}, "geo": {"latitude": 53.34, "longitude": None}},
    }
    cases = [
        script("{broken") + script(json.dumps([1, {"@type": "Thing"}, nested]).replace("\\n", "\n")),
        script('{"@type": "Event", "url": "u", "location": {"address": "Main St"}}'),
        script('{"@type": "Event", "location": "Square"}') + script('{"@type": "Event", "name": "second"}'),
        script('{"@type": "Event", "location": [{"name": "L"}, {"name": "M"}]}'),
        script('{"@type": "Event", "location": null}'),
        script('{"@type": "MusicEvent"}') + script('{"@type": ["Event"]}'),
        script('{"@type": "Event"} trailing'),
        script("{'@type': 'Event'}"),
        "<p>none</p>",
    ]
    df = spark.createDataFrame([(i, f"https://x/{i}", h, 200) for i, h in enumerate(cases)] + [(99, "u", cases[1], 404)], "i int, url string, html string, status int")
    rows = {r.i: r for r in pages.page_events(df.select("i", "url", "html", "status")).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4]
    r = rows[0]
    assert (r.title, r.venue_name, r.venue_address, r.city, r.latitude, r.longitude) == ("A\nB", "V", "s", "Dublin", "53.34", "None")
    assert (r.source, r.url) == ("id:1", "https://x/0")
    assert (rows[1].venue_address, rows[1].url, rows[1].source) == ("Main St", "u", "https://x/1")
    assert (rows[2].venue_name, rows[2].title) == ("Square", "")
    assert rows[3].venue_name == "L"
    assert (rows[4].venue_name, rows[4].latitude) == ("", "")


def test_page_links(spark):
    html = (
        '<a href="/events-on-in-county-dublin-ireland/b-2"><a href="/events-on-in-county-x/a-1">'
        '<a href="/events-on-in-county-dublin-ireland/b-2"><a href="/events-on-in-ireland/christmas">'
        '<i data-link="https://allevents.in/d/1?ref=x"><i data-link="https://allevents.in/d/1/"><i data-link="https://other.in/d/2">'
    )
    df = spark.createDataFrame([(1, "https://www.site.com/list", html)], "page_id int, url string, html string")
    got = [(r.pos, r.link) for r in pages.page_links(df).orderBy("pos").collect()]
    assert got == [
        (0, "https://www.site.com/events-on-in-county-dublin-ireland/b-2"),
        (1, "https://www.site.com/events-on-in-county-x/a-1"),
    ]
    assert [r.link for r in pages.data_links(df).collect()] == ["https://allevents.in/d/1"]


def test_canonical_fallbacks(spark):
    a = spark.createDataFrame([("t", "Oct 1", "Hall", 1)], "title string, date_raw string, location_raw string, ingest_ord long")
    b = spark.createDataFrame([("", "", "", "", "facebook:1", 2)], "title string, start_date string, country string, venue_name string, source string, ingest_ord long")
    first, second = to_canonical(union_feeds({2: b, 1: a, 3: a}, tiers=[1, 2])).orderBy("ingest_ord").collect()
    assert (first.start_date, first.venue_name, first.country, first.source) == ("Oct 1", "Hall", "IE", "unknown")
    assert (second.start_date, second.country, second.source_type, second.confidence) == ("", "", "facebook", 0.5)
    assert second.rank < first.rank


def test_limits_monitoring_and_order(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "source string, ord int")
    assert sorted(tuple(r) for r in per_source_limit(df, 2).collect()) == [("a", 1), ("a", 2), ("b", 9)]
    plan = per_source_limit(df, 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    dim = spark.createDataFrame([("b",), ("b",)], "source string")
    assert monitored(df, dim, "source").count() == 1
    got = with_ingest_order(df, "source", "ord").orderBy("ingest_ord").select("ord").collect()
    assert [r.ord for r in got] == [1, 2, 3, 9]


def test_feed_files(spark, tmp_path):
    assert read_feed(spark, str(tmp_path / "none")).count() == 0
    canonical = to_canonical(spark.createDataFrame([("Café ✨", "2026-01-01", 1)], "title string, start_date string, ingest_ord long"))
    feed = canonical.withColumns({"all_sources": F.array("source_type"), "all_urls": F.array("url")})
    write_feed(feed, str(tmp_path / "feed"))
    back = read_feed(spark, str(tmp_path / "feed"), multi_line=False)
    assert back.first().title == "Café ✨" and back.first().all_sources == ["unknown"]
    (tmp_path / "raw.json").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    good, bad = read_raw_json(spark, str(tmp_path / "raw.json"), "a int")
    assert [r.a for r in good.collect()] == [1, 3] and bad.count() == 1
