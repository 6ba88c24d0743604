import datetime

import pytest
from pyspark.sql import functions as F

from eventloom.functions import text as t
from eventloom.functions.dates import parse_any_date

REF = datetime.date(2026, 5, 1)


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalize_title(spark):
    cases = {
        "The Café & the à Bar_1!": "café à bar_1",
        "Halloween at the Zoo -- for Kids": "halloween zoo kids",
        "LE Tour de   l'été": "tour l été",
        "Theatre and Andy": "theatre andy",
        "\t \n": "",
        None: "",
        "ঢাকা উৎসব": "ঢ ক উৎসব",
    }
    assert apply(spark, t.normalize_title, list(cases)) == list(cases.values())


def test_normalize_location(spark):
    cases = {
        " County  Dublin, Ireland": "dublin ireland",
        "City of Cork": "cork",
        "The County Hall": "county hall",
        "county": "county",
        "Countyville": "countyville",
        None: "",
    }
    assert apply(spark, t.normalize_location, list(cases)) == list(cases.values())


def test_parse_any_date(spark):
    d = datetime.date
    cases = {
        "2026-10-25T18:00:00+00:00": d(2026, 10, 25),
        " 2026-10-25 ": d(2026, 10, 25),
        "2025-02-30": None,
        "Thu, Oct 30, 2025": d(2025, 10, 30),
        "Thu, Oct 30, 2025 at 3:00 PM GMT": d(2025, 10, 30),
        "from Oct 1, 2025 to Nov 2, 2025": d(2025, 11, 2),
        "Oct 30, 2025": None,
        "Oct 30th": None,
        "Oct 30th 3pm-5pm": d(2026, 10, 30),
        "October 30th 2024": d(2024, 10, 30),
        "do, 30 okt. 2025": d(2025, 10, 30),
        "za. 1 mrt. 2025": d(2025, 3, 1),
        "Thu, Jul 23": d(2026, 7, 23),
        "Thu 30 October 2025": d(2026, 10, 20),
        "Thu, Feb 30, 2025": None,
        "someday": None,
        "": None,
        None: None,
    }
    assert apply(spark, lambda c: parse_any_date(c, REF), list(cases)) == list(cases.values())
    relaxed = apply(spark, lambda c: parse_any_date(c, REF, relaxed=True), ["Oct 30th", "Oct 30, 2025", "Xyz 30"])
    assert relaxed == [d(2026, 10, 30), d(2025, 10, 30), None]


def test_urls(spark):
    cases = {"https://a.b/x//?q=1#f": "https://a.b/x", "https://a.b/#top": "https://a.b/#top", "": ""}
    assert apply(spark, t.canonical_url, list(cases)) == list(cases.values())
    assert apply(spark, t.url_domain, ["https://a.b/x", "/x/y"]) == ["a.b", "y"]


@pytest.mark.parametrize(
    "source, url, expected",
    [
        ("yourdaysout:1", "", "yourdaysout"),
        ("instagram:x", "https://www.yourdaysout.com/1", "yourdaysout"),
        ("facebook:allevents", "", "allevents"),
        ("", "https://www.facebook.com/events/1", "facebook"),
        ("instagram:tag:1", None, "instagram"),
        ("blog:7", "", "blog"),
        (None, None, "unknown"),
    ],
)
def test_source_type(spark, source, url, expected):
    row = spark.createDataFrame([(source, url)], "s string, u string").select(t.source_type(F.col("s"), F.col("u")))
    assert row.first()[0] == expected


def test_priorities_and_decay(spark):
    kinds = ["yourdaysout", "allevents", "facebook", "instagram", "blog"]
    assert apply(spark, t.base_confidence, kinds) == [1.0, 0.9, 0.5, 0.3, 0.1]
    assert apply(spark, t.prefix_priority, ["facebook:1", "https://allevents.in/1", "allevents"]) == [50, 10, 90]
    assert apply(spark, lambda c: t.confidence_decay(c.cast("int")), ["-3", "7", "8", "15", "31"]) == [1.0, 1.0, 0.8, 0.6, 0.3]


def test_degrees(spark):
    cases = {"53.34": 53.34, " -6.2 ": -6.2, ".5": 0.5, "1e1": 10.0, "53.1d": None, "None": None, "nan": None, "": None}
    assert apply(spark, t.to_degrees, list(cases)) == list(cases.values())


def test_dates_are_parsed_from_a_text_taken_once(spark):
    """The steps are a function of the stripped text, not one expression that strips and searches it in every step."""
    parsed = spark.createDataFrame([("Oct 30th",)], "d string").select(parse_any_date(F.col("d"), datetime.date(2025, 1, 1)))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("trim(") <= 2
