"""Record shapes and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Results must agree with these lists, constants and patterns.
# ---------------------------------------------------------------------------

# Trust in a source type, 0-100, in test order; anything else gets DEFAULT_PRIORITY.
SOURCE_PRIORITY = {
    "yourdaysout": 100,
    "allevents": 90,
    "facebook": 50,
    "instagram": 30,
}
DEFAULT_PRIORITY = 10

# Words that carry no identity in a title.
TITLE_STOP_WORDS = [
    "the", "a", "an", "at", "in", "on", "for", "with",
    "and", "or", "de", "la", "du", "le",
]

# Leading words dropped (once) from a location.
LOCATION_PREFIXES = ["county", "city of", "the"]

ENGLISH_ABBREVIATIONS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
ENGLISH_MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
DUTCH_MONTHS = {
    "januari": 1, "februari": 2, "maart": 3, "april": 4, "mei": 5, "juni": 6,
    "juli": 7, "augustus": 8, "september": 9, "oktober": 10, "november": 11, "december": 12,
}
DUTCH_ABBREVIATIONS = {
    "jan": 1, "feb": 2, "mrt": 3, "apr": 4, "mei": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dec": 12,
}

# Interface lines of a community page that are never a title or a date.
NOISE_LINES = [
    "log in", "forgot account?", "join group", "more", "about",
    "discussion", "featured", "events", "media", "invite",
    "see more", "see more on facebook", "email or phone number",
    "password", "create new account", "allow the use of cookies",
    "essential cookies", "cookies from other companies",
    "your cookie choices", "about cookies", "what are cookies?",
    "learn more", "why do we use", "what are meta",
    "manage your ad", "more information", "controlling cookies",
    "decline optional", "allow all", "accept all", "accepteer alles",
    "no upcoming events.", "no upcoming events", "geen aankomende",
]

# Section headers of a community page: substrings of the lower-cased line, tested in order.
SECTION_HEADERS = {
    "upcoming": ["upcoming events", "aanstaande", "gepland"],
    "past": ["past events", "verleden", "verstreken"],
    "no_upcoming": ["no upcoming events", "geen"],
}

# Markers that disqualify a caption line as the title.
TITLE_MARKERS = [
    "#", "📅", "⏰", "📍", "🎟", "👶", "✨", "👉", "🎉", "🔥", "🎈",
    "date:", "time:", "location:", "cost:", "age:",
]
DATE_MARKER, PLACE_MARKER, COST_MARKER, AGE_MARKER = "📅", "📍", "🎟", "👶"

# Listing-page link patterns, one capture group each.
RELATIVE_EVENT_LINK = r'href="(/events-on-in-county-[^"]+-\d+)"'
DATA_LINK = r'data-link="(https://allevents\.in/[^\s"\']+)"'
GROUP_EVENT_ID = r"/events/(\d{15,20})"
JSONLD_BLOCK = r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
FALLBACK_DOMAIN = "yourdaysout.com"

# Matching thresholds.
URL_RULE, TITLE_DATE_RULE, TITLE_PLACE_RULE, NEARBY_RULE = "url", "A", "B", "C"
TITLE_DATE_SIM, TITLE_DATE_DAYS = 0.8, 3
TITLE_PLACE_SIM, PLACE_SIM = 0.85, 0.7
NEARBY_SIM, NEARBY_DAYS = 0.5, 1
SAME_TITLE_SIM = 0.9
GEO_KM, KM_PER_DEGREE = 5.0, 111.0

# Confidence of merged records.
MERGED_CONFIDENCE, SINGLE_CONFIDENCE = 0.7, 0.5

# ---------------------------------------------------------------------------
# Record shapes
# ---------------------------------------------------------------------------

# Fields merged one by one, in order.
MERGED_FIELDS = [
    "title", "description", "start_date", "end_date", "venue_name",
    "venue_address", "city", "county", "country", "latitude", "longitude",
    "url", "cost", "age_group",
]

# Raw events: an absent key is NULL, a key that is present but empty is ''.
RAW_FIELDS = MERGED_FIELDS + ["date_raw", "location_raw", "source"]

FEED_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in MERGED_FIELDS + ["source"]]
    + [
        T.StructField("confidence", T.DoubleType()),
        T.StructField("all_sources", T.ArrayType(T.StringType())),
        T.StructField("all_urls", T.ArrayType(T.StringType())),
    ]
)
