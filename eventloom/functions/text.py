"""Column expressions that normalise titles, places, sources and confidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventloom.schemas import (
    DEFAULT_PRIORITY,
    LOCATION_PREFIXES,
    SOURCE_PRIORITY,
    TITLE_STOP_WORDS,
)

# Unicode character classes for Java regexes; the defaults there are ASCII-only.
SPACE = r"\s\p{Z}\x1c-\x1f\x85"
WORD = r"\p{L}\p{N}_"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def text_lines(c: Column) -> Column:
    """Trimmed, non-empty lines of a text as an array."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def _words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{WORD}]+", " "))


def normalize_title(c: Column) -> Column:
    """Lower-cased words of a title without punctuation and stop-words."""
    stop = "|".join(TITLE_STOP_WORDS)
    kept = F.regexp_replace(_words(c), f"(?<![^ ])(?:{stop})(?![^ ])", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def normalize_location(c: Column) -> Column:
    """Lower-cased words of a place without one leading generic prefix."""
    return F.regexp_replace(_words(c), f"^(?:{'|'.join(LOCATION_PREFIXES)}) +", "")


def source_type(source: Column, url: Column) -> Column:
    """Source type from source id or URL, else the prefix before ':' or 'unknown'."""
    src, link = F.coalesce(source, F.lit("")), F.coalesce(url, F.lit(""))
    known = F.lit(None).cast("string")
    for name in reversed(SOURCE_PRIORITY):
        known = F.when(src.contains(name) | link.contains(name), F.lit(name)).otherwise(known)
    prefix = F.when(src.contains(":"), F.split_part(src, F.lit(":"), F.lit(1)))
    return F.coalesce(known, prefix, F.lit("unknown"))


def type_priority(source_type: Column) -> Column:
    """Priority of an inferred source type."""
    out = F.lit(DEFAULT_PRIORITY)
    for name, value in SOURCE_PRIORITY.items():
        out = F.when(source_type == name, F.lit(value)).otherwise(out)
    return out


def prefix_priority(source: Column) -> Column:
    """Priority by the beginning of the source string; URLs get the default."""
    out = F.lit(DEFAULT_PRIORITY)
    for name, value in reversed(SOURCE_PRIORITY.items()):
        out = F.when(source.startswith(name), F.lit(value)).otherwise(out)
    return out


def base_confidence(source_type: Column) -> Column:
    return type_priority(source_type) / F.lit(100.0)


def confidence_decay(days_old: Column) -> Column:
    """Step down the weight of an event by its age in days."""
    return (
        F.when(days_old > 30, F.lit(0.3))
        .when(days_old > 14, F.lit(0.6))
        .when(days_old > 7, F.lit(0.8))
        .otherwise(F.lit(1.0))
    )


def canonical_url(c: Column) -> Column:
    """Cut the query string and all trailing slashes; fragments stay."""
    return F.regexp_replace(F.split_part(c, F.lit("?"), F.lit(1)), "/+$", "")


def url_domain(c: Column) -> Column:
    """Host part of an absolute URL ('' when there is none)."""
    return F.split_part(c, F.lit("/"), F.lit(3))


def to_degrees(c: Column) -> Column:
    """Double from a decimal literal; NULL for anything else."""
    number = strip(c)
    literal = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
    return F.when(number.rlike(literal), number.try_cast("double"))
