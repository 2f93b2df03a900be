"""Scalar expressions on text, numbers and dates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists of the place classifier.
INDOOR_KEYWORDS = ("museum", "gallery", "hospital", "church", "cathedral", "library", "theatre", "theater",
                   "station", "centre", "center")
OUTDOOR_KEYWORDS = ("park", "trail", "lake", "mountain", "garden", "falls", "canyon", "glacier", "summit",
                    "valley", "river", "hot spring", "gondola", "viewpoint", "peak", "creek")

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    """The value itself, or null where it has nothing but white space."""
    value = col(value)
    return F.when(F.trim(value) != "", value)


def joined(separator: str, *parts: Column | str) -> Column:
    """The non-empty parts joined by ``separator``; null when none is left."""
    kept = [F.nullif(col(part), F.lit("")) for part in parts]
    return F.nullif(F.concat_ws(separator, *kept), F.lit(""))


def round_half_up(value: Column | str, digits: int) -> Column:
    """Decimal rounding away from zero; the double is first read at 12 decimals, which drops its binary noise."""
    return F.round(col(value).cast("decimal(30,12)"), digits).cast("double")


def round_half_even(value: Column | str, digits: int = 0) -> Column:
    return F.bround(col(value), digits)


def to_whole(value: Column | str) -> Column:
    """Null-safe conversion to an integer, halves to the even neighbour."""
    return F.bround(col(value).try_cast("double"), 0).cast("int")


def iso_date(text: Column | str) -> Column:
    """The date a ``yyyy-MM-dd`` text names. The pattern test comes first: a bare cast also accepts words."""
    text = col(text).cast("string")
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def clamp_day(day: Column | str, start: Column | str, end: Column | str) -> Column:
    """The requested day moved into the window; the first day when it is blank or no date.

    Compared as text, so that a well-formed day outside the calendar is clamped like any other.
    """
    day, start, end = col(day).cast("string"), col(start), col(end)
    clamped = F.greatest(start.cast("string"), F.least(end.cast("string"), day)).try_cast("date")
    return F.when(day.rlike(ISO_DATE), F.coalesce(clamped, start)).otherwise(start)


def mentions(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, (text.contains(word) for word in words))


def classify_place(title: Column | str, extract: Column | str, indoor: Sequence[str] = INDOOR_KEYWORDS,
                   outdoor: Sequence[str] = OUTDOOR_KEYWORDS) -> tuple[Column, Column]:
    """(category, is_outdoor) from keywords in the text; an indoor word wins over an outdoor word."""
    text = F.lower(F.concat_ws(" ", col(title), col(extract)))
    is_outdoor = ~mentions(text, indoor) & mentions(text, outdoor)
    return F.when(is_outdoor, "outdoor").otherwise("attraction"), is_outdoor.cast("long")


def aqi_label(aqi: Column | str) -> Column:
    aqi = col(aqi)
    return (F.when(aqi.isNull(), "—").when(aqi < 50, "good").when(aqi < 100, "moderate")
            .when(aqi < 150, "unhealthy·sg").otherwise("unhealthy"))


def aqi_colour(aqi: Column | str) -> Column:
    """One display colour per air-quality label."""
    aqi = col(aqi)
    return (F.when(aqi.isNull(), "#5f7688").when(aqi < 50, "#6bd08f").when(aqi < 100, "#eaa84a")
            .when(aqi < 150, "#f2864a").otherwise("#e0607b"))


def page_slug(title: Column | str) -> Column:
    """The title as it stands in a page URL; a slash stays a slash."""
    encoded = F.url_encode(F.replace(col(title), F.lit(" "), F.lit("_")))
    return F.replace(encoded, F.lit("%2F"), F.lit("/"))


def month_day(date: Column | str) -> Column:
    return F.substring(col(date).cast("string"), 6, 5)


def hour_minute(time: Column | str) -> Column:
    return F.substring(col(time), 1, 5)


def blurb(text: Column | str, length: int = 240) -> Column:
    return F.substring(F.coalesce(col(text), F.lit("")), 1, length)
