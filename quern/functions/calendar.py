"""Dates, day numbers and time stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day 0 of the modified Julian day count.
MJD_EPOCH = "1858-11-17"


def date_seconds(text: Column) -> Column:
    """``yyyy-MM-dd`` as epoch seconds; null for null, empty or malformed text."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def date_seconds_or_missing(text: Column) -> Column:
    """As ``date_seconds``, with -1 for what's missing."""
    return F.coalesce(date_seconds(text), F.lit(-1))


def to_mjd(date: Column) -> Column:
    return F.datediff(date, F.lit(MJD_EPOCH).cast("date"))


def from_mjd(mjd: Column) -> Column:
    return F.date_add(F.lit(MJD_EPOCH).cast("date"), mjd)


def short_date(date: Column) -> Column:
    """Month/day/two-digit year, without leading zeros of month and day."""
    return F.date_format(date, "M/d/yy")


def stamp(moment: Column) -> Column:
    """``yyMMddHHmm`` as a whole number."""
    return F.date_format(moment, "yyMMddHHmm").cast("long")


def age_decade(year: Column, now: int = 2010) -> Column:
    """Whole decades from a year of birth to ``now``."""
    return F.floor((F.lit(now) - year) / 10)
