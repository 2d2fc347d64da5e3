"""Times. A time without a zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import strip

#: Month names, and the hours that named zones are from UTC; any other name counts as UTC.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"ast": -4, "adt": -3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
#: A mail date: weekday, day, month, year, hour, minute, second, zone and comment; some parts may be missing.
_MAIL = r"(?i)^(?:[a-z]+,\s*|(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?\s+)?(\d{1,2})[\s\-]+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?[\s\-]+(\d{4}|\d{2}),?\s+(\d{1,2})[:.](\d{1,2})(?:[:.](\d{1,2}))?(?:\s+([a-z]+|[+\-]\d{4}))?(?:\s*\(.*\))?$"
#: An ISO date, with or without time, fraction and offset, all in the long or all in the short form.
_ISO_LONG = r"^(\d{4})-(\d{2})-(\d{2})(?:[^\d](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?(Z|[+\-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?$"
_ISO_SHORT = r"^(\d{4})(\d{2})(\d{2})(?:[^\d](\d{2})(?:(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?(Z|[+\-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?$"
#: Seconds from which a time is beyond the calendar.
_MOST_SECONDS = 253_402_300_800


def _part(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def _int(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def _at(year: Column, month: Column, day: Column, hour: Column, minute: Column, seconds: Column, ahead: Column) -> Column:
    """A time of a clock that is ``ahead`` seconds before UTC's; null where there is no such time."""
    made = F.try_make_timestamp(year, month, day, hour, minute, seconds.cast("decimal(16,6)"), F.lit("UTC"))
    return made - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ahead.cast("decimal(18,6)"))


def _mail_date(text: Column) -> Column:
    part = lambda k: _part(text, _MAIL, k)
    year = part(3).try_cast("int")
    year = F.when(F.length(part(3)) == 2, F.when(year <= 68, year + 2000).otherwise(year + 1900)).otherwise(year)
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.lower(part(2))).cast("int")
    zone = F.lower(F.coalesce(part(7), F.lit("")))
    hours = F.lit(0)
    for name, h in ZONES.items():
        hours = F.when(zone == name, h).otherwise(hours)
    minutes = F.when(zone.rlike(r"^[+\-]"), F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))).otherwise(hours * 60)
    return _at(year, month, part(1).try_cast("int"), part(4).try_cast("int"), part(5).try_cast("int"), _int(part(6)), minutes * 60)


def _iso_date(text: Column, pattern: str) -> Column:
    part = lambda k: _part(text, pattern, k)
    zone = F.regexp_replace(F.coalesce(part(8), F.lit("")), ":", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    ahead = sign * (_int(F.substring(zone, 2, 2)) * 3600 + _int(F.substring(zone, 4, 2)) * 60 + _int(F.substring(zone, 6, 2)))
    micros = _int(F.rpad(F.substring(F.coalesce(part(7), F.lit("0")), 1, 6), 6, "0"))
    seconds = _int(part(6)).cast("decimal(16,6)") + micros / F.lit(1_000_000).cast("decimal(16,6)")
    found = _at(part(1).try_cast("int"), part(2).try_cast("int"), part(3).try_cast("int"), _int(part(4)), _int(part(5)), seconds, ahead)
    return F.when(_int(part(6)) < 60, found)


def parse_feed_date(*fields: Column) -> Column:
    """The first field that says anything: a mail date in any spelling (named zones, two-digit years, no seconds) or an ISO date; else null."""
    text = F.coalesce(*(F.nullif(strip(f), F.lit("")) for f in fields))
    return F.coalesce(_mail_date(text), parse_iso(text))


def parse_iso(text: Column) -> Column:
    """An ISO date or time in the long or the short form, with a fraction of any length (six digits count) and an offset in any form; a
    time without an offset is UTC. Weeks and days of the year are not read."""
    text = strip(text)
    return F.coalesce(_iso_date(text, _ISO_LONG), _iso_date(text, _ISO_SHORT))


def parse_unix(seconds: Column) -> Column:
    """Whole seconds since 1970; a fraction is dropped, what is no number or beyond the calendar is null."""
    number = seconds.try_cast("double")
    fits = F.when(F.abs(number) < _MOST_SECONDS, number)
    return F.timestamp_seconds(F.when(fits < 0, F.ceil(fits)).otherwise(F.floor(fits)))


def iso(at: Column) -> Column:
    """A time without a zone, which is UTC, in ISO form."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def digest_date(at: Column) -> Column:
    """Calendar day at UTC+8."""
    return F.to_date(at + F.make_dt_interval(F.lit(0), F.lit(8)))
