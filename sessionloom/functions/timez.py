"""Local calendar fields of UTC wall-clock timestamps, and date windows."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_YMD = re.compile(r"\d{4}-\d{2}-\d{2}")


def to_utc_ntz(ts: Column) -> Column:
    """Instant -> UTC wall clock, independent of the session time zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def parse_instant(text: Column) -> Column:
    """ISO-8601 text -> UTC wall clock; null when it cannot be read."""
    return to_utc_ntz(F.try_to_timestamp(text))


def local_time(ts: Column, tz: str = "UTC") -> Column:
    return ts if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def local_day(ts: Column, tz: str = "UTC") -> Column:
    return F.to_date(local_time(ts, tz))


def local_hour(ts: Column, tz: str = "UTC") -> Column:
    return F.hour(local_time(ts, tz))


def day_text(ts: Column, tz: str = "UTC") -> Column:
    return F.date_format(local_time(ts, tz), "yyyy-MM-dd")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less UTC timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


@dataclass(frozen=True)
class DayWindow:
    """Inclusive pair of local calendar days."""

    first: dt.date
    last: dt.date

    def contains(self, ts: Column, tz: str = "UTC") -> Column:
        return local_day(ts, tz).between(F.lit(self.first), F.lit(self.last))


def resolve_window(date: str | None = None, since: str | None = None, days: int | None = None, *, today: dt.date) -> DayWindow:
    """One day, else since..today, else the last N days including today, else today."""

    def parse(name: str, text: str) -> dt.date:
        if not _YMD.fullmatch(text):
            raise ValueError(f"invalid {name} {text!r}, want YYYY-MM-DD")
        return dt.date.fromisoformat(text)

    if date:
        day = parse("date", date)
        return DayWindow(day, day)
    if since:
        return DayWindow(parse("since", since), today)
    if days and days > 0:
        return DayWindow(today - dt.timedelta(days=days - 1), today)
    return DayWindow(today, today)
