"""DT1-DT3: report ranges. Bounds are calendar days in a zone; the range is half-open."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"
MOST_DAYS = 366


@dataclass(frozen=True)
class DateWindow:
    from_date: dt.date
    to_date: dt.date
    start: dt.datetime
    end: dt.datetime

    def holds(self, ts: Column) -> Column:
        """FLT4, for a timestamp without zone that is in UTC."""
        text = lambda x: F.to_timestamp_ntz(F.lit(x.strftime("%Y-%m-%d %H:%M:%S")))
        return (ts >= text(self.start)) & (ts < text(self.end))


def _day(text: str) -> dt.date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError("invalid_date")
    return dt.date.fromisoformat(text)


def resolve(from_text: str | None, to_text: str | None, zone: str = "UTC", most_days: int = MOST_DAYS, now: dt.datetime | None = None) -> DateWindow:
    """Default: up to the end of today, seven days long."""
    tz = ZoneInfo(zone)
    today = (now or dt.datetime.now(dt.UTC)).astimezone(tz).date()
    to = _day(to_text) if to_text else today + dt.timedelta(1)
    start = _day(from_text) if from_text else to - dt.timedelta(7)
    if to <= start:
        raise ValueError("invalid_date_range")
    if (to - start).days > most_days:
        raise ValueError("date_range_too_large")
    at = lambda d: dt.datetime.combine(d, dt.time(), tz).astimezone(dt.UTC)
    return DateWindow(start, to, at(start), at(to))


def admin_window(from_text: str | None, to_text: str | None, **more) -> DateWindow:
    return resolve(from_text, to_text, "UTC", **more)


def instructor_window(from_text: str | None, to_text: str | None, **more) -> DateWindow:
    return resolve(from_text, to_text, EASTERN, **more)


def month_range(day: dt.date) -> tuple[dt.date, dt.date]:
    """DT7: first and last day of a day's month."""
    first = day.replace(day=1)
    return first, (first + dt.timedelta(32)).replace(day=1) - dt.timedelta(1)


def eastern_date(ts: Column) -> Column:
    """DT4: New York calendar day of a UTC timestamp without zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(EASTERN), ts))


def elapsed_ms(seconds: Column) -> Column:
    """DT8."""
    return F.greatest(F.lit(0), F.bround(seconds * 1000).cast("long"))


def clerk_time(millis: Column) -> Column:
    """DT6: epoch milliseconds; anything but a whole number is null."""
    return F.timestamp_millis(F.when(millis.cast("string").rlike(r"^-?\d+$"), millis.cast("long")))
