"""Local days, ranges and daily opening windows."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
MAX_RANGE_DAYS = 400
# Named ranges and their length in days.
RANGE_DAYS = {"today": 1, "yesterday": 1, "7d": 7, "30d": 30, "90d": 90}


def local_time(ts: Column, zone: str = ZONE) -> Column:
    """Wall clock in `zone` of a UTC instant (a zone-less column is read as UTC)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(local_time(ts, zone))


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _utc(day: date, zone: str) -> datetime:
    return datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)


def resolve_range(
    key: str, now: datetime, custom: tuple[str, str] | None = None, zone: str = ZONE
) -> tuple[datetime, datetime]:
    """UTC bounds [from, to) aligned to local days. `now` is UTC without a zone."""
    if key == "custom":
        first, last = (date.fromisoformat(v) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", v or "") else None for v in custom or ("", ""))
        if first is None or last is None:
            raise ValueError("start and end dates are required")
        end = last + timedelta(days=1)
        if end <= first or (end - first).days > MAX_RANGE_DAYS:
            raise ValueError(f"range must be ordered and at most {MAX_RANGE_DAYS} days")
        return _utc(first, zone), _utc(end, zone)
    today = now.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).date()
    end = today if key == "yesterday" else today + timedelta(days=1)
    return _utc(end - timedelta(days=RANGE_DAYS[key]), zone), _utc(end, zone)


def week_period(
    period: str, now: datetime, custom: tuple[str, str] | None = None, zone: str = ZONE
) -> tuple[datetime, datetime]:
    """Monday-based week as UTC bounds [from, to)."""
    if period == "custom":
        return resolve_range("custom", now, custom, zone)
    today = now.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).date()
    monday = today - timedelta(days=today.weekday() + (7 if period == "last_week" else 0))
    return _utc(monday, zone), _utc(monday + timedelta(days=7), zone)


def week_start(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.date_trunc("week", local_time(ts, zone)))


def in_range(ts: Column, start: datetime, end: datetime) -> Column:
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def modified_between(ts: Column, start: str | None, end: str | None) -> Column:
    """A bare date as upper bound takes in that whole day."""
    ok = F.lit(True)
    if start:
        ok = ok & (ts >= F.lit(start).cast("timestamp_ntz"))
    if end:
        bare = re.fullmatch(r"\d{4}-\d{2}-\d{2}", end) is not None
        stop = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz") if bare else F.lit(end).cast("timestamp_ntz")
        ok = ok & ((ts < stop) if bare else (ts <= stop))
    return ok


def minute_of_day(ts: Column, zone: str = ZONE) -> Column:
    local = local_time(ts, zone)
    return F.hour(local) * 60 + F.minute(local)


def _clock_minutes(text: Column) -> Column:
    """Minutes of an HH:MM text, null when malformed."""
    good = text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    return F.when(good, F.substring(text, 1, 2).cast("int") * 60 + F.substring(text, 4, 2).cast("int"))


def window_enabled(enabled: Column, start: Column, end: Column) -> Column:
    first, last = _clock_minutes(start), _clock_minutes(end)
    return F.coalesce(enabled & (first != last), F.lit(False))


def window_open(enabled: Column, start: Column, end: Column, ts: Column, zone: str = ZONE) -> Column:
    """True inside the daily window, which may wrap midnight; a disabled window is always open."""
    first, last, now = _clock_minutes(start), _clock_minutes(end), minute_of_day(ts, zone)
    inside = F.when(first < last, (now >= first) & (now < last)).otherwise((now >= first) | (now < last))
    return ~window_enabled(enabled, start, end) | F.coalesce(inside, F.lit(True))


def next_open(enabled: Column, start: Column, end: Column, ts: Column, zone: str = ZONE) -> Column:
    """Next opening on the minute, null while open."""
    wait = _clock_minutes(start) - minute_of_day(ts, zone)
    wait = F.when(wait <= 0, wait + 24 * 60).otherwise(wait)
    at = ts.cast("timestamp_ntz") + F.make_dt_interval(mins=wait)
    rounded = F.date_trunc("minute", at + F.expr("interval 30 seconds"))
    return F.when(~window_open(enabled, start, end, ts, zone), rounded)


def effective_start(
    enabled: Column, start: Column, end: Column, eligible: Column, now: Column, zone: str = ZONE
) -> Column:
    base = F.greatest(eligible.cast("timestamp_ntz"), now.cast("timestamp_ntz"))
    return F.coalesce(next_open(enabled, start, end, base, zone), base)


def add_days(day: Column, n: Column | int) -> Column:
    return F.date_add(day, n)


def diff_days(first: Column, last: Column) -> Column:
    return F.datediff(last, first)


def date_span(start: Column, end: Column) -> tuple[Column, Column]:
    """Calendar span; the end never lies before the start, no start means no span."""
    return start, F.when(start.isNotNull(), F.greatest(start, F.coalesce(end, start)))
