"""Wall-clock parts of a request and the hour-of-week slot clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole_seconds_between(start: str, end: str) -> Column:
    """Whole seconds from `start` to `end`, truncated toward zero, free of the session time zone."""
    span = F.expr(f"`{end}` - `{start}`")
    return (
        F.extract(F.lit("DAY"), span).cast("bigint") * 86400
        + F.extract(F.lit("HOUR"), span).cast("bigint") * 3600
        + F.extract(F.lit("MINUTE"), span).cast("bigint") * 60
        + F.extract(F.lit("SECOND"), span).cast("bigint")
    )


def weekday(ts: Column) -> Column:
    """Sunday = 0 ... Saturday = 6."""
    return (F.dayofweek(ts) - 1).cast("int")


def weekday_from_day_of_month(ts: Column) -> Column:
    """Formula that equals `weekday` only in a month that begins on a Thursday."""
    return ((F.dayofmonth(ts) + 3) % 7).cast("int")


def slot_clock(step, start_day: int = 0, start_hour: int = 0, ahead: int = 0) -> tuple[Column, Column]:
    """(day, hour) of simulation step `step`, `ahead` hours later; the week wraps."""
    step = step if isinstance(step, Column) else F.col(step)
    hours = step + F.lit(start_hour + ahead)
    day = ((F.lit(start_day) + F.floor(hours / 24)) % 7).cast("int")
    return day, (hours % 24).cast("int")


def next_slot(day: str = "day", hour: str = "hour") -> tuple[Column, Column]:
    """The (day, hour) one hour after the given slot."""
    d, h = F.col(day), F.col(hour)
    return F.when(h == 23, (d + 1) % 7).otherwise(d).cast("int"), ((h + 1) % 24).cast("int")
