"""Packed dates and times, weekday masks and schedule texts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mask bit order is Sunday = 1 to Saturday = 64.
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# Schedule codes and their texts.
RELATIVE_WEEKS = {1: "First", 2: "Second", 4: "Third", 8: "Fourth", 16: "Last"}
RELATIVE_DAYS = {number: day for number, day in enumerate(WEEKDAYS, start=1)} | {
    8: "Day",
    9: "Weekday",
    10: "Weekend",
}
SUBDAY_UNITS = {2: "seconds", 4: "minutes", 8: "hours"}


def decode_packed_datetime(day: Column, time: Column) -> Column:
    """yyyymmdd and HHMMSS integers as one timestamp; impossible values give NULL."""
    d, t = day.cast("int"), time.cast("int")
    return F.call_function(
        "try_make_timestamp_ntz",
        _div(d, 10000),
        _div(d, 100) % 100,
        d % 100,
        _div(t, 10000),
        _div(t, 100) % 100,
        (t % 100).cast("decimal(16,6)"),
    )


def format_packed_duration(duration: Column) -> Column:
    """HHMMSS integer as HH:MM:SS; the hours widen past 99."""
    d = duration.cast("bigint")
    hours = _div(d, 10000)
    wide = F.when(hours < 100, two_digits(hours)).otherwise(hours.cast("string"))
    minutes, seconds = _div(d, 100) % 100, d % 100
    return F.concat(wide, F.lit(":"), two_digits(minutes), F.lit(":"), two_digits(seconds))


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def padded_time(time: Column) -> Column:
    """A time integer as six digits; a longer one has no such text."""
    text = time.cast("string")
    return F.when(F.length(text) <= 6, F.lpad(text, 6, "0"))


def weekdays(mask: Column) -> Column:
    """The day names of a mask in bit order, NULL when it names no day."""
    names = F.array(*[F.when(mask.bitwiseAND(1 << bit) != 0, F.lit(day)) for bit, day in enumerate(WEEKDAYS)])
    text = F.array_join(names, ", ")
    return F.when(text != "", text)


def moment(value: datetime, like: DataFrame, name: str) -> Column:
    """A literal of the type of a timestamp column, free of the driver's time zone."""
    return F.lit(value.isoformat(sep=" ")).cast(like.schema[name].dataType)


def weekday_bit(day: date | datetime) -> int:
    """The mask bit of a date, Sunday = 1."""
    return 1 << (day.isoweekday() % 7)


def frequency_text(
    freq_type: Column, interval: Column, relative: Column, factor: Column
) -> Column:
    """How often a schedule runs.  A part without a text makes the whole NULL."""
    number = interval.cast("string")
    daily = F.when(interval == 1, "Daily").otherwise(F.concat(F.lit("Every "), number, F.lit(" days")))
    weekly = F.concat(weekdays(interval), _recurrence(factor, "weekly", "weeks"))
    monthly = F.concat(
        F.lit("On day "), number, F.lit(" of every "), factor.cast("string"), F.lit(" months")
    )
    relative_monthly = F.concat(
        lookup(relative, RELATIVE_WEEKS),
        F.lit(" "),
        lookup(interval, RELATIVE_DAYS),
        _recurrence(factor, "monthly", "months"),
    )
    return (
        F.when(freq_type == 1, F.lit("Once"))
        .when(freq_type == 4, daily)
        .when(freq_type == 8, weekly)
        .when(freq_type == 16, monthly)
        .when(freq_type == 32, relative_monthly)
        .when(freq_type == 64, F.lit("StartUp"))
        .when(freq_type == 128, F.lit("Idle"))
    )


def subday_text(subday_type: Column, interval: Column) -> Column:
    """How often a schedule repeats within a day, 'Once' when it does not."""
    text = F.concat(F.lit("Every "), interval.cast("string"), F.lit(" "), lookup(subday_type, SUBDAY_UNITS))
    return F.coalesce(text, F.lit("Once"))


def lookup(key: Column, texts: dict[int, str]) -> Column:
    """A code's text, NULL when it has none."""
    found = None
    for code, text in texts.items():
        found = F.when(key == code, text) if found is None else found.when(key == code, text)
    return found


def _recurrence(factor: Column, one: str, many: str) -> Column:
    return F.when(factor == 1, F.lit(f"; {one}")).when(
        factor != 0, F.concat(F.lit("; every "), factor.cast("string"), F.lit(f" {many}"))
    )


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by)).cast("int")
