"""Dates, times and their differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute of a timestamp to its expression. Spark keeps microseconds, so that nanosecond is zero.
FIELDS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "quarter": F.quarter, "dayofyear": F.dayofyear, "week": F.weekofyear,
    "second": lambda c: F.date_part(F.lit("second"), c).cast("int"), "dayofweek": F.weekday, "date": F.to_date,
    "microsecond": lambda c: F.pmod(F.date_part(F.lit("second"), c) * 1000000, F.lit(1000000)).cast("int"), "nanosecond": lambda c: F.lit(0),
}


def field(c: Column, name: str) -> Column:
    return FIELDS[name](c)


def timestamp(c: Column, fmt: str | None = None) -> Column:
    """Parsed from ISO text, or in ``fmt``; NULL if it can't be parsed."""
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz") if fmt else c.try_cast("timestamp_ntz")


def make_date(y: Column, m: Column, d: Column) -> Column:
    return F.make_date(y, m, d)


def make_datetime(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return F.make_timestamp_ntz(y, m, d, h, mi, s)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, independent of the session's zone."""
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    in_day = F.hour(c) * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + (F.date_part(F.lit("second"), c) * 1_000_000).cast("long")
    return days * 86_400_000_000 + in_day


def difference(a: Column, b: Column) -> Column:
    """a - b in microseconds."""
    return micros(a) - micros(b)


def parts(delta: Column) -> dict[str, Column]:
    """Days, seconds, microseconds and nanoseconds of a difference in microseconds; days floor, the rest is not negative."""
    day, second = 86_400_000_000, 1_000_000
    return {"days": F.floor(delta / day), "seconds": F.floor(F.pmod(delta, F.lit(day)) / second), "microseconds": F.pmod(delta, F.lit(second)), "nanoseconds": F.lit(0)}
