"""Zone-free time arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
MICROS = {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}


def ntz(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp_ntz")


def micros(col: Column | str) -> Column:
    """Microseconds since 1970 as BIGINT."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ntz(col))


def from_micros(col: Column) -> Column:
    return F.expr(EPOCH) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), col.cast("decimal(24,0)").cast("decimal(20,0)") / F.lit(10**6).cast("decimal(7,0)"))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", ntz(a), ntz(b)) / F.lit(1e6)


def step_micros(freq: str) -> int:
    """`'1 hour'`, `'3 hours'`, `'day'` -> microseconds."""
    parts = freq.strip().lower().split()
    n, unit = (int(parts[0]), parts[1]) if len(parts) == 2 else (1, parts[0])
    return n * MICROS[unit.rstrip("s")]


def floor_time(col: Column | str, freq: str) -> Column:
    """Start of the bin that holds the time; `month` and `year` are calendar bins."""
    unit = freq.strip().lower().split()[-1].rstrip("s")
    t = ntz(col)
    if unit == "month":
        return F.make_date(F.year(t), F.month(t), F.lit(1)).cast("timestamp_ntz")
    if unit == "year":
        return F.make_date(F.year(t), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    m = micros(t)
    return from_micros(m - F.pmod(m, F.lit(step_micros(freq))))


def day_of_year(year: Column, month: Column, day: Column) -> Column:
    return F.dayofyear(F.make_date(year, month, day))


def month_day(year: Column, yday: Column) -> tuple[Column, Column]:
    d = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), yday.cast("int") - 1)
    return F.month(d), F.dayofmonth(d)


def yearday_to_time(year: Column, yday: Column) -> Column:
    """Year and fractional day (1.0 is the first of January, 00:00) -> time."""
    start = F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return from_micros(micros(start) + F.round((yday - 1) * F.lit(8.64e10)).cast("bigint"))


def decimal_day(day: Column, hour: Column, code: Column) -> Column:
    """Day, hour and a `mmssfff` code -> decimal day."""
    minute = F.substring(code, 1, 2).cast("double")
    second = F.substring(code, 3, 2).cast("double") + F.substring(code, 5, 3).cast("double") / 1000
    return day.cast("double") + (hour.cast("double") + (minute + second / 60) / 60) / 24
