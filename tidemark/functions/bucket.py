"""Time buckets as Catalyst expressions: no Python at run time, no dependence on the session's time zone.

Columns are timestamps (``kind="ltz"``), timestamps without zone (``"ntz"``),
dates (``"date"``) or whole numbers (``"long"``, ``"int"``); ``with_bucket``
finds the kind from the schema. Null gives null.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.width import DAY, Width

#: Where the grids begin. A Monday for days and time, the first of a year for months.
ORIGIN = dt.datetime(2000, 1, 3)
MONTH_ORIGIN = dt.datetime(2000, 1, 1)
EPOCH = dt.datetime(1970, 1, 1)
KINDS = {"timestamp": "ltz", "timestamp_ntz": "ntz", "date": "date", "bigint": "long", "int": "int", "smallint": "int"}


def ntz(value: dt.datetime | dt.date) -> Column:
    return F.lit(value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()).cast("timestamp_ntz")


def micros(value: dt.datetime | dt.date) -> int:
    """Microseconds since 1970, of a time with a zone or else of one in UTC."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return (value - EPOCH) // dt.timedelta(microseconds=1)


def _diff(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def _add(ts: Column, n: Column) -> Column:
    return F.timestamp_add("MICROSECOND", n, ts)


def to_utc(ts: Column) -> Column:
    """A timestamp's clock in UTC, without zone."""
    return _add(ntz(EPOCH), F.unix_micros(ts))


def from_utc(ts: Column) -> Column:
    return F.timestamp_micros(_diff(ntz(EPOCH), ts))


def time_key(ts: Column, kind: str) -> Column:
    """The column as a whole number that orders and measures: microseconds since 1970, days as microseconds, or itself."""
    if kind == "ltz":
        return F.unix_micros(ts)
    if kind in ("ntz", "date"):
        return _diff(ntz(EPOCH), ts.cast("timestamp_ntz"))
    return ts.cast("long")


def _fixed(ts: Column, width: int, origin: Column) -> Column:
    return _add(ts, -F.pmod(_diff(origin, ts), F.lit(width)))


def _months(ts: Column, width: int, origin: dt.datetime) -> Column:
    passed = F.year(ts) * 12 + F.month(ts) - (origin.year * 12 + origin.month)
    k = (F.floor(passed / F.lit(width)) * width).cast("int")
    start = lambda n: ntz(origin) + F.make_ym_interval(F.lit(0), n)
    return F.when(start(k) > ts, start(k - width)).otherwise(start(k))


def _ntz_bucket(ts: Column, width: Width, origin: dt.datetime | None) -> Column:
    if width.months:
        return _months(ts, width.months, origin or MONTH_ORIGIN)
    return _fixed(ts, width.micros, ntz(origin or ORIGIN))


def _zone_bucket(utc: Column, width: Width, zone: str, origin: dt.datetime | None) -> Column:
    """utc and the result: clocks in UTC."""
    local = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
    if width.calendar:
        here = local(utc)
        start = _ntz_bucket(here, width, origin)
        back = F.convert_timezone(F.lit(zone), F.lit("UTC"), start)
        # The clock was set back after the start: measure along the clock instead.
        return F.when(back > utc, _add(utc, -_diff(start, here))).otherwise(back)
    offset = lambda t: _diff(t, local(t))
    found = []
    for o in (offset(utc), offset(_add(utc, F.lit(-width.micros)))):
        grid = _add(_fixed(_add(utc, o), width.micros, ntz(origin or ORIGIN)), -o)
        for k in range(3):
            c = _add(grid, F.lit(-k * width.micros))
            found.append(F.when((c <= utc) & (offset(c) == o), c))
    return F.greatest(*found)


def bucket(column: Column | str, width: str | dt.timedelta | Width | int, *, origin=None, zone: str | None = None, kind: str = "ntz") -> Column:
    """The start of the bucket that holds the column's value.

    origin: where the grid begins (a number for whole numbers; with a zone, a local time). zone: buckets follow the
    clock of this time zone, daylight saving included; only for ``ltz``.
    """
    c = F.col(column) if isinstance(column, str) else column
    if kind in ("long", "int"):
        if isinstance(width, bool) or not isinstance(width, int) or width <= 0:
            raise ValueError("whole numbers have a whole width over zero")
        if zone:
            raise ValueError("whole numbers have no time zone")
        return (c - F.pmod(c - F.lit(origin or 0), F.lit(width))).cast("bigint" if kind == "long" else "int")
    if isinstance(width, int):
        raise ValueError("times have a width like '15 minutes'")
    w = Width.parse(width)
    if zone and kind != "ltz":
        raise ValueError("only timestamps with a zone are bucketed by a time zone's clock")
    if kind == "date":
        if not w.calendar:
            raise ValueError("dates have buckets of whole days or months")
        begin = origin if origin is None or isinstance(origin, dt.datetime) else dt.datetime(origin.year, origin.month, origin.day)
        if w.months:
            return _months(c.cast("timestamp_ntz"), w.months, begin or MONTH_ORIGIN).cast("date")
        return F.date_sub(c, F.pmod(F.datediff(c, F.lit((begin or ORIGIN).date())), F.lit(w.micros // DAY)).cast("int"))
    if kind == "ntz":
        return _ntz_bucket(c, w, origin)
    if kind != "ltz":
        raise ValueError(f"unknown kind {kind!r}")
    if zone:
        return from_utc(_zone_bucket(to_utc(c), w, zone, origin))
    if w.months:
        return from_utc(_months(to_utc(c), w.months, origin.astimezone(dt.timezone.utc).replace(tzinfo=None) if origin and origin.tzinfo else origin or MONTH_ORIGIN))
    m = F.unix_micros(c)
    return F.timestamp_micros(m - F.pmod(m - F.lit(micros(origin or ORIGIN)), F.lit(w.micros)))


def kind_of(df: DataFrame, column: str) -> str:
    found = dict(df.dtypes)[column]
    if found not in KINDS:
        raise ValueError(f"{column} is {found}; buckets are of timestamps, dates and whole numbers")
    return KINDS[found]


def with_bucket(df: DataFrame, column: str, width, name: str = "bucket", *, origin=None, zone: str | None = None) -> DataFrame:
    """df with a column of buckets; the kind comes from the schema."""
    return df.withColumn(name, bucket(column, width, origin=origin, zone=zone, kind=kind_of(df, column)))
