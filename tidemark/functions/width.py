"""Widths of buckets: whole months, or a fixed length, never both."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

DAY = 86_400_000_000
_UNITS = {
    "microsecond": (0, 1), "millisecond": (0, 1_000), "second": (0, 1_000_000), "minute": (0, 60_000_000), "hour": (0, 3_600_000_000),
    "day": (0, DAY), "week": (0, 7 * DAY), "month": (1, 0), "quarter": (3, 0), "year": (12, 0), "decade": (120, 0), "century": (1200, 0),
}
_SHORT = {"us": "microsecond", "ms": "millisecond", "s": "second", "sec": "second", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "w": "week", "mon": "month", "y": "year", "centurie": "century"}
_PART = re.compile(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)\s*,?")


@dataclass(frozen=True)
class Width:
    months: int = 0
    micros: int = 0

    @property
    def calendar(self) -> bool:
        """Whole days or months: such buckets follow the local calendar."""
        return self.months > 0 or self.micros % DAY == 0

    @staticmethod
    def parse(value: str | dt.timedelta | Width, *, positive: bool = True, months: bool = True) -> Width:
        """A width from ``"15 minutes"``, ``"1 year 2 months"``, a timedelta or a Width."""
        if isinstance(value, Width):
            out = value
        elif isinstance(value, dt.timedelta):
            out = Width(0, (value.days * 86_400 + value.seconds) * 1_000_000 + value.microseconds)
        elif isinstance(value, str):
            out = _parse(value)
        else:
            raise ValueError(f"a width is text, a timedelta or a Width, not {type(value).__name__}")
        if out.months and out.micros:
            raise ValueError(f"{value!r} mixes months with days or time; their lengths cannot be added")
        if out.months and not months:
            raise ValueError(f"{value!r} has months, whose length varies; use days or less")
        if positive and out.months + out.micros <= 0:
            raise ValueError(f"{value!r} is not longer than zero")
        if out.micros < 0:
            raise ValueError(f"{value!r} is negative")
        return out


def _parse(text: str) -> Width:
    clock = re.fullmatch(r"\s*(\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?\s*", text)
    if clock:
        return Width(0, int(clock[1]) * 3_600_000_000 + int(clock[2]) * 60_000_000 + round(float(clock[3] or 0) * 1_000_000))
    if re.fullmatch(r"\s*0\s*", text):
        return Width()
    months = micros = 0.0
    at = 0
    while at < len(text) and (m := _PART.match(text, at)):
        unit = m[2].lower()
        unit = unit if unit in _UNITS or unit in _SHORT else unit.removesuffix("s")
        unit = _SHORT.get(unit, unit)
        if unit not in _UNITS:
            raise ValueError(f"unknown unit {m[2]!r} in {text!r}")
        months += float(m[1]) * _UNITS[unit][0]
        micros += float(m[1]) * _UNITS[unit][1]
        at = m.end()
    if text[at:].strip() or not at:
        raise ValueError(f"{text!r} is no width")
    if months != int(months):
        raise ValueError(f"{text!r} has a part of a month")
    return Width(int(months), round(micros))
