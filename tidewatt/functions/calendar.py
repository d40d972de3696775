"""Calendar and cyclic features of a timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature name -> expression of a timestamp; Monday is 0.
CALENDAR = {
    "hour": lambda t: F.hour(t),
    "day": lambda t: F.dayofmonth(t),
    "month": lambda t: F.month(t),
    "year": lambda t: F.year(t),
    "weekday": lambda t: F.weekday(t),
    "day_of_year": lambda t: F.dayofyear(t),
    "minute_of_day": lambda t: F.hour(t) * 60 + F.minute(t),
    "weekend": lambda t: (F.weekday(t) >= 5).cast("int"),
}
#: Other spellings that grouping accepts.
ALIASES = {"dayofyear": "day_of_year", "dayofweek": "weekday", "day_of_week": "weekday"}
#: Periods of the cyclic calendar features.
PERIODS = {"hour": 24, "month": 12, "weekday": 7, "day_of_year": 365.25, "minute_of_day": 1440}


def calendar_value(ts: str | Column, name: str) -> Column:
    """One calendar feature as an integer."""
    key = ALIASES.get(name.lower(), name.lower())
    if key not in CALENDAR:
        raise ValueError(f"unknown calendar feature {name!r}; known: {sorted(CALENDAR)}")
    return CALENDAR[key](F.col(ts) if isinstance(ts, str) else ts).cast("int")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value's place in its period."""
    angle = value.cast("double") * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def wind_sector(direction: Column, sectors: int = 16) -> Column:
    """Sector of a direction in degrees; sector 0 is centred on north."""
    width = 360.0 / sectors
    return F.pmod(F.floor((direction + width / 2) / width), F.lit(sectors)).cast("int")
