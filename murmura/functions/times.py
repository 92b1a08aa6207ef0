"""Time features: rounding, cycles, sunrise and sunset."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The site, and the zenith of sunrise and sunset.
LATITUDE, LONGITUDE, ZENITH = 37.408, -122.2275, 90.789
#: The site's clock is so many hours behind UTC all year.
UTC_HOURS = 7
#: Length of each cycle.
CYCLES = {"second": 60, "minute": 60, "hour": 24, "day": 30, "month": 12, "year": 10}


def round_time(t: Column, seconds: int = 60) -> Column:
    """The nearest multiple of ``seconds`` (which divides a day), half up; fractions of a second are dropped first."""
    unix = F.unix_timestamp(t)
    return F.timestamp_seconds(F.floor((unix + seconds / 2) / seconds) * seconds)


def tick(t: Column, unit: str) -> Column:
    part = getattr(F, {"day": "dayofmonth"}.get(unit, unit))(t)
    return part % 10 if unit == "year" else part


def cycle(t: Column, unit: str) -> tuple[Column, Column]:
    """(sin, cos) of the time's place in the unit's cycle; a day is one of 30, so the 31st is the 1st again."""
    if unit not in CYCLES:
        raise ValueError(f"no cycle of {unit}")
    angle = tick(t, unit) * F.lit(2 * math.pi / CYCLES[unit])
    return F.sin(angle), F.cos(angle)


def cycle_columns(t: Column, units: dict[str, str] | None = None) -> dict[str, Column]:
    """sin_ and cos_ columns; by default of hour, day, month and year."""
    out = {}
    for suffix, unit in (units or {"hr": "hour", "day": "day", "month": "month", "year": "year"}).items():
        out[f"sin_{suffix}"], out[f"cos_{suffix}"] = cycle(t, unit)
    return out


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _n(x: float) -> str:
    return f"({float(x)!r}D)"


def _sun(day: str, rising: bool, rounds: int = 3) -> str:
    """SQL for the Unix seconds of sunrise or sunset of a local date, by the published low-precision solar equations: one
    text, as so many operators one by one cost seconds of calls to the JVM.

    Solar noon and the hour angle are computed for the event's own instant, in ``rounds`` rounds."""
    rad, deg = _n(math.radians(1)), _n(180 / math.pi)
    midnight = f"(datediff({day}, date'1970-01-01') * 86400D)"
    mean_long = f"(pmod(280.46646D + c * (36000.76983D + c * 0.0003032D), 360D) * {rad})"
    anomaly = f"((357.52911D + c * (35999.05029D - c * 0.0001537D)) * {rad})"
    node = f"((125.04D - c * 1934.136D) * {rad})"
    tilt = f"((23D + (26D + (21.448D - c * (46.815D + c * (0.00059D - c * 0.001813D))) / 60D) / 60D + cos(o) * 0.00256D) * {rad})"
    centre = f"((sin(m) * (1.914602D - c * (0.004817D + c * 0.000014D)) + sin(2 * m) * (0.019993D - c * 0.000101D) + sin(3 * m) * 0.000289D) * {rad})"
    declination = f"asin(sin(t) * sin(l + {centre} - {_n(math.radians(0.00569))} - sin(o) * {_n(math.radians(0.00478))}))"
    equation = f"(4 * {deg} * (y * sin(2 * l) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * l) - 0.5D * y * y * sin(4 * l) - 1.25D * e * e * sin(2 * m)))"
    latitude = math.radians(LATITUDE)
    angle = f"(acos({_n(math.cos(math.radians(ZENITH)))} / ({_n(math.cos(latitude))} * cos(d)) - {_n(math.tan(latitude))} * tan(d)) * {deg})"
    minutes = f"(720 - 4 * ({_n(LONGITUDE)} {'+' if rising else '-'} {angle}) - {equation})"
    steps = [("c", "(at / 86400D + 2440587.5D - 2451545D) / 36525D"), ("l", mean_long), ("m", anomaly), ("o", node), ("t", tilt), ("y", "tan(t / 2) * tan(t / 2)"), ("e", "0.016708634D - c * (0.000042037D + c * 0.0000001267D)"), ("d", declination)]
    event = f"(midnight + {minutes} * 60)"
    for name, value in reversed(steps):
        event = _let(name, value, event)
    at = f"(midnight + {(UTC_HOURS + (6 if rising else 18)) * 3600}D)"
    for _ in range(rounds):
        at = _let("at", at, event)
    return _let("midnight", midnight, at)


def sunrise_sunset(day: str, round_to: int = 60) -> tuple[Column, Column]:
    """Local times (no zone) of sunrise and sunset of the local dates in column ``day``, rounded half up to ``round_to``
    seconds."""
    shown = lambda unix: F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(floor((floor({unix}) - {UTC_HOURS * 3600} + {round_to / 2}D) / {round_to}) * {round_to} as decimal(18,6)))")
    return shown(_sun(f"`{day}`", True)), shown(_sun(f"`{day}`", False))


def hour_minute(t: Column) -> Column:
    return F.date_format(t, "HH:mm")


def week_start(day: Column, first: Column) -> Column:
    """The start of the day's 7-day bin, counted from the first day."""
    return F.date_add(first, (F.floor(F.datediff(day, first) / 7) * 7).cast("int"))
