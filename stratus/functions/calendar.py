"""Calendar expressions: timestamp assembly, season and day-period labels, cyclic terms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label texts and month/hour bands that must match the reference outputs.
SEASON_SUMMER = "verao"  # December, January, February (southern hemisphere)
SEASON_AUTUMN = "outono"  # March, April, May
SEASON_WINTER = "inverno"  # June, July, August
SEASON_SPRING = "primavera"  # every other month, and a missing month
PERIOD_MORNING = "manha"  # hours 6-11
PERIOD_AFTERNOON = "tarde"  # hours 12-17
PERIOD_EVENING = "noite"  # hours 18-23
PERIOD_NIGHT = "madrugada"  # every other hour, and a missing hour
DAYS_IN_MONTH_NON_LEAP = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
SCENARIO_DAY_OF_MONTH = 15


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), F.lit(SEASON_SUMMER))
        .when(month.isin(3, 4, 5), F.lit(SEASON_AUTUMN))
        .when(month.isin(6, 7, 8), F.lit(SEASON_WINTER))
        .otherwise(F.lit(SEASON_SPRING))
    )


def day_period(hour: Column) -> Column:
    return (
        F.when((hour >= 6) & (hour < 12), F.lit(PERIOD_MORNING))
        .when((hour >= 12) & (hour < 18), F.lit(PERIOD_AFTERNOON))
        .when((hour >= 18) & (hour < 24), F.lit(PERIOD_EVENING))
        .otherwise(F.lit(PERIOD_NIGHT))
    )


def weekend_flag(weekday_mon0: Column) -> Column:
    """1 on Saturday/Sunday (weekday 5/6 with Monday = 0); missing -> 0."""
    return F.coalesce((weekday_mon0 >= 5).cast("int"), F.lit(0))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of ``2π·value/period``."""
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def day_of_year_fixed(month: Column, day: Column | int = SCENARIO_DAY_OF_MONTH) -> Column:
    """Day of year from a non-leap month table (scenario inputs carry no year)."""
    cumulative = [sum(DAYS_IN_MONTH_NON_LEAP[:i]) for i in range(12)]
    day = F.lit(day) if isinstance(day, int) else day
    return F.element_at(F.array(*[F.lit(v) for v in cumulative]), month.cast("int")) + day


def week_of_year_fixed(day_of_year: Column) -> Column:
    """7-day buckets from 1 January (not ISO weeks)."""
    return F.floor((day_of_year - F.lit(1)) / F.lit(7)).cast("int") + F.lit(1)


def build_timestamp(date_text: Column, hour_text: Column | None = None, date_format: str = "yyyy/MM/dd") -> Column:
    """Station date text + hour text (``'0100'``, ``'100'``, ``'0100 UTC'``) -> timestamp_ntz.

    Hour text shorter than 4 characters is left-padded with zeros; the first four
    characters are read as ``HHmm``.  Anything unparsable becomes NULL.
    """
    if hour_text is None:
        return F.try_to_timestamp(F.trim(date_text), F.lit(date_format)).cast("timestamp_ntz")
    h = F.trim(hour_text.cast("string"))
    padded = F.when(F.length(h) < 4, F.lpad(h, 4, "0")).otherwise(h)
    hhmm = F.substring(padded, 1, 4)
    text = F.concat(F.trim(date_text), F.lit(" "), hhmm)
    return F.try_to_timestamp(text, F.lit(date_format + " HHmm")).cast("timestamp_ntz")
