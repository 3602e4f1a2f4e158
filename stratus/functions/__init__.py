"""Column-expression builders (pure ``Column -> Column``; no DataFrame access)."""

from stratus.functions.calendar import (
    build_timestamp,
    cyclic,
    day_of_year_fixed,
    day_period,
    season,
    week_of_year_fixed,
    weekend_flag,
)
from stratus.functions.numeric import clamp_non_negative, finite_or_null, parse_number, rain_flag, round_half_even
from stratus.functions.weather import discomfort_index, radiation_scaled

__all__ = [
    "build_timestamp",
    "clamp_non_negative",
    "cyclic",
    "day_of_year_fixed",
    "day_period",
    "discomfort_index",
    "finite_or_null",
    "parse_number",
    "radiation_scaled",
    "rain_flag",
    "round_half_even",
    "season",
    "week_of_year_fixed",
    "weekend_flag",
]
