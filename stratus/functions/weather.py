"""Derived weather measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def discomfort_index(temp: Column, humidity: Column) -> Column:
    """Thom's simplified discomfort index: T - 0.55 (1 - 0.01 RH) (T - 14.5)."""
    return temp - F.lit(0.55) * (F.lit(1.0) - F.lit(0.01) * humidity) * (temp - F.lit(14.5))


def radiation_scaled(radiation: Column) -> Column:
    """kJ/m² -> MJ/m²."""
    return radiation / F.lit(1000.0)
