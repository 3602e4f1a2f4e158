"""Numeric column expressions: lenient parsing, non-finite cleanup, labels, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: str | Column) -> Column:
    """NaN, +inf and -inf become SQL NULL (pandas treats all three as missing)."""
    c = _col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def parse_number(c: str | Column) -> Column:
    """Lenient text -> double: decimal comma to point, trim, unparsable -> NULL.

    ``try_cast`` keeps ANSI mode from raising on junk such as ``'n/d'`` or ``'0000 UTC'``;
    the result is passed through :func:`finite_or_null` so ``'nan'``/``'inf'`` are missing too.
    """
    text = F.trim(F.regexp_replace(_col(c).cast("string"), ",", "."))
    return finite_or_null(text.try_cast("double"))


def rain_flag(c: str | Column, threshold: float = 0.0) -> Column:
    """1 when the amount is above ``threshold``; a missing amount counts as 0 (dry)."""
    return F.coalesce((_col(c) > F.lit(threshold)).cast("int"), F.lit(0))


def clamp_non_negative(c: str | Column) -> Column:
    return F.greatest(_col(c), F.lit(0.0))


def round_half_even(c: str | Column, digits: int = 2) -> Column:
    """Python's ``round`` (banker's rounding) for report figures."""
    return F.bround(_col(c), digits)
