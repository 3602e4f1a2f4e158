"""Join helper: lookup tables by null-safe equality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_lookup(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Add the columns of ``lookup`` to ``rows``; a NULL key meets a NULL key.

    The join carries no hint: Spark broadcasts the lookup if its size in bytes allows it and
    otherwise shuffles both sides, splitting frequent keys.
    """
    renamed = lookup.withColumnsRenamed({c: f"__on_{c}" for c in on})
    match = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(renamed[f"__on_{c}"]) for c in on])
    return rows.join(renamed, match, how).drop(*[f"__on_{c}" for c in on])
