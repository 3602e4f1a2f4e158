"""Category encoders and class weights.

An encoder is a table ``(column, value, code)``: codes are the ranks of the sorted
distinct string values (``NULL`` is encoded as the text ``'nan'``), as a sorted label
encoder does.  All columns are read in one pass; distinct values come from a map-side
combined ``distinct`` and are ranked in ranges of about equal size.  Applying an encoder is
one left join per column, without hints and without jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.operators.joins import join_lookup
from stratus.operators.ranges import RANGE, range_buckets
from stratus.operators.series import sequence
from stratus.session import shared_table

# Fixed value: text a missing category is encoded as (string form of a float NaN).
MISSING_CATEGORY = "nan"


def category_text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY))


def label_encode_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Encoder table ``column, value, code`` (code = 0-based rank of the sorted values).

    The distinct values are written to the shared folder while the plan is built.
    """
    cells = [F.struct(F.lit(c).alias("column"), category_text(c).alias("value")) for c in columns]
    distinct = df.select(F.inline(F.array(*cells))).distinct()
    ranked = sequence(range_buckets(distinct, "column", "value"), ["column"], ["value"], bucket=F.col(RANGE).cast("long"), out="__pos")
    return ranked.select("column", "value", (F.col("__pos") - 1).alias("code"))


def label_encode_apply(df: DataFrame, encoder: DataFrame, columns: Sequence[str] | None = None, unknown: int | str = -1) -> DataFrame:
    """Replace each encoded column by its code; values unseen at fit time -> ``unknown``.

    With ``unknown="raise"`` the query that meets such a value fails and names the column and the value,
    in the same pass.  Without ``columns`` the encoder's are read (one row each).
    """
    if isinstance(unknown, str) and unknown != "raise":
        raise ValueError("unknown is a code or 'raise'")
    columns = list(columns) if columns is not None else [r[0] for r in encoder.select("column").distinct().collect()]
    out = df
    for i, c in enumerate(columns):
        lookup = encoder.where(F.col("column") == c).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
        out = join_lookup(out.withColumn(f"__v{i}", category_text(c)), lookup, [f"__v{i}"])
        refuse = F.raise_error(F.concat(F.lit(f"unknown value in column {c}: "), F.col(f"__v{i}"))).cast("long")
        other = refuse if unknown == "raise" else F.lit(unknown).cast("long")
        out = out.withColumn(c, F.when(F.col(f"__c{i}").isNull(), other).otherwise(F.col(f"__c{i}").cast("long"))).drop(f"__v{i}", f"__c{i}")
    return out.select(*df.columns)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (k · n_c)`` per class: label, n, weight."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("n"))
    w = Window.partitionBy()
    # the counts table has one row per class, so an unpartitioned window over it is tiny
    return counts.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Rows with their class's balanced weight; a NULL label is a class of its own.

    The weights are written when this is called and broadcast whatever the session's size limit for that: a
    join by class would bring the rows of a class into one task, and there are few classes.
    """
    weights = shared_table(class_weights(df, label).select(label, F.col("weight").alias(out)), "class-weights")
    return join_lookup(df, F.broadcast(weights), [label])
