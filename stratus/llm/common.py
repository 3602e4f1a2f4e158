"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.session import scratch_path

#: raw bytes of text given to one group of documents (see :func:`chunk_count`)
CHUNK_BYTES = 8 << 20


def ship_by_value(name: str) -> None:
    """Executors get the functions of module ``name`` with the task; they need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship_by_value(__name__)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: lineage ends there, and a
    lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: chunks and partitions that an operator asks for at most; beyond, chunks or partitions hold more
MOST_CHUNKS = 1 << 16


def chunk_count(df: DataFrame, column: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Number of groups of about ``chunk_bytes`` that the column's text makes (1 at least)."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-total // chunk_bytes))


#: rows of an Arrow batch; Spark's own default of 10,000 would be hundreds of MB of documents
BATCH_ROWS = 1000
_BATCH_CONF, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def bound_batches(df: DataFrame) -> DataFrame:
    """Keeps the session's Arrow batches at ``BATCH_ROWS`` rows, unless the user has set a size."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, _SPARK_DEFAULT) == _SPARK_DEFAULT:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))
    return df


#: rows that :func:`map_rows` turns into Python values together
SLICE_ROWS = 256


def map_rows(df: DataFrame, make: Callable[[], Callable[[list[list]], list]], schema: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` with plain column lists.  ``make()`` runs once per task and returns
    ``fn(columns) -> columns`` (lists or Arrow arrays), called for every ``slice_rows`` rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for start in range(0, batch.num_rows, slice_rows):
                columns = fn([c.to_pylist() for c in batch.slice(start, slice_rows).columns])
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, out, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return bound_batches(df).mapInArrow(run, schema)


def add_columns(df: DataFrame, column: str, make: Callable[[], Callable[[list], list]], schema: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with the columns of ``schema``, computed in tasks from the strings of ``column``.

    ``make()`` runs once per task and returns ``fn(strings) -> columns``.  Columns of ``df`` with
    the new names are replaced; all others pass through as they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    kept = [f for f in df.schema.fields if f.name not in added.names]
    full = StructType(kept + added.fields)
    out = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for start in range(0, whole.num_rows, slice_rows):
                batch = whole.slice(start, slice_rows)
                columns = fn(batch.column(batch.num_columns - 1).to_pylist())
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, out, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=full.names)

    rows = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").cast("string").alias("string of the map"))
    return bound_batches(rows).mapInArrow(run, full)
