"""Processed-table readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratus.sources.station_csv import FILE_PATTERN, StationRead, read_station_files

# microsecond timestamps survive a CSV round trip (the default keeps milliseconds)
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def scan_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    sep: str = ",",
    header: bool = True,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Processed / uploaded CSV with a header.  Pass ``schema`` for production reads;
    without it types are inferred (an extra pass over the data, for ad-hoc use)."""
    r = spark.read.option("header", str(header).lower()).option("sep", sep).option("encoding", encoding)
    r = r.option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT + "XXX")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", "true")
    return r.csv(path if isinstance(path, str) else list(path))


def read_glob_union(
    spark: SparkSession,
    paths: str | Sequence[str],
    path_glob: str | None = FILE_PATTERN,
    recursive: bool = True,
    on_bad_file: str = "skip",
    **options,
) -> StationRead:
    """All station files below the given folders or patterns, stacked by column name in one scan, with the
    quarantine of what could not be read.

    ``path_glob`` matches file names in any case; paths are de-duplicated and sorted.  Columns that
    a file lacks are NULL.  Files that cannot be read, or have no header, and lines that do not fit their
    header are in ``.quarantine``; it is an error if no file is left.
    """
    paths = sorted({paths} if isinstance(paths, str) else set(paths))
    if not paths:
        raise ValueError("no input files")
    return read_station_files(spark, paths, path_glob=path_glob, recursive=recursive, on_bad_file=on_bad_file, **options)


def scan_glob_union(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """The rows of :func:`read_glob_union`, which takes the same options."""
    return read_glob_union(spark, paths, **options).rows


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> str:
    """UTF-8 CSV with a header (one folder of part files)."""
    (
        df.write.mode(mode)
        .option("header", "true")
        .option("sep", sep)
        .option("encoding", "UTF-8")
        .option("timestampNTZFormat", TS_FORMAT)
        .option("timestampFormat", TS_FORMAT + "XXX")
        .csv(path)
    )
    return path


def sink_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Parquet, optionally partitioned (e.g. by year / station) for pruning on read."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Small report tables (summaries, metrics) as JSON lines."""
    df.write.mode(mode).json(path)
    return path
