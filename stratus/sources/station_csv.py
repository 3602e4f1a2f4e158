"""Station files: Latin-1, ``;``-separated, a metadata preamble, then a header line.

All files are read as lines in one scan, whatever their number, and split without a limit of
fields.  The header of a file is its first line that holds both ``Data`` and ``Hora``; every line
after it is a row.

A line's address is the start of its file block and a number that grows within the block.  Which
numbers a scan gives depends on how Spark cuts files into tasks, which may change from one scan to
the next.  So the lines are written once, with their addresses, to the shared folder, and headers,
rows and quarantine all come from that table.  Large files stay splittable.

Files may order their columns differently: the table of headers (one row per file) gives each named
column's position, and the rows of all files are picked by name in one projection.  What cannot be a
row goes to the quarantine table with its file, address, text and reason.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratus.session import shared_table

# How station files mark their header, and the station code in their names.
HEADER_MARKERS = ("Data", "Hora")
ENCODING = "ISO-8859-1"
FILE_PATTERN = "*inmet*.csv"
STATION_PATTERN = r"_([A-Za-z]\d{3})_[^/]*$"


def any_case(pattern: str) -> str:
    """A file-name pattern that matches letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)


class StationRead(NamedTuple):
    """What station files hold.

    ``rows``: the observations, all strings.  ``files``: ``(file, n_lines, header_at, names)`` per file that has
    lines; NULL ``header_at`` and ``names`` where no line is a header.  ``quarantine``: ``(file, address, text, reason)``
    of every line of a file without header, every line with values beyond the header's fields, and one row
    without address and text per unreadable file.  ``lines``: ``(file, at, line)`` of all lines read that are not blank.
    """

    rows: DataFrame
    files: DataFrame
    quarantine: DataFrame
    lines: DataFrame


def _options(reader, path_glob: str | None, recursive: bool):
    if path_glob:
        reader = reader.option("pathGlobFilter", any_case(path_glob))
    return reader.option("recursiveFileLookup", "true") if recursive else reader


def _lines(spark: SparkSession, paths: Sequence[str], encoding: str, path_glob: str | None, recursive: bool) -> DataFrame:
    """``(file, at, line)`` of every line that is not blank; ``at`` grows along a file within one scan."""
    # one field per line: a separator and quotes that no text file holds
    reader = spark.read.schema("line string").option("sep", "\x01").option("quote", "\x00").option("escape", "\x00")
    reader = reader.option("encoding", encoding).option("header", "false").option("mode", "PERMISSIVE").option("ignoreCorruptFiles", "false")
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = _options(reader, path_glob, recursive).csv(list(paths))
    return lines.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.regexp_replace("line", "\r$", "").alias("line"))


def _broken_gzip(files: DataFrame) -> DataFrame:
    """``(path, content)`` -> ``(path, reason)`` of the files whose members cannot be read to their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            broken = []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rest, reason = memoryview(content.as_buffer()), None
                while len(rest) and reason is None:
                    member, at = zlib.decompressobj(31), 0
                    try:
                        while at < len(rest) and not member.eof:
                            member.decompress(rest[at : at + (1 << 16)])  # what comes out is not kept
                            at += 1 << 16
                        reason = None if member.eof else "truncated gzip"
                    except zlib.error as e:
                        reason = f"broken gzip: {e}"
                    rest = rest[min(at, len(rest)) - len(member.unused_data) :]
                if reason:
                    broken.append((path.as_py(), reason))
            yield pa.RecordBatch.from_arrays([pa.array([b[i] for b in broken], pa.string()) for i in (0, 1)], names=["path", "reason"])

    return files.select("path", "content").mapInArrow(run, "path string, reason string")


def _line_table(spark: SparkSession, paths: Sequence[str], encoding: str, path_glob: str | None, recursive: bool, skip: bool) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The written table of lines, and ``(file, reason)`` of the files that cannot be read (an error unless ``skip``).

    Compressed files are tried in one job beforehand; another file that fails the scan is left out of the next attempt."""
    unreadable: dict[str, str] = {}
    if skip:
        # a condition on the file's metadata, so that other files are not read; what fails here fails in the scan
        names = _options(spark.read.format("binaryFile").option("ignoreCorruptFiles", "true"), path_glob, recursive).load(list(paths))
        broken = {_bare(r.path): r.reason for r in _broken_gzip(names.where(F.lower("_metadata.file_path").endswith(".gz"))).collect()}  # a row per broken file
        if broken:
            unreadable = {f: broken[_bare(f)] for f in _lines(spark, paths, encoding, path_glob, recursive).inputFiles() if _bare(f) in broken}
    while True:
        lines = _lines(spark, paths, encoding, path_glob, recursive)
        if unreadable:
            good = [f for f in lines.inputFiles() if f not in unreadable]
            if not good:
                raise ValueError(f"no file can be read: {', '.join(sorted(unreadable)[:5])}")
            lines = _lines(spark, good, encoding, None, False)
        try:
            return shared_table(lines, "station-lines"), sorted(unreadable.items())
        except (PySparkException, Py4JJavaError) as e:
            found = re.search(r"\[FAILED_READ_FILE[^\]]*\] Encountered error while reading file (\S+?)\.?\s", str(e))
            if not skip or not found or found[1] in unreadable:
                raise
            unreadable[found[1]] = "unreadable"


def _bare(path: str) -> str:
    """A path without its scheme's slashes, which differ between readers."""
    return re.sub("^([a-z0-9]+):/+", r"\1:", path)


def _names(fields: Column) -> Column:
    """Header texts: trimmed, a repeated name numbered, an unnamed one ``Unnamed: i``, and the one
    after a trailing separator left out (NULL)."""
    trimmed = F.transform(fields, lambda x: F.trim(x))

    def name(x: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(trimmed, F.lit(1), i), lambda y: y == x))
        unnamed = F.when(i < F.size(trimmed) - 1, F.concat(F.lit("Unnamed: "), i.cast("string")))
        return F.when(x == "", unnamed).when(before > 0, F.concat(x, F.lit("."), before.cast("string"))).otherwise(x)

    return F.transform(trimmed, name)


def read_station_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = ";",
    encoding: str = ENCODING,
    path_glob: str | None = None,
    recursive: bool = False,
    file_column: str | None = "source_file",
    station_column: str | None = None,
    station_pattern: str = STATION_PATTERN,
    on_bad_file: str = "raise",
) -> StationRead:
    """Read station files (see :class:`StationRead`); every measure stays a string until ``to_numeric``.

    Every line after a file's header is a row, as it stands; a line with fewer fields has NULLs.
    ``path_glob`` matches file names in any case.  ``station_column`` takes the station from the
    file name by ``station_pattern`` (else the file), so that several files make one series.

    A file without a header raises ``ValueError`` that names it, an unreadable file fails the scan, and a line with
    values beyond the header's fields fails the query that reads it; ``on_bad_file="skip"`` puts all these into the
    quarantine instead.  It is an error if no file has a header.  The lines and the quarantine are written
    to the shared folder when this is called.
    """
    if on_bad_file not in ("raise", "skip"):
        raise ValueError("on_bad_file is 'raise' or 'skip'")
    paths = [paths] if isinstance(paths, str) else list(paths)
    skip = on_bad_file == "skip"
    lines, unreadable = _line_table(spark, paths, encoding, path_glob, recursive, skip)
    is_header = F.col("line").contains(HEADER_MARKERS[0]) & F.col("line").contains(HEADER_MARKERS[1])
    first = F.min(F.when(is_header, F.struct("at", "line"))).alias("first")
    found = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), first)
    names_of = F.when(F.col("first").isNotNull(), _names(F.split("first.line", re.escape(sep))))
    files = shared_table(found.select("file", "n_lines", F.col("first.at").alias("header_at"), names_of.alias("names")), "station-files")
    bad = [r[0] for r in files.where("header_at is null").select("file").orderBy("file").limit(5).collect()]
    if bad and not skip:
        raise ValueError(f"no header line containing 'Data' and 'Hora' in {', '.join(bad)}")
    headers = files.where("header_at is not null")
    # the vocabulary of headers, in the order of their earliest position
    vocabulary = headers.select(F.posexplode("names").alias("pos", "name")).where("name is not null").groupBy("name").agg(F.min("pos").alias("pos")).collect()
    names = [r["name"] for r in sorted(vocabulary, key=lambda r: (r["pos"], r["name"]))]
    if not names:
        raise ValueError("no header line containing 'Data' and 'Hora' found")
    at = F.array(*[F.array_position("names", n) for n in names])  # 0: not in this file
    placed = files.select(F.col("file").alias("__file"), "header_at", F.size(F.filter("names", lambda x: x.isNotNull())).alias("__width"), at.alias("__at"))
    joined = lines.join(placed, F.col("file") == F.col("__file")).withColumn("__fields", F.split("line", re.escape(sep)))
    extra = F.exists(F.expr("slice(__fields, __width + 1, size(__fields))"), lambda x: F.trim(x) != "")
    after = joined.where(F.col("at") > F.col("header_at"))
    if skip:
        rows = after.where(~extra)
        reason = F.when(F.col("header_at").isNull(), "no header").otherwise("extra fields")
        held = joined.where(F.col("header_at").isNull() | ((F.col("at") > F.col("header_at")) & extra))
        held = held.select("file", F.col("at").alias("address"), F.col("line").alias("text"), reason.alias("reason"))
        whole = spark.createDataFrame(unreadable, "file string, reason string").select("file", F.lit(None).cast(held.schema["address"].dataType).alias("address"), F.lit(None).cast("string").alias("text"), "reason")
        quarantine = shared_table(held.unionByName(whole), "quarantine")
    else:
        fails = F.raise_error(F.concat(F.lit("more values than header fields in "), F.col("file"), F.lit(": "), F.col("line"))).cast("boolean")
        rows = after.where(F.when(extra, fails).otherwise(True))
        quarantine = spark.createDataFrame([], "file string, address struct<block: bigint, n: bigint>, text string, reason string")
    cols = [F.trim(F.get("__fields", (F.get("__at", F.lit(i)) - 1).cast("int"))).alias(n) for i, n in enumerate(names)]
    # pandas reads an empty field as missing
    cols = [F.when(c != "", c).alias(n) for c, n in zip(cols, names, strict=True)]
    if station_column:
        code = F.regexp_extract("file", station_pattern, 1)
        cols.append(F.when(code != "", F.upper(code)).otherwise(F.col("file")).alias(station_column))
    return StationRead(rows.select(*cols, *([F.col("file").alias(file_column)] if file_column else [])), files, quarantine, lines)


def scan_station_csv(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """The rows of :func:`read_station_files`, which takes the same options."""
    return read_station_files(spark, paths, **options).rows
