"""Files of any size: listed through Spark, read by positions inside tasks.

A listing ``(trace_id, path, size)`` stays a DataFrame; every task opens the files of its
rows and reads only the bytes it needs. Paths are opened with :mod:`pyarrow.fs`, which
knows local files, HDFS and the common object stores. For another store pass ``opener``, a
function of a path that returns a file with ``seek`` and ``read``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceprofile.sources.binary_files import LISTING_TASKS, file_listing

Opener = Callable[[str], BinaryIO]

#: Bytes of a file that one task reads at a time.
RANGE_BYTES = 64 << 20
#: Bytes of a shuffle partition of ranges, what opening a file counts for in bytes, and
#: partitions at most.
_TASK_BYTES, _OPEN_BYTES, _MOST_TASKS = 4 * RANGE_BYTES, 4 << 20, 100_000


def file_system(path: str):
    """The :mod:`pyarrow.fs` file system of a path as Spark spells it, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(quote(path, safe=":/@=+,"))


def open_file(path: str) -> BinaryIO:
    """Open a path as Spark spells it."""
    system, name = file_system(path)
    return system.open_input_file(name)


def read_at(file: BinaryIO, offset: int, size: int) -> bytes:
    """Up to ``size`` bytes from an offset; fewer at the end of the file."""
    file.seek(offset)
    parts, left = [], size
    while left > 0 and (part := file.read(left)):
        parts.append(part)
        left -= len(part)
    return parts[0] if len(parts) == 1 else b"".join(parts)


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(trace_id, path, size)`` of files of any size; no content is read.

    Spark's listing leaves out files without a byte.
    """
    return _listed(spark, path, pattern).select(
        "trace_id", "path", F.col("length").cast("bigint").alias("size")
    )


def list_file_versions(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(trace_id, path, size, modified)``: the listing with what tells one form of a file
    from the next."""
    return _listed(spark, path, pattern).select(
        "trace_id", "path", F.col("length").cast("bigint").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def _listed(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    """The listing in some tasks per core; Spark deals files for their content, four to a task,
    and the driver would keep a task and a written file for each four names."""
    return file_listing(spark, path, pattern).coalesce(spark.sparkContext.defaultParallelism * LISTING_TASKS)


def file_starts(listing: DataFrame, fixed: int, more: Callable[[bytes], int] | None = None,
                opener: Opener = open_file) -> DataFrame:
    """``listing`` with ``content``, the first ``fixed`` bytes of each file and ``more`` of them.

    ``more`` tells from the first bytes how many follow. Nothing else is read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for path in batch.column("path").to_pylist():
                with opener(path) as file:
                    start = read_at(file, 0, fixed)
                    if more is not None and len(start) == fixed and (rest := more(start)) > 0:
                        start += read_at(file, fixed, rest)
                starts.append(start)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("trace_id", "path", "size")), pa.array(starts, pa.binary())],
                names=["trace_id", "path", "size", "content"],
            )

    plain = listing.select("trace_id", "path", "size")
    return plain.mapInArrow(read, "trace_id string, path string, size bigint, content binary")


def ranges(listing: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(trace_id, path, size, begin, end)``: every file cut into ranges, spread over tasks."""
    begins = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)),
                        F.lit(range_bytes).cast("bigint"))
    cut = listing.select("trace_id", "path", "size", F.explode(begins).alias("begin"))
    return cut.withColumn("end", F.least(F.col("begin") + range_bytes, "size"))


def spread(rows: DataFrame, listing: DataFrame, range_bytes: int) -> DataFrame:
    """``rows`` of ranges dealt over as many tasks as the files' bytes call for.

    Rows of ranges are tiny, so partitions merged by their size would put all into one task.
    A task per few small ranges would cost more than they do, and its blocks of the shuffle
    grow with the square of the files; so a range counts by its bytes and for being opened.
    """
    number = F.ceil((F.col("size") + 1) / range_bytes)
    return rows.repartition(task_count(listing, number), "path", "begin")


def task_count(listing: DataFrame, opened: Column | None = None) -> int:
    """Tasks that the bytes of the files call for, each file being opened so many times."""
    cores = listing.sparkSession.sparkContext.defaultParallelism
    total = listing.agg(F.sum(F.col("size") + (F.lit(1) if opened is None else opened) * _OPEN_BYTES)).first()[0] or 1
    return min(max(cores, math.ceil(total / _TASK_BYTES)), _MOST_TASKS)
