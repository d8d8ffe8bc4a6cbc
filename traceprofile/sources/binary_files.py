"""Files as rows of ``(trace_id, path, content)`` and little-endian fields of a content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceprofile.functions.text import TRACE_NAME_PATTERN

# Ending of a symbol map's name, name of a sample file alone in its folder.
MAPPING_SUFFIX = "-mapping"
SAMPLE_FILE = "sampling"

#: Tasks per core that list folders.
LISTING_TASKS = 8
_LISTING_CONF = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def folder_root(spark: SparkSession, path: str) -> str:
    """The folder read, as the reader spells it; the part before any wildcard."""
    plain = "/".join(takewhile(lambda part: not re.search(r"[*?\[{]", part), path.split("/")))
    folder = spark._jvm.org.apache.hadoop.fs.Path(plain or "/")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(folder).toString().rstrip("/")


def trace_identity(path: Column, root: str) -> Column:
    """Name of the trace a file belongs to: unique per sample file, shared by its map.

    It is the path below ``root`` without the ending of a map; a sample file under the
    usual name is known by its folder. For a file in ``root`` itself that leaves nothing:
    then the trace name in the path counts, or else the name of the folder.
    """
    below = F.when(
        F.startswith(path, F.lit(root + "/")), F.substring(path, F.lit(len(root) + 2), F.length(path))
    ).otherwise(F.element_at(F.split(path, "/"), -1))
    own = F.regexp_replace(F.regexp_replace(below, f"{MAPPING_SUFFIX}$", ""), f"(^|/){SAMPLE_FILE}$", "")
    named = F.nullif(F.regexp_extract(path, TRACE_NAME_PATTERN, 1), F.lit(""))
    return F.coalesce(F.nullif(own, F.lit("")), named, F.lit(root.rsplit("/", 1)[-1]))


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Some tasks per core while folders are listed; by default each folder gets a task."""
    most = str(spark.sparkContext.defaultParallelism * LISTING_TASKS)
    before = spark.conf.get(_LISTING_CONF, None)
    if before is not None and int(before) <= int(most):
        yield
        return
    spark.conf.set(_LISTING_CONF, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LISTING_CONF)
        else:
            spark.conf.set(_LISTING_CONF, before)


def file_listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """The files below ``path`` with ``trace_id``, ``path``, ``length`` and ``content``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    with _few_listing_tasks(spark):
        files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.withColumn("trace_id", trace_identity(F.col("path"), folder_root(spark, path)))


def read_binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(trace_id, path, content)``, one row per file, through Spark's own reader.

    A row holds less than 2 GiB; a larger file fails the read. ``list_files`` of
    :mod:`traceprofile.sources.file_ranges` takes files of any size.
    """
    return file_listing(spark, path, pattern).select("trace_id", "path", "content")


def little_endian(content: Column, offset: int, size: int) -> Column:
    """Unsigned field at a byte offset as BIGINT (two's complement at eight bytes);
    NULL when the content is too short."""
    octets = [F.substring(content, offset + size - i, 1) for i in range(size)]
    value = F.conv(F.hex(F.concat(*octets)), 16, -10).cast("bigint")
    return F.when(F.length(content) >= offset + size, value)
