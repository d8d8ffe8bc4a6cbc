"""Sinks: issue tables and Markdown files, and their readers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceprofile import schema
from traceprofile.functions.text import report_filename
from traceprofile.plans.analysis import Analysis
from traceprofile.sources.binary_files import file_listing, folder_root
from traceprofile.sources.file_ranges import file_system


def write_issues(issues: DataFrame, path: str, mode: str = "error") -> None:
    """Issue table sorted by trace, so a reader of few traces skips most row groups.

    A folder per trace would mean as many files as traces. ``mode`` is that of Spark's
    writers; ``overwrite`` replaces the table of an earlier analysis.
    """
    (
        issues.select(*schema.ISSUES.fieldNames())
        .repartitionByRange("trace_id")
        .sortWithinPartitions("trace_id", "position")
        .write.mode(mode).parquet(path)
    )


#: Tables kept of an analysis, besides ``issues``.
RAW_TABLES = ("findings", "stacks", "traces", "diagnostics", "failures")
#: Versions of an analysis that stay, so that a reader of the last but one is not cut off.
KEPT_VERSIONS = 2


def write_analysis(
    analysis: Analysis, path: str, mode: str = "overwrite", keep: int = KEPT_VERSIONS
) -> None:
    """Issues with the findings, stacks and status they were made of, as one new version.

    The tables go to a folder of their own. A version counts from the moment on that its
    manifest, a small file under the next number, gets its name; nothing is ever written
    over. A run that breaks before leaves the last version as it was. Versions before the
    last ``keep`` are removed. With ``mode="error"`` there must be none yet.
    """
    spark = analysis.issues.sparkSession
    store = _Versions(spark, path)
    if mode == "error" and store.numbers():
        raise FileExistsError(f"{path} holds an analysis")
    folder = f"{path}/tables/{uuid.uuid4().hex}"
    for name in RAW_TABLES:
        getattr(analysis, name).write.parquet(f"{folder}/{name}")
    write_issues(analysis.issues, f"{folder}/issues")
    store.commit(folder.rsplit("/", 1)[-1])
    store.remove_all_but(keep)


def read_analysis(spark: SparkSession, path: str) -> Analysis:
    """The last whole version of an analysis."""
    folder = f"{path}/tables/{_Versions(spark, path).latest()}"
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in RAW_TABLES}
    return Analysis(issues=read_issues(spark, f"{folder}/issues"), **tables)


class _Versions:
    """Numbered manifests under ``path/versions``; each names a folder under ``path/tables``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._root = path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of the versions, ascending."""
        folder = self._path(f"{self._root}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.split("-")[0]) for n in names if re.fullmatch(r"\d+-[0-9a-f]{32}", n))

    def _manifests(self, number: int) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self._root}/versions/{number:012d}-*")) or []
        return sorted(f.getPath().getName() for f in found)

    def latest(self) -> str:
        numbers = self.numbers()
        if not numbers:
            raise FileNotFoundError(f"{self._root} holds no analysis")
        # of two runs that ended at once either counts, the same one for every reader
        return self._manifests(numbers[-1])[-1].split("-")[1]

    def commit(self, folder: str) -> None:
        number = max(self.numbers(), default=0) + 1
        manifest = self._path(f"{self._root}/versions/{number:012d}-{folder}")
        if not self._fs.createNewFile(manifest):
            raise FileExistsError(manifest.toString())

    def remove_all_but(self, keep: int) -> None:
        for number in self.numbers()[:-keep]:
            for name in self._manifests(number):
                # the manifest first: a version without it is no version
                self._fs.delete(self._path(f"{self._root}/versions/{name}"), False)
                self._fs.delete(self._path(f"{self._root}/tables/{name.split('-')[1]}"), True)


def read_issues(spark: SparkSession, path: str, trace_ids: list[str] | None = None) -> DataFrame:
    issues = spark.read.schema(schema.ISSUES).parquet(path)
    return issues if trace_ids is None else issues.filter(F.col("trace_id").isin(trace_ids))


def write_reports(reports: DataFrame, path: str, as_of: Column) -> int:
    """One Markdown file per trace, ``<path>/<trace>/<report file name>``; their number.

    Files are written in the tasks, under a passing name first, so that a report is there
    whole or not at all, also when a task is run again. The report of an earlier run in the
    folder of a trace is removed afterwards; those of other traces stay.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                _replace_report(system, f"{root}/{_folder(row['trace_id'])}", row["file_name"], row["markdown"])
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    named = reports.select("trace_id", report_filename(as_of).alias("file_name"), "markdown")
    return named.mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _folder(trace_id: str) -> str:
    """Folder of a trace below the reports; parts that are not plain are escaped."""
    if "" in trace_id.split("/"):
        return quote(trace_id, safe="")
    parts = [quote(part, safe="") for part in trace_id.split("/")]
    return "/".join(part.replace(".", "%2E") if set(part) == {"."} else part for part in parts)


def _replace_report(system, folder: str, name: str, markdown: str) -> None:
    from pyarrow import fs

    system.create_dir(folder, recursive=True)
    passing = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(passing) as out:
        out.write(markdown.encode("utf-8"))
    final = f"{folder}/{name}"
    if system.type_name != "local" and system.get_file_info(final).type != fs.FileType.NotFound:
        system.delete_file(final)  # other stores do not move over a file
    system.move(passing, final)
    for info in system.get_file_info(fs.FileSelector(folder)):
        if info.base_name.endswith(".md") and info.base_name != name and info.is_file:
            system.delete_file(info.path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``(trace_id, file_name, markdown)`` as written, one row per file."""
    below = F.expr(f"substring(path, {len(folder_root(spark, path)) + 2})")
    name = F.element_at(F.split(below, "/"), -1)
    trace = F.substring(below, F.lit(1), F.length(below) - F.length(name) - 1)
    return file_listing(spark, path, "*.md").select(
        F.url_decode(trace).alias("trace_id"), name.alias("file_name"),
        F.decode("content", "UTF-8").alias("markdown"),
    )
