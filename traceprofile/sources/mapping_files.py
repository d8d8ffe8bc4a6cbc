"""Symbol maps: the binary file format and the hex-keyed JSON form."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceprofile.functions.text import hex_address, parse_hex_address
from traceprofile.operators.joins import broadcast_limit
from traceprofile.session import materialize
from traceprofile.sources.file_ranges import Opener, open_file, read_at, task_count

# Layout of the file format.
FILE_HEADER = 16
RECORD_HEAD = 10
MAX_NAME_BYTES = 2000  # exclusive

#: Bytes of a file in memory at a time.
PIECE_BYTES = 16 << 20

_SCHEMA = "trace_id string, addr bigint, name string"
_SCHEMA_WITH_PATH = "trace_id string, path string, addr bigint, name string"


def _parse(content: memoryview, at: int) -> tuple[dict[int, str], int, bool]:
    """Address to name, a later record replacing an earlier one of the same address; then
    the place of the first record that was not read, and whether it ends the file."""
    names: dict[int, str] = {}
    size, head = len(content), struct.Struct("<qH")
    while at + RECORD_HEAD <= size:
        addr, length = head.unpack_from(content, at)
        if not 0 < length < MAX_NAME_BYTES:
            return names, at, True
        after = at + RECORD_HEAD + length
        if after > size:
            break
        names[addr] = str(content[at + RECORD_HEAD : after], "utf-8", "replace")
        at = after
    return names, at, False


def _pieces(file: BinaryIO, piece: int) -> Iterator[dict[int, str]]:
    """The symbols of a file of any size, by pieces; a record that a piece cuts off is read
    again with the next one."""
    at = FILE_HEADER
    while True:
        content = read_at(file, at, piece)
        names, after, ended = _parse(memoryview(content), 0)
        yield names
        if ended or len(content) < piece:
            return
        at += after


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.schema.names[:-1]
        for *own, value in zip(*batch.columns):
            names, _, _ = _parse(memoryview(value.as_buffer()), FILE_HEADER)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array([key.as_py()] * len(names), pa.string()) for key in own],
                    pa.array(list(names), pa.int64()),
                    pa.array(list(names.values()), pa.string()),
                ],
                names=[*keys, "addr", "name"],
            )


def _scan_listed(piece: int, opener: Opener):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opener(row["path"]) as file:
                    for number, names in enumerate(_pieces(file, piece)):
                        yield pa.RecordBatch.from_arrays(
                            [
                                *[pa.array([row[key]] * len(names), pa.string())
                                  for key in ("trace_id", "path")],
                                pa.array(list(names), pa.int64()),
                                pa.array(list(names.values()), pa.string()),
                                pa.array([number] * len(names), pa.int64()),
                            ],
                            names=["trace_id", "path", "addr", "name", "piece"],
                        )

    return work


def parse_mapping(
    files: DataFrame, piece_bytes: int = PIECE_BYTES, opener: Opener = open_file
) -> DataFrame:
    """``(trace_id, addr, name)`` of every file, with its ``path`` where that is known.

    Of rows with a ``content`` duplicates are settled inside the file, so no shuffle follows.
    A listing may hold files of any size; they are read by pieces, and the last piece wins.
    Files that are small together are read once and their symbols written, which tells later
    joins the size; larger ones are read where the symbols are used.
    """
    if "content" not in files.columns:
        scan, layout = _scan_listed(piece_bytes, opener), f"{_SCHEMA_WITH_PATH}, piece bigint"
        # read several times below, and a listing asks for every file
        files = materialize(files.select("trace_id", "path", "size"), "map-listing")
        # duplicates of a file of one piece are settled in the task that reads it
        one = F.coalesce(F.col("size") <= piece_bytes, F.lit(False))
        listed = files.filter(one).repartition(task_count(files), "trace_id", "path")
        small = listed.select("trace_id", "path").distinct().mapInArrow(scan, layout)
        found = files.filter(~one).select("trace_id", "path").mapInArrow(scan, layout)
        last = found.groupBy("trace_id", "path", "addr").agg(F.max_by("name", "piece").alias("name"))
        symbols = small.select(*last.columns).unionByName(last)
        total = files.agg(F.sum("size")).first()[0] or 0
        return materialize(symbols, "symbols") if total <= broadcast_limit(files.sparkSession) else symbols
    if "path" in files.columns:
        return files.select("trace_id", "path", "content").mapInArrow(_scan, _SCHEMA_WITH_PATH)
    return files.select("trace_id", "content").mapInArrow(_scan, _SCHEMA)


def write_mapping_json(mapping: DataFrame, path: str) -> None:
    """One JSON row per symbol, the address as unsigned hex text."""
    others = [c for c in mapping.columns if c not in ("addr", "name")]
    mapping.select(*others, hex_address(F.col("addr")).alias("addr_hex"), "name").write.json(path)


def read_mapping_json(spark: SparkSession, path: str) -> DataFrame:
    """Inverse of :func:`write_mapping_json`; ``trace_id`` is NULL where it was not kept."""
    rows = spark.read.schema("trace_id string, addr_hex string, name string").json(path)
    return rows.select("trace_id", parse_hex_address(F.col("addr_hex")).alias("addr"), "name")


def read_mapping_object_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold a single object ``{"0x…": "name", …}``, one object per file."""
    whole = spark.read.text(path, wholetext=True)
    pairs = F.explode(F.from_json("value", "map<string,string>")).alias("addr_hex", "name")
    return whole.select(pairs).select(
        parse_hex_address(F.col("addr_hex")).alias("addr"), "name"
    )
