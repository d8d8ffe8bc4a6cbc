"""Sample files: signature, header, samples and scan statistics.

Files come as rows with their ``content`` or, of any size, as a listing
``(trace_id, path, size)`` of :mod:`traceprofile.sources.file_ranges`. From a listing the
signature and header take the first bytes of each file only, and samples are scanned by
byte ranges:

* Where a scan enters a range depends on all bytes before it. But no record is longer than
  ``MAX_RECORD`` bytes, so it enters within that many bytes of the begin. For each of these
  offsets a first pass finds where the scan leaves the range, how many samples it meets and
  how many bytes it skips; scans from different offsets soon run into each other.
* The ranges of a file are composed in order, a few numbers each, which settles where every
  range is entered and where the file ends, be it by too many skipped bytes.
* A second pass reads the ranges that are entered and emits their samples.

A file of one range, as most are, takes the second pass only.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceprofile.session import materialize
from traceprofile.sources import file_ranges
from traceprofile.sources.binary_files import little_endian
from traceprofile.sources.file_ranges import RANGE_BYTES, Opener, open_file, read_at

# ---------------------------------------------------------------------------
# Layout of the file format.
# ---------------------------------------------------------------------------
MAGIC_HEX = "04030201"
VERSION_AT, TIMESTAMP_AT, INTERVAL_AT, JSON_LENGTH_AT, JSON_AT = 8, 12, 20, 24, 28
RECORD_HEADER = 76
DEPTH_AT = 68
MAX_DEPTH = 500   # exclusive
MAX_BAD_BYTES = 200
MAX_RECORD = RECORD_HEADER + 8 * (MAX_DEPTH - 1)
# ---------------------------------------------------------------------------

BATCH_SAMPLES = 10_000
#: Places looked at together, and blocks of them kept.
_BLOCK, _BLOCKS_KEPT = 64 << 10, 16

_SCAN_SCHEMA = (
    "trace_id string, sample_ord bigint, marker int, depth int, frames array<bigint>, bad bigint"
)


def _json_length(start: bytes) -> int:
    """Bytes of the header's text; a foreign file is not read further."""
    if start[:4] != bytes.fromhex(MAGIC_HEX):
        return 0
    return struct.unpack_from("<I", start, JSON_LENGTH_AT)[0]


def with_headers(listing: DataFrame, opener: Opener = open_file) -> DataFrame:
    """``listing`` with the header bytes of each file as ``content``; no other byte is read."""
    return file_ranges.file_starts(listing, JSON_AT, _json_length, opener)


def _started(files: DataFrame) -> DataFrame:
    return files if "content" in files.columns else with_headers(files)


def has_signature(content: Column) -> Column:
    return F.coalesce(
        F.substring(content, 1, 4) == F.unhex(F.lit(MAGIC_HEX)), F.lit(False)
    )


def valid_files(files: DataFrame) -> DataFrame:
    """The files with the signature, in the form they came in."""
    return _started(files).filter(has_signature(F.col("content"))).select(*files.columns)


def rejected_files(files: DataFrame) -> DataFrame:
    """Files without the signature, with the bytes found in its place."""
    size = F.col("size") if "size" in files.columns else F.length("content")
    return _started(files).filter(~has_signature(F.col("content"))).select(
        "trace_id", F.lower(F.hex(F.substring("content", 1, 4))).alias("signature"),
        size.cast("bigint").alias("size"),
    )


def trace_headers(files: DataFrame) -> DataFrame:
    """Header fields of every file; a foreign file or a text process id gives NULL.

    Of a listing the text of a file without the signature is not read.
    """
    content = F.col("content")
    present = F.greatest(F.length(content) - JSON_AT, F.lit(0))
    meta_length = F.least(little_endian(content, JSON_LENGTH_AT, 4), present).cast("int")
    meta = F.substring(content, F.lit(JSON_AT + 1), meta_length).cast("string")
    return _started(files).select(
        "trace_id",
        little_endian(content, VERSION_AT, 4).alias("version"),
        little_endian(content, TIMESTAMP_AT, 8).alias("ts"),
        little_endian(content, INTERVAL_AT, 4).alias("interval_us"),
        meta.alias("meta"),
        F.get_json_object(meta, "$.processId").try_cast("bigint").alias("process_id"),
    )


def _start(content: memoryview | bytes, size: int) -> int:
    """Where the records of a file of ``size`` bytes begin, by its first bytes."""
    if len(content) < JSON_AT:
        return size
    return JSON_AT + struct.unpack_from("<I", content, JSON_LENGTH_AT)[0]


def _records(
    content: memoryview | bytes, at: int, limit: int, bad: int = 0
) -> Iterator[tuple[int, int, int]]:
    """``(start, depth, bad)`` of each record that starts from ``at`` on and before ``limit``;
    ``bad`` counts skipped bytes so far. Ends with ``(-1, 0, bad)``."""
    size = len(content)
    read_u32 = struct.Struct("<I").unpack_from
    while at < limit and at + RECORD_HEADER <= size:
        depth = read_u32(content, at + DEPTH_AT)[0]
        if 0 < depth < MAX_DEPTH:
            end = at + RECORD_HEADER + 8 * depth
            if end > size:
                break
            yield at, depth, bad
            at = end
        else:
            at, bad = at + 1, bad + 1
            if bad > MAX_BAD_BYTES:
                break
    yield -1, 0, bad


def _batch(trace: str, content: memoryview, first: int, found: list[tuple[int, int, int]]):
    depths = np.array([d for _, d, _ in found], dtype=np.int32)
    offsets = np.zeros(len(found) + 1, dtype=np.int32)
    np.cumsum(depths, out=offsets[1:])
    frames = [
        np.frombuffer(content, dtype="<i8", count=d, offset=at + RECORD_HEADER)
        for at, d, _ in found
    ]
    markers = [int.from_bytes(content[at : at + 2], "little") for at, _, _ in found]
    n = len(found)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([trace] * n, pa.string()),
            pa.array(np.arange(first, first + n, dtype=np.int64)),
            pa.array(markers, pa.int32()),
            pa.array(depths),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(frames))),
            pa.array([b for _, _, b in found], pa.int64()),
        ],
        names=["trace_id", "sample_ord", "marker", "depth", "frames", "bad"],
    )


def _summary(trace: str, bad: int):
    return pa.RecordBatch.from_arrays(
        [
            pa.array([trace], pa.string()), pa.array([None], pa.int64()),
            pa.array([None], pa.int32()), pa.array([None], pa.int32()),
            pa.array([None], pa.list_(pa.int64())), pa.array([bad], pa.int64()),
        ],
        names=["trace_id", "sample_ord", "marker", "depth", "frames", "bad"],
    )


def _samples(
    trace: str, content: memoryview, at: int, limit: int, bad: int = 0, done: int = 0
) -> Iterator[pa.RecordBatch]:
    """The samples of a content numbered from ``done`` on, then the bytes skipped so far."""
    found: list[tuple[int, int, int]] = []
    for record in _records(content, at, limit, bad):
        if record[0] >= 0:
            found.append(record)
        if found and (len(found) == BATCH_SAMPLES or record[0] < 0):
            yield _batch(trace, content, done, found)
            done, found = done + len(found), []
        if record[0] < 0:
            yield _summary(trace, record[2])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for trace, value in zip(batch.column(0), batch.column(1)):
            content = memoryview(value.as_buffer())
            yield from _samples(trace.as_py(), content, _start(content, len(content)), len(content))


class _Starts:
    """Places of a content where a record may start, looked up by blocks and in order."""

    def __init__(self, content: bytes, limit: int) -> None:
        self._octets = np.frombuffer(content, dtype=np.uint8)
        #: no record starts from here on
        self.stop = min(limit, len(content) - RECORD_HEADER + 1)
        self._blocks: dict[int, tuple[list[int], list[int]]] = {}

    def _block(self, number: int) -> tuple[list[int], list[int]]:
        if number not in self._blocks:
            if len(self._blocks) == _BLOCKS_KEPT:
                del self._blocks[next(iter(self._blocks))]
            begin = number * _BLOCK
            count = min(_BLOCK, self.stop - begin)
            octets = self._octets[begin + DEPTH_AT : begin + DEPTH_AT + count + 3].astype(np.uint32)
            depths = octets[:count] | octets[1 : count + 1] << 8 | octets[2 : count + 2] << 16
            depths |= octets[3:] << 24
            places = np.flatnonzero((depths > 0) & (depths < MAX_DEPTH))
            self._blocks[number] = (places + begin).tolist(), depths[places].tolist()
        return self._blocks[number]

    def after(self, at: int) -> tuple[int, int]:
        """The first start from ``at`` on and its depth; ``stop`` and 0 where there is none."""
        while at < self.stop:
            places, depths = self._block(at // _BLOCK)
            i = bisect_left(places, at)
            if i < len(places):
                return places[i], depths[i]
            at = (at // _BLOCK + 1) * _BLOCK
        return self.stop, 0


def _passages(content: bytes, entries: range, limit: int) -> np.ndarray:
    """Rows ``(start, exit, samples, skipped)`` by ascending start, for the scans that enter.

    A scan that enters skips to the first start from there on; the row tells what follows.
    ``exit`` is the first position from ``limit`` on, or -1 where the file ends before. More
    than ``MAX_BAD_BYTES`` skipped bytes are told as one more.
    """
    size, starts = len(content), _Starts(content, limit)
    end = limit if limit == starts.stop else -1
    known: dict[int, tuple[int, int, int]] = {starts.stop: (end, 0, 0)}
    rows, entry = [], entries.start
    while entry < entries.stop and entry <= starts.stop:
        place, depth = first, _ = starts.after(entry)
        path = []
        while place not in known:
            after = place + RECORD_HEADER + 8 * depth
            if after > size:
                known[place] = (-1, 0, 0)
                break
            if after >= starts.stop:
                known[place] = (after if after >= limit else -1, 1, 0)
                break
            following, depth = starts.after(after)
            path.append((place, following - after))
            place = following
        leaves, samples, skipped = known[place]
        for at, gap in reversed(path):
            samples, skipped = samples + 1, min(skipped + gap, MAX_BAD_BYTES + 1)
            known[at] = (leaves, samples, skipped)
        rows.append((first, *known[first]))
        entry = first + 1
    return np.array(rows, dtype="<i8").reshape(-1, 4)


def _passage(rows: np.ndarray, entry: int) -> tuple[int, int, int] | None:
    """``(exit, samples, skipped)`` of a scan that enters at ``entry`` and survives."""
    i = int(np.searchsorted(rows[:, 0], entry))
    if i == len(rows):
        return None
    start, leaves, samples, skipped = rows[i].tolist()
    skipped += start - entry
    return (leaves, samples, skipped) if skipped <= MAX_BAD_BYTES else None


def _passage_table(range_bytes: int, opener: Opener):
    """Per range ``start`` of the file's records and the passages, by positions in the range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begin, end = row["begin"], row["end"]
                with opener(row["path"]) as file:
                    start = _start(read_at(file, 0, JSON_AT), row["size"])
                    passages = np.empty((0, 4), dtype="<i8")
                    if start < end:
                        content = read_at(file, begin, end - begin + MAX_RECORD)
                        first = max(start - begin, 0)
                        last = first + 1 if start >= begin else min(MAX_RECORD, end - begin)
                        passages = _passages(content, range(first, last), end - begin)
                yield pa.RecordBatch.from_pylist([{
                    **{name: row[name] for name in ("trace_id", "path", "size", "begin", "end")},
                    "start": start, "passages": passages.tobytes(),
                }], schema=_TABLE_TYPE)

    return work


_TABLE_TYPE = pa.schema([
    ("trace_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("begin", pa.int64()),
    ("end", pa.int64()), ("start", pa.int64()), ("passages", pa.binary()),
])
_TABLE_SCHEMA = (
    "trace_id string, path string, size bigint, begin bigint, end bigint, start bigint, "
    "passages binary"
)
_ENTERED_SCHEMA = (
    "trace_id string, path string, size bigint, begin bigint, end bigint, entry bigint, "
    "done bigint, bad bigint"
)


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges that a scan of each file enters; rows come by path and begin."""
    path, at, done, bad = None, -1, 0, 0
    for batch in batches:
        entered = []
        for row in batch.to_pylist():
            if row["path"] != path:
                path, at, done, bad = row["path"], row["start"], 0, 0
            if not row["begin"] <= at < row["end"]:
                continue
            entered.append({
                **{name: row[name] for name in ("trace_id", "path", "size", "begin", "end")},
                "entry": at, "done": done, "bad": bad,
            })
            rows = np.frombuffer(row["passages"], dtype="<i8").reshape(-1, 4)
            passage = _passage(rows, at - row["begin"])
            if passage is None:  # too many bytes are skipped here
                at = -1
                continue
            leaves, samples, skipped = passage
            done, bad = done + samples, bad + skipped
            at = row["begin"] + leaves if leaves >= 0 and bad <= MAX_BAD_BYTES else -1
        yield pa.RecordBatch.from_pylist(entered, schema=pa.schema([
            ("trace_id", pa.string()), ("path", pa.string()),
            *((name, pa.int64()) for name in ("size", "begin", "end", "entry", "done", "bad")),
        ]))


def _scan_entered(opener: Opener):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begin, end = row["begin"], row["end"]
                with opener(row["path"]) as file:
                    content = memoryview(read_at(file, begin, end - begin + MAX_RECORD))
                entry = row["entry"] if row["entry"] is not None else _start(content, row["size"])
                yield from _samples(
                    row["trace_id"], content, entry - begin, end - begin, row["bad"], row["done"]
                )

    return work


def scan_ranges(
    listing: DataFrame, range_bytes: int = RANGE_BYTES, opener: Opener = open_file
) -> DataFrame:
    """:func:`scan_files` of a listing, by byte ranges. A file may have several rows without
    a depth; the largest ``bad`` counts.

    The listing is read several times, so it is written first: it may open every file."""
    listing = materialize(listing, "listing")
    cut = file_ranges.spread(file_ranges.ranges(listing, range_bytes), listing, range_bytes)
    number = F.lit(0).cast("bigint")
    single = cut.filter(F.col("size") <= range_bytes).select(
        "*", F.lit(None).cast("bigint").alias("entry"), number.alias("done"), number.alias("bad")
    )
    tables = cut.filter(F.col("size") > range_bytes).mapInArrow(
        _passage_table(range_bytes, opener), _TABLE_SCHEMA
    )
    entered = tables.repartition("path").sortWithinPartitions("path", "begin").mapInArrow(
        _compose, _ENTERED_SCHEMA
    )
    several = file_ranges.spread(entered, listing, range_bytes)
    # a file whose records begin behind its end has a row too
    found = single.unionByName(several).mapInArrow(_scan_entered(opener), _SCAN_SCHEMA)
    silent = listing.filter(F.col("size") > range_bytes).select(
        "trace_id", F.lit(None).cast("bigint").alias("sample_ord"), F.lit(None).cast("int").alias("marker"),
        F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<bigint>").alias("frames"),
        number.alias("bad"),
    )
    return found.unionByName(silent)


def scan_files(files: DataFrame) -> DataFrame:
    """All samples plus one row per file (``depth`` NULL) with its final ``bad`` count.

    One pass serves both :func:`samples_of` and :func:`parse_stats`.
    """
    if "content" not in files.columns:
        return scan_ranges(files)
    return files.select("trace_id", "content").mapInArrow(_scan, _SCAN_SCHEMA)


def samples_of(scan: DataFrame) -> DataFrame:
    return scan.filter(F.col("depth").isNotNull()).drop("bad")


def parse_stats(scan: DataFrame) -> DataFrame:
    """``(trace_id, sample_count, bad)`` of every file."""
    return scan.groupBy("trace_id").agg(
        F.count("depth").alias("sample_count"), F.max("bad").alias("bad")
    )


def parse_samples(files: DataFrame) -> DataFrame:
    return samples_of(scan_files(files))
