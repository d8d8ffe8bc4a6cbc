"""Sample files and maps of any size, read by positions."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from tests.test_files import CASES, header, record, symbol
from traceprofile.sources import file_ranges, mapping_files, trace_files


def noisy(seed):
    """Records with runs of skipped bytes between them, some of them beyond the limit."""
    rng = random.Random(seed)
    data = header(b"{}" + b" " * rng.choice([0, 0, 300]))
    for _ in range(rng.randint(5, 60)):
        data += record([rng.choice([rng.getrandbits(64), rng.randrange(600)]) for _ in range(rng.randint(1, 40))])
        if rng.random() < 0.2:
            data += bytes(rng.choice([0, 0, 1, 3, 255]) for _ in range(rng.randint(1, 60)))
    return data[: len(data) - rng.choice([0, 0, 5])]


EXTRA = {f"noisy{i}": noisy(i) for i in range(25)} | {
    # the text of the header ends in a later range, or behind the end of the file
    "late": header(b"x" * 10_000) + record([1]) + record([2]),
    "behind": header(b"{}")[:24] + struct.pack("<I", 9_000) + b"{}" + record([1]) * 40,
    "junk_at_end": header() + record([7] * 30) * 60 + b"\0" * 5000,
    "deep": header() + record(list(range(499))) * 8,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("ranged traces")
    for name, data in ({n: c[0] for n, c in CASES.items()} | EXTRA).items():
        (root / name).write_bytes(data)
    (root / "tiny").write_bytes(b"\x04\x03")
    (root / "foreign").write_bytes(b"PK" * 5000)
    return root


def result(scan):
    scan = scan.persist()
    samples = {}
    for r in trace_files.samples_of(scan).orderBy("trace_id", "sample_ord").collect():
        own = samples.setdefault(r.trace_id, [])
        assert r.sample_ord == len(own)
        own.append((r.marker, r.depth, r.frames))
    stats = {r.trace_id: (r.sample_count, r.bad) for r in trace_files.parse_stats(scan).collect()}
    scan.unpersist()
    return samples, stats


@pytest.fixture(scope="module")
def whole(spark, folder):
    """All files, with or without the signature, read as one content each."""
    rows = [(p.name, p.read_bytes()) for p in folder.iterdir()]
    return result(trace_files.scan_files(spark.createDataFrame(rows, "trace_id string, content binary")))


@pytest.mark.parametrize("size", [64, 3000, 64 << 10])
def test_ranges_give_what_whole_files_give(spark, folder, whole, size):
    names = [n for n in CASES if n != "many" or size > 64] + list(EXTRA) + ["tiny", "foreign"]
    listing = file_ranges.list_files(spark, str(folder)).filter(F.col("trace_id").isin(names))
    samples, stats = result(trace_files.scan_ranges(listing, size))
    assert stats == {n: whole[1][n] for n in names}
    assert samples == {n: s for n, s in whole[0].items() if n in names}


class Counting:
    """A file that adds up the bytes read from it, in a shared folder."""

    def __init__(self, path, log):
        self.file, self.log, self.path = file_ranges.open_file(path), log, path

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def seek(self, offset):
        return self.file.seek(offset)

    def read(self, size):
        data = self.file.read(size)
        with open(f"{self.log}/{self.path.rsplit('/', 1)[-1]}", "ab") as out:
            out.write(b"." * len(data))
        return data


def test_only_headers_are_read(spark, folder, tmp_path):
    log = str(tmp_path)
    listing = file_ranges.list_files(spark, str(folder))
    started = trace_files.with_headers(listing, lambda path: Counting(path, log))
    rows = {r.trace_id: r.content for r in started.collect()}
    for path in folder.iterdir():
        data = path.read_bytes()
        text = struct.unpack_from("<I", data, 24)[0] if data[:4] == b"\x04\x03\x02\x01" else 0
        logged = tmp_path / path.name
        assert (logged.stat().st_size if logged.exists() else 0) == len(rows[path.name]) <= 28 + text
        assert data.startswith(rows[path.name])


def test_headers_and_signatures_of_a_listing(spark, folder):
    listing = file_ranges.list_files(spark, str(folder))
    rows = [(p.name, p.read_bytes()) for p in folder.iterdir()]
    files = spark.createDataFrame(rows, "trace_id string, content binary")
    for operator in (trace_files.trace_headers, trace_files.rejected_files,
                     lambda f: trace_files.valid_files(f).select("trace_id")):
        want = sorted(tuple(r) for r in operator(files.filter("trace_id <> 'foreign'")).collect())
        assert sorted(tuple(r) for r in operator(listing.filter("trace_id <> 'foreign'")).collect()) == want
    foreign = trace_files.rejected_files(listing).filter("trace_id = 'foreign'").first()
    assert (foreign.signature, foreign.size) == ("504b504b", 10_000)


@pytest.mark.parametrize("piece", [2010, 5000, mapping_files.PIECE_BYTES])
def test_maps_by_pieces(spark, tmp_path, piece):
    rng = random.Random(4)
    head = struct.pack("<QII", 0, 1, 99)
    names = [(rng.randrange(300), b"n%d" % i * rng.randint(1, 40)) for i in range(900)]
    (tmp_path / "long").write_bytes(head + b"".join(symbol(a, n) for a, n in names))
    (tmp_path / "stop").write_bytes(
        head + b"".join(symbol(a, n) for a, n in names[:500]) + symbol(1, b"") + symbol(2, b"late")
    )
    (tmp_path / "cut").write_bytes((head + b"".join(symbol(a, n) for a, n in names))[:-1])
    (tmp_path / "none").write_bytes(b"")
    listing = file_ranges.list_files(spark, str(tmp_path))
    got = {}
    for r in mapping_files.parse_mapping(listing, piece).collect():
        assert r.addr not in got.setdefault(r.trace_id, {})
        got[r.trace_id][r.addr] = r.name.encode()
    assert got == {"long": dict(names), "stop": dict(names[:500]), "cut": dict(names[:-1])}


def test_a_file_is_spread_over_tasks(spark, tmp_path):
    (tmp_path / "sampling").write_bytes(header() + record(list(range(30))) * 3000)
    listing = file_ranges.list_files(spark, str(tmp_path))
    cut = file_ranges.spread(file_ranges.ranges(listing, 32 << 10), listing, 32 << 10)
    parts = cut.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert cut.count() > 25 and len(parts) > 4


def test_small_ranges_share_tasks(spark):
    """A task per four ranges made the blocks of the shuffle grow with the square of the files."""
    listing = spark.range(300).select(
        F.concat(F.lit("t"), "id").alias("trace_id"), F.concat(F.lit("/t"), "id").alias("path"),
        F.lit(400_000).cast("bigint").alias("size"),
    )
    cut = file_ranges.spread(file_ranges.ranges(listing, 10_000), listing, 10_000)
    assert cut.count() == 12_000
    assert cut.rdd.getNumPartitions() < 300


def test_passages_take_less_than_the_range():
    """One row per place where a record may start, not per place where a scan may enter."""
    content = (header() + record(list(range(1000, 1040))) * 60)[len(header()):]
    content += bytes(trace_files.MAX_RECORD)
    limit = 16 << 10
    rows = trace_files._passages(content, range(trace_files.MAX_RECORD), limit)
    assert rows.nbytes < limit
    found = [trace_files._passage(rows, e) for e in range(trace_files.MAX_RECORD)]
    step = trace_files.RECORD_HEADER + 8 * 40
    records = -(-limit // step)
    assert found[0] == (records * step, records, 0)
    assert found[step] == (records * step, records - 1, 0)


def test_a_map_listed_twice_is_read_once(spark, tmp_path):
    (tmp_path / "m").write_bytes(struct.pack("<QII", 0, 1, 2) + symbol(1, b"a") + symbol(2, b"b"))
    listing = file_ranges.list_files(spark, str(tmp_path))
    rows = mapping_files.parse_mapping(listing.unionByName(listing)).collect()
    assert sorted((r.addr, r.name) for r in rows) == [(1, "a"), (2, "b")]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for i in range(100):
        (tmp_path / f"t{i}").mkdir()
        (tmp_path / f"t{i}" / "sampling").write_bytes(header())
    seen, reader = [], type(spark.read)
    load = reader.load
    try:
        reader.load = lambda self, *a, **k: seen.append(int(spark.conf.get(name))) or load(self, *a, **k)
        before = spark.conf.get(name)
        listing = file_ranges.list_files(spark, str(tmp_path), "sampling")
    finally:
        reader.load = load
    assert seen == [8 * spark.sparkContext.defaultParallelism]
    assert spark.conf.get(name) == before
    assert listing.count() == 100
