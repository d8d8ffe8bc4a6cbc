"""Binary files, JSON maps, sinks and tables at rest."""

from __future__ import annotations

import json
import re
import struct

import pytest
from pyspark.sql import functions as F

import traceprofile as tp
from tests.test_issues import as_of, findings, trace_list, with_text
from traceprofile import schema
from traceprofile.operators import issues
from traceprofile.plans import report
from traceprofile.plans.profile import sample_profile
from traceprofile.sources import binary_files, mapping_files, outputs, slice_model, trace_files


def header(meta=b'{"processId":11550}', magic=b"\x04\x03\x02\x01"):
    return magic + struct.pack("<IIQII", 0, 5, 123456789, 25000, len(meta)) + meta


def record(frames, marker=7, opaque=b"\0" * 66, depth=None):
    depth = len(frames) if depth is None else depth
    return struct.pack("<H", marker) + opaque + struct.pack("<II", depth, depth) + b"".join(
        struct.pack("<Q", f) for f in frames
    )


# bytes, samples as (marker, frames), bytes skipped; all stated by hand
CASES = {
    "good": (header() + record([1]) + record([1, 2, 3, 4, 5], 9) + record(list(range(499))),
             [(7, [1]), (9, [1, 2, 3, 4, 5]), (7, list(range(499)))], 0),
    "junk": (header() + record([1, 2]) + b"\0" * 10 + record([3, 4]) + record([5, 6]),
             [(7, [1, 2]), (7, [3, 4]), (7, [5, 6])], 10),
    "hopeless": (header() + b"\0" * (76 + 201) + record([1, 2]), [], 201),
    "cut": (header() + record([1, 2]) + record([3, 4, 5])[:-3], [(7, [1, 2])], 0),
    # no byte of this record starts a depth below 500
    "deep": (header() + record([2**64 - 1] * 500) + record([2]), [], 201),
    "zero": (header() + record([8, 9]) + record([], depth=0), [(7, [8, 9])], 1),
    "high": (header() + record([2**63, 2**64 - 1]), [(7, [-(2**63), -1])], 0),
    "empty": (header(), [], 0),
    "no_meta": (header(b"") + record([4]), [(7, [4])], 0),
    # the marker of the record is taken for a depth of 7, 82 bytes into the noise
    "noise": (header() + b"\xff" * 150 + record([1, 2, 3]), [(0xFFFF, [0] * 7)], 82),
    "many": (header() + b"".join(record([i, i + 1]) for i in range(10_001)),
             [(7, [i, i + 1]) for i in range(10_001)], 0),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("traces")
    for name, (data, _, _) in CASES.items():
        (root / f"{name}.bin").write_bytes(data)
    (root / "wrong.bin").write_bytes(header(magic=b"PK\x03\x04") + record([1]))
    (root / "tiny.bin").write_bytes(b"\x04")
    return str(root)


@pytest.fixture(scope="module")
def files(spark, folder):
    return binary_files.read_binary_files(spark, folder, "*.bin")


def test_samples_and_statistics(files):
    scan = trace_files.scan_files(trace_files.valid_files(files))
    got = {}
    for r in trace_files.samples_of(scan).orderBy("trace_id", "sample_ord").collect():
        rows = got.setdefault(r.trace_id, [])
        assert r.sample_ord == len(rows) and r.depth == len(r.frames)
        rows.append((r.marker, r.frames))
    stats = {r.trace_id: (r.sample_count, r.bad) for r in trace_files.parse_stats(scan).collect()}
    for name, (_, samples, bad) in CASES.items():
        assert got.get(f"{name}.bin", []) == samples, name
        assert stats[f"{name}.bin"] == (len(samples), bad), name
    assert set(stats) == {f"{n}.bin" for n in CASES}


def test_headers(files):
    rows = {r.trace_id: r for r in trace_files.trace_headers(files).collect()}
    good = rows["good.bin"]
    assert (good.version, good.ts, good.interval_us) == (5, 123456789, 25000)
    assert (good.meta, good.process_id) == ('{"processId":11550}', 11550)
    assert rows["no_meta.bin"].meta == "" and rows["no_meta.bin"].process_id is None
    assert rows["tiny.bin"].version is None


def test_files_without_the_signature_are_reported(files):
    rows = {r.trace_id: r.signature for r in trace_files.rejected_files(files).collect()}
    assert rows == {"wrong.bin": "504b0304", "tiny.bin": "04"}


def test_trace_name_comes_from_the_path(spark, tmp_path):
    inner = tmp_path / "strace_abc123_huawei"
    inner.mkdir()
    (inner / "sampling").write_bytes(CASES["good"][0])
    assert binary_files.read_binary_files(spark, str(tmp_path)).first().trace_id == "strace_abc123_huawei"


def symbol(addr, name):
    return struct.pack("<QH", addr, len(name)) + name


def test_mapping_files(spark, tmp_path):
    head = struct.pack("<QII", 0, 1, 99)
    cases = {
        "dup": head + symbol(1, b"old") + symbol(2, b"two") + symbol(1, b"new"),
        "stop0": head + symbol(1, b"one") + symbol(2, b"") + symbol(3, b"three"),
        "stop2000": head + symbol(1, b"x" * 1999) + symbol(2, b"x" * 2000),
        "cut": head + symbol(1, b"one") + symbol(2, b"two")[:-1],
        "high": head + symbol(2**63 + 5, "方法".encode()) + symbol(7, b"bad\xff"),
        "none": head,
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in mapping_files.parse_mapping(
        binary_files.read_binary_files(spark, str(tmp_path))
    ).collect():
        got.setdefault(r.trace_id, {})[r.addr] = r.name
    assert got == {
        "dup": {1: "new", 2: "two"}, "stop0": {1: "one"}, "stop2000": {1: "x" * 1999},
        "cut": {1: "one"}, "high": {5 - 2**63: "方法", 7: "bad�"},
    }


def test_mapping_json_forms(spark, tmp_path):
    rows = [("t", 0, "zero"), ("t", 255, "a|b"), ("u", -1, "top \"q\"")]
    mapping = spark.createDataFrame(rows, schema.MAPPING)
    path = str(tmp_path / "rows")
    mapping_files.write_mapping_json(mapping, path)
    back = mapping_files.read_mapping_json(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    single = tmp_path / "object.json"
    single.write_text(json.dumps({hex(a % 2**64): n for _, a, n in rows}))
    back = mapping_files.read_mapping_object_json(spark, str(single))
    assert sorted(tuple(r) for r in back.collect()) == sorted((a, n) for _, a, n in rows)


def test_issue_table_round_trip(spark, tmp_path):
    table = with_text(issues.ranked_issues(
        findings(spark, long=[(1, "a", 600)], cpu=[("b", 6, 300, 50)])
    ))
    path = str(tmp_path / "issues")
    outputs.write_issues(table, path)
    key = lambda r: r.position
    assert sorted(outputs.read_issues(spark, path).collect(), key=key) == sorted(
        table.collect(), key=key
    )
    assert outputs.read_issues(spark, path, ["other"]).count() == 0


def test_report_files(spark, tmp_path):
    table = with_text(issues.ranked_issues(findings(spark, long=[(1, "a", 600)])))
    reports = report.reports(table, trace_list(spark, "t", "007"), as_of())
    path = tmp_path / "reports"
    outputs.write_reports(reports, str(path), as_of())
    want = {r.trace_id: r.markdown for r in reports.collect()}
    back = outputs.read_reports(spark, str(path)).collect()
    assert {r.trace_id: r.markdown for r in back} == want
    assert {r.file_name for r in back} == {"perfetto_analysis_report_20240115_103045.md"}
    name = "perfetto_analysis_report_20240115_103045.md"
    assert sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file()) == [f"007/{name}", f"t/{name}"]
    assert (path / "t" / name).read_text("utf-8") == want["t"]
    # a later run replaces the reports of its traces only
    later = F.lit("2024-01-16 00:00:00").cast("timestamp")
    assert outputs.write_reports(reports.filter("trace_id = 't'"), str(path), later) == 1
    back = {r.trace_id: r.file_name for r in outputs.read_reports(spark, str(path)).collect()}
    assert back == {"007": name, "t": "perfetto_analysis_report_20240116_000000.md"}


def test_report_folders_of_odd_trace_names(spark, tmp_path):
    names = ["a/b", "a", "..", "x y+z", "100%", "方法", "a//c", "p?q#r"]
    reports = spark.createDataFrame([(n, f"# {n}\n") for n in names], "trace_id string, markdown string")
    assert outputs.write_reports(reports.repartition(3), str(tmp_path / "r"), as_of()) == len(names)
    assert not list(tmp_path.glob("*.md"))
    back = outputs.read_reports(spark, str(tmp_path / "r")).collect()
    assert {(r.trace_id, r.markdown) for r in back} == {(n, f"# {n}\n") for n in names}


def test_slice_model_at_rest(spark, tmp_path):
    tables = {
        "slice": spark.createDataFrame([("t", 1, 2, None, "n", 5, 6)], schema.SLICE),
        "thread_track": spark.createDataFrame([("t", 2, 3)], schema.THREAD_TRACK),
        "thread": spark.createDataFrame([("t", 3, 4, "main", None)], schema.THREAD),
        "process": spark.createDataFrame([("t", 4)], schema.PROCESS),
    }
    slice_model.write_slice_model(tables, str(tmp_path / "model"))
    back = slice_model.read_slice_model(spark, str(tmp_path / "model"))
    for name, df in tables.items():
        assert [tuple(r) for r in back[name].collect()] == [tuple(r) for r in df.collect()]


def two_traces(folder, names=("a", "b")):
    head = struct.pack("<QII", 0, 1, 2)
    for name, leaf in zip(names, (b"void A.x()", b"void B.y()")):
        (folder / name).mkdir(parents=True)
        (folder / name / "sampling").write_bytes(header() + record([5, 6]) * 3 + record([6]))
        (folder / name / "sampling-mapping").write_bytes(head + symbol(5, leaf))


def test_profile_from_files_with_a_map_per_trace(spark, tmp_path):
    two_traces(tmp_path, ("strace_a1_huawei", "strace_b2_vivo"))
    read = binary_files.read_binary_files
    mapping = mapping_files.parse_mapping(read(spark, str(tmp_path), "*-mapping"))
    reports = sample_profile(read(spark, str(tmp_path), "sampling"), mapping)
    got = {(r.trace_id, r.pos): (r.short_name, r["count"], r.percent, r.est_ms)
           for r in reports["self_time"].collect()}
    assert got == {
        ("strace_a1_huawei", 1): ("void A.x", 3, 75.0, 75.0),
        ("strace_a1_huawei", 2): ("native:0x6", 1, 25.0, 25.0),
        ("strace_b2_vivo", 1): ("void B.y", 3, 75.0, 75.0),
        ("strace_b2_vivo", 2): ("native:0x6", 1, 25.0, 25.0),
    }
    assert {r.name: r["count"] for r in reports["inclusive_time"].collect()} == {
        "void A.x()": 3, "void B.y()": 3, "native:0x6": 4
    }
    assert reports["hot_stacks"].filter("pos = 1").count() == 2
    assert reports["rejected"].count() == 0


def test_profile_of_plainly_named_files(spark, tmp_path):
    """The calls of the README on folders without a trace name."""
    two_traces(tmp_path, ("a", "deep/b"))
    (tmp_path / "a" / "notes.txt").write_bytes(b"not a trace")
    files = tp.list_files(spark, str(tmp_path), "sampling")
    symbols = tp.parse_mapping(tp.list_files(spark, str(tmp_path), "*-mapping"))
    profile = tp.sample_profile(files, symbols)
    got = {(r.trace_id, r.pos): (r.name, r["count"]) for r in profile["self_time"].collect()}
    assert got == {
        ("a", 1): ("void A.x()", 3), ("a", 2): ("native:0x6", 1),
        ("deep/b", 1): ("void B.y()", 3), ("deep/b", 2): ("native:0x6", 1),
    }
    assert {(r.trace_id, r.sample_count) for r in profile["sample_count"].collect()} == {
        ("a", 4), ("deep/b", 4)}
    assert profile["headers"].count() == 2 and len(profile) == 7


def test_identity_is_unique_and_shared_by_the_map(spark):
    paths = ["file:/d/a/sampling", "file:/d/a/sampling-mapping", "file:/d/x.bin", "file:/d/x.bin-mapping",
             "file:/d/strace_q_huawei/sampling", "file:/d/sampling", "file:/other/y"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r[0] for r in df.select(binary_files.trace_identity(F.col("path"), "file:/d")).collect()]
    assert got == ["a", "a", "x.bin", "x.bin", "strace_q_huawei", "d", "y"]
    assert binary_files.folder_root(spark, "/d/*/x") == binary_files.folder_root(spark, "file:///d/") == "file:/d"


def test_headers_of_foreign_and_odd_files(spark):
    huge = bytearray(header())
    huge[24:28] = b"\xff\xff\xff\xff"
    rows = [("huge", bytes(huge)), ("text", header(b'{"processId":"main"}')), ("other", b"PK" * 40),
            ("big", header(b'{"processId":99999999999999999999}')), ("none", b"")]
    files = spark.createDataFrame(rows, "trace_id string, content binary")
    got = {r.trace_id: r for r in trace_files.trace_headers(files).collect()}
    assert got["huge"].meta == '{"processId":11550}' and got["huge"].process_id == 11550
    assert got["text"].process_id is None and got["text"].meta == '{"processId":"main"}'
    assert got["big"].process_id is None and got["none"].version is None


def test_analysis_is_replaced_with_its_raw_tables(spark, tmp_path):
    from traceprofile.testing import bindings

    found = tp.run_analysis(bindings.slice_model(spark, "/root/testdata/sf0.001"))
    for _ in range(4):
        tp.write_analysis(found, str(tmp_path / "last"))
    assert len(list((tmp_path / "last" / "tables").iterdir())) == outputs.KEPT_VERSIONS
    with pytest.raises(FileExistsError):
        tp.write_analysis(found, str(tmp_path / "last"), mode="error")
    # a run that breaks between two tables leaves the last analysis
    broken = found._replace(traces=found.traces.select(F.raise_error(F.lit("broken")).alias("x")))
    with pytest.raises(Exception, match="broken"):
        tp.write_analysis(broken, str(tmp_path / "last"))
    back = tp.read_analysis(spark, str(tmp_path / "last"))
    with pytest.raises(FileNotFoundError):
        tp.read_analysis(spark, str(tmp_path / "none"))
    for name in ("issues", "findings", "stacks", "traces", "diagnostics"):
        assert getattr(back, name).count() == getattr(found, name).count() > 0
    tp.write_issues(found.issues, str(tmp_path / "i"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tp.write_issues(found.issues, str(tmp_path / "i"))
    tp.write_issues(found.issues, str(tmp_path / "i"), mode="overwrite")


def test_samples_are_encoded_in_columns(spark):
    from traceprofile.testing import bindings

    rows = [("a", 1, 2, 3, [7, -1, 2**62]), ("a", None, 2, 0, []), (None, 3, 258, 2, [None, 5]),
            ("b", 4, 2, None, None), ("b", 4, 2, 1, [600])]
    schema = "trace_id string, sample_ord bigint, marker int, depth int, frames array<bigint>"
    layout = "trace_id string, sample_ord bigint, record binary"
    found = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(bindings._encode, layout).collect()
    want = [
        None if f is None else struct.pack("<H", m) + bytes(66) + struct.pack("<II", d, d)
        + b"".join(struct.pack("<q", x) for x in f if x is not None) for _, _, m, d, f in rows
    ]
    assert [(r.trace_id, r.sample_ord) for r in found] == [r[:2] for r in rows]
    assert [r.record if r.record is None else bytes(r.record) for r in found] == want


@pytest.mark.parametrize("name", ["self_time", "inclusive_time", "hot_stacks"])
def test_maps_over_the_limit_are_not_broadcast_for_the_size_of_their_listing(spark, tmp_path, monkeypatch, name):
    from tests.test_plans import plan
    from traceprofile.operators import sampling

    names = [f"t{i}" for i in range(4)]
    two_traces(tmp_path, names[:2])
    two_traces(tmp_path, names[2:])
    for i, trace in enumerate(names):  # 60 kB each, 2 kB as a listing
        data = b"".join(symbol(a, f"void C{i}.m{a}()".encode().ljust(100)) for a in range(5, 550))
        (tmp_path / trace / "sampling-mapping").write_bytes(struct.pack("<QII", 0, 1, 2) + data)
    files, maps = (tp.list_files(spark, str(tmp_path), p) for p in ("sampling", "*-mapping"))
    plans, write = [], sampling.materialize
    monkeypatch.setattr(sampling, "materialize", lambda df, n: plans.append(plan(df)) or write(df, n))

    def report():
        plans.clear()
        found = tp.sample_profile(files, tp.parse_mapping(maps))[name]
        rows = sorted(tuple(r) for r in found.collect())
        joins = "\n".join([*plans, plan(found)])
        return rows, "SortMergeJoin LeftOuter" in joins, bool(
            re.search(r"\) BroadcastHashJoin.*\nLeft keys \[2\]: \[trace_id.*\n.*\nJoin type: LeftOuter", joins))

    small, sorted_, sent = report()
    assert sent and not sorted_
    spark.conf.set("spark.traceprofile.broadcastBytes", "100000")
    try:
        large, sorted_, sent = report()
    finally:
        spark.conf.unset("spark.traceprofile.broadcastBytes")
    assert sorted_ and not sent and large == small and len(small) >= 4


def test_names_are_listed_by_few_tasks(spark, tmp_path):
    most = spark.sparkContext.defaultParallelism * binary_files.LISTING_TASKS
    for i in range(most + 20):
        (tmp_path / f"{i}.bin").write_bytes(b"\x04")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")  # a task per file
    try:
        for listed in (tp.list_files, tp.list_file_versions):
            found = listed(spark, str(tmp_path), "*.bin")
            assert found.rdd.getNumPartitions() <= most and found.count() == most + 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
