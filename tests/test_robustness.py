"""Hot traces, failing parts, odd samples, staged tables and settings."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import traceprofile as tp
from tests.compare import force_shuffles
from traceprofile import schema
from traceprofile.functions import annotate
from traceprofile.operators import context, sampling
from traceprofile.operators import diagnostics as D
from traceprofile.plans import analysis, report
from traceprofile.session import materialize, shared_root, staging
from traceprofile.testing import bindings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return bindings.slice_model(spark, SF)


def samples(spark, rows):
    return spark.createDataFrame(
        [("t", i, 2, len(f), f) for i, f in rows], schema.SAMPLES)


def names(spark, rows, layout="addr bigint, name string"):
    return spark.createDataFrame(rows, layout)


def test_an_empty_stack_counts_but_has_no_leaf(spark):
    table = samples(spark, [(1, [5]), (2, []), (3, [5, 6]), (4, [])])
    symbols = names(spark, [(5, "a()")])
    own = sampling.self_time(table, symbols).collect()
    assert [(r.name, r["count"], r.percent) for r in own] == [("a()", 2, 50.0)]
    assert {r.name: r["count"] for r in sampling.inclusive_time(table, symbols).collect()} == {
        "a()": 2, "native:0x6": 1}
    assert sampling.sample_count(table).first().sample_count == 4


def test_order_of_ties_in_deep_stacks_with_large_numbers(spark):
    deep = [10_000 + i for i in range(600)]
    first = 2**60
    table = samples(spark, [(first, deep), (first + 1, list(reversed(deep)))])
    symbols = names(spark, [(a, f"m{a}()") for a in deep])
    got = [r.name for r in sampling.inclusive_time(table, symbols, n=600).orderBy("pos").collect()]
    assert got == [f"m{a}()" for a in deep]
    # two addresses of one name: its place is that of the one met first
    shared = names(spark, [(a, "last()" if a in (10_599, 10_300) else f"m{a}()") for a in deep])
    got = [r.name for r in sampling.inclusive_time(table, shared, n=600).orderBy("pos").collect()]
    assert got.index("last()") == 300 and len(got) == 599


def test_one_name_per_address(spark):
    table = samples(spark, [(1, [5, 6])])
    twice = names(spark, [("f1", 5, "old()"), ("f2", 5, "new()"), ("f2", 6, "b()")],
                  "path string, addr bigint, name string")
    assert {(r.name, r.percent) for r in sampling.inclusive_time(table, twice).collect()} == {
        ("new()", 100.0), ("b()", 100.0)}
    plain = names(spark, [(5, "x()"), (5, "y()")])
    assert [r.name for r in sampling.self_time(table, plain).collect()] == ["y()"]


def test_sums_do_not_overflow(spark, tables):
    big = 2**62
    slices = spark.createDataFrame(
        [("t", i, 1, None, "void app.Big.run()", 0, big) for i in range(8)], schema.SLICE)
    row = D.cpu_heavy_all_threads({"slice": slices}).first()
    assert row.total_ms == pytest.approx(8 * big / 1e6)


def test_a_diagnostic_that_fails_at_run_time_leaves_the_others(spark, tables):
    def broken(t):
        return D.frame_jank(t).withColumn("dur", F.raise_error(F.lit("broken")).cast("bigint"))

    results, status, failures = D.run_diagnostics(tables, {**D.DIAGNOSTICS, "frame_jank": broken})
    assert {r.diagnostic: r.ok for r in status.collect()} == {
        "long_slices": True, "frame_jank": False, "cpu_heavy": True, "main_thread_io": True}
    assert results["frame_jank"].count() == 0 and results["long_slices"].count() > 0


def test_analysis_goes_on_without_a_failing_part(tables, monkeypatch):
    def broken(t):
        raise ValueError("no")

    monkeypatch.setattr(D, "cpu_heavy", broken)
    found = analysis.run_analysis(tables)
    assert {r.diagnostic: r.ok for r in found.diagnostics.collect()} == {
        "long_slices": True, "frame_jank": True, "main_thread_io": True, "cpu_heavy": False}
    assert found.issues.count() > 0
    real = D.slice_findings

    def partly(t, searches):
        if len(searches) > 1 or searches[0].kind == "io":
            raise ValueError("no")
        return real(t, searches)

    monkeypatch.setattr(D, "slice_findings", partly)
    found = analysis.run_analysis(tables)
    assert {r.diagnostic: r.ok for r in found.diagnostics.collect()} == {
        "long_slices": True, "frame_jank": True, "main_thread_io": False, "cpu_heavy": False}
    assert {r.kind for r in found.findings.select("kind").distinct().collect()} == {"long", "jank"}


def test_no_report_on_a_trace_that_is_not_ready(spark, tables):
    more = {**tables, "thread": tables["thread"].unionByName(
        spark.createDataFrame([("bare", 1, 1, "main", 1)], schema.THREAD))}
    more["thread_track"] = tables["thread_track"].unionByName(
        spark.createDataFrame([("tracks", 1, 1)], schema.THREAD_TRACK))
    found = analysis.run_analysis(more)
    status = {r.trace_id: r for r in found.traces.collect()}
    assert not status["bare"].ready and not status["tracks"].ready
    assert status["bare"].error == analysis.NOT_LOADED
    written = {r.trace_id for r in report.reports(found.issues, found.traces, F.lit("2024-01-15 10:30:45").cast("timestamp")).collect()}
    assert written == {t for t, r in status.items() if r.ready} and "bare" not in written


@pytest.mark.parametrize("shuffled", [False, True])
def test_slices_meet_windows_as_in_a_plain_comparison(spark, shuffled):
    session = spark.newSession()
    if shuffled:
        force_shuffles(session)
    rng = random.Random(8)
    spans = [0, 1, 2, 5, 10**6, 2**20, 2**20 + 1, 3 * 10**7, 10**9, 7 * 10**9]
    rows = [(rng.choice("ab"), i, 1, None, "n", rng.choice([-1, 1]) * rng.randrange(3 * 10**9),
             rng.choice([-5, -10**6, *spans])) for i in range(1500)]
    slices = session.createDataFrame(rows, schema.SLICE)
    found = [(t, p, "long", p, ts, dur) for p, (t, ts, dur) in enumerate(
        (rng.choice("abc"), rng.randrange(2 * 10**9), rng.choice(spans)) for _ in range(40)
    )] + [("a", 90, "cpu", None, None, None)]
    issues = session.createDataFrame(
        found, "trace_id string, position int, kind string, id bigint, ts bigint, dur bigint"
    )
    for pad in ("tenth", "none"):
        windows = context.windows_of(issues, pad).collect()
        want = sorted(
            (w.trace_id, w.position, s[1], min(s[5] + s[6], w.end) - max(s[5], w.start))
            for w in windows for s in rows
            if s[0] == w.trace_id and s[5] < w.end and s[5] + s[6] > w.start
        )
        got = context.slices_in_windows(slices, issues, pad).collect()
        assert sorted((r.trace_id, r.position, r.slice_id, r.overlap_ns) for r in got) == want
    assert context.slices_in_windows(slices, issues.filter("false")).collect() == []
    assert context.slices_in_windows(slices.filter("false"), issues).collect() == []


def test_slices_outside_the_windows_leave_before_a_shuffle(spark, tables):
    slices = tables["slice"]
    issues = analysis.staged_issues(tables)
    plan = context.slices_in_windows(slices, issues)._jdf.queryExecution().executedPlan().toString()
    assert "filter(" not in plan and "CartesianProduct" not in plan
    assert re.search(r"BroadcastHashJoin \[trace_id[^]]*\], \[trace_id[^]]*\], Inner, BuildRight, "
                     r"\(\(ts.*high", plan) or re.search(r"ts#\d+L < high", plan)


def test_staged_tables_are_released(spark):
    with staging(spark):
        table = materialize(spark.range(5), "short-lived")
        paths = table.inputFiles()
        assert table.count() == 5
    assert paths and not any(os.path.exists(p.removeprefix("file://")) for p in paths)
    assert os.path.isdir(shared_root(spark))


def test_partition_number_follows_the_input(spark):
    session = spark.newSession()
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    tp.configure(session)
    assert session.conf.get(key, None) is None
    tp.configure(session, input_bytes=10 * 2**40)
    assert session.conf.get(key) == str(10 * 2**40 // 2**27)
    tp.configure(session, input_bytes=1)
    assert session.conf.get(key) == session.conf.get("spark.sql.shuffle.partitions")


def test_io_is_a_cause_on_the_main_thread_only(spark):
    df = spark.createDataFrame([("readFile()", True), ("readFile()", False), ("JSONObject.put()", False)],
                               "name string, on_main_thread boolean")
    got = [(r.name, r.on_main_thread, r.tag) for r in annotate.pattern_tags(df).collect()]
    assert got == [("readFile()", True, "io"), ("JSONObject.put()", False, "json")]
