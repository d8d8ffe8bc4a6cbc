"""Rating, de-duplication, order and texts of issues; reports."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from traceprofile import schema
from traceprofile.operators import context, issues
from traceprofile.plans import report


def findings(spark, long=(), jank=(), io=(), cpu=()):
    """Rows in the order given; slice kinds are (id, name, ms), cpu (name, n, total, avg)."""
    rows = []
    for kind, hits in (("long", long), ("jank", jank), ("io", io)):
        for pos, (i, name, ms) in enumerate(hits, 1):
            ns = int(ms * 1e6)
            rows.append(("t", kind, pos, i, name, float(ms), 1000 * i, ns, None, None, None))
    for pos, (name, n, total, avg) in enumerate(cpu, 1):
        rows.append(("t", "cpu", pos, None, name, None, None, None, n, float(total), float(avg)))
    return spark.createDataFrame(rows, schema.FINDINGS)


def listed(df):
    return df.orderBy("trace_id", "position").collect()


def with_text(rated, stacks=None):
    if stacks is None:
        stacks = rated.sparkSession.createDataFrame([], schema.STACKS)
    return issues.attach_stacks(rated, stacks)


def as_of():
    return F.expr("TIMESTAMP_NTZ '2024-01-15 10:30:45'")


def trace_list(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "trace_id string")


def test_severity_bounds_are_strict(spark):
    cases = {501: "P0", 1000: "P0", 500.01: "P0", 500: "P1", 201: "P1", 200.01: "P1", 300: "P1",
             200: "P2", 101: "P2", 100.01: "P2", 150: "P2", 100: "P3", 50: "P3", 0: "P3", 1: "P3"}
    df = spark.createDataFrame([(float(ms),) for ms in cases], "ms double")
    assert [r[0] for r in df.select(issues.severity(F.col("ms"))).collect()] == list(cases.values())


def test_severity_ranks(spark):
    df = spark.createDataFrame([("P0",), ("P1",), ("P2",), ("P3",), ("P9",)], "s string")
    assert [r[0] for r in df.select(issues.severity_rank(F.col("s"))).collect()] == [0, 1, 2, 3, 4]


def test_no_findings_no_issues(spark):
    assert issues.ranked_issues(findings(spark)).count() == 0


@pytest.mark.parametrize("kind", ["long", "io"])
def test_short_hits_are_left_out(spark, kind):
    hits = {kind: [(1, "fast", 30), (2, "edge", 50), (3, "slow", 600)]}
    assert [r.title[-4:] for r in listed(issues.ranked_issues(findings(spark, **hits)))] == ["slow"]


def test_frame_and_cpu_hits_have_no_lower_bound(spark):
    rated = issues.ranked_issues(
        findings(spark, jank=[(1, "doFrame", 17)], cpu=[("calm", 9, 0.4, 0.04)])
    )
    assert [r.kind for r in listed(rated)] == ["jank", "cpu"]


def test_order_by_severity_then_duration(spark):
    rated = issues.ranked_issues(findings(
        spark, long=[(1, "minor", 80), (2, "blocking", 600), (3, "moderate", 150), (4, "severe", 300),
                     (5, "worse", 900)],
    ))
    assert [(r.severity, r.duration_raw) for r in listed(rated)] == [
        ("P0", 900.0), ("P0", 600.0), ("P1", 300.0), ("P2", 150.0), ("P3", 80.0)
    ]


def test_worst_hit_per_method_within_its_kind(spark):
    rated = issues.ranked_issues(findings(
        spark, long=[(1, "twice", 150), (2, "twice", 600)], io=[(3, "twice", 300)],
    ))
    assert [(r.kind, r.severity, r.id) for r in listed(rated)] == [("long", "P0", 2), ("io", "P1", 3)]


def test_equal_issues_keep_kind_order_and_first_place(spark):
    rated = issues.ranked_issues(findings(
        spark,
        long=[(1, "b", 60), (2, "a", 80), (3, "b", 80)], jank=[(4, "doFrame", 80)],
        io=[(5, "File", 80)], cpu=[("c", 6, 80, 13.3)],
    ))
    # "b" was listed first by its shorter hit and keeps that place
    assert [(r.kind, r.id) for r in listed(rated)] == [
        ("long", 3), ("long", 2), ("jank", 4), ("io", 5), ("cpu", None)
    ]


def test_random_findings_match_a_plain_model(spark):
    rng = random.Random(8)
    names = ["a", "b", "c", "jank:a"]
    hits = {k: [(i, rng.choice(names), rng.choice([10, 50, 51, 100, 101, 250, 501, 502]))
                for i in range(rng.randrange(20))] for k in ("long", "jank", "io")}
    cpu = [(rng.choice(names), 6, rng.choice([10, 150, 501]), 1) for _ in range(6)]
    best = {}
    rows = [(k, i, n, ms) for k in ("long", "jank", "io") for i, n, ms in hits[k]
            if k == "jank" or ms > 50] + [("cpu", None, n, t) for n, _, t, _ in cpu]

    def rank(ms):
        return 0 if ms > 500 else 1 if ms > 200 else 2 if ms > 100 else 3

    for kind, i, name, ms in rows:
        old = best.get((kind, name))
        if old is None or rank(ms) < rank(old[1]) or (rank(ms) == rank(old[1]) and ms > old[1]):
            best[kind, name] = (i, ms)
    want = [(k[0], v[0], float(v[1])) for k, v in
            sorted(best.items(), key=lambda kv: (rank(kv[1][1]), -kv[1][1]))]
    rated = issues.ranked_issues(findings(spark, **hits, cpu=cpu))
    assert [(r.kind, r.id, r.duration_raw) for r in listed(rated)] == want


def test_texts(spark):
    rows = {r.kind: r for r in issues.ranked_issues(findings(
        spark, long=[(1, "a()", 600.04)], jank=[(2, "doFrame", 33.2)], io=[(3, "File", 120)],
        cpu=[("busy", 7, 350.25, 50.0357)],
    )).collect()}
    assert rows["long"].title == "主线程长耗时: a()" and rows["long"].duration == "600.0ms"
    assert rows["long"].where == "`a()`" and rows["long"].impact.startswith("严重阻塞")
    assert rows["jank"].impact == "帧渲染超时 2.0 倍，用户可感知明显掉帧"
    assert rows["io"].what == "主线程上执行了 I/O 操作 `File`，耗时 120.0ms"
    assert rows["cpu"].duration == "350.3ms (7次, 平均50.0ms)"
    assert rows["cpu"].impact == "累计耗时较高，占用较多 CPU 资源"
    assert (rows["cpu"].id, rows["cpu"].ts, rows["cpu"].dur) == (None, None, None)


def test_listing_drops_the_prefix_and_marks_aggregates(spark):
    rated = issues.ranked_issues(findings(
        spark, long=[(1, "帧卡顿: odd", 600)], cpu=[("busy", 7, 10, 1)],
    ))
    rows = issues.issue_listing(rated).orderBy("position").collect()
    assert [(r.label, r.badge) for r in rows] == [
        ("[P0] odd", "locate"), ("[P3] busy", "aggregated")
    ]
    assert rows[0].duration == "耗时: 600.0ms"


def test_focus_windows(spark):
    rows = [("t", 100, 15), ("t", 1, 15), ("t", 1000, 100)]
    df = spark.createDataFrame(rows, "trace_id string, ts long, dur long")

    def windows(pad):
        return [(r.window_start, r.window_width) for r in issues.focus_window(df, pad).collect()]

    assert windows("tenth") == [(98, 19), (1, 19), (990, 120)]
    assert windows("third") == [(95, 25), (-4, 25), (967, 166)]
    assert windows("none") == [(100, 15), (1, 15), (1000, 100)]
    with pytest.raises(ValueError):
        issues.focus_window(df, "half")


def test_context_counts_only_overlapping_slices_of_the_trace(spark):
    rated = issues.ranked_issues(findings(spark, long=[(1, "slow", 100)]))  # ts 1000, 100 ms
    start, end = 1000, 1000 + 100_000_000
    rows = [("t", 1, 1, None, "slow", start, 100_000_000), ("t", 2, 1, 1, "in", start + 5, 10),
            ("t", 3, 1, None, "before", 0, 1000), ("t", 4, 1, None, "after", end, 10),
            ("u", 5, 1, None, "other", start, 10)]
    slices = spark.createDataFrame(rows, schema.SLICE)
    row = context.issue_context(slices, rated, pad="none").first()
    assert (row.slice_count, row.overlap_ns, row.longest_ns) == (2, 100_000_010, 100_000_000)


def test_severity_counts(spark):
    rated = issues.ranked_issues(findings(spark, long=[(1, "a", 600), (2, "b", 60), (3, "c", 70)]))
    row = issues.severity_counts(rated).first()
    assert (row.p0, row.p1, row.p2, row.p3, row.total) == (1, 0, 0, 2, 3)


def test_report_of_a_healthy_trace(spark):
    empty = with_text(issues.ranked_issues(findings(spark)))
    text = report.reports(empty, trace_list(spark, "t"), as_of()).first().markdown
    assert text == (
        "# Perfetto Trace 性能分析报告\n\n**分析时间**: 2024-01-15 10:30:45\n\n## Summary\n\n"
        "本次 trace 分析未发现显著性能问题，应用整体运行状况良好。\n\n## Issues\n\n未发现显著性能问题。\n"
    )


def test_report_lists_issues_with_stacks(spark):
    stack = [("slowMethod", 1, 2), ("rootMethod", 2, -1)]
    stacks = spark.createDataFrame([("t", 1, stack, False)], schema.STACKS)
    rated = issues.ranked_issues(findings(spark, long=[(2, "minor", 80), (1, "slowMethod", 600)]))
    rows = report.reports(with_text(rated, stacks), trace_list(spark, "t", "u"), as_of()).collect()
    text = {r.trace_id: r.markdown for r in rows}
    assert "未发现显著性能问题" in text["u"]
    body = text["t"].split("## Issues\n\n")[1]
    assert body.startswith(
        "### [P0] 主线程长耗时: slowMethod\n- **What**: 主线程方法 `slowMethod` 单次执行耗时 600.0ms，可能导致 UI 卡顿\n"
        "- **Where**: `slowMethod`\n- **Duration**: 600.0ms\n- **Impact**: 严重阻塞主线程，用户可感知明显卡顿或无响应\n"
        "- **Call Stack**:\n  ```\n  rootMethod()\n    → slowMethod()          ← 瓶颈\n  ```\n- **Suggestion**: "
    )
    assert body.count("**Call Stack**") == 1 and body.endswith("\n") and not body.endswith("\n\n")
    assert re.findall(r"### \[(P\d)\]", body) == ["P0", "P3"]
    assert "本次分析共发现 2 个性能问题，其中 1 个 P0（阻塞级）、1 个 P3（轻微）。存在阻塞级问题" in text["t"]


@pytest.mark.parametrize(("ms", "advice"), [
    (300, "建议优先关注 P1 级别问题。"), (150, "1 个 P2（中等）。"), (60, "1 个 P3（轻微）。"),
])
def test_summary_advice(spark, ms, advice):
    rated = issues.ranked_issues(findings(spark, long=[(1, "a", ms)]))
    assert report.report_summary(rated, trace_list(spark, "t")).first().summary.endswith(advice)
