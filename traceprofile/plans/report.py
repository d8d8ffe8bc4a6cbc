"""Markdown reports, one per trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceprofile.functions.text import date_time_text
from traceprofile.operators.issues import SEVERITIES, severity_counts

# ---------------------------------------------------------------------------
# Texts of the report.
# ---------------------------------------------------------------------------
REPORT_TITLE = "# Perfetto Trace 性能分析报告"
ANALYSIS_TIME = "**分析时间**: "
SUMMARY_HEADING = "## Summary"
ISSUES_HEADING = "## Issues"
NO_ISSUES = "未发现显著性能问题。"
HEALTHY_SUMMARY = "本次 trace 分析未发现显著性能问题，应用整体运行状况良好。"
FOUND_PREFIX = "本次分析共发现 "
FOUND_SUFFIX = " 个性能问题"
OF_WHICH = "，其中 "
SEVERITY_PARTS = {
    "P0": " 个 P0（阻塞级）",
    "P1": " 个 P1（严重）",
    "P2": " 个 P2（中等）",
    "P3": " 个 P3（轻微）",
}
PART_SEPARATOR = "、"
FULL_STOP = "。"
ADVICE = {
    "P0": "存在阻塞级问题，建议优先处理 P0 问题以改善用户体验。",
    "P1": "建议优先关注 P1 级别问题。",
}
# ---------------------------------------------------------------------------


def summary_text(counts: dict[str, Column], total: Column) -> Column:
    """Summary sentence from the number of issues per severity."""
    parts = [
        F.when(counts[s] > 0, F.concat(counts[s].cast("string"), F.lit(SEVERITY_PARTS[s])))
        for s in SEVERITIES
    ]
    listed = F.concat_ws(PART_SEPARATOR, *parts)
    found = F.concat(
        F.lit(FOUND_PREFIX), total.cast("string"), F.lit(FOUND_SUFFIX),
        F.when(listed != "", F.concat(F.lit(OF_WHICH), listed)).otherwise(""),
        F.lit(FULL_STOP),
        F.when(counts["P0"] > 0, ADVICE["P0"]).when(counts["P1"] > 0, ADVICE["P1"]).otherwise(""),
    )
    return F.when(total > 0, found).otherwise(HEALTHY_SUMMARY)


def _issue_block() -> Column:
    stack = F.concat(
        F.lit("- **Call Stack**:\n  ```\n  "),
        F.replace("call_stack", F.lit("\n"), F.lit("\n  ")),
        F.lit("\n  ```\n"),
    )
    return F.concat(
        F.lit("### ["), F.col("severity"), F.lit("] "), F.col("title"),
        F.lit("\n- **What**: "), F.col("what"),
        F.lit("\n- **Where**: "), F.col("where"),
        F.lit("\n- **Duration**: "), F.col("duration"),
        F.lit("\n- **Impact**: "), F.col("impact"),
        F.lit("\n"), F.when(F.col("call_stack") != "", stack).otherwise(""),
        F.lit("- **Suggestion**: "), F.col("suggestion"), F.lit("\n"),
    )


def _totals(traces: DataFrame, summary: DataFrame) -> DataFrame:
    """``summary`` of every trace; of a status table only the traces that are ready."""
    if "ready" in traces.columns:
        traces = traces.filter("ready")
    filled = traces.select("trace_id").distinct().join(summary, "trace_id", "left")
    return filled.fillna(0, [c for c in summary.columns if c != "trace_id" and c != "blocks"])


def report_summary(issues: DataFrame, traces: DataFrame) -> DataFrame:
    """``(trace_id, summary)`` for every trace, also those without issues."""
    totals = _totals(traces, severity_counts(issues))
    counts = {s: F.col(s.lower()) for s in SEVERITIES}
    return totals.select("trace_id", summary_text(counts, F.col("total")).alias("summary"))


def reports(issues: DataFrame, traces: DataFrame, as_of: Column) -> DataFrame:
    """``(trace_id, markdown)`` for every trace, also those without issues.

    Counts and blocks come from one aggregation; a trace has at most as many issues as
    the diagnostics report rows, so its block list is bounded.
    """
    per_trace = (
        issues.select("trace_id", "position", "severity", _issue_block().alias("block"))
        .groupBy("trace_id")
        .agg(
            *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
            F.count(F.lit(1)).alias("total"),
            F.array_sort(F.collect_list(F.struct("position", "block"))).alias("blocks"),
        )
    )
    totals = _totals(traces, per_trace)
    counts = {s: F.col(s.lower()) for s in SEVERITIES}
    body = F.when(
        F.col("total") > 0,
        F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"),
    ).otherwise(f"{NO_ISSUES}\n")
    markdown = F.concat(
        F.lit(f"{REPORT_TITLE}\n\n{ANALYSIS_TIME}"), date_time_text(as_of),
        F.lit(f"\n\n{SUMMARY_HEADING}\n\n"), summary_text(counts, F.col("total")),
        F.lit(f"\n\n{ISSUES_HEADING}\n\n"), body,
    )
    return totals.select("trace_id", markdown.alias("markdown"))
