"""Turn diagnostic hits into rated, de-duplicated, ordered issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceprofile.functions.predicates import locate_badge, passes_issue_threshold
from traceprofile.functions.text import to_fixed1
from traceprofile.operators.callstack import stack_text

# ---------------------------------------------------------------------------
# Severity bounds (ms), kind order and issue texts. {name}, {ms},
# {count}, {avg} and {ratio} are filled per row.
# ---------------------------------------------------------------------------
SEVERITY_ABOVE_MS = (("P0", 500), ("P1", 200), ("P2", 100))
LOWEST_SEVERITY = "P3"
SEVERITIES = ("P0", "P1", "P2", "P3")
FRAME_BUDGET_MS = 16.6

KINDS = ("long", "jank", "io", "cpu")  # order in which equal issues are listed
TITLE_PREFIX = {
    "long": "主线程长耗时: ",
    "jank": "帧卡顿: ",
    "io": "主线程 I/O: ",
    "cpu": "CPU 密集型方法: ",
}
WHAT = {
    "long": "主线程方法 `{name}` 单次执行耗时 {ms}ms，可能导致 UI 卡顿",
    "jank": "帧渲染方法 `{name}` 耗时 {ms}ms，超过 16.6ms 帧预算",
    "io": "主线程上执行了 I/O 操作 `{name}`，耗时 {ms}ms",
    "cpu": "方法 `{name}` 被调用 {count} 次，总耗时 {ms}ms（平均 {avg}ms/次）",
}
DURATION = {
    "long": "{ms}ms",
    "jank": "{ms}ms",
    "io": "{ms}ms",
    "cpu": "{ms}ms ({count}次, 平均{avg}ms)",
}
IMPACT_LONG_ABOVE_MS = (
    (500, "严重阻塞主线程，用户可感知明显卡顿或无响应"),
    (200, "主线程阻塞时间较长，可能导致掉帧和交互延迟"),
    (100, "主线程有一定阻塞，可能在低端设备上引起卡顿"),
)
IMPACT_LONG_OTHER = "轻微影响，建议关注"
IMPACT_JANK = "帧渲染超时 {ratio} 倍，用户可感知明显掉帧"
IMPACT_IO = "主线程 I/O 操作会阻塞 UI 渲染，导致卡顿和 ANR 风险"
IMPACT_CPU_ABOVE_MS = (
    (500, "累计耗时极高，严重消耗 CPU 资源，影响整体性能"),
    (200, "累计耗时较高，占用较多 CPU 资源"),
)
IMPACT_CPU_OTHER = "有一定 CPU 开销，建议关注"
SUGGESTION = {
    "long": "考虑将 `{name}` 的耗时操作移至后台线程，或优化其执行逻辑以减少耗时",
    "jank": "优化帧渲染流程，减少 `{name}` 中的同步操作，避免在 doFrame 中执行耗时任务",
    "io": "将 `{name}` 移至后台线程执行，使用异步 API 或 WorkManager 处理 I/O 操作",
    "cpu": "优化 `{name}` 的实现，减少调用频次或单次执行耗时，考虑缓存计算结果",
}
DURATION_LABEL = "耗时: "
# ---------------------------------------------------------------------------

ISSUE_COLUMNS = (
    "trace_id", "kind", "position", "severity", "id", "title", "what", "where", "duration",
    "duration_raw", "impact", "call_stack", "suggestion", "ts", "dur",
)


def severity(ms: Column) -> Column:
    """P0 above 500 ms, P1 above 200, P2 above 100, else P3."""
    chain = F.when(F.lit(False), "")
    for label, bound in SEVERITY_ABOVE_MS:
        chain = chain.when(ms > bound, label)
    return chain.otherwise(LOWEST_SEVERITY)


def severity_rank(label: Column) -> Column:
    """0 for P0 … 3 for P3, 4 for anything else."""
    position = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), label)
    return F.coalesce(F.when(position > 0, position - 1), F.lit(len(SEVERITIES))).cast("int")


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Column text of ``template`` with its {fields} replaced by columns."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        field, _, rest = tail.partition("}")
        parts += [F.lit(head)] if head else []
        parts.append(values[field])
    parts += [F.lit(rest)] if rest else []
    return F.concat(*parts)


def _by_kind(texts: dict[str, Column]) -> Column:
    chain = F.when(F.lit(False), "")
    for kind, text in texts.items():
        chain = chain.when(F.col("kind") == kind, text)
    return chain


def _tiers(ms: Column, tiers: tuple, otherwise: str) -> Column:
    chain = F.when(F.lit(False), "")
    for bound, text in tiers:
        chain = chain.when(ms > bound, text)
    return chain.otherwise(otherwise)


def union_findings(slice_hits: DataFrame, cpu_hits: DataFrame) -> DataFrame:
    """Slice and aggregate hits as one table with the layout ``FINDINGS``."""
    both = slice_hits.drop("parent_id").unionByName(cpu_hits, allowMissingColumns=True)
    return both.select(
        "trace_id", "kind", "pos", "id", "name", "dur_ms", "ts", "dur",
        "count", "total_ms", "avg_ms",
    )


def counted_hits(findings: DataFrame) -> DataFrame:
    """Hits that count as issues, with the duration that rates them."""
    return findings.filter(
        passes_issue_threshold(F.col("kind"), F.col("dur_ms"))
    ).withColumn("duration_raw", F.coalesce("total_ms", "dur_ms"))


def issue_texts(hits: DataFrame) -> DataFrame:
    """Add severity and texts to counted hits."""
    raw = F.col("duration_raw")
    fields = ("name", "ms", "count", "avg", "ratio")
    values = {f: F.col(f"t.{f}") for f in fields}
    texts = F.struct(
        F.col("name"), to_fixed1(raw).alias("ms"), F.col("count").cast("string").alias("count"),
        to_fixed1(F.col("avg_ms")).alias("avg"),
        to_fixed1(raw / F.lit(FRAME_BUDGET_MS)).alias("ratio"),
    )

    def filled(templates: dict[str, str]) -> Column:
        return _by_kind({k: _fill(t, values) for k, t in templates.items()})

    impact = {
        "long": _tiers(raw, IMPACT_LONG_ABOVE_MS, IMPACT_LONG_OTHER),
        "jank": _fill(IMPACT_JANK, values),
        "io": F.lit(IMPACT_IO),
        "cpu": _tiers(raw, IMPACT_CPU_ABOVE_MS, IMPACT_CPU_OTHER),
    }
    return hits.withColumn("t", texts).select(
        *hits.columns,
        severity(raw).alias("severity"),
        filled({k: f"{prefix}{{name}}" for k, prefix in TITLE_PREFIX.items()}).alias("title"),
        filled(WHAT).alias("what"),
        F.concat(F.lit("`"), F.col("name"), F.lit("`")).alias("where"),
        filled(DURATION).alias("duration"),
        _by_kind(impact).alias("impact"),
        filled(SUGGESTION).alias("suggestion"),
    )


def ranked_issues(findings: DataFrame) -> DataFrame:
    """Worst hit per method and kind, in list order, without call stacks.

    The worst hit has the highest severity, then the longest duration; the first of
    equals stays. A method keeps the list place of its first hit. Findings hold at most
    the sum of the diagnostic limits per trace, so each sort is small.
    """
    raw = F.col("duration_raw")
    hits = counted_hits(findings).withColumn("rank", severity_rank(severity(raw)))
    fields = ["id", "name", "ts", "dur", "duration_raw", "count", "avg_ms"]
    best = F.min(F.struct("rank", (-raw).alias("falling"), "pos", F.struct(*fields).alias("hit")))
    worst = (
        hits.groupBy("trace_id", "kind", F.col("name").alias("key"))
        .agg(best.alias("best"), F.min("pos").alias("first_pos"))
        .select("trace_id", "kind", "best.rank", "best.falling", "first_pos", "best.hit.*")
    )
    kind_order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    order = Window.partitionBy("trace_id").orderBy("rank", "falling", kind_order, "first_pos")
    placed = worst.withColumn("position", F.row_number().over(order))
    return issue_texts(placed).select(*[c for c in ISSUE_COLUMNS if c != "call_stack"])


def attach_stacks(issues: DataFrame, stacks: DataFrame) -> DataFrame:
    """Add ``call_stack`` text; issues without a stack get an empty text."""
    texts = stacks.select(
        "trace_id", F.col("slice_id").alias("id"),
        stack_text(F.col("stack"), F.col("truncated")).alias("call_stack"),
    )
    return (
        issues.join(texts, ["trace_id", "id"], "left")
        .withColumn("call_stack", F.coalesce("call_stack", F.lit("")))
        .select(*ISSUE_COLUMNS)
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    """Issues per trace and severity."""
    return issues.groupBy("trace_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
        F.count(F.lit(1)).alias("total"),
    )


def issue_seeds(issues: DataFrame) -> DataFrame:
    """Distinct slices whose caller chains the issues or hits need."""
    return (
        issues.filter(F.col("id").isNotNull())
        .select("trace_id", F.col("id").alias("slice_id"))
        .distinct()
    )


def issue_listing(issues: DataFrame) -> DataFrame:
    """One line per issue: label without the kind prefix, duration and badge."""
    bare = F.col("title")
    for prefix in TITLE_PREFIX.values():  # the first occurrence of each goes
        bare = F.regexp_replace(bare, f"(?s)^(.*?){prefix}", "$1")
    return issues.select(
        "trace_id", "position",
        F.concat(F.lit("["), F.col("severity"), F.lit("] "), bare).alias("label"),
        F.concat(F.lit(DURATION_LABEL), F.col("duration")).alias("duration"),
        locate_badge(F.col("ts"), F.col("dur")).alias("badge"),
    )


def focus_window(issues: DataFrame, pad: str = "tenth") -> DataFrame:
    """Time range to show for an issue. ``pad``: ``tenth`` of the duration rounded to
    nearest, ``third`` cut to an integer, or ``none``."""
    ts, dur = F.col("ts"), F.col("dur")
    if pad == "tenth":
        margin = F.floor(dur.cast("double") * F.lit(0.1) + F.lit(0.5)).cast("bigint")
        start = F.when(ts - margin > 0, ts - margin).otherwise(ts)
    elif pad == "third":
        margin = F.expr("dur div 3")
        start = ts - margin
    elif pad == "none":
        margin = F.lit(0).cast("bigint")
        start = ts
    else:
        raise ValueError(f"unknown padding: {pad}")
    return (
        issues.filter(ts.isNotNull() & dur.isNotNull())
        .withColumn("window_start", start)
        .withColumn("window_width", dur + margin * 2)
    )
