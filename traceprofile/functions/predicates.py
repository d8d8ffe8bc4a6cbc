"""Row predicates as Column expressions. They stay inside code generation and, where
they touch slice columns only, below the joins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Word lists, prefixes and thresholds that decide which rows count.
# ---------------------------------------------------------------------------
FRAMEWORK_PREFIXES = (
    "void com.android.internal.",
    "void android.",
    "boolean android.",
    "int android.",
    "java.lang.Object android.",
    "void java.",
    "java.lang.",
    "void kotlin.",
    "kotlin.",
    "java.lang.Object kotlin.",
    "kotlinx.coroutines.Job kotlin.",
    "void kotlinx.coroutines.",
    "java.lang.Object kotlinx.coroutines.",
    "kotlinx.coroutines.",
)
FRAME_KEYWORDS = ("doFrame", "Choreographer", "traversal")
IO_KEYWORDS = ("Binder", "sqlite", "SharedPreferences", "File", "network", "http")
FRAME_BUDGET_NS = 16_600_000
ISSUE_THRESHOLD_MS = 50
ISSUE_THRESHOLD_NS = ISSUE_THRESHOLD_MS * 1_000_000
MIN_CALLS = 5
RUNTIME_OVERHEAD_METHOD = (
    "<runtime method>.<runtime internal callee-save reference registers method>"
)
ROOT_PARENT = -1
# ---------------------------------------------------------------------------

_REGEX_SPECIAL = re.compile(r"([.$^|?*+()\[\]{}\\])")


def _alternatives(words: tuple[str, ...]) -> str:
    return "|".join(_REGEX_SPECIAL.sub(r"\\\1", w) for w in words)


def is_main_thread(
    thread_name: Column, tid: Column, is_main_flag: Column, pid: Column, rule: str = "any"
) -> Column:
    """Main-thread test. ``rule``: ``any`` of flag, pid and name; ``name_or_pid``;
    ``name_or_flag``."""
    by_name = thread_name == F.lit("main")
    by_pid = tid == pid
    by_flag = is_main_flag == F.lit(1)
    rules = {
        "any": by_flag | by_pid | by_name,
        "name_or_pid": by_name | by_pid,
        "name_or_flag": by_name | by_flag,
    }
    return rules[rule]


def is_framework(name: Column) -> Column:
    """Name starts with a framework prefix, ignoring ASCII case; NULL stays NULL.

    One anchored expression, so the name is read once for all prefixes.
    """
    return name.rlike(f"(?i)^(?:{_alternatives(FRAMEWORK_PREFIXES)})")


def not_framework(name: Column) -> Column:
    return ~is_framework(name)


def is_frame_call(name: Column) -> Column:
    return name.rlike(f"(?i){_alternatives(FRAME_KEYWORDS)}")


def exceeds_frame_budget(dur: Column) -> Column:
    return dur > F.lit(FRAME_BUDGET_NS)


def mentions_io(name: Column) -> Column:
    """I/O keyword anywhere in the name, ignoring ASCII case (diagnostic form)."""
    return name.rlike(f"(?i){_alternatives(IO_KEYWORDS)}")


def is_io_related(name: Column) -> Column:
    """I/O keyword anywhere in the name, case-sensitive; NULL gives false."""
    return F.coalesce(name.rlike(_alternatives(IO_KEYWORDS)), F.lit(False))


def contains_keyword(name: Column, keyword: str) -> Column:
    """``keyword`` anywhere in the name, ignoring ASCII case."""
    return name.rlike(f"(?i){_alternatives((keyword,))}")


def passes_issue_threshold(kind: Column, dur_ms: Column) -> Column:
    """Long and I/O hits need more than 50 ms; frame and cpu hits always pass."""
    return kind.isin("jank", "cpu") | (dur_ms > F.lit(ISSUE_THRESHOLD_MS))


def not_runtime_overhead(name: Column) -> Column:
    return name != F.lit(RUNTIME_OVERHEAD_METHOD)


def locate_badge(ts: Column, dur: Column) -> Column:
    """``locate`` when the issue has a place on the timeline, else ``aggregated``."""
    return F.when(ts.isNotNull() & dur.isNotNull(), "locate").otherwise("aggregated")
