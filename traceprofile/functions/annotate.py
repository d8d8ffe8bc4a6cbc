"""Readable notes on compiler-made method names and likely causes of cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Name patterns, most specific first, with the note each one earns.
# {1} and {2} are the captured class and member.
# ---------------------------------------------------------------------------
NAME_NOTES = (
    (r"(\w+)\$(\w+)\$\d+\$\d+\.invokeSuspend\b", "← Kotlin lambda in {1}.{2}()"),
    (r"(\w+)\$(\w+)\$\d+\.invokeSuspend\b", "← coroutine continuation of {1}.{2}()"),
    (r"(\w+)\$(\w+)\$\d+\.invoke\b", "← lazy init of {1}.{2}"),
    (r"(\w+)\$\d+\.run\b", "← anonymous Runnable in {1}"),
    (r"\.[A-Za-z]\d(?:\(|$)", "← obfuscated method (ProGuard)"),
    (r"\bmsdocker\.|\b[Il1i]{4,}\b", "← DroidPlugin hook / string decryption"),
)

# Cause patterns: tag, pattern (case as written), advice.
CAUSE_PATTERNS = (
    ("idle", r"MessageQueue\.next", "Normal idle state"),
    ("json", r"JSONObject\.put|ReflectiveTypeAdapterFactory",
     "Use code-gen (Moshi, kotlinx.serialization)"),
    ("reflection", r"java\.lang\.reflect\.", "Use code generation"),
    ("io", r"(?i)file|network|http", "Move to background thread"),
    ("vendor_sdk", r"(?i)vivo|huawei", "Disable or reduce frequency"),
    ("database", r"(?i)androidx\.room\.|sqlite", "Optimize query frequency"),
    ("animation", r"(?i)choreographer|vsync", "Keep frame callbacks light"),
    ("logging", r"FilePrinter", "Async batch logging"),
)
# ---------------------------------------------------------------------------


def method_note(name: Column) -> Column:
    """Note for a compiler-made or obfuscated name, '' for an ordinary one."""
    chain = F.when(F.lit(False), "")
    for pattern, note in NAME_NOTES:
        head, _, tail = note.partition("{1}")
        if not tail and "{1}" not in note:
            text = F.lit(note)
        else:
            middle, _, end = tail.partition("{2}")
            parts = [F.lit(head), F.regexp_extract(name, pattern, 1), F.lit(middle)]
            if "{2}" in note:
                parts += [F.regexp_extract(name, pattern, 2), F.lit(end)]
            text = F.concat(*parts)
        chain = chain.when(name.rlike(pattern), text)
    return chain.otherwise("")


def annotated_name(name: Column) -> Column:
    """The name followed by its note, if it has one."""
    note = method_note(name)
    return F.when(note != "", F.concat(name, F.lit(" "), note)).otherwise(name)


#: Causes that count on the main thread only.
MAIN_THREAD_TAGS = ("io",)


def cause_tags(name: Column, on_main: Column | None = None) -> Column:
    """``array<struct<tag, advice>>`` of every cause pattern the name matches.

    Where ``on_main`` tells the thread, I/O is a cause on the main thread only.
    """
    def applies(tag: str, pattern: str) -> Column:
        hit = name.rlike(pattern)
        return hit & on_main if on_main is not None and tag in MAIN_THREAD_TAGS else hit

    return F.array_compact(
        F.array(*[
            F.when(
                applies(tag, pattern),
                F.struct(F.lit(tag).alias("tag"), F.lit(advice).alias("advice")),
            )
            for tag, pattern, advice in CAUSE_PATTERNS
        ])
    )


def pattern_tags(methods: DataFrame) -> DataFrame:
    """One row per method and matching cause pattern; ``methods`` has ``name`` and, where
    it is known, ``on_main_thread``."""
    on_main = F.col("on_main_thread") if "on_main_thread" in methods.columns else None
    hit = F.explode(cause_tags(F.col("name"), on_main))
    return methods.withColumn("hit", hit).select(
        *methods.columns, F.col("hit.tag").alias("tag"), F.col("hit.advice").alias("advice")
    )
