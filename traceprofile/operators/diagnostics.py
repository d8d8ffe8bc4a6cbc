"""The slice diagnostics: long calls, slow frames, I/O and accumulated time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traceprofile.functions import predicates as P
from traceprofile.functions.text import ns_to_ms
from traceprofile.operators.main_thread import (
    Tables,
    join_tracks,
    on_main_thread,
    track_threads,
)
from traceprofile.operators.topk import collapse_duplicates, top_groups, top_k
from traceprofile.session import materialize

# How many rows each diagnostic reports per trace.
LONG_LIMIT = 30
JANK_LIMIT = 20
IO_LIMIT = 20
CPU_LIMIT = 30

_KEEP = ("id", "name", "parent_id")
SLICE_FINDING = ("trace_id", "kind", "pos", "id", "name", "dur_ms", "ts", "dur", "parent_id")


@dataclass(frozen=True)
class SliceDiagnostic:
    """A search for the slices with the largest duration among those that match."""

    kind: str
    matches: Callable[[], Column]
    limit: int
    rule: str | None = "any"  # main-thread rule; None takes every thread
    dedupe: bool = True       # fold slices of equal start and duration
    min_dur_ns: int | None = None

    def above(self, dur_ns: int) -> "SliceDiagnostic":
        """The same search, reporting only rows longer than ``dur_ns``.

        Rows are ranked by duration, so cutting before the ranking reports exactly
        the rows a cut after it would; the bound reaches the table scan.
        """
        return replace(self, min_dur_ns=dur_ns)

    def condition(self) -> Column:
        test = self.matches()
        return test if self.min_dur_ns is None else (F.col("dur") > self.min_dur_ns) & test


_NAME, _DUR = "name", "dur"

LONG_SLICES = SliceDiagnostic("long", lambda: P.not_framework(F.col(_NAME)), LONG_LIMIT)
FRAME_JANK = SliceDiagnostic(
    "jank",
    lambda: P.exceeds_frame_budget(F.col(_DUR)) & P.is_frame_call(F.col(_NAME)),
    JANK_LIMIT,
)
MAIN_THREAD_IO = SliceDiagnostic("io", lambda: P.mentions_io(F.col(_NAME)), IO_LIMIT)

LONG_SLICES_UNFILTERED = SliceDiagnostic(
    "long", lambda: F.lit(True), LONG_LIMIT, rule="name_or_pid", dedupe=False
)
FRAME_JANK_UNDEDUPED = replace(FRAME_JANK, rule="name_or_flag", dedupe=False)
MAIN_THREAD_IO_UNDEDUPED = replace(MAIN_THREAD_IO, rule="name_or_flag", dedupe=False)


def slice_findings(tables: Tables, searches: Sequence[SliceDiagnostic]) -> DataFrame:
    """Run several searches that share a main-thread rule in one pass over the slices.

    Every row learns which searches it matches at the scan; rows matching none leave
    there. Slices of equal start and duration are one finding: the first groups of them
    are picked before anything is folded, by duration, then by start, so that each task
    sends the rows of few groups; only these are folded and numbered.
    """
    rule, dedupe = searches[0].rule, searches[0].dedupe
    if any((s.rule, s.dedupe) != (rule, dedupe) for s in searches):
        raise ValueError("searches of one pass must share the thread rule and folding")

    columns = ["trace_id", "id", "name", "ts", "dur", "parent_id"]
    if rule is not None:
        columns.append("track_id")
    matching = reduce(lambda a, b: a | b, (s.condition() for s in searches))
    slices = tables["slice"].select(*columns).filter(matching)
    if rule is not None:
        slices = on_main_thread(slices, tables, rule).drop("track_id")
    if len(searches) == 1:
        hits = slices.withColumn("kind", F.lit(searches[0].kind))
    else:
        kinds = F.array(*[F.when(s.condition(), s.kind) for s in searches])
        hits = slices.withColumn("kind", F.explode(F.array_compact(kinds)))
    most, each = max(s.limit for s in searches), ["trace_id", "kind"]
    order = [F.col("dur").desc(), F.col("id")]
    if dedupe:
        order = [F.col("dur").desc(), F.col("ts")]
        hits = top_groups(hits, each, order, most)
        hits = collapse_duplicates(hits, ["trace_id", "kind", "ts", "dur"], "id", list(_KEEP))
    ranked = top_k(hits, each, order, most)
    if len({s.limit for s in searches}) > 1:
        limits = reduce(
            lambda acc, s: acc.when(F.col("kind") == s.kind, s.limit),
            searches[1:],
            F.when(F.col("kind") == searches[0].kind, searches[0].limit),
        )
        ranked = ranked.filter(F.col("pos") <= limits)
    return ranked.withColumn("dur_ms", ns_to_ms(F.col("dur"))).select(*SLICE_FINDING)


def long_slices(tables: Tables) -> DataFrame:
    """Longest main-thread calls outside the framework."""
    return slice_findings(tables, [LONG_SLICES])


def frame_jank(tables: Tables) -> DataFrame:
    """Main-thread frame calls over the 16.6 ms budget."""
    return slice_findings(tables, [FRAME_JANK])


def main_thread_io(tables: Tables) -> DataFrame:
    """Longest main-thread calls that name an I/O facility."""
    return slice_findings(tables, [MAIN_THREAD_IO])


def long_slices_unfiltered(tables: Tables) -> DataFrame:
    return slice_findings(tables, [LONG_SLICES_UNFILTERED])


def frame_jank_undeduped(tables: Tables) -> DataFrame:
    return slice_findings(tables, [FRAME_JANK_UNDEDUPED])


def main_thread_io_undeduped(tables: Tables) -> DataFrame:
    return slice_findings(tables, [MAIN_THREAD_IO_UNDEDUPED])


def frame_jank_literal(tables: Tables) -> DataFrame:
    """Slow frames read with AND binding tighter than OR: ``doFrame`` on a main thread,
    or ``Choreographer`` on any thread, or a ``traversal`` over budget on any thread."""
    name, dur = F.col("name"), F.col("dur")
    anywhere = P.contains_keyword(name, "Choreographer") | (
        P.contains_keyword(name, "traversal") & P.exceeds_frame_budget(dur)
    )
    do_frame = P.contains_keyword(name, "doFrame")
    slices = (
        tables["slice"]
        .select("trace_id", "id", "track_id", "parent_id", "name", "ts", "dur")
        .filter(do_frame | anywhere)
    )
    hits = join_tracks(slices, track_threads(tables, "name_or_flag"), tables).filter(
        (F.col("is_main") & do_frame) | anywhere
    )
    ranked = top_k(
        hits.withColumn("kind", F.lit("jank")),
        ["trace_id", "kind"],
        [F.col("dur").desc(), F.col("id")],
        JANK_LIMIT,
    )
    return ranked.withColumn("dur_ms", ns_to_ms(F.col("dur"))).select(*SLICE_FINDING)


CPU_FINDING = ("trace_id", "kind", "pos", "name", "count", "total_ms", "avg_ms")


def _total_ns() -> Column:
    """Exact sum that no number of calls overflows."""
    return F.sum(F.col("dur").cast("decimal(20,0)"))


def name_statistics(slices: DataFrame) -> DataFrame:
    """Calls, total and mean time per method; combined in each task before the shuffle."""
    return (
        slices.groupBy("trace_id", "name")
        .agg(F.count(F.lit(1)).alias("count"), _total_ns().alias("total_ns"))
        .withColumn("total_ms", ns_to_ms(F.col("total_ns")))
        .withColumn(
            "avg_ms", F.col("total_ns").cast("double") / F.col("count") / F.lit(1_000_000.0)
        )
    )


def _heaviest(stats: DataFrame) -> DataFrame:
    repeated = stats.filter(F.col("count") > P.MIN_CALLS).withColumn("kind", F.lit("cpu"))
    order = [F.col("total_ns").desc(), F.col("name")]
    return top_k(repeated, ["trace_id"], order, CPU_LIMIT).select(*CPU_FINDING)


def cpu_heavy(tables: Tables) -> DataFrame:
    """Main-thread methods called more than five times, by accumulated time."""
    slices = (
        tables["slice"]
        .select("trace_id", "id", "track_id", "name", "dur")
        .filter(P.not_framework(F.col("name")))
    )
    return _heaviest(name_statistics(on_main_thread(slices, tables)))


def cpu_heavy_all_threads(tables: Tables) -> DataFrame:
    """Methods called more than five times on any thread, framework included."""
    return _heaviest(name_statistics(tables["slice"].select("trace_id", "name", "dur")))


def longest_slice_by_keyword(slices: DataFrame, keyword: str) -> DataFrame:
    """Per trace, the longest slice whose name contains ``keyword``."""
    hits = slices.select("trace_id", "id", "parent_id", "name", "ts", "dur").filter(
        P.contains_keyword(F.col("name"), keyword)
    )
    best = top_k(hits, ["trace_id"], [F.col("dur").desc(), F.col("id")], 1)
    return best.select(
        "trace_id", "id", F.coalesce("parent_id", F.lit(P.ROOT_PARENT)).alias("parent_id"),
        "name", "ts", "dur",
    )


DIAGNOSTICS: dict[str, Callable[[Tables], DataFrame]] = {
    "long_slices": long_slices,
    "frame_jank": frame_jank,
    "cpu_heavy": cpu_heavy,
    "main_thread_io": main_thread_io,
}

_EMPTY = {
    "cpu_heavy": "trace_id string, kind string, pos int, name string, count bigint, "
                 "total_ms double, avg_ms double",
}
_EMPTY_SLICE = ("trace_id string, kind string, pos int, id bigint, name string, "
                "dur_ms double, ts bigint, dur bigint, parent_id bigint")


#: Failing runs of one diagnostic before the traces not yet told apart count as failed.
ATTEMPTS = 40
_STATUS = T.StructType([
    T.StructField("diagnostic", T.StringType(), False),
    T.StructField("ok", T.BooleanType(), False),
    T.StructField("error", T.StringType(), True),
])
_FAILURES = "trace_id string, diagnostic string, error string"


def _first_line(error: Exception) -> str:
    return (str(error) or type(error).__name__).splitlines()[0]


def run_by_trace(
    tables: Tables, name: str, build: Callable[[Tables], DataFrame], attempts: int = ATTEMPTS
) -> tuple[list[DataFrame], list[tuple[Column, str]]]:
    """The rows of a diagnostic for all traces that it can take, written in pieces, and a
    condition on ``trace_id`` with an error for those that it cannot.

    All traces are run at once. Only where that fails they are halved by the bits of a hash
    of their id, until the trace at fault is alone; so one of N costs about log2(N) more
    runs, each on half of the rows of the one before. A diagnostic that cannot even be
    planned fails for all traces at once, and so does the rest after ``attempts`` failures.
    """
    traces = tables["thread"].select("trace_id").unionByName(tables["slice"].select("trace_id"))
    pieces: list[DataFrame] = []
    failed: list[tuple[Column, str]] = []
    parts = [(0, 0)]
    for depth, prefix in parts:
        place = F.shiftrightunsigned(F.xxhash64("trace_id"), 64 - depth) if depth else F.lit(0).cast("bigint")
        mine = place == prefix
        own = {key: table.filter(mine) for key, table in tables.items()} if depth else tables
        try:
            planned = build(own)
        except Exception as error:  # noqa: BLE001 - no trace is at fault
            failed.append((mine, _first_line(error)))
            continue
        try:
            pieces.append(materialize(planned, f"diagnostic-{name}"))
        except Exception as error:  # noqa: BLE001 - any failure only skips its traces
            attempts -= 1
            if attempts <= 0 or depth == 63 or traces.filter(mine).distinct().limit(2).count() < 2:
                failed.append((mine, _first_line(error)))
            else:
                parts += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
    return pieces, failed


def run_diagnostics(
    tables: Tables, diagnostics: dict[str, Callable[[Tables], DataFrame]] | None = None,
    attempts: int = ATTEMPTS,
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """All diagnostics; one that fails leaves the others, a trace that fails the other traces.

    Each is run and its few rows are written, so a failure at run time is seen here too.
    Returns the results by name, a ``(diagnostic, ok, error)`` table, where ``ok`` says that
    no trace failed, and a ``(trace_id, diagnostic, error)`` table of failed traces.
    """
    spark = tables["thread"].sparkSession
    traces = tables["thread"].select("trace_id").unionByName(tables["slice"].select("trace_id"))
    results: dict[str, DataFrame] = {}
    status: list[tuple[str, bool, str | None]] = []
    failures = spark.createDataFrame([], _FAILURES)
    for name, build in (diagnostics or DIAGNOSTICS).items():
        pieces, failed = run_by_trace(tables, name, build, attempts)
        empty = spark.createDataFrame([], _EMPTY.get(name, _EMPTY_SLICE))
        results[name] = reduce(DataFrame.unionByName, pieces) if pieces else empty
        status.append((name, not failed, failed[0][1] if failed else None))
        for mine, error in failed:
            failures = failures.unionByName(traces.filter(mine).distinct().select(
                "trace_id", F.lit(name).alias("diagnostic"), F.lit(error).alias("error")
            ))
    return results, spark.createDataFrame(status, _STATUS), failures


def diagnostic_counts(results: dict[str, DataFrame]) -> DataFrame:
    """Rows per trace and diagnostic."""
    tagged = [
        df.select("trace_id", F.lit(name).alias("diagnostic")) for name, df in results.items()
    ]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("trace_id", "diagnostic")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
