"""The whole analysis of a slice model as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceprofile import schema
from traceprofile.functions.predicates import ISSUE_THRESHOLD_NS
from traceprofile.operators import diagnostics as D
from traceprofile.operators.callstack import call_stacks
from traceprofile.operators.issues import (
    attach_stacks,
    issue_seeds,
    ranked_issues,
    union_findings,
)
from traceprofile.session import materialize

Tables = Mapping[str, DataFrame]

# Fixed value: message of a trace that cannot be analysed.
NOT_LOADED = "请先在 Perfetto 中加载 trace 文件"


def trace_status(tables: Tables) -> DataFrame:
    """``(trace_id, ready, error)``: a trace is ready when it has slices and every
    table has its columns."""
    lacking = [
        f"{name}.{column}"
        for name, layout in schema.SLICE_MODEL.items()
        for column in schema.missing_columns(tables[name], layout)
    ]
    traces = (
        tables["thread"].select("trace_id").unionByName(tables["process"].select("trace_id"))
        .unionByName(tables["thread_track"].select("trace_id"))
    )
    if lacking:
        return traces.distinct().select(
            "trace_id", F.lit(False).alias("ready"),
            F.lit("missing columns: " + ", ".join(lacking)).alias("error"),
        )
    seen = traces.select("trace_id", F.lit(0).alias("n")).unionByName(
        tables["slice"].select("trace_id", F.lit(1).alias("n"))
    )
    ready = F.max("n") > 0
    return seen.groupBy("trace_id").agg(
        ready.alias("ready"), F.when(~ready, NOT_LOADED).alias("error")
    )


def all_findings(tables: Tables) -> DataFrame:
    """Every row the four diagnostics report."""
    hits = D.slice_findings(tables, [D.LONG_SLICES, D.FRAME_JANK, D.MAIN_THREAD_IO])
    return union_findings(hits, D.cpu_heavy(tables))


def issue_findings(tables: Tables) -> DataFrame:
    """The reported rows that can become issues.

    Long and I/O hits count above 50 ms only. As they are ranked by duration the bound
    moves to the table scan without changing which of them are reported.
    """
    searches = [
        D.LONG_SLICES.above(ISSUE_THRESHOLD_NS),
        D.FRAME_JANK,
        D.MAIN_THREAD_IO.above(ISSUE_THRESHOLD_NS),
    ]
    return union_findings(D.slice_findings(tables, searches), D.cpu_heavy(tables))


def stack_seeds(tables: Tables) -> DataFrame:
    """Distinct slices reported by the long, frame and I/O diagnostics."""
    searches = [D.LONG_SLICES, D.FRAME_JANK, D.MAIN_THREAD_IO]
    return issue_seeds(D.slice_findings(tables, searches))


def rated_issues(tables: Tables) -> DataFrame:
    """Issues in list order, without call stacks."""
    return ranked_issues(issue_findings(tables))


def staged_issues(tables: Tables) -> DataFrame:
    """Rated issues written once: a few rows per trace that several steps read, for
    which the slice table must not be searched again. Their size is then known too."""
    return materialize(rated_issues(tables), "rated-issues")


class Analysis(NamedTuple):
    """What one analysis leaves: issues with stacks, and what they were made of."""

    issues: DataFrame
    findings: DataFrame
    stacks: DataFrame
    traces: DataFrame       # trace_id, ready, error
    diagnostics: DataFrame  # diagnostic, ok, error
    failures: DataFrame     # trace_id, diagnostic, error


def _tolerant_findings(tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that can become issues, the status of each diagnostic and the failed traces.

    Three searches share a pass over the slices. If that pass fails each is run alone, so
    that the one at fault does not take the others along, and for the traces it can take.
    """
    searches = {
        "long_slices": D.LONG_SLICES.above(ISSUE_THRESHOLD_NS),
        "frame_jank": D.FRAME_JANK,
        "main_thread_io": D.MAIN_THREAD_IO.above(ISSUE_THRESHOLD_NS),
    }
    cpu, status, failures = D.run_diagnostics(tables, {"cpu_heavy": D.cpu_heavy})
    together, trial, _ = D.run_diagnostics(
        tables, {"slices": lambda t: D.slice_findings(t, list(searches.values()))}, attempts=1
    )
    if trial.first()["ok"]:
        names = F.explode(F.array(*map(F.lit, searches)))
        status = trial.withColumn("diagnostic", names).unionByName(status)
        return union_findings(together["slices"], cpu["cpu_heavy"]), status, failures
    alone, more, failed = D.run_diagnostics(tables, {
        name: lambda t, s=search: D.slice_findings(t, [s]) for name, search in searches.items()
    })
    hits = reduce(DataFrame.unionByName, alone.values())
    return (
        union_findings(hits, cpu["cpu_heavy"]), more.unionByName(status), failed.unionByName(failures)
    )


def run_analysis(tables: Tables) -> Analysis:
    """The whole analysis with all it leaves behind.

    A diagnostic that fails, also at run time, has a status and no rows of the traces on which
    it failed, which are listed; a trace that is not ready has a status, and :func:`~traceprofile.plans.report.reports` writes nothing
    about it when given ``traces``.
    """
    findings, diagnostics, failures = _tolerant_findings(tables)
    issues = materialize(ranked_issues(findings), "rated-issues")
    stacks = materialize(call_stacks(issue_seeds(issues), tables["slice"]), "stacks")
    return Analysis(
        attach_stacks(issues, stacks), findings, stacks, trace_status(tables), diagnostics, failures
    )


def analyze(tables: Tables) -> DataFrame:
    """Issues of every trace, with call stacks walked for surviving issues only."""
    return run_analysis(tables).issues
