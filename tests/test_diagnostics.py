"""Diagnostics over random traces against plain models."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.compare import force_shuffles
from traceprofile import schema
from traceprofile.functions import predicates as P
from traceprofile.operators import diagnostics as D
from traceprofile.plans import analysis

NAMES = ["doFrame", "Choreographer#x", "a.Traversal.b", "void android.A.b()", "com.app.Work.run()",
         "Binder call", "com.app.profile()", "HTTP get", None]


def _model(spark, slices, tracks, threads, processes):
    return {
        "slice": spark.createDataFrame(slices, schema.SLICE),
        "thread_track": spark.createDataFrame(tracks, schema.THREAD_TRACK),
        "thread": spark.createDataFrame(threads, schema.THREAD),
        "process": spark.createDataFrame(processes, schema.PROCESS),
    }


def _random_trace(seed):
    rng = random.Random(seed)
    threads, tracks, processes, slices = [], [], [], []
    for trace in ("a", "b", "c"):
        for u in range(4):
            threads.append((trace, u, 100 + u, rng.choice(["main", "w", None]),
                            rng.choice([0, 1, None])))
            tracks.append((trace, 10 + u, u))
        if trace != "c":
            processes += [(trace, 102), (trace, 101)]
        for i in range(400):
            slices.append((trace, i, 10 + rng.randrange(5), None, rng.choice(NAMES),
                           rng.randrange(5) * 1000,
                           rng.choice([0, -1, 16_600_000, 16_600_001, 50_000_000, 50_000_001,
                                       rng.randrange(10**9)])))
    return slices, tracks, threads, processes


def _lower(name, words):
    return name is not None and any(w.lower() in name.lower() for w in words)


def _expected(data, match, limit):
    slices, tracks, threads, processes = data
    pid = {}
    for trace, p in processes:
        pid[trace] = min(p, pid.get(trace, p))
    thread = {(t, u): (tid, n, flag) for t, u, tid, n, flag in threads}
    main = set()
    for trace, track, utid in tracks:
        tid, name, flag = thread[trace, utid]
        if name == "main" or flag == 1 or tid == pid.get(trace):
            main.add((trace, track))
    groups = {}
    for trace, i, track, _, name, ts, dur in slices:
        if (trace, track) in main and match(name, dur):
            key = (trace, ts, dur)
            groups[key] = min(groups.get(key, (i, name)), (i, name), key=lambda x: x[0])
    per_trace = defaultdict(list)
    for (trace, ts, dur), (i, name) in groups.items():
        per_trace[trace].append((-dur, ts, i, name))
    return {
        (trace, pos, i, name, -neg, ts)
        for trace, rows in per_trace.items()
        for pos, (neg, ts, i, name) in enumerate(sorted(rows)[:limit], 1)
    }


def _got(df):
    return {(r.trace_id, r.pos, r.id, r.name, r.dur, r.ts) for r in df.collect()}


def _not_framework(name, dur):
    return name is not None and not any(
        name.lower().startswith(p.lower()) for p in P.FRAMEWORK_PREFIXES
    )


@pytest.mark.parametrize("shuffled", [False, True])
def test_slice_diagnostics_match_the_model(spark, shuffled):
    session = spark.newSession()
    if shuffled:
        force_shuffles(session)
    data = _random_trace(11)
    tables = _model(session, *data)
    assert _got(D.long_slices(tables)) == _expected(data, _not_framework, 30)
    assert _got(D.frame_jank(tables)) == _expected(
        data, lambda n, d: d > 16_600_000 and _lower(n, P.FRAME_KEYWORDS), 20
    )
    assert _got(D.main_thread_io(tables)) == _expected(
        data, lambda n, d: _lower(n, P.IO_KEYWORDS), 20
    )


def test_one_pass_for_several_searches_equals_single_passes(spark):
    tables = _model(spark, *_random_trace(5))
    searches = [D.LONG_SLICES, D.FRAME_JANK, D.MAIN_THREAD_IO]
    together = D.slice_findings(tables, searches)
    for search in searches:
        alone = D.slice_findings(tables, [search])
        assert _got(together.filter(f"kind = '{search.kind}'")) == _got(alone)


def test_duration_bound_below_the_ranking_keeps_the_result(spark):
    tables = _model(spark, *_random_trace(6))
    bounded = D.slice_findings(tables, [D.LONG_SLICES.above(50_000_000)])
    assert _got(bounded) == {r for r in _got(D.long_slices(tables)) if r[4] > 50_000_000}


def test_cpu_heavy_needs_more_than_five_calls_and_counts_negative_durations(spark):
    slices = [("t", i, 1, None, "five", 0, 10) for i in range(5)]
    slices += [("t", 10 + i, 1, None, "six", i, 1_000_000) for i in range(5)]
    slices += [("t", 20, 1, None, "six", 9, -1)]
    tables = _model(spark, slices, [("t", 1, 1)], [("t", 1, 1, "main", None)], [])
    rows = D.cpu_heavy(tables).collect()
    assert [(r.name, r.count if isinstance(r.count, int) else r["count"]) for r in rows] == [("six", 6)]
    assert rows[0].total_ms == 4_999_999 / 1e6
    assert rows[0].avg_ms == 4_999_999 / 6 / 1e6


def test_totals_are_ranked_by_number_not_by_text(spark):
    slices = [("t", i, 1, None, "small", i, 99_500_000 // 6) for i in range(6)]
    slices += [("t", 10 + i, 1, None, "large", i, 1_000_000_000 // 6) for i in range(6)]
    tables = _model(spark, slices, [("t", 1, 1)], [("t", 1, 1, "main", None)], [])
    assert [r.name for r in D.cpu_heavy(tables).orderBy("pos").collect()] == ["large", "small"]


def test_unfinished_slices_never_become_issues(spark):
    slices = [("t", i, 1, None, "Binder open", i, -1) for i in range(3)]
    tables = _model(spark, slices, [("t", 1, 1)], [("t", 1, 1, "main", None)], [])
    assert D.main_thread_io(tables).count() == 3
    assert analysis.rated_issues(tables).count() == 0


def test_a_failing_diagnostic_leaves_the_others(spark):
    tables = _model(spark, *_random_trace(2))

    def broken(_):
        raise ValueError("no such table\ndetails")

    results, status, failures = D.run_diagnostics(tables, {**D.DIAGNOSTICS, "frame_jank": broken})
    assert results["frame_jank"].count() == 0
    assert results["frame_jank"].columns == D.frame_jank(tables).columns
    assert results["long_slices"].count() > 0
    by_name = {r.diagnostic: (r.ok, r.error) for r in status.collect()}
    assert by_name["frame_jank"] == (False, "no such table")
    assert by_name["cpu_heavy"] == (True, None)
    counts = {(r.trace_id, r.diagnostic) for r in D.diagnostic_counts(results).collect()}
    assert ("a", "long_slices") in counts and ("a", "frame_jank") not in counts


def test_a_failing_trace_leaves_the_others(spark):
    rows = []
    for t in range(45):
        rows += [(f"t{t}", 100 * t + i, 1, None, "doFrame", 10 * i, 20_000_000 + i) for i in range(4)]
    names = [f"t{t}" for t in range(45)]
    tables = _model(spark, rows, [(t, 1, 1) for t in names], [(t, 1, 1, "main", 1) for t in names], [])

    def broken(own):
        fails = F.raise_error(F.lit("unreadable")).cast("bigint")
        dur = F.when(F.col("trace_id").isin("t7", "t31"), fails).otherwise(F.col("dur"))
        return D.frame_jank({**own, "slice": own["slice"].withColumn("dur", dur)})

    results, status, failures = D.run_diagnostics(tables, {"frame_jank": broken, "long_slices": D.long_slices})
    assert {r.diagnostic: r.ok for r in status.collect()} == {"frame_jank": False, "long_slices": True}
    assert sorted((r.trace_id, r.diagnostic) for r in failures.collect()) == [
        ("t31", "frame_jank"), ("t7", "frame_jank")]
    assert "unreadable" in failures.first().error
    got = {r.trace_id: r["count"] for r in results["frame_jank"].groupBy("trace_id").count().collect()}
    assert got == {t: 4 for t in names if t not in ("t7", "t31")}
    # given up early, all traces not told apart count as failed
    results, _, failures = D.run_diagnostics(tables, {"frame_jank": broken}, attempts=2)
    lost = {r.trace_id for r in failures.collect()}
    kept = {r.trace_id for r in results["frame_jank"].collect()}
    assert {"t7", "t31"} <= lost and lost | kept == set(names) and not lost & kept


def test_trace_status(spark):
    tables = _model(
        spark, [("a", 1, 1, None, "x", 0, 1)], [("a", 1, 1)],
        [("a", 1, 1, "main", None), ("b", 1, 1, "main", None)], [],
    )
    got = {r.trace_id: (r.ready, r.error) for r in analysis.trace_status(tables).collect()}
    assert got == {"a": (True, None), "b": (False, analysis.NOT_LOADED)}
    tables["slice"] = tables["slice"].drop("dur")
    lacking = analysis.trace_status(tables).collect()
    assert all(not r.ready and "slice.dur" in r.error for r in lacking)
