"""Sampling reports against counters over plain Python lists."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from tests.compare import force_shuffles
from traceprofile import schema
from traceprofile.functions.predicates import RUNTIME_OVERHEAD_METHOD
from traceprofile.operators import sampling as S


def _data(seed, per_trace_map):
    rng = random.Random(seed)
    samples, mapping = [], []
    for t in ("a", "b"):
        for i in range(300):
            if rng.random() < 0.34:
                frames = [3, 2, 1]
            else:
                frames = [rng.randrange(25) for _ in range(rng.randrange(1, 12))] + [1]
            if i % 50 == 0:
                frames[0] = -7
            samples.append((t, i, 2, len(frames), frames))
    for t in ("a", "b") if per_trace_map else (None,):
        # addresses 0..19 mapped, several to one name; one name holds the separator
        names = {a: f"void m{a % 6}(int)" for a in range(20)}
        names |= {1: "main()", 2: "x|y", 4: RUNTIME_OVERHEAD_METHOD, 5: f"only.{t}()"}
        mapping += [(t, a, n) for a, n in names.items()]
    return samples, mapping


def _frames(session, samples, mapping):
    s = session.createDataFrame(samples, schema.SAMPLES)
    m = session.createDataFrame(mapping, schema.MAPPING)
    return s, (m if mapping[0][0] is not None else m.drop("trace_id"))


def _counters(samples, mapping):
    names = {(t, a): n for t, a, n in mapping}

    def name(trace, addr):
        fallback = f"native:0x{addr % 2**64:x}"
        return names.get((trace, addr), names.get((None, addr), fallback))

    own, total, stacks = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for trace, _, _, _, frames in samples:
        called = [name(trace, a) for a in frames]
        own[trace][called[0]] += 1
        for n in dict.fromkeys(called):
            total[trace][n] += 1
        stacks[trace][tuple(called[:5])] += 1
    return own, total, stacks


def _want(counters, n, samples):
    size = Counter(s[0] for s in samples)
    return {(t, pos, k, c, c / size[t] * 100) for t, counter in counters.items()
            for pos, (k, c) in enumerate(counter.most_common(n), 1)}


def _methods(df):
    return {(r.trace_id, r.pos, r.name, r["count"], r.percent) for r in df.collect()}


@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("per_trace_map", [False, True])
def test_reports_match_counters(spark, shuffled, per_trace_map):
    session = spark.newSession()
    if shuffled:
        force_shuffles(session)
    samples, mapping = _data(21, per_trace_map)
    s, m = _frames(session, samples, mapping)
    own, total, stacks = _counters(samples, mapping)
    assert _methods(S.self_time(s, m)) == _want(own, 30, samples)
    assert _methods(S.inclusive_time(s, m)) == _want(total, 30, samples)
    got = {(r.trace_id, r.pos, r.stack, r["count"]) for r in S.hot_stacks(s, m).collect()}
    assert got == {(t, p, "|".join(k), c) for t, p, k, c, _ in _want(stacks, 15, samples)}


def test_every_method_is_counted_not_only_the_reported_ones(spark):
    samples, mapping = _data(5, True)
    s, m = _frames(spark, samples, mapping)
    got = {(r.trace_id, r.name): r["count"] for r in S.inclusive_counts(s, m).collect()}
    _, total, _ = _counters(samples, mapping)
    assert got == {(t, n): c for t, counter in total.items() for n, c in counter.items()}


def test_runtime_bookkeeping_is_left_out_but_kept_in_the_base(spark):
    samples = [("t", i, 2, 1, [4 if i < 6 else 1]) for i in range(8)]
    s, m = _frames(spark, samples, [(None, 4, RUNTIME_OVERHEAD_METHOD), (None, 1, "main()")])
    assert [(r.name, r.percent) for r in S.self_time(s, m, skip_runtime=True).collect()] == [
        ("main()", 25.0)
    ]


def test_estimated_time_from_constant_and_from_headers(spark):
    s, m = _frames(spark, [("t", 0, 2, 1, [1]), ("t", 1, 2, 1, [1])], [(None, 1, "main()")])
    own = S.self_time(s, m)
    headers = spark.createDataFrame([("t", 10_000)], "trace_id string, interval_us long")
    assert S.with_estimated_ms(own).first().est_ms == 50.0
    assert S.with_estimated_ms(own, headers).first().est_ms == 20.0


def test_symbolized_frames_keep_every_frame_in_place(spark):
    s, m = _frames(spark, [("t", 0, 2, 3, [9, 1, -1])], [(None, 1, "main()")])
    rows = S.symbolized_frames(s, m).orderBy("frame_pos").collect()
    assert [r.name for r in rows] == ["native:0x9", "main()", "native:0xffffffffffffffff"]


def test_frames_are_not_sorted_to_be_named(spark):
    """A hot address has a part of all frames; sorting it takes memory that grows with it."""
    samples = spark.createDataFrame(
        [("t", i, [i % 3, 1, None]) for i in range(50)], "trace_id string, sample_ord bigint, frames array<bigint>"
    )
    names = spark.createDataFrame([(1, "one"), (1, "other"), (2, "two"), (None, "none")], "addr bigint, name string")
    want = {tuple(r) for r in S.symbolized_frames(samples, names).collect()}
    spark.conf.set("spark.traceprofile.broadcastBytes", "-1")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = S.symbolized_frames(samples, names)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        rows = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.unset("spark.traceprofile.broadcastBytes")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(rows) == 150 and set(rows) == want
