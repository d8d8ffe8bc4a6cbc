"""Caller chains and their text form."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.compare import force_shuffles
from traceprofile import schema
from traceprofile.operators import callstack as C


def _slices(spark, rows):
    full = [(t, i, 0, parent, name, 0, dur) for t, i, parent, name, dur in rows]
    return spark.createDataFrame(full, schema.SLICE)


def _odd_slices(spark, rows):
    layout = "trace_id string, id bigint, parent_id bigint, name string, dur bigint"
    return spark.createDataFrame(rows, layout)


def _walk(parents, start):
    """Plain model of the walk."""
    if start not in parents:
        return None
    path, current = [start], parents[start]
    for _ in range(C.MAX_PARENTS):
        if current is None or current == -1 or current not in parents:
            break
        path.append(current)
        current = parents[current]
    cut = current is not None and current != -1 and len(path) > C.MAX_PARENTS
    return path, cut


@pytest.mark.parametrize("shuffled", [False, True])
def test_chains_of_every_depth(spark, shuffled):
    session = spark.newSession()
    if shuffled:
        force_shuffles(session)
    rows, parents = [], {}
    for depth in range(1, 51):
        trace = f"d{depth}"
        chain = {i: (i + 1 if i < depth - 1 else (-1 if depth % 2 else None)) for i in range(depth)}
        parents[trace] = chain
        rows += [(trace, i, p, f"m{i}", 1) for i, p in chain.items()]
    slices = _slices(session, rows)
    seeds = session.createDataFrame([(t, 0) for t in parents], "trace_id string, slice_id long")
    got = {r.trace_id: ([e.id for e in r.stack], r.truncated)
           for r in C.call_stacks(seeds, slices).collect()}
    assert got == {t: _walk(chain, 0) for t, chain in parents.items()}
    assert got["d26"][1] is False and got["d27"][1] is True
    assert len(got["d50"][0]) == 26


def test_random_forests_with_dangling_parents_loops_and_unknown_seeds(spark):
    rng = random.Random(4)
    rows, models = [], {}
    for t in range(4):
        trace, n = f"t{t}", 200
        parents = {}
        for i in range(n):
            parents[i] = rng.choice([None, -1, i + 10_000, i]) if rng.random() < 0.05 else rng.randrange(n)
        models[trace] = parents
        rows += [(trace, i, p, f"n{i}", 1) for i, p in parents.items()]
    slices = _slices(spark, rows)
    wanted = [(t, i) for t in models for i in range(0, 220, 7)]
    seeds = spark.createDataFrame(wanted, "trace_id string, slice_id long")
    got = {(r.trace_id, r.slice_id): ([e.id for e in r.stack], r.truncated)
           for r in C.call_stacks(seeds, slices).collect()}
    want = {(t, i): _walk(models[t], i) for t, i in wanted if i in models[t]}
    assert got == want


def test_entries_carry_name_and_parent_with_minus_one_at_the_root(spark):
    slices = _slices(spark, [("t", 1, None, "root", 1), ("t", 2, 1, "leaf", 5)])
    seeds = spark.createDataFrame([("t", 2)], "trace_id string, slice_id long")
    stack = C.call_stacks(seeds, slices).first().stack
    assert [(e.name, e.id, e.parent_id) for e in stack] == [("leaf", 2, 1), ("root", 1, -1)]


def test_stack_of_the_longest_slice_with_a_keyword(spark):
    slices = _slices(spark, [
        ("t", 1, None, "root", 100), ("t", 2, 1, "x.Save.a", 5), ("t", 3, 1, "y.save.b", 9),
    ])
    rows = C.call_stacks_by_keyword(slices, "SAVE").collect()
    assert [[e.name for e in r.stack] for r in rows] == [["y.save.b", "root"]]


@pytest.mark.parametrize(
    ("names", "cut", "text"),
    [
        ([], False, ""),
        (["slow"], False, "slow()          ← 瓶颈"),
        (["leaf", "mid", "root"], False,
         "root()\n  → mid()\n    → leaf()          ← 瓶颈"),
        (["d", "c", "b", "a"], False,
         "a()\n  → b()\n    → c()\n      → d()          ← 瓶颈"),
        (["leaf", "parent"], True,
         "parent()\n  → leaf()          ← 瓶颈\n    ... (调用栈已截断)"),
    ],
)
def test_stack_text(spark, names, cut, text):
    stack = [(n, i, i + 1) for i, n in enumerate(names)]
    df = spark.createDataFrame([("t", 1, stack, cut)], schema.STACKS)
    assert df.select(C.stack_text(F.col("stack"), F.col("truncated"))).first()[0] == text


def _forest(seed, repeated=False):
    """Parents by trace: chains, stars, roots, dangling parents and loops; and all slices."""
    rng = random.Random(seed)
    rows, models = [], {}
    for t in range(3):
        parents = {}
        for i in range(150):
            odd = rng.random()
            parents[i] = (
                rng.choice([None, -1, i + 10_000, i]) if odd < 0.05 else 3 if odd < 0.3
                else (i + 1) % 150 if odd < 0.8 else rng.randrange(150)
            )
        models[f"t{t}"] = parents
        rows += [(f"t{t}", i, p, None if i % 17 == 5 else f"n{i}", 1) for i, p in parents.items()]
    rows += [(None, 1, 2, "x", 1), ("t0", None, 2, "y", 1)]
    if repeated:
        rows += [("t0", 7, 8, "other", 1), ("t0", 7, None, "third", 1), ("t1", 20, models["t1"][20], "n20", 1)]
    return rows, models


@pytest.mark.parametrize(("max_parents", "repeated"), [(25, False), (25, True), (4, True), (0, False)])
def test_doubled_stacks_are_those_of_the_walk(spark, max_parents, repeated):
    rows, models = _forest(8, repeated)
    slices = _odd_slices(spark, rows)
    seeds = slices.select("trace_id", F.col("id").alias("slice_id")).filter(
        "slice_id % 3 != 1 OR slice_id IS NULL").distinct()
    want = C._walked_stacks(seeds, slices, max_parents)
    got = C._doubled_stacks(seeds, slices, max_parents)
    assert got.dtypes == want.dtypes
    rows_of = lambda df: sorted(df.collect(), key=repr)
    assert rows_of(got) == rows_of(want) and got.count() > 250


def test_all_slices_as_seeds_are_not_sent_at_every_level(spark):
    from tests.test_plans import plan

    session = spark.newSession()
    force_shuffles(session)
    rows, models = _forest(9)
    slices = _odd_slices(session, rows)
    df = C.call_stacks(slices.select("trace_id", F.col("id").alias("slice_id")), slices)
    assert plan(df).split("== Physical Plan ==")[-1].count("SortMergeJoin LeftOuter") <= 1
    got = {(r.trace_id, r.slice_id): ([e.id for e in r.stack], r.truncated) for r in df.collect()}
    assert got == {(t, i): _walk(p, i) for t, p in models.items() for i in p}
