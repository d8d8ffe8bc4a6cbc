"""Caller chains: follow ``parent_id`` from many slices at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceprofile.functions.annotate import method_note
from traceprofile.functions.predicates import ROOT_PARENT
from traceprofile.operators.diagnostics import longest_slice_by_keyword
from traceprofile.operators.joins import estimated_bytes, fits_broadcast
from traceprofile.session import materialize, release

# Depth limit and the marks of the text form.
MAX_PARENTS = 25
BOTTLENECK_MARK = "          ← 瓶颈"
TRUNCATED_MARK = "... (调用栈已截断)"

#: Seeds are few when the parent pointers are this many times their size.
FEW_SEEDS = 8


def ancestor_paths(
    seeds: DataFrame, slices: DataFrame, max_parents: int = MAX_PARENTS
) -> DataFrame:
    """``(trace_id, slice_id, path, next_id)``: ids from the seed up to ``max_parents``
    callers, and the id of the caller after a path of full length (NULL when the walk
    ended by itself, at a root or at a parent that is not in the table).

    ``seeds`` holds ``(trace_id, slice_id)``; ids that name no slice are left out. The
    walk is one plan of equal joins between the shrinking set of open walks and the
    ``(trace_id, id, parent_id)`` projection. A small projection is broadcast once for
    all levels. A large one is shuffled once by ``(trace_id, id)``, a key no two slices
    share, and every level reuses that exchange. When the seeds are few beside it, their
    walks are hashed and the projection is never sorted; else both sides are merged in
    order, which spills, and AQE splits the key of a caller that many walks share.
    """
    spark = slices.sparkSession
    edges = slices.select(
        "trace_id", "id", F.when(F.col("parent_id") != ROOT_PARENT, F.col("parent_id")).alias("up")
    )
    if fits_broadcast(spark, edges):
        hint = "/*+ BROADCAST(e) */"
    elif _few(seeds, edges):
        hint = "/*+ SHUFFLE_HASH(w) */"
    else:
        hint = ""
    # One statement, so the chain is analysed once. An ended walk looks up a key of its
    # own, so ended walks spread over all tasks instead of meeting at NULL.
    walk = f"""SELECT {hint} w.trace_id, w.slice_id, e.id AS id0, e.up AS up0
      FROM {{seeds}} w JOIN {{edges}} e ON e.trace_id = w.trace_id AND e.id = w.slice_id"""
    for level in range(1, max_parents + 1):
        last = f"up{level - 1}"
        ids = ", ".join(f"w.id{i}" for i in range(level))
        walk = f"""SELECT {hint} w.trace_id, w.slice_id, {ids},
            e.id AS id{level}, e.up AS up{level}
          FROM ({walk}) w LEFT JOIN {{edges}} e
            ON e.trace_id = w.trace_id AND e.id = coalesce(w.{last}, -2 - w.slice_id)
               AND w.{last} IS NOT NULL"""
    path = ", ".join(f"id{i}" for i in range(max_parents + 1))
    return spark.sql(
        f"""SELECT trace_id, slice_id, array_compact(array({path})) AS path,
                   up{max_parents} AS next_id
            FROM ({walk})""",
        seeds=seeds.select("trace_id", "slice_id").distinct(),
        edges=edges,
    )


def _few(seeds: DataFrame, beside: DataFrame, times: int = 1) -> bool:
    """Whether ``times`` rows per seed are few enough to be hashed beside a table."""
    return estimated_bytes(seeds) * times * FEW_SEEDS <= estimated_bytes(beside)


def call_stacks(
    seeds: DataFrame, slices: DataFrame, max_parents: int = MAX_PARENTS
) -> DataFrame:
    """``(trace_id, slice_id, stack, truncated)`` for every seed that names a slice.

    ``stack`` is leaf first. Few seeds walk level by level, and names are looked up after the
    walk, in one join. Many seeds in slices over the broadcast limit would send each walk at
    every level and each entry once more; their stacks are put together by doubling.
    """
    # written first: the size of few seeds out of many slices is known only then
    staged = materialize(seeds.select("trace_id", "slice_id").distinct(), "seeds")
    edges = slices.select("trace_id", "id", "parent_id")
    if fits_broadcast(slices.sparkSession, edges) or _few(staged, edges):
        return _walked_stacks(staged, slices, max_parents)
    return _doubled_stacks(staged, slices, max_parents)


def _walked_stacks(staged: DataFrame, slices: DataFrame, max_parents: int) -> DataFrame:
    """:func:`call_stacks` level by level."""
    paths = ancestor_paths(staged, slices, max_parents)
    entries = paths.select(
        "trace_id", "slice_id",
        F.col("next_id").isNotNull().alias("truncated"),
        F.posexplode("path").alias("level", "id"),
    )
    names = slices.select("trace_id", "id", "name", "parent_id")
    if fits_broadcast(slices.sparkSession, names):
        named = entries.join(F.broadcast(names), ["trace_id", "id"])
    elif _few(staged, names, times=max_parents + 1):
        named = entries.hint("shuffle_hash").join(names, ["trace_id", "id"])
    else:
        # as many entries as slices or more: a merge join spills, a hashed side does not
        named = entries.join(names, ["trace_id", "id"])
    entry = F.struct(
        "level", "name", "id", F.coalesce("parent_id", F.lit(ROOT_PARENT)).alias("parent_id")
    )
    return (
        named.groupBy("trace_id", "slice_id")
        # at most max_parents + 1 entries per seed
        .agg(F.array_sort(F.collect_list(entry)).alias("e"), F.first("truncated").alias("truncated"))
        .select(
            "trace_id", "slice_id",
            F.transform(
                "e",
                lambda x: F.struct(
                    x["name"].alias("name"), x["id"].alias("id"), x["parent_id"].alias("parent_id")
                ),
            ).alias("stack"),
            "truncated",
        )
    )


def _doubled_stacks(staged: DataFrame, slices: DataFrame, max_parents: int) -> DataFrame:
    """:func:`call_stacks` of many seeds: runs of callers that double in length.

    Every slice has a run: itself and its next callers, with their names, and ``up``, the
    caller after the last one. An open run is joined with the run of that caller, so a stack
    takes one join per doubling, and ended runs are left alone. Where an id names several
    slices, one run does not tell all stacks; seeds that may meet such an id walk level by
    level.
    """
    runs = materialize(_single_runs(staged, slices), "runs")
    repeated = not runs.filter("repeated").isEmpty()
    lengths = [max_parents + 1]
    while lengths[0] > 1:
        lengths.insert(0, (lengths[0] + 1) // 2)
    for length, longer in zip(lengths, lengths[1:]):
        doubled = _doubled(runs, length, longer)
        if longer < max_parents + 1:
            shorter, runs = runs, materialize(doubled, "runs")
            release(shorter)
        else:
            runs = doubled
    wanted = runs.filter("wanted")
    stack = F.arrays_zip(
        F.col("names").alias("name"), F.col("ids").alias("id"),
        F.concat(
            F.slice("ids", F.lit(2), F.size("ids")), F.array(F.coalesce("up", F.lit(ROOT_PARENT)))
        ).alias("parent_id"),
    )
    stacks = wanted.filter(~F.col("repeated")).select(
        "trace_id", F.col("id").alias("slice_id"), stack.alias("stack"),
        ((F.size("ids") == max_parents + 1) & F.col("up").isNotNull()).alias("truncated"),
    )
    if not repeated:
        return stacks
    others = wanted.filter("repeated").select("trace_id", F.col("id").alias("slice_id"))
    return stacks.unionByName(
        _walked_stacks(materialize(others, "seeds-by-level"), slices, max_parents)
    )


def _single_runs(staged: DataFrame, slices: DataFrame) -> DataFrame:
    """Runs of one slice: ``(trace_id, id, ids, names, up, wanted, repeated)``, a row per id."""
    up = F.when(F.col("parent_id") != ROOT_PARENT, F.col("parent_id"))
    same = Window.partitionBy("trace_id", "id")
    own = (
        slices.filter(F.col("trace_id").isNotNull() & F.col("id").isNotNull())
        .select("trace_id", "id", "name", up.alias("up"))
        .withColumn("place", F.row_number().over(same.orderBy("up", "name")))
        .withColumn("slices", F.count(F.lit(1)).over(same))
        .filter("place = 1")
    )
    seeds = staged.select("trace_id", F.col("slice_id").alias("id"), F.lit(True).alias("wanted"))
    return own.join(seeds, ["trace_id", "id"], "left").select(
        "trace_id", "id", F.array("id").alias("ids"), F.array("name").alias("names"), "up",
        F.coalesce("wanted", F.lit(False)).alias("wanted"), (F.col("slices") > 1).alias("repeated"),
    )


def _doubled(runs: DataFrame, length: int, longer: int) -> DataFrame:
    """Runs of up to ``longer`` slices from those of up to ``length``.

    A run that is shorter than ``length`` has ended: at a root, or at a caller that is not there.
    """
    taken = longer - length
    is_open = F.col("up").isNotNull() & (F.size("ids") == length)
    after = F.when(F.size("ids") > taken, F.get("ids", F.lit(taken))).otherwise(F.col("up"))
    callers = runs.select(
        "trace_id", F.col("id").alias("up"), F.slice("ids", 1, taken).alias("more_ids"),
        F.slice("names", 1, taken).alias("more_names"), after.alias("after"),
        F.col("repeated").alias("more_repeated"),
    )
    found = F.col("more_ids").isNotNull()
    joined = runs.filter(is_open).join(callers, ["trace_id", "up"], "left").select(
        "trace_id", "id",
        F.when(found, F.concat("ids", "more_ids")).otherwise(F.col("ids")).alias("ids"),
        F.when(found, F.concat("names", "more_names")).otherwise(F.col("names")).alias("names"),
        F.when(found, F.col("after")).otherwise(F.col("up")).alias("up"), "wanted",
        (F.col("repeated") | F.coalesce("more_repeated", F.lit(False))).alias("repeated"),
    )
    return joined.unionByName(runs.filter(~is_open))


def call_stacks_by_keyword(slices: DataFrame, keyword: str) -> DataFrame:
    """Stack of the longest slice per trace whose name contains ``keyword``."""
    hits = longest_slice_by_keyword(slices, keyword)
    return call_stacks(hits.select("trace_id", F.col("id").alias("slice_id")), slices)


def stack_text(stack: Column, truncated: Column, annotate: bool = False) -> Column:
    """Indented text, root first, the seed marked as the bottleneck; '' when empty.

    ``annotate`` adds a note to compiler-made and obfuscated names.
    """
    top_down = F.reverse(stack)
    last = F.size(stack) - 1

    def line(entry: Column, i: Column) -> Column:
        arrow = F.when(i > 0, F.concat(F.repeat(F.lit("  "), i), F.lit("→ "))).otherwise("")
        mark = F.when(i == last, BOTTLENECK_MARK).otherwise("")
        note = method_note(F.coalesce(entry["name"], F.lit(""))) if annotate else F.lit("")
        noted = F.when(note != "", F.concat(F.lit(" "), note)).otherwise("")
        return F.concat(arrow, F.coalesce(entry["name"], F.lit("")), F.lit("()"), noted, mark)

    cut = F.when(
        truncated, F.array(F.concat(F.repeat(F.lit("  "), F.size(stack)), F.lit(TRUNCATED_MARK)))
    ).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.transform(top_down, line), cut), "\n")
    return F.when(F.size(stack) > 0, text).otherwise("")
