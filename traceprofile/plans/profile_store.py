"""Sampling profiles that are kept as counts and grow by parts.

A *state* holds the counts behind the sampling reports, not the samples: one row per trace
and leaf address, per trace and head of a stack, per trace and method name. Samples that are
split into parts, each sample in one part, have states that merge by adding counts and taking
the least first use, so a report over all parts reads no sample again. Names are counted per
part with the map that applies to it; a sample lies in one part, so a name that is met at
several addresses still counts once for it.

A *store* is a folder with one folder per part, written under the name of the part, so that a
part added twice counts once. A ledger row per input file tells what a part was made of:
:func:`update_profile` reads only files that no part holds in their present form. Of the parts
with the same trace the last counts, by their names, so a changed trace replaces its counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceprofile.operators import sampling as S
from traceprofile.plans.profile import Reports
from traceprofile.session import materialize
from traceprofile.sources import trace_files

STATE = (
    "trace_id string, kind string, addr bigint, head array<bigint>, name string, "
    "count bigint, first_sample bigint, first_at int"
)
LEDGER = "trace_id string, path string, size bigint, modified timestamp"
_KEYS = ("trace_id", "kind", "addr", "head", "name")


def _first() -> Column:
    return F.struct("first_sample", "first_at")


def _rows(counts: DataFrame, kind: str, **key: str) -> DataFrame:
    """``counts`` in the layout of a state; ``key`` names the column that is counted by."""
    types = {"addr": "bigint", "head": "array<bigint>", "name": "string"}
    keys = [
        (F.col(key[c]) if c in key else F.lit(None)).cast(kind_of).alias(c)
        for c, kind_of in types.items()
    ]
    return counts.select(
        "trace_id", F.lit(kind).alias("kind"), *keys, "count",
        F.col("first_sample").cast("bigint"), F.col("first_at").cast("int"),
    )


def profile_state(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """The state of some samples; ``sample_ord`` numbers the samples of a trace over all parts."""
    at_leaf = F.lit(0).alias("first_at")
    leaves = S.leaf_counts(samples).select("*", F.col("first_seen").alias("first_sample"), at_leaf)
    heads = S.head_counts(samples).select("*", F.col("first_seen").alias("first_sample"), at_leaf)
    names = S.inclusive_counts(samples, mapping).select("*", "first_seen.*")
    return (
        _rows(leaves, "leaf", addr="addr").unionByName(_rows(heads, "head", head="head"))
        .unionByName(_rows(names, "name", name="name"))
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state of several, given as their union. Counts are added inside each task first."""
    return states.groupBy(*_KEYS).agg(
        F.sum("count").alias("count"), F.min(_first()).alias("first")
    ).select(*_KEYS, "count", "first.*")


def state_reports(state: DataFrame, mapping: DataFrame) -> Reports:
    """``sample_count``, ``self_time``, ``inclusive_time`` and ``hot_stacks`` of a merged state.

    ``mapping`` names leaves and heads, so it must be the one the state was made with.
    """
    def of(kind: str, *columns: str) -> DataFrame:
        return state.filter(F.col("kind") == kind).select("trace_id", *columns)

    leaves = of("leaf", "addr", "count", F.col("first_sample").alias("first_seen"))
    totals = S.totals_of(leaves)
    return Reports({
        "sample_count": lambda: totals,
        "self_time": lambda: S.self_time_of(leaves, mapping),
        "inclusive_time": lambda: S.inclusive_time_of(
            of("name", "name", "count", _first().alias("first_seen")), totals),
        "hot_stacks": lambda: S.hot_stacks_of(
            of("head", "head", "count", F.col("first_sample").alias("first_seen")), mapping, totals),
    })


def write_part(state: DataFrame, ledger: DataFrame, path: str, part: str) -> None:
    """Add a part to a store, or replace the part of that name.

    The ledger is written last: a part without it does not count, so a broken run is made good
    by the next one.
    """
    state.write.mode("overwrite").parquet(f"{path}/states/part={part}")
    ledger.write.mode("overwrite").parquet(f"{path}/ledger/part={part}")


def _read(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """All parts of one table of a store; empty where there are none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{layout}, part string")
    return spark.read.schema(f"{layout}, part string").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``(trace_id, path, size, modified, part)``: the files whose counts stand in the store."""
    files = _read(spark, f"{path}/ledger", LEDGER)
    newest = Window.partitionBy("trace_id")
    last = F.max("part").over(newest)
    return files.withColumn("last", last).filter(F.col("part") == F.col("last")).drop("last")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The merged state of a store, of each trace the part that counts."""
    valid = read_ledger(spark, path).select("trace_id", "part").distinct()
    states = _read(spark, f"{path}/states", STATE)
    return merge_states(states.join(valid, ["trace_id", "part"]).drop("part"))


def pending(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The listed files that are new or have another size or time than in the ledger."""
    known = ledger.select("trace_id", "path", "size", "modified")
    return files.join(known, ["trace_id", "path", "size", "modified"], "left_anti")


def update_profile(
    files: DataFrame, mapping: DataFrame, path: str, part: str,
    decode: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Count the listed files that the store lacks, as the part ``part``; their number.

    ``files`` has ``(trace_id, path, size, modified)`` and one file per trace; names of parts
    ascend with time. Nothing is written where nothing is pending. A file without a valid
    signature, or without a sample, goes to the ledger too, so that it is not read each time.
    """
    spark = files.sparkSession
    new = materialize(pending(files, read_ledger(spark, path)), "pending-files")
    n_new = new.count()
    if n_new:
        decode = decode or _decoded
        samples = materialize(decode(new), "pending-samples")
        write_part(profile_state(samples, mapping), new.select("trace_id", "path", "size", "modified"),
                   path, part)
    return n_new


def _decoded(files: DataFrame) -> DataFrame:
    valid = trace_files.valid_files(files.select("trace_id", "path", "size"))
    return trace_files.samples_of(trace_files.scan_files(valid))
