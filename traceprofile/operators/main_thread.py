"""Restrict slices to the main thread of each trace."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceprofile.functions import predicates as P
from traceprofile.operators.joins import join_small

Tables = Mapping[str, DataFrame]

SLICE_COLUMNS = ("trace_id", "id", "track_id", "parent_id", "name", "ts", "dur")


def smallest_pid(process: DataFrame) -> DataFrame:
    """One pid per trace: the smallest, standing for the analysed process."""
    return process.groupBy("trace_id").agg(F.min("pid").alias("pid"))


def track_threads(tables: Tables, rule: str = "any") -> DataFrame:
    """``(trace_id, track_id, is_main)`` for every track with a known thread.

    The whole test runs on the small thread tables, so the slice table needs a single
    inner join. A trace without a process row keeps its other two ways to qualify.
    """
    tracks = tables["thread_track"].select("trace_id", F.col("id").alias("track_id"), "utid")
    threads = tables["thread"].select("trace_id", "utid", "tid", "name", "is_main_thread")
    joined = tracks.join(threads, ["trace_id", "utid"])
    if rule == "name_or_flag":
        pid = F.lit(None).cast("bigint")
    else:
        joined = joined.join(smallest_pid(tables["process"]), "trace_id", "left")
        pid = F.col("pid")
    test = P.is_main_thread(F.col("name"), F.col("tid"), F.col("is_main_thread"), pid, rule)
    return joined.select("trace_id", "track_id", test.alias("is_main"))


def main_tracks(tables: Tables, rule: str = "any") -> DataFrame:
    """``(trace_id, track_id)`` of main-thread tracks."""
    return track_threads(tables, rule).filter("is_main").select("trace_id", "track_id")


def join_tracks(slices: DataFrame, tracks: DataFrame, tables: Tables) -> DataFrame:
    """Attach per-track columns to slices; filter ``slices`` first, at the scan."""
    return join_small(
        slices, tracks, ["trace_id", "track_id"],
        inputs=(tables["thread_track"], tables["thread"]),
    )


def on_main_thread(slices: DataFrame, tables: Tables, rule: str = "any") -> DataFrame:
    """Rows of ``slices`` whose track belongs to a main thread."""
    return join_tracks(slices, main_tracks(tables, rule), tables)


def main_thread_slices(tables: Tables, rule: str = "any") -> DataFrame:
    return on_main_thread(tables["slice"].select(*SLICE_COLUMNS), tables, rule)
