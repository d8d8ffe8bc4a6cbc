"""What lies on the timeline around each issue.

Slices meet focus windows in an equal join over time bins. A slice has one key: its trace,
its level (the power of two that its duration fits in, at least that of the longest window)
and the bin of that width in which it starts. A window is copied, at every level there is,
to the bins in which an overlapping slice of that level may start; as bins are no shorter
than a window or such a slice, these are three at most. So every pair that overlaps meets
exactly once, slices are never multiplied, and a trace with many slices is many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceprofile.operators.issues import focus_window
from traceprofile.operators.joins import fits_broadcast
from traceprofile.session import materialize

#: Level of windows and slices that need none higher: bins of 2^20 ns, about a millisecond.
LEAST_LEVEL = 20


def windows_of(issues: DataFrame, pad: str = "tenth") -> DataFrame:
    """``(trace_id, position, kind, id, start, end)`` of the focus windows of issues."""
    return focus_window(issues, pad).select(
        "trace_id", "position", "kind", "id", F.col("window_start").alias("start"),
        (F.col("window_start") + F.col("window_width")).alias("end"),
    )


def _level(duration: Column, least: int) -> Column:
    """The smallest level, ``least`` or more, whose bins hold a duration."""
    bits = F.length(F.bin(F.greatest(duration, F.lit(1)) - 1))
    return F.when(duration > 1, F.greatest(bits, F.lit(least))).otherwise(least)


def _bin(time: Column, level: Column) -> Column:
    return F.call_function("shiftright", time, level)


def binned_windows(windows: DataFrame, least: int, most: int) -> DataFrame:
    """``windows`` once for each ``(level, bin)`` in which an overlapping slice may start."""
    levels = windows.withColumn("level", F.explode(F.sequence(F.lit(least), F.lit(most))))
    width = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level"))
    first, last = _bin(F.col("start") - width, F.col("level")), _bin(F.col("end"), F.col("level"))
    return levels.withColumn("bin", F.explode(F.sequence(first, last)))


def slices_in_windows(slices: DataFrame, issues: DataFrame, pad: str = "tenth") -> DataFrame:
    """Slices that overlap a focus window of their trace, once per window.

    Windows are few beside slices; they are written first, and so their size is known. Where
    the bounds of the windows per trace fit a broadcast, slices outside of them leave at the
    scan. Where the binned windows fit one too, slices are not shuffled at all.
    """
    spark = slices.sparkSession
    windows = materialize(windows_of(issues, pad), "windows")
    length = F.max(F.col("end") - F.col("start"))
    least = windows.select(F.coalesce(_level(length, LEAST_LEVEL), F.lit(LEAST_LEVEL))).first()[0]
    longest = F.max("dur")
    most = slices.select(F.coalesce(_level(longest, least), F.lit(least))).first()[0]
    columns = slices.select("trace_id", F.col("id").alias("slice_id"), "track_id", "name", "ts", "dur")
    end = F.col("ts") + F.col("dur")
    bounds = windows.groupBy("trace_id").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    if fits_broadcast(spark, windows):
        inside = columns.join(
            F.broadcast(bounds), "trace_id"
        ).filter((F.col("ts") < F.col("high")) & (end > F.col("low"))).drop("low", "high")
    else:
        inside = columns
    keyed = inside.withColumn("level", _level(F.col("dur"), least)).withColumn(
        "bin", _bin(F.col("ts"), F.col("level"))
    )
    binned = binned_windows(windows, least, most)
    # every window is there three times at most for each level
    if fits_broadcast(spark, *[windows] * (3 * (most - least + 1))):
        binned = F.broadcast(binned)
    else:
        binned = binned.hint("shuffle_hash")
    joined = keyed.join(binned, ["trace_id", "level", "bin"]).filter(
        (F.col("ts") < F.col("end")) & (end > F.col("start"))
    )
    return joined.select(
        "trace_id", "position", "kind", "id", "slice_id", "track_id", "name", "ts", "dur",
        (F.least(end, F.col("end")) - F.greatest("ts", F.col("start"))).alias("overlap_ns"),
    )


def issue_context(slices: DataFrame, issues: DataFrame, pad: str = "tenth") -> DataFrame:
    """Per issue window: overlapping slices, time inside it and the longest of them.

    Fixed-width partial results per window are combined before the shuffle.
    """
    return (
        slices_in_windows(slices, issues, pad)
        .groupBy("trace_id", "position", "kind", "id")
        .agg(
            F.count(F.lit(1)).alias("slice_count"),
            F.sum("overlap_ns").alias("overlap_ns"),
            F.max("dur").alias("longest_ns"),
            F.min("ts").alias("first_ts"),
        )
    )
