"""Slice tables at rest: one Parquet folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traceprofile import schema


def read_slice_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """``slice``, ``thread_track``, ``thread`` and ``process`` under ``folder``.

    Schemas are given, not inferred; columns and filters are pruned at the scan.
    """
    return {
        name: spark.read.schema(layout).parquet(f"{folder.rstrip('/')}/{name}")
        for name, layout in schema.SLICE_MODEL.items()
    }


def write_slice_model(tables: dict[str, DataFrame], folder: str) -> None:
    """Write the tables so that rows of a trace lie together.

    Range partitioning samples the key, so a hot trace is spread over several files
    while small traces share one; a query for few traces skips the other row groups.
    """
    for name, layout in schema.SLICE_MODEL.items():
        keys = ["trace_id", "ts"] if name == "slice" else ["trace_id"]
        (
            tables[name].select(*layout.fieldNames())
            .repartitionByRange(*keys)
            .sortWithinPartitions(*keys)
            .write.parquet(f"{folder.rstrip('/')}/{name}")
        )
