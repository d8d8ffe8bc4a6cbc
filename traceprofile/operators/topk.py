"""Duplicate collapse and top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_duplicates(df: DataFrame, keys: list[str], order_by: str, keep: list[str]) -> DataFrame:
    """One row per ``keys``: the one with the smallest ``order_by``.

    Written as an aggregate, so each task sends at most one row per key and a key
    shared by a large part of the table is combined before the shuffle.
    """
    payload = [order_by, *[c for c in keep if c != order_by and c not in keys]]
    best = F.min(F.struct(*payload)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[f"__best.{c}" for c in payload])


def top_k(
    df: DataFrame, partition: list[str], order: list[Column], k: int, position: str = "pos"
) -> DataFrame:
    """First ``k`` rows per partition with their position from 1.

    The bound on ``row_number`` makes Spark cut every task to ``k`` rows per partition
    key before the shuffle, so a hot trace sends ``k`` rows per task.
    """
    ranked = df.withColumn(
        position, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    )
    return ranked.filter(F.col(position) <= k)


def top_groups(df: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    """All rows of the first ``k`` groups of equal ``order`` values per partition.

    Like :func:`top_k` it is cut in each task before the shuffle, to the rows of ``k``
    groups; nothing is folded or sorted for it beforehand.
    """
    ranked = df.withColumn(
        "__group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order))
    )
    return ranked.filter(F.col("__group") <= k).drop("__group")
