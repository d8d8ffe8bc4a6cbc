"""Joins of a large table with a small one, chosen by a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes up to which a side may be broadcast.
BROADCAST_CONF = "spark.traceprofile.broadcastBytes"
DEFAULT_BROADCAST_BYTES = 10 * 1024 * 1024

_SALT = "__salt"


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_CONF, str(DEFAULT_BROADCAST_BYTES)))


def estimated_bytes(*frames: DataFrame) -> int:
    """Sum of the optimizer's size estimates (file sizes after column pruning).

    No job runs. Pass the *inputs* of a joined dimension rather than the join: the
    optimizer multiplies the sides of a join, the inputs bound a key-unique one.
    """
    return sum(
        int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        for df in frames
    )


def has_known_size(df: DataFrame) -> bool:
    """Whether the optimizer's estimate of ``df`` tells of its rows.

    Of rows that a Python function makes it knows the input only: symbols read from files are
    taken for as few as the rows of the listing.
    """
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if "InArrow" in node.nodeName() or "InPandas" in node.nodeName():
            return False
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return True


def fits_broadcast(spark: SparkSession, *inputs: DataFrame) -> bool:
    return estimated_bytes(*inputs) <= broadcast_limit(spark)


def join_small(
    fact: DataFrame,
    small: DataFrame,
    on: list[str],
    *,
    spread_by: str | None = None,
    how: str = "inner",
    salts: int = 1,
    inputs: tuple[DataFrame, ...] | None = None,
) -> DataFrame:
    """Join ``fact`` with ``small`` on equal keys; hot keys do not end in one task.

    Under the size limit the small side is broadcast and the large side is not
    shuffled. Over it both sides are shuffled, the small one is hashed rather than the
    large one sorted, and AQE splits the partition of a hot key by its measured size.

    AQE leaves a join alone when the next step groups by a superset of the join keys,
    because it reuses their layout. Such callers pass ``salts``: each key of the small
    side is repeated once per salt and a row of the large side picks its salt by hashing
    ``spread_by``, a column that differs within a hot key.
    """
    spark = fact.sparkSession
    if fits_broadcast(spark, *(inputs or (small,))):
        return fact.join(F.broadcast(small), on, how)
    if salts == 1:
        return fact.join(small.hint("shuffle_hash"), on, how)
    salted_fact = fact.withColumn(
        _SALT, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    )
    salted_small = small.withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted_fact.join(salted_small.hint("shuffle_hash"), [*on, _SALT], how).drop(_SALT)
