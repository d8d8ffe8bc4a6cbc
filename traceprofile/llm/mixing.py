"""Mix sources to target weights.

The word budget of the mix is shared among sources by weight; no source is asked for more
than it can give, the rest is reshared (:func:`source_targets`). A source then repeats all
of its documents a whole number of times, and once more those whose hash lies below a
threshold. The threshold is found without sorting documents: words are summed by source
and bucket of the hash, the bucket in which the budget ends is split by the next bits, and
so on until the full hash is used (:data:`LEVELS` nested histograms). Only rows of the
boundary bucket take part in the next level.

Sources are in code-point order, NULL last. Defined results: a NULL or empty text has no
words and takes none; a NULL ``doc_id`` has a hash of its own; rows with the same id are
taken or left together; a source without words has target 0. Reruns agree, as the hash is
that of the id alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceprofile.llm import common as C
from traceprofile.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word of the input.
BUDGET = 1.5
#: No document is taken more often than this.
MAX_REPEATS = 2.0
#: Hex digits of the hash used by each level; 16 digits are 64 bits.
LEVELS = (4, 4, 4, 4)


def _order_of_hash(name: str = "doc_id") -> Column:
    """The first 16 hex digits of the id's MD5."""
    return F.substring(F.md5(F.coalesce(F.col(name).cast("string"), F.lit("null"))), 1, 16)


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, place)``: the words of each document and its hash."""
    return docs.select(
        "doc_id", "source", F.size(C.words(F.col("text"))).cast("long").alias("size"),
        _order_of_hash().alias("place"),
    )


def source_targets(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
    max_repeats: float = MAX_REPEATS,
) -> DataFrame:
    """``(source, source_size, target)``; one row per source, from sums by source.

    Sources that reach their limit are the first in the order of limit by weight. If k of
    them are full, the others get ``weight * level`` where the level spreads what is left
    over the weights left; k is the first number at which the next source is not full.
    """
    given = F.array(*[F.lit(float(w)) for w in weights])
    by_source = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ordered = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(ordered) - 1
    limits = by_source.withColumn("rank", rank).select(
        "source", "source_size", "rank",
        given[(F.col("rank") % len(weights)).cast("int")].alias("weight"),
        (F.col("source_size") * F.lit(float(max_repeats))).alias("limit"),
    )
    everything = Window.partitionBy(F.lit(1))
    fullest = everything.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    levels = limits.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(budget))).alias("mix"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("full"),
        F.sum("weight").over(fullest.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
    ).withColumn("level", (F.col("mix") - F.col("full")) / F.col("weight_left"))
    # the level is right at the first source that it does not fill
    first_open = F.min(
        F.when(
            F.col("limit") >= F.col("level") * F.col("weight"),
            F.struct((F.col("limit") / F.col("weight")).alias("ratio"), "rank", "level"),
        )
    ).over(everything)
    target = F.least(
        F.col("limit"),
        F.coalesce(F.col("weight") * F.col("first_open.level"), F.col("limit")),
    )
    return levels.withColumn("first_open", first_open).select(
        "source", "source_size", F.greatest(target, F.lit(0.0)).alias("target")
    )


def _thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, repeats, threshold)``: documents with ``place < threshold`` are taken once
    more than ``repeats`` times; a NULL threshold takes none."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("repeats", whole.cast("long")).select(
        "source", "repeats",
        (F.col("target") - F.col("repeats") * F.col("source_size")).alias("left"),
        F.lit("").alias("prefix"),
    )
    rows = sized.filter(F.col("size") > 0).select("source", "place", "size")
    used = 0
    for digits in LEVELS:
        used += digits
        # only the bucket in which the budget ends is looked into
        here = rows.join(
            state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
        ).filter(F.substring("place", 1, used - digits) == F.col("prefix"))
        bucket = here.groupBy("source", F.substring("place", 1, used).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("left").alias("left"),
            F.first("repeats").alias("repeats"),
        )
        upto = Window.partitionBy("source").orderBy("bucket")
        bucket = bucket.withColumn("end", F.sum("words").over(upto)).withColumn(
            "start", F.col("end") - F.col("words")
        )
        crossing = bucket.filter((F.col("start") <= F.col("left")) & (F.col("end") > F.col("left")))
        state = crossing.select(
            "source", "repeats", (F.col("left") - F.col("start")).alias("left"),
            F.col("bucket").alias("prefix"), F.col("words"),
        )
    # one hash is left: it is taken if that is nearer to the target
    return state.select(
        "source",
        F.when(F.col("left") * 2 > F.col("words"), F.concat("prefix", F.lit("~")))
        .otherwise(F.col("prefix")).alias("threshold"),
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
    max_repeats: float = MAX_REPEATS,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` of every document."""
    sized = materialize(sizes(docs), "mix-sizes")
    targets = materialize(source_targets(sized, weights, budget, max_repeats), "mix-targets")
    thresholds = materialize(_thresholds(sized, targets), "mix-thresholds")
    plan = targets.join(
        thresholds.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left"
    ).select(
        F.col("source").alias("of"), "source_size", "target", "threshold",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(0).cast("long").alias("repeats"),
    )
    more = F.coalesce(F.col("place") < F.col("threshold"), F.lit(False)).cast("long")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.col("repeats") + more)).alias("taken"),
    )

