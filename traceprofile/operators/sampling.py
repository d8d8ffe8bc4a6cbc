"""Sampling profile: self time, inclusive time and hot stacks.

Counts are taken per *address* first, inside each task; symbol names are looked up for
the few distinct addresses and merged afterwards. Raw samples are never joined with the
symbol map for a count, and no list grows with the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceprofile.functions.predicates import not_runtime_overhead
from traceprofile.functions.text import native_name, short_name
from traceprofile.operators.joins import fits_broadcast, has_known_size, join_small
from traceprofile.operators.topk import top_k
from traceprofile.session import materialize

# Rows reported, frames that identify a hot stack, typical interval.
SELF_LIMIT = 30
INCLUSIVE_LIMIT = 30
STACK_LIMIT = 15
STACK_FRAMES = 5
DEFAULT_INTERVAL_US = 25_000


def name_addresses(df: DataFrame, mapping: DataFrame, hashed: bool = False) -> DataFrame:
    """Add ``name`` for ``addr``: the mapped one, else the native form.

    A map with ``trace_id`` applies to its trace, one without to all traces. Of several
    names of one address the last counts, in the order of their files where ``path`` is
    kept, then of the names. A map under the size limit is broadcast, otherwise AQE splits
    a hot address; so it is where nothing tells the size of a map before it is read. ``hashed``
    is for a ``df`` that holds addresses many times: a partition of the symbols, each of which
    is there once, is hashed, and the rows of a hot address pass by it unsorted.
    """
    keys = ["trace_id", "addr"] if "trace_id" in mapping.columns else ["addr"]
    if "path" in mapping.columns:
        last = F.max(F.struct("path", "name"))["name"]
    else:
        last = F.max("name")
    symbols = mapping.groupBy(*keys).agg(last.alias("mapped_name"))
    known = has_known_size(mapping)
    if known and fits_broadcast(df.sparkSession, mapping):
        symbols = F.broadcast(symbols)
    elif hashed:
        symbols = symbols.hint("shuffle_hash")
    elif not known:
        # else Spark broadcasts it by itself, for the size of the listing
        symbols = symbols.hint("merge")
    return (
        df.join(symbols, keys, "left")
        .withColumn("name", F.coalesce("mapped_name", native_name(F.col("addr"))))
        .drop("mapped_name")
    )


def symbolized_frames(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every frame of every sample with its name; ``frame_pos`` 0 is the leaf."""
    frames = samples.select(
        "trace_id", "sample_ord", F.posexplode("frames").alias("frame_pos", "addr")
    )
    return name_addresses(frames, mapping, hashed=True).select(
        "trace_id", "sample_ord", "frame_pos", "addr", "name"
    )


def sample_count(samples: DataFrame) -> DataFrame:
    """Samples per trace, the denominator of every percentage."""
    return samples.groupBy("trace_id").agg(F.count(F.lit(1)).alias("sample_count"))


def _most_common(counts: DataFrame, totals: DataFrame, tie: Column, n: int) -> DataFrame:
    """The ``n`` largest counts per trace, ties by first appearance, with percentages of
    the samples in ``totals``."""
    best = top_k(counts, ["trace_id"], [F.col("count").desc(), tie], n)
    percent = F.col("count") / F.col("sample_count") * 100
    return best.join(totals, "trace_id").withColumn("percent", percent)


def _merge_names(per_address: DataFrame, mapping: DataFrame) -> DataFrame:
    return (
        name_addresses(per_address, mapping)
        .groupBy("trace_id", "name")
        .agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"))
    )


_METHOD_COLUMNS = ("trace_id", "pos", "name", "short_name", "count", "percent")


def _method_report(df: DataFrame) -> DataFrame:
    return df.withColumn("short_name", short_name(F.col("name"))).select(*_METHOD_COLUMNS)


def self_time(
    samples: DataFrame, mapping: DataFrame, n: int = SELF_LIMIT, skip_runtime: bool = False,
    leaves: DataFrame | None = None,
) -> DataFrame:
    """Samples per leaf method. ``skip_runtime`` leaves out runtime bookkeeping before
    ranking; percentages keep all samples as their base. ``leaves`` are leaf counts that
    are known already."""
    return self_time_of(leaf_counts(samples) if leaves is None else leaves, mapping, n, skip_runtime)


def self_time_of(
    leaves: DataFrame, mapping: DataFrame, n: int = SELF_LIMIT, skip_runtime: bool = False
) -> DataFrame:
    """:func:`self_time` from leaf counts."""
    counts = _merge_names(leaves.filter(F.col("addr").isNotNull()), mapping)
    if skip_runtime:
        counts = counts.filter(not_runtime_overhead(short_name(F.col("name"))))
    return _method_report(_most_common(counts, totals_of(leaves), F.col("first_seen"), n))


def leaf_counts(samples: DataFrame) -> DataFrame:
    """Samples per leaf address and the first of them; an empty stack has no address."""
    return (
        samples.select("trace_id", F.get("frames", F.lit(0)).alias("addr"), "sample_ord")
        .groupBy("trace_id", "addr")
        .agg(F.count(F.lit(1)).alias("count"), F.min("sample_ord").alias("first_seen"))
    )


def totals_of(leaves: DataFrame) -> DataFrame:
    """Samples per trace from their leaf counts, empty stacks included."""
    return leaves.groupBy("trace_id").agg(F.sum("count").alias("sample_count"))


def _address_occurrences(samples: DataFrame) -> DataFrame:
    """One row per sample and distinct address, with the place of its first use."""
    return samples.select(
        "trace_id", "sample_ord", F.posexplode(F.array_distinct("frames")).alias("at", "addr")
    )


def _first_use() -> list[Column]:
    """Smallest sample and the place in it, as two numbers of fixed width; a sample holds
    a key once."""
    return [F.min("sample_ord").alias("first_sample"), F.min_by("at", "sample_ord").alias("first_at")]


def inclusive_counts(samples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Samples per method found anywhere in the stack, each sample counted once.

    A name with one address in its trace is counted by that address. Only names shared
    by several addresses can meet twice in a sample; their occurrences, and no others,
    are regrouped by sample. Both parts are exact and no name is in both.
    """
    occurrences = _address_occurrences(samples)
    first_seen = F.struct("first_sample", "first_at").alias("first_seen")
    per_address = occurrences.groupBy("trace_id", "addr").agg(
        F.count(F.lit(1)).alias("count"), *_first_use()
    ).select("trace_id", "addr", "count", first_seen)
    # read three times below; writing this short table spares three scans of the samples
    # and tells the true size of the part that is joined with them
    named = materialize(name_addresses(per_address, mapping), "named-addresses")
    per_name = named.groupBy("trace_id", "name").agg(
        F.count(F.lit(1)).alias("addresses"), F.min("addr").alias("lead"),
        F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"),
    )
    single = per_name.filter(F.col("addresses") == 1)
    several = per_name.filter(F.col("addresses") > 1).select("trace_id", "name", "lead")
    # names are stood for by one of their addresses while occurrences are shuffled
    leads = named.join(several, ["trace_id", "name"]).select("trace_id", "addr", "lead")
    regrouped = (
        join_small(occurrences, leads, ["trace_id", "addr"], inputs=(named,))
        .groupBy("trace_id", "lead", "sample_ord")
        .agg(F.min("at").alias("at"))
        .groupBy("trace_id", "lead")
        .agg(F.count(F.lit(1)).alias("count"), *_first_use())
        .select("trace_id", "lead", "count", first_seen)
        .join(several, ["trace_id", "lead"])
    )
    columns = ("trace_id", "name", "count", "first_seen")
    return single.select(*columns).unionByName(regrouped.select(*columns))


def inclusive_time(
    samples: DataFrame, mapping: DataFrame, n: int = INCLUSIVE_LIMIT,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Samples per method anywhere in the stack; ``totals`` spares counting the samples."""
    totals = sample_count(samples) if totals is None else totals
    return inclusive_time_of(inclusive_counts(samples, mapping), totals, n)


def inclusive_time_of(counts: DataFrame, totals: DataFrame, n: int = INCLUSIVE_LIMIT) -> DataFrame:
    """:func:`inclusive_time` from the counts of names."""
    return _method_report(_most_common(counts, totals, F.col("first_seen"), n))


def hot_stacks(
    samples: DataFrame, mapping: DataFrame, n: int = STACK_LIMIT, totals: DataFrame | None = None
) -> DataFrame:
    """Samples per sequence of the first five names.

    Sequences are grouped as arrays, so a name that contains the separator of the text
    form is not confused with two names.
    """
    totals = sample_count(samples) if totals is None else totals
    return hot_stacks_of(head_counts(samples), mapping, totals, n)


def head_counts(samples: DataFrame) -> DataFrame:
    """Samples per first five addresses and the first of them."""
    return (
        samples.select(
            "trace_id", F.slice("frames", 1, STACK_FRAMES).alias("head"), "sample_ord"
        )
        .groupBy("trace_id", "head")
        .agg(F.count(F.lit(1)).alias("count"), F.min("sample_ord").alias("first_seen"))
    )


def hot_stacks_of(
    heads: DataFrame, mapping: DataFrame, totals: DataFrame, n: int = STACK_LIMIT
) -> DataFrame:
    """:func:`hot_stacks` from the counts of stack heads."""
    frames = heads.select(
        "trace_id", "head", "count", "first_seen", F.posexplode("head").alias("at", "addr")
    )
    sequences = (
        name_addresses(frames, mapping)
        .groupBy("trace_id", "head", "count", "first_seen")  # at most five rows each
        .agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("s"))
        .select("trace_id", "count", "first_seen", F.col("s.name").alias("names"))
        .groupBy("trace_id", "names")
        .agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"))
    )
    best = _most_common(sequences, totals, F.col("first_seen"), n)
    return best.select(
        "trace_id", "pos", F.array_join("names", "|").alias("stack"),
        F.array_join(F.transform("names", short_name), "\n").alias("short_stack"),
        "count", "percent",
    )


def with_estimated_ms(
    methods: DataFrame, interval_us: int | DataFrame = DEFAULT_INTERVAL_US
) -> DataFrame:
    """Add ``est_ms``: one sample stands for one sampling interval. ``interval_us`` is a
    number for all traces or a header table with ``(trace_id, interval_us)``."""
    if isinstance(interval_us, DataFrame):
        headers = interval_us.select("trace_id", "interval_us")
        joined = methods.join(headers, "trace_id", "left")
        return joined.withColumn(
            "est_ms", F.col("count") * F.col("interval_us") / 1000
        ).drop("interval_us")
    return methods.withColumn("est_ms", F.col("count") * F.lit(interval_us) / 1000)
