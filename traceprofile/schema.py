"""Column layouts of every table the engine reads or writes.

All tables carry ``trace_id``: one job analyses any number of traces at once.
Times are integer nanoseconds; 64-bit addresses are held as two's complement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

SLICE = _struct(
    ("trace_id", _S, False), ("id", _L, False), ("track_id", _L, False),
    ("parent_id", _L, True), ("name", _S, True), ("ts", _L, False), ("dur", _L, False),
)
THREAD_TRACK = _struct(("trace_id", _S, False), ("id", _L, False), ("utid", _L, False))
THREAD = _struct(
    ("trace_id", _S, False), ("utid", _L, False), ("tid", _L, False),
    ("name", _S, True), ("is_main_thread", _I, True),
)
PROCESS = _struct(("trace_id", _S, False), ("pid", _L, False))

SLICE_MODEL = {"slice": SLICE, "thread_track": THREAD_TRACK, "thread": THREAD, "process": PROCESS}

SAMPLES = _struct(
    ("trace_id", _S, False), ("sample_ord", _L, False), ("marker", _I, True),
    ("depth", _I, False), ("frames", T.ArrayType(_L, False), False),
)
MAPPING = _struct(("trace_id", _S, True), ("addr", _L, False), ("name", _S, False))
TRACE_HEADER = _struct(
    ("trace_id", _S, False), ("version", _L, True), ("ts", _L, True),
    ("interval_us", _L, True), ("meta", _S, True), ("process_id", _L, True),
)
PARSE_STATS = _struct(("trace_id", _S, False), ("sample_count", _L, False), ("bad", _L, False))

STACK_ENTRY = _struct(("name", _S, True), ("id", _L, True), ("parent_id", _L, True))
STACKS = _struct(
    ("trace_id", _S, False), ("slice_id", _L, False),
    ("stack", T.ArrayType(STACK_ENTRY, False), False), ("truncated", T.BooleanType(), False),
)

# One row per diagnostic hit; slice kinds leave the aggregate fields NULL and vice versa.
FINDINGS = _struct(
    ("trace_id", _S, False), ("kind", _S, False), ("pos", _I, False), ("id", _L, True),
    ("name", _S, True), ("dur_ms", _D, True), ("ts", _L, True), ("dur", _L, True),
    ("count", _L, True), ("total_ms", _D, True), ("avg_ms", _D, True),
)
ISSUES = _struct(
    ("trace_id", _S, False), ("kind", _S, False), ("position", _I, False),
    ("severity", _S, False), ("id", _L, True), ("title", _S, True), ("what", _S, True),
    ("where", _S, True), ("duration", _S, True), ("duration_raw", _D, True),
    ("impact", _S, True), ("call_stack", _S, True), ("suggestion", _S, True),
    ("ts", _L, True), ("dur", _L, True),
)
REPORT = _struct(("trace_id", _S, False), ("markdown", _S, False))


def missing_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    """Names required by ``schema`` that ``df`` does not have."""
    present = set(df.columns)
    return [name for name in schema.fieldNames() if name not in present]
