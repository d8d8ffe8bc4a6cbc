"""Formatting functions against exact models."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from traceprofile.functions import text


def _values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_one_decimal_rounds_the_exact_binary_value(spark):
    rng = random.Random(7)
    xs = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95, 0.96, 99.95,
          1.005, 1e12 + 0.25, 16.65, -0.04, -0.25, -3.35, 600.0]
    xs += [rng.uniform(0, 5000) for _ in range(300)]
    xs += [rng.randrange(0, 10**6) / 100 for _ in range(300)]
    got = _values(spark, [(x,) for x in xs], "x double", text.to_fixed1(F.col("x")))

    def model(x: float) -> str:
        size = Decimal(abs(x)).quantize(Decimal("0.1"), ROUND_HALF_UP)
        return ("-" if x < 0 else "") + str(size)

    assert [g[0] for g in got] == [model(x) for x in xs]


def test_one_decimal_of_null_is_null(spark):
    assert _values(spark, [(None,)], "x double", text.to_fixed1(F.col("x"))) == [(None,)]


def test_addresses_print_unsigned_and_read_back(spark):
    addresses = [0, 1, 255, 2**63 - 1, -(2**63), -1]
    rows = _values(
        spark, [(a,) for a in addresses], "a bigint",
        text.native_name(F.col("a")), text.parse_hex_address(text.hex_address(F.col("a"))),
    )
    assert [r[0] for r in rows] == [f"native:0x{a % 2**64:x}" for a in addresses]
    assert [r[1] for r in rows] == addresses


def test_short_name_stops_at_the_first_parenthesis(spark):
    rows = [("void a.b(int)(x)",), ("plain",), ("",)]
    got = _values(spark, rows, "n string", text.short_name(F.col("n")))
    assert got == [("void a.b",), ("plain",), ("",)]


def test_report_file_names(spark):
    rows = [("2024-01-15 10:30:45",), ("2024-03-05 08:05:03",)]
    got = _values(spark, rows, "t string", text.report_filename(F.to_timestamp_ntz("t")))
    assert got == [
        ("perfetto_analysis_report_20240115_103045.md",),
        ("perfetto_analysis_report_20240305_080503.md",),
    ]


def test_trace_name_from_path_or_time(spark):
    rows = [("https://h/x/strace_abc123_huawei?k=1",), ("https://h/x/file.bin",)]
    as_of = F.expr("TIMESTAMP_NTZ '2024-03-05 08:05:03'")
    got = _values(spark, rows, "p string", text.trace_id_from_path(F.col("p"), as_of))
    assert got == [("strace_abc123_huawei",), ("analysis_20240305_080503",)]
