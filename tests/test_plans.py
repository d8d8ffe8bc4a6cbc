"""Shape of the physical plans: what reaches the scan, what is shuffled, what is not."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.compare import force_shuffles
from traceprofile.functions.predicates import ISSUE_THRESHOLD_NS
from traceprofile.operators import callstack, diagnostics, joins
from traceprofile.session import materialize
from traceprofile.testing import bindings, registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def tables(spark):
    return bindings.slice_model(spark, SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_query_pairs_rows_without_an_equal_key(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


def test_top_k_is_cut_before_the_shuffle(tables):
    text = plan(diagnostics.long_slices(tables))
    # groups are cut in the task and after the shuffle, the folded rows once more
    assert len(re.findall(r"^\(\d+\) WindowGroupLimit", text, re.M)) == 3


@pytest.mark.parametrize("build", [
    diagnostics.long_slices, diagnostics.frame_jank, diagnostics.main_thread_io,
])
def test_groups_are_cut_before_anything_is_folded_or_sent(spark, tables, build):
    session = spark.newSession()
    force_shuffles(session)
    slices = session.read.schema(tables["slice"].schema).parquet(*tables["slice"].inputFiles())
    text = plan(build({**tables, "slice": slices})).split("== Physical Plan ==")[-1]
    order = re.findall(r"^\((\d+)\) (\w+)", text, re.M)
    number = {name: min(int(n) for n, x in order if x == name) for _, name in order}
    assert number["WindowGroupLimit"] < number["SortAggregate"]
    cut = number["WindowGroupLimit"]
    later = [int(n) for n, x in order if x == "Exchange" and int(n) > cut]
    assert later and not [n for n, x in order if x == "SortAggregate" and int(n) < min(later)]


def test_entries_of_all_walks_are_not_hashed(spark):
    session = spark.newSession()
    force_shuffles(session)
    slices = bindings.slice_model(session, SF)["slice"]
    slices = session.read.schema(slices.schema).parquet(*slices.inputFiles())
    every = slices.select("trace_id", F.col("id").alias("slice_id"))
    assert "ShuffledHashJoin" not in plan(callstack.call_stacks(every, slices))


def test_duration_bound_and_columns_reach_the_scan(tables):
    bounded = diagnostics.slice_findings(
        tables, [diagnostics.LONG_SLICES.above(ISSUE_THRESHOLD_NS)]
    )
    text = plan(bounded)
    assert f"GreaterThan(dur,{ISSUE_THRESHOLD_NS})" in text
    cpu = plan(diagnostics.cpu_heavy_all_threads(tables))
    assert "ReadSchema: struct<trace_id:string,name:string,dur:bigint>" in cpu


def test_counts_are_combined_before_the_shuffle(tables):
    text = plan(diagnostics.cpu_heavy(tables))
    assert "partial_count(1)" in text and "partial_sum(cast(dur" in text


def test_large_walks_share_one_exchange_of_the_slices(spark):
    session = spark.newSession()
    force_shuffles(session)
    slices = bindings.slice_model(session, "/root/testdata/sf0.01")["slice"]
    slices = session.read.schema(slices.schema).parquet(*slices.inputFiles())
    seeds = slices.filter("dur > 600000000").select("trace_id", F.col("id").alias("slice_id"))
    df = callstack.ancestor_paths(materialize(seeds, "seeds"), slices)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("ReusedExchange") >= callstack.MAX_PARENTS - 1
    assert "SortMergeJoin" not in text


def test_broadcast_only_below_the_limit(spark, tables):
    session = spark.newSession()
    fact = session.range(100).withColumn("k", F.col("id") % 3)
    small = session.range(3).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in plan(joins.join_small(fact, small, ["k"]))
    force_shuffles(session)
    plain = joins.join_small(fact, small, ["k"])
    assert "ShuffledHashJoin" in plan(plain) and plain.count() == 100
    salted = joins.join_small(fact, small, ["k"], spread_by="id", salts=4)
    assert "ShuffledHashJoin" in plan(salted) and "__salt" in plan(salted)
    assert salted.count() == 100
