"""Stored profiles: parts merge to the whole, and only new or changed files are read."""

from __future__ import annotations

import random

import pytest

from traceprofile import schema
from traceprofile.operators import sampling as S
from traceprofile.plans import profile_store as P
from traceprofile.plans.profile import sample_profile
from traceprofile.sources.file_ranges import list_file_versions, list_files
from traceprofile.sources.mapping_files import parse_mapping
from traceprofile.testing import bindings

NAMES = ("self_time", "inclusive_time", "hot_stacks")


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def mapping(spark):
    names = [(t, a, f"void m{a % 4}(int)") for t in ("a", "b") for a in range(12)]
    return spark.createDataFrame(names, schema.MAPPING)


def _samples(spark, seed, traces=("a", "b"), n=120):
    rng = random.Random(seed)
    rows = []
    for t in traces:
        for i in range(n):
            frames = [rng.randrange(15) for _ in range(rng.randrange(0, 9))]
            rows.append((t, i, 2, len(frames), frames))
    return spark.createDataFrame(rows, schema.SAMPLES)


def _direct(samples, mapping):
    return {name: _rows(getattr(S, name)(samples, mapping)) for name in NAMES}


def _files(spark, rows):
    return spark.createDataFrame(
        [(t, f"/x/{t}", size, None) for t, size in rows], P.LEDGER
    ).withColumn("modified", P.F.lit("2024-01-15 10:30:45").cast("timestamp"))


def test_parts_merge_to_the_whole(spark, mapping):
    samples = _samples(spark, 1)
    halves = [P.profile_state(samples.filter(f"sample_ord % 2 = {i}"), mapping) for i in (0, 1)]
    reports = P.state_reports(P.merge_states(halves[0].unionByName(halves[1])), mapping)
    assert {name: _rows(reports[name]) for name in NAMES} == _direct(samples, mapping)
    assert _rows(reports["sample_count"]) == _rows(S.sample_count(samples))


def test_only_new_and_changed_files_are_read(spark, mapping, tmp_path):
    path, read = str(tmp_path / "store"), []
    first, second = _samples(spark, 1), _samples(spark, 2, ("b", "c"))

    def decode(samples):
        def of(new):
            names = sorted(r["trace_id"] for r in new.select("trace_id").collect())
            read.append(names)
            return samples.filter(P.F.col("trace_id").isin(names))
        return of

    assert P.update_profile(_files(spark, [("a", 1), ("b", 1)]), mapping, path, "1", decode(first)) == 2
    assert P.update_profile(_files(spark, [("a", 1), ("b", 1)]), mapping, path, "2", decode(first)) == 0
    # b has changed, c is new, a stays
    now = _files(spark, [("a", 1), ("b", 2), ("c", 1)])
    assert P.update_profile(now, mapping, path, "3", decode(second)) == 2
    assert read == [["a", "b"], ["b", "c"]]
    state = P.read_state(spark, path)
    whole = first.filter("trace_id = 'a'").unionByName(second)
    reports = P.state_reports(state, mapping)
    assert {name: _rows(reports[name]) for name in NAMES} == _direct(whole, mapping)


def test_a_part_without_its_ledger_does_not_count(spark, mapping, tmp_path):
    path = str(tmp_path / "store")
    samples = _samples(spark, 3)
    P.update_profile(_files(spark, [("a", 1), ("b", 1)]), mapping, path, "1", lambda new: samples)
    P.profile_state(samples, mapping).write.parquet(f"{path}/states/part=2")
    got = P.state_reports(P.read_state(spark, path), mapping)
    assert _rows(got["self_time"]) == _rows(S.self_time(samples, mapping))


def test_an_empty_store(spark, mapping, tmp_path):
    state = P.read_state(spark, str(tmp_path / "none"))
    assert state.count() == 0 and P.state_reports(state, mapping)["self_time"].count() == 0


def test_a_folder_of_files(spark, tmp_path):
    """The same reports as from the files themselves; a second update reads nothing."""
    folder = bindings.trace_folder(spark, "/root/testdata/sf0.001")
    symbols = parse_mapping(list_files(spark, folder, "*-mapping"))
    forms, path = list_file_versions(spark, folder, "sampling"), str(tmp_path / "store")
    assert P.update_profile(forms, symbols, path, "1") == forms.count() > 0
    assert P.update_profile(forms, symbols, path, "2") == 0
    got = P.state_reports(P.read_state(spark, path), symbols)
    want = sample_profile(list_files(spark, folder, "sampling"), symbols)
    for name in ("inclusive_time", "hot_stacks", "sample_count"):
        assert _rows(got[name]) == _rows(want[name]) != []
