"""From sample files and symbol maps to the sampling reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame

from traceprofile.operators import sampling
from traceprofile.session import materialize
from traceprofile.sources import trace_files


class Reports(Mapping[str, DataFrame]):
    """Reports by name, each built when it is first asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]) -> None:
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def sample_profile(files: DataFrame, mapping: DataFrame) -> Reports:
    """All sampling reports by name, of a listing ``(trace_id, path, size)`` of files of any
    size or of rows ``(trace_id, content)``.

    Files are decoded once; the decoded samples are written to the shared folder and
    every report reads the columns it needs from there. Headers are read of files with the
    signature only. The samples of a trace are counted once, with its leaf counts.
    """
    valid = trace_files.valid_files(files)
    scan = materialize(trace_files.scan_files(valid), "sample-scan")
    samples = trace_files.samples_of(scan)
    headers = trace_files.trace_headers(valid)
    leaves = Reports({"leaves": lambda: materialize(sampling.leaf_counts(samples), "leaf-counts")})

    def totals() -> DataFrame:
        return sampling.totals_of(leaves["leaves"])

    return Reports({
        "headers": lambda: headers,
        "rejected": lambda: trace_files.rejected_files(files),
        "parse_stats": lambda: trace_files.parse_stats(scan),
        "sample_count": totals,
        "self_time": lambda: sampling.with_estimated_ms(
            sampling.self_time(samples, mapping, leaves=leaves["leaves"]), headers
        ),
        "inclusive_time": lambda: sampling.inclusive_time(samples, mapping, totals=totals()),
        "hot_stacks": lambda: sampling.hot_stacks(samples, mapping, totals=totals()),
    })
