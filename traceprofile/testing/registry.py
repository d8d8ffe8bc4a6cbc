"""Named queries over the driver tables, one per operator of the blueprint."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceprofile.functions import annotate, text
from traceprofile.functions import predicates as P
from traceprofile.operators import callstack as C
from traceprofile.operators import diagnostics as D
from traceprofile.operators import issues as I
from traceprofile.operators import sampling as S
from traceprofile.operators.context import issue_context
from traceprofile.operators.main_thread import SLICE_COLUMNS, main_thread_slices
from traceprofile.operators.topk import collapse_duplicates
from traceprofile.plans import analysis, profile_store, report
from traceprofile.plans.profile import sample_profile
from traceprofile.session import materialize, new_shared_path
from traceprofile.sources import mapping_files, outputs, trace_files
from traceprofile.sources.file_ranges import list_files
from traceprofile.testing import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
Tables = dict[str, DataFrame]

# A fixed report time keeps results repeatable.
AS_OF = "2024-01-15 10:30:45"
KEYWORD = "submit"


def _as_of():
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def _on_slices(operator: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(B.slice_model(spark, sf_dir))


def _on_samples(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(B.samples(spark, sf_dir), B.mapping(spark, sf_dir))


def _on_trace_files(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(B.trace_files(spark, sf_dir))


def _stack_rows(stacks: DataFrame, annotate: bool = False) -> DataFrame:
    return stacks.select(
        "trace_id", "slice_id", F.size("stack").alias("entries"), "truncated",
        C.stack_text(F.col("stack"), F.col("truncated"), annotate).alias("call_stack"),
    )


def _dedup(tables: Tables) -> DataFrame:
    keys = ["trace_id", "ts", "dur"]
    return collapse_duplicates(main_thread_slices(tables), keys, "id", ["name"])


def _severity(tables: Tables) -> DataFrame:
    label = I.severity(text.ns_to_ms(F.col("dur")))
    return tables["slice"].select(
        "trace_id", "id", label.alias("severity"), I.severity_rank(label).alias("severity_rank")
    )


def _issue_text(tables: Tables) -> DataFrame:
    hits = I.counted_hits(analysis.all_findings(tables))
    return I.issue_texts(hits).drop("id", "name", "dur_ms", "ts", "dur", "count", "total_ms", "avg_ms")


def _focus_windows(tables: Tables) -> DataFrame:
    issues = analysis.staged_issues(tables)
    columns = ["trace_id", "kind", "id", "position"]
    return reduce(DataFrame.unionByName, [
        I.focus_window(issues, pad).select(
            *columns, F.lit(pad).alias("pad"), "window_start", "window_width"
        )
        for pad in ("tenth", "third", "none")
    ])


def _seed_stacks(tables: Tables) -> DataFrame:
    return C.call_stacks(analysis.stack_seeds(tables), tables["slice"])


def _all_stacks(tables: Tables) -> DataFrame:
    slices = tables["slice"]
    return C.call_stacks(slices.select("trace_id", F.col("id").alias("slice_id")), slices)


def _counts_with_a_broken_trace(tables: Tables) -> DataFrame:
    """Rows per trace and diagnostic when one search fails on the slices of one trace; the
    failed pair has no number."""
    def broken(own: Tables) -> DataFrame:
        fails = F.raise_error(F.lit("unreadable")).cast("bigint")
        dur = F.when(F.col("trace_id") == "t1", fails).otherwise(F.col("dur"))
        return D.frame_jank({**own, "slice": own["slice"].withColumn("dur", dur)})

    results, _, failures = D.run_diagnostics(tables, {**D.DIAGNOSTICS, "frame_jank": broken})
    lost = failures.select("trace_id", "diagnostic", F.lit(None).cast("bigint").alias("rows"))
    return D.diagnostic_counts(results).unionByName(lost)


def _issues_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "issues")
    outputs.write_issues(analysis.analyze(B.slice_model(spark, sf_dir)), path)
    return outputs.read_issues(spark, path)


def _from_parts(name: str) -> Query:
    """A report of a store to which the samples came in three parts, one of them twice."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        samples, mapping = B.samples(spark, sf_dir), B.mapping(spark, sf_dir)
        # the part that comes twice is counted once, and written twice
        states = [
            materialize(
                profile_store.profile_state(samples.filter(F.col("sample_ord") % 3 == i), mapping),
                "part-state",
            )
            for i in range(3)
        ]
        path = new_shared_path(spark, "profile-parts")
        for i in (0, 1, 2, 1):
            states[i].write.mode("overwrite").parquet(f"{path}/part={i}")
        kept = spark.read.schema(f"{profile_store.STATE}, part int").parquet(path).drop("part")
        return profile_store.state_reports(profile_store.merge_states(kept), mapping)[name]

    return query


def _updated_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self time from a store that met a few traces first, then all, then nothing new."""
    samples, mapping = B.samples(spark, sf_dir), B.mapping(spark, sf_dir)
    files = samples.select("trace_id").distinct().select(
        "trace_id", F.col("trace_id").alias("path"), F.lit(1).cast("long").alias("size"),
        F.lit("2024-01-15 10:30:45").cast("timestamp").alias("modified"),
    )
    path = new_shared_path(spark, "profile-store")
    first = files.filter(F.crc32(F.col("trace_id").cast("binary")) % 3 == 0)
    for part, listed in (("000001", first), ("000002", files), ("000003", files)):
        profile_store.update_profile(
            listed, mapping, path, part, lambda new: samples.join(new.select("trace_id"), "trace_id", "left_semi")
        )
    return profile_store.state_reports(profile_store.read_state(spark, path), mapping)["self_time"]


def _report(tables: Tables) -> DataFrame:
    found = analysis.run_analysis(tables)
    return report.reports(found.issues, found.traces, _as_of())


def _report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "reports")
    outputs.write_reports(_report(B.slice_model(spark, sf_dir)), path, _as_of())
    return outputs.read_reports(spark, path)


def _report_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", text.report_filename(F.col("ts")).alias("file_name"))


def _trace_id_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    tail = F.when(
        F.col("page_id") % 3 != 0,
        F.concat(F.lit("/strace_a"), F.col("page_id").cast("string"), F.lit("_huawei.bin")),
    ).otherwise("")
    as_of = F.expr("timestampadd(SECOND, page_id, TIMESTAMP_NTZ '2024-03-05 08:05:03')")
    return pages.select(
        "page_id", text.trace_id_from_path(F.concat("url", tail), as_of).alias("trace_id")
    )


def _method_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = B.slice_model(spark, sf_dir)["slice"].select("name")
    return slices.unionByName(B.mapping(spark, sf_dir).select("name")).distinct()


def _annotate_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _method_names(spark, sf_dir).select(
        "name", annotate.method_note(name).alias("note"),
        annotate.annotated_name(name).alias("annotated"),
    )


def _parse_samples(files: DataFrame) -> DataFrame:
    return _with_frames_text(trace_files.parse_samples(trace_files.valid_files(files)))


def _with_frames_text(parsed: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("frames", lambda a: a.cast("string")), ",")
    return parsed.withColumn("frames", joined)


def _file_validity(files: DataFrame) -> DataFrame:
    good = trace_files.valid_files(files).select(
        "trace_id", F.lit(True).alias("valid"), F.lit(None).cast("string").alias("signature")
    )
    bad = trace_files.rejected_files(files)
    return good.unionByName(bad.select("trace_id", F.lit(False).alias("valid"), "signature"))


def _from_folder(report_name: str) -> Query:
    """A report of sample files and their maps, read from a folder under plain names."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = B.trace_folder(spark, sf_dir)
        symbols = mapping_files.parse_mapping(list_files(spark, folder, "*-mapping"))
        return sample_profile(list_files(spark, folder, "sampling"), symbols)[report_name]

    return query


#: Far below the size of the files, so that most have several ranges.
_SMALL_RANGE = 16 << 10


def _on_listing(operator: Callable[[DataFrame], DataFrame]) -> Query:
    """An operator on a listing of sample files in a folder."""
    return lambda spark, sf_dir: operator(list_files(spark, B.trace_folder(spark, sf_dir), "sampling"))


def _scan_by_range(listing: DataFrame) -> DataFrame:
    return trace_files.scan_ranges(trace_files.valid_files(listing), _SMALL_RANGE)


def _analysis_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "analysis")
    found = analysis.run_analysis(B.slice_model(spark, sf_dir))
    outputs.write_analysis(found, path)
    outputs.write_analysis(found, path)
    return outputs.read_analysis(spark, path).findings


def _mapping_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "mapping-json")
    mapping_files.write_mapping_json(B.mapping(spark, sf_dir), path)
    return mapping_files.read_mapping_json(spark, path).select("addr", "name")


def queries() -> dict[str, Query]:
    return {
        # sources
        "slice_scan": _on_slices(lambda t: t["slice"].select(*SLICE_COLUMNS)),
        "trace_status": _on_slices(analysis.trace_status),
        "valid_trace_files": _on_trace_files(_file_validity),
        "trace_header": _on_trace_files(trace_files.trace_headers),
        "parse_samples": _on_trace_files(_parse_samples),
        "parse_stats": _on_trace_files(
            lambda f: trace_files.parse_stats(trace_files.scan_files(trace_files.valid_files(f)))
        ),
        "valid_trace_files_listed": _on_listing(_file_validity),
        "trace_header_listed": _on_listing(
            lambda f: trace_files.trace_headers(trace_files.valid_files(f))
        ),
        "parse_samples_by_range": _on_listing(
            lambda f: _with_frames_text(trace_files.samples_of(_scan_by_range(f)))
        ),
        "parse_stats_by_range": _on_listing(lambda f: trace_files.parse_stats(_scan_by_range(f))),
        "parse_mapping": lambda spark, sf_dir: mapping_files.parse_mapping(
            B.mapping_files(spark, sf_dir)
        ),
        "mapping_json_roundtrip": _mapping_json,
        # predicates
        "main_thread_slices": _on_slices(main_thread_slices),
        "framework_excluded": _on_slices(
            lambda t: t["slice"].filter(P.not_framework(F.col("name")))
            .select("trace_id", "id", "name")
        ),
        "is_io_related": _on_slices(
            lambda t: t["slice"].select(
                "trace_id", "id", "name", P.is_io_related(F.col("name")).alias("is_io")
            )
        ),
        "longest_slice_by_keyword": _on_slices(
            lambda t: D.longest_slice_by_keyword(t["slice"], KEYWORD)
        ),
        "dedup_slices": _on_slices(_dedup),
        # diagnostics
        "long_slices": _on_slices(D.long_slices),
        "frame_jank": _on_slices(D.frame_jank),
        "main_thread_io": _on_slices(D.main_thread_io),
        "cpu_heavy": _on_slices(D.cpu_heavy),
        "long_slices_unfiltered": _on_slices(D.long_slices_unfiltered),
        "frame_jank_undeduped": _on_slices(D.frame_jank_undeduped),
        "frame_jank_literal": _on_slices(D.frame_jank_literal),
        "main_thread_io_undeduped": _on_slices(D.main_thread_io_undeduped),
        "cpu_heavy_all_threads": _on_slices(D.cpu_heavy_all_threads),
        "diagnostic_counts_broken_trace": _on_slices(_counts_with_a_broken_trace),
        "diagnostic_counts": _on_slices(lambda t: D.diagnostic_counts(D.run_diagnostics(t)[0])),
        # call stacks
        "stack_seeds": _on_slices(analysis.stack_seeds),
        "call_stacks": _on_slices(lambda t: _stack_rows(_seed_stacks(t))),
        "call_stack_by_keyword": _on_slices(
            lambda t: _stack_rows(C.call_stacks_by_keyword(t["slice"], KEYWORD))
        ),
        "call_stack_annotated": _on_slices(lambda t: _stack_rows(_seed_stacks(t), annotate=True)),
        "call_stack_text": _on_slices(lambda t: _stack_rows(_all_stacks(t))),
        # issues
        "severity": _on_slices(_severity),
        "issue_text": _on_slices(_issue_text),
        "issues": _on_slices(analysis.analyze),
        "severity_counts": _on_slices(lambda t: I.severity_counts(analysis.rated_issues(t))),
        "issue_listing": _on_slices(lambda t: I.issue_listing(analysis.rated_issues(t))),
        "focus_window": _on_slices(_focus_windows),
        "issue_context": _on_slices(
            lambda t: issue_context(t["slice"], analysis.staged_issues(t))
        ),
        "issues_roundtrip": _issues_roundtrip,
        "findings_roundtrip": _analysis_roundtrip,
        # report
        "report_summary": _on_slices(
            lambda t: report.report_summary(analysis.rated_issues(t), B.traces(t))
        ),
        "report": _on_slices(_report),
        "report_sink": _report_sink,
        "report_filename": _report_filename,
        "trace_id_from_path": _trace_id_from_path,
        # names
        "annotate_methods": _annotate_methods,
        "pattern_tags": lambda spark, sf_dir: annotate.pattern_tags(_method_names(spark, sf_dir)),
        "short_name": lambda spark, sf_dir: B.mapping(spark, sf_dir).select(
            "addr", "name", text.short_name(F.col("name")).alias("short_name"),
            text.hex_address(F.col("addr")).alias("addr_hex"),
        ),
        # sampling
        "sample_count": _on_samples(lambda s, m: S.sample_count(s)),
        "symbolized_frames": _on_samples(S.symbolized_frames),
        "self_time": _on_samples(S.self_time),
        "self_time_no_runtime": _on_samples(lambda s, m: S.self_time(s, m, skip_runtime=True)),
        "self_time_est_ms": _on_samples(lambda s, m: S.with_estimated_ms(S.self_time(s, m))),
        "self_time_from_files": lambda spark, sf_dir: sample_profile(
            B.trace_files(spark, sf_dir), B.mapping(spark, sf_dir)
        )["self_time"],
        "self_time_from_folder": _from_folder("self_time"),
        "inclusive_time_from_folder": _from_folder("inclusive_time"),
        "hot_stacks_from_folder": _from_folder("hot_stacks"),
        "self_time_from_parts": _from_parts("self_time"),
        "inclusive_time_from_parts": _from_parts("inclusive_time"),
        "hot_stacks_from_parts": _from_parts("hot_stacks"),
        "self_time_from_store": _updated_profile,
        "inclusive_time": _on_samples(S.inclusive_time),
        "hot_stacks": _on_samples(S.hot_stacks),
    }
