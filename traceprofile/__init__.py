"""Analytics over mobile performance traces as Spark DataFrame jobs.

Slices: :func:`read_slice_model` → :func:`analyze` → :func:`reports`.
Samples: :func:`list_files` → :func:`parse_mapping` → :func:`sample_profile`.
"""

from traceprofile.plans.analysis import analyze, run_analysis, trace_status
from traceprofile.plans.profile import sample_profile
from traceprofile.plans.profile_store import (
    merge_states, profile_state, read_state, state_reports, update_profile,
)
from traceprofile.plans.report import report_summary, reports
from traceprofile.session import configure, staging
from traceprofile.sources.binary_files import read_binary_files
from traceprofile.sources.file_ranges import list_file_versions, list_files
from traceprofile.sources.mapping_files import parse_mapping
from traceprofile.sources.outputs import (
    read_analysis, read_issues, read_reports, write_analysis, write_issues, write_reports,
)
from traceprofile.sources.slice_model import read_slice_model, write_slice_model

__all__ = [
    "analyze", "configure", "list_file_versions", "list_files", "merge_states", "parse_mapping", "profile_state",
    "read_analysis",
    "read_binary_files", "read_issues", "read_reports", "read_slice_model", "read_state",
    "report_summary", "reports", "run_analysis", "sample_profile", "staging", "state_reports",
    "trace_status", "update_profile", "write_analysis", "write_issues", "write_reports", "write_slice_model",
]
