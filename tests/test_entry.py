"""The entry module with and without the optional corpus operators."""

from __future__ import annotations

import subprocess
import sys

import pytest

# hides one module, then counts the queries
HIDDEN = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as entry
found = entry.queries()
assert entry.corpus is None and not set(entry.oracle_sql()) - set(found)
print(len(found), any(name.startswith("op") or name == "pipeline" for name in found))
"""


@pytest.mark.parametrize("name", ["zstandard", "traceprofile.llm", "corpus_pipeline"])
def test_core_queries_without(name):
    pytest.importorskip("traceprofile.llm")
    shown = subprocess.run(
        [sys.executable, "-c", HIDDEN.format(name=name)], capture_output=True, text=True, check=True
    ).stdout.split()
    assert int(shown[0]) >= 56 and shown[1] == "False"


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert not set(entry.oracle_sql()) - set(entry.queries())
