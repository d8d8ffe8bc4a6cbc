"""The whole chain against plain Python over whole texts."""

from __future__ import annotations

import os
import tempfile

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_exact_operators import _lines_kept
from tests.llm.test_learned_operators import _leaks
from traceprofile.llm import langid as L


def _tables(spark, docs_rows, items) -> str:
    folder = tempfile.mkdtemp(prefix="corpus-")
    cases.frame(spark, docs_rows).repartition(2).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        os.path.join(folder, "benchmark.parquet"))
    return folder


def test_stages_keep_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "jaccard_join", "decontaminate", "mix_sources"]
    rows = cases.documents()
    folder = _tables(spark, rows, [(1, rows[0][1])])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes


def test_pipeline_against_brute_force(spark):
    rows = [r for r in cases.documents() if r[0] is not None]
    rows = list({r[:2]: r for r in rows}.values())
    item = next(r[1] for r in rows if r[0] == 10).split("\n")[1]
    folder = _tables(spark, rows, [(1, item)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    classifier = L.Classifier(L.learn_dictionaries(docs.filter(L.training_rows())))
    left = []
    for r in rows:
        lang, score = classifier.classify(r[1])
        if lang != L.UNKNOWN and score >= L.MIN_MARGIN:
            left.append(r)
    assert len(left) < len(rows)
    left = [(r[0], "\n".join(kept), *r[2:]) for r, _, kept in _lines_kept(left)]
    group = cases.components([((r[0], hash(r[1])), r[1]) for r in left])
    groups: dict = {}
    for r, g in zip(left, group):
        key = g if cases.shingles(r[1]) else (r[0], hash(r[1]))
        groups.setdefault(key, []).append(r)
    stay = [min(own, key=lambda r: r[0]) for own in groups.values()]
    assert len(stay) < len(left)
    leaked = {k for k, _ in _leaks([(r[0], r[1]) for r in stay], [(1, item)])}
    assert leaked
    final = {r[0]: len(r[1].encode().split()) for r in stay if r[0] not in leaked}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert got.keys() <= final.keys()
    assert all(r["size"] == final[k] and r["taken"] in (r["size"], 2 * r["size"]) for k, r in got.items())
    taken = sum(r["taken"] for r in got.values())
    assert abs(taken - 1.5 * sum(final.values())) < 4 * max(final.values())
