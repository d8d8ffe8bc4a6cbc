"""Exact operators against plain Python on small tables with awkward rows."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from tests.llm import cases
from traceprofile.llm import jaccard_join as J
from traceprofile.llm import registry
from traceprofile.llm.jaccard_join import (
    band_starts, bands_of, components, keep_one_of_each, link_report, most_different, n_blocks,
)
from traceprofile.llm.line_dedup import dedup_lines, line_report
from traceprofile.llm.mixing import mix
from traceprofile.llm.substring_dedup import level_lengths, remove_repeats
from traceprofile.llm.suffix_dedup import remove_earlier


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.frame(spark, rows).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.frame(spark, [])


def _bag(records) -> Counter:
    return Counter(tuple(r) for r in records)


def _key(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def _lines_kept(rows):
    low = lambda doc_id: -1 if doc_id is None else doc_id
    holders: dict[str, set[int]] = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(_key(line)) >= 20:
                holders.setdefault(_key(line), set()).add(low(r[0]))
    for r in rows:
        lines = (r[1] or "").split("\n")
        yield r, lines, [
            x for x in lines
            if len(holders.get(_key(x), ())) < 3 or max(holders[_key(x)]) == low(r[0])
        ]


def test_lines(docs, rows):
    want = Counter(
        (r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
        for r, lines, kept in _lines_kept(rows)
    )
    got = line_report(docs)
    assert _bag(got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == want
    assert sum(n * c for (_, _, n, _), c in want.items()) > 5


def test_line_dedup_keeps_columns(docs, rows):
    got = dedup_lines(docs)
    assert got.columns == docs.columns
    want = Counter((r[0], None if r[1] is None else "\n".join(k), r[5], r[7]) for r, _, k in _lines_kept(rows))
    assert _bag(got.select("doc_id", "text", "did", "row").collect()) == want


def _repeats_removed(rows, n: int):
    texts = [(r[1] or "").encode().split() for r in rows]
    count = Counter(tuple(w[i:i + n]) for w in texts for i in range(len(w) - n + 1))
    for r, w in zip(rows, texts):
        gone = {j for i in range(len(w) - n + 1) if count[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
        yield r[0], len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()


@pytest.mark.parametrize("window", [1, 3, 7, 35])
def test_word_windows(docs, rows, window):
    assert _bag(remove_repeats(docs, window).collect()) == Counter(_repeats_removed(rows, window))


def test_level_lengths():
    assert level_lengths(35) == [9, 18, 35] and level_lengths(1) == [1] and level_lengths(2) == [1, 2]


def _earlier_removed(rows, n: int):
    low = lambda doc_id: -1 if doc_id is None else doc_id
    texts = [(r[1] or "").encode() for r in rows]
    least: dict[bytes, int] = {}
    for r, t in zip(rows, texts):
        for i in range(len(t) - n + 1):
            least[t[i:i + n]] = min(least.get(t[i:i + n], low(r[0])), low(r[0]))
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if least[t[i:i + n]] < low(r[0]):
                gone[i:i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield r[0], len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)


@pytest.mark.parametrize("length", [50, 55])
def test_byte_strings(docs, rows, length):
    got = Counter((*r[:4], bytes(r[4])) for r in remove_earlier(docs, length).collect())
    assert got == Counter(_earlier_removed(rows, length))


def test_byte_string_lengths_are_checked(docs):
    with pytest.raises(ValueError):
        remove_earlier(docs, 20)


def _linked(rows):
    keyed = [(-1 if r[0] is None else r[0], r[1]) for r in rows]
    return keyed, cases.components(keyed)


def test_links(docs, rows):
    keyed, want = _linked(rows)
    expected = Counter(
        (r[0], len(cases.shingles(r[1])), None if c == -1 else c) for r, c in zip(rows, want)
    )
    assert _bag(link_report(docs).collect()) == expected
    assert len(set(want)) < len(rows) - 5


def test_one_of_each_group_stays(docs, rows):
    keyed = sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows} | {
        (-1 if r[0] is None else r[0], "") for r in rows if r[1] is None})
    found = cases.components([(key, key[1]) for key in keyed])
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns
    texts = [(-1 if r[0] is None else r[0], r[1] or "") for r in got.select("doc_id", "text").collect()]
    assert len(texts) == len(set(texts)) and set(texts) <= set(keyed)
    group = dict(zip(keyed, found))
    # each group once; documents without words are groups of their own
    assert sorted(group[t] for t in texts) == sorted(set(found))
    assert len(set(found)) < len(keyed) - 5


def test_links_among_many_near_copies_and_common_passages(spark, rows):
    """One group larger than a hot block, and a passage that many unlike documents share."""
    import random
    rng = random.Random(3)
    body = cases.sentence(rng, 120).split()
    made = []
    for i in range(150):
        words = list(body)
        words[rng.randrange(len(words))] = f"w{i}"
        made.append(" ".join(words))
    passage = cases.sentence(rng, 30)
    for i in range(150):
        made.append(cases.sentence(rng, rng.randint(12, 40)) + " " + passage)
    table = [(i, t, *rows[0][2:]) for i, t in enumerate(made)]
    got = {r["doc_id"]: r["component_id"] for r in link_report(cases.frame(spark, table)).collect()}
    want = cases.components([(i, t) for i, t in enumerate(made)])
    assert [got[i] for i in range(len(made))] == want


def test_links_of_copies_about_the_threshold(spark, rows):
    """Families whose copies are edited so much that about half of their pairs link."""
    import random
    rng = random.Random(8)
    made = []
    for _ in range(6):
        body = cases.sentence(rng, 90).split()
        for i in range(40):
            words = list(body)
            for at in rng.sample(range(len(words)), rng.randint(1, 3)):
                words[at] = f"w{rng.randrange(10**6)}"
            made.append(" ".join(words[: rng.randint(75, 90)]))
    table = [(i, t, *rows[0][2:]) for i, t in enumerate(made)]
    got = {r["doc_id"]: r["component_id"] for r in link_report(cases.frame(spark, table)).collect()}
    want = cases.components([(i, t) for i, t in enumerate(made)])
    assert [got[i] for i in range(len(made))] == want and 6 < len(set(want)) < len(made)


def _open_blocks_of(spark, n_classes):
    """Blocks of unlike sizes in which classes of one band meet, and the parity bits of the sets."""
    import numpy as np
    rng = np.random.default_rng(5)
    band = bands_of(100)[0]
    body = rng.integers(1, 2**62, 100).astype(np.uint64)
    sketches, rows = [], []
    for c in range(n_classes):
        other = rng.integers(1, 2**62, 100).astype(np.uint64)
        shingles = np.unique(np.concatenate([body[:100 - c % 30], other[:c % 30]]))
        sketches.append((c, band, len(shingles), J.parity_bits(shingles, band)))
        rows += [(key, band, c, c // 2, 1) for key in range(200) if (c * 7 + key) % (1 + key % 25) == 0]
    sizes = Counter(r[0] for r in rows)
    opened = spark.createDataFrame(
        [(*r, sizes[r[0]]) for r in rows if sizes[r[0]] > 1],
        "key long, band int, class long, label long, place int, n long",
    )
    return opened, spark.createDataFrame(sketches, "class long, band int, n_shingles long, parity binary")


def test_pairs_of_small_and_of_large_blocks(spark, monkeypatch):
    opened, sketches = _open_blocks_of(spark, 60)
    size = {r["class"]: r["n_shingles"] for r in sketches.collect()}
    bits = {r["class"]: int.from_bytes(r["parity"], "big") for r in sketches.collect()}
    band = opened.first()["band"]
    blocks = {}
    for r in opened.collect():
        blocks.setdefault(r["key"], []).append((r["class"], r["label"]))
    want = {
        (a, b) for met in blocks.values() for a, of_a in met for b, of_b in met
        if a > b and of_a != of_b and 75 * max(size[a], size[b]) <= 100 * min(size[a], size[b])
        and (bits[a] ^ bits[b]).bit_count() <= min(most_different(band), (size[a] + size[b]) * 25 // 175)
    }
    assert {len(met) > J.FEW_CLASSES for met in blocks.values()} == {True, False}
    assert 0 < len(want) < 60 * 59 // 2 - 30
    for few in (0, J.FEW_CLASSES, 1000):
        monkeypatch.setattr(J, "FEW_CLASSES", few)
        got = [tuple(r) for r in J._pairs(opened, sketches, False).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_group_of_blocks_gets_the_parity_bits_of_a_class_once(spark):
    """A large set stands in thousands of blocks; its bits are as long as the set."""
    import pyarrow as pa
    opened, sketches = _open_blocks_of(spark, 60)

    def work(rows, beside):
        classes = len(set(rows.column("class").to_pylist()))
        return pa.table({"a": [rows.num_rows], "b": [beside.num_rows], "apart": [classes]})

    found = J._in_groups(opened, sketches, work).collect()
    assert sum(r["a"] for r in found) == opened.count() > sum(r["b"] for r in found)
    assert all(r["b"] == r["apart"] for r in found)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def test_bands_cover_every_linked_pair():
    starts = band_starts(largest=3000)
    for a in range(1, 1500):
        for b in {a, a * 4 // 3, max(a, a * 4 // 3 - 1)}:
            band = min(set(bands_of(a)) & set(bands_of(b)), key=lambda x: abs(x - bands_of(a)[0]))
            assert band == bands_of(a)[0]
            assert (a + b) // 7 <= most_different(band) < n_blocks(band)
    assert (starts[1:] > starts[:-1]).all()


def test_mix(docs, rows):
    got = mix(docs).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    weight = dict(zip(["s0", "s1", "s2", None], [5, 2, 1, 5]))
    level = max(t / weight[s] for s, (t, _) in targets.items())
    for s, (target, size) in targets.items():
        assert target == pytest.approx(min(2 * size, weight[s] * level))
        taken = [r["taken"] for r in got if r["source"] == s]
        longest = max(r["size"] for r in got if r["source"] == s)
        assert abs(sum(taken) - target) <= 3 * longest  # ids that occur three times
    for r in got:
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert _bag(got) == _bag(mix(docs.repartition(5)).collect())


def test_empty_table(empty):
    for result in (line_report(empty), dedup_lines(empty), remove_repeats(empty), remove_earlier(empty),
                   link_report(empty), keep_one_of_each(empty), mix(empty)):
        assert result.count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_duckdb(spark, name):
    from tests.compare import compare, connect

    sf = "/root/testdata/sf0.001"
    n, problem = compare(spark, connect(sf), sf, name, registry.queries()[name], registry.oracle_sql()[name])
    assert problem is None and n > 0
