"""Operators that learn, estimate or scan: brute force, held-out accuracy, hand-made cases."""

from __future__ import annotations

import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from traceprofile.llm import decontaminate as D
from traceprofile.llm import fingerprints as P
from traceprofile.llm import hashing as H
from traceprofile.llm import html_text as T
from traceprofile.llm import langid as L
from traceprofile.llm import licenses as S

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.frame(spark, rows).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.frame(spark, [])


# -- hashing -------------------------------------------------------------------------


def test_packed_columns_come_back():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64))
    other = rng.integers(0, 9, 500).astype(np.uint16)
    got = H.unpack(H.pack(keys, other, other > 4))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(got, (keys, other, other > 4)))
    assert [len(c) for c in H.unpack(H.pack(keys[:0], other[:0]))] == [0, 0]


def test_words_and_minima():
    hashes, _, _, first = H.word_hashes([b"ab cd  ab", b"", b" x\x0bAB ", b"\x1c"], lower=True)
    assert first.tolist() == [0, 3, 3, 5, 6] and hashes[0] == hashes[2] == hashes[4] != hashes[1]
    values = np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)
    at = H.window_minima(values, 7)
    assert all(at[i] == i + int(np.argmin(values[i:i + 7])) for i in range(294))


def test_words_in_slices(monkeypatch):
    texts = [b"some words " * 50, b"more of them"]
    whole = H.word_hashes(texts)[0]
    monkeypatch.setattr(H, "CHUNK_BYTES", 64)
    assert (H.word_hashes(texts)[0] == whole).all()


# -- language ------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = L.language_report(docs).collect()
    assert len(found) == len(truth)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    assert right / len(held) > 0.98
    assert sum(r["rejected"] for r in found) < 0.01 * len(found)


def test_language_of_awkward_rows(docs, rows, empty):
    found = L.language_report(docs).collect()
    assert len(found) == len(rows)
    letters = {r[0]: any(c.isalpha() for c in r[1] or "") for r in rows if r[0] is not None}
    for r in found:
        if r["doc_id"] is not None and r["doc_id"] != 5:
            assert (r["lang_pred"] in ("xx", "yy")) == letters[r["doc_id"]]
            assert letters[r["doc_id"]] or (r["score"] == 0 and r["rejected"])
    assert L.language_report(empty).count() == 0
    assert L.keep_identified(docs).columns == docs.columns


def test_language_without_labels(docs):
    unlabelled = docs.withColumn("lang", docs["lang"].substr(100, 1)).filter("lang is null or lang = ''")
    from pyspark.sql import functions as F
    found = L.language_report(unlabelled.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in found} == {"und"}


@pytest.mark.parametrize("text", ["½ ²", "①", "Ⅷ", "12 _ ½"])
def test_number_signs_are_no_letters(text):
    from traceprofile.llm.langid import normalised
    assert normalised(text) == b"" and normalised(text + " ä") != b""


def test_one_language():
    assert L.Classifier({"xx": b" some text "}).classify("some") == ("xx", 1.0)


# -- benchmark -----------------------------------------------------------------------


def _bags(text: str):
    words = "".join(c if not c.isascii() or c.isalnum() else " " for c in (text or "").lower()).split()
    return words


def _leaks(docs, items):
    """All windows of the length of every item, compared with it."""
    for doc_id, text in docs:
        words = _bags(text)
        for item, passage in items:
            own = _bags(passage)
            n, k = len(own), min(5, len(own))
            if not n:
                continue
            want = Counter(tuple(own[i:i + k]) for i in range(n - k + 1))
            for s in range(len(words) - n + 1):
                if not want.keys() & {tuple(words[i:i + k]) for i in range(s, s + n - k + 1)}:
                    continue
                have = Counter(tuple(words[i:i + k]) for i in range(s, s + n - k + 1))
                common = sum((want & have).values())
                if common / (sum(want.values()) * 2 - common) >= 0.75:
                    yield doc_id, item
                    break


def test_leaks_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = Counter((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect())
    want = Counter(_leaks(docs.collect(), [(r["item_id"], r["text"]) for r in bench.collect()]))
    assert got == want and len(want) > 5


def test_leaks_in_awkward_rows(spark, docs, rows, empty):
    item = next(r[1] for r in rows if r[0] == 1).split("\n")[0]
    edited = " ".join(item.upper().split() + ["more"])
    items = spark.createDataFrame(
        [(1, item), (2, None), (3, ""), (4, "one"), (None, edited)], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, items).collect())
    want = Counter(_leaks([(r[0], r[1]) for r in rows], [(1, item), (4, "one"), (None, edited)]))
    assert got == want
    assert D.find_leaks(empty, items).count() == 0
    assert D.find_leaks(docs, items.limit(0)).count() == 0
    clean = D.drop_leaked(docs, items)
    assert clean.columns == docs.columns
    leaked = {k[0] for k in want}
    assert {r["doc_id"] for r in clean.collect()}.isdisjoint(leaked - {5, None})


def _similarity(a: list[str], b: list[str]) -> float:
    x, y = (Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    common = sum((x & y).values())
    return common / max(1, sum(x.values()) + sum(y.values()) - common)


def _clipped_leaks(words: list[str], item: list[str]) -> bool:
    """Whether any window of the length of the item, clipped at the ends of the text, holds it."""
    n = len(item)
    return any(_similarity(words[max(s, 0):s + n], item) >= 0.75 for s in range(1 - n, len(words)))


def test_leaks_cut_off_by_an_end_of_the_text():
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    for n in (5, 6, 9, 20, 61):
        item, other, more = word(n), word(40), word(40)
        texts = [other + item[:n - cut] for cut in range(n)] + [item[cut:] + other for cut in range(n)]
        texts += [item[1:], item[:-1], item[1:-1], item[2:], other + item + more, item, other, []]
        edited = item[:n // 2] + ["changed"] + item[n // 2 + 1:-1]
        texts += [edited, other + edited, edited + other]
        found = D.Matcher([(8, " ".join(item)), (9, " ".join(more))]).find([" ".join(t) for t in texts])
        assert [8 in {h[0] for h in own} for own in found] == [_clipped_leaks(t, item) for t in texts]
        for text, own in zip(texts, found):
            for number, start, size, _, similarity in own:
                passage = item if number == 8 else more
                assert similarity == _similarity(text[start:start + size], passage)
    item = word(20)
    (hit,), = D.Matcher([(1, " ".join(item))]).find([" ".join(word(30) + item[:19])])
    assert hit[:3] == (1, 30, 19) and hit[4] == 15 / 16


def test_passages_edited_near_the_start_are_found():
    rng = np.random.default_rng(11)
    for n, edited in ((26, 3), (38, 4), (200, 24)):
        found = 0
        for _ in range(100):
            words = [f"w{i}" for i in rng.integers(0, 10**6, n + 2 * edited + 60)]
            item, changed, around = words[:n], words[n:n + edited], words[n + 2 * edited:]
            passage = changed + item[edited:]
            assert _similarity(passage, item) >= 0.75
            text = around[:30] + passage + around[30:]
            found += bool(D.Matcher([(1, " ".join(item))]).find([" ".join(text)])[0])
        assert found == 100


def test_short_items_and_starts_of_windows():
    texts = ["a b", "b a b c", "a", "", "c d e f x", "c d e f g h"]
    items = ["a", "a b", "b c d", "c d e f", "c d e f g", ""]
    found = D.Matcher(list(enumerate(items))).find(texts)
    assert [{h[0] for h in own} for own in found] == [{0, 1}, {0, 1}, {0}, set(), {3}, {3, 4}]


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 2**64, 50, dtype=np.uint64)
    index = D._Index(prints, np.arange(50))
    for distance in range(D.RADIUS + 1):
        near = prints.copy()
        for i in range(50):
            for bit in rng.choice(64, distance, replace=False):
                near[i] ^= np.uint64(1) << np.uint64(bit)
        place, item, apart = index.near(near)
        found = set(zip(place.tolist(), item.tolist(), apart.tolist()))
        assert {(i, i, distance) for i in range(50)} <= found


def test_item_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "item_id long, text string")
    monkeypatch.setattr(D, "ITEMS", 7)
    blocks = list(D.item_blocks(items))
    assert len(blocks) > 1 and sorted(n for b in blocks for n, _ in b) == list(range(30))


# -- licences ------------------------------------------------------------------------


def test_licences(spark, docs, rows, empty):
    mit = "\n".join(S.TEMPLATES["MIT"][1][i:i + 70] for i in range(0, len(S.TEMPLATES["MIT"][1]), 70))
    table = [
        (1, "Some text.\nReleased under the MIT license!\nMore text."), (2, f"Title\n\n{mit}\n\nEnd"),
        (3, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0"),
        (4, "Nothing of the kind is licensed here under any licence at all."), (5, None), (6, ""), (6, ""),
    ]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    got = {r["doc_id"]: r for r in S.license_report(frame).collect()}
    assert got[1]["licenses"] == "MIT" and got[1]["best_dice"] == 1.0
    assert got[2]["best_license"] == "MIT" and got[2]["best_dice"] > 0.9
    assert got[3]["licenses"] == "Apache-2.0,CC-BY-NC" and got[3]["n_hits"] == 2
    assert got[4]["n_hits"] == got[5]["n_hits"] == got[6]["n_hits"] == 0 and got[4]["best_dice"] is None
    assert S.license_report(docs).count() == len(rows) and S.license_report(empty).count() == 0


def test_notices_among_other_text(spark):
    gpl = S.TEMPLATES["GPL"][1]
    wrapped = " Some module.\n * " + gpl.replace(" under ", "\n * under ").replace(" Foundation", "\n * Foundation")
    table = {
        1: ("(c) 2024 Jane Doe, released under the MIT License", "MIT", 1),
        2: ("This project is licensed under the MIT License", "MIT", 1),
        3: (f"/*\n * It does many things and it has more words here than any notice, to sink it.\n *{wrapped}\n"
            " * The rest of the comment goes on about what the module does and what it does not do.\n */", "GPL", 1),
        4: ("See. This work is licensed under the GNU Affero General Public License, version 3. It is ours, "
            "and all of it stays open to those who wish to read or to change it.", "AGPL", 1),
        5: ("Released under the MIT License, while the art is all its own: Licensed under CC BY-NC 4.0. Bye.",
            "CC-BY-NC,MIT", 2),
        6: ("Preamble. The GNU General Public License is a free, copyleft license for software and other "
            "kinds of works. The licenses for most software are designed to take away your freedom.", "GPL", 1),
        7: ("He was under the license of the king and released the work to the public", "", 0),
    }
    frame = spark.createDataFrame([(k, v[0]) for k, v in table.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_hits"]) for r in S.license_report(frame).collect()}
    assert got == {k: v[1:] for k, v in table.items()}


def test_licences_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    grams = [(n, set(S.bigram_set(t))) for n, texts in S.TEMPLATES.items() for t in texts]
    want = {}
    for r in docs.collect():
        found = set()
        for line in {*r["text"].split("\n"), r["text"].replace("\n", " ")}:
            own = set(S.bigram_set(line))
            rated = [(-2 * len(own & g) / (len(own) + len(g)), n) for n, g in grams if own]
            if rated and min(rated)[0] <= -0.75:
                found.add(min(rated)[1])
        want[r["doc_id"]] = ",".join(sorted(found))
    got = {r["doc_id"]: r["licenses"] for r in S.license_report(docs).collect()}
    assert got == want and len([v for v in want.values() if v]) > 10


def test_usual_notices(spark):
    table = {
        1: ("# SPDX-License-Identifier: MIT\nimport os", "MIT"), 2: ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        3: ("It is licensed under the terms of the MIT license, as is the rest.", "MIT"),
        4: ("Released under the GPL v3", "GPL"), 5: ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL"),
        6: ("Distributed under the Boost Software License, Version 1.0. See the file.", "BSL-1.0"),
        7: ("This program and the accompanying materials\nare made available under the terms of the\n"
            "Eclipse Public License 2.0 which is at hand", "EPL-2.0"),
        8: (S.TEMPLATES["Zlib"][1], "Zlib"), 9: ("SPDX-License-Identifier: none of these", ""),
    }
    frame = spark.createDataFrame([(k, v[0]) for k, v in table.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in S.license_report(frame).collect()} == {
        k: v[1] for k, v in table.items()}


def test_windows_and_paragraphs_against_brute_force(spark):
    """Notices with words changed, among other words and over lines."""
    import random
    rng = random.Random(4)
    every = [(n, t) for n, ts in S.TEMPLATES.items() for t in ts]
    table, want = [], {}
    for i in range(120):
        words = rng.choice(every)[1].split()
        for at in rng.sample(range(len(words)), min(len(words), rng.randint(0, 3))):
            words[at] = rng.choice(["license", "the", "changed", "software"])
        text = " ".join(["some", "words"] * rng.randint(0, 9) + words + ["and", "more"] * rng.randint(0, 9))
        text = "".join("\n" if c == " " and rng.random() < 0.1 else c for c in text)
        table.append((i, text))
        plain = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
        pairs = list(zip(plain, plain[1:]))
        found = set()
        for name, template in every:
            own = {tuple(g.split()) for g in S.bigram_set(template)}
            wide = S._n_pairs(template)
            units = [pairs[j:j + wide] for j in range(len(pairs))] + [pairs] + [
                list(zip(w, w[1:])) for line in text.lower().split("\n") for w in [
                    "".join(c if c.isascii() and c.isalnum() else " " for c in line).split()]]
            if any(u and 2 * len(set(u) & own) >= 0.75 * (len(set(u)) + len(own)) for u in units):
                found.add(name)
        want[i] = found
    got = {r["doc_id"]: {n for n in r["licenses"].split(",") if n} for r in S.license_report(
        spark.createDataFrame(table, "doc_id long, text string")).collect()}
    for i, _ in table:
        assert got[i] <= want[i] and bool(got[i]) == bool(want[i]), table[i]
    assert 20 < sum(map(bool, want.values())) < 120


# -- pages ---------------------------------------------------------------------------

_BODY = "The council met on Monday and agreed to mend the old bridge before winter comes to town."
_PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body class="page header-x">
<header><h1>Site</h1><p>{_BODY}</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>{_BODY}</p></div><form><p>{_BODY}</p><input></form><script>x("<p>no</p>")</script>
<article><h1>Title &amp; more</h1><!-- <p>no</p> --><p>{_BODY}
  {_BODY}</p><p>Short.</p><div class="ad">Buy now.</div><blockquote>Quote &lt;here&gt;</blockquote></article>
<section id="comments"><p>{_BODY}</p></section><aside>{_BODY}</aside><div class="sidebar">{_BODY}</div>
<footer>&copy; us</footer></body></html>"""


def test_main_text():
    tree = T.DecisionTree().fit(*T.labelled_table())
    want = f"Title & more\n\n{_BODY} {_BODY}\n\nShort.\n\nQuote <here>"
    assert T.main_text(_PAGE, tree) == want
    cut = _PAGE[:_PAGE.index("Short.") + 3]
    assert T.main_text(cut, tree) == f"Title & more\n\n{_BODY} {_BODY}\n\nSho"
    assert T.main_text("", tree) == T.main_text(None, tree) == T.main_text("<p", tree) == ""
    x, y = T.labelled_table()
    assert (tree.predict(x) == y).all()


def test_articles_in_named_wrappers():
    tree = T.DecisionTree().fit(*T.labelled_table())
    article = f"<h1>Title of it</h1><p>{_BODY}</p><p>Short.</p><p>{_BODY}</p>"
    want = f"Title of it\n\n{_BODY}\n\nShort.\n\n{_BODY}"
    for page in (
        f"<div class='layout has-sidebar'><article>{article}</article></div>",
        f"<div id=page class=no-comments><main>{article}</main></div>",
        f"<div class='page widget-area'><main>{article}</main><div class=sidebar><p>{_BODY}</p></div></div>",
        f"<div class=sidebar-layout><div><article class=post>{article}</article></div></div>",
        f"<article><header class='entry-header'><h1>Title of it</h1></header>{article[article.index('<p>'):]}</article>",
        f"<article>{article}<div class=comments><article><p>{_BODY}</p></article></div></article>",
        f"<article>{article}</article><div id=comments><article class=comment-body><p>{_BODY}</p></article></div>",
        f"<article>{article}</article><aside><article><p>{_BODY}</p></article></aside>",
    ):
        assert T.main_text(page, tree) == want, page


def test_pages(spark):
    table = [(1, "u", _PAGE), (2, None, None), (None, "v", ""), (1, "u", _PAGE), (3, "w", "<p>" * 3000)]
    got = T.extract_main_text(
        spark.createDataFrame([(*r, 1) for r in table], "page_id long, url string, html string, text int")
    ).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert Counter(r["page_id"] for r in got) == Counter([1, 1, 2, 3, None])


def test_article_of_every_page(spark):
    tree = T.DecisionTree().fit(*T.labelled_table())
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = r["html"].split("<article>", 1)[-1].split("</article>", 1)[0]
        own = [b.text for b in T.blocks(article)]
        assert T.main_text(r["html"], tree) == "\n\n".join(own)


# -- fingerprints --------------------------------------------------------------------


def _generalised_jaccard(a: str, b: str) -> float:
    x, y = (Counter(t.encode().split()) for t in (a, b))
    weigh = lambda c, w: c[w] * len(w.decode())
    low = sum(min(weigh(x, w), weigh(y, w)) for w in x.keys() | y.keys())
    high = sum(max(weigh(x, w), weigh(y, w)) for w in x.keys() | y.keys())
    return low / high if high else 1.0


def test_fingerprints(docs, rows, empty):
    import hashlib
    got = P.fingerprint_report(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None and r[0] != 5}
    prints: dict[str, set] = {}
    errors = []
    for doc_id, text in texts.items():
        r = by_id[doc_id]
        prints.setdefault(text, set()).add(r["fingerprint"])
        assert r["n_chars"] == len(text)
        if doc_id + 1 in texts:
            following, k = texts[doc_id + 1], len(text) // 4
            edited = text[:len(text) - k] + following[:k]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            errors += [r["near_edited"] - _generalised_jaccard(text, edited),
                       r["near_next"] - _generalised_jaccard(text, following)]
    assert all(len(p) == 1 for p in prints.values())
    assert by_id[max(texts)]["near_next"] is not None
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09
    assert P.fingerprint_report(empty).count() == 0


def test_gamma_quantiles():
    table = P.gamma_quantiles(1000)
    assert table.mean() == pytest.approx(2, abs=0.02) and (np.diff(table) > 0).all()


_SAID = "One plain sentence of an article tells what happened and why it matters to those who read. " * 3


@pytest.mark.parametrize("page, want", [
    (f"<div data-x=it's><article><p>{_SAID}</p></article></div><p>that's</p>", [_SAID]),
    (f"<nav><a href=/>Up</a></nav><article><p title=\"a > b\">{_SAID}</p><p>{_SAID}</p></article>", [_SAID, _SAID]),
    (f"<article><script src=a.js/>var x = '<p>no</p>';</script><p>{_SAID}</p></article>", [_SAID]),
    (f"<article><svg viewBox='0'/><p>{_SAID}</p></article>", [_SAID]),
    *[(f"<div {name}><p>{_SAID}</p><p>{_SAID}</p></div><div class=sidebar><p>{_SAID}</p></div>", [_SAID, _SAID])
      for name in ("id=main class='content search-page'", "class='post-content share-enabled'",
                   "class='article-body login-required'", "class=main-content-with-sidebar")],
    (f"<article><div class=story__header><h1>The title of it</h1></div><p>{_SAID}</p></article>",
     ["The title of it", _SAID]),
    (f"<article><p>{_SAID}</p></article><div class=post-comments><p>{_SAID}</p></div>"
     f"<div class=article-footer><p>{_SAID}</p></div><div class=share-buttons><p>{_SAID}</p></div>", [_SAID]),
])
def test_hostile_markup(page, want):
    tree = T.DecisionTree().fit(*T.labelled_table())
    assert T.main_text(page, tree) == "\n\n".join(w.strip() for w in want)


def test_unmatched_tags_take_linear_time():
    start = time.perf_counter()
    T.blocks("<div>" * 50_000 + "</section>" * 50_000 + "</div>" * 100_000 + "<p>x</p>")
    assert time.perf_counter() - start < 5
