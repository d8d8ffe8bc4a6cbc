"""Lexical search, conversation repair and toxicity against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from traceprofile.llm import conversation_repair as repair
from traceprofile.llm import crossings, lexical_search, registry, toxicity

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SPACE = " \t\n\x0b\x0c\r"


# -- lexical search -----------------------------------------------------------------------


def ranked(docs, items, k=10):
    """``(item_id, rank, doc_id, score)`` by scoring every document for every item."""
    bags = [(d, Counter(TERM.findall(cases.lowered(t).decode()))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(term for _, b in bags for term in b)
    out = []
    for item_id, text in items:
        wanted = set(TERM.findall(cases.lowered(text).decode()))
        found = []
        for d, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in wanted if b[t]
            )
            if score > 0:
                found.append((-score, d is not None, d if d is not None else 0, d))
        found.sort(key=lambda f: f[:3])
        out += [(item_id, r + 1, f[3], -f[0]) for r, f in enumerate(found[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


def benchmark(rows):
    items = [(i, " ".join((rows[i][1] or "").split()[:9])) for i in range(0, 20, 2)]
    return items + [(100, None), (101, ""), (102, "!!"), (103, "ONE two éé"), (103, "ONE two éé"), (None, "the")]


@pytest.mark.parametrize("pairs", [lexical_search._PAIRS, 40])
def test_search(spark, rows, monkeypatch, pairs):
    monkeypatch.setattr(lexical_search, "_PAIRS", pairs)
    docs = cases.frame(spark, rows * 3).repartition(5)
    items = benchmark(rows)
    found = lexical_search.search(docs, spark.createDataFrame(
        [(*r, "t") for r in items], "item_id long, text string, term string"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == ranked([r[:2] for r in rows * 3], items)


def test_search_by_blocks_with_text_ids(spark, rows, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS", 4)
    items = [(None if i is None else f"item-{i}", t) for i, t in benchmark(rows)]
    docs = [(None if r[0] is None else f"d{r[0]:03}", r[1]) for r in rows]
    found = lexical_search.search(
        spark.createDataFrame(docs, "doc_id string, text string"),
        spark.createDataFrame(items, "item_id string, text string"), k=3,
    )
    want = Counter()
    for (item, rank, d, score), n in ranked(
        [(r[0], r[1]) for r in rows], [(i, t) for i, t in benchmark(rows)], 3
    ).items():
        want[None if item is None else f"item-{item}", rank, None if d is None else f"d{d:03}", score] += n
    assert Counter(tuple(r) for r in found.collect()) == want


def test_search_of_nothing(spark, rows):
    docs, items = cases.frame(spark, rows), spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(docs, items).collect() == []
    some = spark.createDataFrame(benchmark(rows), "item_id long, text string")
    assert lexical_search.search(cases.frame(spark, []), some).collect() == []


# -- conversation repair ------------------------------------------------------------------


def cheapest(kinds):
    """Least cost and ASCII-least edits by trying all edits of a row of turn classes."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(kinds) + 1):
        for edits in itertools.product("DKR", repeat=len(kinds)):
            cost, said, text = 0, "", ""
            for n, kind, edit in zip(inserts, [*kinds, None], [*edits, ""]):
                for _ in range(n):
                    said += "a" if said.endswith("u") else "u"
                cost += 5 * n
                text += "I" * n + edit
                if edit == "D":
                    cost += 2
                elif edit:
                    if kind == crossings.MUST_GO:
                        break
                    cost += 5 * (kind % 2) + (edit == "R")
                    said += "suax"[kind // 2] if edit == "K" else "a" if said.endswith("u") else "u"
            else:
                if re.fullmatch("(s?(ua)+)?", said) and (best is None or (cost, text) < best):
                    best = cost, text
    return best


def test_crossings_against_all_edits():
    rng = random.Random(2)
    rows = [[kind] for kind in range(crossings.CLASSES)]
    rows += [[rng.randrange(crossings.CLASSES) for _ in range(rng.choice([2, 3, 4]))] for _ in range(60)]
    first = np.cumsum([0] + [len(r) for r in rows])
    flat = np.array([k for r in rows for k in r])
    stretches = crossings.Stretches(crossings.turns(flat), first)
    last, cost = crossings.ends(stretches.whole)
    a, b = stretches.states(np.zeros(len(rows), dtype=np.int64), last)
    for i, row in enumerate(rows):
        own = slice(first[i], first[i + 1])
        edits = "".join(crossings.EDITS[k][x][y] for k, x, y in zip(row, a[own], b[own]))
        assert (int(cost[i]), edits + crossings.END_EDITS[last[i]]) == cheapest(row), row


def repaired(rows):
    """All columns of the report by conversation, turn after turn with every state's best."""
    conversations = {}
    for conv, turn, role, text in rows:
        own = conversations.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        own += [(turn, "user" if case == 4 else role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return {conv: _report(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1:])))
            for conv, own in conversations.items()}


def _report(rows):
    names, seen, count = {"u": "user", "a": "assistant"}, set(), Counter()
    best = {"": (0, "", ())}
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                 else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
        count[fault] += 1
        new = {}

        def offer(state, *value):
            if state not in new or value[:2] < new[state][:2]:
                new[state] = value

        for state, (cost, audit, said) in best.items():
            for _ in range(3):
                offer(state, cost + 2, audit + "D", said)
                due = "a" if state == "u" else "u"
                if fault in ("", "truncated"):
                    more = 5 if fault else 0
                    offer(due, cost + 1 + more, audit + "R", (*said, f"{names[due]}:{text}"))
                    if role[:1] == due or (role[:1] == "s" and state == ""):
                        offer(role[:1], cost + more, audit + "K", (*said, f"{role}:{text}"))
                state, cost, audit, said = due, cost + 5, audit + "I", (*said, f"{names[due]}:")
        best = new
    ends = {"": (), "a": (), "u": ("assistant:",), "s": ("user:", "assistant:")}
    cost, audit, said = min(
        (c + 5 * len(ends[q]), a + "I" * len(ends[q]), s + ends[q]) for q, (c, a, s) in best.items()
    )
    turns = [r[0] for r in rows if r[0] is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        count["blank"], count["duplicate"], count["truncated"],
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
        cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
    )


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(7)
    rows = []
    for conv, n in [(None, 40), (0, 1), (1, 700), (2, 5), (3, 3), (4, 60), (5, 1), (6, 1)]:
        for i in range(n):
            turn = rng.choice([None, i, i, rng.randrange(n)])
            text = rng.choice([None, "", " \t", "a.", "b", "c! ", "dd.\n", "Why?", f"more {rng.random()}.",
                               "long " * 400 + "end"])
            rows.append((conv, turn, rng.choice([None, "", "user", "assistant", "system", "tool"]), text))
    return rows + [(7, None, "user", "x.")] * 30 + [(8, t, "system", "s.") for t in range(6)] + rows[:3]


SCHEMA = "conv_id long, turn long, role string, text string, cid long, key string, copy int"


@pytest.mark.parametrize("segment", [repair.SEGMENT, 5])
def test_repair(spark, turns, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    found = repair.repair_report(
        spark.createDataFrame([(*r, 1, "k", 2) for r in turns], SCHEMA).repartition(4)
    )
    rows = found.collect()
    assert len(rows) == len({r[0] for r in turns})
    assert {r["conv_id"]: tuple(r)[1:] for r in rows} == repaired(turns)


def test_repaired_turns(spark, turns):
    found = repair.repair(spark.createDataFrame([(*r, 1, "k", 2) for r in turns], SCHEMA))
    said = {}
    for r in sorted(found.collect(), key=lambda r: r["place"]):
        said.setdefault(r["conv_id"], []).append(r)
    for own in said.values():
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own))
        assert all((r["text"] == "") == (r["edit"] == "I") for r in own)


def test_one_conversation_is_spread(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(4000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repair.numbered(repair._described(frame.repartition(8)))
        parts = found.selectExpr("shiftright(at, 33) AS part").groupBy("part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 2000


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(empty).collect() == [] and repair.repair(empty).collect() == []


# -- toxicity -----------------------------------------------------------------------------

BAD = ["blorgface", "snarkwit", "grubnik"]


def labelled(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = cases.sentence(rng, rng.randint(30, 200)).split()
        toxic = int(i % 5 == 1)
        for _ in range(toxic * rng.randint(3, 6)):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if i % 5 == 2:  # harmless use of a word that looks like an entry
            words[3:3] = ["grubnikel", "mine"]
        docs.append((i, " ".join(words)))
        labels.append((i, 0, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def scorer(spark):
    docs, labels = labelled(random.Random(1), 400)
    labels += [(1, None, None), (None, 1, 1), (3, 0, 7), (0, 0, 0)]
    return toxicity.learn(
        spark.createDataFrame([*docs, (None, "blorgface")], "doc_id long, text string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_folding():
    assert toxicity.folded_words("Tr4sh, TRА5H! p@th3t1c 2024 a$$es ﾀ ​x") [:4] == [
        "trash", "trash", "pathetic", "asses"
    ]
    assert toxicity.folded_words("ｔｒａｓｈ tra­sh") == ["trash", "trash"]
    assert toxicity.folded_words("stupid$$$ 12 !!") == ["stupid"]
    assert toxicity.folded_words(None) == toxicity.folded_words("") == []


def test_longest_entry_and_exceptions():
    lexicon = toxicity.Lexicon({"gru": 1.0, "grubnik ": 5.0, "ni": 9.0}, frozenset({"grumbie", "a grub"}))
    words = toxicity.folded_words("grubnik grumble grubs a grub nibble agru")
    assert list(lexicon.matches(words)) == [(0, 5.0), (1, 1.0), (2, 1.0), (4, 1.0), (5, 9.0)]
    assert list(lexicon.counted(words)) == [(0, 5.0), (2, 1.0), (5, 9.0)]


def test_toxic_texts_are_found(scorer):
    docs, labels = labelled(random.Random(9), 200)
    right = [(scorer.score(t)[0] >= 0.5) == bool(label[2]) for (_, t), label in zip(docs, labels)]
    assert sum(right) >= 0.97 * len(right)
    hidden = cases.sentence(random.Random(3), 60) + " bl0rgface grubn1k bIorgface snаrkwit blorgf@ce"
    assert scorer.score(hidden)[0] >= 0.5
    assert scorer.score(None) == scorer.score("") and scorer.score("")[0] < 0.5
    assert scorer.score("the " * 200_000)[0] < 0.5


def test_report(spark):
    docs, labels = labelled(random.Random(4), 200)
    awkward = [(i, r[1]) for i, r in enumerate(cases.documents(), 1000)] + [(None, "grubnik"), docs[6], docs[6]]
    frame = spark.createDataFrame(
        [(*r, "x", 1.0, 2) for r in docs + awkward], "doc_id long, text string, row string, score double, toxic int"
    ).repartition(3)
    found = toxicity.toxicity_report(
        frame, spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    ).collect()
    assert len(found) == len(docs) + len(awkward)
    truth = {i: t for i, _, t in labels}
    for r in found:
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    unseen = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in unseen) >= 0.9 * len(unseen)


@pytest.mark.parametrize("kind", [None, 0, 1])
def test_labels_of_one_kind(spark, kind):
    docs, labels = labelled(random.Random(4), 20)
    labels = [] if kind is None else [(i, 0, kind) for i, _, _ in labels]
    found = toxicity.toxicity_report(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    ).collect()
    assert {r["score"] for r in found} == {float(kind or 0)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.toxicity_report(
        empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ).collect() == []


def test_given_labels(spark):
    """Held-out labels of the given table."""
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = registry.op13_toxicity(spark, sf_dir).filter("held_out").collect()
    rows = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["doc_id"] in labels]
    assert sum(p and t for p, t in rows) >= 0.9 * sum(t for _, t in rows)
    assert sum(p and not t for p, t in rows) <= 0.02 * len(rows)
