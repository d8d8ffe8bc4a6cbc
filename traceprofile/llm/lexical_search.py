"""Ranked lexical search of benchmark items over documents, by bag deduplication.

Every document is reduced to its bag: the terms that occur in any item, with their counts,
and its length class ``m``. Documents with the same bag and the same ``m`` have the same
score for every item, so they form one class. Classes are found by a hash of the bag and
verified by grouping on the bag itself. Only classes are scored. Each task keeps the best
classes of every item; the winners are expanded into their members by ascending id.

A class before another one has a member that ranks before all members of the other, so
the ``k`` best classes of an item hold its ``k`` best documents, and of each class the
``k`` smallest ids are enough. They are picked in each task before the shuffle, so a class
that holds a third of all documents sends ``k`` rows per task.

Items are a stated query set. They are taken in blocks of bounded size, and documents are
read once per block. The driver holds one block of items and the document frequencies of
its terms. Bags are staged in the shared folder, as they are read twice.

Terms are runs of ASCII letters and digits and of any character outside ASCII; A-Z are
lower-cased. Scores are integers, see :func:`term_weight` and :func:`scored_classes`.

Defined results: a NULL or empty text has no term, is counted nowhere and is never found.
An item without terms finds nothing. Equal scores rank by ascending id, a missing id
first. Repeated documents and repeated items each get their rows. Without documents or
items the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceprofile.llm.common import UPPER, bound_batches
from traceprofile.session import materialize

#: Documents returned for each item.
TOP = 10
#: Items, and bytes of items, in the tasks at a time.
ITEMS, ITEM_BYTES = 20_000, 16 << 20
#: Scores, and pairs of a term in a bag and an item, held at once in a task.
_SCORES, _PAIRS = 1 << 20, 1 << 20

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
#: Bytes of terms stay, upper case becomes lower case, all others become a space.
_FOLD = bytes(
    b if b in _KEPT else b + 32 if b in UPPER.encode() else 0x20 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_FOLD).split() if text else []


def term_weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Items:
    """One block of items: vocabulary, and for each of its terms the items that hold it."""

    def __init__(self, texts: list[str | None]) -> None:
        held = [sorted(set(terms(t.encode("utf-8", "replace") if t else None))) for t in texts]
        self.count = len(texts)
        self.vocabulary = sorted({term for own in held for term in own})
        number = {term: i for i, term in enumerate(self.vocabulary)}
        pairs = sorted((number[term], item) for item, own in enumerate(held) for term in own)
        self.items = np.array([item for _, item in pairs], dtype=np.int64)
        self.first = np.searchsorted(
            np.array([term for term, _ in pairs], dtype=np.int64), np.arange(len(number) + 1)
        )

    def scores(
        self, weights: np.ndarray, m: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray
    ) -> np.ndarray:
        """Scores by bag and item; ``first`` tells where each bag begins in ``term`` and ``tf``."""
        bag = np.repeat(np.arange(len(m)), np.diff(first))
        part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[bag]))
        count = self.first[term + 1] - self.first[term]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.items[np.repeat(self.first[term], count) + within]
        found = np.zeros(len(m) * self.count, dtype=np.int64)
        np.add.at(found, np.repeat(bag, count) * self.count + item, np.repeat(part, count))
        return found.reshape(len(m), self.count)


def item_blocks(benchmark: DataFrame) -> Iterator[list]:
    """``(item_id, text)`` rows in blocks of about :data:`ITEMS` items and :data:`ITEM_BYTES` bytes."""
    items = benchmark.select("item_id", "text")
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil(n / ITEMS), math.ceil((size or 0) / ITEM_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for number in range(blocks):
        yield (items.filter(block == number) if blocks > 1 else items).collect()


def _lists(values: list[list[int]]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(v) for v in values])
    flat = np.fromiter((x for v in values for x in v), dtype=np.int32, count=offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id``, ``n`` (terms of the text), ``term`` and ``tf`` (its bag, by term number)."""
    packed = bound_batches(docs).select("doc_id", F.col("text").cast("binary").alias("body"))
    id_type = packed.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(vocabulary)}
        for batch in batches:
            size, held, times = [], [], []
            for body in batch.column("body").to_pylist():
                found = terms(body)
                own = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                size.append(len(found))
                held.append([t for t, _ in own])
                times.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), _lists(held), _lists(times)],
                names=["doc_id", "n", "term", "tf"],
            )

    return packed.mapInArrow(count, f"doc_id {id_type}, n long, term array<int>, tf array<int>")


def classes(found: DataFrame, documents: int, words: int, k: int) -> DataFrame:
    """``m``, ``term``, ``tf`` and the ``k`` smallest ``ids`` of every class of documents.

    ``documents`` and ``words`` count the documents that have a term, and all their terms.
    """
    m = F.expr(
        f"10 + (CAST(n AS DECIMAL(18,0)) * CAST({90 * documents} AS DECIMAL(20,0))) div {words}"
    )
    own = ["hash", "m", "term", "tf"]
    ranked = (
        found.filter(F.size("term") > 0)
        .select("doc_id", m.cast("long").alias("m"), "term", "tf")
        .withColumn("hash", F.xxhash64("m", "term", "tf"))
        .withColumn("n", F.row_number().over(Window.partitionBy(*own).orderBy("doc_id")))
        .filter(F.col("n") <= k)
    )
    listed = F.array_sort(F.collect_list(F.struct("n", "doc_id")))
    return ranked.groupBy(*own).agg(listed.alias("listed")).select(
        "m", "term", "tf", F.col("listed.doc_id").alias("ids")
    )


def scored_classes(found: DataFrame, items: Items, weights: np.ndarray, k: int) -> DataFrame:
    """``item``, ``score`` and ``ids`` of the ``k`` best classes of each item in each task.

    The score of a bag adds, over the terms of the item, its weight times
    ``(10^9 tf) div (1000 tf + 8 m)``.
    """
    id_type = found.schema["ids"].dataType.simpleString()
    rows = max(1, _SCORES // max(1, items.count))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(items.count)]
        ids_type = pa.null()
        for batch in batches:
            ids_type = batch.column("ids").type
            for low, high in _chunks(batch.column("term"), items, rows):
                _keep_best(best, batch.slice(low, high - low), items, weights, k)
        flat = [(i, score, ids) for i, own in enumerate(best) for score, _, ids in own]
        if flat:
            item, score, members = zip(*flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(members, ids_type)],
                names=["item", "score", "ids"],
            )

    return found.mapInArrow(work, f"item int, score long, ids {id_type}")


def _chunks(term: pa.ListArray, items: Items, rows: int) -> Iterator[tuple[int, int]]:
    """Runs of bags, of ``rows`` at most, that meet about ``_PAIRS`` items with their terms."""
    flat = np.asarray(term.flatten(), dtype=np.int64)
    met = np.concatenate([[0], np.cumsum(items.first[flat + 1] - items.first[flat])])
    first = np.asarray(term.offsets, dtype=np.int64)
    met, low = met[first - first[0]], 0
    while low < len(term):
        last = int(np.searchsorted(met, met[low] + _PAIRS, side="right")) - 1
        high = min(max(last, low + 1), low + rows, len(term))
        yield low, high
        low = high


def _keep_best(
    best: list[list[tuple]], batch: pa.RecordBatch, items: Items, weights: np.ndarray, k: int
) -> None:
    """Merge a batch of classes into ``best``: per item ``(score, key of the first id, ids)``."""
    term, tf = batch.column("term"), batch.column("tf")
    first = np.asarray(term.offsets, dtype=np.int64)
    found = items.scores(
        weights, np.asarray(batch.column("m"), dtype=np.int64), first - first[0],
        np.asarray(term.flatten(), dtype=np.int64), np.asarray(tf.flatten(), dtype=np.int64),
    )
    ids = batch.column("ids").to_pylist()
    keys = [(own[0] is not None, own[0]) for own in ids]
    place = np.empty(len(ids), dtype=np.int64)
    place[sorted(range(len(ids)), key=keys.__getitem__)] = np.arange(len(ids))
    for item, own in enumerate(best):
        column = found[:, item]
        least = max(own[-1][0] if len(own) == k else 1, 1)
        able = np.flatnonzero(column >= least)
        if not len(able):
            continue
        order = able[np.lexsort((place[able], -column[able]))[:k]]
        own += [(int(column[i]), keys[i], ids[i]) for i in order.tolist()]
        own.sort(key=lambda entry: (-entry[0], entry[1]))
        del own[k:]


def search(docs: DataFrame, benchmark: DataFrame, k: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)`` of the ``k`` best documents of each item."""
    spark, total = docs.sparkSession, None
    for rows in item_blocks(benchmark):
        items = Items([row["text"] for row in rows])
        found = materialize(bags(docs, items.vocabulary), "search-bags")
        documents, words = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        holding = dict(found.select(F.explode("term").alias("term")).groupBy("term").count().collect())
        weights = np.array(
            [term_weight(documents, holding.get(t, 0)) for t in range(len(items.vocabulary))],
            dtype=np.int64,
        )
        best = scored_classes(classes(found, documents, max(words or 0, 1), k), items, weights, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = (
            best.select("item", "score", F.explode("ids").alias("doc_id"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        )
        names = spark.createDataFrame(
            [(i, row["item_id"]) for i, row in enumerate(rows)],
            f"item int, item_id {benchmark.schema['item_id'].dataType.simpleString()}",
        )
        # a block of items is bounded
        named = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        total = named if total is None else total.unionByName(named)
    return total
