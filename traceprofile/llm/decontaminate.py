"""Find passages of a benchmark in documents by SimHash windows.

An item is represented by the SimHash of all its words; a document, for every length that
an item has, by the SimHash of its windows of that length. Only windows are fingerprinted
that hold as many shingles of any items as a leak of that length must. Fingerprints of 64 bits are indexed by four blocks of 16 bits, each under all
values within :data:`BLOCK_RADIUS` bits of its own: two fingerprints that differ in at most
:data:`RADIUS` bits have a block that differs in at most that many, so every pair within
the radius is found. A candidate is then compared exactly: the window of as many words as
the whole item, by the weighted Jaccard similarity of their shingles of five words, weighted
by occurrences. From :data:`MIN_SIMILARITY` on it is a leak.

Fingerprints of similar windows can be further apart than the radius, and a passage may be
cut off by either end of its text. So items are also counted by their shingles in the text,
and every window, clipped where it reaches over an end, with enough shingles of an item for
that similarity is compared exactly. No leak is lost; its distance may be above the radius.

Words are runs of letters and digits in lower case, so punctuation, case and markup
between words do not hide a passage.

The benchmark is a stated query set; it is taken in blocks of bounded size, one after the
other, and only one block is in the tasks at a time. Documents are read where they are, in
Arrow batches, and are not shuffled. Words are fingerprinted in slices, so memory does not
grow with the length of a text.

Defined results: a NULL or empty text holds nothing, an item without words is found
nowhere. Several places of an item in one document give one row, the most similar, then
the first. Repeated rows each get their rows.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceprofile.llm import hashing as H
from traceprofile.llm.common import bound_batches

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.75
#: Bits in which an equal block may differ, and what that guarantees over four blocks.
BLOCK_RADIUS = 2
_BLOCKS, _BLOCK_BITS = 4, 16
RADIUS = _BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Items, and bytes of items, in the tasks at a time.
ITEMS, ITEM_BYTES = 20_000, 16 << 20
#: Words fingerprinted at once.
_SLICE = 1 << 15

HITS = "array<struct<item:long,start:long,n_words:long,distance:int,similarity:double>>"


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the ``size`` word hashes from each place on; a bit is set by a majority."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64)
    return _windows(_bit_sums(hashes, size), size, np.arange(len(hashes) - size + 1))


def _bit_sums(hashes: np.ndarray, size: int) -> np.ndarray:
    """Running counts of each bit; their differences over up to ``size`` words are right."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    kind = np.uint16 if size < 1 << 16 else np.uint32
    sums = np.zeros((len(hashes) + 1, 64), dtype=kind)
    np.cumsum(bits, axis=0, dtype=kind, out=sums[1:])
    return sums


def _windows(sums: np.ndarray, size: int, start: np.ndarray) -> np.ndarray:
    most = (sums[start + size] - sums[start]) > size // 2
    return np.packbits(most, axis=1).view(np.uint64).ravel()


class _Index:
    """Fingerprints of one window size, found by any block within the block radius."""

    def __init__(self, prints: np.ndarray, items: np.ndarray) -> None:
        self.prints, self.items = prints, items
        near = np.array([
            sum(1 << b for b in bits) for r in range(BLOCK_RADIUS + 1)
            for bits in itertools.combinations(range(_BLOCK_BITS), r)
        ], dtype=np.uint64)
        self.blocks = []
        for block in range(_BLOCKS):
            value = ((prints >> np.uint64(_BLOCK_BITS * block)) & np.uint64(0xFFFF))[:, None] ^ near
            value = value.astype(np.uint16).ravel()
            owner = np.repeat(np.arange(len(prints), dtype=np.int32), len(near))
            order = np.argsort(value, kind="stable")
            self.blocks.append((value[order], owner[order]))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(place, number of the item, distance)`` of all within the radius."""
        places, owners = [], []
        for block, (values, owner) in enumerate(self.blocks):
            value = ((prints >> np.uint64(_BLOCK_BITS * block)) & np.uint64(0xFFFF)).astype(np.uint16)
            first = np.searchsorted(values, value)
            count = np.searchsorted(values, value, side="right") - first
            hit = np.flatnonzero(count)
            count = count[hit]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place, own = np.repeat(hit, count), owner[np.repeat(first[hit], count) + within]
            close = np.bitwise_count(prints[place] ^ self.prints[own]) <= RADIUS
            places.append(place[close])
            owners.append(own[close])
        place, own = np.concatenate(places), np.concatenate(owners)
        both = np.unique(place * len(self.prints) + own)
        place, own = both // len(self.prints), both % len(self.prints)
        return place, self.items[own], np.bitwise_count(prints[place] ^ self.prints[own])


def _shingles(hashes: np.ndarray) -> Counter:
    n = min(SHINGLE_WORDS, len(hashes))
    return Counter(H.ngrams(hashes, n).tolist()) if n else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    common = sum(min(n, b[x]) for x, n in a.items() if x in b)
    union = sum(a.values()) + sum(b.values()) - common
    return common / union if union else 0.0


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(text or "").lower().encode("utf-8", "replace") for text in texts]


def _words(texts: list[bytes]):
    hashes, _, _, first = H.word_hashes(texts, between=H.NOT_LETTERS)
    return hashes, first


class Matcher:
    """The items of one block of a benchmark."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        hashes, first = _words(_encoded([text for _, text in items]))
        self.numbers = [number for number, _ in items]
        self.words = [hashes[i:j] for i, j in zip(first[:-1], first[1:])]
        self.shingles = [_shingles(w) for w in self.words]
        self.n_words = np.array([len(w) for w in self.words], dtype=np.int64)
        whole = [H.ngrams(w, SHINGLE_WORDS) for w in self.words]
        self.known, at = np.unique(np.concatenate([hashes[:0], *whole]), return_inverse=True)
        self.n_shingles = np.array([len(w) for w in whole], dtype=np.int64)
        # the items of each known shingle, laid end to end
        pairs = np.unique(at * len(whole) + np.repeat(np.arange(len(whole)), self.n_shingles))
        self.owners = pairs % max(len(whole), 1)
        self.owned = np.searchsorted(pairs, np.arange(len(self.known) + 1) * len(whole))
        by_size: dict[int, list[int]] = {}
        for k, words in enumerate(self.words):
            if len(words):
                by_size.setdefault(len(words), []).append(k)
        self.indexes = {
            size: _Index(np.concatenate([simhashes(self.words[k], size) for k in own]),
                         np.array(own))
            for size, own in by_size.items()
        }
        self.short = {
            size: np.unique(np.concatenate([H.ngrams(self.words[k], size) for k in own]))
            for size, own in by_size.items() if size < SHINGLE_WORDS
        }

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text ``(item, start, n_words, distance, similarity)`` of its leaks."""
        best: list[dict[int, tuple]] = [{} for _ in texts]
        encoded = _encoded(texts)
        for low, high in H.chunks(encoded):
            hashes, first = _words(encoded[low:high])
            at = self._known_at(hashes, first)
            for text, item, start, end, distance in itertools.chain(
                self._candidates(hashes, first, at), self._counted(hashes, first, at)
            ):
                found = similarity(self.shingles[item], _shingles(hashes[start:end]))
                if found >= MIN_SIMILARITY:
                    known = best[low + text].get(item)
                    leak = (self.numbers[item], start - int(first[text]), end - start, distance, found)
                    if known is None or (-found, *leak[1:3]) < (-known[4], *known[1:3]):
                        best[low + text][item] = leak
        return [[b[item] for item in sorted(b)] for b in best]

    def _known_at(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of the shingles that occur in any item and lie within one text."""
        at = np.flatnonzero(H.member(H.ngrams(hashes, SHINGLE_WORDS), self.known))
        end = first[np.searchsorted(first, at, side="right")]
        return at[at + SHINGLE_WORDS <= end]

    def _counted(self, hashes: np.ndarray, first: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        """``(text, item, start, end, distance)`` of windows, clipped by the ends of their text,
        that may be similar: common shingles are at most those of the window that the item has."""
        if not len(at):
            return
        shingle = np.searchsorted(self.known, H.ngrams(hashes, SHINGLE_WORDS)[at])
        text_of = np.searchsorted(first, at, side="right") - 1
        for text in np.unique(text_of):
            begin, stop = int(first[text]), int(first[text + 1])
            own = slice(*np.searchsorted(text_of, [text, text + 1]))
            count = self.owned[shingle[own] + 1] - self.owned[shingle[own]]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            item = self.owners[np.repeat(self.owned[shingle[own]], count) + within]
            place = np.repeat(at[own], count)
            some, n = np.unique(item, return_counts=True)
            for k in some[n >= MIN_SIMILARITY * self.n_shingles[some]].tolist():
                places, size, shingles = place[item == k], len(self.words[k]), self.n_shingles[k]
                need = math.ceil(MIN_SIMILARITY * shingles)
                start = np.arange(places[need - 1] - shingles + 1, places[-need] + 1)
                low, high = np.maximum(start, begin), np.minimum(start + size, stop)
                held = (np.searchsorted(places, high - SHINGLE_WORDS, side="right")
                        - np.searchsorted(places, low))
                have = np.maximum(high - low - SHINGLE_WORDS + 1, 0)
                able = (held >= need) & (held >= MIN_SIMILARITY * (shingles + have - held))
                for a, b in np.unique(np.stack([low[able], high[able]], axis=1), axis=0).tolist():
                    apart = simhashes(hashes[a:b], b - a) ^ simhashes(self.words[k], size)
                    yield int(text), k, a, b, int(np.bitwise_count(apart)[0])

    def _starts(
        self, hashes: np.ndarray, first: np.ndarray, at: np.ndarray, size: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """``(text, start)`` of the windows of ``size`` words that may be similar to an item.

        A similar window has at least that share of its shingles in common with the item, so
        it has as many that occur in any item.
        """
        if size < SHINGLE_WORDS:  # one shingle, the whole window
            low = high = np.flatnonzero(H.member(H.ngrams(hashes, size), self.short[size]))
            text = np.searchsorted(first, low, side="right") - 1
        else:
            shingles = size - SHINGLE_WORDS + 1
            need = math.ceil(MIN_SIMILARITY * shingles)
            high, last = at[:max(0, len(at) - need + 1)], at[need - 1:]
            text = np.searchsorted(first, high, side="right") - 1
            near = (last - high < shingles) & (last < first[text + 1])
            text, high = text[near], high[near]
            low = np.maximum(last[near] - shingles + 1, first[text])
        high = np.minimum(high, first[text + 1] - size)
        if len(high) > 1:  # both ends ascend, so a window is left out where the last has it
            low = np.concatenate([low[:1], np.maximum(low[1:], high[:-1] + 1)])
        count = np.maximum(high - low + 1, 0)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(text, count), np.repeat(low, count) + within

    def _candidates(self, hashes: np.ndarray, first: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        """``(text, item, start, end, distance)`` of windows within the radius that may be similar."""
        if not self.indexes:
            return
        widest = max(self.indexes)
        able = {size: self._starts(hashes, first, at, size) for size in self.indexes}
        for low in range(0, len(hashes), _SLICE):
            sums = None
            for size, index in self.indexes.items():
                text, start = able[size]
                own = slice(*np.searchsorted(start, [low, low + _SLICE]))
                if own.start == own.stop:
                    continue
                if sums is None:
                    sums = _bit_sums(hashes[low:low + _SLICE + widest - 1], widest)
                place, item, distance = index.near(_windows(sums, size, start[own] - low))
                text, start = text[own][place], start[own][place]
                yield from zip(*(c.tolist() for c in (text, item, start, start + size, distance)))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about :data:`ITEMS` items and :data:`ITEM_BYTES` bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil(n / ITEMS), math.ceil((size or 0) / ITEM_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for number in range(blocks):
        rows = items.filter(block == number) if blocks > 1 else items
        yield [(r["item_id"], r["text"]) for r in rows.collect()]


def with_leaks(docs: DataFrame, items: list[tuple[int, str | None]], carried: list[str]) -> DataFrame:
    """``row``, a struct of the ``carried`` columns, and ``hits``, the leaks of its text."""
    packed = bound_batches(docs).select(F.struct(*carried).alias("row"), F.col("text").alias("body"))
    row_type = packed.schema["row"].dataType.simpleString()
    kind = pa.list_(pa.struct([
        ("item", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()),
        ("distance", pa.int32()), ("similarity", pa.float64()),
    ]))
    names = [f.name for f in kind.value_type]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            found = matcher.find(batch.column("body").to_pylist())
            hits = pa.array([[dict(zip(names, hit)) for hit in own] for own in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column("row"), hits], names=["row", "hits"])

    return packed.mapInArrow(work, f"row {row_type}, hits {HITS}")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, n_words, distance, similarity)`` of every leak."""
    found = None
    for items in item_blocks(benchmark):
        leaks = with_leaks(docs, items, ["doc_id"]).select(
            F.col("row.doc_id").alias("doc_id"), F.inline("hits")
        ).withColumnRenamed("item", "item_id")
        found = leaks if found is None else found.unionByName(leaks)
    return found


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item of the benchmark."""
    columns = docs.columns
    for items in item_blocks(benchmark):
        clean = with_leaks(docs, items, columns).filter(F.size("hits") == 0)
        docs = clean.select(*[F.col("row").getField(name).alias(name) for name in columns])
    return docs
