"""Remove byte strings that a document with a smaller id also holds.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document
of smaller id. This is a question about sorted suffixes: two strings are equal if their
suffixes stand together and agree in ``length`` bytes. To keep the sort in proportion to
the repeated text, suffixes are thinned twice before they move:

* every string of ``length`` bytes is represented by its part of :data:`ANCHOR` bytes with
  the smallest hash; equal strings choose the same part at the same offset, and neighbours
  mostly share theirs. Only anchors that occur in two documents go on;
* suffixes that share an anchor travel as one segment, and equal segments of one block are
  sent once, for the smallest id; for the other documents they are decided there.

Segments are range-partitioned by the leading bytes of their anchor; the splitters are
quantiles of a sample of anchors. Each bucket cuts segments into their suffixes and orders
them by multikey sorting with eight bytes as one character: suffixes that differ from all
others leave early. A run of equal suffixes keeps its smallest id. Splitters only cut
between leading bytes, so equal suffixes never lie on both sides of a boundary.

Texts are shuffled once into blocks and reused by all passes.

Defined results: a NULL text is empty. Documents shorter than ``length`` keep all bytes. A
NULL id is below all others. Rows with the same id do not remove each other's bytes. Kept
bytes may cut a multi-byte character, so they are binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceprofile.llm import blocks as B
from traceprofile.llm import common as C
from traceprofile.llm import hashing as H

LENGTH = 50
#: Bytes of an anchor, a multiple of eight and at most half of ``length``.
ANCHOR = 24
#: Leading bytes by which suffixes are partitioned.
LEAD = 16
#: Documents looked at, and anchors taken from each, for the splitters.
SAMPLE_DOCS, SAMPLE_ANCHORS = 1000, 32
#: Segments cut into suffixes at once.
_BATCH = 1 << 13
#: Bits of an anchor's key; more only matter for wrong candidates, which the sort drops.
_KEY_BITS = np.uint64((2**64 - 1) ^ (2**14 - 1))

_RESULT = "did long, n_bytes long, n_removed long, n_spans long, kept binary"


class _Run:
    """The strings of a run of texts and their anchors."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        sizes = np.diff(self.offset)
        ends = np.repeat(self.offset[1:], sizes)
        self.at = np.flatnonzero(np.arange(len(ends)) + length <= ends)
        if len(self.at):
            self.keys = H.byte_ngrams(self.bytes, ANCHOR) & _KEY_BITS
            self.anchor = H.window_minima(self.keys, length - ANCHOR + 1)[self.at]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offset, at, side="right") - 1


def _anchor_keys(length: int, parts: int):
    def work(table: pa.Table, rows: pa.Table | None) -> pa.Table:
        block, dids, texts = B.rows_of(table)
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, texts_run in B.text_runs(texts):
            run = _Run(texts_run, length)
            if len(run.at):
                anchors = np.unique(run.anchor)
                keys.append(run.keys[anchors])
                owners.append(dids[first + run.text_of(anchors)])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(keys)) - 1
        return B.sliced(block, parts, keys[starts], owners[starts] != owners[ends[:len(starts)]])

    return work


def _segments(run: _Run, shared: np.ndarray, length: int):
    """``(start, suffixes, offset of the anchor)`` of runs of neighbouring strings with one
    shared anchor."""
    chosen = H.member(run.keys[run.anchor], shared)
    at, anchor = run.at[chosen], run.anchor[chosen]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return at[first], count, anchor[first] - at[first]


def _widest(length: int) -> int:
    return 2 * length - ANCHOR


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` bytes from each start, zero after ``size``."""
    columns = np.arange(width)
    at = np.minimum(start[:, None] + columns, max(len(data) - 1, 0))
    return np.where(columns < size[:, None], data[at], 0).astype(np.uint8)


def _leads(rows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    at = offset[:, None] + np.arange(LEAD)
    return np.ascontiguousarray(np.take_along_axis(rows, at, axis=1)).view(f"S{LEAD}").ravel()


def _send(length: int, parts: int, splitters: list[bytes]):
    """Segments of a block to the buckets; with part -1 - x, removals decided already."""
    bounds = np.array(splitters, dtype=f"S{LEAD}")
    width = _widest(length)

    def work(table: pa.Table, rows: pa.Table) -> pa.Table:
        block, dids, texts = B.rows_of(table)
        shared = B.merged(rows)
        pieces = []
        for first, texts_run in B.text_runs(texts):
            run = _Run(texts_run, length)
            if len(run.at):
                start, count, offset = _segments(run, shared, length)
                text = run.text_of(start)
                pieces.append((
                    first + text, start - run.offset[text], count, offset,
                    _cut(run.bytes, start, count + length - 1, width),
                ))
        if not pieces:
            return B.key_rows(np.zeros(0), block, [])
        text, start, count, offset, data = (np.concatenate(c) for c in zip(*pieces))
        # equal segments of the block: only those of the smallest id can matter elsewhere
        leader = _leaders(data, dids[text], count, offset)
        decided = dids[text] > dids[text[leader]]
        blobs = [_result(text[decided], start[decided], _all_bits(count[decided]))]
        part = [-1 - block % parts]
        go = np.flatnonzero(~decided)
        lead = _leads(data[go], offset[go])
        to = np.searchsorted(bounds, lead, side="right")
        # neighbours in the order of suffixes compress well
        go = go[np.lexsort((lead.view(">u8").reshape(-1, LEAD // 8)[:, 0], to))]
        to = np.sort(to)
        cuts = np.flatnonzero(np.diff(to, prepend=-1)) if len(to) else np.zeros(0, np.int64)
        for i, j in zip(cuts, np.append(cuts[1:], len(to))):
            rows_ = go[i:j]
            used = np.arange(width) < (count[rows_] + length - 1)[:, None]
            blobs.append(H.pack(
                dids[text[rows_]], text[rows_].astype(np.uint32), start[rows_].astype(np.uint32),
                count[rows_].astype(np.uint8), offset[rows_].astype(np.uint8), data[rows_][used],
            ))
            part.append(int(to[i]))
        return B.key_rows(np.array(part), block, blobs)

    return work


def _all_bits(count: np.ndarray) -> np.ndarray:
    return (np.left_shift(1, count.astype(np.int64)) - 1).astype(np.uint32)


def _leaders(data: np.ndarray, did: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """For each segment the place of an equal one with the smallest id."""
    words = np.zeros((len(data), -(-data.shape[1] // 8) + 1), dtype=np.uint64)
    words.view(np.uint8)[:, :data.shape[1]] = data
    words[:, -1] = count * 256 + offset
    whole = H.ngrams_apart(words.T.ravel(), words.shape[1], len(words), len(words))
    order = np.lexsort((did, whole))
    new = np.ones(len(order), dtype=bool)
    new[1:] = whole[order[1:]] != whole[order[:-1]]
    leader = np.empty(len(order), dtype=np.int64)
    leader[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    wrong = np.flatnonzero(leader != np.arange(len(leader)))
    wrong = wrong[(words[wrong] != words[leader[wrong]]).any(axis=1)]
    leader[wrong] = wrong  # equal hashes of unequal segments
    return leader


def _result(text: np.ndarray, start: np.ndarray, bits: np.ndarray) -> bytes:
    return H.pack(text.astype(np.uint32), start.astype(np.uint32), bits.astype(np.uint32))


def equal_groups(group: np.ndarray, characters: np.ndarray) -> np.ndarray:
    """A number per row that is equal for equal rows only, by multikey sorting.

    ``group`` is equal for rows that may be equal. Rows of a group are ordered by their
    first 64-bit character; those that tie are ordered by the next one, and so on. Rows
    that no longer tie are not looked at again.
    """
    _, group, count = np.unique(group, return_inverse=True, return_counts=True)
    active, used = np.flatnonzero(count[group] > 1), len(count)
    for column in range(characters.shape[1]):
        if not len(active):
            break
        value = characters[active, column]
        order = np.lexsort((value, group[active]))
        rows, value = active[order], value[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (group[rows[1:]] != group[rows[:-1]]) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        group[rows] = used + np.cumsum(new)
        used += len(first) + 1
        size = np.diff(np.append(first, len(rows)))
        active = rows[np.repeat(size > 1, size)]
    return group


def _decide(data: np.ndarray, did: np.ndarray, count: np.ndarray, offset: np.ndarray,
            length: int) -> np.ndarray:
    """For each segment the bits of its suffixes that a smaller id also holds."""
    row = np.repeat(np.arange(len(count)), count)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    suffix = np.zeros((len(row), -(-length // 8) * 8), dtype=np.uint8)
    suffix[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length, axis=1)[row, shift]
    # equal suffixes hold the same anchor at the same place
    anchor = H.byte_ngrams(data.ravel(), ANCHOR)[np.arange(len(data)) * data.shape[1] + offset]
    may = anchor[row] + (offset[row] - shift).astype(np.uint64)
    group = equal_groups(may, suffix.view(">u8"))
    owner = did[row]
    order = np.lexsort((owner, group))
    new = np.ones(len(order), dtype=bool)
    new[1:] = group[order[1:]] != group[order[:-1]]
    least = np.empty(len(order), dtype=np.int64)
    least[order] = owner[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    bits = np.where(owner > least, np.left_shift(1, shift), 0)
    return np.add.reduceat(bits, np.cumsum(count) - count).astype(np.uint32)


def _bucket(length: int):
    width = _widest(length)

    def work(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        blocks, blobs = table.column("block").to_numpy(), table.column("blob").to_pylist()
        if part[0] < 0:
            return table
        columns = [H.unpack(blob) for blob in blobs]
        did, text, start, count, offset, flat = (np.concatenate(c) for c in zip(*columns))
        count, offset = count.astype(np.int64), offset.astype(np.int64)
        block = np.repeat(blocks, [len(c[0]) for c in columns])
        data = np.zeros((len(did), width), dtype=np.uint8)
        data[np.arange(width) < (count + length - 1)[:, None]] = flat
        # of equal segments one is looked at; those of larger ids lose all
        leader = _leaders(data, did, count, offset)
        bits = np.where(did > did[leader], _all_bits(count), 0).astype(np.uint32)
        own = np.flatnonzero(leader == np.arange(len(leader)))
        # segments in the order of their anchors, so that batches end between anchors
        at = offset[own, None] + np.arange(ANCHOR)
        anchor = np.ascontiguousarray(np.take_along_axis(data[own], at, axis=1)).view(">u8")
        order = np.lexsort(anchor.T[::-1])
        new = np.ones(len(order), dtype=bool)
        new[1:] = (anchor[order[1:]] != anchor[order[:-1]]).any(axis=1)
        order, first = own[order], np.append(np.flatnonzero(new), len(order))
        i = 0
        while i < len(first) - 1:
            j = max(i + 1, int(np.searchsorted(first, first[i] + _BATCH, side="right")) - 1)
            rows = order[first[i]:first[j]]
            if j > i + 1 or len(rows) > 1:
                bits[rows] = _decide(data[rows], did[rows], count[rows], offset[rows], length)
            i = j
        alike = did == did[leader]
        bits[alike] = bits[leader[alike]]
        hit = np.flatnonzero(bits)
        hit = hit[np.argsort(block[hit], kind="stable")]
        edge = np.flatnonzero(np.diff(block[hit], prepend=-1))
        out = [
            _result(text[hit[i:j]], start[hit[i:j]], bits[hit[i:j]])
            for i, j in zip(edge, np.append(edge[1:], len(hit)))
        ]
        return B.key_rows(np.full(len(out), part[0]), block[hit[edge]], out)

    return work


def _removal(length: int):
    def work(table: pa.Table, rows: pa.Table) -> pa.Table:
        _, dids, texts = B.rows_of(table)
        found = [H.unpack(blob) for blob in rows.column("blob").to_pylist()]
        empty = (np.zeros(0, np.uint32),) * 3
        text, start, bits = (np.concatenate(c) for c in zip(empty, *found))
        order = np.argsort(text, kind="stable")
        text, start, bits = text[order], start[order].astype(np.int64), bits[order]
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        n_removed, n_spans, kept = [], [], []
        for i, whole in enumerate(texts):
            at, mine = start[first[i]:first[i + 1]], bits[first[i]:first[i + 1]]
            if not len(at):
                n_removed.append(0)
                n_spans.append(0)
                kept.append(whole)
                continue
            edges = np.zeros(len(whole) + 1, dtype=np.int64)
            for shift in range(length - ANCHOR + 1):
                hit = at[(mine >> np.uint32(shift)) & np.uint32(1) == 1] + shift
                np.add.at(edges, hit, 1)
                np.add.at(edges, hit + length, -1)
            gone = np.cumsum(edges[:-1]) > 0
            n_removed.append(int(gone.sum()))
            n_spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
            kept.append(np.frombuffer(whole, dtype=np.uint8)[~gone].tobytes())
        return pa.table({
            "did": pa.array(dids, pa.int64()),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
            "kept": pa.array(kept, pa.binary()),
        })

    return work


def sampled_splitters(docs: DataFrame, length: int, parts: int) -> list[bytes]:
    """Quantiles of the leading bytes of a sample of anchors, at most ``parts - 1``."""
    every = max(1, docs.count() // SAMPLE_DOCS)

    def leads(batches):
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                run = _Run([text], length)
                if len(run.at):
                    anchors = np.unique(run.anchor)
                    lowest = anchors[np.argsort(run.keys[anchors])[:SAMPLE_ANCHORS]]
                    rows = _cut(run.bytes, lowest, np.full(len(lowest), LEAD), LEAD)
                    found += [row.tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["lead"])

    sample = C.identified(docs).filter(F.pmod(F.xxhash64("rid", "did"), F.lit(every)) == 0)
    rows = sample.select(F.col("text").cast("binary").alias("text")).mapInArrow(leads, "lead binary")
    values = sorted(bytes(r["lead"]) for r in rows.collect())
    return sorted({values[len(values) * i // parts] for i in range(1, parts)}) if values else []


def remove_earlier(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` of every document."""
    if not 2 * ANCHOR <= length <= ANCHOR + 31:
        raise ValueError(f"length must be from {2 * ANCHOR} to {ANCHOR + 31}")
    parts = B.n_parts(docs.sparkSession)
    splitters = sampled_splitters(docs, length, parts)
    base = B.in_blocks(docs)
    shared = B.repeated_keys(B.per_block(base, None, _anchor_keys(length, parts), B.KEYS))
    sent = B.per_block(base, shared, _send(length, parts, splitters), B.KEYS)
    decided = sent.groupBy("part").applyInArrow(_bucket(length), B.KEYS)
    result = B.per_block(base, decided, _removal(length), _RESULT)
    return result.select(C.given_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
