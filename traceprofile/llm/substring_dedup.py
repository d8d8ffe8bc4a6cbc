"""Remove word sequences that occur more than once, in all their places.

A window of ``window`` words is removed if its words also start anywhere else. Instead of
counting all windows at full length, repeats are found at a quarter of the length first;
only windows that hold such a repeat are looked at with half of the length, and only what
is left there at full length. A window is represented at a level by one of its parts of
that length, the one with the smallest hash: equal windows choose the same part, so a
repeated window has a repeated part, and neighbouring windows mostly share theirs, which
leaves about 2 / (window - length + 2) of the positions to count.

Texts are shuffled once into blocks; per level only sorted 64-bit keys travel. At the last
level all windows left are counted by the hash of all their words: among n of them a wrong
match is expected n^2 / 2^65 times.

Defined results: a NULL or blank text has no words. Words are compared unchanged. Rows are
places of their own, so a repeated row loses all its windows. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from traceprofile.llm import blocks as B
from traceprofile.llm import common as C
from traceprofile.llm import hashing as H

WINDOW = 35
_RESULT = "did long, n_words long, n_removed long, kept binary"


def level_lengths(window: int) -> list[int]:
    """A quarter, a half and the whole of the window, without repeats."""
    return sorted({math.ceil(window / 4), math.ceil(window / 2), window})


def _valid(first: np.ndarray, window: int) -> np.ndarray:
    """Places from which a window ends within its text."""
    ends = np.repeat(first[1:], np.diff(first))
    return np.flatnonzero(np.arange(len(ends)) + window <= ends)


def _parts(hashes: np.ndarray, at: np.ndarray, window: int, length: int):
    """Hashes of all parts of ``length``, and for windows ``at`` the place of their part."""
    grams = H.ngrams(hashes, length)
    return grams, at if length == window else H.window_minima(grams, window - length + 1)[at]


def _level(lengths: list[int], level: int, window: int, parts: int):
    """Keys of one level from the texts of a block and the repeats of the level before."""
    def work(table: pa.Table, rows: pa.Table | None) -> pa.Table:
        block, _, texts = B.rows_of(table)
        before = B.merged(rows) if rows is not None else None
        found = []
        for _, run in B.text_runs(texts):
            hashes, _, _, first = H.word_hashes(run)
            at = _valid(first, window)
            if before is not None and len(at):
                grams, place = _parts(hashes, at, window, lengths[level - 1])
                at = at[H.member(grams[place], before)]
            if len(at):
                grams, place = _parts(hashes, at, window, lengths[level])
                found.append(grams[np.unique(place)])
        keys = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
        keys, count = np.unique(keys, return_counts=True)
        return B.sliced(block, parts, keys, count > 1)

    return work


def _removal(window: int):
    def work(table: pa.Table, rows: pa.Table) -> pa.Table:
        _, dids, texts = B.rows_of(table)
        repeats = B.merged(rows)
        n_words, n_removed, kept = [], [], []
        for _, run in B.text_runs(texts):
            hashes, _, _, first = H.word_hashes(run)
            at = _valid(first, window)
            grams = H.ngrams(hashes, window)
            at = at[H.member(grams[at], repeats)]
            edges = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + window, -1)
            stays = np.cumsum(edges[:-1]) == 0
            for i, text in enumerate(run):
                keep = stays[first[i]:first[i + 1]]
                words = text.split()
                if not keep.all():
                    words = [words[k] for k in np.flatnonzero(keep)]
                n_words.append(len(keep))
                n_removed.append(len(keep) - len(words))
                kept.append(b" ".join(words))
        return pa.table({
            "did": pa.array(dids, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()),
        })

    return work


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)`` of every document, ``text`` being the words
    kept, joined by one space."""
    base, parts = B.in_blocks(docs), B.n_parts(docs.sparkSession)
    lengths = level_lengths(window)
    repeats = None
    for level in range(len(lengths)):
        keys = B.per_block(base, repeats, _level(lengths, level, window, parts), B.KEYS)
        repeats = B.repeated_keys(keys)
    result = B.per_block(base, repeats, _removal(window), _RESULT)
    return result.select(
        C.given_id().alias("doc_id"), "n_words", "n_removed", result["kept"].cast("string").alias("text")
    )
