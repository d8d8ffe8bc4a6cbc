"""Link documents whose sets of word shingles are similar, by parity sketches.

A document's set holds its distinct shingles of five words. Two documents link if
``100 * common >= 75 * union``; then their sets differ in at most a third of the smaller
one. The sketch of a set has ``n`` blocks: each shingle belongs to one block by its hash
and is XORed into it, so that common shingles cancel and sketches differ in at most as
many blocks as sets differ in shingles. With more blocks than the sets may differ in, two
linked documents have an equal block: candidates are found by a join on blocks.

*Size bands.* Band ``i`` holds sizes from ``s`` up to ``s / 0.75``. Linked documents lie in
the same or in neighbouring bands, so each document makes a sketch for its own band (as
the smaller one) and for the band below (as the larger one). ``D``, the most that a pair
of a band may differ in, fixes the number of blocks, with a quarter added.

*Empty blocks* are equal in all documents and not used. A document with more than ``D``
filled blocks loses no partner by that, as one of its filled blocks is untouched by the
difference. If of two documents neither has so many, they meet on single shingles, which
such documents send besides.

*Common blocks* (a passage that many documents share) are avoided in the same way: of its
filled blocks a document shares all but ``D`` with a partner. If blocks are put in one order
for all, by the number of their classes, the first block that both have is among the first
``D + 1`` filled blocks of either, so the commonest others are left out.

*Copies.* Documents with equal sets are one class. Blocks are joined as compressed runs of
sorted keys; a class enters each block once per batch however many copies it has.

*Links.* Every class is first compared with the class it shares most blocks with, smallest
first. Components of these links need no more comparisons inside, which disposes of large
groups of near copies. Then, in rounds, every class is compared with the class of another
component whose parity bits are nearest, as long as such comparisons find links. At last all
pairs of a block that still lie in different components, have sizes in the ratio and parity
bits that differ in few enough places are compared exactly. A large set stands in thousands of
blocks, so its parity bits are not copied to each: pairs of small blocks are made distinct
before they meet the bits, and a group of larger blocks gets the bits of a class once. Staged
tables go when the next ones are written.
Components are found by passing on the smallest label along links and along labels.

Defined results: a document without words has an empty set and links with nothing; one
with fewer than five words has one shingle. A NULL id is below all others. Rows with equal
text are copies. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceprofile.llm import blocks as B
from traceprofile.llm import common as C
from traceprofile.llm import hashing as H
from traceprofile.operators.joins import fits_broadcast
from traceprofile.session import materialize, release

SHINGLE_WORDS = 5
#: Similarity in percent from which documents link.
PERCENT = 75
#: Blocks of a sketch for each difference to be covered.
SPARE = 1.25
#: Rarest open blocks of a class in which its nearest one is looked for; the last step takes
#: all that are needed.
NEAREST_BLOCKS = 8
#: Rounds of nearest classes go on while one in so many comparisons finds a link.
GAIN = 20
#: Classes of a block up to which its pairs are sent to the parity bits; to larger blocks the
#: parity bits are sent.
FEW_CLASSES = 8
#: Parity bits for each shingle of the band's largest set.
PARITY_BITS = 4
#: Bytes of text whose blocks are sent as one run.
BATCH_BYTES = 8 << 20
#: Pairs of classes looked at at once.
_PAIRS = 1 << 19
_TWO = np.uint64(2)
#: The lowest bits of a join key hold the band.
_BAND_BITS = np.uint64(2**16 - 1)


def band_starts(percent: int = PERCENT, largest: int = 2**40) -> np.ndarray:
    """First sizes of the bands: the next band starts above what links with the first size."""
    starts = [1]
    while starts[-1] < largest:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts, dtype=np.int64)


_BANDS = band_starts()


def most_different(band: int, percent: int = PERCENT) -> int:
    """The most shingles in which a linked pair differs whose smaller set is in ``band``."""
    size = int(_BANDS[band + 1]) - 1
    # a + b shingles with |difference| d have similarity (a + b - d) / (a + b + d)
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


def n_blocks(band: int) -> int:
    return math.ceil((most_different(band) + 1) * SPARE) + 2


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for first, end in H.chunks(texts):
        hashes, _, _, at = H.word_hashes(texts[first:end], lower=True)
        grams = H.ngrams(hashes, SHINGLE_WORDS)
        for i, j in zip(at[:-1], at[1:]):
            if j - i >= SHINGLE_WORDS:
                yield np.unique(grams[i:j - SHINGLE_WORDS + 1])
            elif j > i:
                yield H.ngrams(hashes[i:j], int(j - i)) + np.uint64(j - i)
            else:
                yield grams[:0]


def class_of(shingles: np.ndarray) -> int:
    """A hash of the whole set."""
    with np.errstate(over="ignore"):
        total = H.mixed(shingles + np.uint64(len(shingles))).sum(dtype=np.uint64)
        return int(H.mixed(np.array([total]))[0].astype(np.int64))


def bands_of(size: int) -> list[int]:
    """The bands in which a set of this size takes part: its own and the one below."""
    own = int(np.searchsorted(_BANDS, size, side="right")) - 1
    return [own] if own == 0 else [own, own - 1]


def sketch(shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """``(numbers, values)`` of the filled blocks of a set."""
    blocks = n_blocks(band)
    block = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    values = H.mixed(shingles)
    # sorted shingles have sorted blocks
    first = np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1))
    return block[first], np.bitwise_xor.reduceat(values, first)


def block_keys(shingles: np.ndarray, band: int) -> np.ndarray:
    """Join keys of a set in a band; of its shingles too if it has too few filled blocks."""
    number, value = sketch(shingles, band)
    place = number * _TWO + np.uint64(2 * band + 1) * np.uint64(2**40)
    keys = H.chained(value, place)
    if len(number) <= most_different(band):
        keys = np.concatenate([keys, H.chained(shingles, np.uint64(2 * band) * np.uint64(2**40))])
    return keys


def parity_bits(shingles: np.ndarray, band: int) -> bytes:
    """Parity of the shingles that fall on each bit."""
    bits = 1 << max(6, int(PARITY_BITS * _BANDS[band + 1] - 1).bit_length())
    at = (H.mixed(shingles + np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1).tobytes()


def _binary_texts(docs: DataFrame) -> DataFrame:
    return C.bound_batches(C.identified(docs)).select(
        "did", "rid", F.col("text").cast("binary").alias("text")
    )


def reserve(shingles: np.ndarray, band: int) -> int:
    """Filled blocks of a set beyond those that a linked one may differ in, less one."""
    return len(sketch(shingles, band)[0]) - most_different(band) - 1


def members(docs: DataFrame) -> DataFrame:
    """``(did, rid, class, n_shingles, reserves)`` of every document; no class for an empty
    set. ``reserves`` are those of its bands, its own first."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([
                batch.column("did"), batch.column("rid"),
                pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([[reserve(s, b) for b in bands_of(len(s))] if len(s) else [] for s in sets],
                         pa.list_(pa.int32())),
            ], names=["did", "rid", "class", "n_shingles", "reserves"])

    return _binary_texts(docs).mapInArrow(
        work, "did long, rid long, class long, n_shingles long, reserves array<int>"
    )


def _sent_keys(docs: DataFrame, parts: int) -> DataFrame:
    """Compressed runs of ``(key, band, class)`` by part of the key range."""
    def runs(texts: list[bytes]) -> pa.Table:
        seen: dict[int, int] = {}
        keys, owners = [], []
        for shingles in shingle_sets(texts):
            cls = class_of(shingles) if len(shingles) else None
            if cls is None or cls in seen:
                continue
            seen[cls] = len(seen)
            for band in bands_of(len(shingles)):
                found = block_keys(shingles, band)
                keys.append(found & ~_BAND_BITS | np.uint64(band))
                owners.append(np.full(len(found), seen[cls], dtype=np.uint32))
        if not keys:
            return B.key_rows(np.zeros(0), 0, [])
        classes = np.array(list(seen), dtype=np.int64)
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        cuts = np.concatenate([[0], np.searchsorted(key, B.places(parts)), [len(key)]])
        full = np.flatnonzero(np.diff(cuts))
        blobs = []
        for i in full:
            part = slice(cuts[i], cuts[i + 1])
            used, place = np.unique(owner[part], return_inverse=True)
            place = place.astype(np.uint16 if len(used) < 2**16 else np.uint32)
            blobs.append(H.pack(key[part], place, classes[used]))
        return B.key_rows(full, 0, blobs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            texts += batch.column("text").to_pylist()
            held += batch.nbytes
            if held >= BATCH_BYTES:
                yield from runs(texts).select(["part", "blob"]).to_batches()
                texts, held = [], 0
        yield from runs(texts).select(["part", "blob"]).to_batches()

    return _binary_texts(docs).select("text").mapInArrow(work, "part int, blob binary")


def shared_blocks(docs: DataFrame) -> DataFrame:
    """``(key, band, class)``: the classes of every block that holds several."""
    def work(table: pa.Table) -> pa.Table:
        columns = [H.unpack(blob) for blob in table.column("blob").to_pylist()]
        key = np.concatenate([c[0] for c in columns])
        cls = np.concatenate([c[2][c[1]] for c in columns])
        order = np.argsort(key, kind="stable")
        key, cls = key[order], cls[order]
        several = np.zeros(len(key), dtype=bool)
        several[1:] = key[1:] == key[:-1]
        several[:-1] |= several[1:].copy()
        key, cls = key[several], cls[several]
        order = np.lexsort((cls, key))
        key, cls = key[order], cls[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls = key[new], cls[new]
        keep = np.zeros(len(key), dtype=bool)
        keep[1:] = key[1:] == key[:-1]
        keep[:-1] |= keep[1:].copy()
        return pa.table({
            "key": pa.array(key[keep].astype(np.int64)), "band": pa.array((key[keep] & _BAND_BITS).astype(np.int32)),
            "class": pa.array(cls[keep]),
        })

    sent = _sent_keys(docs, max(1, B.n_parts(docs.sparkSession) // 2))
    return sent.groupBy("part").applyInArrow(work, "key long, band int, class long")


def _needed_blocks(raw: DataFrame, needs: DataFrame) -> DataFrame:
    """``(key, band, class, hub, n)``, written: shared blocks of classes that can have a partner
    in the band, with the smallest class of each block and their number.

    Of the filled blocks of a class at most ``D`` differ in a linked one, so it shares more
    of them than its reserve. A class that has no more shared blocks in all has no partner.
    """
    enough = raw.groupBy("class", "band").agg(F.count("*").alias("shared")).join(
        _small(needs), ["class", "band"]
    ).filter(F.col("shared") > F.col("reserve")).select("class", "band")
    possible = materialize(enough, "possible")
    kept = raw.join(_small(possible), ["class", "band"])
    several = kept.groupBy("key").agg(F.min("class").alias("hub"), F.count("*").alias("n"))
    blocks = materialize(
        kept.join(several.filter("n > 1"), "key").select("key", "band", "class", "hub", "n"), "blocks"
    )
    release(possible)
    return blocks


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(class, text)`` of the ``(class, did, rid)`` in ``wanted``, a written table.

    It is broadcast if its files are small; the texts are then not shuffled. A repeated
    row is passed on once per task.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            classes = batch.column("class").to_pylist()
            fresh = [not (c in seen or seen.add(c)) for c in classes]
            yield batch.filter(pa.array(fresh, pa.bool_()))

    rows = _binary_texts(docs).join(_small(wanted), ["did", "rid"]).select("class", "text")
    return rows.mapInArrow(work, "class long, text binary")


def _linked(pairs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose texts ``text_a`` and ``text_b`` link."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (shingle_sets(batch.column(c).to_pylist()) for c in ("text_a", "text_b"))
            keep = []
            for a, b in zip(*sides):
                common = int(H.member(a, b).sum())
                keep.append(100 * common >= PERCENT * (len(a) + len(b) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"]
            )

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def _verified(docs: DataFrame, first_of: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those of the written ``pairs`` (a, b) that link, written."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = materialize(first_of.join(used, "class"), f"{name}-wanted")
    texts = materialize(_texts_of(docs, wanted), f"{name}-texts")
    both = pairs.join(
        texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a"
    ).join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    links = materialize(_linked(both), f"{name}-links")
    release(wanted, texts)
    return links


def components(links: DataFrame) -> DataFrame:
    """``(class, label)`` of all classes in ``links`` (a, b): the smallest class reachable.

    Each round passes the smallest label on along links and follows labels once; rounds
    grow with the logarithm of the longest chain. Only a count reaches the driver.
    """
    edges = materialize(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges"
    )
    labels = materialize(
        edges.groupBy(F.col("a").alias("class")).agg(F.min(F.least("a", "b")).alias("label")), "labels"
    )
    while True:
        of_b = labels.select(F.col("class").alias("b"), F.col("label").alias("offer"))
        offers = edges.join(of_b, "b").groupBy(F.col("a").alias("class")).agg(F.min("offer").alias("offer"))
        nearer = labels.join(offers, "class").select(
            "class", F.col("label").alias("old"), F.least("label", "offer").alias("label")
        )
        jump = labels.select(F.col("class").alias("label"), F.col("label").alias("further"))
        moved = materialize(nearer.join(jump, "label", "left").select(
            "class", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        ), "labels")
        release(labels)
        if moved.filter("old <> label").isEmpty():
            found = materialize(moved.select("class", "label"), "labels")
            release(edges, moved)
            return found
        labels = moved


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its files are small."""
    return F.broadcast(table) if fits_broadcast(table.sparkSession, table) else table


def _open_blocks(blocks: DataFrame, labels: DataFrame, needs: DataFrame) -> DataFrame:
    """``(key, band, class, label, place, n)``, written: the blocks in which linked classes of
    different components are bound to meet; ``place`` counts those of a class, rarest first,
    ``n`` the classes of a block.

    A block with classes of one component is closed. Classes of different components that
    link share only open blocks, and more of them than the reserve of either, so the first
    one they share, rarest first, is among as many as a class has open blocks beyond its
    reserve.
    """
    rows = blocks.join(_small(labels), "class", "left").withColumn("label", F.coalesce("label", "class"))
    keys = materialize(_between_components(rows), "open-keys")
    of_class = Window.partitionBy("class", "band")
    first = materialize(
        rows.join(_small(keys.select("key")), "key").join(_small(needs), ["class", "band"])
        .withColumn("place", F.row_number().over(of_class.orderBy("n", "key")))
        .withColumn("open", F.count("*").over(of_class))
        .filter(F.col("place") <= F.col("open") - F.col("reserve"))
        .select("key", "band", "class", "label", "place"), "first-blocks"
    )
    # where the others of a block left it out, nothing meets
    left = materialize(_between_components(first), "met-keys")
    found = materialize(first.join(_small(left), "key"), "open-blocks")
    release(keys, first, left)
    return found


def _between_components(rows: DataFrame) -> DataFrame:
    """The keys with classes of several components, and the number of their rows."""
    labels = rows.groupBy("key").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")
    )
    return labels.filter("least <> most").select("key", "n")


def _pairs(opened: DataFrame, sketches: DataFrame, nearest: bool) -> DataFrame:
    """Pairs ``(a, b)`` of one block and different components that may link: all of them, or
    of each class the one whose parity bits are nearest."""
    if nearest:
        found = _in_groups(opened.filter(F.col("place") <= NEAREST_BLOCKS), sketches, _nearest_in_blocks)
        best = found.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best"))
        found = best.select(F.greatest("a", "best.b").alias("a"), F.least("a", "best.b").alias("b"))
    else:
        found = _in_groups(opened.filter(F.col("n") > FEW_CLASSES), sketches, _pairs_in_blocks).unionByName(
            _of_few(opened.filter(F.col("n") <= FEW_CLASSES), sketches))
    return found.select("a", "b").distinct()


def _in_groups(opened: DataFrame, sketches: DataFrame, work) -> DataFrame:
    """What ``work`` finds in groups of whole blocks, beside which each class has its sketch once."""
    spread = F.pmod(F.xxhash64("key"), F.lit(B.n_parts(opened.sparkSession)))
    rows = opened.select("key", "band", "class", "label", spread.alias("group"))
    # under names of their own: the two sides come of one table
    of_group = opened.select(
        spread.alias("beside"), *[F.col(c).alias(c) for c in ("class", "band")]
    ).distinct().join(_small(sketches), ["class", "band"])
    return rows.groupBy("group").cogroup(of_group.groupBy("beside")).applyInArrow(
        work, "a long, b long, apart long"
    )


def _of_few(opened: DataFrame, sketches: DataFrame) -> DataFrame:
    """:func:`_pairs_in_blocks` of blocks with few classes."""
    one = opened.select("key", "band", F.col("class").alias("a"), F.col("label").alias("label_a"))
    other = opened.select("key", F.col("class").alias("b"), F.col("label").alias("label_b"))
    pairs = one.join(other, "key").filter("a > b and label_a <> label_b").select("a", "b", "band").distinct()
    for side in ("a", "b"):
        of_side = sketches.select(
            F.col("class").alias(side), "band", F.col("n_shingles").alias(f"size_{side}"),
            F.col("parity").alias(f"parity_{side}"),
        )
        pairs = pairs.join(
            F.broadcast(of_side) if fits_broadcast(sketches.sparkSession, sketches) else of_side, [side, "band"]
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, band, size_a, size_b = (
                batch.column(c).to_numpy() for c in ("a", "b", "band", "size_a", "size_b")
            )
            for number in np.unique(band):
                at = np.flatnonzero(band == number)
                bits_a, bits_b = (_bits(batch.column(c), at) for c in ("parity_a", "parity_b"))
                apart = np.bitwise_count(bits_a ^ bits_b).sum(axis=1, dtype=np.int64)
                keep = apart <= _most_apart(int(number), size_a[at] + size_b[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[keep]) for c in (a[at], b[at], apart)], names=["a", "b", "apart"]
                )

    in_ratio = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * PERCENT
    return pairs.filter(in_ratio).mapInArrow(work, "a long, b long, apart long")


def _sketches(texts: DataFrame) -> DataFrame:
    """``(class, band, n_shingles, parity)``: the parity bits of each set in its bands."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sets = shingle_sets(batch.column("text").to_pylist())
            for cls, shingles in zip(batch.column("class").to_pylist(), sets):
                for band in bands_of(len(shingles)):
                    out.append((cls, band, len(shingles), parity_bits(shingles, band)))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["class", "band", "n_shingles", "parity"],
            )

    # a repeated row gives the text of its class once per task
    return texts.mapInArrow(work, "class long, band int, n_shingles long, parity binary").dropDuplicates(
        ["class", "band"])


def _nearest_in_blocks(rows: pa.Table, sketches: pa.Table) -> pa.Table:
    """Of each class the nearest one of another component, ``a`` and ``b``."""
    found = _pairs_in_blocks(rows, sketches)
    a, b, apart = (found.column(c).to_numpy() for c in ("a", "b", "apart"))
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    apart = np.concatenate([apart, apart])
    order = np.lexsort((other, apart, one))
    one, other, apart = one[order], other[order], apart[order]
    first = np.diff(one, prepend=~one[:1]) != 0
    return pa.table({"a": one[first], "b": other[first], "apart": apart[first]})


def _pairs_in_blocks(rows: pa.Table, sketches: pa.Table) -> pa.Table:
    """Pairs of one block whose sizes and parity bits allow a link, for many blocks.

    Within a block rows stand in the order of their size, so each row is compared with the
    rows after it up to the largest size that may link; pairs are made and tested in runs
    of bounded number.
    """
    key, band, cls, label = (rows.column(c).to_numpy() for c in ("key", "band", "class", "label"))
    sketch_of = _sketch_places(cls, band, sketches)
    size = sketches.column("n_shingles").to_numpy()[sketch_of]
    parity = sketches.column("parity")
    order = np.lexsort((size, key))
    key, band, cls, label, size, sketch_of = (c[order] for c in (key, band, cls, label, size, sketch_of))
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    end = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
    # rank of (block, size) makes the largest size that may link a place in one array
    place = np.arange(len(key))
    stop = np.empty(len(key), dtype=np.int64)
    for i, j in zip(first, np.append(first[1:], len(key))):
        stop[i:j] = i + np.searchsorted(size[i:j], size[i:j] * 100 // PERCENT, side="right")
    count = np.minimum(stop, end) - place - 1
    none = np.zeros(0, dtype=np.int64)
    low, high, distance = [none], [none], [none]
    total = np.cumsum(count)
    i = 0
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _PAIRS, side="right")))
        left = np.repeat(place[i:j], count[i:j])
        right = left + 1 + np.arange(len(left)) - np.repeat(
            np.cumsum(count[i:j]) - count[i:j], count[i:j]
        )
        other = label[left] != label[right]
        left, right = left[other], right[other]
        for number in np.unique(band[left]):
            of_band = band[left] == number
            near = _near(parity, sketch_of, left[of_band], right[of_band], size, int(number))
            low.append(np.minimum(cls[near[0]], cls[near[1]]))
            high.append(np.maximum(cls[near[0]], cls[near[1]]))
            distance.append(near[2])
        i = j
    high, low, distance = (np.concatenate(c) for c in (high, low, distance))
    _, once = np.unique(np.stack([high, low]), axis=1, return_index=True)
    return pa.table({"a": high[once], "b": low[once], "apart": distance[once]})


def _sketch_places(cls: np.ndarray, band: np.ndarray, sketches: pa.Table) -> np.ndarray:
    """Row of the sketch of each class in its band."""
    of_cls, of_band = (sketches.column(c).to_numpy() for c in ("class", "band"))
    _, at = np.unique(
        np.stack([np.concatenate([of_cls, cls]), np.concatenate([of_band, band]).astype(np.int64)]),
        axis=1, return_inverse=True,
    )
    places = np.empty(len(of_cls), dtype=np.int64)
    at = at.ravel()
    places[at[:len(of_cls)]] = np.arange(len(of_cls))
    return places[at[len(of_cls):]]


def _bits(parity: pa.Array | pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """Parity bits of some rows of one band, a line each."""
    return np.frombuffer(
        b"".join(parity.take(pa.array(rows)).to_pylist()), np.uint64
    ).reshape(len(rows), -1)


def _most_apart(band: int, sizes: np.ndarray) -> np.ndarray:
    """Places in which the parity bits of two linked sets may differ, by the sum of their sizes."""
    return np.minimum(most_different(band), sizes * (100 - PERCENT) // (100 + PERCENT))


def _near(parity, sketch_of, left, right, size, band: int):
    """Those of the pairs whose parity bits differ in no more places than linked sets may,
    and in how many."""
    rows, at = np.unique(np.concatenate([sketch_of[left], sketch_of[right]]), return_inverse=True)
    bits = _bits(parity, rows)
    apart = np.zeros(len(left), dtype=np.int64)
    step = max(1, (1 << 20) // bits.shape[1])
    for i in range(0, len(left), step):
        a, b = at[i:i + step][:len(left) - i], at[len(left) + i:len(left) + i + step]
        apart[i:i + step] = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
    keep = apart <= _most_apart(band, size[left] + size[right])
    return left[keep], right[keep], apart[keep]


def similar_groups(docs: DataFrame) -> DataFrame:
    """``(did, rid, n_shingles, component, keeper)`` of every distinct ``(did, rid)``.

    ``component`` is the smallest ``did`` reachable by links; ``keeper`` marks the one
    document of each component with the smallest ``(did, rid)``.
    """
    known = materialize(members(docs).distinct(), "members")
    filled = known.filter(F.col("class").isNotNull())
    one = F.min(F.struct("did", "rid"))
    first_of = materialize(
        filled.groupBy("class").agg(
            one.alias("first"), F.first("n_shingles").alias("n_shingles"),
            F.first("reserves").alias("reserves"),
        ).select("class", "first.did", "first.rid", "n_shingles", "reserves"), "classes"
    )
    edges = F.array(*[F.lit(int(x)) for x in _BANDS[1:]])
    own = F.size(F.filter(edges, lambda x: x <= F.col("n_shingles")))
    needs = materialize(first_of.select(
        "class", own.alias("own"), F.posexplode("reserves").alias("below", "reserve")
    ).select("class", (F.col("own") - F.col("below")).alias("band"), "reserve"), "needs")
    ids = first_of.select("class", "did", "rid")
    raw = materialize(shared_blocks(docs), "shared-blocks")
    blocks = _needed_blocks(raw, needs)
    release(raw)
    hubs = blocks.filter("class <> hub").groupBy("class", "hub").agg(F.count("*").alias("n"))
    best = materialize(
        hubs.groupBy("class").agg(F.max(F.struct(F.col("n"), (-F.col("hub")).alias("hub"))).alias("best"))
        .select(F.col("class").alias("a"), (-F.col("best.hub")).alias("b")), "best-hubs"
    )
    links = _verified(docs, ids, best, "near")
    labels = components(links)
    opened = _open_blocks(blocks, labels, needs)
    used = materialize(ids.join(opened.select("class").distinct(), "class"), "open-wanted")
    sketches = materialize(_sketches(_texts_of(docs, used)), "open-sketches")
    release(best, used)
    nearest = True
    while True:
        pairs = materialize(_pairs(opened, sketches, nearest), "open-pairs")
        more = _verified(docs, ids, pairs, "open")
        last, n_pairs, n_links = not nearest, pairs.count(), more.count()
        release(pairs)
        if n_links:
            older, links = (links, labels), materialize(links.union(more), "links")
            labels = components(links)
            release(*older)
        release(more)
        if last:
            break
        nearest = n_links > 0 and n_links * GAIN >= n_pairs
        if n_links:
            release(opened)
            opened = _open_blocks(blocks, labels, needs)
    release(opened, blocks, links, sketches, needs, first_of)
    grouped = known.join(labels, "class", "left").withColumn(
        "group", F.coalesce("label", "class")
    )
    least = grouped.filter(F.col("group").isNotNull()).groupBy("group").agg(one.alias("least"))
    alone = F.struct("did", "rid")
    return grouped.join(least, "group", "left").withColumn("least", F.coalesce("least", alone)).select(
        "did", "rid", "n_shingles", F.col("least.did").alias("component"),
        (F.col("least") == alone).alias("keeper"),
    )


def link_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document."""
    found = similar_groups(docs)
    return C.identified(docs).select("did", "rid").join(found, ["did", "rid"]).select(
        C.given_id().alias("doc_id"), "n_shingles", C.given_id("component").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """All columns of the rows of ``docs`` that stand for their group; repeated rows once."""
    keepers = similar_groups(docs).filter("keeper").select("did", "rid")
    kept = C.packed(docs).join(keepers, ["did", "rid"]).dropDuplicates(["did", "rid"])
    return kept.select(*[F.col("row").getField(name).alias(name) for name in docs.columns])
