"""Documents in blocks, and the exchange of sorted keys between blocks.

A block is a bounded number of whole documents, chosen by hash. Blocks are shuffled once
and the shuffle is reused by every pass of a plan. Between passes only keys travel: each
block cuts its sorted keys at fixed places of the key range, all slices of one place meet
in one task, and what that task finds goes back to the blocks that sent the slices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceprofile.llm import common as C
from traceprofile.llm import hashing as H

#: Bytes of text in a block, about. A longer document is a block of its own at most.
BLOCK_BYTES = 4 << 20
KEYS = "part int, block int, blob binary"


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block, did, rid, text)`` with the text as bytes, never NULL."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    return C.identified(docs).select(
        F.pmod(F.xxhash64("did", "rid"), F.lit(blocks)).cast("int").alias("block"),
        "did", "rid", F.col("text").cast("binary").alias("text"),
    )


def n_parts(spark: SparkSession) -> int:
    """Parts of a key range: a few for each shuffle partition, to keep them small."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def rows_of(block: pa.Table) -> tuple[int, np.ndarray, list[bytes]]:
    """Number, ids and texts of a block, in an order that depends on its content alone."""
    dids = block.column("did").to_numpy()
    order = np.lexsort((block.column("rid").to_numpy(), dids))
    texts = block.column("text").to_pylist()
    number = block.column("block")[0].as_py() if len(dids) else 0
    return number, dids[order], [texts[i] for i in order]


def places(parts: int) -> np.ndarray:
    """First keys of the parts of the key range after the first."""
    return np.array([(i * 2**64) // parts for i in range(1, parts)], dtype=np.uint64)


def sliced(block: int, parts: int, keys: np.ndarray, repeated: np.ndarray) -> pa.Table:
    """Sorted distinct ``keys`` of a block, and whether each repeats within it, as rows."""
    cuts = np.concatenate([[0], np.searchsorted(keys, places(parts)), [len(keys)]])
    full = np.flatnonzero(np.diff(cuts))
    blobs = [H.pack(keys[cuts[i]:cuts[i + 1]], repeated[cuts[i]:cuts[i + 1]]) for i in full]
    return key_rows(full, block, blobs)


def key_rows(part: np.ndarray, block: int | np.ndarray, blobs: list[bytes]) -> pa.Table:
    blocks = np.broadcast_to(np.asarray(block, dtype=np.int32), len(blobs))
    return pa.table({
        "part": pa.array(np.asarray(part, dtype=np.int32)), "block": pa.array(blocks),
        "blob": pa.array(blobs, pa.binary()),
    })


def _repeated(slices: pa.Table) -> pa.Table:
    """Of each slice, the keys that repeat in any block or stand in several blocks."""
    columns = [H.unpack(blob) for blob in slices.column("blob").to_pylist()]
    keys = np.concatenate([c[0] for c in columns])
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    found = count > 1
    found[at[np.concatenate([c[1] for c in columns])]] = True
    keep = np.split(found[at], np.cumsum([len(c[0]) for c in columns])[:-1])
    blobs = [H.pack(c[0][k]) for c, k in zip(columns, keep)]
    return key_rows(slices.column("part").to_numpy(), slices.column("block").to_numpy(), blobs)


def repeated_keys(slices: DataFrame) -> DataFrame:
    """The keys of :func:`sliced` rows that occur at more than one place, by block."""
    return slices.groupBy("part").applyInArrow(_repeated, KEYS)


def merged(rows: pa.Table) -> np.ndarray:
    """All keys sent to one block, sorted."""
    found = [H.unpack(blob)[0] for blob in rows.column("blob").to_pylist()]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def per_block(
    blocks: DataFrame, received: DataFrame | None,
    work: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str,
) -> DataFrame:
    """Run ``work(texts, received rows)`` once per block that has documents."""
    if received is None:
        return blocks.groupBy("block").applyInArrow(lambda table: work(table, None), schema)
    empty = _empty(schema)

    def both(table: pa.Table, rows: pa.Table) -> pa.Table:
        return work(table, rows) if table.num_rows else empty

    return blocks.groupBy("block").cogroup(received.groupBy("block")).applyInArrow(both, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in fields})


def text_runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """``(number of the first text, texts)`` in runs that keep working arrays small."""
    for first, end in H.chunks(texts):
        yield first, texts[first:end]
