"""Drop lines that many documents share.

Every line gets a 64-bit hash of its key: stripped of white space, A-Z lowered. Hashes are
combined by task, then range-partitioned with the holders of each hash sorted by
descending document, so that the first row met is the holder that keeps its lines and the
running sum tells in how many documents the line occurs. A hash arrives at most
:data:`SALTS` times however often its line occurs; the lines themselves are matched by a
join, which adaptive execution splits. What comes back per document is a bitmap in words
of 64 lines, of which only those with a dropped line are stored; text moves once, to meet
its bitmap.

Defined results: a NULL text is one empty line. A NULL ``doc_id`` is a document below all
others. Rows with the same id count as one holder of a line and all of them keep it when
they hold it last. Keys are compared by hash: among n different keys a wrong match is
expected n^2 / 2^65 times. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceprofile.llm import common as C

MIN_CHARS = 20
MIN_DOCS = 3
#: Partial groups of one line before the sort.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """One hash per line, NULL where the key is shorter than ``min_chars``."""
    def key_hash(line: Column) -> Column:
        key = F.trim(line, F.lit(C.SPACE))
        return F.when(F.length(key) >= min_chars, F.xxhash64(key))

    return F.transform(_lines(C.lower_ascii(text)), key_hash)


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(line, keeper)``: each shared line's hash and the last document that holds it."""
    holders = (
        C.identified(docs)
        .select("did", F.explode(F.array_distinct(line_hashes(F.col("text"), min_chars))).alias("line"))
        .filter(F.col("line").isNotNull())
    )
    partial = holders.groupBy("line", F.pmod(F.xxhash64("did"), F.lit(SALTS)).alias("salt")).agg(
        F.max("did").alias("last"), F.count_distinct("did").alias("n_docs")
    )
    same_line = Window.partitionBy("line")
    return (
        partial.repartitionByRange("line")
        .withColumn("place", F.row_number().over(same_line.orderBy(F.desc("last"))))
        .withColumn("n_docs", F.sum("n_docs").over(same_line))
        .filter((F.col("place") == 1) & (F.col("n_docs") >= min_docs))
        .select("line", F.col("last").alias("keeper"))
    )


def dropped_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(did, rid, dropped)`` of documents that lose lines; ``dropped`` maps the number of
    a word of 64 lines to its bits, words without a dropped line are left out."""
    lines = C.identified(docs).select(
        "did", "rid", F.posexplode(line_hashes(F.col("text"), min_chars)).alias("at", "line")
    ).filter(F.col("line").isNotNull())
    shared = shared_lines(docs, min_chars, min_docs)
    lost = lines.join(shared, "line").filter(F.col("did") != F.col("keeper"))
    word = lost.groupBy("did", "rid", F.expr("at div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("bits")
    )
    return word.groupBy("did", "rid").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "bits")))).alias("dropped")
    )


def _kept(text: Column, dropped: Column) -> Column:
    def stays(_line: Column, at: Column) -> Column:
        bits = F.try_element_at(dropped, F.floor(at / 64).cast("long"))
        return F.coalesce(F.getbit(bits, at % 64) == 0, F.lit(True))

    return F.filter(_lines(text), stays)


def _with_bitmaps(docs: DataFrame, left: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    return left.join(dropped_bitmaps(docs, min_chars, min_docs), ["did", "rid"], "left")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with shared lines dropped from ``text``; ``n_chars`` follows.

    A document that loses nothing is returned unchanged (a NULL text stays NULL).
    """
    joined = _with_bitmaps(docs, C.packed(docs), min_chars, min_docs)
    text = F.col("row").getField("text")
    kept = F.array_join(_kept(text, F.col("dropped")), "\n")
    joined = joined.withColumn("kept", F.when(F.col("dropped").isNull(), text).otherwise(kept))
    return C.with_text(joined, docs.columns, F.col("kept"))


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256, dropped)`` of every document."""
    joined = _with_bitmaps(docs, C.identified(docs), min_chars, min_docs)
    whole = F.col("dropped").isNull()
    kept = _kept(F.col("text"), F.col("dropped"))
    joined = joined.withColumn("kept", F.when(whole, F.col("text")).otherwise(F.array_join(kept, "\n")))
    n_dropped = F.aggregate(
        F.map_values("dropped"), F.lit(0).cast("long"), lambda n, bits: n + F.bit_count(bits)
    )
    return joined.select(
        C.given_id().alias("doc_id"),
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )
