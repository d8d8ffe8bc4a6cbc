"""Language identification by compression.

For each language a dictionary of raw text is kept. A text is compressed with each of them
and belongs to the language whose dictionary makes it smallest. Texts are reduced to lower
case letters first and compressed in pieces of :data:`PIECE_BYTES`, so that a long text
cannot replace the dictionary by its own words; the sizes of all its pieces are added. The
score is what the best dictionary saves against the second best; under
:data:`MIN_MARGIN` the answer is marked as rejected.

Dictionaries are learned from a bounded sample of labelled rows: per language the
``SAMPLE_DOCS`` documents with the smallest hash of their id, ``SAMPLE_CHARS`` characters
of each. That sample is all that reaches the driver; texts are classified in place, in
Arrow batches, without a shuffle.

Defined results: a text that is NULL or has no letter is ``und`` with score 0, rejected.
Without labelled rows every text is ``und``; with one language all others get it with
score 1. Of equal sizes the language with the longest dictionary wins, then the first by
name. Repeated rows get equal answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceprofile.llm.common import bound_batches

UNKNOWN = "und"
SAMPLE_DOCS = 128
SAMPLE_CHARS = 2000
DICTIONARY_BYTES = 64 << 10
PIECE_BYTES = 2048
LEVEL = 12
MIN_MARGIN = 0.004

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalised(text: str) -> bytes:
    """Lower-case words of letters between single spaces; empty if there is no letter.

    Number signs such as ``½`` stay inside words but are no letters.
    """
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {words} ".encode("utf-8", "replace") if any(map(str.isalpha, words)) else b""


def training_rows() -> Column:
    """Rows that are not held out: CRC-32 of the id as text, modulo 4, is not 2."""
    return ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_dictionaries(
    labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Raw dictionaries by language from rows with ``doc_id``, ``text`` and ``lang``.

    The driver receives at most ``sample_docs * sample_chars`` characters per language.
    """
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "start")
    sample = (
        labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", "doc_id", F.substring("text", 1, sample_chars).alias("start"),
                F.xxhash64("doc_id").alias("place"))
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= sample_docs)
        .select("lang", "n", "start")
    )
    found: dict[str, list[bytes]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["n"])):
        found.setdefault(row["lang"], []).append(normalised(row["start"]))
    joined = {lang: b"".join(texts)[:dictionary_bytes] for lang, texts in found.items()}
    return {lang: data for lang, data in joined.items() if data}


class Classifier:
    """Compressors for a set of dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL) -> None:
        order = sorted(dictionaries, key=lambda lang: (-len(dictionaries[lang]), lang))
        self.coders = []
        for lang in order:
            data = zstandard.ZstdCompressionDict(
                dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            data.precompute_compress(level=level)
            self.coders.append((lang, zstandard.ZstdCompressor(
                level=level, dict_data=data, write_content_size=False, write_checksum=False,
                write_dict_id=False,
            ).compress))

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and score."""
        clean = normalised(text) if text else b""
        if not clean or not self.coders:
            return UNKNOWN, 0.0
        pieces = [clean[i:i + PIECE_BYTES] for i in range(0, len(clean), PIECE_BYTES)]
        sizes = [sum(len(code(piece)) for piece in pieces) for _, code in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = sizes[:best] + sizes[best + 1:]
        return self.coders[best][0], 1.0 - sizes[best] / min(others) if others else 1.0


def identify_languages(
    docs: DataFrame, dictionaries: dict[str, bytes], carried: list[str],
    min_margin: float = MIN_MARGIN,
) -> DataFrame:
    """``row``, a struct of the ``carried`` columns, with ``lang_pred``, ``score``, ``rejected``."""
    packed = bound_batches(docs).select(F.struct(*carried).alias("row"), F.col("text").alias("body"))
    row_type = packed.schema["row"].dataType.simpleString()

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            answers = [classifier.classify(text) for text in batch.column("body").to_pylist()]
            scores = [score for _, score in answers]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array([lang for lang, _ in answers], pa.string()),
                pa.array(scores, pa.float64()),
                pa.array([lang == UNKNOWN or score < min_margin for lang, score in answers], pa.bool_()),
            ], names=["row", "lang_pred", "score", "rejected"])

    return packed.mapInArrow(
        classify, f"row {row_type}, lang_pred string, score double, rejected boolean"
    )


def language_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``; the texts are not carried along."""
    dictionaries = learn_dictionaries(docs.filter(training_rows()))
    found = identify_languages(docs, dictionaries, ["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score", "rejected").select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told; learned from the rows' own labels."""
    dictionaries = learn_dictionaries(docs.filter(training_rows()))
    found = identify_languages(docs, dictionaries, docs.columns).filter(~F.col("rejected"))
    return found.select(*[F.col("row").getField(name).alias(name) for name in docs.columns])
