"""Column helpers shared by the corpus operators.

A document is identified by ``did`` (its ``doc_id``; a missing id becomes the smallest
long) and ``rid`` (hash of its text). Rows equal in both are copies of one document and
always get the same answer, rows that share only the id stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a missing document id; such documents sort before all others.
NO_ID = -(2**63)
#: The white space that separates words: space and 0x09-0x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def did(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def rid(column: str = "text") -> Column:
    return F.xxhash64(F.col(column))


def bound_batches(frame: DataFrame, limit: str = "4m") -> DataFrame:
    """``frame``, with Arrow batches of its session bounded by bytes, not only by rows."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)
    return frame


def given_id(column: str = "did") -> Column:
    """The document id as it was given."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Runs of anything but :data:`SPACE`, as an array; empty for a missing text."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACE[1:], " " * (len(SPACE) - 1))
    return F.array_remove(F.split(flat, " "), "")


def identified(docs: DataFrame) -> DataFrame:
    """``did``, ``rid``, ``text`` (never NULL) of every document, other columns left out."""
    return docs.select(did().alias("did"), rid().alias("rid"), whole_text().alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """``did``, ``rid`` and the whole input row as ``row``, so that no name can clash."""
    return docs.select(did().alias("did"), rid().alias("rid"), F.struct("*").alias("row"))


def with_text(frame: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """Unpack ``row`` into its ``columns`` with a new text and its length."""
    def value(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == "text":
            return text.alias(name)
        return F.length(text).cast("long").alias(name) if name == "n_chars" else old.alias(name)

    return frame.select(*[value(name) for name in columns])
