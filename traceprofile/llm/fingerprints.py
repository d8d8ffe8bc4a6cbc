"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its words, weighted by occurrences times code points.
For sample ``k`` each term draws, from its hash alone, ``r`` and ``c`` of the Gamma(2, 1)
distribution and a uniform ``b``; with ``t = floor(ln w / r + b)`` and
``ln a = ln c - r (t - b) - r`` the sample is the pair (term, t) of smallest ``a``. Two
texts agree in a sample with a probability equal to their generalised Jaccard similarity
``sum(min(w, v)) / sum(max(w, v))``.

The draws come from one 64-bit hash per term and sample: two fields of it index a table of
Gamma(2, 1) quantiles, a third is ``b``. ``ln a`` and the identity of (term, t) share a
64-bit integer, so that a fingerprint is :data:`SAMPLES` integer minima, computed inside
generated code over the exploded terms. Terms of one text are in one task and are never
shuffled: the texts are partitioned by document before.

Defined results: a NULL or blank text has no terms and the empty fingerprint, which is
like itself (1) and unlike any other (0). Equal texts have equal fingerprints. Words are
taken as they are, case included.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceprofile.llm import common as C
from traceprofile.session import materialize

SAMPLES = 64
#: Quantiles in the table of Gamma(2, 1).
QUANTILES = 1024
#: ``ln a`` is kept in steps of 2^-24 above this lower bound.
_LOWEST, _STEPS = -64.0, float(2**24)
_DIGITS = 4


def gamma_quantiles(n: int = QUANTILES) -> np.ndarray:
    """Middle quantiles of Gamma(2, 1): the roots of ``1 - (1 + x) exp(-x) = (i + 1/2) / n``."""
    want = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 64.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < want
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def weighted_terms(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``term`` and ``ln_weight`` of each distinct word: its hash, its log weight.

    Words are sorted, so that occurrences of one word stand together; where a run starts
    is known from the word before. A text without words keeps one row without a term.
    """
    word, starts = F.col("word"), F.col("starts")
    first = F.transform(
        word, lambda w, i: F.when((i > 0) & (F.get(word, i - 1) == w), -1).otherwise(i)
    )
    runs = texts.select(*keys, F.sort_array(C.words(F.col("text"))).alias("word")).select(
        *keys, "word", F.filter(first, lambda s: s >= 0).alias("starts")
    )
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(word)))
    terms = F.zip_with(starts, ends, lambda s, e: F.struct(
        F.xxhash64(word[s]).alias("term"),
        F.ln((e - s) * F.length(word[s]).cast("double")).alias("ln_weight"),
    ))
    return runs.select(
        *keys, F.inline_outer(F.filter(terms, lambda t: t["term"].isNotNull()))
    )


def _sample(k: int, quantile: Column, log_quantile: Column) -> Column:
    """``ln a`` (upper bits) and identity (lower 31 bits) of one term in sample ``k``."""
    drawn = F.xxhash64("term", F.lit(k))
    field = lambda at, bits: F.shiftrightunsigned(drawn, at).bitwiseAND(F.lit(2**bits - 1))
    bits = int(math.log2(QUANTILES))
    r = quantile[field(0, bits).cast("int")]
    ln_c = log_quantile[field(bits, bits).cast("int")]
    b = field(2 * bits, 13) / F.lit(float(2**13))
    t = F.floor(F.col("ln_weight") / r + b)
    ln_a = ln_c - r * (t - b) - r
    rank = ((ln_a - F.lit(_LOWEST)) * F.lit(_STEPS)).cast("long")
    identity = (field(33, 31) + t * F.lit(0x61C88647)).bitwiseAND(F.lit(2**31 - 1))
    return F.shiftleft(rank, 31).bitwiseOR(identity)


def fingerprints(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``fingerprint`` of the ``text`` of every row; equal keys, equal text.

    The rows should be partitioned by a part of the keys already: then nothing moves.
    """
    table = gamma_quantiles()
    one = texts.sparkSession.range(1)
    # the tables are scalar subqueries, so that the plan holds them once, not per sample
    terms = weighted_terms(texts, keys).select(
        "*", one.select(F.lit(table)).scalar().alias("quantile"),
        one.select(F.lit(np.log(table))).scalar().alias("log_quantile"),
    )
    quantile, log_quantile = F.col("quantile"), F.col("log_quantile")
    minima = terms.groupBy(*keys).agg(*[
        F.min(F.when(F.col("term").isNotNull(), _sample(k, quantile, log_quantile))).alias(f"m{k}")
        for k in range(samples)
    ])
    digits = [
        F.lpad(F.lower(F.hex(F.col(f"m{k}").bitwiseAND(F.lit(16**_DIGITS - 1)))), _DIGITS, "0")
        for k in range(samples)
    ]
    return minima.select(*keys, F.coalesce(F.concat(*digits), F.lit("")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two fingerprints agree; estimates generalised Jaccard."""
    samples = F.length(a) / _DIGITS
    part = lambda text, i: F.substring(text, i * _DIGITS + 1, F.lit(_DIGITS))
    agreeing = F.size(F.filter(
        F.sequence(F.lit(0), (samples - 1).cast("int")), lambda i: part(a, i) == part(b, i)
    ))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(agreeing / samples)


def in_order(docs: DataFrame) -> DataFrame:
    """``(did, rid, n_chars, copies, next_did, next_rid)``: each document and the next one.

    Ids are range-partitioned; the last of a range is followed by the first of the next
    range, of which there is one row per partition, the only thing broadcast.
    """
    ids = C.identified(docs).groupBy("did", "rid").agg(
        F.first(F.length("text")).alias("n_chars"), F.count("*").alias("copies")
    )
    ids = materialize(
        ids.repartitionByRange("did", "rid").withColumn("part", F.spark_partition_id()), "ordered-ids"
    )
    key = F.struct("did", "rid")
    heads = ids.groupBy("part").agg(F.min(key).alias("head"))
    ranges = Window.partitionBy(F.lit(1)).orderBy("part")
    whole = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(
        F.lead("head").over(ranges), F.first("head").over(whole)
    ).alias("following"))
    following = F.lead(key).over(Window.partitionBy("part").orderBy("did", "rid"))
    return ids.withColumn("next", following).join(F.broadcast(heads), "part").select(
        "did", "rid", "n_chars", "copies",
        F.coalesce("next.did", "following.did").alias("next_did"),
        F.coalesce("next.rid", "following.rid").alias("next_rid"),
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The last quarter of the code points is replaced by the first as many of the next
    document. Documents travel once by their id; of the next one only the part needed.
    """
    chain = materialize(in_order(docs), "document-chain")
    base = C.identified(docs)
    heads = (
        chain.select(F.col("did").alias("to_did"), F.col("rid").alias("to_rid"), "n_chars",
                     F.col("next_did").alias("did"), F.col("next_rid").alias("rid"))
        .join(base, ["did", "rid"])
        .select(F.col("to_did").alias("did"), F.col("to_rid").alias("rid"), "n_chars",
                F.substring("text", F.lit(1), F.floor(F.col("n_chars") / 4).cast("int")).alias("head"))
        .groupBy("did", "rid").agg(F.first("n_chars").alias("n_chars"), F.first("head").alias("head"))
    )
    stays = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    both = base.join(heads, ["did", "rid"]).select(
        "did", "rid", F.explode(F.array(
            F.struct(F.lit(False).alias("edited"), F.col("text")),
            F.struct(F.lit(True).alias("edited"),
                     F.concat(F.substring("text", F.lit(1), stays), "head").alias("text")),
        )).alias("version"),
    ).select("did", "rid", "version.edited", "version.text")
    hashed = both.withColumn(
        "sha256", F.when(F.col("edited"), F.sha2(F.col("text").cast("binary"), 256))
    )
    prints = materialize(fingerprints(hashed, ["did", "rid", "edited", "sha256"]), "fingerprints")
    plain = prints.filter(~F.col("edited"))
    edited = prints.filter("edited").select(
        "did", "rid", "sha256", F.col("fingerprint").alias("edited_fingerprint")
    )
    following = plain.select(F.col("did").alias("next_did"), F.col("rid").alias("next_rid"),
                             F.col("fingerprint").alias("next_fingerprint"))
    return (
        chain.join(plain.select("did", "rid", "fingerprint"), ["did", "rid"])
        .join(edited, ["did", "rid"])
        .join(following, ["next_did", "next_rid"])
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        .select(
            C.given_id().alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"),
            F.col("sha256").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        )
    )
