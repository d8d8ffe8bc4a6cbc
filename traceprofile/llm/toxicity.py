"""Toxicity of texts by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: lower case, letters of other scripts that look like Latin ones
become those, and digits or signs inside a word become the letters they stand for. The
folded words, each between spaces, run through one automaton that holds the entries of the
lexicon: whole words (``" idiot "``) and beginnings of words (``" idio"``). A word counts
with the weight of the longest entry that it matches. Matches inside an exception phrase
(a harmless word, or a match with one neighbour) count nothing. The sum of the weights over
the number of words, plus ``SMOOTHING`` words so that one match in a short text is not
everything, is mapped to a probability.

Everything is learned from labelled rows, :data:`SAMPLE` of them at most:

* Lexicon: for every word and word beginning the pairs of a text and a distinct word that
  have it, toxic and clean. Entries are those held by ``MIN_SUPPORT`` toxic pairs or more
  whose log odds are ``MIN_WEIGHT`` or more and whose log likelihood ratio, against equal
  rates in both, is ``MIN_RATIO`` or more; the ``ENTRIES`` with the largest ratios are kept,
  which bounds what the driver and the tasks hold.
* Exceptions: phrases of a matched word alone and with either neighbour that ``MIN_CLEAN``
  clean texts or more hold, and toxic ones not more often than all texts are toxic; the
  ``EXCEPTIONS`` most frequent are kept.
* Probability: a monotone step function over a histogram of sums, one bin per
  ``1 / BINS``. For it each of ``FOLDS`` parts is rated by a lexicon learned from the others.

Counting is a map-side aggregation by word, then one by entry, so no word is a hot key. The
labels that teach are bounded, so they are sent to the documents. Texts are read in Arrow
batches where they are, whole, and are not shuffled.

Defined results: a text that is NULL, empty or without words has sum 0 and gets the
probability of texts without a match. Without labelled rows, or with labels of one kind
only, there is no lexicon and every text gets the share of toxic labels (0 without
labels). Documents labelled twice count once per label; labels other than 0 and 1, or
missing ones, and rows without an id do not teach. Repeated rows get equal answers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceprofile.llm.common import bound_batches
from traceprofile.session import materialize

#: Labelled rows that teach, at most: those with the smallest hash of their id.
SAMPLE = 200_000
#: Characters of a word beginning, at least and at most.
MIN_BEGINNING, MAX_BEGINNING = 3, 16
#: Toxic texts, log odds and log likelihood ratio that an entry needs.
MIN_SUPPORT, MIN_WEIGHT, MIN_RATIO = 5, 1.5, 18.0
MIN_CLEAN = 5
#: Entries and exceptions kept at most.
ENTRIES, EXCEPTIONS = 50_000, 20_000
#: Parts of the labelled rows; each is rated by a lexicon learned from the others.
FOLDS = 4
#: Words added to the length of every text.
SMOOTHING = 20
BINS = 400
#: Words that a task counts before it sends its counts on.
_HELD_WORDS = 200_000

# Letters that look like Latin ones (Cyrillic, Greek), digits, signs.
_LOOKALIKES = str.maketrans(
    "абвгеёзкмнорстуухіїјѕԁԛԝһ" "αβεζηικμνορτυχωϲ",
    "abbreezkmhopctyyxiijsdqwh" "abeznikmvoptuxwc",
)
_DIGITS = (("0", "o"), ("1", "i"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("8", "b"))
_SIGNS = str.maketrans("@$!", "asi")
_FULL_WIDTH = str.maketrans({0xFF01 + i: 0x21 + i for i in range(94)})

_GREEK_CYRILLIC = re.compile("[\u0370-\u052f]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WIDE = re.compile("[\uff01-\uff5e]")
_NUMBER = re.compile(r"\d+")
_SIGN = re.compile(r"[@$!]+")
_WORD = re.compile(r"[^\W_]+")


def _beside(found: re.Match) -> tuple[bool, bool]:
    """Whether a letter or digit comes right before a match, and right after it."""
    text, (start, end) = found.string, found.span()
    return start > 0 and text[start - 1].isalnum(), end < len(text) and text[end].isalnum()


def _sign(found: re.Match) -> str:
    return found[0].translate(_SIGNS) if all(_beside(found)) else found[0]


def _number(found: re.Match) -> str:
    return found[0] if any(_beside(found)) else " "


def folded_words(text: str | None) -> list[str]:
    """Folded words of a text; numbers are no words."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if _WIDE.search(text):
            text = text.translate(_FULL_WIDTH).lower()
        if _GREEK_CYRILLIC.search(text):
            text = text.translate(_LOOKALIKES)
    text = _NUMBER.sub(_number, _SIGN.sub(_sign, text))
    for digit, letter in _DIGITS:
        text = text.replace(digit, letter)
    # a capital I, a small l and 1 look alike
    return _WORD.findall(text.replace("l", "i"))


@dataclass
class Lexicon:
    """Entries with weights (a word ends with a space, a beginning does not), and exceptions."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "_automaton": None}

    def matches(self, words: list[str]) -> Iterator[tuple[int, float]]:
        """``(place of the word, weight of its longest entry)`` of matching words."""
        if not self.weights or not words:
            return
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(" " + entry, (len(entry), weight))
            self._automaton.make_automaton()
        begin = np.zeros(len(words), dtype=np.int64)
        begin[1:] = np.cumsum([len(word) + 1 for word in words[:-1]])
        best: dict[int, tuple[int, float]] = {}
        for end, (size, weight) in self._automaton.iter(" " + " ".join(words) + " "):
            start = end - size
            known = best.get(start)
            if known is None or size > known[0]:
                best[start] = (size, weight)
        starts = np.fromiter(best, dtype=np.int64, count=len(best))
        places = np.searchsorted(begin, starts)
        for place, (_, weight) in sorted(zip(places.tolist(), best.values())):
            yield place, weight

    def counted(self, words: list[str]) -> Iterator[tuple[int, float]]:
        """The matches outside exception phrases."""
        for place, weight in self.matches(words):
            if not any(phrase in self.exceptions for phrase in phrases(words, place)):
                yield place, weight

    def density(self, words: list[str], smoothing: int = SMOOTHING) -> float:
        """Sum of the weights over the length of the text."""
        return sum(weight for _, weight in self.counted(words)) / (len(words) + smoothing)


def phrases(words: list[str], place: int) -> list[str]:
    """The word at a place, alone and with each neighbour."""
    found = [words[place]]
    if place:
        found.append(f"{words[place - 1]} {words[place]}")
    if place + 1 < len(words):
        found.append(f"{words[place]} {words[place + 1]}")
    return found


def held_out(column: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text``, ``toxic`` and ``fold`` of at most ``sample`` labelled ids that teach; staged.

    Of documents with equal text and label the one with the smallest id teaches.
    """
    taught = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    )
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"))
    # both are bounded by ``sample``
    once = hashed.join(F.broadcast(taught), "doc_id").groupBy("copy", "toxic").agg(
        F.min("doc_id").alias("doc_id")
    )
    fold = F.pmod("copy", F.lit(FOLDS)).cast("int")
    joined = hashed.join(F.broadcast(once), ["doc_id", "copy"])
    return materialize(joined.select("text", "toxic", fold.alias("fold")), "toxicity-labelled")


def _counts(rows: DataFrame, of_text: Callable[[str | None, int], Iterable[str]]) -> DataFrame:
    """``entry``, ``fold``, ``toxic``, ``clean``: texts of a fold, by label, in which
    ``of_text`` finds an entry.

    Every task sends its counts whenever it holds ``_HELD_WORDS`` of them.
    """

    def flush(held: dict[int, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for fold, (clean, toxic) in held.items():
            entries = list(clean.keys() | toxic.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(entries, pa.string()), pa.array([fold] * len(entries), pa.int32()),
                 pa.array([toxic[e] for e in entries], pa.int64()),
                 pa.array([clean[e] for e in entries], pa.int64())],
                names=["entry", "fold", "toxic", "clean"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for text, toxic, fold in zip(*(column.to_pylist() for column in batch.columns)):
                own = held.setdefault(fold, (Counter(), Counter()))[toxic]
                size -= len(own)
                own.update(set(of_text(text, fold)))
                size += len(own)
                if size > _HELD_WORDS:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    found = bound_batches(rows.select("text", "toxic", "fold")).mapInArrow(
        count, "entry string, fold int, toxic long, clean long"
    )
    return found.groupBy("entry", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _left_out() -> list[tuple[str, Column]]:
    """Which folds teach each lexicon: all but one, by its number, and at last all."""
    fold = F.col("fold")
    return [(str(k), fold != k) for k in range(FOLDS)] + [(str(FOLDS), F.lit(True))]


def _of_words(words: DataFrame) -> DataFrame:
    """The counts of ``words`` for each entry that a word would match: itself and its beginnings."""
    size = F.length("entry")
    lengths = F.sequence(F.lit(MIN_BEGINNING), F.least(size - 1, F.lit(MAX_BEGINNING)))
    begun = F.when(size > MIN_BEGINNING, F.transform(lengths, lambda n: F.left("entry", n)))
    whole = F.array(F.concat("entry", F.lit(" ")))
    own = F.coalesce(F.concat(whole, begun), whole)
    return words.select(F.explode(own).alias("entry"), "fold", "toxic", "clean")


def learn_entries(
    words: DataFrame, min_support: int = MIN_SUPPORT, min_weight: float = MIN_WEIGHT,
    min_ratio: float = MIN_RATIO, entries: int = ENTRIES,
) -> list[dict[str, float]]:
    """Weights of entries by lexicon, from the counts of all words."""
    taught = [
        F.coalesce(F.sum(F.when(used, F.col(label))), F.lit(0)).alias(f"{label}{k}")
        for k, used in _left_out() for label in ("toxic", "clean")
    ]
    total = words.agg(*taught).first()
    # entries of toxic words are few; all others are left out before they are counted
    able = materialize(
        _of_words(words.filter("toxic > 0")).groupBy("entry").agg(F.sum("toxic").alias("n"))
        .filter(F.col("n") >= min_support).select("entry"), "toxicity-entries",
    )
    weight, rated = [], []
    for k, _ in _left_out():
        toxic, clean = F.col(f"toxic{k}"), F.col(f"clean{k}")
        all_toxic, all_clean = total[f"toxic{k}"], total[f"clean{k}"]
        odds = F.log((toxic + 0.5) / (all_toxic + 0.5)) - F.log((clean + 0.5) / (all_clean + 0.5))
        share = all_toxic / max(all_toxic + all_clean, 1)
        ratio = sum(
            F.when(own > 0, own * F.log(own / ((toxic + clean) * part))).otherwise(0.0)
            for own, part in ((toxic, share), (clean, 1 - share)) if 0 < share < 1
        ) + F.lit(0.0)
        able_here = (toxic >= min_support) & (odds >= min_weight) & F.lit(0 < share < 1)
        weight.append(odds.alias(f"weight{k}"))
        rated.append(F.when(able_here, ratio).alias(f"ratio{k}"))
    most = F.array_max(F.array(*[F.col(f"ratio{k}") for k, _ in _left_out()]))
    found = (
        _of_words(words).join(able, "entry", "semi").groupBy("entry").agg(*taught)
        .select("entry", *weight, *rated)
        .filter(most >= min_ratio).orderBy(F.desc(most), "entry").limit(entries).collect()
    )
    return [
        {r["entry"]: r[f"weight{k}"] for r in found if (r[f"ratio{k}"] or 0.0) >= min_ratio}
        for k, _ in _left_out()
    ]


def learn_exceptions(
    rows: DataFrame, lexicons: list[Lexicon], min_clean: int = MIN_CLEAN, exceptions: int = EXCEPTIONS
) -> list[Lexicon]:
    """The lexicons with exceptions, each from the folds that teach it.

    Phrases are those around the matches of the last lexicon, which all folds teach.
    """

    def matched(text: str | None, fold: int) -> Iterable[str]:
        words = folded_words(text)
        for place, _ in lexicons[FOLDS].matches(words):
            yield from phrases(words, place)

    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    toxic, clean = F.col("toxic"), F.col("clean")
    harmless, names = [], []
    for k, used in _left_out():
        t, c = F.sum(F.when(used, toxic)), F.sum(F.when(used, clean))
        harmless.append(((c >= min_clean) & (t <= share * (t + c))).alias(f"harmless{k}"))
        names.append(f"harmless{k}")
    found = (
        _counts(rows, matched).groupBy("entry").agg(*harmless, F.sum("clean").alias("clean"))
        .filter(" OR ".join(names)).orderBy(F.desc("clean"), "entry").limit(exceptions).collect()
    )
    return [
        Lexicon(lexicon.weights, frozenset(r["entry"] for r in found if r[name]))
        for lexicon, name in zip(lexicons, names)
    ]


@dataclass
class Scorer:
    """A lexicon, and the probability of each step of the density."""

    lexicon: Lexicon
    steps: np.ndarray

    def score(self, text: str | None) -> tuple[float, float, int]:
        """Probability, density and number of matches that count."""
        words = folded_words(text)
        weights = [weight for _, weight in self.lexicon.counted(words)]
        density = sum(weights) / (len(words) + SMOOTHING)
        return float(self.steps[_bin(density)]), density, len(weights)


def _bin(density: float) -> int:
    """Bin 0 is for texts without a match."""
    return 0 if density <= 0 else 1 + min(int(density * BINS), BINS)


def _rising(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Probabilities by bin that never fall: neighbours out of order are put together."""
    share = (toxic.sum() + 0.5) / (toxic.sum() + clean.sum() + 1.0)
    blocks: list[list[float]] = []  # toxic, all, bins
    for t, c in zip(toxic.tolist(), clean.tolist()):
        # a fraction of a row with the common share, so that empty bins have a value
        blocks.append([t + 0.01 * share, t + c + 0.01, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t1, n1, b1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t1, blocks[-1][1] + n1, blocks[-1][2] + b1]
    # Laplace's rule within a block
    return np.concatenate([np.full(b, (t + 0.5) / (n + 1.0)) for t, n, b in blocks])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer from documents that have a label and are not held out."""
    rows = _labelled(docs, labels, sample)
    words = materialize(_counts(rows, lambda text, fold: folded_words(text)), "toxicity-words")
    lexicons = learn_exceptions(rows, [Lexicon(weights) for weights in learn_entries(words)])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BINS + 2), dtype=np.int64)
        for batch in batches:
            for text, toxic, fold in zip(*(column.to_pylist() for column in batch.columns)):
                held[toxic, _bin(lexicons[fold].density(folded_words(text)))] += 1
        place = np.flatnonzero(held.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int32()), pa.array(held[1, place]), pa.array(held[0, place])],
            names=["bin", "toxic", "clean"],
        )

    found = bound_batches(rows.select("text", "toxic", "fold")).mapInArrow(
        bins, "bin int, toxic long, clean long"
    ).groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    toxic, clean = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for row in found:
        toxic[row["bin"]], clean[row["bin"]] = row["toxic"], row["clean"]
    if not lexicons[FOLDS].weights:
        share = toxic.sum() / max(toxic.sum() + clean.sum(), 1)
        return Scorer(lexicons[FOLDS], np.full(BINS + 2, share))
    return Scorer(lexicons[FOLDS], _rising(toxic, clean))


def with_toxicity(docs: DataFrame, scorer: Scorer, carried: list[str]) -> DataFrame:
    """``row``, a struct of the ``carried`` columns, with ``score``, ``density``, ``n_matches``."""
    packed = bound_batches(docs).select(F.struct(*carried).alias("row"), F.col("text").alias("body"))
    row_type = packed.schema["row"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scorer.score(text) for text in batch.column("body").to_pylist()]
            score, density, n = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(score, pa.float64()), pa.array(density, pa.float64()),
                 pa.array(n, pa.int64())], names=["row", "score", "density", "n_matches"],
            )

    return packed.mapInArrow(work, f"row {row_type}, score double, density double, n_matches long")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_matches)`` of every document."""
    found = with_toxicity(docs, learn(docs, labels), ["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "score", "n_matches").select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches",
    )
