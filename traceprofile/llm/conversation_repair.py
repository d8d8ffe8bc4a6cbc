"""Audit and repair of the structure of conversations.

A repaired conversation reads, by the initials of its roles, ``(s?(ua)+)?``. Turns may be
kept, given the role that is due, deleted or inserted; :mod:`traceprofile.llm.crossings`
states the costs and finds the cheapest edits by divide and conquer, the ASCII-least of
equally cheap ones. Blank turns and repeats of an earlier turn must go; a truncated turn
that stays costs more.

The work is spread by rows, not by conversations, so one that holds a third of all rows is
no hot key:

1. Turns without their texts are folded (equal ones in each task first), range-partitioned
   and sorted by conversation and place, and numbered. Repeats are found by the smallest
   number of each 128-bit hash of conversation, role and text.
2. Each run of up to ``SEGMENT`` turns of a conversation becomes one cost table of four by
   four states with some counts, a few hundred bytes whatever its length.
3. The tables of a conversation are combined and the states where its segments meet are
   chosen.
4. Between known states every segment finds its edits on its own.
5. Texts meet the edits of their segment in one pass that reads the conversation in order
   and keeps one segment of edits in memory.

Only the last step brings the rows of a conversation into one task, as a stream; a digest
over a whole conversation cannot be computed in any other way.

Defined results: a missing role or text counts as one space, as do a missing conversation
or turn in the damage; missing turn numbers come first, and rows without a conversation
form one. Turns of equal number are ordered by role, then by their first
``HEAD`` characters, then by hash. Repeated rows are repeats of each other. A conversation
without rows has zeros, an empty audit and no repaired turn. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceprofile.llm import crossings as X
from traceprofile.llm.common import SPACE, bound_batches
from traceprofile.session import materialize

#: Turns whose edits are found at once.
SEGMENT = 65_536
#: Characters of a text that order turns of equal number.
HEAD = 32
_ENDING = (".", "!", "?")
#: Pairs of neighbouring initials (numbered as in crossings) that are legal.
_LEGAL = np.zeros((4, 4), dtype=bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
_NO_TURN = np.int64(2**63 - 1)


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _hash(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def identity(column: str = "conv_id") -> Column:
    """128 bits that stand for a conversation, a missing id included."""
    named = F.concat(F.lit("="), F.col(column).cast("string"))
    return _hash(F.coalesce(named, F.lit("")))


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with reproducible faults, chosen by the hash of conversation and turn.

    Of 20 cases 0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats
    it (``copies`` is 2), 4 gives it the role user.
    """
    case = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = _spaced("text")
    return conversations.select("conv_id", "turn", "role", "text", case.alias("case")).filter(
        F.col("case") != 0
    ).select(
        "conv_id", "turn",
        F.when(F.col("case") == 4, "user").otherwise(_spaced("role")).alias("role"),
        F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate(text, ".!?", ""))
        .otherwise(text).alias("text"),
        F.when(F.col("case") == 3, 2).otherwise(1).alias("copies"),
    )


def _described(rows: DataFrame) -> DataFrame:
    """The columns that order and rate a turn, and its text."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    spoken = rows.select(
        identity().alias("cid"), F.col("turn").cast("long").alias("turn"),
        _spaced("role").alias("role"), _spaced("text").alias("text"), copies.cast("long").alias("copies"),
    )
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    return spoken.select(
        "*", F.left("text", F.lit(HEAD)).alias("head"),
        _hash(F.hex("cid"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
        .alias("key"),
        number.cast("byte").alias("initial"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(*_ENDING)).alias("truncated"),
    )


def _place() -> list[Column]:
    return [F.col("cid"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("key")]


def numbered(described: DataFrame) -> DataFrame:
    """Distinct turns without texts, numbered in order by ``at``; staged.

    The numbers of the turns in one part of the table are consecutive.
    """
    own = ["cid", "turn", "role", "head", "key", "initial", "blank", "truncated"]
    folded = described.groupBy(*own).agg(F.sum("copies").alias("copies"))
    ordered = folded.repartitionByRange(*_place()).sortWithinPartitions(*_place())
    return materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")


def with_repeats(turns: DataFrame) -> DataFrame:
    """``turns`` and whether the same role and text occur before, as ``repeated``."""
    firsts = (
        turns.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        .filter(F.col("n") > 1).select("key", "first")
    )
    later = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    return turns.join(firsts, "key", "left").withColumn("repeated", later).drop("first")


_SEGMENTS = (
    "cid binary, at long, turn long, role string, head string, key binary, kinds binary, "
    "copies array<long>, table binary, blank long, duplicate long, truncated long, illegal long, "
    "opens int, closes int, turns long, first_turn long, last_turn long"
)


def segments(turns: DataFrame) -> DataFrame:
    """One row for each run of up to ``SEGMENT`` turns of a conversation; staged."""
    part = F.shiftright("at", 33)
    ordered = turns.withColumn("part", part).repartition("part").sortWithinPartitions("at").drop("part")
    return materialize(bound_batches(ordered).mapInArrow(_cut, _SEGMENTS), "segments")


def _changes(table: pa.Table, *columns: str) -> np.ndarray:
    """Whether a row differs from the one before in any of the columns; the first one does."""
    new = np.ones(table.num_rows, dtype=bool)
    new[1:] = False
    for name in columns:
        column = table.column(name)
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return new


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        at = table.column("at").to_numpy()
        new = _changes(table, "cid")
        new[1:] |= at[1:] != at[:-1] + 1
        group = np.flatnonzero(new)
        within = np.arange(len(at)) - np.repeat(group, np.diff(np.append(group, len(at))))
        first = np.flatnonzero(within % SEGMENT == 0)
        held = table.slice(first[-1]).to_batches()[0]
        if len(first) > 1:
            yield _described_segments(table, first)
    if held is not None:
        yield _described_segments(pa.Table.from_batches([held]), np.array([0, held.num_rows]))


def _units(kinds: np.ndarray, copies: np.ndarray) -> X.Tables:
    """Tables of turns with all their copies, which must go."""
    units = X.turns(kinds)
    return X.Tables(units.cost + (X.DELETE * (copies - 1))[:, None, None], units.order)


def _described_segments(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
    """The segments between the places ``first``."""
    begin, stop = first[:-1], int(first[-1])

    def values(name: str) -> np.ndarray:
        return table.column(name).slice(0, stop).to_numpy(zero_copy_only=False)

    def total(number: np.ndarray) -> pa.Array:
        return pa.array(np.add.reduceat(number.astype(np.int64), begin))

    initial, copies = values("initial").astype(np.int64), values("copies")
    blank, repeated = values("blank").astype(bool), values("repeated").astype(bool)
    gone = blank | repeated
    truncated = values("truncated").astype(bool) & ~gone
    kinds = np.where(gone, X.MUST_GO, 2 * initial + truncated)
    whole = X.Stretches(_units(kinds, copies), first).whole
    known = table.column("turn").slice(0, stop).is_valid().to_numpy()
    turn = table.column("turn").slice(0, stop).fill_null(int(_NO_TURN)).to_numpy()
    opening = np.zeros(stop, dtype=bool)
    opening[begin] = True
    distinct = known.copy()
    distinct[1:] &= opening[1:] | ~known[:-1] | (turn[1:] != turn[:-1])
    illegal = copies - 1
    illegal[1:] += ~opening[1:] & ~_LEGAL[initial[:-1], initial[1:]]
    ending = first[1:] - 1
    bytes_of = kinds.astype(np.int8).tobytes()
    repeats = [
        copies[a:b].tolist() if copies[a:b].max() > 1 else [] for a, b in zip(begin, first[1:])
    ]
    at_begin = pa.array(begin)
    return pa.RecordBatch.from_arrays([
        *[table.column(name).combine_chunks().take(at_begin) for name in
          ("cid", "at", "turn", "role", "head", "key")],
        pa.array([bytes_of[a:b] for a, b in zip(begin, first[1:])], pa.binary()),
        pa.array(repeats, pa.list_(pa.int64())), _packed(whole),
        total(np.where(blank, copies, 0)), total(np.where(blank, 0, copies - 1 + repeated)),
        total(truncated), total(illegal),
        pa.array(initial[begin], pa.int32()), pa.array(initial[ending], pa.int32()), total(distinct),
        table.column("turn").combine_chunks().take(pa.array(_first_known(known, begin, ending))),
        table.column("turn").combine_chunks().take(pa.array(ending)),
    ], names=[field.split()[0] for field in _SEGMENTS.split(", ")])


def _first_known(known: np.ndarray, begin: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """Place of the first turn with a number; missing numbers come first."""
    missing = np.add.reduceat((~known).astype(np.int64), begin)
    return np.minimum(begin + missing, ending)


def _packed(tables: X.Tables) -> pa.Array:
    cost, order = tables.cost.reshape(-1, 16), tables.order.reshape(-1, 16).astype(np.int8)
    return pa.array([c.tobytes() + o.tobytes() for c, o in zip(cost, order)], pa.binary())


def _unpacked(column: pa.Array) -> X.Tables:
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 144)
    cost = np.ascontiguousarray(rows[:, :128]).view(np.int64).reshape(-1, 4, 4)
    order = np.ascontiguousarray(rows[:, 128:]).view(np.int8).reshape(-1, 4, 4).astype(np.int64)
    return X.Tables(cost, order)


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_SOLVED = f"cid binary, at long, before int, after int, last boolean, {_COUNTS}"


def solved(found: DataFrame) -> DataFrame:
    """States at both ends of every segment; the first of a conversation has its counts. Staged."""
    narrow = found.drop("role", "head", "key", "kinds", "copies", "turn")
    ordered = narrow.repartition("cid").sortWithinPartitions("cid", "at")
    return materialize(bound_batches(ordered).mapInArrow(_solve, _SOLVED), "solved")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        first = np.flatnonzero(_changes(table, "cid"))
        held = table.slice(first[-1]).to_batches()[0]
        if len(first) > 1:
            yield _solved_conversations(table, first)
    if held is not None:
        yield _solved_conversations(pa.Table.from_batches([held]), np.array([0, held.num_rows]))


def _solved_conversations(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
    begin, stop = first[:-1], int(first[-1])

    def values(name: str) -> np.ndarray:
        return table.column(name).slice(0, stop).to_numpy()

    def turn(name: str) -> np.ndarray:
        return table.column(name).slice(0, stop).fill_null(int(_NO_TURN)).to_numpy()

    stretches = X.Stretches(_unpacked(table.column("table").slice(0, stop)), first)
    last, cost = X.ends(stretches.whole)
    before, after = stretches.states(np.zeros(len(begin), dtype=np.int64), last)
    opening = np.zeros(stop, dtype=bool)
    opening[begin] = True
    closing = np.append(opening[1:], True)
    opens, closes = values("opens"), values("closes")
    low, high = turn("first_turn"), turn("last_turn")
    illegal, turns = values("illegal").copy(), values("turns").copy()
    illegal[1:] += ~opening[1:] & ~_LEGAL[closes[:-1], opens[1:]]
    turns[1:] -= ~opening[1:] & (high[:-1] != _NO_TURN) & (low[1:] == high[:-1])
    least = np.minimum.reduceat(low, begin)
    most = high[first[1:] - 1]  # numbers ascend, missing ones come first
    gaps = np.where(most == _NO_TURN, 0, most - least + 1 - np.add.reduceat(turns, begin))

    def counted(total: np.ndarray) -> pa.Array:
        spread = np.zeros(stop, dtype=np.int64)
        spread[begin] = total
        return pa.array(spread, mask=~opening)

    return pa.RecordBatch.from_arrays([
        table.column("cid").slice(0, stop).combine_chunks(), table.column("at").slice(0, stop).combine_chunks(),
        pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(closing), counted(gaps),
        *[counted(np.add.reduceat(values(name), begin)) for name in ("blank", "duplicate", "truncated")],
        counted(np.add.reduceat(illegal, begin)), counted(cost),
    ], names=[field.split()[0] for field in _SOLVED.split(", ")])


_EDITS = "cid binary, at long, turn long, role string, head string, key binary, edits string"


def segment_edits(found: DataFrame, states: DataFrame) -> DataFrame:
    """The edits of every segment, with the place of its first turn; staged."""
    known = found.select("cid", "at", "turn", "role", "head", "key", "kinds", "copies").join(
        states.select("at", "before", "after", "last"), "at"
    )
    return materialize(bound_batches(known).mapInArrow(_edit, _EDITS), "edits")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("kinds").to_pylist()
        first = np.cumsum([0] + [len(kinds) for kinds in own])
        kinds = np.frombuffer(b"".join(own), dtype=np.int8).astype(np.int64)
        copies = np.ones(len(kinds), dtype=np.int64)
        for begin, repeats in zip(first, batch.column("copies").to_pylist()):
            copies[begin:begin + len(repeats)] = repeats
        after = batch.column("after").to_numpy().astype(np.int64)
        a, b = X.Stretches(_units(kinds, copies), first).states(
            batch.column("before").to_numpy().astype(np.int64), after
        )
        edits = [
            X.EDITS[kind][x][y] + "D" * (n - 1)
            for kind, x, y, n in zip(kinds.tolist(), a.tolist(), b.tolist(), copies.tolist())
        ]
        ending = [X.END_EDITS[s] if last else "" for s, last in
                  zip(after.tolist(), batch.column("last").to_pylist())]
        joined = ["".join(edits[x:y]) + end for x, y, end in zip(first[:-1], first[1:], ending)]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(name) for name in ("cid", "at", "turn", "role", "head", "key")],
             pa.array(joined, pa.string())],
            names=[field.split()[0] for field in _EDITS.split(", ")],
        )


_REPAIRED = "cid binary, place long, role string, text string, edit string"
_ROWS = 4096


def repaired_turns(described: DataFrame, edits: DataFrame) -> DataFrame:
    """``cid``, ``place``, ``role``, ``text`` and ``edit`` of every turn after the repair.

    All turns of a conversation follow each other, in order, in one partition.
    """
    spoken = described.select(
        "cid", "turn", "role", "head", "key", F.lit(1).alias("kind"), "copies", "text"
    )
    planned = edits.select(
        "cid", "turn", "role", "head", "key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("copies"),
        F.col("edits").alias("text"),
    )
    ordered = spoken.unionByName(planned).repartition("cid").sortWithinPartitions(*_place(), "kind")
    read = ordered.select("cid", "role", "kind", "copies", "text")
    return bound_batches(read).mapInArrow(_replay, _REPAIRED)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    cid, edits, read, place, state = None, "", 0, 0, X.START

    def emit(role: str, text: str, edit: str) -> None:
        nonlocal place, state
        place += 1
        state = X.INITIALS.index(role[0]) + 1
        rows.append((cid, place, role, text, edit))

    def due() -> str:
        return "assistant" if state == X.USER else "user"

    def inserted() -> None:
        nonlocal read
        while read < len(edits) and edits[read] == "I":
            emit(due(), "", "I")
            read += 1

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)],
            names=["cid", "place", "role", "text", "edit"],
        )

    for batch in batches:
        for own, role, kind, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
            if own != cid:
                inserted()
                cid, edits, read, place, state = own, "", 0, 0, X.START
            if kind == 0:
                inserted()
                edits, read = text, 0
                continue
            for _ in range(copies):
                inserted()
                edit = edits[read]
                read += 1
                if edit != "D":
                    emit(role if edit == "K" else due(), text, edit)
            if len(rows) >= _ROWS:
                yield batch_of()
                rows.clear()
        yield batch_of()
        rows.clear()
    inserted()
    yield batch_of()


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """``cid`` and ``repaired_sha256`` of the ``role:text`` lines of repaired conversations.

    Reads :func:`repaired_turns` as it comes, one turn at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, state = None, None
        for batch in batches:
            done = []
            for own, role, text in zip(*(batch.column(n).to_pylist() for n in ("cid", "role", "text"))):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if own != cid:
                    if state is not None:
                        done.append((cid, state.hexdigest()))
                    cid, state = own, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            if done:
                yield _digests(done)
        if state is not None:
            yield _digests([(cid, state.hexdigest())])

    return repaired.mapInArrow(digest, "cid binary, repaired_sha256 string")


def _digests(done: list[tuple]) -> pa.RecordBatch:
    cid, shown = zip(*done)
    return pa.RecordBatch.from_arrays(
        [pa.array(cid, pa.binary()), pa.array(shown, pa.string())], names=["cid", "repaired_sha256"]
    )


class Repair:
    """The analysis of a table of turns ``(conv_id, turn, role, text)``, with optional ``copies``.

    ``counts`` has a row per conversation with rows: ``cid``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``.
    """

    def __init__(self, rows: DataFrame) -> None:
        self.described = _described(rows)
        found = segments(with_repeats(numbered(self.described)))
        states = solved(found)
        self.edits = segment_edits(found, states)
        audit = F.array_sort(F.collect_list(F.struct("at", "edits")))
        audits = self.edits.groupBy("cid").agg(F.array_join(audit["edits"], "").alias("audit"))
        self.counts = (
            states.filter(F.col("gaps").isNotNull()).drop("at", "before", "after", "last")
            .join(audits, "cid")
        )

    def turns(self) -> DataFrame:
        """The repaired conversations, see :func:`repaired_turns`."""
        return repaired_turns(self.described, self.edits)


def repair(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, role, text, edit)`` of all conversations after their repair."""
    ids = conversations.select("conv_id").distinct().withColumn("cid", identity())
    return Repair(conversations).turns().join(ids, "cid").select("conv_id", "place", "role", "text", "edit")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Counts, audit and digest of every conversation, after :func:`damage`."""
    found = Repair(damage(conversations))
    digests = conversation_digests(found.turns())
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256().hexdigest()
    return (
        conversations.select("conv_id").distinct().withColumn("cid", identity())
        .join(found.counts, "cid", "left").join(digests, "cid", "left")
        .select(
            "conv_id", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )
