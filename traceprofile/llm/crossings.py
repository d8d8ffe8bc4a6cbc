"""Cheapest edits of a row of turns by divide and conquer, many conversations at once.

The roles of a whole conversation read ``(s?(ua)+)?``. That is an automaton of four states:
at the start, after the system turn, after a user turn, after an assistant turn. One turn
takes it from a state to another by one of the edits

    ``K`` keep, ``R`` give it the role that is due, ``D`` delete, ``I`` insert a turn before,

and every stretch of turns has a table of 4 x 4 costs from state to state. A row of the
left half's table is the forward cost vector, a column of the right half's the backward
one; they meet in the middle of the stretch. Tables are combined in pairs until one is
left for each conversation. Then the crossing of each middle is chosen from the known
states at both ends, and both halves follow, down to single turns, whose edits are in a
fixed table. Space is linear in the turns, and a level is one numpy pass over all
conversations of a batch.

Of equally cheap edits the ASCII-least string counts. Edits of a stretch hold one of
``KRD`` per turn and end with it, so of two different strings none begins the other, and
equal strings end in the same state. So where crossings tie, the left string decides, and
a table only has to know the order of its four least strings from each state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STATES = 4
START, SYSTEM, USER, ASSISTANT = range(STATES)
INITIALS = "sua"
#: Classes of turns: initial (s, u, a, other) times two, one more if truncated; or to delete.
MUST_GO = 2 * (len(INITIALS) + 1)
CLASSES = MUST_GO + 1

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_NEVER = np.int64(1) << 50
#: State after a turn of the role that is due.
_DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Cost and edits that lead from a state to an end.
ENDS = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
END_EDITS = ("", "II", "I", "")


@dataclass
class Tables:
    """For each stretch ``cost[a, b]`` and the place of its edits among all ``b`` of ``a``."""

    cost: np.ndarray
    order: np.ndarray

    def at(self, rows: np.ndarray) -> Tables:
        return Tables(self.cost[rows], self.order[rows])


def _turn(kind: int) -> list[list[tuple[int, str]]]:
    """Cost and edits of one turn of a class, by the states before and after."""
    found = [[(int(_NEVER), "")] * STATES for _ in range(STATES)]

    def offer(a: int, b: int, cost: int, edits: str) -> None:
        found[a][b] = min(found[a][b], (cost, edits))

    for a in range(STATES):
        state = a
        for inserted in range(STATES):
            cost, edits = INSERT * inserted, "I" * inserted
            offer(a, state, cost + DELETE, edits + "D")
            if kind != MUST_GO:
                cost += TRUNCATED * (kind % 2)
                offer(a, _DUE[state], cost + REROLE, edits + "R")
                initial = kind // 2
                due = state == START if initial == 0 else _DUE[state] == initial + 1
                if initial < len(INITIALS) and due:
                    offer(a, initial + 1, cost + KEEP, edits + "K")
            state = _DUE[state]
    return found


_TURNS = [_turn(kind) for kind in range(CLASSES)]
#: Edits of a turn by class, state before and state after.
EDITS = [[[edits for _, edits in row] for row in table] for table in _TURNS]
_COST = np.array([[[cost for cost, _ in row] for row in table] for table in _TURNS], dtype=np.int64)
_ORDER = np.array([
    [[sorted(row, key=lambda e: (e[0] >= _NEVER, e[1])).index(entry) for entry in row] for row in table]
    for table in _TURNS
], dtype=np.int64)


def turns(kinds: np.ndarray) -> Tables:
    """Tables of single turns, given their classes."""
    return Tables(_COST[kinds], _ORDER[kinds])


def _through(left: Tables, right: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Least cost from ``a`` to ``b`` over the middle, and the crossing: ``[n, a, b]``."""
    cost = left.cost[:, :, :, None] + right.cost[:, None, :, :]
    least = cost.min(axis=2)
    tied = np.where(cost == least[:, :, None, :], left.order[:, :, :, None], STATES)
    return least, tied.argmin(axis=2)


def join(left: Tables, right: Tables) -> Tables:
    """Tables of stretches that follow each other."""
    cost, crossing = _through(left, right)
    n, a, b = np.indices(cost.shape, sparse=True)
    key = left.order[n, a, crossing] * STATES + right.order[n, crossing, b]
    key = np.where(cost >= _NEVER, STATES * STATES, key)
    order = np.argsort(np.argsort(key, axis=2, kind="stable"), axis=2, kind="stable")
    return Tables(np.minimum(cost, _NEVER), order)


class Stretches:
    """Rows of ``units``, each row from one place of ``first`` to the next; none is empty."""

    def __init__(self, units: Tables, first: np.ndarray) -> None:
        size = np.diff(first)
        self.levels = [units]
        self.lefts: list[tuple[np.ndarray, np.ndarray]] = []
        while size.max(initial=0) > 1:
            begin = np.cumsum(size) - size
            within = np.arange(size.sum()) - np.repeat(begin, size)
            left = np.flatnonzero(within % 2 == 0)
            paired = np.repeat(size, size)[left] > within[left] + 1
            old = self.levels[-1]
            new = old.at(left)
            both = join(old.at(left[paired]), old.at(left[paired] + 1))
            new.cost[paired], new.order[paired] = both.cost, both.order
            self.levels.append(new)
            self.lefts.append((left, paired))
            size = (size + 1) // 2

    @property
    def whole(self) -> Tables:
        """One table per row."""
        return self.levels[-1]

    def states(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States before and after every unit, given those of whole rows."""
        for units, (left, paired) in zip(reversed(self.levels[:-1]), reversed(self.lefts)):
            a, b = np.empty(len(units.cost), dtype=np.int64), np.empty(len(units.cost), dtype=np.int64)
            a[left], b[left] = before, after
            first = left[paired]
            middle = _through(units.at(first), units.at(first + 1))[1][
                np.arange(len(first)), before[paired], after[paired]
            ]
            a[first + 1], b[first + 1] = middle, after[paired]
            b[first] = middle
            before, after = a, b
        return before, after


def ends(whole: Tables) -> tuple[np.ndarray, np.ndarray]:
    """State after the last turn of whole conversations, and the cost of all their edits."""
    cost = whole.cost[:, START] + ENDS
    least = cost.min(axis=1)
    tied = np.where(cost == least[:, None], whole.order[:, START], STATES)
    return tied.argmin(axis=1), least
