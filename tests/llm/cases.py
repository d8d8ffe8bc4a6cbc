"""Small tables with the awkward rows that every corpus operator must take."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use inside
    "did long, rid long, row string, line string, size long, block int, hits string, class string"
)
SYLLABLES = {
    "xx": "the and ion ing tha ent her for ede ati".split(),
    "yy": "ßen sch ung über ich der zwö lich kei äng".split(),
}


def sentence(rng: random.Random, n: int, lang: str = "xx") -> str:
    pick = SYLLABLES[lang]
    return " ".join("".join(rng.choice(pick) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed: int = 5) -> list[tuple]:
    """Rows of :data:`SCHEMA`: random texts, copies, near copies, shared lines, edge cases."""
    rng = random.Random(seed)
    shared = [sentence(rng, 9) for _ in range(3)]
    passage = sentence(rng, 60)
    long_text = "\n".join(sentence(rng, 40) for _ in range(120))
    texts: list[str | None] = []
    for i in range(24):
        lines = [sentence(rng, rng.randint(3, 30), "yy" if i % 4 == 3 else "xx") for _ in range(4)]
        if i % 3 == 0:
            lines.insert(rng.randrange(4), f"  {shared[i % 2].upper()}\t")
        if i % 5 == 0:
            lines.append(passage)
        texts.append("\n".join(lines))
    for i in range(0, 8, 2):
        texts.append(texts[i])  # exact copies
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))  # near copies
    texts += [None, "", " \t\r\n ", "one", "one two three", "ONE two three", "a\n\n\nb", "é" * 60,
              long_text, long_text + " end", "x" * 300, "the " * 300, "12 34 !!", "\x1c\x1d a\x85b\xa0c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[5][0], "same id, other text"), (None, texts[1]), (None, None)]
    rng.shuffle(rows)
    out = []
    for doc_id, text in rows:
        lang = None if doc_id is None or doc_id % 7 == 0 else "yy" if doc_id % 4 == 3 else "xx"
        source = None if doc_id is None else f"s{doc_id % 3}"
        out.append((doc_id, text, lang, source, 1, -1, -2, "r", "l", -3, -4, "h", "c"))
    return out


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, SCHEMA)


def lowered(text: str | None) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def shingles(text: str | None, n: int = 5) -> set[tuple]:
    words = lowered(text).split()
    return {tuple(words)} if 0 < len(words) < n else {
        tuple(words[i:i + n]) for i in range(len(words) - n + 1)
    }


def components(rows: list[tuple]) -> list[int]:
    """For each ``(key, text)`` the smallest key reachable over links, by comparing all."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least: dict[int, object] = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return [least[root(i)] for i in range(len(rows))]
