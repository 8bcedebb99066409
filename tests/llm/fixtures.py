"""Small corpora made by rule, and plain Python versions of what the operators compute."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, words: int, letters: str = "aeilmnorstu") -> str:
    rng = random.Random(seed)
    found = ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(words)]
    return " ".join(w + "." if i % 9 == 8 else w for i, w in enumerate(found))


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, one word, one very long text."""
    return [
        (None, prose(901, 30), "x", "s", None),
        (None, None, None, None, None),
        (5001, None, "x", None, 0),
        (5002, "", "x", "s", 0),
        (5003, " \t\n\n ", "x", "s", 5),
        (5004, "word", "x", "s", 4),
        (5004, "word", "x", "s", 4),
        (5005, "é" * 70_000, "y", "t", 70_000),
        (5006, "long " * 30_000, "y", "t", 150_000),
        (5007, "12 34 !!", None, "", 8),
    ]


def frame(spark, rows):
    return spark.createDataFrame([r if len(r) == 5 else (*r, "x", "s", len(r[1] or "")) for r in rows], SCHEMA)


def word_sets(text: str | None, size: int) -> set[tuple]:
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def components(keys: list, links: list[tuple[int, int]], ids: list) -> list:
    """The smallest id reachable from each place."""
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    best: dict[int, int | None] = {}
    for i in range(len(keys)):
        r = root(i)
        known = [x for x in (best.get(r), ids[i]) if x is not None]
        best[r] = min(known) if known else None
    return [best[root(i)] for i in range(len(keys))]
