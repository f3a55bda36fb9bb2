"""Awkward documents that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, source string, size string, shard string, row string, h int"

WORDS = "the of and thion erly anst wher ouble inea thory reed stan ly ting es or".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "en", "ly", "x", "tion"]) for _ in range(n))


def awkward(seed: int = 3) -> list[tuple]:
    """Nulls in any column, empty and very long texts, copies, near copies, repeated rows; columns
    whose names clash with ones that operators use."""
    rng = random.Random(seed)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \n\t ", "a", "one two three four", "x" * 50_000, long, base, base, " ".join(near),
        base.upper(), "é日本語\U0001f642 ﬁ\x00   İ", prose(rng, 40), prose(rng, 41), "\n\n", None,
    ]
    rows = [(i, t, rng.choice(["a", "b", None]), "s", None, "r", None) for i, t in enumerate(texts)]
    rows.append(rows[7])
    rows.append((None, base, None, None, None, None, None))
    rows.append((None, prose(rng, 30), "a", None, None, None, 1))
    return rows
