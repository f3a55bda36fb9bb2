"""The text rules once more in plain Python, row by row, for comparison with the Columns.

Written from the rules, with Python's own ``split``, ``lower`` and ``re``.
"""

from __future__ import annotations

import re

from respeval.functions import text as tx
from respeval.functions.defects import HEDGES, REFUSALS


def hits(text: str, phrases: tuple[str, ...]) -> int:
    return len(re.findall(r"\b(?:" + "|".join(phrases) + r")\b", text, re.IGNORECASE))


def listed(text: str) -> bool:
    return re.search(r"\d+\)|" + "|".join(tx.LIST_WORDS), text, re.IGNORECASE) is not None


def scores(text: str) -> dict[str, int]:
    n = len(text.split())
    if n == 0:
        return dict.fromkeys(("accuracy", "reasoning", "tone", "completeness"), 1)
    connectors = hits(text, tx.LOGICAL)
    length_points = 2 + sum(n >= floor for floor in (10, 30, 100))
    earned = {
        "accuracy": 3 + (n > 20) + bool(hits(text, tx.ACCURACY_BONUS)),
        "reasoning": 3 + (connectors > 1) - (connectors == 0) + listed(text),
        "tone": 3
        + bool(hits(text, tx.POSITIVE))
        - bool(hits(text, tx.NEGATIVE))
        + bool(hits(text, tx.POLITE)),
        "completeness": min(5, length_points + listed(text)),
    }
    if hits(text, tx.UNCERTAIN):
        earned["accuracy"] = 2
    return earned


def unique_ratio(text: str) -> float | None:
    bare = [w.strip(tx.WORD_PUNCTUATION).lower() for w in text.split()]
    return len(set(bare)) / len(bare) if bare else None


def defects(text: str) -> str:
    by_score = {"reasoning": "D01", "accuracy": "D02", "tone": "D03", "completeness": "D04"}
    found = {code for key, code in by_score.items() if scores(text)[key] <= 2}
    if len(text.split()) > 20 and unique_ratio(text) < 0.5:
        found.add("D05")
    if any(p in text.lower() for p in REFUSALS):
        found.add("D06")
    if any(p in text.lower() for p in HEDGES):
        found.add("D07")
    return ",".join(sorted(found))
