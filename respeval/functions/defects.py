"""Defect codes of a response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from respeval.functions import text as tx
from respeval.functions.scores import TextFeatures

# Defect codes, the dimension behind each score defect, and the marker phrases.
SCORE_DEFECTS = {"reasoning": "D01", "accuracy": "D02", "tone": "D03", "completeness": "D04"}
REFUSALS = (
    "as an ai model",
    "as a large language model",
    "i cannot fulfill",
    "i am unable to provide",
    "against my safety guidelines",
    "my programming does not allow",
)
HEDGES = (
    "to the best of my knowledge",
    "as far as i know",
    "if i remember correctly",
    "i believe that",
    "it is possible that",
)
LOW_SCORE = 2.0
MIN_WORDS_FOR_REDUNDANCY = 20
MIN_UNIQUE_RATIO = 0.5


def defect_codes(f: TextFeatures, scores: dict[str, Column]) -> Column:
    """Sorted array of codes; ``scores`` maps a dimension to its 0-5 score, null counting as 5."""
    codes = [
        F.when(F.coalesce(scores[dimension], F.lit(5.0)) <= LOW_SCORE, code)
        for dimension, code in SCORE_DEFECTS.items()
        if dimension in scores
    ]
    repetitive = (f.n_words > MIN_WORDS_FOR_REDUNDANCY) & (
        f.unique_word_ratio < MIN_UNIQUE_RATIO
    )
    codes.append(F.when(repetitive, "D05"))
    codes.append(F.when(tx.contains_any(f.lowered, REFUSALS), "D06"))
    codes.append(F.when(tx.contains_any(f.lowered, HEDGES), "D07"))
    # The codes are built in their sorted order, each at most once.
    return F.array_remove(F.array(*[F.coalesce(c, F.lit("")) for c in codes]), "")
