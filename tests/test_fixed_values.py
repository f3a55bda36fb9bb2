"""The fixed values once more, written out: a typo in the package would pass both Spark and the SQL made from it."""

from __future__ import annotations

from respeval.functions import cost, defects, scores, text
from respeval.operators import regression, reports, running

# Marker phrases of the heuristics and the defects, prices, weights, grades, thresholds.
LOGICAL = (
    "because therefore thus hence consequently|as a result|due to|since so furthermore moreover specifically "
    "nevertheless however alternatively"
)
POSITIVE = "understand help|let me|i can|happy to|certainly|of course|delighted pleasure assist welcome"
NEGATIVE = "obviously|you should have|just simply|clearly you|wrong"
POLITE = "please|thank you|appreciate"
UNCERTAIN = "i don't know|i'm not sure|unclear|uncertain"
ACCURACY_BONUS = "because therefore specifically exactly precisely|in fact|evidently documented"
REFUSALS = (
    "as an ai model|as a large language model|i cannot fulfill|i am unable to provide|against my safety guidelines|"
    "my programming does not allow"
)
HEDGES = "to the best of my knowledge|as far as i know|if i remember correctly|i believe that|it is possible that"


def listed(phrases: str, whole: bool = False) -> list[str]:
    """Phrases between bars; words of a part that is no phrase of several words stand alone."""
    several = {"as a result", "due to", "let me", "i can", "happy to", "of course", "you should have", "clearly you"}
    several |= {"thank you", "in fact"}
    out = []
    for part in phrases.split("|"):
        out += [part] if whole or part in several or "'" in part else part.split()
    return sorted(out)


def test_phrases():
    for name in ("LOGICAL", "POSITIVE", "NEGATIVE", "POLITE", "UNCERTAIN", "ACCURACY_BONUS"):
        assert sorted(getattr(text, name)) == listed(globals()[name]), name
    assert list(defects.REFUSALS) == REFUSALS.split("|")
    assert list(defects.HEDGES) == HEDGES.split("|")
    assert sorted(text.LIST_WORDS) == sorted(["first", "second", "•", "-"])
    assert sorted(text.WORD_PUNCTUATION) == sorted(".,;:!?()[]{}\"'`")


def test_prices():
    assert cost.PRICES == {
        "gpt-4": (30, 60),
        "gpt-4-turbo-preview": (10, 30),
        "gpt-3.5-turbo": (0.5, 1.5),
        "claude-sonnet-4-6": (3, 15),
        "claude-opus-4-6": (15, 75),
        "claude-haiku-4-5-20251001": (0.8, 4),
    }
    assert cost.DEFAULT_MODEL == "gpt-4" and cost.CHARS_PER_TOKEN == 4


def test_weights_grades_and_thresholds():
    assert scores.DEFAULT_WEIGHTS == {"accuracy": 0.4, "reasoning": 0.3, "tone": 0.15, "completeness": 0.15}
    assert scores.GRADE_FLOORS == (("A", 4.5), ("B", 3.5), ("C", 2.5), ("D", 1.5))
    assert defects.SCORE_DEFECTS == {"accuracy": "D02", "completeness": "D04", "reasoning": "D01", "tone": "D03"}
    assert (defects.LOW_SCORE, defects.MIN_WORDS_FOR_REDUNDANCY, defects.MIN_UNIQUE_RATIO) == (2, 20, 0.5)
    assert (regression.CONFIDENCE, regression.LARGE_EFFECT, regression.FAIL_RISE_POINTS) == (0.95, 0.3, 10)
    assert regression.MIN_SAMPLE == 5
    assert (reports.SUCCESS_ON_ONE, reports.SUCCESS_ON_FIVE, reports.HIGH_VARIANCE) == (0.7, 3.5, 1)
    assert reports.INSIGHT_BANDS == (("excellent", 4.5), ("good", 3.5), ("acceptable", 2.5))
    assert running.WARNING_SHARE == 0.2
