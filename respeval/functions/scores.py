"""The four response heuristics, grades, and the judge score."""

from __future__ import annotations

from collections.abc import Callable
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.functions import text as tx
from respeval.functions.numbers import ascii_digits, normalize_value, parse_number

# The scored dimensions with their default weights.
DEFAULT_WEIGHTS = {"accuracy": 0.40, "reasoning": 0.30, "tone": 0.15, "completeness": 0.15}
# Lowest score of each grade, on the 0-5 scale.
GRADE_FLOORS = (("A", 4.5), ("B", 3.5), ("C", 2.5), ("D", 1.5))
GRADES = ("A", "B", "C", "D", "F")
# The notes on how a criterion was scored.
NOTE_NO_TEXT = "no response_text"
NOTE_TERMS = "matched %d/%d terms"
NOTE_PRESENT = "entity '%s' present"
NOTE_ABSENT = "entity '%s' absent"
NOTE_LENGTH = "length %d words"
NOTE_HEURISTIC = "using heuristic for rule: %s"
NOTE_JSON = "json key '%s' parsed"
NOTE_NUMBER = "parsed last numeric"
NOTE_NO_NUMBER = "no numeric found"
NOTE_UNKNOWN_TYPE = "unsupported criterion type: %s"
NOTE_FAILED = "exception during scoring: %s"
BAD_TERMS = "params['terms'] must be a list"


class TextFeatures:
    """What the heuristics need to know of a response, each a Column.

    ``used`` records which were asked for, so that only those are computed.
    """

    # Built from the text and its lower-case form.
    BUILDERS: ClassVar[dict[str, Callable[[Column, Column], Column]]] = {
        "words": tx.lower_words,
        "found": lambda text, _: tx.markers(text),
        "listed": tx.has_list_marker,
    }

    def __init__(self) -> None:
        self.used: set[str] = set()
        self.own: dict[str, Callable[[Column], Column]] = {}

    def _feature(self, name: str) -> Column:
        self.used.add(name)
        return F.col(f"__{name}")

    @property
    def text(self) -> Column:
        return self._feature("text")

    @property
    def lowered(self) -> Column:
        return self._feature("lowered")

    @property
    def words(self) -> Column:
        """Lower-case words."""
        return self._feature("words")

    @property
    def found(self) -> Column:
        """Marker phrases."""
        return self._feature("found")

    @property
    def listed(self) -> Column:
        return self._feature("listed")

    @property
    def n_words(self) -> Column:
        return F.size(self.words)

    @property
    def blank(self) -> Column:
        return self.n_words == 0

    @property
    def unique_word_ratio(self) -> Column:
        return tx.unique_word_ratio(self.text, self.lowered, self.words)

    def has(self, phrases: tuple[str, ...]) -> Column:
        return tx.has_marker(self.found, phrases)

    def derived(self, name: str, build: Callable[[Column], Column]) -> Column:
        """A feature of one's own: ``build`` of the text, computed once under that name."""
        self.own[name] = build
        return F.col(f"`__own_{name.replace('`', '``')}`")

    def add_to(self, df: DataFrame, text: Column) -> DataFrame:
        """Add the features used so far as columns, so each is computed once.

        They come out of a generator of one row. The optimizer moves no filter through a
        generator; through a projection, a filter on a score would take along a copy of every
        regex behind it.
        """
        base = df.select("*", text.alias("__text"))
        base = base.select("*", F.lower("__text").alias("__lowered"))
        features = [
            build(F.col("__text"), F.col("__lowered")).alias(f"__{name}")
            for name, build in self.BUILDERS.items()
            if name in self.used
        ] + [build(F.col("__text")).alias(f"__own_{name}") for name, build in self.own.items()]
        return base.select("*", F.inline(F.array(F.struct(*features)))) if features else base


def _points(condition: Column) -> Column:
    return condition.cast("int")


def score_accuracy(f: TextFeatures) -> Column:
    earned = 3 + _points(f.n_words > 20) + _points(f.has(tx.ACCURACY_BONUS))
    return F.when(f.blank, 1).when(f.has(tx.UNCERTAIN), 2).otherwise(earned)


def score_reasoning(f: TextFeatures) -> Column:
    connectors = tx.count_markers(f.found, tx.LOGICAL)
    earned = 3 + _points(connectors >= 2) - _points(connectors == 0) + _points(f.listed)
    return F.when(f.blank, 1).otherwise(earned)


def score_tone(f: TextFeatures) -> Column:
    earned = (
        3
        + _points(f.has(tx.POSITIVE))
        - _points(f.has(tx.NEGATIVE))
        + _points(f.has(tx.POLITE))
    )
    return F.when(f.blank, 1).otherwise(earned)


def score_completeness(f: TextFeatures) -> Column:
    by_length = F.when(f.n_words < 10, 2).when(f.n_words < 30, 3).when(f.n_words < 100, 4)
    return F.when(f.blank, 1).otherwise(
        F.least(F.lit(5), by_length.otherwise(5) + _points(f.listed))
    )


HEURISTICS = {
    "accuracy": score_accuracy,
    "reasoning": score_reasoning,
    "tone": score_tone,
    "completeness": score_completeness,
}


def category_score(f: TextFeatures, category: Column) -> Column:
    """The heuristic named by ``category``; 3 for any other name."""
    chosen = F.when(F.lit(False), F.lit(3))
    for name, heuristic in HEURISTICS.items():
        chosen = chosen.when(category == name, heuristic(f))
    return chosen.otherwise(3)


def expected_grade(score: Column) -> Column:
    grade = F.when(score.isNull() | F.isnan(score.cast("double")), "F")
    for name, floor in GRADE_FLOORS:
        grade = grade.when(score >= floor, name)
    return grade.otherwise("F")


# A fenced JSON block, and a number in running text (the sign belongs to the
# decimal form only).
_FENCED_JSON = r"(?si)```(?:json)?[SP]*(\{.*?\})[SP]*```".replace(
    "[SP]", f"[{tx.LATIN_SPACES}{tx.WIDE_SPACES}]"
)
_NUMBER = r"[-+]?\p{Nd}*\.\p{Nd}+|\p{Nd}+"


def fenced_json(text: Column) -> Column:
    block = F.nullif(F.regexp_extract(text, _FENCED_JSON, 1), F.lit(""))
    return F.when(text.contains("```"), block)


def last_number(text: Column) -> Column:
    """The last number written in a text, as a double."""
    found = F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0))
    return parse_number(ascii_digits(F.try_element_at(found, F.lit(-1))))


_END = "end of the judged text"


def json_number(text: Column, key: str) -> Column:
    """The number under ``key`` if the text is one JSON object, else null.

    Booleans and numeric strings count; anything after the object makes the text invalid. The
    parser stops at the end of the first value, so the object is parsed as the first of exactly
    two array elements, of which the second is an end mark that trailing text would displace.
    """
    quoted = key.replace("`", "``")
    framed = F.concat(F.lit("["), text, F.lit(f',{{"{_END}":true}}]'))
    schema = f"array<struct<`{quoted}`: variant, `{_END}`: boolean>>"
    parsed = F.from_json(framed, schema, {"allowSingleQuotes": "false"})
    value = F.try_element_at(parsed, F.lit(1)).getField(key)
    ended = F.try_element_at(parsed, F.lit(2)).getField(_END)
    whole = (F.size(parsed) == 2) & F.coalesce(ended, F.lit(False))
    is_string = F.schema_of_variant(value) == "STRING"
    number = F.when(is_string, parse_number(F.try_variant_get(value, "$", "string"))).otherwise(
        F.try_variant_get(value, "$", "double")
    )
    is_object = tx.strip(text).startswith("{")
    return F.when(is_object, F.when(whole, number))


def judge_score(
    f: TextFeatures,
    json_key: str | None = None,
    min_val: float | None = None,
    max_val: float | None = None,
) -> tuple[Column, Column]:
    """A judge's verdict as (score on 0-1, note): the JSON value if any, else the last number."""
    spoken = f.derived("spoken", last_number)
    score = F.when(spoken.isNotNull(), normalize_value(spoken, min_val, max_val))
    note = F.when(spoken.isNotNull(), NOTE_NUMBER).otherwise(NOTE_NO_NUMBER)
    if json_key:
        keyed = f.derived(
            f"json_{json_key}",
            lambda text: json_number(F.coalesce(fenced_json(text), text), json_key),
        )
        score = F.when(keyed.isNotNull(), normalize_value(keyed, min_val, max_val)).otherwise(score)
        note = F.when(keyed.isNotNull(), NOTE_JSON % json_key).otherwise(note)
    empty = f.text == ""
    return F.when(~empty, score), F.when(empty, NOTE_NO_TEXT).otherwise(note)
