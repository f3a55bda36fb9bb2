"""Rubric scoring and defect tagging of a response table, as one narrow projection."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.functions import scores as notes
from respeval.functions import text as tx
from respeval.functions.defects import SCORE_DEFECTS, defect_codes
from respeval.functions.numbers import normalize_value, number_column
from respeval.functions.scores import (
    DEFAULT_WEIGHTS,
    HEURISTICS,
    TextFeatures,
    category_score,
    judge_score,
)

# A rule or judge yields (raw score or null, note).
Verdict = tuple[Column, Column]


@dataclass(frozen=True)
class Criterion:
    key: str
    weight: float
    type: str = "rule"
    params: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Rubric:
    criteria: tuple[Criterion, ...] = tuple(
        Criterion(key, weight) for key, weight in DEFAULT_WEIGHTS.items()
    )

    def __post_init__(self) -> None:
        if not self.criteria:
            raise ValueError("a rubric needs at least one criterion")
        for c in self.criteria:
            if not math.isfinite(c.weight) or c.weight < 0:
                raise ValueError(f"weight of {c.key!r} must be finite and not negative")
        if not self.total_weight > 0:
            raise ValueError("rubric weights must have a positive sum")
        if abs(self.total_weight - 1.0) > 1e-6:
            warnings.warn(
                f"rubric weights sum to {self.total_weight}, scores are divided by it", stacklevel=3
            )

    @property
    def total_weight(self) -> float:
        return sum(c.weight for c in self.criteria)

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> Rubric:
        """Read ``config["scoring"]["criteria"]``; without criteria, the default rubric."""
        entries = config.get("scoring", {}).get("criteria", {})
        criteria = []
        for key, entry in entries.items():
            if not isinstance(entry, Mapping):
                raise TypeError(f"criterion {key!r} must be a mapping")
            given = entry.get("params") or {}
            if not isinstance(given, Mapping):
                raise TypeError(f"params of criterion {key!r} must be a mapping")
            ends = {"min_val": entry.get("min_score"), "max_val": entry.get("max_score")}
            params = {k: v for k, v in ends.items() if v is not None} | dict(given)
            criteria.append(
                Criterion(
                    key, float(entry.get("weight", 0.0)), str(entry.get("type", "rule")), params
                )
            )
        return cls(tuple(criteria)) if criteria else cls()


def contains_terms(f: TextFeatures, params: Mapping[str, Any]) -> Verdict:
    terms = params.get("terms", [])
    if not isinstance(terms, list):
        raise TypeError(notes.BAD_TERMS)
    needed = max(1, int(params.get("min_match", 1)))
    matched = F.lit(0)
    for term in terms:
        matched = matched + f.lowered.contains(str(term).lower()).cast("int")
    note = F.format_string(notes.NOTE_TERMS, matched, F.lit(len(terms)))
    return (matched >= needed).cast("double"), note


def mentions_entity(f: TextFeatures, params: Mapping[str, Any]) -> Verdict:
    entity = params.get("entity")
    present = f.lowered.contains(str(entity).lower()) if entity else F.lit(False)
    note = F.when(present, notes.NOTE_PRESENT % (entity,)).otherwise(notes.NOTE_ABSENT % (entity,))
    return present.cast("double"), note


def length_within(f: TextFeatures, params: Mapping[str, Any]) -> Verdict:
    longest = int(params.get("max_len", 10000))
    note = F.format_string(notes.NOTE_LENGTH, f.n_words)
    return (f.n_words <= longest).cast("double"), note


RULES: dict[str, Callable[[TextFeatures, Mapping[str, Any]], Verdict]] = {
    "contains_terms": contains_terms,
    "mentions_entity": mentions_entity,
    "length_within": length_within,
}


# Names of rules added by register_rule, whose scores may be on any scale.
EXTRA_RULES: set[str] = set()


def _null_score() -> Column:
    return F.lit(None).cast("double")


def _rule_type(f: TextFeatures, criterion: Criterion) -> Verdict:
    empty = f.text == ""
    name = criterion.params.get("rule")
    heuristic = HEURISTICS.get(criterion.key)
    fallback = heuristic(f) / F.lit(5.0) if heuristic else _null_score()
    if name not in RULES:
        return fallback, F.when(empty, notes.NOTE_NO_TEXT).otherwise(notes.NOTE_HEURISTIC % (name,))
    try:
        raw, note = RULES[name](f, criterion.params)
    except (TypeError, ValueError) as e:
        raw, note = _null_score(), F.lit(notes.NOTE_FAILED % (e,))
    return (
        F.when(empty, fallback).otherwise(raw),
        F.when(empty, notes.NOTE_NO_TEXT).otherwise(note),
    )


def _judge_type(f: TextFeatures, criterion: Criterion) -> Verdict:
    p = criterion.params
    try:
        ends = [None if p.get(k) is None else float(p[k]) for k in ("min_val", "max_val")]
    except (TypeError, ValueError) as e:
        note = F.when(f.text == "", notes.NOTE_NO_TEXT).otherwise(notes.NOTE_FAILED % (e,))
        return _null_score(), note
    return judge_score(f, p.get("json_key"), *ends)


CRITERION_TYPES: dict[str, Callable[[TextFeatures, Criterion], Verdict]] = {
    "rule": _rule_type,
    "judge": _judge_type,
}


def register_rule(
    name: str, build: Callable[[TextFeatures, Mapping[str, Any]], Verdict]
) -> None:
    """Make ``build`` available as ``params["rule"] == name``."""
    RULES[name] = build
    EXTRA_RULES.add(name)


def register_criterion_type(
    name: str, build: Callable[[TextFeatures, Criterion], Verdict]
) -> None:
    CRITERION_TYPES[name] = build


def _verdict(f: TextFeatures, criterion: Criterion) -> Verdict:
    build = CRITERION_TYPES.get(criterion.type)
    if build is None:
        return _null_score(), F.lit(notes.NOTE_UNKNOWN_TYPE % (criterion.type,))
    return build(f, criterion)


def present(df: DataFrame, *names: str) -> list[Column]:
    return [df[n] for n in names if n in df.columns]


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of a table, also those with dots in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def response_text(df: DataFrame) -> Column:
    return tx.first_non_empty(*present(df, "model_response", "response"))


def prompt_text(
    df: DataFrame, order: tuple[str, ...] = ("text", "prompt_text", "prompt")
) -> Column:
    """The first non-empty of the named prompt columns that the table has."""
    return tx.first_non_empty(*present(df, *order))


def prompt_id(df: DataFrame) -> Column:
    candidates = [F.nullif(c.cast("string"), F.lit("")) for c in present(df, "id", "prompt_id")]
    return F.coalesce(*candidates) if candidates else F.lit(None).cast("string")


def score_columns(rubric: Rubric, f: TextFeatures) -> dict[str, Column]:
    """Per criterion ``score_<k>_raw`` and ``score_<k>_notes``."""
    out: dict[str, Column] = {}
    for c in rubric.criteria:
        raw, note = _verdict(f, c)
        out[f"score_{c.key}_raw"] = raw.cast("double")
        out[f"score_{c.key}_notes"] = note
    return out


def _normalized(criterion: Criterion) -> Column:
    raw = F.col(f"__score_{criterion.key}_raw")
    # Built-in rules, heuristics and judges already yield 0-1 or null.
    if criterion.type in ("rule", "judge") and criterion.params.get("rule") not in EXTRA_RULES:
        return F.coalesce(raw, F.lit(0.0))
    return normalize_value(raw)


def _scored(df: DataFrame, rubric: Rubric, defects: bool) -> tuple[DataFrame, dict[str, Column]]:
    """The table with ``__`` helper columns, and the report columns over it by name."""
    f = TextFeatures()
    raws = score_columns(rubric, f)
    codes = None
    if defects:
        keys = [c.key for c in rubric.criteria if c.key in SCORE_DEFECTS]
        codes = defect_codes(f, {key: F.col(f"__norm_{key}") * 5.0 for key in keys})
    response = f.text
    scored = f.add_to(df, response_text(df)).select(
        "*", *[c.alias(f"__{name}") for name, c in raws.items()]
    )
    norms = {c.key: _normalized(c) for c in rubric.criteria}
    scored = scored.select("*", *[n.alias(f"__norm_{key}") for key, n in norms.items()])

    weighted = None
    for c in rubric.criteria:
        part = F.col(f"__norm_{c.key}") * F.lit(float(c.weight))
        weighted = part if weighted is None else weighted + part
    aggregated = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), weighted / F.lit(float(rubric.total_weight)))
    )
    scored = scored.select("*", aggregated.alias("__aggregated"))

    out: dict[str, Column] = {
        "prompt_id": prompt_id(df),
        "prompt_text": prompt_text(df),
        "model": df["model"] if "model" in df.columns else F.lit(None).cast("string"),
        "response": response,
        "aggregated_score": F.col("__aggregated"),
        "overall_score": F.col("__aggregated") * 5.0,
    }
    out |= {name: F.col(f"__{name}") for name in raws}
    for key in norms:
        norm = F.col(f"__norm_{key}")
        out |= {f"score_{key}": norm, key: norm * 5.0, f"{key}_score": norm * 5.0}
    if codes is not None:
        out["defects"] = F.array_join(codes, ",")
    return scored, out


def score_table(df: DataFrame, rubric: Rubric | None = None, defects: bool = True) -> DataFrame:
    """One report row per response: ids, texts, all scores and, if asked for, the defects."""
    scored, out = _scored(df, rubric or Rubric(), defects)
    return scored.select(*[c.alias(name) for name, c in out.items()])


def score_responses(df: DataFrame, rubric: Rubric | None = None, defects: bool = True) -> DataFrame:
    """The input plus every report column it does not have yet, in name order. No shuffle."""
    scored, out = _scored(df, rubric or Rubric(), defects)
    new = sorted(name for name in out if name not in df.columns)
    return scored.select(*columns_of(df), *[out[name].alias(name) for name in new])


def with_category_score(df: DataFrame, category: str = "category") -> DataFrame:
    f = TextFeatures()
    chosen = category_score(f, F.col(category)).cast("int")
    return f.add_to(df, response_text(df)).select(*df.columns, chosen.alias("category_score"))


def table_score(df: DataFrame, dimension: str) -> Column:
    """The 0-5 score of a dimension in a stored table, from whichever of its columns is filled.

    ``k`` goes before ``k_score`` and ``score_k`` (0-1); a filled but unreadable value ends the
    search with null.
    """
    chosen = F.when(F.lit(False), F.lit(None).cast("double"))
    factors = {dimension: 1.0, f"{dimension}_score": 1.0, f"score_{dimension}": 5.0}
    for name, factor in factors.items():
        if name in df.columns:
            chosen = chosen.when(df[name].isNotNull(), number_column(df, name) * factor)
    return chosen


def detect_defects(df: DataFrame) -> DataFrame:
    """Add ``defects`` (array) to a table that already has response texts and scores."""
    scores = {k: table_score(df, k) for k in SCORE_DEFECTS}
    f = TextFeatures()
    codes = defect_codes(f, {k: F.col(f"__s_{k}") for k in scores})
    valued = df.select("*", *[c.alias(f"__s_{k}") for k, c in scores.items()])
    kept = [c for c in df.columns if c != "defects"]
    return f.add_to(valued, response_text(df)).select(*kept, codes.alias("defects"))
