"""Spark-native evaluation of model responses: scoring, defects, cost, quality and regression."""

from respeval.operators.scoring import Criterion, Rubric, score_responses, score_table

__all__ = ["Criterion", "Rubric", "score_responses", "score_table"]
