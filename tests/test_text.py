from __future__ import annotations

import random
import sys
import time

import pytest
from pyspark.sql import functions as F

from respeval.functions import text as tx
from respeval.functions.scores import HEURISTICS, TextFeatures
from respeval.operators.scoring import score_responses
from tests import restated

PHRASES = sorted(
    {
        p
        for group in (
            tx.LOGICAL, tx.POSITIVE, tx.NEGATIVE, tx.POLITE, tx.UNCERTAIN, tx.ACCURACY_BONUS,
            tx.LIST_WORDS, restated.HEDGES, restated.REFUSALS,
        )
        for p in group
    }
)
SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def random_texts(count: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    plain = ["((so", "so...", "a...b", "(", "'x'", "so", "éso", "so_", "sométhing", "x", "12)", "3", "co-op", "Thus,", "(since)", "ſo",
             "ΑΣ", "İf", "`word`", "...", "thank", "you", "should", "have", "straße", "٣)"]
    joints = [" ", " ", " ", "  ", "\n", "\t", ", ", "; ", ".", *SPACES]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(rng.choice([0, 1, 3, 8, 15, 25, 40, 120])):
            word = rng.choice(plain) if rng.random() < 0.8 else rng.choice(PHRASES)
            parts.append(word.upper() if rng.random() < 0.2 else word)
            parts.append(rng.choice(joints))
        texts.append("".join(parts))
    return texts


def test_space_class_is_pythons():
    assert sorted(tx.LATIN_SPACES + tx.WIDE_SPACES) == SPACES


def test_every_space_splits(table):
    texts = [f"a{s}b" for s in SPACES] + ["", " ", "a", " 　"]
    rows = table([(t,) for t in texts], "t string").select("t", tx.word_count(F.col("t")).alias("n"))
    assert [(r.t, r.n) for r in rows.collect()] == [(t, len(t.split())) for t in texts]


def test_strip_and_collapse(table):
    texts = ["\x1c a\x0b b ", "", "　", "x"]
    rows = table([(t,) for t in texts], "t string").select(
        tx.strip(F.col("t")).alias("s"), tx.collapse_spaces(F.col("t")).alias("c")
    )
    assert [(r.s, r.c) for r in rows.collect()] == [(t.strip(), " ".join(t.split())) for t in texts]


def test_scores_and_defects_match_restatement(table):
    texts = random_texts(1500, seed=7)
    df = table(list(enumerate(texts)), "i int, response string")
    scored = score_responses(df).select("i", *HEURISTICS, "defects").collect()
    for row in scored:
        text = texts[row.i]
        assert {k: round(row[k]) for k in HEURISTICS} == restated.scores(text), repr(text)
        assert row.defects == restated.defects(text), repr(text)


def test_unique_ratio_matches_restatement(table):
    texts = random_texts(400, seed=8)
    f = TextFeatures()
    ratio = f.unique_word_ratio
    df = f.add_to(table(list(enumerate(texts)), "i int, t string"), F.col("t"))
    for row in df.select("i", ratio.alias("r")).collect():
        assert row.r == pytest.approx(restated.unique_ratio(texts[row.i])), repr(texts[row.i])


def test_phrases_sharing_a_word_are_both_found(table):
    df = table([("thank you should have; clearly you should have",)], "t string")
    (row,) = df.select(tx.markers(F.col("t")).alias("m")).collect()
    assert row.m == "|thank you|you should have|clearly you|you should have|"


def test_word_boundary_is_unicode(table):
    df = table([("éso soé so² so",)], "t string")
    (row,) = df.select(tx.markers(F.col("t")).alias("m")).collect()
    assert row.m == "|so|"


def test_first_non_empty(table):
    df = table([(None, ""), ("", "b"), ("a", "b"), (None, None)], "a string, b string")
    rows = df.select(tx.first_non_empty(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == ["", "b", "a", ""]


def test_long_runs_take_linear_time(spark, table):
    """100,000 characters of what a pattern could rescan: dots in a word, markers, numbers, fences."""
    texts = ["a" + "." * 100_000 + "b", "so " * 33_000, "1" * 100_000, "`" * 100_000, "." * 100_000]
    df = table([("because " * 25 + t,) for t in texts], "response string")
    start = time.monotonic()
    got = score_responses(df).collect()
    assert len(got) == len(texts)
    assert time.monotonic() - start < 20
