from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from respeval.llm import toxicity
from tests.llm.data import SCHEMA, WORDS, awkward, prose

BAD = ["idiot", "Scum", "TRASH"]


def sample(rng: random.Random, n: int) -> list[tuple[str, int]]:
    out = []
    for _ in range(n):
        words = prose(rng, rng.randrange(20, 200)).split()
        label = int(rng.random() < 0.2)
        for _ in range(rng.randrange(2, 6) * label):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ",", "!!"]))
        out.append((" ".join(words), label))
    return out


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(sample(random.Random(1), 500))


def forward_backward(model, codes):
    """Marginals of all words by the plain recursions."""
    step = np.exp(np.array(model.step))
    emit = [np.array([1.0, math.exp(model.emission[c])]) for c in codes]
    ahead = [np.array([1.0, math.exp(model.start)]) * emit[0]]
    for e in emit[1:]:
        ahead.append((ahead[-1] / ahead[-1].sum()) @ step * e)
    back = [np.ones(2)]
    for e in emit[:0:-1]:
        back.insert(0, step @ (e * back[0]))
        back[0] /= back[0].sum()
    both = [a * b for a, b in zip(ahead, back, strict=True)]
    return [x[1] / x.sum() for x in both]


def test_marginals_equal_the_plain_recursions(model):
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice(WORDS * rng.randrange(1, 9) + BAD) for _ in range(rng.randrange(1, 80))]
        n, at, p = model.tag(" ".join(words))
        assert n == len(words)
        codes = [model.words.get(w.lower(), 0) for w in words]
        assert at == [i for i, c in enumerate(codes) if c]
        whole = forward_backward(model, codes)
        assert p == pytest.approx([whole[i] for i in at], abs=1e-9)


def test_learns_the_words_and_no_others(model):
    found = {w for w, c in model.words.items() if model.emission[c] > 0}
    assert found == {b.lower() for b in BAD}
    rng = random.Random(3)
    right = 0
    for text, label in (held := sample(rng, 300)):
        n, _, p = model.tag(text)
        right += (model.score(n, p) >= toxicity.THRESHOLD) == bool(label)
    assert right >= 0.99 * len(held)


def test_order_of_the_sample_does_not_matter():
    rows = sample(random.Random(4), 60)
    assert toxicity.fit(rows) == toxicity.fit(rows[::-1])


def test_without_labels_or_classes():
    for rows, share in (([], 0.5), ([("a b", 0)] * 3, 0.125), ([("a", 1), (None, 1)], 2.5 / 3)):
        assert toxicity.fit(rows).score(0, []) == pytest.approx(share)


def test_awkward_documents(table, spark, model):
    rows = [*awkward(), (50, "Oh, you İdiot é IDIOT! scum", None, None, None, None, None)]
    docs = table(rows, SCHEMA)
    got = toxicity.tag_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    (bad,) = [r for r in got if r.doc_id == 50]
    assert [rows[-1][1][s.start : s.end] for s in bad.spans] == ["IDIOT", "scum"] and bad.score > 0.5
    clean = toxicity.drop_toxic(docs, model)
    assert clean.columns == docs.columns and clean.filter("doc_id = 50").count() == 0
    assert clean.count() == len(rows) - 1
    empty = spark.createDataFrame([], SCHEMA)
    labels = table([(1, 1, None), (1, 0, 2), (None, 1, 3), (2, None, 4), (3, 0, 5)], "doc_id long, toxic int, text int")
    trained = toxicity.train(docs, labels)
    assert 0 < trained.score(0, []) < 1
    assert toxicity.tag_documents(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_held_out_rows_are_not_learned_from(table):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = table([(i, "only idiot idiot here") for i in ids], "doc_id long, text string")
    labels = table([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).score(0, []) == pytest.approx(0.5)
    marked = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h for r in marked)


def test_held_out_accuracy_on_given_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.tag_documents(docs, toxicity.train(docs, labels)).join(labels, "doc_id")
    rows = scored.filter(toxicity.held_out(F.col("doc_id"))).collect()
    hit = [r for r in rows if r.score >= toxicity.THRESHOLD]
    # A tenth of the labels is noise.
    assert sum(r.toxic for r in hit) >= 0.95 * len(hit)
    assert sum(r.toxic for r in hit) >= 0.85 * sum(r.toxic for r in rows)


def test_sample_is_bounded(spark, table, monkeypatch):
    """One id on a third of all rows, with many texts and copies; texts beyond the bytes are left out whole."""
    rng = random.Random(3)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample: seen.append(sample))
    rows = [(i if i % 3 else 1, prose(rng, 12) if i % 2 else "the same text") for i in range(900)]
    rows.append((5, "x" * 100_000))
    docs = table(rows, "doc_id long, text string")
    labels = table([(i, i % 2) for i in range(900)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 40_000)
    toxicity.train(docs, labels, sample_rows=50)
    (sample,) = seen
    assert len(sample) <= 50 and sum(len(t) for t, _ in sample) <= 40_000
    assert len({t for t, _ in sample}) > 1 and ("x" * 100_000, 1) not in sample
