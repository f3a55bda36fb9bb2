from __future__ import annotations

import random

import pytest

from respeval.llm import token_counts
from tests.llm.data import SCHEMA, awkward, prose

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab theing \n\t▁é漢字日本語のカ\U0001f642  .,-{}()\\/0123456789Ééß​\x00İ́"


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(rng: random.Random, pieces: tuple[str, ...]):
    for i in range(1500):
        yield "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))
        yield "".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randrange(15)))
        yield "".join(rng.choice("aeinorst") for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("chunk", [3, 8, 1 << 16])
def test_equals_the_library(vocabulary, library, monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    machine = token_counts.Transducer(vocabulary)
    for text in texts(random.Random(chunk), vocabulary.pieces):
        assert machine.count(text) == len(library.encode(text)), repr(text)


def test_bounds_of_what_is_kept(vocabulary, library, monkeypatch):
    """Compiling anew, and long texts without any cut, change nothing."""
    for name in ("MAX_TRANSITIONS", "MAX_PIECES", "MAX_PAIRS"):
        monkeypatch.setattr(token_counts, name, 50)
    machine = token_counts.Transducer(vocabulary)
    rng = random.Random(1)
    some = [prose(rng, 200), "日本語" * 3000, "x" * 30_000, "ab" * 10_000, " " * 5000, "\n" * 5000]
    for text in some:
        assert machine.count(text) == len(library.encode(text))


def test_composition_is_associative(vocabulary):
    machine = token_counts.Transducer(vocabulary)
    rng = random.Random(2)
    for _ in range(500):
        a, b, c = (machine.chunk("".join(rng.choice("ab▁▁\nxé") for _ in range(rng.randrange(1, 9)))) for _ in "abc")
        assert machine.compose(machine.compose(a, b), c) == machine.compose(a, machine.compose(b, c))


def test_awkward_documents(table, spark, vocabulary, library):
    rows = awkward()
    got = token_counts.token_counts(table(rows, SCHEMA), vocabulary, limit=100).collect()
    expected = [
        (r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "")), len(library.encode(r[1] or "")) > 100)
        for r in rows
    ]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), vocabulary).count() == 0


def test_given_documents(spark, vocabulary, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, vocabulary).collect()}
    assert got == {r.doc_id: len(library.encode(r.text)) for r in docs.collect()}
