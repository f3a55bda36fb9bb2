from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from respeval.llm import token_alignment
from respeval.llm.catalog import op13_token_alignment
from tests.llm.data import SCHEMA, awkward, prose

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab theing \n\t▁é漢字日本語\U0001f642  .,'s-{}0123456789ß​\x00<|endoftext|>"


@pytest.fixture(scope="module")
def pair():
    return token_alignment.read_byte_level(A), token_alignment.read_sentencepiece(B)


@pytest.fixture(scope="module")
def library():
    """Ids and bytes of tokens as the libraries give them."""
    one = tokenizers.Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}

    def encode(text):
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        bytes_a = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [
            bytes([int(two.id_to_piece(i)[1:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        return a, b, bytes_a, bytes_b

    return encode


def ends(parts):
    return np.cumsum([len(p) for p in parts]).tolist()


def groups_of(text, library):
    """Groups of (ids of A, ids of B), or none."""
    if not text:
        return []
    a, b, bytes_a, bytes_b = library(text)
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return []
    ends_a, ends_b = ends(bytes_a), ends(bytes_b)
    out, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        out.append((a[i:to_a], b[j:to_b]))
        i, j = to_a, to_b
    return out


def brute_force(rows, library):
    all_groups = [groups_of(t, library) for _, t in rows]
    links = [Counter((x, y) for g, h in groups for x in g for y in h) for groups in all_groups]
    count = Counter(p for linked in links for p in linked)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (key, _), groups, linked in zip(rows, all_groups, links, strict=True):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((
            key, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(linked.values()),
            sum(n for p, n in linked.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in linked.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def texts(rng):
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(50))) for _ in range(150)]
    out += [prose(rng, rng.randrange(1, 80)) for _ in range(60)]
    return out + out[:30] + [None, "", "<|endoftext|>", "</s>", "x" * 3000, "漢" * 200, " " * 90, "\n" * 40]


@pytest.mark.parametrize("frequent, links, pairs", [(1_000_000, 1 << 21, 1 << 21), (90, 5, 50), (0, 1, 1)])
def test_brute_force(table, pair, library, monkeypatch, frequent, links, pairs):
    """The same with all, few or no pairs broadcast, and in small pieces."""
    monkeypatch.setattr(token_alignment, "FREQUENT_PAIRS", frequent)
    monkeypatch.setattr(token_alignment, "LINKS_AT_ONCE", links)
    monkeypatch.setattr(token_alignment, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(token_alignment, "DOCUMENTS_AT_ONCE", 16)
    rows = list(enumerate(texts(random.Random(frequent))))
    got = token_alignment.alignment(table(rows, "doc_id long, text string"), *pair).collect()
    assert sorted(map(tuple, got)) == sorted(brute_force(rows, library))


def test_given_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = op13_token_alignment(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(brute_force([tuple(r) for r in docs], library))


def test_overlapping_tokens(table, pair, library):
    """Every overlap once, with ranges of bytes, and the groups of the tokens."""
    rows = list(enumerate(texts(random.Random(3))))
    got = token_alignment.overlapping_tokens(table(rows, "doc_id long, text string"), *pair).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id][1]
        groups = groups_of(text, library)
        assert [t.id for t in r.tokens_a] == [i for g, _ in groups for i in g]
        assert [t.id for t in r.tokens_b] == [i for _, h in groups for i in h]
        assert [t.group for t in r.tokens_a] == [k for k, (g, _) in enumerate(groups) for _ in g]
        assert [t.group for t in r.tokens_b] == [k for k, (_, h) in enumerate(groups) for _ in h]
        if not groups:
            assert r.overlaps == []
            continue
        _, _, bytes_a, bytes_b = library(text)
        for tokens, parts in ((r.tokens_a, bytes_a), (r.tokens_b, bytes_b)):
            assert [(t.start, t.end) for t in tokens] == list(zip([0, *ends(parts)][:-1], ends(parts), strict=True))
        expected = [
            (i, j) for i, x in enumerate(r.tokens_a) for j, y in enumerate(r.tokens_b) if x.start < y.end and y.start < x.end
        ]
        assert [tuple(o) for o in r.overlaps] == expected


def test_equals_the_library_for_all_characters(pair, library):
    """Byte-level ranks cut words at every kind of character as the library of the file does."""
    one = tokenizers.Tokenizer.from_file(A)
    one.encode_special_tokens = True
    encode = pair[0].encoder()
    codes = [*range(0x3000), *range(0x3000, 0x110000, 97)]
    some = [f" a{chr(c)}b 1{chr(c)}2 .{chr(c)}, {chr(c)}{chr(c)}  {chr(c)} 's{chr(c)}" for c in codes if not 0xD800 <= c < 0xE000]
    expected = one.encode_batch(some, add_special_tokens=False)
    for text, mine, theirs in zip(some, encode(some), expected, strict=True):
        assert mine.tolist() == theirs.ids, repr(text)


def test_awkward_documents(table, spark, pair, library):
    rows = awkward()
    got = token_alignment.alignment(table(rows, SCHEMA), *pair).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_force([r[:2] for r in rows], library)))
    empty = spark.createDataFrame([], SCHEMA)
    assert token_alignment.alignment(empty, *pair).count() == 0
    assert token_alignment.overlapping_tokens(empty, *pair).count() == 0
