from __future__ import annotations

import hashlib
import random

import pytest

from respeval.llm import fingerprints as fp
from tests.llm.data import SCHEMA, awkward, prose


def in_order(rows):
    """Descending by id; repeated ids by a digest, which only their texts decide; null ids last."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or type(r[0])()) if r[0] is not None else (False,), reverse=True)


def check(got, rows):
    order = in_order(rows)
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        changed = fp.edited(text, after)
        a, b, c = fp.fingerprints([text, changed, after])
        expected = (i, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c))
        assert tuple(by_id[i]) == expected


@pytest.mark.parametrize("size", [2_000, 16 << 20])
def test_neighbours(table, monkeypatch, size):
    monkeypatch.setattr(fp, "RANGE_BYTES", size)
    rows = [r[:2] for r in awkward()[:16]]
    check(fp.edit_likeness(table(rows, "doc_id long, text string").repartition(5)).collect(), rows)


def test_a_thousand_ranges(table, monkeypatch):
    """As many ranges as about 16 GB of text have."""
    monkeypatch.setattr(fp, "RANGE_BYTES", 16)
    rng = random.Random(5)
    rows = [(i, prose(rng, 4)[:16].ljust(16, "z")) for i in range(1100)]
    check(fp.edit_likeness(table(rows, "doc_id long, text string")).collect(), rows)


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def parse(symbols):
    """One level, symbol by symbol: runs joined, coins tossed, phrases from local maxima, their names."""
    joined = []
    for s in symbols:
        if joined and joined[-1][0] == s:
            joined[-1][1] += 1
        else:
            joined.append([s, 1])
    symbols = [s if n == 1 else mix((s + 0x9E3779B97F4A7C15 * n) % 2**64) for s, n in joined]

    def toss(label):
        """Where a label differs from its left neighbour, and its bit there."""
        out = [label[0] % 2]
        for left, own in zip(label, label[1:]):
            bit = ((left ^ own) & -(left ^ own)).bit_length() - 1
            out.append(2 * bit + (own >> bit) % 2)
        return out

    label = toss(toss(toss(symbols)))
    assert all(a != b for a, b in zip(label, label[1:])) and max(label) < 8
    phrases = []
    for i, s in enumerate(symbols):
        top = 0 < i < len(symbols) - 1 and label[i - 1] < label[i] >= label[i + 1]
        if i == 0 or top:
            phrases.append([])
        phrases[-1].append(s)
    factors = [mix(k) | 1 for k in range(1, 65)]
    return [mix(sum((s + 1) * factors[k % 64] for k, s in enumerate(p)) % 2**64) for p in phrases]


def brute_names(text, levels=3, lowest=2):
    symbols, names = [ord(c) for c in text], set()
    for level in range(1, levels + 1) if symbols else ():
        symbols = parse(symbols)
        if level >= lowest:
            names |= {(s + level) % 2**64 for s in symbols}
    return names


def test_names_by_brute_force(monkeypatch):
    """The parse of many texts at once against one symbol after the other."""
    rng = random.Random(11)
    texts = ["", "a", "ab", "aa", "aba", "x" * 900, "ab" * 300, "\U0001f642\x00é" * 40]
    texts += ["".join(rng.choice("ab\n é日") for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += [prose(rng, rng.randrange(300)) for _ in range(60)]
    rng.shuffle(texts)
    for chars in (1 << 17, 50):
        monkeypatch.setattr(fp, "PARSED_CHARS", chars)
        for text, names, mark in zip(texts, fp.phrase_names(texts), fp.fingerprints(texts), strict=True):
            expected = brute_names(text)
            assert set(names.tolist()) == expected, repr(text)
            assert mark == "".join(f"{h:08x}" for h in sorted({n >> 32 for n in expected})[:32])


def test_string_ids(table, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", 3000)
    rng = random.Random(6)
    rows = [(f"http://{rng.random()}/é", prose(rng, rng.randrange(60))) for _ in range(120)] + [("", "a"), (None, "null id")]
    check(fp.edit_likeness(table(rows, "doc_id string, text string")).collect(), rows)


def test_one_id_on_most_rows(table, monkeypatch):
    """A repeated id, or none, is cut into ranges by the texts."""
    monkeypatch.setattr(fp, "RANGE_BYTES", 2000)
    rng = random.Random(9)
    for hot in (5, None):
        rows = [(hot if i % 3 else i, prose(rng, 20)) for i in range(400)]
        df = table(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
        keyed = df.selectExpr("doc_id", "xxhash64(text) as tie")
        cuts = fp.range_cuts(keyed, ["doc_id", "tie"], 30)
        sizes = [r["count"] for r in fp.with_range(keyed, ["doc_id", "tie"], cuts).groupBy("part").count().collect()]
        assert max(sizes) < 60
        got = fp.edit_likeness(df).collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
        assert sorted(r.fingerprint for r in got) == sorted(fp.fingerprints([t for _, t in rows]))


def test_one_document_and_none(table, spark):
    rows = [(7, "only one document of its own")]
    check(fp.edit_likeness(table(rows, "doc_id long, text string")).collect(), rows)
    assert fp.edit_likeness(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fp.document_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_and_null_ids(table):
    rows = awkward()
    got = fp.edit_likeness(table(rows, SCHEMA)).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (r[0] for r in rows)))
    texts = {r[1] or "" for r in rows}
    hashes = {fp.fingerprints([t])[0] for t in texts}
    assert {r.fingerprint for r in got} == hashes


def test_equal_texts_and_blocks(table):
    rng = random.Random(1)
    texts = ["", "a", "aaaaaaa", *(prose(rng, n) for n in (1, 3, 10, 100, 1000)), "ab" * 500, "x" * 9999]
    alone = [fp.fingerprints([t])[0] for t in texts]
    assert fp.fingerprints(texts) == alone
    assert fp.fingerprints([*texts, *texts[::-1]]) == alone + alone[::-1]
    rows = list(enumerate(texts))
    got = fp.document_fingerprints(table(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.fingerprint for r in got} == dict(enumerate(alone))


def test_substrings_share_interior_names():
    """The same passage at any offset has the same names, but for a bounded margin at both ends."""
    rng = random.Random(2)
    passage = prose(rng, 400)
    names = set(fp.phrase_names([passage])[0].tolist())
    for offset in (1, 2, 3, 17, 1000):
        around = "".join(rng.choice("abcdefgh ") for _ in range(offset))
        other = set(fp.phrase_names([around + passage + around[::-1]])[0].tolist())
        assert len(names & other) >= 0.93 * len(names)


def test_phrases_are_short_and_names_differ():
    rng = random.Random(3)
    text = prose(rng, 3000)
    for level, shortest in ((1, 2), (2, 4), (3, 8)):
        n = len(fp.phrase_names([text], level, level)[0])
        assert n <= len(text) / shortest


def test_likeness_estimates_the_share():
    rng = random.Random(4)
    for _ in range(30):
        a, b, c = prose(rng, 400), prose(rng, 400), prose(rng, 200)
        x, y, z, w = fp.fingerprints([a, b, a + c, a])
        assert fp.likeness(x, w) == 1 and fp.likeness(x, y) < 0.3 < fp.likeness(x, z) < 1
    assert fp.likeness("", "") == 1 and fp.likeness("", "00000000") == 0
