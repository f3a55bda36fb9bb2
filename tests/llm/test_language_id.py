from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from respeval.llm import language_id
from respeval.llm.catalog import op11_language_id
from tests.llm.data import SCHEMA, awkward

ONE = 1 << 20


def words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if language_id.regex.match(r"\p{L}", c) or word and language_id.regex.match(r"\p{M}", c):
            word += c
            if len(word) == 40:
                out.append(word)
                word = ""
        else:
            out += [word] if word else []
            word = ""
    return out


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 4 == 2


def brute_force(rows):
    """Predictions for rows (id, text, lang), word by word."""
    learned = [(words(t), g) for k, t, g in rows if g is not None and not held(k)]
    docs = Counter(g for _, g in learned)
    languages = sorted(docs, key=lambda g: (-docs[g], g))
    tables = defaultdict(lambda: defaultdict(Counter))  # length (0: words) -> entry -> language
    for found, g in learned:
        for w in found:
            tables[0][w][g] += 1
            for n in range(1, 6):
                whole = w if n == 1 else f" {w} "
                for i in range(len(whole) - n + 1):
                    tables[n][whole[i : i + n]][g] += 1
    totals = {n: sum(t.values(), Counter()) for n, t in tables.items()}

    def score(n, entry):
        floor = math.log(0.5 / max(totals[n].values()))
        counts = tables[n][entry]
        return {g: int(np.rint((np.log(np.float64(c) / totals[n][g]) - floor) * ONE)) for g, c in counts.items()}

    def of_word(w):
        if w in tables[0]:
            return score(0, w)
        for n in range(5, 0, -1):
            whole = w if n == 1 else f" {w} "
            grams = [whole[i : i + n] for i in range(len(whole) - n + 1)]
            known = [score(n, x) for x in grams if x in tables[n]]
            if known:
                total = Counter()
                for k in known:
                    total.update(k)
                return {g: v // len(known) for g, v in total.items()}
        return {}

    out = []
    for key, text, _ in rows:
        found = words(text)
        if not found or not languages:
            out.append((key, len(found), "und", 0.0))
            continue
        total = Counter()
        for w in found:
            total.update(of_word(w))
        best = max(languages, key=lambda g: (total[g], -languages.index(g)))
        share = 1 / sum(math.exp((total[g] - total[best]) / ONE) for g in languages)
        out.append((key, len(found), best, share))
    return out


def made_up(rng, n):
    syllables = {g: ["".join(rng.choice("aeioubcdfglmnprstéñßü") for _ in range(2)) for _ in range(25)] for g in ("aa", "bb", "cc")}
    out = []
    for i in range(n):
        g = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[g]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 60)))
        out.append((i, text.title() if i % 3 else text, None if i % 17 == 0 else g))
    return out


def same(got, expected):
    got = sorted((tuple(r) for r in got), key=repr)
    expected = sorted(expected, key=repr)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    for a, b in zip(got, expected, strict=True):
        assert a[3] == pytest.approx(b[3], abs=1e-9)


@pytest.mark.parametrize("frequent", [0, 60, 400_000])
def test_brute_force(table, monkeypatch, frequent):
    """The same with all, few or no words broadcast."""
    monkeypatch.setattr(language_id, "FREQUENT_WORDS", frequent)
    monkeypatch.setattr(language_id, "COUNTED_AT_ONCE", 100)
    monkeypatch.setattr(language_id, "WORDS_AT_ONCE", 50)
    rows = made_up(random.Random(4), 160)
    rows += [(900, "Ω日本 ж", "aa"), (901, "Ω zzzz qqqqq", None), (902, "1234 .,! ²", "bb"), (902, rows[5][1], None)]
    got = language_id.identify(table(rows, "doc_id long, text string, lang string")).collect()
    same(got, brute_force(rows))


def test_words():
    """Words as the rule has them, whichever way they are found."""
    rng = random.Random(7)
    alphabet = "aBcé\u0301\u0930\u093f\u4e2d1²Ⅷ_ -'\n\x1c\u00a0ſİ"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        assert language_id.words_of(text) == words(text), repr(text)
    for text in ("x" * 100, "x" * 40 + " y", "é" * 81, "e\u0301" * 30):
        assert language_id.words_of(text) == words(text)


def test_many_letters():
    """N-grams of so many letters that five of them do not fit a number."""
    rng = random.Random(1)
    some = sorted({"".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(rng.randrange(1, 8))) for _ in range(4000)})
    counts = [{0: rng.randrange(1, 9), 3: 2} if i % 2 else {1: 5} for i in range(len(some))]
    expected = Counter()
    for w, c in zip(some, counts, strict=True):
        for n in range(1, 6):
            whole = w if n == 1 else f" {w} "
            for i in range(len(whole) - n + 1):
                for g, k in c.items():
                    expected[whole[i : i + n], g] += k
    lengths = np.array([len(c) for c in counts])
    langs, values = (np.array([x[i] for c in counts for x in c.items()]) for i in (0, 1))
    got = Counter()
    for batch in language_id._count_grams_of(some, lengths, langs, values):
        for r in batch.to_pylist():
            got[r["gram"], r["lang"]] += r["n"]
    assert got == expected


def test_held_out_documents(spark):
    """Documents of languages that the operator learned are told apart, held out or not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op11_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    shares = {r.held_out: r.right for r in got.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert shares[True] >= 0.99 and shares[False] >= 0.99


def test_given_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    same(language_id.identify(docs).collect(), brute_force([tuple(r) for r in docs.collect()]))


def test_other_documents_than_the_learned(table):
    """A fitted model is applied to documents with words of their own."""
    rows = made_up(random.Random(6), 60)
    docs = table(rows, "doc_id long, text string, lang string")
    learn = language_id.learnable(docs)
    languages = language_id.languages_of(docs, learn)
    model = language_id.fit(language_id.stored(language_id.count_words(docs, languages, learn), "words"), languages)
    others = [(1000 + i, t + " neverseen", None) for i, t, _ in made_up(random.Random(6), 20)]
    got = language_id.predict(table(others, "doc_id long, text string, lang string"), model).collect()
    right = {i: g for i, _, g in rows[:20]}
    assert all(r.lang_pred == right[r.doc_id - 1000] for r in got if right[r.doc_id - 1000])
    expected = [r for r in brute_force(rows + others) if r[0] is not None and r[0] >= 1000]
    same(got, expected)


def test_awkward_documents(table, spark):
    rows = [(*r[:4], "k", r[5], r[6], lang) for r, lang in zip(awkward() * 2, ["x", None, "y"] * 40, strict=False)]
    docs = table(rows, SCHEMA + ", lang string")
    got = language_id.identify(docs).collect()
    same(got, brute_force([(r[0], r[1], r[7]) for r in rows]))
    assert language_id.identify(spark.createDataFrame([], SCHEMA + ", lang string")).count() == 0
    unknown = table([("a", "some text", None)], "doc_id string, text string, lang string")
    assert [tuple(r) for r in language_id.identify(unknown).collect()] == [("a", 2, "und", 0.0)]
