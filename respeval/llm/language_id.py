"""Language identification: known words first, then ever shorter character n-grams.

Every word of the learned documents is counted per language. A known word scores each language by
the log of its relative frequency there, and by one common floor where it was not seen. A word
that was never learned falls back to its character n-grams, with a space at both ends: the
longest length of which any n-gram was learned counts, from five down to one, and the word scores
the mean of its learned n-grams of that length. A document's language is the one with the highest sum
over its words.

The tables of words and n-grams are Spark tables over all documents, as large as the corpus makes
them. Every distinct word is scored once. The words that occur most often, a fixed number of entries,
are broadcast; each text is summed up against those where it lies. The other words of a text, of
which none is frequent, meet their scores in a join. So no key is hot and nothing that is broadcast
grows, and there is one way for all sizes. Scores are whole multiples of 2^-20, so sums do not
depend on their order.

Defined cases: words are runs of letters with their marks, lower-cased; longer runs are cut into
pieces of 40. A null text, or one without any letter, is ``und`` with score 0, and so is every text if
nothing was learned. Ties go to the language with more learned documents, then to the smaller name;
so does a text none of whose letters was learned. Rows with a null id or language can be scored;
rows without a language are not learned from. Repeated rows each get a row and count as often as they
occur; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.llm.common import blocks, most_frequent, stored
from respeval.llm.toxicity import held_out

UNKNOWN = "und"
LONGEST_WORD = 40
LONGEST_GRAM = 5
# Fixed point of scores.
ONE = 1 << 20
# Words that are broadcast: at most so many, with at most so many scores.
FREQUENT_WORDS = 400_000
FREQUENT_SCORES = 2_000_000
# Names of languages are kept on the driver.
MOST_LANGUAGES = 10_000
# Distinct words that a task counts, and words whose n-grams it counts, before it passes them on.
COUNTED_AT_ONCE = 400_000
WORDS_AT_ONCE = 200_000

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,%d}" % (LONGEST_WORD - 1))
_MARK = regex.compile(r"\p{M}")


class _Letters(dict):
    """What a character is replaced by so that words stand between spaces; filled when first asked."""

    def __missing__(self, code: int) -> int:
        self[code] = code if regex.match(r"\p{L}", chr(code)) else 32
        return self[code]


_LETTERS = _Letters()


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    lower = text.lower()
    if lower.isascii() or not _MARK.search(lower):
        # The same and faster, but for words to be cut.
        found = lower.translate(_LETTERS).split()
        if max(map(len, found), default=0) <= LONGEST_WORD:
            return found
    return _WORD.findall(lower)


@dataclass(frozen=True)
class Model:
    """Learned counts as tables, and what is as long as the list of languages.

    ``words`` and ``grams`` hold (word or gram, counts: array of (language, n)). Languages are numbered
    in the order that settles ties. ``totals[0]`` are the words per language, ``totals[n]`` the n-grams.
    """

    languages: tuple[str, ...]
    words: DataFrame
    grams: DataFrame
    totals: np.ndarray


def _scored(langs: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log frequency above the floor, which is half an occurrence in the largest language."""
    floor = math.log(0.5 / max(int(totals.max()), 1)) if len(totals) else 0.0
    return np.rint((np.log(counts / totals[langs]) - floor) * ONE).astype(np.int64)


def _sums(rows: DataFrame, key: str) -> DataFrame:
    """(key, counts) from partial counts (key, lang, n); one shuffle, as tasks have added theirs up."""
    by_key = rows.repartition(key).groupBy(key, "lang").agg(F.sum("n").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("lang", "n")))
    return by_key.groupBy(key).agg(pairs.alias("counts"))


def _emit(counters: dict[int, Counter], key: str) -> Iterator[pa.RecordBatch]:
    for lang, found in counters.items():
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.keys(), pa.string()),
                    pa.array(np.full(len(found), lang, np.int32)),
                    pa.array(found.values(), pa.int64()),
                ],
                names=[key, "lang", "n"],
            )
    counters.clear()


def learnable(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> Column:
    """Whether a row may be learned from: it has a language and is not held out."""
    return F.col(f"`{lang_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`"))


def languages_of(docs: DataFrame, learn: Column, lang_col: str = "lang") -> tuple[str, ...]:
    """The learned languages: most documents first, then by name."""
    known = docs.filter(learn).groupBy(F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = known.agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return tuple(r.lang for r in sorted(rows, key=lambda r: (-r.n, r.lang)))


def count_words(
    docs: DataFrame, languages: tuple[str, ...] = (), learn: Column | None = None,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """Every word of every text: word, counts per language, and total over all texts.

    Texts of rows that are not learned from add to ``total`` only.
    """
    number = {name: i for i, name in enumerate(languages)}
    lang = F.lit(None).cast("string")
    if learn is not None:
        lang = F.when(learn, F.col(f"`{lang_col}`").cast("string"))
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, Counter] = {}
        for block in blocks(batches):
            texts, langs = (block.column(c).to_pylist() for c in ("text", "lang"))
            for text, name in zip(texts, langs, strict=True):
                if text:
                    i = -1 if name is None else number[name]
                    counters.setdefault(i, Counter()).update(words_of(text))
            if sum(map(len, counters.values())) > COUNTED_AT_ONCE:
                yield from _emit(counters, "word")
        yield from _emit(counters, "word")

    counted = _sums(rows.mapInArrow(run, "word string, lang int, n long"), "word")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c.n)
    learned = F.filter("counts", lambda c: c.lang >= 0)
    return counted.select("word", learned.alias("counts"), total.alias("total"))


def _pairs(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the lists, and languages and counts of all pairs, of a column of counts."""
    flat = column.flatten()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lengths, flat.field("lang").to_numpy(), flat.field("n").to_numpy()


def _grams(n: int, whole: str, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, ...]:
    """Places, words and keys of the n-grams of words that stand between spaces; a space alone is none."""
    size = len(whole) - n + 1
    if size < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = codes == 0
    ok = ~space[:size] if n == 1 else np.ones(size, bool)
    for i in range(1, n - 1):
        ok &= ~space[i : i + size]
    place = np.flatnonzero(ok)
    key = codes[place]
    for i in range(1, n):
        if n_codes * (int(key.max(initial=0)) + 1) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * n_codes + codes[place + i]
    return place, np.cumsum(space)[place] - 1, key


def _count_grams_of(words: list[str], lengths: np.ndarray, langs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts per n-gram and language of words with (language, n) pairs."""
    whole = f" {' '.join(words)} "
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    chars, codes = np.unique(points, return_inverse=True)
    at = int(np.searchsorted(chars, 32))  # words have no character below a space, so it is the first
    codes = (codes - at).astype(np.int64)
    first = np.cumsum(lengths) - lengths
    n_langs = int(langs.max(initial=0)) + 1
    for n in range(1, LONGEST_GRAM + 1):
        place, word, key = _grams(n, whole, codes, len(chars))
        _, example, which = np.unique(key, return_index=True, return_inverse=True)
        size = lengths[word]
        pair = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first[word], size)
        cell, where = np.unique(np.repeat(which, size) * n_langs + langs[pair], return_inverse=True)
        total = np.bincount(where, counts[pair], len(cell)).astype(np.int64)  # exact below 2^53
        starts = place[example].tolist()
        names = pa.array([whole[i : i + n] for i in starts], pa.string())
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(cell // n_langs)), pa.array((cell % n_langs).astype(np.int32)), pa.array(total)],
            names=["gram", "lang", "n"],
        )


def _count_grams(words: DataFrame) -> DataFrame:
    """gram and counts, from the learned words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def counted() -> Iterator[pa.RecordBatch]:
            if sum(b.num_rows for b in waiting):
                table = pa.Table.from_batches(waiting).combine_chunks()
                pairs = _pairs(table.column("counts").combine_chunks())
                yield from _count_grams_of(table.column("word").to_pylist(), *pairs)
            waiting.clear()

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= WORDS_AT_ONCE:
                yield from counted()
        yield from counted()

    learned = words.filter(F.size("counts") > 0).select("word", "counts")
    return _sums(learned.mapInArrow(run, "gram string, lang int, n long"), "gram")


def _totals(table: DataFrame, size: Column, n_languages: int) -> np.ndarray:
    """Sums of the counts by size and language."""
    each = table.select(size.alias("size"), F.explode("counts").alias("c"))
    rows = each.groupBy("size", "c.lang").agg(F.sum("c.n").alias("n")).collect()
    out = np.ones((LONGEST_GRAM + 1, n_languages), np.int64)
    for r in rows:
        out[r["size"], r["lang"]] = r["n"]
    return out


def fit(words: DataFrame, languages: tuple[str, ...]) -> Model:
    """The model of a stored table from ``count_words``."""
    grams = stored(_count_grams(words), "grams")
    totals = _totals(grams, F.length("gram"), len(languages))
    totals[0] = _totals(words, F.lit(0), len(languages))[0]
    return Model(languages, words.filter(F.size("counts") > 0).select("word", "counts"), grams, totals)


_SCORED = "word string, total long, langs array<int>, scores array<long>"


def _scored_batch(batch: pa.RecordBatch, lengths, langs, values) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column("word"),
            batch.column("total"),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(langs, pa.int32())),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64())),
        ],
        names=["word", "total", "langs", "scores"],
    )


def _known(words: DataFrame, totals: np.ndarray) -> DataFrame:
    """Scores of the learned words (word, total, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, langs, counts = _pairs(batch.column("counts"))
            yield _scored_batch(batch, lengths, langs, _scored(langs, counts, totals[0]))

    return words.mapInArrow(run, _SCORED)


def _by_grams(words: DataFrame, model: Model, n: int) -> DataFrame:
    """Scores of words (word, total) by their n-grams; words without any learned one are missing."""
    totals = model.totals[n]
    whole = F.col("word") if n == 1 else F.concat(F.lit(" "), "word", F.lit(" "))
    places = F.sequence(F.lit(1), F.length(whole) - n + 1)
    enough = words.filter(F.length(whole) >= n)
    each = enough.select("word", "total", F.explode(F.transform(places, lambda i: F.substr(whole, i, F.lit(n)))).alias("gram"))
    of_length = model.grams.filter(F.length("gram") == n)
    # At most one entry per place of a word, which has 40 letters at most.
    found = each.join(of_length, "gram").groupBy("word", "total").agg(F.collect_list("counts").alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, langs, values = [], [], []
            for grams in batch.column("all").to_pylist():
                pairs = [(c["lang"], c["n"]) for g in grams for c in g]
                where = np.array([p[0] for p in pairs])
                value = _scored(where, np.array([p[1] for p in pairs]), totals)
                total = np.zeros(len(totals), np.int64)
                np.add.at(total, where, value)
                here = np.flatnonzero(total)
                lengths.append(len(here))
                langs.extend(here.tolist())
                values.extend((total[here] // len(grams)).tolist())
            yield _scored_batch(batch, lengths, langs, values)

    return found.mapInArrow(run, _SCORED)


def score_words(words: DataFrame, model: Model) -> DataFrame:
    """word, total, and the languages with their scores, for every word (word, counts, total)."""
    out = stored(_known(words.filter(F.size("counts") > 0), model.totals), "scores")
    rest = words.filter(F.size("counts") == 0).select("word", "total")
    for n in range(LONGEST_GRAM, 0, -1):
        found = stored(_by_grams(rest, model, n), "scores")
        rest = rest.join(found.select("word"), "word", "left_anti")
        if n > 1:
            rest = stored(rest, "unseen")
        out = out.unionByName(found)
    return out


def _frequent(scored: DataFrame, n_languages: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent words with the ends, languages and scores of their entries."""
    most = min(FREQUENT_WORDS, FREQUENT_SCORES // max(n_languages, 1))
    top = most_frequent(scored, "total", most).select("word", "langs", "scores").toArrow()
    langs, values = top.column("langs").combine_chunks(), top.column("scores").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(langs.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return top.column("word").to_pylist(), ends, langs.flatten().to_numpy(), values.flatten().to_numpy()


_INDEX: dict[str, tuple] = {}


def _index(shared) -> tuple:
    """The broadcast words as a dictionary, built once per worker."""
    name, words, *rest = shared.value
    if name not in _INDEX:
        _INDEX.clear()
        _INDEX[name] = ({w: i for i, w in enumerate(words)}, *rest)
    return _INDEX[name]


_PARTIAL = "n_words long, langs array<int>, sums array<long>, words array<string>, times array<int>"


def _partial_sums(rows: DataFrame, shared, n_languages: int) -> DataFrame:
    """Sums over the frequent words of each text, and its other words with their numbers."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ends, langs, values = _index(shared)
        row = TaskContext.get().partitionId() << 33
        for block in blocks(batches):
            n = block.num_rows
            found = [words_of(text) for text in block.column("text").to_pylist()]
            number = np.array([len(f) for f in found], np.int64)
            doc = np.repeat(np.arange(n), number)
            flat = list(chain.from_iterable(found))
            hit = np.fromiter((index.get(w, -1) for w in flat), np.int64, len(flat))
            rare: list[Counter] = [Counter() for _ in range(n)]
            for i in np.flatnonzero(hit < 0).tolist():
                rare[doc[i]][flat[i]] += 1
            words, times = [list(r) for r in rare], [list(r.values()) for r in rare]
            hit, doc = hit[hit >= 0], doc[hit >= 0]
            size = ends[hit + 1] - ends[hit]
            first = np.repeat(ends[hit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cell = np.repeat(doc, size) * n_languages + langs[first]
            total = np.bincount(cell, values[first], n * n_languages).astype(np.int64)  # exact below 2^53
            full = np.flatnonzero(total)
            cuts = np.searchsorted(full, np.arange(n + 1) * n_languages).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    *(block.column(c) for c in others),
                    pa.array(number, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array((full % max(n_languages, 1)).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(total[full])),
                    pa.array(words, pa.list_(pa.string())),
                    pa.array(times, pa.list_(pa.int32())),
                ],
                names=["row", *others, "n_words", "langs", "sums", "words", "times"],
            )
            row += n

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"row long, {kept}, {_PARTIAL}")


def choose(langs: list[int], sums: list[int], n_languages: int) -> tuple[int, float]:
    """The first language with the highest sum, and its share of the likelihood of all."""
    all_ = np.zeros(n_languages)
    for i, s in zip(langs, sums, strict=True):
        all_[i] += s
    best = int(np.argmax(all_))
    return best, float(1 / np.exp((all_ - all_[best]) / ONE).sum())


def predict(
    docs: DataFrame, model: Model, words: DataFrame | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, lang_pred and score of every document.

    ``words`` is a stored table from ``count_words`` over these documents, if there is one with the counts
    the model was fitted on; else the words are counted here.
    """
    if words is None:
        own = count_words(docs, text_col=text_col).select("word", "total")
        words = stored(own.join(model.words, "word", "left").select(
            "word", F.coalesce("counts", F.array().cast("array<struct<lang:int,n:long>>")).alias("counts"), "total"
        ), "words")
    scored = score_words(words, model)
    languages, n = model.languages, len(model.languages)
    frequent = _frequent(scored, n)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *frequent))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sums = stored(_partial_sums(rows, shared, n), "sums")

    rare = sums.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    rare = rare.join(scored.select(F.col("word").alias("words"), "langs", "scores"), "words")
    rare = rare.select("row", "times", F.explode(F.arrays_zip("langs", "scores")).alias("s"))
    rare = rare.repartition("row").groupBy("row", F.col("s.langs").alias("lang"))
    rare = rare.agg(F.sum(F.col("times") * F.col("s.scores")).alias("sum")).groupBy("row")
    rare = rare.agg(F.collect_list(F.struct("lang", "sum")).alias("more"))
    more = F.coalesce("more", F.array().cast("array<struct<lang:int,sum:long>>"))
    whole = sums.drop("words", "times").join(rare, "row", "left")
    whole = whole.select(
        "doc_id", "n_words",
        F.concat("langs", F.transform(more, lambda m: m.lang)).alias("langs"),
        F.concat("sums", F.transform(more, lambda m: m.sum)).alias("sums"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, langs, totals = (batch.column(c).to_pylist() for c in ("n_words", "langs", "sums"))
            out = [
                (languages[(b := choose(i, s, n))[0]], b[1]) if k and n else (UNKNOWN, 0.0)
                for k, i, s in zip(n_words, langs, totals, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_words"),
                    pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.float64()),
                ],
                names=["doc_id", "n_words", "lang_pred", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"doc_id {kind}, n_words long, lang_pred string, score double")


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Learn from the labelled documents that are not held out, and predict for all."""
    learn = learnable(docs, id_col, lang_col)
    languages = languages_of(docs, learn, lang_col)
    words = stored(count_words(docs, languages, learn, lang_col, text_col), "words")
    return predict(docs, fit(words, languages), words, id_col, text_col)
