"""Toxicity: a two-state linear-chain conditional random field over the words of a text.

Labels are per document, so words are labelled first: in a bounded sample of labelled documents, a
word counts as toxic where it stands in a toxic document and occurs in toxic documents far more
often than chance allows (binomial tail, corrected for the number of words). A word occurrence
counts once per document and once per pair of neighbours, so copies add no evidence. The field is
then fitted on windows of those words by maximum likelihood: one emission weight per candidate
word, one shared weight for all other words, start and transition weights.

A text is scored whole. Between candidate words all emissions are equal, so the forward and
backward messages cross such a gap by a power of the transition matrix; this is exact. The
marginals of the toxic state give the offending words with their offsets, and three sums over them
go through a logistic function, fitted on the same sample, to the score of the document.

Defined cases: a null, empty or wordless text has no marginals and gets the score of a text without
toxic words; a null id is never sampled and not held out; conflicting labels of an id count as
toxic; null labels are left out; repeated documents each get a row and equal texts equal scores;
without any label, or with labels of one class only, every score is the smoothed share of toxic
labels (0.5 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respeval.llm.common import blocks

# Labelled documents the model is fitted on: the first of them in the order of a hash of the id.
SAMPLE_ROWS = 4000
# Bytes of text in the sample; a text that does not fit any more is left out whole.
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.3
WINDOW = 32

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Field:
    """Emission weights of the toxic state against the other, start and transition weights."""

    words: dict[str, int] = field(default_factory=dict)  # candidate word -> 1, 2, ...
    emission: list[float] = field(default_factory=lambda: [0.0])  # at 0: all other words
    start: float = 0.0
    step: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    logistic: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0])

    def __post_init__(self) -> None:
        self._power = lru_cache(maxsize=4096)(self._gap)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_power"}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def _gap(self, n: int) -> tuple[float, float, float, float]:
        """The messages' matrix over ``n`` other words and the step after them, scaled."""
        t = np.exp(np.array(self.step))
        m = t @ np.diag([1.0, math.exp(self.emission[0])])
        out, base = np.eye(2), m / m.max()
        while n:
            if n & 1:
                out = out @ base
                out /= out.max()
            base = base @ base
            base /= base.max()
            n >>= 1
        out = out @ t
        out /= out.max()
        return tuple(out.ravel().tolist())

    def marginals(self, at: list[int], codes: list[int], n: int) -> list[float]:
        """P(toxic) of the candidate words at the positions ``at`` of a text of ``n`` words."""
        e = [math.exp(self.emission[c]) for c in codes]
        other = math.exp(self.emission[0])
        gaps = [self._power(b - a - 1) for a, b in zip(at, at[1:], strict=False)]
        x, y = 1.0, math.exp(self.start)
        if at[0]:
            p = self._power(at[0] - 1)
            x, y = x, y * other
            x, y = x * p[0] + y * p[2], x * p[1] + y * p[3]
        forward = []
        for i, w in enumerate(e):
            if i:
                p = gaps[i - 1]
                x, y = x * p[0] + y * p[2], x * p[1] + y * p[3]
            y *= w
            x, y = x / (x + y), y / (x + y)
            forward.append((x, y))
        x = y = 1.0
        if rest := n - 1 - at[-1]:
            # After the last word of the text the step of the gap's matrix leads nowhere: undo it.
            p = self._power(rest - 1)
            x, y = p[0] + p[1] * other, p[2] + p[3] * other
        out = [0.0] * len(e)
        for i in range(len(e) - 1, -1, -1):
            a, b = forward[i]
            out[i] = b * y / (a * x + b * y)
            if i:
                p, v = gaps[i - 1], y * e[i]
                x, y = p[0] * x + p[1] * v, p[2] * x + p[3] * v
                x, y = x / (x + y), y / (x + y)
        return out

    def tag(self, text: str | None) -> tuple[int, list[int], list[float]]:
        """Number of words, positions of candidate words, their marginals."""
        lookup = self.words.get
        codes = [lookup(w, 0) for w in map(str.lower, _WORD.findall(text or ""))]
        at = [i for i, c in enumerate(codes) if c] if any(codes) else []
        return len(codes), at, self.marginals(at, [codes[i] for i in at], len(codes)) if at else []

    def score(self, n: int, marginals: list[float]) -> float:
        z = sum(w * x for w, x in zip(self.logistic, _sums(n, marginals), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sums(n: int, marginals: list[float]) -> tuple[float, float, float, float]:
    total = sum(marginals)
    return 1.0, math.log1p(total), max(marginals, default=0.0), math.log1p(100 * total / max(n, 1))


def _tail(k: int, n: int, p: float) -> float:
    """P(at least k of n) for a binomial, by its logarithms."""
    if k <= 0:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k, n + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def _evidence(sample: list[tuple[str, int]]) -> tuple[dict[str, int], set[str]]:
    """Candidate words, and those among them that label a word of a toxic document."""
    docs: dict[int, Counter] = {0: Counter(), 1: Counter()}
    around: dict[str, set] = defaultdict(set)
    for text, label in sample:
        docs[label].update({w.lower() for w in _WORD.findall(text)})
    often = {w for w, k in docs[1].items() if k >= 3}
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for text, label in sample:
        words = ["", *(w.lower() for w in _WORD.findall(text)), ""]
        first: dict[str, tuple[str, str]] = {}
        for before, w, after in zip(words, words[1:], words[2:], strict=False):
            if w in often and w not in first:
                first[w] = (before, after)
        for w, pair in first.items():
            if pair not in around[w]:
                around[w].add(pair)
                seen[label][w] += 1
    total = {k: sum(seen[k].values()) for k in seen}
    if not total[0] + total[1]:
        return {}, set()
    rate = min(0.95, max(0.01, sum(label for _, label in sample) / len(sample)))
    tails = {w: _tail(seen[1][w], seen[0][w] + seen[1][w], rate) * len(often) for w in often if seen[1][w]}
    candidates = sorted(w for w, t in tails.items() if t <= 50 and seen[1][w] > seen[0][w])
    return {w: i + 1 for i, w in enumerate(candidates)}, {w for w in candidates if tails[w] <= 0.5}


def _windows(sample, words, toxic) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of windows: all that hold a candidate, and one other of each document."""
    codes, labels = [], []
    for text, label in sample:
        found = [w.lower() for w in _WORD.findall(text)]
        code = [words.get(w, 0) for w in found]
        plain = True
        for i in range(0, len(code), WINDOW):
            part = code[i : i + WINDOW]
            if any(part) or plain and len(part) == WINDOW:
                plain = plain and any(part)
                pad = [-1] * (WINDOW - len(part))
                codes.append(part + pad)
                labels.append([int(label and w in toxic) for w in found[i : i + WINDOW]] + [0] * len(pad))
    return np.array(codes, dtype=np.int64), np.array(labels, dtype=np.int64)


def _fit_field(codes: np.ndarray, labels: np.ndarray, n_words: int, rounds: int = 200) -> np.ndarray:
    """Maximum likelihood by Adam. Parameters: start, 4 steps, emissions (other words first)."""
    theta = np.zeros(5 + n_words + 1)
    theta[5] = -3.0
    m = v = np.zeros_like(theta)
    real = codes >= 0
    for r in range(1, rounds + 1):
        gradient = -0.01 * theta
        emit = np.where(real, theta[5 + np.maximum(codes, 0)], 0.0)
        step = theta[1:5].reshape(2, 2)
        n, t_max = codes.shape
        alpha = np.zeros((t_max, n, 2))
        beta = np.zeros((t_max, n, 2))
        alpha[0, :, 1] = theta[0] + emit[:, 0]
        for t in range(1, t_max):
            new = np.logaddexp(alpha[t - 1, :, :1] + step[0], alpha[t - 1, :, 1:] + step[1])
            new[:, 1] += emit[:, t]
            alpha[t] = np.where(real[:, t, None], new, alpha[t - 1])
        for t in range(t_max - 2, -1, -1):
            ahead = beta[t + 1].copy()
            ahead[:, 1] += emit[:, t + 1]
            new = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
            beta[t] = np.where(real[:, t + 1, None], new, beta[t + 1])
        log_z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z).T  # of the toxic state
        wrong = np.where(real, labels - p, 0.0)
        gradient[0] += wrong[:, 0].sum()
        np.add.at(gradient, 5 + np.maximum(codes, 0), wrong)
        for a in (0, 1):
            for b in (0, 1):
                pair = alpha[:-1, :, a] + step[a, b] + beta[1:, :, b] + b * emit[:, 1:].T - log_z
                there = (labels[:, :-1] == a) & (labels[:, 1:] == b)
                gradient[1 + 2 * a + b] += np.where(real[:, 1:], there - np.exp(pair).T, 0.0).sum()
        gradient /= math.sqrt(n)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return theta


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w.tolist()


def fit(sample: list[tuple[str | None, int]]) -> Field:
    """The field and the logistic function for (text, label) pairs, in any order."""
    sample = sorted((t or "", int(y)) for t, y in sample)
    positive = sum(y for _, y in sample)
    share = (positive + 0.5) / (len(sample) + 1)
    base = [math.log(share / (1 - share)), 0.0, 0.0, 0.0]
    words, toxic = _evidence(sample) if 0 < positive < len(sample) else ({}, set())
    if not toxic:
        return Field(logistic=base)
    codes, labels = _windows(sample, words, toxic)
    theta = _fit_field(codes, labels, len(words)).tolist()
    out = Field(words, theta[5:], theta[0], [theta[1:3], theta[3:5]], base)
    x = np.array([_sums(n, p) for n, _, p in (out.tag(t) for t, _ in sample)])
    out.logistic = _fit_logistic(x, np.array([y for _, y in sample], dtype=float))
    return out


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic",
) -> Field:
    """Fit on the labelled documents that are not held out: at most ``sample_rows`` ids, as many texts, and
    ``SAMPLE_BYTES`` of text.

    Only the sample is brought to the driver; what it holds depends on ids and texts alone. A text of an id counts once,
    however often it is repeated. Of every document, all windows with a candidate word and one other are learned from.
    """
    key = F.col(f"`{id_col}`")
    known = labels.select(key.alias("id"), F.col(f"`{label_col}`").alias("label"))
    known = known.filter("id is not null and label is not null").filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").withColumn("digest", F.xxhash64("text"))
    sizes = rows.groupBy("id", "digest").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    sizes = sizes.orderBy(F.xxhash64("id"), "id", "digest").limit(sample_rows).collect()
    picked, left = [], SAMPLE_BYTES
    for r in sizes:
        if r["size"] <= left:
            picked.append((r["id"], r["digest"]))
            left -= r["size"]
    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("digest", T.LongType())])
    wanted = docs.sparkSession.createDataFrame(picked, kind)
    rows = rows.join(F.broadcast(wanted), ["id", "digest"]).dropDuplicates(["id", "digest"])
    return fit([(r.text, int(r.label > 0)) for r in rows.select("text", "label").collect()])


SPANS = "array<struct<start:int,end:int,p:double>>"


def tag_documents(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and the toxic words: offsets in code points (end exclusive), marginals >= 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_ = shared.value
        for block in blocks(batches):
            scores, spans = [], []
            for text in block.column("text").to_pylist():
                n, at, p = field_.tag(text)
                scores.append(field_.score(n, p))
                toxic = {i: x for i, x in zip(at, p, strict=True) if x >= 0.5}
                found = enumerate(_WORD.finditer(text)) if toxic else ()
                spans.append([{"start": m.start(), "end": m.end(), "p": toxic[i]} for i, m in found if i in toxic])
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(scores, pa.float64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))),
                ],
                names=["doc_id", "score", "spans"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, spans {SPANS}")


def drop_toxic(docs: DataFrame, model: Field, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field_ = shared.value
        for block in blocks(batches, text_col):
            tags = (field_.tag(t) for t in block.column(text_col).to_pylist())
            yield block.filter(pa.array([field_.score(n, p) < threshold for n, _, p in tags]))

    return docs.mapInArrow(run, docs.schema)
