"""Secret scan: three fixed patterns, and a battery of randomness tests on other long tokens.

A candidate is a run of 20 or more characters of the base64 family. Its encoding is inferred from
its characters (hex, base32, base64), and the battery tests the values its characters have in that
encoding:

- uniformity: a chi-squared statistic over ranges of the alphabet;
- runs: the number of runs above and below the middle of the alphabet (Wald and Wolfowitz);
- serial correlation: of neighbouring values.

A candidate is random if none of the three rejects randomness, and if its chi-squared is too small
for text in the same alphabet: the probability of so small a statistic under the distribution of
text (a non-central chi-squared, whose centre grows with the length) is its p-value. Within each
stratum of encoding and length, Benjamini and Hochberg's procedure on these p-values over the whole
corpus bounds the share of false discoveries, so short tokens need more evidence than long ones.
The p-values are counted in a fixed grid, so the corpus needs one small aggregate.

Defined cases: a null text is empty and has no spans; spans never cross texts; equal rows each get
a row; an empty table gives an empty table. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.llm.common import blocks, id_and_text, stored

KINDS = ("assign", "access", "hex", "random")
FALSE_DISCOVERIES = 0.01
REJECT = 0.001  # level of the three tests against randomness

_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
# Runs shorter than the bound fail; for these two kinds a bound in the pattern finds the same runs.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_KEYWORDS = ("passw", "secret", "token", "api")

# Alphabets, cut into ranges of the chi-squared test, and the shares of text in those ranges.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ENCODINGS = {
    "hex": (["01", "23", "45", "67", "89", "ab", "cd", "ef"], [0.2, 0.2, 0.2, 0.2, 0.2, 0, 0, 0]),
    "base32": (["ABCD", "EFGH", "IJKL", "MNOP", "QRST", "UVWXYZ", "234567"], [0.17, 0.23, 0.12, 0.19, 0.21, 0.08, 0]),
    "base64": (
        [_UPPER[:13], _UPPER[13:], _LOWER[:7], _LOWER[7:13], _LOWER[13:20], _LOWER[20:], _DIGITS],
        [0.02, 0.02, 0.35, 0.19, 0.33, 0.07, 0.02],
    ),
}
_STEPS = 300  # of the grid of p-values, a tenth of a decimal power each


def _prepare(ranges: list[str], text: list[float]):
    place = {c: i for i, r in enumerate(ranges) for c in r}
    order = {c: i for i, c in enumerate("".join(ranges))}
    even = [len(r) / len(order) for r in ranges]
    # How far text is from uniform: the non-centrality per character.
    far = sum((q - u) ** 2 / u for q, u in zip(text, even, strict=True))
    return place, order, even, far


_TESTS = {name: _prepare(*parts) for name, parts in _ENCODINGS.items()}


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds a token; None for tokens of one character class."""
    token = token.rstrip("=")
    for low in (token, token.lower() if token.upper() == token else token):
        if all(c in _TESTS["hex"][0] for c in low):
            return "hex"
    if all(c in _TESTS["base32"][0] for c in token):
        return "base32"
    classes = (any(map(str.isupper, token)), any(map(str.islower, token)), any(map(str.isdigit, token)))
    return "base64" if sum(classes) >= 2 else None


def _normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _chi2_cdf(x: float, k: int, centre: float = 0.0) -> float:
    """Sankaran's normal approximation to the (non-central) chi-squared distribution."""
    s = k + centre
    h = 1 - 2 * s * (k + 3 * centre) / (3 * (k + 2 * centre) ** 2)
    p = (k + 2 * centre) / s**2
    m = (h - 1) * (1 - 3 * h)
    middle = 1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p)
    spread = h * math.sqrt(2 * p) * math.sqrt(max(1e-12, 1 + 0.5 * m * p)) if 1 + 0.5 * m * p > 0 else 1e-6
    return _normal_cdf((((x / s) ** h if x > 0 else 0.0) - middle) / spread)


def battery(token: str, name: str) -> tuple[float, float, float, float]:
    """p-values: uniformity, runs and serial correlation under randomness; uniformity under text."""
    place, order, even, far = _TESTS[name]
    if name == "hex" and token.upper() == token:
        token = token.lower()
    values = [order[c] for c in token if c in order]
    n = len(values)
    if n < 8:
        return 0.0, 0.0, 0.0, 1.0
    counts = [0] * len(even)
    for c in token:
        if c in place:
            counts[place[c]] += 1
    chi2 = sum((k - n * u) ** 2 / (n * u) for k, u in zip(counts, even, strict=True))
    freedom = len(even) - 1
    uniform = 1 - _chi2_cdf(chi2, freedom)
    text = max(1e-30, _chi2_cdf(chi2, freedom, n * far))
    half = len(order) / 2
    high = [v >= half for v in values]
    a = sum(high)
    b = n - a
    if not a or not b:
        return uniform, 0.0, 0.0, text
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 2 * a * b / n + 1
    spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    runs_p = 2 * _normal_cdf(-abs(runs - mean) / spread)
    middle = sum(values) / n
    total = sum((v - middle) ** 2 for v in values)
    lag = sum((x - middle) * (y - middle) for x, y in zip(values, values[1:], strict=False))
    z = (lag / total + 1 / n) * math.sqrt(n) if total else 99.0
    return uniform, runs_p, 2 * _normal_cdf(-abs(z)), text


def _length_class(n: int) -> int:
    """20-23, 24-31, 32-47, 48-63, 64-127, longer."""
    return sum(n >= x for x in (24, 32, 48, 64, 128))


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans (start, kind, end), and random-looking candidates (start, end, stratum, step)."""
    base, found = [], []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    at = 0
    for word in text.split():
        if len(word) < 16:
            continue
        at = text.index(word, at)
        base += [(at + m.start(), 1, at + m.end()) for m in _ACCESS.finditer(word)]
        base += [(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(word)]
        for m in _CANDIDATE.finditer(word):
            name = encoding(m.group())
            if name is None:
                continue
            uniform, runs, serial, p = battery(m.group(), name)
            step = min(_STEPS - 1, int(-10 * math.log10(p)))
            stratum = 6 * list(_TESTS).index(name) + _length_class(len(m.group()))
            # A token that the battery rejects stays in the procedure as the largest p-value.
            passed = min(uniform, runs, serial) >= REJECT
            found.append((at + m.start(), at + m.end(), stratum, step if passed else 0))
        at += len(word)
    return sorted(base), found


def thresholds(candidates: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Per stratum the first step of the grid from which on candidates are discoveries.

    ``candidates`` has columns stratum and step; the driver gets at most 18 x 300 counts.
    """
    counts: dict[int, list[int]] = {}
    for r in candidates.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.stratum, [0] * _STEPS)[r.step] = r.n
    out = {}
    for stratum, by_step in counts.items():
        total, above = sum(by_step), 0
        for step in range(_STEPS - 1, 0, -1):
            above += by_step[step]
            # All p-values of this step and beyond are at most 10 ** (-step / 10).
            if above and 10 ** (-step / 10) * total <= rate * above:
                out[stratum] = step
    return out


_FOUND = "array<struct<start:int,end:int,stratum:int,step:int>>"


def secret_spans(
    docs: DataFrame, rate: float = FALSE_DISCOVERIES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, base (array of spans of the fixed patterns) and random (spans of the battery).

    Texts are scanned once; spans and candidates are stored, without the texts, because the
    thresholds need all candidates of the corpus.
    """
    rows = id_and_text(docs, id_col, text_col)
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    candidate = pa.struct([(c, pa.int32()) for c in ("start", "end", "stratum", "step")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            both = [scan(t or "") for t in block.column("text").to_pylist()]
            base = [[dict(zip(("start", "kind", "end"), s, strict=True)) for s in b] for b, _ in both]
            found = [[dict(zip(("start", "end", "stratum", "step"), s, strict=True)) for s in c] for _, c in both]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(candidate))],
                names=["doc_id", "base", "found"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    spans = stored(
        rows.mapInArrow(run, f"doc_id {id_type}, base array<struct<start:int,kind:int,end:int>>, found {_FOUND}"),
        "secrets",
    )
    first = thresholds(spans.select(F.explode("found").alias("c")).select("c.stratum", "c.step"), rate)
    pairs = [F.lit(x) for k, v in sorted(first.items()) for x in (k, v)]
    step = F.create_map(*pairs) if pairs else F.create_map().cast("map<int,int>")
    random = F.filter("found", lambda c: c.step >= F.coalesce(step[c.stratum], F.lit(_STEPS)))
    # A candidate inside or across a base span is the same secret.
    random = F.filter(
        random,
        lambda c: ~F.exists("base", lambda b: (b.start < c.end) & (c.start < b.end)),
    )
    return spans.select(
        "doc_id",
        "base",
        F.transform(
            random, lambda c: F.struct(c.start.alias("start"), F.lit(3).alias("kind"), c.end.alias("end"))
        ).alias("random"),
    )


def span_list(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string")),
        ),
        ",",
    )


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """A text with its spans replaced; overlapping spans are replaced once."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
