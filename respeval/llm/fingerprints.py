"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. On each level runs of one symbol are joined, deterministic coin tossing
labels every symbol from its bits and those of its left neighbours until labels are below eight and
neighbours differ, and local maxima of the labels begin phrases. A phrase is named by a hash of its
symbols, and names are the symbols of the next level. Where phrases begin depends on a bounded number
of symbols around, so equal substrings have equal names inside, wherever they stand.

A fingerprint is the ``SIZE`` smallest hashes of the phrase names of the upper levels, each of which
stands for some dozen code points; the likeness of two fingerprints estimates the share of the phrases
of both that both texts have.

Whole texts are parsed, many at once: the steps are array operations over the texts of a block, in
which the ends of texts are ends of phrases.

Defined cases: a null text is empty; an empty text's fingerprint is the empty string, alike only to
another empty one; texts too short for the upper levels have the hash of the whole text; documents
with the same id follow each other in the order of their digests, null ids come last; the only
document is its own neighbour; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from respeval.llm.common import BLOCK_CHARS, blocks, id_and_text, range_cuts, with_range

# Hashes in a fingerprint, of 32 bits each.
SIZE = 32
LEVELS = 3
LOWEST = 2  # the first level whose names are in the fingerprint
# Code points that are parsed together, so that the arrays stay in a core's cache.
PARSED_CHARS = 1 << 17
# Bytes of text in a range of neighbours, which one task sorts.
RANGE_BYTES = 16 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


# Factors of the symbols of a phrase by their place in it; places beyond take them in turn.
_FACTORS = _mix(np.arange(1, 65, dtype=_U)) | _U(1)


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below eight, different for neighbours; ``first`` has the places of texts' first symbols."""
    one = symbols.dtype.type(1)
    other = symbols[1:] ^ symbols[:-1]
    # The lowest bit in which a symbol differs from its left neighbour, and its value there.
    label = np.empty(len(symbols), dtype=np.uint8)
    bit = np.bitwise_count((other & -other) - one)
    label[1:] = 2 * bit + ((symbols[1:] >> bit) & one).astype(np.uint8)
    label[first] = symbols[first] & one
    for _ in range(2):  # from below 128 to below 14, then 8
        other = label[1:] ^ label[:-1]
        bit = np.bitwise_count((other & -other) - np.uint8(1))
        new = np.empty_like(label)
        new[1:] = 2 * bit + ((label[1:] >> bit) & np.uint8(1))
        new[first] = label[first] & np.uint8(1)
        label = new
    return label


def _parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level, and the places of the first ones of texts."""
    new = np.empty(len(symbols), dtype=bool)
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[first] = True
    if not new.all():
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(symbols)))
        first = np.searchsorted(starts, first)
        symbols = symbols[starts].astype(_U)
        runs = np.flatnonzero(lengths > 1)
        symbols[runs] = _mix(symbols[runs] + _U(0x9E3779B97F4A7C15) * lengths[runs].astype(_U))
    label = _toss(symbols, first)
    # Local maxima; the ends of a text are none.
    begins = np.zeros(len(symbols), dtype=bool)
    begins[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    begins[first[1:] - 1] = False
    begins[first] = True
    starts = np.flatnonzero(begins)
    place = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    names = np.add.reduceat((symbols + _U(1)) * _FACTORS[place & 63], starts)
    return _mix(names), np.searchsorted(starts, first)


def phrase_names(texts: list[str], levels: int = LEVELS, lowest: int = LOWEST) -> list[np.ndarray]:
    """The distinct names of each text's phrases on the levels from ``lowest`` on."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    full = np.flatnonzero(lengths)
    out = [np.zeros(0, dtype=_U) for _ in texts]
    if not len(full):
        return out
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    first = np.concatenate(([0], np.cumsum(lengths[full])[:-1]))
    found, firsts = [], []
    for level in range(1, levels + 1):
        symbols, first = _parse(symbols, first)
        if level >= lowest:
            found.append(symbols + _U(level))
            firsts.append(np.append(first, len(symbols)).tolist())
    for k, i in enumerate(full.tolist()):
        out[i] = np.unique(np.concatenate([f[a[k] : a[k + 1]] for f, a in zip(found, firsts, strict=True)]))
    return out


def fingerprints(texts: list[str], size: int = SIZE) -> list[str]:
    """Hexadecimal fingerprints, eight digits for each of at most ``size`` smallest hashes."""
    out, at = [], 0
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to]) <= PARSED_CHARS):
            chars += len(texts[to])
            to += 1
        small = [np.unique(n[: 2 * size] >> _U(32))[:size].astype(">u4") for n in phrase_names(texts[at:to])]
        out += [s.tobytes().hex() for s in small]
        at = to
    return out


def likeness(a: str, b: str, size: int = SIZE) -> float:
    """Share of common hashes among the ``size`` smallest of both fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x = {a[i : i + 8] for i in range(0, len(a), 8)}
    y = {b[i : i + 8] for i in range(0, len(b), 8)}
    both = sorted(x | y)[:size]
    return sum(h in x and h in y for h in both) / len(both)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every document; narrow, without a shuffle."""
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = [t or "" for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(fingerprints(texts), pa.string()),
                ],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text, its last third replaced by as many first code points of another (or all of it)."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


EDITS = (
    "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How alike every document is to its edited text and to the next document, descending by id.

    Documents are dealt out once, in ranges of the id and a hash of the text, a range to a task. The first
    document of each range is sent to the range before it as well, so that every task has the neighbour of its
    last document; the first of all goes to the last range. Ids may be of any type that Spark orders.
    """
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", "tie"]
    rows = with_range(rows, order, range_cuts(rows, order, int(size // RANGE_BYTES) + 8))
    # One row per range: its first document and the range before it.
    heads = rows.groupBy("part").agg(F.max(F.struct(*order)).alias("head")).orderBy("part").collect()
    parts = [r["part"] for r in heads]
    ends = [
        (r["part"], r["head"]["doc_id"], r["head"]["tie"], parts[(i + 1) % len(parts)]) for i, r in enumerate(heads)
    ]
    kind = T.StructType.fromDDL("of int, head_tie long, to int")
    kind = T.StructType([kind["of"], T.StructField("head_id", id_type), kind["head_tie"], kind["to"]])
    ends = docs.sparkSession.createDataFrame(ends, kind)
    is_head = (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    rows = rows.join(F.broadcast(ends), is_head, "left")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    guest = F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), F.lit(1).alias("guest")))
    rows = rows.select("doc_id", "text", "tie", F.inline(F.array_compact(F.array(own, guest))))
    dealt = rows.repartitionById(max(parts, default=0) + 1, F.col("part")).sortWithinPartitions(
        "part", "guest", F.desc("doc_id"), F.desc("tie")
    )

    def work(waiting: list[tuple], following: str | None) -> pa.RecordBatch:
        texts = [t for _, t in waiting]
        after = [*texts[1:], following if following is not None else texts[0]]
        changed = [edited(t, n) for t, n in zip(texts, after, strict=True)]
        own = fingerprints([*texts, after[-1]])
        other = fingerprints(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in waiting], arrow_id),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(own[:-1], pa.string()),
                pa.array(other, pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # documents of the current range, until their neighbour is known
        size, part, done = 0, None, False
        for batch in batches:
            ids, texts, parts_, guests = (batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "guest"))
            for i, text, p, guest in zip(ids, texts, parts_, guests, strict=True):
                if p != part:
                    part, done = p, False
                if guest:
                    if not done and waiting:
                        yield work(waiting, text)
                        waiting, size, done = [], 0, True
                    continue
                if size >= BLOCK_CHARS:
                    yield work(waiting, text)
                    waiting, size = [], 0
                waiting.append((i, text))
                size += len(text)
        if waiting:
            yield work(waiting, None)

    return dealt.select("doc_id", "text", "part", "guest").mapInArrow(run, EDITS.format(id=id_type.simpleString()))
