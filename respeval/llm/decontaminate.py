"""Benchmark decontamination: windows of benchmark words, held as a broadcast hash set.

Words are the maximal runs of letters, digits and non-ASCII characters after lower-casing A-Z. A
window is ``width`` consecutive words of a benchmark item; an item with fewer words is one window.
Each document is scanned once: words outside the benchmark's vocabulary rule out most positions, a
rolling hash of the rest is looked up, and every hit is verified word by word.

The hash set is sent to all executors only up to ``max_words`` words of benchmark text. A larger
benchmark is cut into slices of that size by item, each scanned in a pass of its own, and the hit
words of all passes are united per text; the result is the same. One slice at a time is held, and what it
hit is stored before the next one.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no
windows; an item without id hits words but is not counted as an item; repeated
documents each get a row; repeated item ids count once; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.llm.common import blocks, id_and_text, stored
from respeval.sources.storage import broadcast_if_small

WIDTH = 10
# Words of benchmark text in one broadcast; about 100 bytes each in a worker.
MAX_WORDS = 1_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; bytes over 0x7F belong to characters that are in words."""
    return _WORD.findall(text.encode().lower()) if text else []


class WindowSet:
    """The windows of some items, by length and hash, with the items that hold them."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH) -> None:
        self.ids: dict[bytes, int] = {}
        self.width = width
        found: dict[int, dict[int, dict[tuple[int, ...], set]]] = {}
        for item, text in items:
            codes = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            size = min(width, len(codes))
            for at in range(len(codes) - size + 1 if size else 0):
                window = tuple(codes[at : at + size])
                by_hash = found.setdefault(size, {})
                by_hash.setdefault(self._hash(window), {}).setdefault(window, set()).add(item)
        self.windows = found
        self.hashes = {n: np.sort(np.array(list(h), dtype=np.uint64)) for n, h in found.items()}

    @staticmethod
    def _hash(window: tuple[int, ...]) -> int:
        value = 0
        for code in window:
            value = (value * _BASE + code) & _MASK
        return value

    def scan(self, codes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """Starts, lengths and items of all occurrences; ``doc`` numbers the document of a word."""
        for size, hashes in self.hashes.items():
            n = len(codes) - size + 1
            if n <= 0:
                continue
            known = np.concatenate(([0], np.cumsum(codes != 0)))
            full = (known[size:] - known[:-size] == size) & (doc[size - 1 :] == doc[:n])
            starts = np.flatnonzero(full)
            value = np.zeros(len(starts), dtype=np.uint64)
            for k in range(size):
                value = value * np.uint64(_BASE) + codes[starts + k].astype(np.uint64)
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            hit = hashes[at] == value
            for start, h in zip(starts[hit].tolist(), value[hit].tolist(), strict=True):
                items = self.windows[size][h].get(tuple(codes[start : start + size].tolist()))
                if items:
                    yield start, size, items


def _scan_block(texts: list[str | None], windows: WindowSet):
    """Per document: number of words, hit mask, items."""
    lookup = windows.ids.get
    coded = [[lookup(w, 0) for w in words_of(t)] for t in texts]
    counts = np.array([len(c) for c in coded], dtype=np.int64)
    codes = np.fromiter((c for one in coded for c in one), dtype=np.int64, count=int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    items: dict[int, set] = {}
    edges = np.zeros(len(codes) + 1, dtype=np.int64)
    for start, size, found in windows.scan(codes, doc):
        edges[start] += 1
        edges[start + size] -= 1
        items.setdefault(int(doc[start]), set()).update(found)
    mask = np.cumsum(edges[:-1]) > 0
    return counts, mask, items


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()


def _slices(
    benchmark: DataFrame, item_col: str, text_col: str, width: int, max_words: int
) -> tuple[int, Iterator[WindowSet]]:
    """How many window sets there are, and the sets one by one: each of at most ``max_words`` words (or a
    single longer item). Only the one that is asked for is held."""
    items = id_and_text(benchmark, item_col, text_col)
    size = F.coalesce(F.octet_length("text"), F.lit(0)) / 2 + 1
    total = items.agg(F.sum(size)).first()[0] or 0
    n = int(total // max_words) + 1
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))

    def sets() -> Iterator[WindowSet]:
        for i in range(n):
            rows = (items if n == 1 else items.filter(part == i)).collect()
            yield WindowSet([(r.doc_id, r.text) for r in rows], width)

    return n, sets()


REPORT = (
    "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Words, hit words and occurring items of every document.

    A benchmark of one slice needs a single narrow pass. Otherwise the hits of every slice are stored by the digest
    of the text before the next slice is built, and united where they meet the documents.
    """
    rows = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    n, slices = _slices(benchmark, item_col, item_text_col, width, max_words)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    if n == 1:
        shared = spark.sparkContext.broadcast(next(slices))

        def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                counts, mask, items = _scan_block(block.column("text").to_pylist(), shared.value)
                ends = np.concatenate(([0], np.cumsum(counts)))
                sums = np.concatenate(([0], np.cumsum(mask)))
                hits = sums[ends[1:]] - sums[ends[:-1]]
                found = [items.get(i, set()) - {None} for i in range(block.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"),
                        pa.array(counts),
                        pa.array(hits),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([_digest(f) for f in found], pa.string()),
                        pa.array(hits > 0),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

        return rows.mapInArrow(report, REPORT.format(id=id_type))

    found = _hits_of_slices(rows, slices)
    joined = rows.withColumn("key", _text_key("text")).join(found, "key", "left").select("doc_id", "text", "marks", "items")

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts, marks, items = (block.column(c).to_pylist() for c in ("text", "marks", "items"))
            counts = [len(_WORD.findall((t or "").encode().lower())) for t in texts]
            hits = np.array([0 if m is None else int(_united(m).sum()) for m in marks], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(hits),
                    pa.array([len(i or ()) for i in items], pa.int64()),
                    pa.array([_digest(i or ()) for i in items], pa.string()),
                    pa.array(hits > 0),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return joined.mapInArrow(united, REPORT.format(id=id_type))


def _text_key(name: str) -> Column:
    return F.sha2(F.col(f"`{name}`"), 256)


def _united(marks: list[bytes]) -> np.ndarray:
    """One bit per word, set if any of the marks has it."""
    bits = np.bitwise_or.reduce([np.frombuffer(m, dtype=np.uint8) for m in marks])
    return np.unpackbits(bits)


def _hits_of_slices(rows: DataFrame, slices: Iterator[WindowSet]) -> DataFrame:
    """key, marks (bits of the hit words, one entry per slice) and items of all texts with hits.

    One slice at a time is built, broadcast and scanned; its hits are stored, a row per text, before the next one.
    """
    texts = rows.select("text", _text_key("text").alias("key"))
    all_hits = None
    for part in slices:
        shared = rows.sparkSession.sparkContext.broadcast(part)

        def hits(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                counts, mask, items = _scan_block(block.column("text").to_pylist(), shared.value)
                ends = np.concatenate(([0], np.cumsum(counts)))
                at = sorted(items)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("key").take(pa.array(at, pa.int64())),
                        pa.array([np.packbits(mask[ends[i] : ends[i + 1]]).tobytes() for i in at], pa.binary()),
                        pa.array([[str(x) for x in items[i] - {None}] for i in at], pa.list_(pa.string())),
                    ],
                    names=["key", "mark", "items"],
                )

        one = texts.mapInArrow(hits, "key string, mark binary, items array<string>").dropDuplicates(["key"])
        one = stored(one, "hits")
        shared.destroy()
        all_hits = one if all_hits is None else all_hits.unionByName(one)
    united = all_hits.groupBy("key").agg(
        F.collect_list("mark").alias("marks"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return broadcast_if_small(united)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WIDTH,
    max_words: int = MAX_WORDS, item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The documents without any hit, with all their columns.

    One narrow pass for a benchmark of one slice; else the texts with hits are found slice by slice, and left out.
    """
    n, slices = _slices(benchmark, item_col, item_text_col, width, max_words)
    if n > 1:
        rows = docs.select(F.col(f"`{text_col}`").alias("text"))
        found = _hits_of_slices(rows, slices).select(F.col("key").alias("__key"))
        return docs.join(found, _text_key(text_col) == F.col("__key"), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(next(slices))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            _, _, items = _scan_block(block.column(text_col).to_pylist(), shared.value)
            yield block.filter(pa.array([i not in items for i in range(block.num_rows)]))

    return docs.mapInArrow(clean, docs.schema)


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WIDTH,
    max_words: int = MAX_WORDS, item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """All documents, their hit words cut out of the text; other columns unchanged.

    Every slice is scanned in the whole text, one after the other; the hits of all are cut out together.
    """
    marks = "__hits"
    while marks in docs.columns:
        marks += "_"
    _, slices = _slices(benchmark, item_col, item_text_col, width, max_words)
    found = _hits_of_slices(docs.select(F.col(f"`{text_col}`").alias("text")), slices)
    found = found.select(F.col("key").alias(f"{marks}_key"), F.col("marks").alias(marks))
    kept = docs.join(found, _text_key(text_col) == F.col(f"{marks}_key"), "left").drop(f"{marks}_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            texts, bits = (block.column(c).to_pylist() for c in (text_col, marks))
            for i, hits in enumerate(bits):
                if hits is None:
                    continue
                raw, low = texts[i].encode(), texts[i].encode().lower()
                mask = _united(hits)
                out, at = [], 0
                for hit, m in zip(mask.tolist(), _WORD.finditer(low), strict=False):
                    if hit:
                        out.append(raw[at : m.start()])
                        at = m.end()
                texts[i] = b"".join([*out, raw[at:]]).decode()
            place = block.schema.get_field_index(text_col)
            field = block.schema.field(place)
            block = block.set_column(place, field, pa.array(texts, field.type))
            yield block.select([n for n in block.schema.names if n != marks])

    return kept.mapInArrow(cut, docs.schema)
