"""Alignment of two tokenizers' tokens over the bytes of every text.

Both tokenizers encode a text; their tokens become ranges of bytes of one and the same string. In
batches of texts, keyed by document, ``merge_asof`` finds for the start of every token the token of the
other side that covers it. A pair of tokens that overlap begins with the start of one of them, so both
directions together hold each overlap. Overlapping tokens with equal ends close a group: a stretch of
bytes that both sides cut out. Tokens of one group are linked, each of one side with each of the other.

A pair of ids counts in how many documents it is linked. Pairs are reduced per document, added up
per task and then over all tasks. The most frequent pairs, a fixed number, are broadcast with their
counts; a document's other pairs, none of which is frequent, meet theirs in a join. What is best
for an id of the first side is one row per entry of its vocabulary, and is broadcast.

Defined cases: a text that is null or empty, or whose tokens do not give back the bytes of the text
(with the space in front), has no tokens: zeros and empty lists. Strings of special tokens are plain
text. Texts are never cut. Repeated rows each get a row and count as documents; an empty table
gives an empty table; other columns are ignored. A group of many tokens is expanded in pieces of
bounded size, of which only different pairs of ids stay.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respeval.llm.common import blocks, most_frequent, stored

# Fixed value: how a byte-level vocabulary cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the sign for a space in pieces.
SPACE = "▁"
# Pairs of ids that are broadcast with their counts.
FREQUENT_PAIRS = 1_000_000
# Links expanded, and different pairs counted by a task, at once.
LINKS_AT_ONCE = 1 << 21
PAIRS_AT_ONCE = 1 << 21
# Ids of both sides and the number of a document in a batch share 62 bits.
ID_BITS = 21
DOCUMENTS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer as data: what its library needs, and the bytes of every id.

    ``kind`` is "byte_level" (ranks of byte strings) or "sentencepiece" (a serialised model).
    """

    kind: str
    data: object
    pieces: tuple[bytes, ...]

    def encoder(self) -> Callable[[list[str]], list[np.ndarray]]:
        if self.kind == "byte_level":
            import tiktoken

            coder = tiktoken.Encoding("vocabulary", pat_str=WORDS, mergeable_ranks=self.data, special_tokens={})
            return lambda texts: [coder.encode_to_numpy(t, disallowed_special=()) for t in texts]
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return lambda texts: [np.array(i, np.int32) for i in model.encode(texts, num_threads=1)]


def _byte_of() -> dict[str, int]:
    """Which byte a character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_byte_level(path: str) -> Tokenizer:
    """A byte-level BPE vocabulary from a .json file whose ids follow the order of its merges.

    Then the ids are the ranks that merges go by. Raises for files that normalise, add spaces or pair
    ids otherwise.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, cut = whole["model"], whole["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
    if whole["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges") or not plain:
        raise ValueError("only plain byte-level BPE is covered")
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items()}
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if [model["vocab"][a + b] for a, b in merged] != list(range(256, 256 + len(merged))):
        raise ValueError("the ids do not follow the merges")
    pieces = [b""] * (max(ranks.values()) + 1)
    for word, i in ranks.items():
        pieces[i] = word
    return Tokenizer("byte_level", ranks, tuple(pieces))


def read_sentencepiece(path: str) -> Tokenizer:
    """A sentencepiece model; it puts a space in front of texts if it was made to."""
    import sentencepiece

    with open(path, "rb") as file:
        data = file.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=data)

    def piece(i: int) -> bytes:
        text = model.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace(SPACE, " ").encode()

    return Tokenizer("sentencepiece", data, tuple(piece(i) for i in range(model.get_piece_size())))


class Side:
    """One tokenizer at work: ids and ends of the tokens of some texts."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.pieces, self.encode = tokenizer.pieces, tokenizer.encoder()
        self.lossless = tokenizer.kind == "byte_level"
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        signs = [f"{i}{end}".encode() for i in range(len(self.pieces)) for end in ",|;"]
        self.signs = np.array(signs, "S")  # an id with what follows it
        self.sign_sizes = np.array([len(s) for s in signs], np.int64)

    def gives_back(self, ids: np.ndarray, whole: bytes) -> bool:
        """Whether the bytes of the tokens are the whole; byte-level ranks only ever cut them."""
        return self.lossless or b"".join(map(self.pieces.__getitem__, ids.tolist())) == whole


def _frame(side: Side, ids: list[np.ndarray]) -> pd.DataFrame:
    """Tokens with their document and their byte range, counted through all documents of a batch."""
    flat = np.concatenate([*ids, np.zeros(0, np.int32)])
    sizes = side.sizes[flat]
    end = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(i) for i in ids])
    return pd.DataFrame({"doc": doc, "start": end - sizes, "end": end, "id": flat}, copy=False)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All pairs (a, b) of numbers of overlapping tokens, from both directions, each once."""
    left, right = a[["doc", "start"]], b[["doc", "start"]]
    # Starts increase, also from document to document, so neither side needs sorting. What covers a
    # start is always there, as both sides cover the same bytes.
    covered = pd.merge_asof(left, right.assign(b=np.arange(len(b))), on="start", by="doc")["b"].to_numpy()
    covering = pd.merge_asof(right, left.assign(a=np.arange(len(a))), on="start", by="doc")["a"].to_numpy()
    # Two tokens with one start are found in both directions.
    later = np.flatnonzero(a["start"].to_numpy()[covering] != b["start"].to_numpy())
    return pd.DataFrame(
        {"a": np.concatenate([np.arange(len(a)), covering[later]]), "b": np.concatenate([covered, later])}, copy=False
    )


@dataclass
class Aligned:
    """Tokens of both sides of a batch, their overlaps, and the number of each token's group."""

    a: pd.DataFrame
    b: pd.DataFrame
    overlaps: pd.DataFrame
    group_a: np.ndarray
    group_b: np.ndarray
    group_doc: np.ndarray


def align(a: pd.DataFrame, b: pd.DataFrame) -> Aligned:
    pairs = overlaps(a, b)
    end_a, end_b = a["end"].to_numpy(), b["end"].to_numpy()
    closing = np.sort(pairs["a"].to_numpy()[end_a[pairs["a"]] == end_b[pairs["b"]]])
    ends = end_a[closing]
    return Aligned(
        a, b, pairs, np.searchsorted(ends, end_a), np.searchsorted(ends, end_b), a["doc"].to_numpy()[closing]
    )


def linked_pairs(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """Different (document, id of a, id of b) of linked tokens, packed and sorted, with the numbers of links."""
    n_groups = len(x.group_doc)

    def reduced(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different (group, id) in order with their numbers, and how many there are of each group."""
        keys, times = np.unique((group << ID_BITS) | ids, return_counts=True)
        return keys, times, np.bincount(keys >> ID_BITS, minlength=n_groups)

    keys_a, times_a, _ = reduced(x.group_a, x.a["id"].to_numpy())
    keys_b, times_b, each_b = reduced(x.group_b, x.b["id"].to_numpy())
    if not n_groups:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first_b = np.cumsum(each_b) - each_b
    mask = (1 << ID_BITS) - 1
    group, id_a = keys_a >> ID_BITS, keys_a & mask
    sizes = each_b[group]
    doc = x.group_doc.astype(np.int64)[group] << (2 * ID_BITS)
    found_keys, found_times = [], []
    at, upto = 0, np.cumsum(sizes)
    while at < len(keys_a):
        # Rows of one expansion: whole entries of a, and one of them at least.
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS_AT_ONCE, side="right")))
        size = sizes[at:to]
        own = np.repeat(np.arange(at, to), size)
        other = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first_b[group[own]]
        packed = doc[own] | (id_a[own] << ID_BITS) | (keys_b[other] & mask)
        keys, places = np.unique(packed, return_inverse=True)
        found_keys.append(keys)
        # The sums are whole numbers far below 2^53.
        found_times.append(np.bincount(places, times_a[own] * times_b[other], len(keys)).astype(np.int64))
        at = to
    return _merged(found_keys, found_times)


def _merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys with the sums of their numbers."""
    if len(keys) == 1:
        return keys[0], times[0]
    key, n = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*times, np.zeros(0, np.int64)])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _digests(x: Aligned, a: Side, b: Side, n_docs: int) -> list[str]:
    """SHA-256 of the groups' ids, ``a1,a2|b1;a3|b2,b3``, per document; '' without tokens."""
    n_groups = len(x.group_doc)
    n_a, n_b = np.bincount(x.group_a, minlength=n_groups), np.bincount(x.group_b, minlength=n_groups)
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    # A token's place: what stands before it on its own side, and the other side's earlier groups.
    place_a = np.arange(len(x.a)) + (ends_b - n_b)[x.group_a]
    place_b = np.arange(len(x.b)) + ends_a[x.group_b]
    follow_a = np.zeros(len(x.a), np.int64)
    follow_a[ends_a - 1] = 1
    follow_b = np.zeros(len(x.b), np.int64)
    follow_b[ends_b - 1] = 2
    width = max(a.signs.itemsize, b.signs.itemsize)
    cells = np.zeros(len(x.a) + len(x.b), f"S{width}")
    sizes = np.zeros(len(cells), np.int64)
    sign_a, sign_b = 3 * x.a["id"].to_numpy() + follow_a, 3 * x.b["id"].to_numpy() + follow_b
    cells[place_a], sizes[place_a] = a.signs[sign_a], a.sign_sizes[sign_a]
    cells[place_b], sizes[place_b] = b.signs[sign_b], b.sign_sizes[sign_b]
    grid = cells.view(np.uint8).reshape(len(cells), width)
    text = memoryview(grid[np.arange(width) < sizes[:, None]])
    tokens = np.bincount(x.a["doc"], minlength=n_docs) + np.bincount(x.b["doc"], minlength=n_docs)
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(tokens)])]
    # The last sign of a document has nothing to separate.
    return [
        hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:], strict=False)
    ]


def align_texts(texts: list[str | None], a: Side, b: Side, prefix: str = " ") -> Aligned:
    """Align a batch; texts without tokens have none on either side."""
    given = [t or "" for t in texts]
    all_a, all_b = a.encode([prefix + t for t in given]), b.encode(given)
    none = np.zeros(0, np.int32)
    ids_a, ids_b = [], []
    for text, i, j in zip(given, all_a, all_b, strict=True):
        whole = (prefix + text).encode()
        fine = text and b.gives_back(j, whole) and a.gives_back(i, whole)
        ids_a.append(i if fine else none)
        ids_b.append(j if fine else none)
    return align(_frame(a, ids_a), _frame(b, ids_b))


_SIDES: dict[str, tuple[Side, Side]] = {}


def _sides(shared) -> tuple[Side, Side]:
    """The tokenizers, made ready once per worker."""
    name, a, b = shared.value
    if name not in _SIDES:
        _SIDES.clear()
        _SIDES[name] = (Side(a), Side(b))
    return _SIDES[name]


def _checked(a: Tokenizer, b: Tokenizer) -> tuple[str, Tokenizer, Tokenizer]:
    if max(len(a.pieces), len(b.pieces)) > 1 << ID_BITS:
        raise ValueError(f"vocabularies of more than {1 << ID_BITS} entries")
    return uuid.uuid4().hex, a, b


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        for at in range(0, block.num_rows, DOCUMENTS_AT_ONCE):
            yield block.slice(at, DOCUMENTS_AT_ONCE)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def overlapping_tokens(
    docs: DataFrame, a: Tokenizer, b: Tokenizer, prefix: str = " ", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and, for every document, its tokens of both sides and its overlaps.

    ``tokens_a`` and ``tokens_b`` are (id, start, end, group) with byte offsets in prefix + text, end
    exclusive; ``overlaps`` are pairs of numbers of tokens, from 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_checked(a, b))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ("id", "start", "end", "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _sides(shared)
        for block in _text_blocks(batches):
            texts = block.column("text").to_pylist()
            x = align_texts(texts, one, two, prefix)
            x.overlaps.sort_values(["a", "b"], inplace=True)
            first = np.searchsorted(x.a["doc"], np.arange(len(texts)))
            bases = np.concatenate([x.a["start"].to_numpy(), [0]])[first]
            first_group = np.searchsorted(x.group_doc, np.arange(len(texts)))
            columns, firsts = [], []
            for frame, group in ((x.a, x.group_a), (x.b, x.group_b)):
                doc = frame["doc"].to_numpy()
                fields = (
                    frame["id"].to_numpy(), frame["start"].to_numpy() - bases[doc], frame["end"].to_numpy() - bases[doc],
                    group - first_group[doc],
                )
                token = pa.StructArray.from_arrays([pa.array(f, pa.int32()) for f in fields], names=names)
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), token))
                firsts.append(ends)
            doc = x.a["doc"].to_numpy()[x.overlaps["a"]]
            pair = pa.StructArray.from_arrays(
                [pa.array(x.overlaps[c].to_numpy() - f[doc], pa.int32()) for c, f in zip("ab", firsts, strict=True)],
                names=("a", "b"),
            )
            ends = np.searchsorted(doc, np.arange(len(texts) + 1))
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *columns], names=["doc_id", "tokens_a", "tokens_b", "overlaps"]
            )

    token = "array<struct<id:int,start:int,end:int,group:int>>"
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, tokens_a {token}, tokens_b {token}, overlaps array<struct<a:int,b:int>>")


def _aligned(rows: DataFrame, shared, prefix: str) -> DataFrame:
    """Numbers of each document, and its different linked pairs of ids with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _sides(shared)
        row = TaskContext.get().partitionId() << 33
        for block in _text_blocks(batches):
            n = block.num_rows
            x = align_texts(block.column("text").to_pylist(), one, two, prefix)
            keys, times = linked_pairs(x)
            ends = np.searchsorted(keys >> (2 * ID_BITS), np.arange(n + 1))
            links = np.concatenate([[0], np.cumsum(times)])
            mask = (1 << ID_BITS) - 1
            counts = [np.bincount(d, minlength=n) for d in (x.a["doc"], x.b["doc"], x.group_doc)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    block.column("doc_id"),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(links[ends[1:]] - links[ends[:-1]], pa.int64()),
                    pa.array(_digests(x, one, two, n), pa.string()),
                    _lists((keys >> ID_BITS) & mask, ends, pa.int32()),
                    _lists(keys & mask, ends, pa.int32()),
                    _lists(times, ends, pa.int64()),
                ],
                names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"],
            )
            row += n

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "a array<int>, b array<int>, times array<long>",
    )


def _packed(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in "ab")
    return (a << ID_BITS) | b


def _pair_counts(documents: DataFrame) -> DataFrame:
    """pair, its id of the first side, and in how many documents it is linked."""

    def emit(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        for batch in batches:
            waiting.append(_packed(batch))
            if sum(map(len, waiting)) > PAIRS_AT_ONCE:
                new = np.unique(np.concatenate(waiting), return_counts=True)
                keys, n = _merged([keys, new[0]], [n, new[1].astype(np.int64)])
                waiting.clear()
                if len(keys) > PAIRS_AT_ONCE:
                    yield emit(keys, n)
                    keys, n = keys[:0], n[:0]
        new = np.unique(np.concatenate([*waiting, np.zeros(0, np.int64)]), return_counts=True)
        yield emit(*_merged([keys, new[0]], [n, new[1].astype(np.int64)]))

    counted = documents.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    return counted.select("pair", F.shiftright("pair", ID_BITS).alias("a"), "count")


def pair_counts(documents: DataFrame, n_ids: int) -> DataFrame:
    """pair, count, and best: whether no other pair of its first id counts more.

    There is one highest count per id of the first vocabulary, ``n_ids`` at most, to broadcast.
    """
    if n_ids > 1 << ID_BITS:
        raise ValueError("the vocabulary is too large")
    counted = stored(_pair_counts(documents), "pairs")
    highest = counted.groupBy("a").agg(F.max("count").alias("highest"))
    joined = counted.join(F.broadcast(highest), "a")
    return stored(joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "counts")


def _top(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs in order, with their counts and whether they are best."""
    top = most_frequent(counts, "count", FREQUENT_PAIRS).toArrow()
    pair, count, best = (top.column(c).to_numpy() for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    return pair[order], count[order], best[order].astype(bool)


def _sums_of_top(documents: DataFrame, shared) -> DataFrame:
    """Sums over the frequent pairs of each document, and its other pairs with their links."""
    others = [c for c in documents.columns if c not in ("a", "b", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            own, times = _packed(batch), batch.column("times").flatten().to_numpy()
            sizes = batch.column("a").value_lengths().to_numpy()
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            there = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            ends = np.concatenate([[0], np.cumsum(sizes)])

            def summed(values: np.ndarray, ends: np.ndarray = ends) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(values)])
                return total[ends[1:]] - total[ends[:-1]]

            known = np.where(there, times, 0)
            hit = at[there]
            value, is_best = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
            value[there], is_best[there] = count[hit], best[hit]
            left = np.concatenate([[0], np.cumsum(~there)])[ends]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in others),
                    pa.array(summed(known * is_best), pa.int64()),
                    pa.array(summed(known * value), pa.int64()),
                    _lists(own[~there], left, pa.int64()),
                    _lists(times[~there], left, pa.int64()),
                ],
                names=[*others, "n_best", "count_sum", "pairs", "times"],
            )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.schema if f.name in others)
    return documents.mapInArrow(run, f"{kept}, n_best long, count_sum long, pairs array<long>, times array<long>")


def alignment(
    docs: DataFrame, a: Tokenizer, b: Tokenizer, prefix: str = " ", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    Documents are tokenised and stored when this is called.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(_checked(a, b))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    documents = stored(_aligned(rows, shared, prefix), "aligned")
    counts = pair_counts(documents, len(a.pieces))
    sums = stored(_sums_of_top(documents, context.broadcast(_top(counts))), "sums")
    rare = sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    rare = rare.select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rare = rare.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("count")).alias("more_sum"),
    )
    zero = F.lit(0).cast("long")
    return sums.drop("pairs", "times").join(rare, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"),
        "groups_sha256",
    )
