"""Token counts by a finite-state transducer compiled from a byte-fallback BPE vocabulary.

Reading a text from the left, the BPE tokens of every prefix are unique, and the last one is the
token that is compatible with the tokens before it: two tokens are compatible when merging their
joined text gives them back. So a state needs to hold only the positions at which a longer token
may still begin, with the last token before each and the number of tokens emitted since. Reading a
character leads to the next state and adds a number of tokens (which is negative where a merge
takes back tokens). States and transitions are compiled when first reached, and kept per worker up
to a bound; beyond it compilation starts anew, with the same results.

A cut where no vocabulary entry spans the two characters brings the transducer back to its start,
whatever its state was. A chunk of a text between such cuts therefore has a constant state map with
a count; what stands before its first cut and after its last is open. Maps of adjacent chunks
compose by running the open text between them, which is associative, so the maps of a text's chunks
are combined in a balanced tree. The pieces between cuts recur, and their counts are kept in a
bounded table.

Defined cases: a null or empty text has no tokens and no bytes; characters outside the vocabulary
count one token per UTF-8 byte; strings of special tokens are ordinary text; repeated rows each get
a row; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respeval.llm.common import blocks, id_and_text

SPACE = "▁"
LIMIT = 4096
CHUNK = 1 << 16
# Bounds of what a worker keeps.
MAX_TRANSITIONS = 600_000
MAX_PIECES = 400_000
MAX_PAIRS = 400_000
LONGEST_KEPT = 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces from the first merge to the last; pieces that are single characters are among them."""

    pieces: tuple[str, ...]
    dummy_prefix: bool = True


def read_model(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece BPE model that leaves texts as they are.

    Raises for models that normalise texts, as these are not covered.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    plain = [i for i in range(model.get_piece_size()) if not any(f(i) for f in odd)]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    out = Vocabulary(tuple(model.id_to_piece(i) for i in plain))
    for probe in ("a  b ", " \n\tx", "Ａﬁé  ", "\U0001f9ff\x00<s>"):
        if Transducer(out).count(probe) != len(model.encode(probe)):
            raise ValueError(f"{path}: this kind of model is not covered")
    return out


class _Counts(dict):
    """Tokens of pieces between cuts."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> int:
        n = self.machine.run(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = n
        return n


class Transducer:
    """States are numbers; state 0 is the start."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.rank = {p: i for i, p in enumerate(vocabulary.pieces)}
        self.prefixes = {p[:i] for p in self.rank for i in range(1, len(p))}
        self.inside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.dummy_prefix = vocabulary.dummy_prefix
        first = {p[0] for p in self.inside}
        second = {p[1] for p in self.inside}
        # Cut before a run of SPACE if no entry has it after another character; around "\n" if none holds it.
        opens = all(p[1] != SPACE or p[0] == SPACE for p in self.inside)
        alone = "\n" not in first | second
        out = (SPACE if opens else "") + ("\n" if alone else "")
        parts = [f"{SPACE}+[^{out}]*"] * opens + ["\n+"] * alone + [f"[^{out}]+" if out else "(?s:.+)"]
        self.cut = re.compile("|".join(parts)).findall
        self._pairs: dict[tuple[str, str], bool] = {}
        self._single: dict[str, bool] = {}
        self._reset()
        self.counts = _Counts(self)

    def _reset(self) -> None:
        start = (("", "", 0),)
        self.states = [start]
        self.numbers = {start: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.size = 0

    def merge(self, text: str) -> list[str]:
        """BPE of a short text by its definition: join the best-ranked adjacent pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, len(self.rank)) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == len(self.rank):
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _token(self, text: str) -> bool:
        """Whether a text is one token; single characters always are."""
        if len(text) == 1:
            return True
        if text not in self.rank:
            return False
        if text not in self._single:
            self._single[text] = self.merge(text) == [text]
        return self._single[text]

    def _fits(self, left: str, right: str) -> bool:
        if not left or left[-1] + right[0] not in self.inside:
            return True
        pair = (left, right)
        found = self._pairs.get(pair)
        if found is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            found = self._pairs[pair] = self.merge(left + right) == [left, right]
        return found

    def _emits(self, token: str) -> int:
        return 1 if token in self.rank else len(token.encode())

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition from a state on a character.

        An entry of a state is (text read since a position, last token before it, tokens emitted
        up to it, relative to those emitted up to now), longest text first.
        """
        entries = [(text + char, last, n) for text, last, n in self.states[state]]
        token, count = next(
            (text, n + self._emits(text))
            for text, last, n in entries
            if self._token(text) and self._fits(last, text)
        )
        then = (*((text, last, n - count) for text, last, n in entries if text in self.prefixes), ("", token, 0))
        number = self.numbers.get(then)
        if number is None:
            number = self.numbers[then] = len(self.states)
            self.states.append(then)
            self.steps.append({})
        self.steps[state][char] = number, count
        self.size += 1
        return number, count

    def run(self, piece: str) -> int:
        if self.size > MAX_TRANSITIONS:
            self._reset()
        state, total = 0, 0
        for char in piece:
            step = self.steps[state].get(char) or self._compile(state, char)
            state = step[0]
            total += step[1]
        return total

    def chunk(self, text: str) -> tuple:
        """State map of a chunk: (open head, tokens between the cuts, open tail) or (open text,)."""
        pieces = self.cut(text)
        if len(pieces) < 2:
            return (text,)
        return pieces[0], sum(map(self.counts.__getitem__, pieces[1:-1])), pieces[-1]

    def compose(self, a: tuple, b: tuple) -> tuple:
        middle = self.chunk(a[-1] + b[0])
        if len(middle) == 1:
            if len(a) == 1 and len(b) == 1:
                return middle
            if len(a) == 1:
                return middle[0], b[1], b[2]
            if len(b) == 1:
                return a[0], a[1], middle[0]
            return a[0], a[1] + self.counts[middle[0]] + b[1], b[2]
        head, n, tail = middle
        if len(a) > 1:
            head, n = a[0], n + self.counts[head] + a[1]
        if len(b) > 1:
            tail, n = b[2], n + self.counts[tail] + b[1]
        return head, n, tail

    def count(self, text: str | None) -> int:
        """Tokens of a text, as the model's library gives them."""
        if not text:
            return 0
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        maps = [self.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [reduce(self.compose, maps[i : i + 2]) for i in range(0, len(maps), 2)]
        (only,) = maps
        if len(only) == 1:
            return self.counts[only[0]]
        return self.counts[only[0]] + only[1] + self.counts[only[2]]


_MACHINES: dict[Vocabulary, Transducer] = {}


def _machine(vocabulary: Vocabulary) -> Transducer:
    """The worker's transducer, kept between tasks."""
    if vocabulary not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[vocabulary] = Transducer(vocabulary)
    return _MACHINES[vocabulary]


def token_counts(
    docs: DataFrame, vocabulary: Vocabulary, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, bytes, tokens, and whether a text has more than ``limit`` tokens.

    The vocabulary (some tens of thousands of short strings) is read on the driver and broadcast.
    """
    rows = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _machine(shared.value).count
        for block in blocks(batches):
            texts = block.column("text")
            tokens = np.array([count(t) for t in texts.to_pylist()], dtype=np.int64)
            sizes = pc.binary_length(texts).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), sizes, pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
