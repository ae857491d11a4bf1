"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays: code points become classes, each class is a transition
function of a small automaton, functions are composed associatively within and across
blocks, and two tables give the boundaries from (state, class). The slices between
boundaries go through a cache of merged pieces. The start of each token is kept.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.llm.common import text_blocks

# Classes of code points. Letters that can belong to a contraction have their own.
DOC, LETTER, NUMBER, OTHER, SPACE, WHITE, APOSTROPHE, SHORT, R, V, L, E = range(12)
LETTERS = (LETTER, SHORT, R, V, L, E)
# States: what the last code point was part of.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AT_SPACE, AT_WHITE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, SHORTENED = range(11)
# Code points with the property White_Space.
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
MAX_CACHED = 500_000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array(
        [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8
    )
    table[WHITE_SPACE] = WHITE
    for chars, kind in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", SHORT), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(c) for c in chars]] = kind
    return table


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next state, boundary before the code point, boundary before its predecessor), by state and class."""
    states, classes = 11, 12
    step = np.zeros((states, classes), np.uint8)
    here = np.zeros((states, classes), bool)
    back = np.zeros((states, classes), bool)
    pending = {QUOTE_R: E, QUOTE_V: E, QUOTE_L: L}
    inside = {IN_LETTERS: LETTERS, IN_NUMBERS: (NUMBER,), IN_OTHER: (OTHER, APOSTROPHE), QUOTE: (OTHER, APOSTROPHE)}
    for s in range(states):
        for c in range(classes):
            # A started contraction that does not go on was a quote and a run of letters.
            as_if = IN_LETTERS if s in pending and c != pending[s] else s
            if c in (SPACE, WHITE):
                step[s, c] = AT_SPACE if c == SPACE else AT_WHITE
                here[s, c] = s not in (AT_SPACE, AT_WHITE)
            elif c == DOC:
                step[s, c], here[s, c] = START, True
            else:
                here[s, c] = c not in inside.get(as_if, ()) and s != AT_SPACE
                # The last white space of a run stands alone, or joins what follows if it is a space.
                back[s, c] = s in (AT_SPACE, AT_WHITE)
                if c in LETTERS:
                    step[s, c] = IN_LETTERS
                elif c == NUMBER:
                    step[s, c] = IN_NUMBERS
                else:
                    fresh = c == APOSTROPHE and here[s, c]
                    step[s, c] = QUOTE if fresh else IN_OTHER
            if s in pending:
                back[s, c] = c != pending[s]
                if c == pending[s]:
                    step[s, c], here[s, c] = SHORTENED, False
            if s == QUOTE and c in (SHORT, R, V, L):
                step[s, c] = {SHORT: SHORTENED, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c]
                here[s, c] = False
    return step, here, back


def boundaries(classes: np.ndarray, width: int = 256) -> np.ndarray:
    """True where a piece starts. ``classes`` holds DOC before each document and at the end."""
    step, here, back = automaton()
    n = len(classes)
    rows = -(-n // width)
    grid = np.full(rows * width, DOC, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    # The function of each block of code points: where it leads from every state. States are
    # held as the start of their row in the flat table.
    states, kinds = step.shape
    flat = (step * kinds).reshape(-1)
    leads = np.repeat(np.arange(0, states * kinds, kinds, dtype=np.uint8)[:, None], rows, axis=1)
    for column in grid:
        leads = flat[leads + column]
    leads = np.ascontiguousarray(leads.T) // np.uint8(kinds)
    # Composition is associative: after log2 rounds row i holds the function of blocks 0..i.
    reach = 1
    while reach < rows:
        leads[reach:] = np.take_along_axis(leads[reach:], leads[:-reach].copy(), axis=1)
        reach *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = leads[:-1, START]
    before = np.empty_like(grid)
    state *= np.uint8(kinds)
    for i, column in enumerate(grid):
        before[i] = state + column
        state = flat[before[i]]
    cell = before.T.reshape(-1)[:n]
    starts = here.reshape(-1)[cell]
    starts[:-1] |= back.reshape(-1)[cell][1:]
    return starts


class Vocabulary:
    """Ranks of byte strings; pieces are merged once and kept."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank] = word
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Ids of a piece as little-endian 32-bit integers: lowest rank first, leftmost first."""
        packed = self.old.get(piece)
        if packed is None:
            merge = self._merge if len(piece) > 64 else self._merge_short
            ids = [self.ranks[piece]] if piece in self.ranks else merge(piece)
            packed = np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.cache) >= MAX_CACHED:
                # Pieces not seen since the last change of generations are forgotten.
                self.old, self.cache = self.cache, {}
            self.cache[piece] = packed
        return packed

    def _merge_short(self, piece: bytes) -> list[int]:
        rank, none = self.ranks.get, 1 << 60
        cuts = list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(piece[cuts[i] : cuts[i + 2]], none)
            if i:
                pairs[i - 1] = rank(piece[cuts[i - 1] : cuts[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _merge(self, piece: bytes) -> list[int]:
        import heapq

        # Parts as a linked list; a heap of mergeable pairs keeps long pieces at n log n.
        n = len(piece)
        end, prev, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], after[i], alive[j] = stop, after[j], False
            if after[i] < n:
                prev[after[i]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts of a block, the byte where each starts, and the first token of each text."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        heads = np.searchsorted(at, offsets)
        classes = np.insert(class_table()[points], heads, DOC)
        marks = heads + np.arange(len(heads))
        starts = np.delete(boundaries(classes), marks)
        # A piece that follows the mark of a document starts there by itself.
        cuts = [*at[np.flatnonzero(starts)].tolist(), len(raw)]
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for piece in set(pieces) - self.cache.keys():
            self.merge(piece)
        try:
            packed = list(map(self.cache.__getitem__, pieces))
        except KeyError:  # a long piece is not kept, or the generation changed
            packed = [self.cache.get(p) or self.merge(p) for p in pieces]
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        return ids, begins, np.searchsorted(begins, offsets)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> bytes:
        """Bytes of tokens; ``starts`` says where each begins, counted from any origin."""
        if not len(ids):
            return b""
        sizes = self.lengths[ids]
        where = np.cumsum(sizes) - sizes
        if not np.array_equal(where, starts - starts[0]):
            raise ValueError("offsets do not fit the ids")
        return self.bytes[np.repeat(self.starts[ids] - where, sizes) + np.arange(sizes.sum())].tobytes()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ids array<int>, starts array<int> (byte where each token starts).

    A null or empty text has empty arrays. Ids may be null or repeated, rows are independent.
    Other columns are not read. Very long texts are one block each and stay whole.
    """
    kept = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, kept.schema[0].dataType),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("starts", T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for rows, data, offsets in text_blocks(batches):
            ids, begins, first = vocab.encode(data, offsets)
            own = begins - np.repeat(offsets[:-1], np.diff(first))
            lists = [
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x.astype(np.int32)))
                for x in (ids, own)
            ]
            yield pa.RecordBatch.from_arrays([rows.column(0), *lists], names=schema.names)

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``decoded`` (binary) to rows of ``encode``; a null array gives null."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    i, j = encoded.columns.index("ids"), encoded.columns.index("starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            at = 0
            ids, starts = batch.column(i), batch.column(j)
            while at < batch.num_rows:
                # Blocks of about a million tokens.
                end, tokens = at, 0
                while end < batch.num_rows and (end == at or tokens < 1 << 20):
                    tokens += len(ids[end]) if ids[end].is_valid else 0
                    end += 1
                out = [
                    vocab.decode(ids[k].values.to_numpy(), starts[k].values.to_numpy()) if ids[k].is_valid else None
                    for k in range(at, end)
                ]
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=schema.names)
                at = end

    return encoded.mapInArrow(run, schema)
