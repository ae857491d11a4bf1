"""Cost-balanced packing of tokenised documents into sequences."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.llm.common import give_back

MAX_CACHED = 200_000


def byte_characters() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves,
    the others in order from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Kept(dict):
    """Values of a function of short texts, kept in two generations.

    When the new one is full it becomes the old one, and what is met again moves back, so
    frequent texts stay.
    """

    def __init__(self, of: Callable[[str], bytes]):
        super().__init__()
        self.of, self.old = of, {}

    def __missing__(self, text: str) -> bytes:
        value = self.old.get(text)
        if value is None:
            value = self.of(text)
        if len(text) <= 64:
            if len(self) >= MAX_CACHED:
                self.old = dict(self)
                self.clear()
            self[text] = value
        return value


class Words:
    """Ids of words as little-endian integers, kept; the tokenizer sees a word once in a while.

    Its white space is dropped and nothing in it looks across white space, so a text has the
    ids of its words in turn. Where the file's steps before the merges are those known here
    (NFC, white space, lower case; a split by pattern; bytes as characters), words of Latin
    letters go to its merges at once, piece by piece. All others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        self.special = [t["content"] for t in steps.get("added_tokens") or []]
        before = (steps.get("normalizer") or {}).get("normalizers") or []
        parts = (steps.get("pre_tokenizer") or {}).get("pretokenizers") or []
        known = [n["type"] for n in before] == ["NFC", "Replace", "Lowercase"] and [
            (p["type"], p.get("invert"), p.get("behavior"), p.get("add_prefix_space"), p.get("use_regex")) for p in parts
        ] == [("Split", True, "Removed", None, None), ("ByteLevel", None, None, False, False)]
        pattern = parts[0]["pattern"]["Regex"] if known else ""
        self.split = regex.compile(pattern).findall if known else None
        # The same pattern with its classes written out for plain texts, which has a quicker engine.
        lowered = sorted(set("".join(map(chr, [9, 10, *range(32, 127), *range(0xC0, 0x250)])).lower()))
        held = {c: "".join(filter(regex.compile(c).match, lowered)) for c in (r"\p{L}", r"\p{N}")}
        classes = reduce(lambda text, c: text.replace(c, held[c]), held, pattern)
        self.split_plain = re.compile(classes).findall if known and "\\p" not in classes else None
        self.shown = byte_characters()
        self.words, self.pieces = Kept(self._encoded), Kept(self._merged)
        # None of these changes under NFC or counts as white space.
        self.plain = regex.compile("[!-~\u00c0-\u024f]+").fullmatch
        self.plain_text = regex.compile("[ -~\\t\\n\u00c0-\u024f]*").fullmatch

    def _encoded(self, word: str) -> bytes:
        if self.split and self.plain(word) and not any(s in word for s in self.special):
            low = word.lower()
            # A piece alone is a word of the same ids.
            return b"".join(map(self.pieces.__getitem__, self.split(low)))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _merged(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(self.shown.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        get, out = self.words.__getitem__, []
        for t in texts:
            if self.split_plain and self.plain_text(t) and not any(s in t for s in self.special):
                # Cut into pieces at once: no white space in a piece, and a piece alone has the same ids.
                out.append(b"".join(map(self.pieces.__getitem__, self.split_plain(t.lower()))))
                continue
            out.append(b"".join(map(get, t.replace("\n", " ").replace("\t", " ").split(" "))))
        return out


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def cost(length: np.ndarray, linear: float, quadratic: float) -> np.ndarray:
    length = np.asarray(length, np.float64)
    return linear * length + quadratic * length * length


def assign(
    lengths: np.ndarray, capacity: int, linear: float, quadratic: float
) -> list[tuple[int, int, int, int, int]]:
    """Place pieces, given by descending cost: (piece, start in it, length, sequence, offset).

    Each goes to the sequence of lowest cost so far that has room for it. As many sequences
    are open as the tokens need; where none has room for a whole piece, it is cut to fill the
    cheapest ones, so less than one sequence of padding is left in all.
    """
    total = int(lengths.sum())
    load = np.zeros(max(1, -(-total // capacity)))
    room = np.full(len(load), capacity, np.int64)
    placed = []
    for piece, size in enumerate(lengths.tolist()):
        start = 0
        while start < size:
            fits = room >= size - start
            if not fits.any():
                fits = room > 0
            seq = int(np.argmin(np.where(fits, load, np.inf)))
            part = min(size - start, int(room[seq]))
            placed.append((piece, start, part, seq, capacity - int(room[seq])))
            load[seq] += cost(part, linear, quadratic)
            room[seq] -= part
            start += part
    return placed


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
    group_docs: int = 2000,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian 32-bit), doc_tokens,
    sequence_id, offset.

    A document is its token ids and ``end_id``; whole sequences are cut from its front, the
    rest is packed with others. Rests are dealt by hash of the document to groups of about
    ``group_docs`` documents, each packed by itself, so a group's padding is below one sequence.
    The whole sequences of a long document are spread over all groups. Rows of one id and one
    text share the group of their rests.

    A null or empty text is ``end_id`` alone. Null ids are allowed; repeated rows are packed
    each. Other columns are not read. An empty table gives an empty result. Special tokens'
    strings in a text are read by the tokenizer as it is loaded.
    """
    groups = max(1, math.ceil(docs.count() / group_docs))
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.pmod(F.xxhash64(F.col(id_col), F.crc32(F.col(text_col).cast("binary"))), F.lit(groups)).alias("group"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    key = source.schema["doc_id"].dataType
    tokens = T.StructType(
        [
            T.StructField("doc_id", key),
            T.StructField("group", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
        ]
    )
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(tokenizer_path)
        names = [f.name for f in tokens]
        for batch in batches:
            key_type = batch.schema.field(0).type
            for part in _parts(batch, 1 << 19):
                rows: list[list] = [[], [], [], [], []]
                encoded = known.encode(part.column(2).to_pylist())
                owners = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encoded, strict=True)
                for doc, group, ids in owners:
                    ids += end
                    for at in range(0, len(ids), step):
                        piece = ids[at : at + step]
                        # Whole sequences need no partner: those of one document go to different groups.
                        to = (group + at // step) % groups if len(piece) == step else group
                        row = (doc, to, at // 4, piece, len(ids) // 4)
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(_typed(rows, key_type), names=names)
            give_back()

    result = T.StructType(
        [
            T.StructField("doc_id", key),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def place(pieces: pa.Table) -> pa.Table:
        give_back()
        doc, start = pieces["doc_id"].to_pylist(), pieces["start"].to_numpy()
        ids, whole = pieces["ids"].to_pylist(), pieces["doc_tokens"].to_numpy()
        base = int(pieces["group"][0].as_py()) << 32
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        # A null id counts as the smallest in the fixed order of ties.
        order = sorted(range(len(doc)), key=lambda k: (-sizes[k], doc[k] is not None, doc[k] or 0, start[k], ids[k]))
        full = [k for k in order if sizes[k] == capacity]
        rest = [k for k in order if sizes[k] < capacity]
        rows = [(k, 0, capacity, n, 0) for n, k in enumerate(full)]
        rows += [
            (rest[piece], at, size, len(full) + seq, offset)
            for piece, at, size, seq, offset in assign(sizes[rest], capacity, linear, quadratic)
        ]
        columns = [
            pa.array([doc[k] for k, *_ in rows], pieces.schema.field("doc_id").type),
            pa.array([int(start[k]) + at for k, at, *_ in rows], pa.int64()),
            pa.array([size for _, _, size, *_ in rows], pa.int64()),
            pa.array([ids[k][4 * at : 4 * (at + size)] for k, at, size, *_ in rows], pa.binary()),
            pa.array([int(whole[k]) for k, *_ in rows], pa.int64()),
            pa.array([base + seq for *_, seq, _ in rows], pa.int64()),
            pa.array([offset for *_, offset in rows], pa.int64()),
        ]
        return pa.Table.from_arrays(columns, names=result.names)

    return source.mapInArrow(tokenise, tokens).groupBy("group").applyInArrow(place, result)


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of the last column."""
    sizes = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _typed(rows: list[list], key: pa.DataType) -> list[pa.Array]:
    kinds = [key, pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return [pa.array(values, kind) for values, kind in zip(rows, kinds, strict=True)]
