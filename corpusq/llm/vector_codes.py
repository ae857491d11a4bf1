"""Vector code compression with per-dimension value dictionaries.

Components become integers. Vectors are laid down once, in blocks, column by column: per dimension a
dictionary of the block's distinct integers and one code per vector. To find the nearest entries of a
codebook, the squared differences of each distinct integer to all entries are tabulated; the distance
of a part is then a gather by code and an addition per dimension. Sums for the new entries come from
counts of codes per entry, again without touching a vector.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import staged
from corpusq.session import small_side

# Integers up to here are counted and squared as 64-bit numbers, larger ones as Python integers.
SMALL = 1 << 24
LIMB_BITS = 32
MAX_LONG = (1 << 63) - 1
BLOCK_TYPE = "length int, small boolean, ids array<long>, labels array<{label}>, words binary, sizes binary, codes binary, wide boolean"


def finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def to_integer(x: float, scale: int) -> int:
    """floor(scale * x) of any finite double, exact for a power of two."""
    return math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale


def bounds(length: int, parts: int) -> list[int]:
    """Where consecutive parts start and end; if they cannot be equal, the first ones are longer by one."""
    return [(length * p + parts - 1) // parts for p in range(parts + 1)]


class Codebook:
    """Entries of one vector length: integers by entry and dimension."""

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        self.small = all(abs(x) < SMALL for e in entries for x in e)
        self.matrix = np.array(entries, np.int64 if self.small else object).reshape(len(entries), -1)


class Block:
    """Vectors of one length as dictionaries and codes per dimension."""

    def __init__(self, row: dict):
        self.length, self.ids, self.labels = row["length"], row["ids"], row["labels"]
        sizes = np.frombuffer(row["sizes"], np.int32)
        ends = np.cumsum(sizes)
        if row["small"]:
            words = np.frombuffer(row["words"], np.int64)
        else:
            words = np.array([int(x) for x in json.loads(row["words"])], object)
        self.small = row["small"]
        self.words = [words[e - s : e] for s, e in zip(sizes, ends, strict=True)]
        self.codes = np.frombuffer(row["codes"], np.uint16 if row["wide"] else np.uint8).reshape(self.length, len(self.ids))

    def assign(self, book: Codebook, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance, per part and vector. Ties go to the lower index."""
        n, k = len(self.ids), len(book.entries)
        kind = np.int64 if self.small and book.small else object
        best, error = np.zeros((parts, n), np.int64), np.zeros((parts, n), kind)
        cuts = bounds(self.length, parts)
        for p in range(parts):
            far = np.zeros((n, k), kind)
            for j in range(cuts[p], cuts[p + 1]):
                gap = self.words[j].astype(kind)[:, None] - book.matrix[:, j].astype(kind)[None, :]
                far += (gap * gap)[self.codes[j]]
            best[p] = far.argmin(axis=1)
            error[p] = far[np.arange(n), best[p]]
        return best, error

    def sums(self, best: np.ndarray, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum per entry and dimension, and count per part and entry, from counts of codes."""
        cuts = bounds(self.length, parts)
        total = np.zeros((k, self.length), np.int64 if self.small else object)
        count = np.zeros((parts, k), np.int64)
        for p in range(parts):
            count[p] = np.bincount(best[p], minlength=k)
            for j in range(cuts[p], cuts[p + 1]):
                words = self.words[j]
                seen = np.bincount(best[p] * len(words) + self.codes[j], minlength=k * len(words)).reshape(k, len(words))
                total[:, j] = seen.astype(total.dtype) @ words
        return total, count


def _pack(ids: list, labels: list, rows: np.ndarray, length: int) -> dict:
    words, sizes, codes = [], [], np.zeros((length, len(ids)), np.uint16)
    for j in range(length):
        distinct, codes[j] = np.unique(rows[:, j], return_inverse=True)
        words.append(distinct)
        sizes.append(len(distinct))
    flat = np.concatenate(words) if words else np.zeros(0, np.int64)
    small = rows.dtype != object
    wide = max(sizes, default=0) > 256
    return {
        "length": length, "small": small, "ids": ids, "labels": labels,
        "words": flat.tobytes() if small else json.dumps([str(x) for x in flat]).encode(),
        "sizes": np.array(sizes, np.int32).tobytes(),
        "codes": codes.astype(np.uint16 if wide else np.uint8).tobytes(), "wide": wide,
    }


def _blocks(kept: DataFrame, label_type: str, scale: int, block_rows: int) -> DataFrame:
    schema = BLOCK_TYPE.format(label=label_type)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for length in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == length)
                for at in range(0, len(own), block_rows):
                    some = own[at : at + block_rows]
                    x = flat[(ends[some] - length)[:, None] + np.arange(length)[None, :]]
                    if np.abs(x).max(initial=0.0) < (SMALL - 1) / scale:
                        rows = np.floor(x * scale).astype(np.int64)
                    else:
                        rows = np.array([[to_integer(v, scale) for v in r] for r in x], object).reshape(len(some), length)
                    out.append(_pack([ids[i] for i in some], [labels[i] for i in some], rows, length))
            if out:
                yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return staged(kept.mapInArrow(pack, schema), "vector-blocks")


def _first_entries(kept: DataFrame, entries: int, scale: int) -> dict[int, Codebook]:
    """The vectors of the smallest ids of each length. Ids travel first, then only vectors up to the last id."""
    sized = kept.select("id", "v", F.size("v").alias("length"), F.col("id").isNull().alias("last"))
    by_id = Window.partitionBy("length").orderBy("last", "id")
    lows = sized.select("id", "length", "last").withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= entries)
    edge = lows.groupBy("length").agg(F.max("id").alias("edge"), F.max("last").alias("all"))
    near = sized.join(edge, "length").where(F.col("all") | (F.col("id") <= F.col("edge")))
    order = Window.partitionBy("length").orderBy("last", "id", "v")
    chosen = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= entries).select("length", "r", "v")
    books: dict[int, list] = {}
    for row in sorted(chosen.collect(), key=lambda x: (x.length, x.r)):
        books.setdefault(row.length, []).append([to_integer(x, scale) for x in row.v])
    return {length: Codebook(rows) for length, rows in books.items()}


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number as 32-bit limbs, the last one signed, so that sums of many fit into columns."""
    at = 0
    while not -(1 << 62) < value < 1 << 62:
        yield at, value & ((1 << LIMB_BITS) - 1)
        value >>= LIMB_BITS
        at += 1
    yield at, value


def _refined(blocks: DataFrame, books: dict[int, Codebook], parts: int) -> dict[int, Codebook]:
    """One round: assign, then replace each used entry by the floor of the mean of its parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1).to_pylist()[0])
                book = books[block.length]
                best, _ = block.assign(book, parts)
                total, count = block.sums(best, len(book.entries), parts)
                if block.length in totals:
                    held = totals[block.length]
                    # Sums of a task stay exact: once they may outgrow 64 bits they are Python integers.
                    if held[0].dtype != object and (total.dtype == object or np.abs(held[0]).max(initial=0) > 1 << 61):
                        held[0] = held[0].astype(object)
                    held[0], held[1] = held[0] + total, held[1] + count
                else:
                    totals[block.length] = [total, count]
        out: list[list] = [[], [], [], [], []]
        for length, (total, count) in totals.items():
            cuts = bounds(length, parts)
            for p in range(parts):
                for e in np.flatnonzero(count[p]).tolist():
                    for j in range(cuts[p], cuts[p + 1]):
                        for limb, value in _limbs(int(total[e, j])):
                            for column, x in zip(out, (length, j, e, limb, value), strict=True):
                                column.append(x)
                    # Counts stand at negative places, one per part.
                    for column, x in zip(out, (length, -1 - p, e, 0, int(count[p, e])), strict=True):
                        column.append(x)
        if out[0]:
            names = ["length", "place", "entry", "limb", "value"]
            arrays = [pa.array(c, pa.int32()) for c in out[:4]] + [pa.array(out[4], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    sums = blocks.mapInArrow(add, "length int, place int, entry int, limb int, value long")
    found: dict[tuple, int] = {}
    wide = sums.groupBy("length", "place", "entry", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    for row in wide.collect():
        key = (row.length, row.place, row.entry)
        found[key] = found.get(key, 0) + (int(row.value) << (LIMB_BITS * row.limb))
    out = {}
    for length, book in books.items():
        entries = [list(e) for e in book.entries]
        cuts = bounds(length, parts)
        for p in range(parts):
            for e in range(len(entries)):
                n = found.get((length, -1 - p, e), 0)
                for j in range(cuts[p], cuts[p + 1]) if n else ():
                    entries[e][j] = found[length, j, e] // n
        out[length] = Codebook(entries)
    return out


def books_digest(books: dict[int, Codebook], parts: int) -> dict[int, str]:
    """Per length the sha256 of all components by part, entry and position."""
    out = {}
    for length, book in books.items():
        cuts = bounds(length, parts)
        flat = [e[j] for p in range(parts) for e in book.entries for j in range(cuts[p], cuts[p + 1])]
        out[length] = hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()
    return out


def decode(code: str, book: Codebook, parts: int = 16) -> list[int]:
    """The integers that a code stands for."""
    length = book.matrix.shape[1]
    cuts = bounds(length, parts)
    chosen = bytes.fromhex(code)
    return [book.entries[chosen[p]][j] for p in range(parts) for j in range(cuts[p], cuts[p + 1])]


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    block_rows: int = 4096,
) -> tuple[DataFrame, dict[int, Codebook]]:
    """One row per kept vector: id, code, error, label_error, codebooks_sha256; and the codebooks.

    A component x counts as floor(``scale`` * x), ``scale`` a power of two. A codebook of at most
    256 ``entries`` per part starts with the vectors of the smallest ids and is refined in
    ``rounds`` of assignment and floored means. code holds one byte per part in hex, error the
    squared distances that are left, label_error the errors of all rows with that label.

    Vectors that are null or hold null or non-finite components have no row. With fewer vectors
    than ``entries`` the codebooks are shorter. Rows of one id start in the order of their
    vectors, null ids come last; repeated rows count each. Vectors of different lengths have
    codebooks of their own; if parts cannot be equal, the first are longer by one; empty vectors
    have code zero and error 0. Integers of any size are exact; an error beyond 64 bits is given
    as the largest long. Other columns are not read. An empty table gives an empty result.

    What the driver holds and sends are the codebooks: ``entries`` times the lengths, whatever
    the number of vectors. A task holds one block of ``block_rows`` vectors and its sums.
    """
    if not 0 < entries <= 256 or scale & (scale - 1) or not 0 < block_rows <= 1 << 16:
        raise ValueError("entries must be 1 to 256, scale a power of two, block_rows at most 65536")
    label_type = vectors.schema[label_col].dataType.simpleString()
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    kept = rows.where(F.col("v").isNotNull() & finite(F.col("v")))
    blocks = _blocks(kept, label_type, scale, block_rows)
    books = _first_entries(kept, entries, scale)
    for _ in range(rounds):
        books = _refined(blocks, books, parts)
    digests = books_digest(books, parts)
    schema = f"id long, label {label_type}, code string, error long, codebooks_sha256 string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("labels")
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1).to_pylist()[0])
                best, error = block.assign(books[block.length], parts)
                text = best.astype(np.uint8).T.tobytes().hex()
                width = 2 * parts
                codes = [text[i * width : (i + 1) * width] for i in range(len(block.ids))]
                errors = [min(int(x), MAX_LONG) for x in error.sum(axis=0)]
                columns = [pa.array(block.ids, pa.int64()), pa.array(block.labels, labels.type.value_type)]
                columns += [pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
                columns += [pa.array([digests[block.length]] * len(codes), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error", "codebooks_sha256"])

    coded = staged(blocks.mapInArrow(encode, schema), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MAX_LONG).cast("decimal(38,0)")).cast("long")
    by_label = staged(coded.groupBy("label").agg(total.alias("label_error")), "vector-label-errors")
    other = by_label.select(F.col("label").alias("_label"), "label_error")
    joined = coded.join(small_side(other, other.count()), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256"), books
