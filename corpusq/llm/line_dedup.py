"""Line dedup: sharded cuckoo filters over exact reference counts, with insertions and deletions.

``refs`` holds one row per (line key, document). ``counts`` holds, per key, its number of
documents and the smallest of them. Keys of two documents or more are in a cuckoo filter,
cut into shards by key; it takes insertions and deletions, so a document can be added or
taken out without a new build. Lines are tested in the filter where they are; only lines
that may be repeated shuffle, to meet the exact counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import SPACES, ascii_lower
from corpusq.session import cut_lineage

SLOTS = 4
KICKS = 500
SPREAD = 1_540_483_477  # odd multiplier between a fingerprint and its other bucket
KEYS_PER_SHARD = 12_000
# The input row while other columns are joined to it.
ROW = "_corpusq_line_dedup_row"
FILTER_SCHEMA = "shard long, buckets long, filter binary"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may lie in two buckets. 0 marks a free slot."""

    def __init__(self, buckets: int, data: bytes | None = None):
        self.buckets = buckets
        self.slots = (
            np.zeros((buckets, SLOTS), ">u2") if data is None
            else np.frombuffer(data, ">u2").reshape(buckets, SLOTS).copy()
        )

    @staticmethod
    def fingerprint(k2: int) -> int:
        return k2 % 65_535 + 1

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * SPREAD & (self.buckets - 1))

    def places(self, k1: int, k2: int) -> tuple[int, int, int]:
        mark, first = self.fingerprint(k2), k1 & (self.buckets - 1)
        return mark, first, self.other(first, mark)

    def __contains__(self, key: tuple[int, int]) -> bool:
        mark, a, b = self.places(*key)
        return bool((self.slots[a] == mark).any() or (self.slots[b] == mark).any())

    def insert(self, k1: int, k2: int) -> bool:
        """False if there is no room; the filter has then lost a key and must be built anew."""
        mark, a, b = self.places(k1, k2)
        at = a
        for bucket in (a, b):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = mark
                return True
        for kick in range(KICKS):
            slot = (mark + kick) % SLOTS
            mark, self.slots[at, slot] = int(self.slots[at, slot]), mark
            at = self.other(at, mark)
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = mark
                return True
        return False

    def delete(self, k1: int, k2: int) -> bool:
        mark, a, b = self.places(k1, k2)
        for bucket in (a, b):
            held = np.flatnonzero(self.slots[bucket] == mark)
            if len(held):
                self.slots[bucket, held[0]] = 0
                return True
        return False

    @classmethod
    def build(cls, k1: list[int], k2: list[int]) -> CuckooFilter:
        buckets = 1 << max(0, math.ceil(math.log2(max(1, len(k1)) / SLOTS / 0.9)))
        while True:
            made = cls(buckets)
            if all(made.insert(a, b) for a, b in zip(k1, k2, strict=True)):
                return made
            buckets *= 2


@dataclass
class LineIndex:
    """State of incremental line dedup; each part is a table that can be saved and loaded.

    ``whole`` says that counts and references hold all keys; only such an index can be changed.
    """

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    whole: bool = True

    def need_whole(self) -> None:
        if not self.whole:
            raise ValueError("an index built with keep_refs=False takes no insertions or deletions")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, same, pos, k1, k2): lines whose key is long enough. ``same`` tells rows of one id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("same"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    keys = rows.select("doc_id", "same", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select(
        "doc_id", "same", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2")
    )


def _refs(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    lines = _lines(docs, id_col, text_col, min_chars)
    return lines.groupBy("k1", "k2", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def _counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("owner")
    )


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("k1", 32), F.lit(shards))


def _build_filters(repeated: DataFrame, shards: int) -> DataFrame:
    def build(keys: pa.Table) -> pa.Table:
        made = CuckooFilter.build(keys["k1"].to_pylist(), keys["k2"].to_pylist())
        return pa.table(
            {
                "shard": pa.array([keys["shard"][0].as_py()], pa.int64()),
                "buckets": pa.array([made.buckets], pa.int64()),
                "filter": pa.array([made.slots.tobytes()], pa.binary()),
            }
        )

    keys = repeated.select(_shard(shards).alias("shard"), "k1", "k2")
    return keys.groupBy("shard").applyInArrow(build, FILTER_SCHEMA)


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    keep_refs: bool = True,
    expected_keys: int | None = None,
) -> LineIndex:
    """Index of all documents. ``keep_refs=False`` leaves out what only later insertions and deletions need."""
    refs = _refs(docs, id_col, text_col, min_chars)
    if keep_refs:
        refs = cut_lineage(refs)
    counts = _counts(refs)
    # For one use only keys of several documents are needed.
    counts = cut_lineage(counts if keep_refs else counts.where("docs > 1"))
    repeated = counts.where("docs > 1")
    shards = max(1, math.ceil((expected_keys or repeated.count()) / KEYS_PER_SHARD))
    return LineIndex(refs, counts, cut_lineage(_build_filters(repeated, shards)), shards, keep_refs)


def _update_filters(index: LineIndex, changes: DataFrame) -> DataFrame:
    """Apply rows (k1, k2, add boolean). A shard without room gets buckets = 0: all its keys may be there."""

    def update(held: pa.Table, keys: pa.Table) -> pa.Table:
        shard = (held if held.num_rows else keys)["shard"][0].as_py()
        buckets = held["buckets"][0].as_py() if held.num_rows else None
        if buckets is None:
            made = CuckooFilter(64)
        elif buckets:
            made = CuckooFilter(buckets, held["filter"][0].as_py())
        else:
            return held
        full = False
        for k1, k2, add in zip(*(keys[c].to_pylist() for c in ("k1", "k2", "add")), strict=True):
            if add:
                full |= not made.insert(k1, k2)
            else:
                made.delete(k1, k2)
        return pa.table(
            {
                "shard": pa.array([shard], pa.int64()),
                "buckets": pa.array([0 if full else made.buckets], pa.int64()),
                "filter": pa.array([b"" if full else made.slots.tobytes()], pa.binary()),
            }
        )

    keyed = changes.select(_shard(index.shards).alias("shard"), "k1", "k2", "add")
    grouped = index.filters.groupBy("shard").cogroup(keyed.groupBy("shard"))
    return cut_lineage(grouped.applyInArrow(update, FILTER_SCHEMA))


def _replace(index: LineIndex, refs: DataFrame, fresh: DataFrame, touched: DataFrame) -> LineIndex:
    """Counts of touched keys become ``fresh``; the filter follows keys that cross two documents."""
    keys = ["k1", "k2"]
    fresh = cut_lineage(fresh)
    before = index.counts.join(touched, keys, "left_semi")
    counts = cut_lineage(index.counts.join(touched, keys, "left_anti").unionByName(fresh))
    now, then = (c.where("docs > 1").select(keys) for c in (fresh, before))
    changes = now.join(then, keys, "left_anti").withColumn("add", F.lit(True)).unionByName(
        then.join(now, keys, "left_anti").withColumn("add", F.lit(False))
    )
    return LineIndex(refs, counts, _update_filters(index, changes), index.shards)


def insert(
    index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10
) -> LineIndex:
    """Add documents whose ids the index does not hold yet."""
    index.need_whole()
    new = cut_lineage(_refs(docs, id_col, text_col, min_chars))
    touched = new.select("k1", "k2").distinct()
    added = index.counts.join(touched, ["k1", "k2"], "left_semi").unionByName(_counts(new))
    fresh = added.groupBy("k1", "k2").agg(F.sum("docs").alias("docs"), F.min("owner").alias("owner"))
    return _replace(index, cut_lineage(index.refs.unionByName(new)), fresh, touched)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """Take out the documents named in column doc_id; the index is then as if they had never been in."""
    index.need_whole()
    ids = doc_ids.select(F.col("doc_id").alias("gone")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone"))
    touched = cut_lineage(index.refs.join(ids, same, "left_semi").select("k1", "k2").distinct())
    refs = cut_lineage(index.refs.join(ids, same, "left_anti"))
    fresh = _counts(refs.join(touched, ["k1", "k2"], "left_semi"))
    return _replace(index, refs, fresh, touched)


def _mark() -> Column:
    """Fingerprint of a key, as the two bytes a slot holds."""
    return F.unhex(F.lpad(F.hex(F.pmod("k2", F.lit(65_535)) + 1), 4, "0"))


def _may_hold() -> Column:
    """Is the fingerprint ``mark`` in one of its two buckets? Slots are compared as bytes, in place."""
    mask = F.col("buckets") - 1
    first = F.col("k1").bitwiseAND(mask)
    spread = (F.pmod("k2", F.lit(65_535)) + 1) * F.lit(SPREAD).cast("long")
    second = first.bitwiseXOR(spread.bitwiseAND(mask))

    def held(bucket: Column) -> Column:
        slots = [F.substring("filter", (bucket * 8 + 2 * i + 1).cast("int"), F.lit(2)) == F.col("mark") for i in range(SLOTS)]
        return reduce(Column.__or__, slots)

    return (F.col("buckets") == 0) | held(first) | held(second)


def dedup_lines(
    docs: DataFrame,
    index: LineIndex | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    result_col: str = "line_dedup",
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """``docs`` with a struct (n_lines, n_dropped, text) added as ``result_col``.

    A line goes when its key (ASCII white space stripped, A-Z lower-cased) has at least
    ``min_chars`` code points, lies in two documents or more, and this is not the smallest id
    that holds it. All its lines go, also repeated ones; the other lines stay in order.

    A null or empty text is one empty line. Rows with one id are one document; null ids are
    one document, larger than any other. A column named like ``result_col`` is replaced, other
    columns are kept as they are. An empty table gives an empty result.
    The filter is broadcast only while its bytes are within ``broadcast_bytes``.
    """
    index = index or build_index(docs, id_col, text_col, min_chars, keep_refs=False)
    size = index.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    filters = F.broadcast(index.filters) if size <= broadcast_bytes else index.filters
    lines = _lines(docs, id_col, text_col, min_chars).withColumns(
        {"shard": _shard(index.shards), "mark": _mark()}
    )
    maybe = lines.join(filters, "shard").where(_may_hold()).drop("shard", "buckets", "filter", "mark")
    owners = index.counts.where("docs > 1").select("k1", "k2", "owner")
    doomed = maybe.join(owners, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    drops = doomed.groupBy("doc_id", "same").agg(F.collect_set("pos").alias("_drop")).select(
        F.col("doc_id").alias("_doc"), F.col("same").alias("_same"), "_drop"
    )
    text = F.coalesce(F.col(f"{ROW}.`{text_col}`").cast("string"), F.lit(""))
    rows = docs.drop(result_col).select(F.struct("*").alias(ROW))
    joined = rows.join(
        drops,
        F.col(f"{ROW}.`{id_col}`").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_same")),
        "left",
    )
    lines_of = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), F.col("_drop"))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(lines_of, i)), "\n")
    return joined.select(
        f"{ROW}.*",
        F.struct(
            F.size(lines_of).cast("long").alias("n_lines"),
            F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("_drop").isNull(), text).otherwise(rebuilt).alias("text"),
        ).alias(result_col),
    )
