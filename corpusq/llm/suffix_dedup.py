"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Equal strings of ``length`` bytes pick the same anchor: the smallest hash of their short
substrings. So strings can be dealt to tasks by anchor, and equal ones meet. The strings of
an anchor occurrence form one segment of text. Equal segments are settled by their hashes;
where an anchor has different segments, these are a collection whose Burrows-Wheeler
transform and common prefixes are built column by column: each round inserts one symbol per
segment, reading the old columns in order and writing new ones in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.llm.common import give_back, mix, staged, text_blocks

BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
BYTE_WORDS = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
CHUNK = 1 << 20
LOW = np.uint64(0xFFFFFFFF)
NO_ID = np.iinfo(np.int64).max
HOT_ANCHORS = 100_000  # so many are dealt by segment at most; the list decides where segments go, not the result
REMOVED, TOGETHER, SINGLY = 0, 1, 2  # what settle says of a segment: gone, to a collection, or string by string
ENTRY = [("fp", np.uint32), ("seg", np.uint64), ("doc", np.int64), ("same", np.int64), ("start", np.uint32), ("count", np.uint16)]


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        column = np.full(n, base, np.uint64)
        column[0] = 1
        out.append(np.multiply.accumulate(column))
    return out[0], out[1]


class Rolling:
    """Hashes of any substring of some bytes from running sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(1 << max(20, int(len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_WORDS[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima to both sides of fixed borders."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(
    data: np.ndarray, offsets: np.ndarray, length: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a block of texts: (text, start in it, number of strings, anchor hash, segment hash).

    A segment is the run of neighbouring strings that pick one occurrence of an anchor.
    """
    width = length - gram + 1
    nothing = np.zeros(0, np.int64)
    if len(data) < length:
        return nothing, nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
    rolling = Rolling(data)
    at = np.arange(len(data) - gram + 1)
    hashes = rolling.of(at, at + gram)
    # High bits of the hash, then the place: of equal hashes the leftmost is the anchor.
    low = window_minimum((hashes & ~LOW) | at.astype(np.uint64), width)
    place = (low & LOW).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    whole = np.arange(len(place)) + length <= offsets[text + 1]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(place)))
    heads, counts = heads[whole[heads]], counts[whole[heads]]
    owner = text[heads]
    return (
        owner,
        heads - offsets[owner],
        counts,
        hashes[place[heads]],
        rolling.of(heads, heads + counts + length - 1),
    )


def chunks(data: np.ndarray, offsets: np.ndarray, length: int):
    """(texts, bytes, offsets, shift): a very long text comes in overlapping chunks, none longer than CHUNK."""
    if len(offsets) > 2 or len(data) <= 2 * CHUNK:
        yield data, offsets, 0
        return
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        yield part, np.array([0, len(part)]), at


class Entries:
    """Columns of segments."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns

    def __getattr__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.columns["doc"])

    def take(self, rows: np.ndarray) -> Entries:
        return Entries({k: v[rows] for k, v in self.columns.items()})

    @classmethod
    def concat(cls, parts: list[Entries]) -> Entries:
        return cls({k: np.concatenate([p.columns[k] for p in parts]) for k in parts[0].columns})

    def in_order(self) -> tuple[Entries, np.ndarray]:
        """Sorted by anchor, segment and order of documents, each place once; and which are the first of their segment."""
        own = self.take(np.lexsort((self.start, self.same, self.doc, self.seg, self.fp, self.block)))
        # Equal rows are one document: what each of them tells of a place counts once.
        place = [own.columns[k] for k in ("block", "fp", "seg", "doc", "same", "start")]
        fresh = np.ones(len(own), bool)
        fresh[1:] = np.logical_or.reduce([column[1:] != column[:-1] for column in place])
        own = own.take(fresh)
        first = np.ones(len(own), bool)
        first[1:] = (own.seg[1:] != own.seg[:-1]) | (own.fp[1:] != own.fp[:-1]) | (own.block[1:] != own.block[:-1])
        return own, first


def common_prefixes(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common prefix with the one before, segment, length) of all suffixes of all segments, in order.

    Round r inserts the suffix of length r of every segment that has one, by its first symbol
    and then in the order of what it extends: ``follow`` holds, for every suffix, the place of
    the suffix without its first symbol, and rises within each symbol of the transform. Its
    common prefix with a neighbour of the same symbol is one more than the least common prefix
    between the two suffixes they extend. Each round reads the columns in order and writes
    them anew, wider by one entry per segment.
    """
    lengths = np.array([len(s) for s in segments], np.int64)
    m = len(segments)
    text = np.frombuffer(b"".join(segments), np.uint8)
    ends = np.cumsum(lengths)
    # The suffixes of length 0 come last, as their symbol is the largest.
    lcp, follow = np.zeros(m, np.uint8), np.zeros(m, np.int32)
    # Segment and length of each suffix, in one column.
    suffix = np.arange(m, dtype=np.uint32) << 8
    counts = np.zeros(256, np.int64)
    alive, at = np.flatnonzero(lengths > 0), np.flatnonzero(lengths > 0).astype(np.int32)
    for r in range(1, int(lengths.max(initial=0)) + 1):
        symbols = text[ends[alive] - r]
        by_symbol = np.lexsort((at, symbols))
        fresh = np.bincount(symbols, minlength=256)
        edges = np.concatenate([[0], np.cumsum(fresh)])
        starts = np.concatenate([[0], np.cumsum(counts)])
        sorted_at = at[by_symbol]
        sorted_place = np.arange(len(at))
        for c in np.flatnonzero(fresh).tolist():
            rows = slice(edges[c], edges[c + 1])
            sorted_place[rows] += starts[c] + np.searchsorted(follow[starts[c] : starts[c + 1]], sorted_at[rows])
        place = np.empty(len(at), np.int64)
        place[by_symbol] = sorted_place
        counts += fresh
        old = np.ones(len(lcp) + len(at), bool)
        old[place] = False
        order = np.empty(len(old), np.int32)
        order[old], order[place] = follow, at
        # Common prefixes change at new suffixes and after them, within one symbol.
        touched = np.zeros(len(old) + 1, bool)
        touched[place] = touched[place + 1] = True
        touched[np.concatenate([[0], np.cumsum(counts)])] = False
        touched[counts.sum() :] = False
        touched = np.flatnonzero(touched)
        low, high = order[touched - 1] + 1, order[touched] + 1
        by_low = np.argsort(low, kind="stable")
        cuts = np.column_stack([low[by_low], high[by_low]]).reshape(-1)
        least = np.empty(len(touched), np.uint8)
        if len(touched):
            least[by_low] = np.minimum.reduceat(np.append(lcp, np.uint8(255)), cuts)[::2]
        wider_lcp, wider_suffix = np.empty(len(old), np.uint8), np.empty(len(old), np.uint32)
        wider_lcp[old], wider_suffix[old] = lcp, suffix
        wider_suffix[place] = (alive << 8 | r).astype(np.uint32)
        wider_lcp[place] = 0
        after = place + 1
        wider_lcp[after[after < len(old)]] = 0
        wider_lcp[touched] = np.minimum(least, 254) + 1
        lcp, suffix = wider_lcp, wider_suffix
        # Places as they are after this round.
        follow = np.flatnonzero(old).astype(np.int32)[order]
        left = lengths[alive] > r
        alive, at = alive[left], place[left].astype(np.int32)
    return lcp, (suffix >> 8).astype(np.int64), (suffix & 0xFF).astype(np.int64)


def later_strings(segments: list[bytes], rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of strings of ``length`` bytes that an earlier place also has.

    ``rank`` orders the segments; strings of one segment are ordered by offset.
    """
    lcp, owner, size = common_prefixes(segments)
    together = lcp >= length
    heads = np.flatnonzero(~together)
    runs = np.diff(np.append(heads, len(lcp)))
    several = np.repeat(runs > 1, runs)
    run = np.repeat(np.arange(len(heads)), runs)[several]
    owner, size = owner[several], size[several]
    offset = np.array([len(s) for s in segments], np.int64)[owner] - size
    key = rank[owner] * 256 + offset
    if not len(key):
        return owner, offset
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    earliest = np.repeat(np.minimum.reduceat(key, starts), np.diff(np.append(starts, len(run))))
    return owner[key != earliest], offset[key != earliest]


def _identity(id_col: str, text: Column) -> list[Column]:
    """Documents in order: null ids last; rows with one id are told apart, and ordered, by their text's hashes."""
    high = F.shiftleft(F.hash(text).cast("long"), 32)
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        high.bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit(int(LOW)))).alias("same"),
    ]


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    gram: int = 40,
    carry: list[str] | None = None,
    per_block: int = 200_000,
    collection: int = 5_000,
    as_text: bool = False,
    sample: int = 64,
) -> DataFrame:
    """One row per document: the id, n_bytes, spans (start, end), kept (binary).

    Columns named in ``carry`` come along in a struct ``carried``, whatever their names.

    With ``as_text``, kept is a string; bytes of characters that were cut through are left out.

    A text is its UTF-8 bytes. Bytes covered by a string of ``length`` bytes that also starts
    earlier are removed: in a smaller id, or before in the same document; overlaps count, and
    the input is judged, not what is left. ``spans`` are the maximal removed runs.

    A null text counts as empty; texts shorter than ``length`` are kept whole. Null ids come
    after all others. Rows with one id and text are one document and get the same result; rows
    with one id and different texts are ordered by a hash of the text. Ids are integers. Other
    columns are not read. Very long texts are read in chunks. An empty table gives an empty
    result. ``length`` is at most 128.

    No group grows with the corpus. Segments are dealt by anchor; anchors that one text in
    ``sample`` shows to have more than about ``per_block`` / 8 different segments are dealt by
    segment. An anchor with more than ``collection`` segments has its strings compared one by
    one: each task keeps the earliest place of a string, so few places of it meet in the end.
    """
    carry = carry or []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        *_identity(id_col, text),
        F.struct(F.col(id_col).alias("id"), *[F.struct(*carry).alias("carried")] * bool(carry)).alias("own"),
        text.alias("text"),
    )
    # Equal rows are one document for the search: their places count once, and their text is cut once.
    source = keyed.select("doc", "same", "text")
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total * 2 / (length - gram + 2) / per_block))
    packed = "block long, " + ", ".join(f"{name} binary" for name, _ in ENTRY)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchor and segment of the sampled texts."""
        for _, data, offsets in text_blocks(batches):
            for part, bounds, _ in chunks(data, offsets, length):
                _, _, _, fp, seg = anchors(part, bounds, length, gram)
                pairs = np.unique(np.column_stack([fp, seg]).view(np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["fp", "seg"])

    least = per_block / 8 / sample
    hot = np.zeros(0, np.uint64)
    if total > per_block / 8:
        seen = source.where(F.pmod("same", F.lit(sample)) == 0).mapInArrow(look, "fp long, seg long").distinct()
        often = seen.groupBy("fp").count().where(F.col("count") > least).orderBy(F.desc("count"), "fp").limit(HOT_ANCHORS)
        hot = np.array([r.fp for r in often.collect()], np.int64).view(np.uint64)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        size = 0
        for rows, data, offsets in text_blocks(batches):
            doc, same = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            for part, bounds, shift in chunks(data, offsets, length):
                owner, start, count, fp, seg = anchors(part, bounds, length, gram)
                held.append(
                    Entries(
                        {
                            # Hot anchors have blocks of their own, where only equal segments need to meet.
                            "block": np.where(np.isin(fp, hot), np.uint64(blocks) + seg % np.uint64(blocks), fp % np.uint64(blocks)).astype(np.int64),
                            "fp": (fp >> np.uint64(32)).astype(np.uint32),
                            "seg": seg,
                            "doc": doc[owner],
                            "same": same[owner],
                            "start": (start + shift).astype(np.uint32),
                            "count": count.astype(np.uint16),
                        }
                    )
                )
                size += len(owner)
            if size > 1 << 18:
                yield _deal(Entries.concat(held), blocks)
                held, size = [], 0
        if size:
            yield _deal(Entries.concat(held), blocks)

    found = "doc long, same long, start long, end long, anchor long, way int"

    def settle(rows: pa.Table) -> pa.Table:
        """Repeats of equal segments are removed; the first ones of anchors with several go on."""
        give_back()
        columns = {
            name: np.frombuffer(b"".join(rows[name].to_pylist()), kind) for name, kind in ENTRY
        }
        block = rows["block"][0].as_py()
        columns["block"] = np.full(len(columns["doc"]), block, np.int64)
        own = Entries(columns)
        # Repeats found within one task were sent with count 0 and their number of strings as anchor.
        told = own.count == 0
        done = own.take(told)
        own, first = own.take(~told).in_order()
        again = own.take(~first)
        own = own.take(first)
        _, inverse, counts = np.unique(own.fp, return_inverse=True, return_counts=True)
        number = counts[inverse] if len(own) else np.zeros(0, np.int64)
        several = (number > 1) | (block >= blocks)
        way = np.where((number[several] > collection) | (block >= blocks), SINGLY, TOGETHER)
        open_ = own.take(several)
        removed = Entries.concat([again, done])
        strings = np.concatenate([again.count, done.fp]).astype(np.int64)
        start = np.concatenate([removed.start, open_.start]).astype(np.int64)
        reach = np.concatenate([strings, open_.count]).astype(np.int64) + length - 1
        return pa.table(
            {
                "doc": pa.array(np.concatenate([removed.doc, open_.doc])),
                "same": pa.array(np.concatenate([removed.same, open_.same])),
                "start": pa.array(start),
                "end": pa.array(start + reach),
                "anchor": pa.array(
                    np.concatenate([np.zeros(len(removed), np.int64), (open_.fp.astype(np.int64) * blocks + block) & NO_ID])
                ),
                "way": pa.array(np.concatenate([np.full(len(removed), REMOVED), way]).astype(np.int32)),
            }
        )

    settled = staged(
        source.mapInArrow(survey, packed).groupBy("block").applyInArrow(settle, found), "suffix-segments"
    )
    asked = settled.where(F.col("way") != REMOVED)
    single = F.col("way") == SINGLY
    segments, strings = asked.agg(
        F.count_if(~single), F.coalesce(F.sum(F.when(single, F.col("end") - F.col("start") - length + 1)), F.lit(0))
    ).first()
    collections = max(1, math.ceil(segments / collection))
    # Parts from ``collections`` on hold single strings.
    parts = max(1, math.ceil(strings / collection))
    requests = asked.groupBy("doc", "same").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "anchor", "way"))).alias("wanted")
    )
    cut_type = "part long, doc long, same long, start long, end long, piece binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], [], []]
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py().encode("utf-8")
                doc, same = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for want in batch.column(3)[i].as_py():
                    start, end = want["start"], want["end"]
                    if want["way"] == SINGLY:
                        # Each string by itself, dealt by its own hash.
                        part = np.frombuffer(raw, np.uint8, end - start, start)
                        at = np.arange(len(part) - length + 1)
                        view = np.lib.stride_tricks.sliding_window_view(part, length)
                        held.append((Rolling(part).of(at, at + length), at + start, doc, same, view))
                        size += len(at)
                        if size > 1 << 17:
                            yield _deal_strings(held, collections, parts)
                            held, size = [], 0
                        continue
                    row = (_scramble(want["anchor"]) % collections, doc, same, start, end, raw[start:end])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield _cut_batch(out)
                    out = [[], [], [], [], [], []]
        if out[0]:
            yield _cut_batch(out)
        if held:
            yield _deal_strings(held, collections, parts)

    def compare(rows: pa.Table) -> pa.Table:
        give_back()
        doc, same, start = (rows[c].to_numpy() for c in ("doc", "same", "start"))
        if rows["part"][0].as_py() >= collections:
            told = rows["piece"].is_null().to_numpy()
            end = rows["end"].to_numpy()
            own = np.flatnonzero(~told)
            order, first = _earliest(rows["piece"].combine_chunks().take(pa.array(own)), doc[own], same[own], start[own])
            who, until = _joined(*(c[own[order[~first]]] for c in (doc, same, start)), length)
            who = np.concatenate([np.flatnonzero(told), own[order[~first]][who]])
            return pa.table(
                {
                    "doc": pa.array(doc[who]),
                    "same": pa.array(same[who]),
                    "start": pa.array(start[who]),
                    "end": pa.array(np.concatenate([end[told], until])),
                }
            )
        pieces = rows["piece"].to_pylist()
        rank = np.empty(len(pieces), np.int64)
        rank[np.lexsort((start, same, doc))] = np.arange(len(pieces))
        owner, offset = later_strings(pieces, rank, length)
        order = np.lexsort((offset, owner))
        owner, offset = owner[order], offset[order]
        # Neighbouring strings of a segment are one interval.
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(owner)) - 1 if len(heads) else heads
        who = owner[heads]
        return pa.table(
            {
                "doc": pa.array(doc[who]),
                "same": pa.array(same[who]),
                "start": pa.array(start[who] + offset[heads]),
                "end": pa.array(start[who] + offset[tails] + length),
            }
        )

    once = source.dropDuplicates(["doc", "same"])
    cuts = once.join(requests, ["doc", "same"]).select("doc", "same", "text", "wanted").mapInArrow(cut, cut_type)
    compared = cuts.groupBy("part").applyInArrow(compare, "doc long, same long, start long, end long")
    gone = settled.where(F.col("way") == REMOVED).select("doc", "same", "start", "end").unionByName(compared)
    lists = gone.groupBy("doc", "same").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    joined = keyed.join(lists, ["doc", "same"], "left").select("own", "text", "gone")
    result = T.StructType(
        [
            joined.schema["own"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("spans", span),
            T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
        ]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                own, sizes, spans, kept, held = at, [], [], [], 0
                while at < batch.num_rows and held < 8 << 20:
                    raw = batch.column(1)[at].as_py().encode("utf-8")
                    merged = _merge(batch.column(2)[at])
                    rest, last = [], 0
                    for a, b in merged:
                        rest.append(raw[last:a])
                        last = b
                    rest.append(raw[last:])
                    sizes.append(len(raw))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                    kept.append(b"".join(rest))
                    if as_text:
                        kept[-1] = kept[-1].decode("utf-8", "ignore")
                    held += len(raw)
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(own, at - own), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string() if as_text else pa.binary())],
                    names=result.names,
                )

    carried = [F.col("own.carried").alias("carried")] * bool(carry)
    return joined.mapInArrow(remove, result).select(F.col("own.id").alias(id_col), *carried, "n_bytes", "spans", "kept")


def _deal(own: Entries, blocks: int) -> pa.RecordBatch:
    """One row of packed columns per block. Only the first of a task's equal segments goes to its
    anchor's block; the others are told as removed (count 0, the number of strings as anchor)."""
    own, first = own.in_order()
    told = np.flatnonzero(~first)
    columns = {k: v.copy() for k, v in own.columns.items()}
    columns["fp"][told] = columns["count"][told]
    columns["block"][told] = _anywhere(*(columns[k][told] for k in ("doc", "same", "start")), blocks)
    columns["count"][told] = 0
    order = np.argsort(columns["block"], kind="stable")
    block = columns["block"][order]
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    parts = np.split(order, heads[1:])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block[heads]),
            *(pa.array([columns[n][p].astype(k).tobytes() for p in parts], pa.binary()) for n, k in ENTRY),
        ],
        names=["block", *(n for n, _ in ENTRY)],
    )


def _scramble(key: int) -> int:
    return (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 20


def _anywhere(doc: np.ndarray, same: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """One of ``n`` numbers for each place; a document's places are not kept together."""
    word = doc.astype(np.int64).view(np.uint64) ^ mix(same.view(np.uint64) ^ start.astype(np.uint64))
    return (mix(word) % np.uint64(n)).astype(np.int64)


def _earliest(pieces: pa.Array, doc: np.ndarray, same: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order, and which of them hold bytes that none before holds."""
    order = np.lexsort((start, same, doc))
    codes = pieces.dictionary_encode().indices.to_numpy()[order]
    first = np.zeros(len(order), bool)
    first[np.unique(codes, return_index=True)[1]] = True
    return order, first


def _joined(doc: np.ndarray, same: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row, end) of the runs of neighbouring strings; rows come in order."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (same[1:] != same[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1 if len(heads) else heads
    return heads, start[tails] + length


def _deal_strings(held: list[tuple], collections: int, parts: int) -> pa.RecordBatch:
    """Single strings: the earliest place of each goes to its part; of the others only the bounds go on."""
    sizes = [len(h[1]) for h in held]
    hashes, start = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    doc, same = (np.repeat(np.array([h[k] for h in held], np.int64), sizes) for k in (2, 3))
    rows = np.concatenate([h[4] for h in held])
    n, length = rows.shape
    offsets = pa.py_buffer(np.arange(0, (n + 1) * length, length, dtype=np.int32))
    pieces = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(rows)])
    order, first = _earliest(pieces, doc, same, start)
    own, again = order[first], order[~first]
    heads, end = _joined(doc[again], same[again], start[again], length)
    again = again[heads]
    who = np.concatenate([own, again])
    part = np.concatenate([(hashes[own] % np.uint64(parts)).astype(np.int64), _anywhere(doc[again], same[again], start[again], parts)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part + collections),
            pa.array(doc[who]),
            pa.array(same[who]),
            pa.array(start[who]),
            pa.array(np.concatenate([start[own] + length, end])),
            pa.concat_arrays([pieces.take(pa.array(own)), pa.nulls(len(again), pa.binary())]),
        ],
        names=["part", "doc", "same", "start", "end", "piece"],
    )


def _cut_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "doc", "same", "start", "end", "piece"]
    )


def _merge(gone: pa.Scalar) -> list[tuple[int, int]]:
    """Maximal runs of intervals that overlap or touch."""
    if not gone.is_valid or not len(gone.values):
        return []
    start, end = (gone.values.field(i).to_numpy() for i in (0, 1))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    heads = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    tails = np.append(heads[1:], len(start)) - 1
    return list(zip(start[heads].tolist(), reach[tails].tolist(), strict=True))
