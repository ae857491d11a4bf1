"""N-gram Jaccard join: a blocked sparse product of the incidence matrix of sets and n-grams."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import give_back, mix, staged, text_blocks
from corpusq.llm.components import components
from corpusq.session import cut_lineage

_RNG = np.random.default_rng(20_240_601)
BYTE_WORDS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
for _c in range(65, 91):
    BYTE_WORDS[_c] = BYTE_WORDS[_c + 32]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
PLACE = np.uint64(0x9E3779B97F4A7C15)
STEPS = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts of a block, and the first word of each text.

    A-Z are lower-cased by the table of bytes. A word's hash is a difference of running sums
    of its bytes, each scrambled with its place in the word.
    """
    n = len(data)
    solid = ~IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if n else solid
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.concatenate([solid[1:], [False]]) if n else solid
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    place = np.arange(1, n + 1, dtype=np.uint64)
    if len(starts):
        place[starts[0] :] -= np.repeat(starts, np.diff(starts, append=n)).astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(BYTE_WORDS[data] ^ (place * PLACE)), out=sums[1:])
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text.

    A text of fewer words is one shingle, a text without words has none.
    """
    n = len(words)
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size if len(full) else 0):
        full += words[j : j + len(full)] * STEPS[j]
    full = mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(full[a : b - size + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            short = (words[a:b] * STEPS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class FrequentCounter:
    """Counts of the most frequent hashes of a stream in bounded memory.

    When full, the count at rank ``capacity`` is taken off all entries and those at zero go,
    so a hash of more than (stream / capacity) occurrences is always held.
    """

    def __init__(self, capacity: int = 1 << 17, buffer: int = 1 << 19):
        self.capacity, self.buffer = capacity, buffer
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, hashes: list[np.ndarray]) -> None:
        self.waiting += hashes
        self.held += sum(map(len, hashes))
        if self.held >= self.buffer:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            new, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.waiting, self.held = [], 0
            keys, place = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
            total = np.bincount(place, np.concatenate([self.counts, counts]), len(keys)).astype(np.int64)
            if len(keys) > self.capacity:
                total -= np.partition(total, -self.capacity)[-self.capacity]
            self.keys, self.counts = keys[total > 0], total[total > 0]


class CellCounts:
    """How often the hashes that fall into each cell of a table of fixed length occur.

    No cell counts less than a hash of its own: where most hashes are unique, one that several
    sets hold nearly always lies in a fuller cell than the sets' own hashes, however many there are.
    """

    SLICE = 1 << 16

    def __init__(self, cells: int):
        self.counts = np.zeros(cells, np.uint32)

    @staticmethod
    def places(hashes: np.ndarray, cells: int) -> np.ndarray:
        """A cell for each hash, by bits that blocks and bitmaps do not use; ``cells`` is a power of two."""
        return ((hashes >> np.uint64(24)) & np.uint64(cells - 1)).astype(np.int64)

    def add(self, hashes: list[np.ndarray]) -> None:
        for s in hashes:
            np.add.at(self.counts, self.places(s, len(self.counts)), np.uint32(1))

    def slices(self) -> Iterator[tuple[int, bytes]]:
        """Number and packed counts of each slice with any count, in the narrowest type."""
        for i in range(-(-len(self.counts) // self.SLICE)):
            own = self.counts[i * self.SLICE : (i + 1) * self.SLICE]
            if most := int(own.max()):
                yield i, zlib.compress(own.astype(np.min_scalar_type(most)).tobytes(), 1)

    def add_slice(self, i: int, packed: bytes) -> None:
        own = self.counts[i * self.SLICE : (i + 1) * self.SLICE]
        raw = zlib.decompress(packed)
        new = np.frombuffer(raw, f"u{len(raw) // len(own)}")
        # A full cell stays full.
        own += np.minimum(new, np.iinfo(np.uint32).max - own)


def prefix(hashes: np.ndarray, rank: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """First hashes of a set in the common order; two sets that link share a hash within these.

    Those not frequent come by the counts of their cells, equal counts by value; then frequent
    ones, rarest first. ``hashes`` are sorted.
    """
    n = len(hashes)
    size = n - -(-percent * n // 100) + 1
    rare = hashes[rank < 0]
    rare = rare[np.argsort(common[rank < 0], kind="stable")[:size]]
    if len(rare) == size:
        return rare
    often = rank >= 0
    return np.concatenate([rare, hashes[often][np.argsort(rank[often])][: size - len(rare)]])


def may_link(n_a, at_a, n_b, at_b, percent: int):
    """Can sets of these sizes link if their first common hash is at these places of the order?

    At most what follows can be common; 100 * overlap must reach percent * union.
    """
    return (100 + percent) * np.minimum(n_a - at_a, n_b - at_b) >= percent * (n_a + n_b)


class Lists:
    """Rows of the transposed incidence matrix: for each n-gram held by two sets or more, its sets."""

    def __init__(self, token, key, size, place):
        self.token, self.key, self.size, self.place = token, key, size, place
        self.starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
        self.lengths = np.diff(np.append(self.starts, len(token)))

    @classmethod
    def gather(cls, token, key, size, place) -> Lists:
        order = np.lexsort((key, place, token))
        token, key, size, place = token[order], key[order], size[order], place[order]
        # Equal sets have equal places: their repeats are neighbours.
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, size, place = token[new], key[new], size[new], place[new]
        _, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
        several = counts[inverse] > 1 if len(token) else np.zeros(0, bool)
        return cls(token[several], key[several], size[several], place[several])

    def columns(self) -> list[tuple[str, np.ndarray]]:
        return [(c, getattr(self, c)) for c, _ in COLUMNS]

    def star(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of each list's first set with the others.

        It is the set with the fewest n-grams of its own before the common one: of a group of
        near copies the one that most others are close to.
        """
        head = np.repeat(self.starts, self.lengths)
        ok = may_link(self.size[head], self.place[head], self.size, self.place, percent)
        ok &= head != np.arange(len(head))
        return self.key[head][ok], self.key[ok]

    def rest(self, roots: np.ndarray, percent: int, cells: int = 1 << 19):
        """All pairs of sets of different components, without those of ``star``; in blocks of bounded size.

        Within an n-gram, sets are sorted by size, so a set looks only at the run of sizes that
        its own size and place leave possible. Pairs inside the component that holds most of an
        n-gram's sets are never looked at: one side of each pair is of another component.
        """
        if not len(roots):
            return
        several = np.repeat(
            np.minimum.reduceat(roots, self.starts) != np.maximum.reduceat(roots, self.starts), self.lengths
        )
        several[self.starts] = False  # the first sets have met all others
        which = np.repeat(np.arange(len(self.starts)), self.lengths)[several]
        if not len(which):
            return
        key, size, place, root = self.key[several], self.size[several], self.place[several], roots[several]
        order = np.lexsort((size, which))
        which, key, root = which[order], key[order], root[order]
        size, place = size[order].astype(np.int64), place[order].astype(np.int64)
        minor = root != _most_held(which, root)[which]
        wide = np.int64(1) << 32
        rows = which * wide + size
        # Smaller partners of any component: percent * larger <= 100 * smaller, and the larger one's part of may_link.
        least = -(-percent * size // 100)
        most = np.minimum((100 + percent) * (size - place) // percent - size, size)
        low = np.searchsorted(rows, which * wide + least)
        high = np.minimum(np.searchsorted(rows, which * wide + np.maximum(most, 0), side="right"), np.arange(len(rows)))
        every = np.arange(len(rows))
        # Larger partners of the component that holds most.
        major = np.flatnonzero(~minor)
        above = np.searchsorted(major, every)
        up_to = np.searchsorted(rows[major], which * wide + 100 * size // percent, side="right")
        for partners, first, last in ((every, low, high), (major, above, up_to)):
            many = np.where(minor, np.maximum(last - first, 0), 0)
            ends = np.cumsum(many)
            at = 0
            while at < len(many) and ends[-1] > (ends[at - 1] if at else 0):
                done = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, done + cells, side="right")))
                counts = many[at:stop]
                a = np.repeat(np.arange(at, stop), counts)
                b = np.arange(len(a)) - np.repeat(ends[at:stop] - counts - done, counts) + np.repeat(first[at:stop], counts)
                b = partners[b]
                ok = root[a] != root[b]
                ok &= may_link(size[a], place[a], size[b], place[b], percent)
                yield key[a[ok]], key[b[ok]]
                at = stop


def _most_held(which: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each list that occurs in ``which``, by its number, the component of most of its sets."""
    order = np.lexsort((root, which))
    which, root = which[order], root[order]
    heads = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (root[1:] != root[:-1])]))
    lengths = np.diff(heads, append=len(which))
    out = np.zeros(int(which[-1]) + 1, root.dtype)
    by_length = np.argsort(lengths, kind="stable")
    out[which[heads[by_length]]] = root[heads[by_length]]  # the longest run is written last
    return out


def _ordered(pairs) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs with the smaller key first."""
    kept, waiting, held = np.zeros((0, 2), np.int64), [], 0

    def merge() -> np.ndarray:
        both = np.concatenate([kept, *waiting])
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        new = np.ones(len(both), bool)
        new[1:] = (both[1:] != both[:-1]).any(axis=1)
        return both[new]

    for a, b in pairs:
        waiting.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]).astype(np.int64))
        held += len(a)
        if held > max(1 << 19, len(kept)):
            kept, waiting, held = merge(), [], 0
    kept = merge()
    return kept[:, 0], kept[:, 1]


def set_key(hashes: np.ndarray) -> int:
    return struct.unpack("<q", hashlib.blake2b(hashes.tobytes(), digest_size=8).digest())[0]


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash of a set, in a power of two of bits: two or more for each hash."""
    bits = 64
    while bits < 2 * len(hashes):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def most_shared(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """No two sets of these bitmaps share more hashes: a bit of one alone is a hash of it alone."""
    a, b, width = int.from_bytes(bits_a, "little"), int.from_bytes(bits_b, "little"), 8 * len(bits_a)
    if len(bits_a) > len(bits_b):
        a, b, width = b, a, 8 * len(bits_b)
        n_a, n_b = n_b, n_a
    low = (1 << width) - 1
    while b >> width:
        b = (b & low) | (b >> width)
    return min(n_a - (a & ~b).bit_count(), n_b - (b & ~a).bit_count())


def _shingles(size: int):
    def of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        return shingle_hashes(*word_hashes(data, offsets), size)

    return of


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 75,
    frequent: int = 50_000,
    postings_per_block: int = 200_000,
    broadcast_rows: int = 1_000_000,
    cells: int = 1 << 22,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set is its distinct ``words``-word shingles (A-Z lower-cased, ASCII white
    space between words); with fewer words the whole sequence, without words the set is empty
    and links with nothing. Two documents link when 100 * intersection >= percent * union. The
    component is named by its smallest id. A component's links are found as far as they
    connect it; none between different components is left out.

    Equal sets are one row of the incidence matrix. Its product with its transpose is made in
    blocks of n-grams: only the first n-grams of each set in an order of rising frequency take
    part, and pairs below bounds from sizes and places are discarded. First each n-gram's
    sets meet the most central of them; then sets of components still different meet, their
    roots carried in the blocks. Of the pairs left, bitmaps of the sets bound the overlap, and
    what may still link is counted over all n-grams of the two sets. The frequent n-grams, and
    the counts of all n-grams in a table of ``cells`` cells (a power of two), only choose the
    order: any such list and table give the same result. The table puts a set's own n-grams
    before those of a passage it shares with others, so that sets with nothing else in common
    rarely meet. Its length is fixed, and so is what a count stands out by: it is off by about
    the root of n-grams per cell, while a passage's count grows with the documents.

    A null text counts as empty. A null id is larger than any other and names a component only
    of null ids. Rows with one id are judged each by its text. Other columns are not read. An
    empty table gives an empty result. Sets are told apart by 64-bit hashes of 64-bit hashes.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key_type = source.schema["doc_id"].dataType.simpleString()
    shingles = _shingles(words)

    names = ["kind", "doc_id", "key", "n", "bits"]

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, table, kind = FrequentCounter(), CellCounts(cells), None
        for rows, data, offsets in text_blocks(batches):
            kind = rows.column(0).type
            sets = shingles(data, offsets)
            counter.add(sets)
            table.add(sets)
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * len(sets), pa.int32()),
                    rows.column(0),
                    pa.array(keys, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([bitmap(s) for s in sets], pa.binary()),
                ],
                names=names,
            )
        counter.merge()
        often = counter.counts > 1
        if often.any():
            found, counts = counter.keys[often], counter.counts[often]
            top = np.argsort(-counts, kind="stable")[: 2 * frequent]
            none = pa.nulls(len(top), kind)
            bits = pa.nulls(len(top), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([1] * len(top), pa.int32()), none, pa.array(found[top].view(np.int64)), pa.array(counts[top]), bits],
                names=names,
            )
        for i, packed in table.slices():
            yield pa.RecordBatch.from_arrays(
                [pa.array([2], pa.int32()), pa.nulls(1, kind), pa.array([i]), pa.array([0]), pa.array([packed])], names=names
            )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the slices of a task, up to what two bytes hold."""
        table, held = None, set()
        for batch in batches:
            table = table or CellCounts(cells)
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table.add_slice(i, packed)
                held.add(i)
        if held:
            np.minimum(table.counts, np.iinfo(np.uint16).max, out=table.counts)
            yield pa.RecordBatch.from_pylist([{"slice": i, "counts": x} for i, x in table.slices()])

    found = staged(
        source.mapInArrow(survey, f"kind int, doc_id {key_type}, key long, n long, bits binary"), "shingle-sets"
    )
    meta = found.where("kind = 0").drop("kind")
    often = (
        found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "key").limit(frequent)
    )
    # A list of fixed length, however many documents there are.
    often = np.array([r[0] for r in often.select("key").collect()], np.int64).view(np.uint64)
    by_hash = np.argsort(often)
    sorted_often, ranks = often[by_hash], (len(often) - by_hash).astype(np.int64)
    table = CellCounts(cells)
    slices = found.where("kind = 2").select(F.col("key").alias("slice"), F.col("bits").alias("counts"))
    for i, packed in slices.repartition("slice").mapInArrow(summed, "slice long, counts binary").collect():
        table.add_slice(i, packed)
    counts_of = table.counts.astype(np.uint16)
    total = meta.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total * (100 - percent) / 100 / postings_per_block))

    def rank_of(hashes: np.ndarray) -> np.ndarray:
        if not len(sorted_often):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(sorted_often, hashes), len(sorted_often) - 1)
        return np.where(sorted_often[at] == hashes, ranks[at], -1)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in text_blocks(batches, 1 << 20):
            sets: dict[int, np.ndarray] = {}
            for s in shingles(data, offsets):
                if len(s):
                    sets.setdefault(set_key(s), s)
            if not sets:
                continue
            firsts = [prefix(s, rank_of(s), counts_of[CellCounts.places(s, cells)], percent) for s in sets.values()]
            lengths = [len(f) for f in firsts]
            token = np.concatenate(firsts)
            key = np.repeat(np.array(list(sets), np.int64), lengths)
            size = np.repeat(np.array([len(s) for s in sets.values()], np.int32), lengths)
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            block = (token % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            heads = np.flatnonzero(np.diff(block[order], prepend=-1))
            parts = np.split(order, heads[1:])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[order][heads]),
                    *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (token, key, size, place)),
                ],
                names=["block", "token", "key", "size", "place"],
            )

    def gather(rows: pa.Table) -> pa.Table:
        give_back()
        lists = Lists.gather(*(_joined(rows, c, d) for c, d in COLUMNS))
        return _packed(rows["block"][0].as_py(), lists)

    blocked = "block long, token binary, key binary, size binary, place binary"
    lists = staged(source.mapInArrow(postings, blocked).groupBy("block").applyInArrow(gather, blocked), "ngram-lists")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = pa.Table.from_batches([batch.slice(i, 1)])
                yield _pair_batch(*_ordered([_unpacked(own).star(percent)]))

    pair_type = "a long, b long"
    first = cut_lineage(lists.mapInArrow(star, pair_type).distinct())
    reps = meta.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    tools = (source, meta, reps, shingles, percent, broadcast_rows)
    links = cut_lineage(_verified(first, *tools))
    roots = components(links)

    def by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                held = _unpacked(pa.Table.from_batches([batch.slice(i, 1)]))
                yield _dealt((held.key % blocks).astype(np.int64), "bucket", "block", block, held.columns())

    def labelled(own: pa.Table, labels: pa.Table) -> pa.Table:
        """Entries of a bucket of sets with the sets' roots, dealt to the blocks of their n-grams again."""
        give_back()
        out = []
        node, root = labels["node"].to_numpy(), labels["root"].to_numpy()
        order = np.argsort(node)
        node, root = node[order], root[order]
        if own.num_rows:
            counts = [len(x) // 8 for x in own["key"].to_pylist()]
            entries = [_joined(own, c, d) for c, d in COLUMNS]
            label = entries[1].copy()
            if len(node):
                at = np.minimum(np.searchsorted(node, label), len(node) - 1)
                label = np.where(node[at] == label, root[at], label)
            block = np.repeat(own["block"].to_numpy(), counts)
            columns = [*zip([c for c, _ in COLUMNS], entries, strict=True), ("root", label)]
            out.append(_dealt(block, "block", None, 0, columns))
        return pa.Table.from_batches(out, _schema("block", None, "root"))

    def rest(rows: pa.Table) -> pa.Table:
        give_back()
        entries = [_joined(rows, c, d) for c, d in [*COLUMNS, ("root", np.int64)]]
        order = np.lexsort((entries[1], entries[3], entries[0]))
        token, key, size, place, root = (x[order] for x in entries)
        return pa.Table.from_batches([_pair_batch(*_ordered(Lists(token, key, size, place).rest(root, percent)))])

    parts = lists.mapInArrow(by_sets, "bucket long, block long, token binary, key binary, size binary, place binary")
    dealt = roots.withColumn("bucket", F.pmod("node", F.lit(blocks)).cast("long"))
    again = parts.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(labelled, f"{blocked}, root binary")
    second = again.groupBy("block").applyInArrow(rest, pair_type)
    second = cut_lineage(second.distinct().join(first, ["a", "b"], "left_anti"))
    more = cut_lineage(_verified(second, *tools))
    # Both sides of a new link are taken to what the first round found.
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
    joined = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
        F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")
    )
    upper = components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
    spread = roots.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    lone = upper.join(roots.select(F.col("node").alias("root")), "root", "left_anti")
    final = cut_lineage(spread.unionByName(lone.select(F.col("root").alias("node"), F.col("top").alias("root"))))
    named = reps.join(final, reps["key"] == final["node"], "left").select(
        "key", F.coalesce("root", "key").alias("root"), "doc_id"
    )
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = cut_lineage(named.join(names, "root").select("key", "component_id"))
    full = meta.where("n > 0").join(classes, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = meta.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


COLUMNS = [("token", np.uint64), ("key", np.int64), ("size", np.int32), ("place", np.int32)]


def _joined(rows: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column].to_pylist()), kind)


def _packed(block: int, lists: Lists) -> pa.Table:
    columns = {"block": pa.array([block], pa.int64())}
    for name, kind in COLUMNS:
        columns[name] = pa.array([getattr(lists, name).astype(kind).tobytes()], pa.binary())
    return pa.table(columns)


def _schema(first: str, second: str | None, *more: str) -> pa.Schema:
    numbers = [(c, pa.int64()) for c in (first, second) if c]
    return pa.schema(numbers + [(c, pa.binary()) for c in (*(c for c, _ in COLUMNS), *more)])


def _dealt(to: np.ndarray, name: str, other: str | None, value: int, columns: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
    """One row for each number in ``to``, its entries packed; ``other`` is a column of one value."""
    order = np.argsort(to, kind="stable")
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(to)), bool), np.diff(to[order]) != 0]))
    arrays = [pa.array(to[order][heads], pa.int64())]
    if other:
        arrays.append(pa.array(np.full(len(heads), value), pa.int64()))
    for _, x in columns:
        arrays.append(pa.array([x[p].tobytes() for p in np.split(order, heads[1:])][: len(heads)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=[n for n in (name, other) if n] + [c for c, _ in columns])


def _unpacked(row: pa.Table) -> Lists:
    return Lists(*(_joined(row, c, d) for c, d in COLUMNS))


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(
    pairs: DataFrame, source: DataFrame, meta: DataFrame, reps: DataFrame, shingles, percent: int, broadcast_rows: int
) -> DataFrame:
    """Pairs whose overlap, counted over all n-grams, reaches the bound.

    Bitmaps of the sets bound the overlap first, so whole sets move only for pairs that
    nearly all link.
    """

    def ends(of: DataFrame) -> DataFrame:
        return of.select(F.col("a").alias("key")).union(of.select("b")).distinct()

    def sides(table: DataFrame, column: str) -> list[DataFrame]:
        return [
            table.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col(column).alias(f"{column}_{c}"))
            for c in ("a", "b")
        ]

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b"))
            keep = []
            for n_a, bits_a, n_b, bits_b in zip(*columns, strict=True):
                keep.append((100 + percent) * most_shared(n_a, bits_a, n_b, bits_b) >= percent * (n_a + n_b))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = ends(pairs)
    sketches = meta.join(wanted, "key", "left_semi").groupBy("key").agg(F.max("n").alias("n"), F.max("bits").alias("bits"))
    of_a, of_b = sides(cut_lineage(sketches), "bits")
    maybe = cut_lineage(pairs.join(of_a, "a").join(of_b, "b").mapInArrow(bounded, "a long, b long"))

    needed = cut_lineage(reps.join(ends(maybe), "key"))
    ids = needed.select(F.col("doc_id").alias("_id")).distinct()
    if needed.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    texts = source.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, offsets in text_blocks(batches):
            new = {set_key(s): s for s in shingles(data, offsets)}
            found = [s for key, s in new.items() if key not in seen]
            if not found:
                continue
            seen.update(new)
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([set_key(s) for s in found], pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(found).view(np.int64))),
                ],
                names=["key", "n", "grams"],
            )

    held = texts.mapInArrow(sets, "key long, n long, grams array<long>")
    # Rows of one id may hold other texts, and repeated rows one text; a task sends a set once.
    held = staged(held.join(needed.select("key"), "key", "left_semi"), "candidate-sets")
    of_a, of_b = sides(held, "grams")
    overlap = F.size(F.array_intersect("grams_a", "grams_b"))
    joined = maybe.join(of_a, "a").join(of_b, "b")
    return joined.where((100 + percent) * overlap >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()
