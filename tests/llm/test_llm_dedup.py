"""Exact, line, passage and near-duplicate removal against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.llm import exact_dedup, line_dedup, ngram_join, suffix_dedup
from corpusq.llm.components import components
from tests.llm import hostile


def test_exact_dedup(spark):
    rows = hostile.texts()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hostile.low(t or "")].append(i)
    want = []
    for i, t in rows:
        own = groups[hostile.low(t or "")]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hostile.sha(hostile.low(t or ""))))
    # Slices of one byte: several filters in turn.
    for options in ({}, {"filter_bytes": 16}):
        got = exact_dedup.exact_dedup(hostile.documents(spark), **options).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(hostile.documents(spark, [])).count() == 0


def plain_lines(rows, least=10):
    docs_of = defaultdict(set)
    keyed = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [hostile.low(x.strip(hostile.SPACES)) for x in lines]
        keyed.append((i, lines, keys))
        for k in keys:
            if len(k) >= least:
                docs_of[k].add(i)
    out = []
    for i, lines, keys in keyed:
        kept = [
            x for x, k in zip(lines, keys, strict=True)
            if len(docs_of[k]) < 2 or min(docs_of[k], key=hostile.order) == i
        ]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lines_of(df):
    return sorted(((r.doc_id, *r.line_dedup) for r in df.collect()), key=str)


def test_line_dedup(spark):
    docs = hostile.documents(spark)
    cleaned = line_dedup.dedup_lines(docs)
    assert cleaned.columns == [*docs.columns, "line_dedup"]
    assert lines_of(cleaned) == plain_lines(hostile.texts())
    assert lines_of(line_dedup.dedup_lines(docs, broadcast_bytes=0)) == plain_lines(hostile.texts())
    assert line_dedup.dedup_lines(hostile.documents(spark, [])).count() == 0


def test_line_dedup_is_reversible(spark):
    rows = [r for r in hostile.texts() if r[0] is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    first, later = [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2]
    index = line_dedup.build_index(hostile.documents(spark, first))
    both = line_dedup.insert(index, hostile.documents(spark, later))
    docs = hostile.documents(spark, rows)
    assert lines_of(line_dedup.dedup_lines(docs, both)) == plain_lines(rows)
    gone = spark.createDataFrame([(i,) for i, _ in first], "doc_id long")
    rest = line_dedup.delete(both, gone)
    assert lines_of(line_dedup.dedup_lines(hostile.documents(spark, later), rest)) == plain_lines(later)
    back = line_dedup.delete(both, spark.createDataFrame([(i,) for i, _ in later], "doc_id long"))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, index.counts.collect()))
    assert lines_of(line_dedup.dedup_lines(hostile.documents(spark, first), back)) == plain_lines(first)


def test_cuckoo_filter_holds_and_forgets():
    rng = random.Random(1)
    keys = [(rng.getrandbits(63) - (1 << 62), rng.getrandbits(63) - (1 << 62)) for _ in range(5000)]
    made = line_dedup.CuckooFilter.build([a for a, _ in keys], [b for _, b in keys])
    assert all(k in made for k in keys)
    assert made.buckets * line_dedup.SLOTS <= 4 * len(keys)
    for k in keys[:2500]:
        assert made.delete(*k)
    assert all(k in made for k in keys[2500:])
    assert sum(k in made for k in keys[:2500]) < 50
    full = line_dedup.CuckooFilter(1)
    assert [full.insert(i, i) for i in range(5)] == [True] * 4 + [False]


def plain_repeats(rows, length=100):
    """Removed spans by (id, text); rows of one id and text are one document."""
    seen, out = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - length + 1):
            piece = raw[j : j + length]
            if piece in seen:
                gone[j : j + length] = b"\1" * length
            else:
                seen.add(piece)
        spans, at = [], 0
        while (a := gone.find(1, at)) >= 0:
            b = gone.find(0, a)
            at = b if b >= 0 else len(raw)
            spans.append((a, at))
        out[i, t or ""] = (len(raw), spans, bytes(x for x, g in zip(raw, gone, strict=True) if not g))
    return out


def in_order(spark, rows):
    """As the operator orders them: by id, nulls last, then by the hash of the text; repeats once."""
    texts = sorted({t or "" for _, t in rows})
    hashes = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.hash("t").alias("h")).collect()
    known = {r.t: r.h for r in hashes}
    return sorted({(i, t or "") for i, t in rows}, key=lambda r: (*hostile.order(r[0]), known[r[1]]))


@pytest.mark.parametrize("options", [{}, {"collection": 1, "per_block": 40}, {"as_text": True}])
def test_suffix_dedup(spark, options):
    rows = hostile.texts()
    want = plain_repeats(in_order(spark, rows))
    docs = hostile.documents(spark)
    # The text is carried to tell rows of one id apart.
    got = suffix_dedup.remove_repeats(docs.withColumn("copy", F.col("text")), carry=["copy", "n", "kept"], **options).collect()
    assert len(got) == len(rows)
    for r in got:
        size, spans, kept = want[r["doc_id"], r["carried"]["copy"] or ""]
        assert (r["n_bytes"], [tuple(s) for s in r["spans"]]) == (size, spans)
        assert r["kept"] == (kept.decode("utf-8", "ignore") if options.get("as_text") else kept)
    assert suffix_dedup.remove_repeats(hostile.documents(spark, [])).count() == 0


@pytest.mark.parametrize("options", [{}, {"collection": 1, "per_block": 40}])
def test_suffix_dedup_keeps_the_text_of_repeated_rows(spark, options):
    rng = random.Random(8)
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    alone, twice, nobody = (" ".join(rng.choice(words) for _ in range(80)) for _ in range(3))
    # A second document with the same passage in other surroundings sends the text to the collections too.
    passage = " ".join(rng.choice(words) for _ in range(30))
    shared, later = f"{alone} {passage} left", f"other words {passage} right"
    # A repeat inside a text still goes, in both of its rows.
    rows = [(1, shared), (1, shared), (2, later), (2, later), (3, twice + "\n" + twice), (3, twice + "\n" + twice)]
    rows += [(None, nobody), (None, nobody)]
    want = plain_repeats(in_order(spark, rows))
    for parts in (1, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = suffix_dedup.remove_repeats(docs, carry=["text"], **options).collect()
        assert len(got) == len(rows)
        for r in got:
            size, spans, kept = want[r["doc_id"], r["carried"]["text"]]
            assert (r["n_bytes"], [tuple(s) for s in r["spans"]], r["kept"]) == (size, spans, kept)
            assert r["kept"]


def test_suffix_dedup_bounds_its_groups(spark, monkeypatch, tmp_path):
    """A passage in many texts, each time in other surroundings: a few hot anchors, and edges that are all equal."""
    rng = random.Random(9)
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(40)
    rows = [(i, f"{say(25)} {passage} {say(25)}") for i in range(600)]
    want = plain_repeats(in_order(spark, rows))
    sizes = str(tmp_path / "sizes")

    def note(kind, size):
        with open(sizes, "a") as out:
            out.write(f"{kind} {size}\n")

    class Noting(suffix_dedup.Entries):
        def take(self, rows):
            if len(set(self.block.tolist())) == 1:
                note("settle", len(self))
            return super().take(rows)

    plain = suffix_dedup.later_strings

    def noting(segments, rank, length):
        note("collection", len(segments))
        return plain(segments, rank, length)

    # What the nested functions read from their module goes to the workers as it is here.
    monkeypatch.setattr(suffix_dedup, "Entries", Noting)
    monkeypatch.setattr(suffix_dedup, "later_strings", noting)
    if earliest := getattr(suffix_dedup, "_earliest", None):

        def strings(pieces, *place):
            note("strings", len(pieces))
            return earliest(pieces, *place)

        monkeypatch.setattr(suffix_dedup, "_earliest", strings)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    options = {"sample": 1} if earliest else {}
    for r in suffix_dedup.remove_repeats(docs, per_block=100, collection=50, **options).collect():
        size, spans, kept = want[r.doc_id, rows[r.doc_id][1]]
        assert (r.n_bytes, [tuple(s) for s in r.spans], r.kept) == (size, spans, kept)
    noted = defaultdict(int)
    for kind, size in map(str.split, open(sizes)):
        noted[kind] = max(noted[kind], int(size))
    assert noted["settle"] and max(noted.values()) < 400, dict(noted)


def test_equal_strings_of_a_task_go_on_once():
    data = np.frombuffer(b"".join(bytes([i % 7]) for i in range(30)), np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(data, 10)
    at = np.arange(len(view))
    held = [(suffix_dedup.Rolling(data).of(at, at + 10), at, doc, 0, view) for doc in (4, 2, 3)]
    rows = suffix_dedup._deal_strings(held, 5, 2).to_pylist()
    # The 7 different strings go on from the first document; the rest is told as whole runs.
    assert sorted((r["doc"], r["start"], r["piece"]) for r in rows if r["piece"]) == [(2, i, data[i : i + 10].tobytes()) for i in range(7)]
    assert sorted((r["doc"], r["start"], r["end"]) for r in rows if not r["piece"]) == [(2, 7, 30), (3, 0, 30), (4, 0, 30)]
    assert {r["part"] for r in rows} <= {5, 6}


def test_later_strings():
    rng = random.Random(3)
    for _ in range(150):
        length = rng.choice([3, 4, 6])
        segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 14))) for _ in range(rng.randint(1, 9))]
        rank = np.array(rng.sample(range(len(segments)), len(segments)), np.int64)
        owner, offset = suffix_dedup.later_strings(segments, rank, length)
        seen, want = set(), set()
        for k in np.argsort(rank).tolist():
            for j in range(len(segments[k]) - length + 1):
                piece = segments[k][j : j + length]
                if piece in seen:
                    want.add((k, j))
                seen.add(piece)
        assert want == set(zip(owner.tolist(), offset.tolist(), strict=True))


def test_common_prefixes_are_those_of_sorted_suffixes():
    rng = random.Random(4)
    segments = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 20))) for _ in range(12)]
    lcp, owner, size = suffix_dedup.common_prefixes(segments)
    suffixes = [segments[o][len(segments[o]) - s :] for o, s in zip(owner, size, strict=True)]
    ends = [s + b"\xff" for s in suffixes]
    assert ends == sorted(ends)
    for a, b, common in zip(suffixes, suffixes[1:], lcp[1:], strict=False):
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common == n


def test_chunks_of_a_long_text_cover_each_string_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5000)
    data = np.random.default_rng(2).integers(97, 101, 33_333).astype(np.uint8)
    found = []
    for part, bounds, shift in suffix_dedup.chunks(data, np.array([0, len(data)]), 100):
        _, start, count, _, _ = suffix_dedup.anchors(part, bounds, 100, 16)
        found += [s + shift + j for s, c in zip(start.tolist(), count.tolist(), strict=True) for j in range(c)]
    assert found == list(range(len(data) - 99))


def plain_components(rows):
    sets = [hostile.shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if hostile.linked(sets[a], sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return sorted(
        (
            (i, len(sets[k]), min((x for x in groups[find(k)] if x is not None), default=None))
            for k, (i, _) in enumerate(rows)
        ),
        key=str,
    )


@pytest.mark.parametrize("options", [{}, {"frequent": 3, "postings_per_block": 60, "broadcast_rows": 0}])
def test_ngram_join(spark, options):
    rng = random.Random(8)
    rows = hostile.texts()
    base = [f"w{rng.randint(0, 40)}" for _ in range(60)]
    for i in range(60):
        words = base[:]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"v{rng.randint(0, 400)}"
        rows.append((500 + i, " ".join(words[rng.randint(0, 6) :])))
    got = ngram_join.ngram_join(hostile.documents(spark, rows), **options)
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows)
    assert ngram_join.ngram_join(hostile.documents(spark, []), **options).count() == 0


def test_word_hashes_see_words_as_the_pattern_does():
    texts = [t or "" for _, t in hostile.texts()]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    sets = ngram_join.shingle_hashes(*ngram_join.word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets), 5)
    assert [len(s) for s in sets] == [len(hostile.shingles(t)) for t in texts]


def test_words_that_differ_in_order_only_have_other_hashes():
    letters = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    for n in (64, 1024, 2048, 4096):
        words = [letters[:n].encode(), letters[:n].translate(str.maketrans("ab", "ba")).encode()]
        hashes, _ = ngram_join.word_hashes(np.frombuffer(b" ".join(words), np.uint8), np.array([0, 2 * n + 1]))
        assert len(set(hashes.tolist())) == 2


def test_bitmaps_never_bound_below_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 2**63, int(rng.integers(1, 400)), dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 400)))) for _ in range(2))
        bound = ngram_join.most_shared(len(a), ngram_join.bitmap(a), len(b), ngram_join.bitmap(b))
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))
        assert ngram_join.most_shared(len(a), ngram_join.bitmap(a), len(a), ngram_join.bitmap(a)) == len(a)


def test_rest_finds_all_pairs_across_components():
    rng = np.random.default_rng(6)
    for cells in (7, 1 << 19):
        token = np.sort(rng.integers(0, 12, 150)).astype(np.uint64)
        key, size = np.arange(150), rng.integers(20, 40, 150).astype(np.int32)
        place, root = rng.integers(0, 4, 150).astype(np.int32), rng.choice([1, 1, 1, 1, 2, 3, 4], 150)
        lists = ngram_join.Lists(token, key, size, place)
        heads = set(lists.starts.tolist())
        got = {tuple(sorted(p)) for a, b in lists.rest(root, 75, cells) for p in zip(a.tolist(), b.tolist(), strict=True)}
        wanted = {
            (a, b)
            for b in range(150)
            for a in range(b)
            if token[a] == token[b] and root[a] != root[b] and not {a, b} & heads
            and ngram_join.may_link(int(size[a]), int(place[a]), int(size[b]), int(place[b]), 75)
        }
        assert got == wanted


def test_frequent_counter_keeps_frequent_hashes():
    counter = ngram_join.FrequentCounter(capacity=100, buffer=500)
    rng = np.random.default_rng(1)
    for _ in range(50):
        counter.add([np.array([7, 8], np.uint64), rng.integers(100, 2**40, 200, dtype=np.uint64)])
    counter.merge()
    assert len(counter.keys) <= 100
    assert {7, 8} <= set(counter.keys.tolist())


def test_cell_counts_add_up_over_slices_and_stay_full():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    parts = [ngram_join.CellCounts(1 << 17) for _ in range(2)]
    for part, own in zip(parts, (hashes[:4000], np.concatenate([hashes[3000:], np.repeat(hashes[:1], 300)])), strict=True):
        part.add([own])
    total = ngram_join.CellCounts(1 << 17)
    for part in parts:
        for i, packed in part.slices():
            total.add_slice(i, packed)
    assert (total.counts == parts[0].counts + parts[1].counts).all() and total.counts.sum() == 6300
    total.counts[:] = 2**32 - 2
    for i, packed in parts[1].slices():
        total.add_slice(i, packed)
    assert total.counts.max() == 2**32 - 1 and total.counts.min() == 2**32 - 2


@pytest.mark.parametrize("cells", [1 << 22, 1 << 10])
def test_documents_that_share_a_passage_only_do_not_meet(spark, monkeypatch, cells):
    rng = random.Random(9)
    passages = [" ".join(f"p{k}x{i}" for i in range(18)) for k in range(2)]
    rows = []
    for i in range(80):
        own = [f"w{rng.randint(0, 10**9)}" for _ in range(100)]
        rows.append((i, " ".join([*own[:50], passages[i % 2], *own[50:]])))
    rows += [(100 + i, text.replace(" w", " v", 2)) for i, (_, text) in enumerate(rows[:10])]
    met, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *more: met.append(pairs.count()) or verified(pairs, *more))
    # No list of frequent n-grams: a passage that tasks see too rarely for it.
    got = ngram_join.ngram_join(hostile.documents(spark, rows), frequent=0, cells=cells)
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows)
    assert sum(met) < 200  # 1,980 in the order by value alone


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in nodes)


def test_a_bare_line_index_refuses_changes(spark):
    docs = spark.createDataFrame([(1, "a line of some length"), (2, "another line here")], "doc_id long, text string")
    bare = line_dedup.build_index(docs, keep_refs=False)
    for change in (lambda: line_dedup.insert(bare, docs), lambda: line_dedup.delete(bare, docs)):
        with pytest.raises(ValueError, match="keep_refs"):
            change()
