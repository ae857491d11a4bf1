"""Tokens, packing, chats, pages, quality and search against plain versions and round trips."""

import base64
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.llm import byte_bpe, chat_format, html_extract, packing, quality, topk_search
from corpusq.llm.common import table
from corpusq.llm.plans import vocabulary
from tests.llm import hostile

SF_DIR = "/root/testdata/sf0.001"


@lru_cache
def tiktoken_encoding():
    import public_tokenizers as public
    import tiktoken

    with open(vocabulary("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_what_the_library_gives(spark):
    rng = random.Random(2)
    parts = [*" \n\t'strevdlm'a1é !? ", "'s", "'re", "'ll", "  ", "'t've", "\r\n", "１", "ﬁ"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    rows = [*hostile.texts(), *((1000 + i, t) for i, t in enumerate(odd)), (9999, "a" * 5000 + "!" * 3000)]
    path = vocabulary("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(hostile.documents(spark, rows).withColumn("copy", F.col("doc_id")), path)
    decoded = byte_bpe.decode(coded, path)
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in decoded.collect()), key=str)
    want = sorted(
        ((i, tiktoken_encoding().encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str
    )
    assert got == want
    assert byte_bpe.encode(hostile.documents(spark, []), path).count() == 0


def test_scan_gives_the_same_whatever_the_blocks():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 12, 5000).astype(np.uint8)
    classes[[0, -1]] = byte_bpe.DOC
    whole = byte_bpe.boundaries(classes, width=8192)
    for width in (1, 7, 64):
        assert (byte_bpe.boundaries(classes, width) == whole).all()


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, capacity):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    reader = Tokenizer.from_file(path)
    rows = hostile.texts()
    pieces = packing.pack(hostile.documents(spark), path, capacity=capacity, group_docs=15).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        docs[p.doc_id].append((p.start, p.doc_tokens, ids))
        sequences[p.sequence_id].append((p.offset, p.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*reader.encode(t or "", add_special_tokens=False).ids, 1])
    for i, texts in want.items():
        # Rows that share an id are told apart by their numbers of tokens here.
        for ids in texts:
            own = sorted((s, x) for s, n, x in docs[i] if n == len(ids))
            if sum(len(x) == len(ids) for x in texts) == 1:
                assert [y for _, x in own for y in x] == ids
            assert sum(len(x) for _, x in own) == len(ids) * sum(len(x) == len(ids) for x in texts)
    groups = {p.sequence_id >> 32 for p in pieces}
    assert len(sequences) * capacity - sum(p.length for p in pieces) < capacity * len(groups)
    assert packing.pack(hostile.documents(spark, []), path).count() == 0


def test_assign_balances_cost():
    lengths = np.array(sorted(np.random.default_rng(1).integers(1, 900, 400), reverse=True))
    load = defaultdict(float)
    for _, _, size, seq, _ in packing.assign(lengths, 2048, 1.0, 1 / 4096):
        load[seq] += float(packing.cost(size, 1.0, 1 / 4096))
    values = sorted(load.values())[1:]
    assert max(values) < 1.2 * min(values)


def test_chat_round_trip(spark):
    rng = random.Random(9)
    parts = ["\\", "0", "1", "###", "#", "</turn>", "</turn", "\n", ": ", "user", " ", "é", "### assistant: ", "\\2"]
    rows = [
        (c, t, rng.choice(["user", "assistant", "a:b", "</turn>", "\\3", ""]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))))
        for c in range(60)
        for t in range(rng.randint(1, 5))
    ]
    rows += [(None, 1, None, None), (None, None, "user", "x" * 100_000), (70, 1, "assistant", "same"), (70, 1, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumns({"rows": F.lit(1), "safe": F.lit("x"), "start": F.lit(2), "formatted": F.lit("f")})
    got = {r.conv_id: r for r in chat_format.format_chats(turns).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == want.keys()
    for c, own in want.items():
        r = got[c]
        assert r.identical
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in sorted(own)]
        learned = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert learned == [t.raw for t in r.turns if t.role == "assistant"]
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_chat_text_without_conflict_is_left_as_it_is(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a \\ b # c < turn>")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(turns).first().formatted == "### user: a \\ b # c < turn></turn>\n"


PAGE = """<!doctype html><html><head><title>T</title><style>x{}</style></head><body>
<header class="site-header"><a href="/">Home</a> <a href="/x">Other</a></header>
<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div id="cookie-notice">We use cookies, and you agree. <button>OK</button></div>
<article class="post"><h1>The title &amp; more</h1>
<p>First <b>bold</b>ly   said,<br>then a line &eacute; &#8212; and on it goes, with a longer sentence. It ends.
<p>Second paragraph, unclosed, that runs on for a while. It has sentences, and commas.
<div class="ad">Buy now</div><ul><li>one point, made well.</li><li>another point, made too.</li></ul></article>
<section class="comments"><p>Nice post, thanks a lot. I liked it.</p></section>
<aside>Related things</aside><form action="/s"><label>Search</label><input></form>
<footer>&copy; us</footer><script>var a = "<p>no</p>";</script></body></html>"""


def test_html_extract(spark):
    model = html_extract.fit(table(spark, SF_DIR, "pages"))
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", PAGE), (5, "u", "<p"), (6, "u", "no markup at all"),
            (7, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "u", "<script>only()</script>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "_y": F.lit(1)})
    got = [(r.page_id, r.text) for r in html_extract.extract(pages, model).collect()]
    want = (
        "The title & more First boldly said, then a line é — and on it goes, with a longer sentence. It ends. "
        "Second paragraph, unclosed, that runs on for a while. It has sentences, and commas. "
        "one point, made well. another point, made too."
    )
    assert sorted(got, key=str)[:1] == [(1, want)] and (None, want) in got
    assert [t for i, t in got if i in (2, 3, 5)] == ["", "", ""]
    assert (7, "") in got and len(got) == len(rows)
    assert html_extract.extract(pages.limit(0), model).count() == 0


def test_html_model_works_without_telling_names(spark):
    """Names hidden from half of the pages: shape and text alone find the text."""
    rows = table(spark, SF_DIR, "pages").select("page_id", "url", "html").collect()
    model = html_extract.fit(table(spark, SF_DIR, "pages"))
    right = total = 0
    for r in rows:
        plain = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        page, bare = html_extract.parse(r.html), html_extract.parse(plain)
        want = html_extract.main_text(page, html_extract.decode(page, model.margin(html_extract.features(page))))
        got = html_extract.main_text(bare, html_extract.decode(bare, model.margin(html_extract.features(bare))))
        right, total = right + len(set(want.split()) & set(got.split())), total + len(set(want.split()))
    assert right > 0.9 * total


def test_html_decoding_never_contradicts_itself():
    rng = np.random.default_rng(4)
    page = html_extract.parse(PAGE)
    for _ in range(50):
        keep = html_extract.decode(page, rng.normal(0, 2, len(page.tags)))
        assert all(not k or p < 0 or keep[p] for k, p in zip(keep, page.parents, strict=True))


def test_quality_on_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.fit(docs, labels)
    score = quality.scorer(model)
    scored = docs.join(labels, "doc_id").select("doc_id", "quality", score("text").alias("s"), quality.held_out(F.col("doc_id")).alias("h"))
    rows = scored.collect()
    assert {r.h for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True}
    held = [r for r in rows if r.h]
    assert np.mean([(r.s >= 0.7) == (r.quality == 1) for r in held]) > 0.95
    again = quality.fit(docs, labels)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True))
    odd = [r.s for r in hostile.documents(spark).select(score("text").alias("s")).collect()]
    assert len(odd) == len(hostile.texts()) and all(0 <= s <= 1 for s in odd)


def test_quality_without_usable_labels(spark):
    docs = hostile.documents(spark)
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 7)], "doc_id long, quality int")
    score = quality.scorer(quality.fit(docs, labels))
    assert {round(r.s, 6) for r in docs.select(score("text").alias("s")).collect()} == {0.5}
    assert docs.limit(0).select(score("text").alias("s")).count() == 0


def test_quality_pairs_learn_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((2000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.train(x, y, pairs=1)
    assert model.pairs == [(1, 2)]
    assert np.mean((model.score(x) > 0.5) == (y == 1)) > 0.95


def plain_top(rows, asks, k):
    def whole(v):
        return None if not v or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256.0 * x)) for x in v]

    vectors = [(i, whole(v)) for i, v in rows]
    out = set()
    for q, v in vectors:
        if v is None or q is None or not asks(q):
            continue
        found = [
            (-sum(a * b for a, b in zip(v, w, strict=True)), i)
            for i, w in vectors
            if w is not None and i is not None and i != q and len(w) == len(v)
        ]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])}
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_topk_search(spark, scale):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0]) * (scale if i % 3 else 1.0) for _ in range(4)]) for i in range(90)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(30)]
    rows += [(300, None), (301, [0.1, None, 0.2, 0.3]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]),
             (304, []), (305, [1.0, 2.0]), (310, [0.5, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (320, [0.5, 0.5, 0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {"id": F.lit("x"), "v": F.lit(1), "shard": F.lit(2), "score": F.lit(0)}
    )
    for options in ({}, {"shard_rows": 9, "query_rows": 4, "fan_in": 3}):
        got = topk_search.top_k(vectors, vectors.where("vec_id % 10 = 0"), **options)
        assert sorted(map(tuple, got.collect())) == plain_top(rows, lambda q: q % 10 == 0, 5)
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0)).count() == 0
