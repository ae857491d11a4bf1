"""Fusion, top-k, hydration, reranking: known answers and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.functions.text import sparse_vector
from corpusq.operators import filters, search


def ranking(spark, ids, query=1):
    rows = [(query, c, n) for n, c in enumerate(ids, start=1)]
    return spark.createDataFrame(rows, "query_id long, chunk_id string, rank int")


def fused(df):
    return [(r.chunk_id, r.score) for r in df.orderBy("rank").collect()]


def test_rrf_adds_shares_of_both_lists(spark):
    got = fused(search.rrf([ranking(spark, ["a", "b"]), ranking(spark, ["a", "c"])]))
    assert [c for c, _ in got] == ["a", "b", "c"]
    assert got[0][1] == pytest.approx(2 / 61)
    assert got[1][1] == got[2][1] == pytest.approx(1 / 62)


def test_rrf_with_an_empty_list(spark):
    assert [c for c, _ in fused(search.rrf([ranking(spark, ["a", "b", "c"]), ranking(spark, [])]))] == ["a", "b", "c"]
    assert fused(search.rrf([ranking(spark, []), ranking(spark, [])])) == []


@pytest.fixture(scope="module")
def corpus(spark):
    """Vectors of three workspaces, one of which holds most rows, with ties and nulls."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        dense = np.round(rng.normal(size=8), 1).tolist() if i % 17 else None
        words = [f"w{int(x)}" for x in rng.zipf(1.5, size=12) if x < 40] + ["the"]
        rows.append((i, "big" if i % 3 else f"ws{i % 2}", f"r{i % 4}", dense, " ".join(words)))
    vectors = spark.createDataFrame(
        rows, "chunk_id long, workspace_id string, repository_id string, dense array<float>, text string"
    ).repartition(5)
    return rows, vectors.withColumn("sparse", sparse_vector(F.col("text"))).drop("text")


@pytest.fixture(scope="module")
def queries(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(30):
        words = " ".join(f"w{int(x)}" for x in rng.zipf(1.5, size=4) if x < 40)
        rows.append((i, "big" if i % 2 else "ws0", None if i % 5 else "r1", rng.normal(size=8).tolist(), words + " the"))
    df = spark.createDataFrame(
        rows, "query_id long, workspace_id string, repository_id string, dense array<float>, query_text string"
    )
    return rows, df.withColumn("sparse", sparse_vector(F.col("query_text")))


def brute(queries, rows, score, k):
    found = set()
    for q in queries:
        scored = []
        for r in rows:
            if r[1] == q[1] and q[2] in (None, r[2]):
                s = score(q, r)
                if s is not None:
                    scored.append((-round(s, 6), r[0]))
        found |= {(q[0], c, n) for n, (_, c) in enumerate(sorted(scored)[:k], start=1)}
    return found


def cosine(q, r):
    if r[3] is None:
        return None
    a, b = np.float32(q[3]).astype(float), np.float32(r[3]).astype(float)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def overlap(q, r):
    def weights(text):
        words = text.split()
        return {w: 1 + math.log(words.count(w)) for w in words}

    a, b = weights(q[4]), weights(r[4])
    s = sum(a[w] * b[w] for w in a if w in b)
    return s if s > 0 else None


def placed(df):
    return {(r.query_id, r.chunk_id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("bound", [8_000_000, 100])
def test_topk_equals_brute_force_broadcast_and_blocks(monkeypatch, corpus, queries, bound):
    """The second bound is too small to broadcast: queries and vectors meet in blocks."""
    monkeypatch.setattr(search, "MAX_BROADCAST_NUMBERS", bound)
    monkeypatch.setattr(search, "CELL_ROWS", 100)
    monkeypatch.setattr(search, "SCORE_CELLS", 500)
    rows, vectors = corpus
    q_rows, q = queries
    assert placed(search.dense_topk(q, vectors, 7)) == brute(q_rows, rows, cosine, 7)
    assert placed(search.sparse_topk(q, vectors, 7)) == brute(q_rows, rows, overlap, 7)


def test_compaction_keeps_the_best():
    best = search._BestK(2)
    for start in range(0, 4000, 100):
        scores = np.arange(start, start + 100, dtype=float).reshape(-1, 1)
        best.add(scores, np.arange(start, start + 100), ["q"], False)
    assert best.compact()["c"].tolist() == [3999, 3998]


def test_approximate_search_with_all_cells_is_exact(corpus, queries):
    _, vectors = corpus
    _, q = queries
    index = search.CellIndex.train(vectors, 5)
    everywhere = index.search(q, index.assign(vectors), 5, nprobe=5)
    assert placed(everywhere) == placed(search.dense_topk(q, vectors, 5))
    few = index.search(q, index.assign(vectors), 5, nprobe=2)
    hits = placed(search.dense_topk(q, vectors, 5))
    recall = len({x[:2] for x in placed(few)} & {x[:2] for x in hits}) / len(hits)
    assert recall > 0.4


@pytest.fixture(scope="module")
def shop(spark):
    """Three orthogonal vectors; chunk 4 has a hit but no chunk row; chunk 3 no file."""
    vectors = spark.createDataFrame(
        [(1, "w", [1.0, 0.0, 0.0, 0.0], "alpha beta"), (2, "w", [0.0, 1.0, 0.0, 0.0], "beta"),
         (3, "w", [0.0, 0.0, 1.0, 0.0], "gamma"), (4, "w", [0.9, 0.1, 0.0, 0.0], "alpha")],
        "chunk_id long, workspace_id string, dense array<float>, text string",
    ).withColumn("sparse", sparse_vector(F.col("text"))).drop("text")
    chunks = spark.createDataFrame(
        [(3, 30, 5, 9, None, "gamma"), (1, 10, 1, 4, "f", "alpha beta"), (2, 20, 1, 2, None, "beta")],
        "chunk_id long, file_id long, start_line int, end_line int, symbol_name string, content string",
    )
    files = spark.createDataFrame([(10, "src/app.py"), (20, "doc/a.md")], "file_id long, path string")
    query = spark.createDataFrame(
        [(1, "w", "alpha", [1.0, 0.0, 0.0, 0.0]), (2, "other", "alpha", [1.0, 0.0, 0.0, 0.0])],
        "query_id long, workspace_id string, query_text string, dense array<float>",
    ).withColumn("sparse", sparse_vector(F.col("query_text")))
    return query, vectors, chunks, files


def test_hybrid_search_end_to_end(shop):
    fused = search.hybrid_search_no_rerank(*shop).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in fused] == [(1, 1), (1, 2), (1, 3)]
    assert fused[0].file_path == "src/app.py" and fused[0].source == "fused"
    assert fused[2].file_path == ""
    best = search.hybrid_search(*shop).orderBy("rank").first()
    assert (best.chunk_id, best.score, best.source) == (1, 1.0, "reranked")


def test_prefix_is_applied_after_the_cut(shop):
    query, vectors, chunks, files = shop
    narrow = query.withColumn("path_prefix", F.lit("doc/"))
    assert [r.chunk_id for r in search.hybrid_search(narrow, vectors, chunks, files).collect()] == [2]
    # With a cut of one only src/app.py is left, which the prefix then removes.
    assert search.hybrid_search(narrow, vectors, chunks, files, k1=1, k2=1).count() == 0


def test_scorer_and_fail_open(spark):
    hits = spark.createDataFrame(
        [(1, "a", 0.5, "fused", "short", 1), (1, "b", 0.4, "fused", "much longer", 2),
         (2, "a", 0.5, "fused", "bad", 1), (2, "b", 0.4, "fused", "long enough", 2)],
        "query_id long, chunk_id string, score double, source string, text string, rank int",
    )
    queries = spark.createDataFrame([(1, "q"), (2, "q")], "query_id long, query_text string")

    def scorer(qs, texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [float(len(x)) for x in texts]

    rows = search.rerank(hits, queries, scorer, batch_size=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.source) for r in rows] == [
        (1, "b", "reranked"), (1, "a", "reranked"), (2, "a", "fused"), (2, "b", "fused")]
    assert [r.score for r in rows] == [11.0, 5.0, 0.5, 0.4]
    with pytest.raises(Exception, match="no"):
        search.rerank(hits, queries, scorer, fail_open=False, batch_size=1).collect()


def test_retry_widens_only_open_queries(shop):
    query, vectors, chunks, files = shop
    narrow = query.withColumn("path_prefix", F.lit("doc/"))
    rows = search.retry_widened(narrow, vectors, chunks, files, multiplier=10, k1=1, k2=1).collect()
    assert [(r.query_id, r.chunk_id, r.attempt) for r in rows] == [(1, 2, 2)]


def test_scoped_requests_need_a_path(spark):
    bad = spark.createDataFrame([("file", "w", "r", None)], "scope string, workspace_id string, repository_id string, path string")
    with pytest.raises(Exception, match="path is required"):
        search.scoped_queries(bad).collect()


def test_no_hits_listing(spark):
    queries = spark.createDataFrame([(1, "what")], "query_id long, query_text string")
    none = spark.createDataFrame([], "query_id long, file_path string, start_line int, end_line int, score double, rank int")
    assert search.format_hits(none, queries).first().listing == "No results found for: what"


def test_workspace_is_mandatory(spark):
    with pytest.raises(TypeError):
        filters.tenant_scope(spark.range(1), None)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, shop):
    query, vectors, chunks, files = shop
    plan = plan_of(search.dense_topk(query, vectors, 5))
    assert plan.count("WindowGroupLimit") == 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    for native in (search.rrf([ranking(spark, ["a"]), ranking(spark, ["b"])]),):
        assert "Python" not in plan_of(native) and "Arrow" not in plan_of(native)


def test_stored_cells_prune_and_know_when_they_are_exact(corpus, queries, spark, tmp_path):
    from corpusq.operators.cells import StoredCells

    _, vectors = corpus
    _, q = queries
    path = str(tmp_path / "cells")
    StoredCells.build(vectors, path, 6)
    index = StoredCells.open(spark, path)
    plan = index.table([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "IN (1,2)" in plan
    want = placed(search.dense_topk(q, vectors, 5))
    assert placed(index.search(q, 5, nprobe=1, exact=True).drop("is_exact")) == want
    assert placed(index.search(q, 5, nprobe=6).drop("is_exact")) == want
    assert all(r.is_exact for r in index.search(q, 5, nprobe=6).collect())
    right = {}
    for i, c, *_ in want:
        right.setdefault(i, set()).add(c)
    got = {}
    for r in index.search(q, 5, nprobe=2).collect():
        got.setdefault((r.query_id, r.is_exact), set()).add(r.chunk_id)
    assert all(found == right[i] for (i, exact), found in got.items() if exact)


def test_stored_cells_of_separate_groups_answer_exactly_from_one(spark, tmp_path):
    from corpusq.operators.cells import StoredCells

    rows = [(g * 100 + i, "w", [float(d == g) + 0.01 * ((i + d) % 3) for d in range(4)]) for g in range(4) for i in range(20)]
    vectors = spark.createDataFrame(rows, "chunk_id long, workspace_id string, dense array<float>")
    index = StoredCells.build(vectors, str(tmp_path / "cells"), 4)
    q = vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "workspace_id", "dense")
    hits = index.search(q, 3, nprobe=1)
    assert hits.count() == 12 and all(r.is_exact for r in hits.collect())
    none = StoredCells.build(vectors.where("false"), str(tmp_path / "none"), 4)
    assert none.search(q, 3).count() == 0



def test_hydration_reads_only_buckets_with_a_hit(spark, shop, tmp_path):
    _, _, chunks, files = shop
    stored = search.open_chunks(spark, str(tmp_path / "chunks"), "long", 16)
    rows = chunks.join(files.select("file_id", F.col("path").alias("file_path")), "file_id", "left")
    rows = rows.withColumn("is_active", F.lit(True))
    stored.publish(stored.snapshot(), "a", {"chunks": stored.write("chunks", rows, "a")})
    fused = spark.createDataFrame([("q", 1, 0.5, 1), ("q", 4, 0.4, 2)], "query_id string, chunk_id long, score double, rank int")
    got = search.hydrate_stored(fused, stored)
    want = search.hydrate(fused, chunks, files)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    hit = stored.buckets_of(fused, "chunk_id")
    assert got.inputFiles() and all(any(f"bucket={b}/" in f for b in hit) for f in got.inputFiles())
