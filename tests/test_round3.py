"""Findings of the third round."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.operators import metrics


def test_quantiles_are_exact_where_a_sketch_is_not(spark):
    n = 20_000
    log = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit("a")).alias("route"), F.timestamp_seconds("id").alias("at"),
        F.when(F.col("id") % 2 == 0, (F.col("id") * 7919) % n).cast("double").alias("took"),
    )
    rows = metrics.latency_quantiles(log, ["route"], "at", "took", "1 day", accuracy=10).collect()
    got = {r["route"]: (r["requests"], r["p50"], r["p95"]) for r in rows}
    values = sorted(float((i * 7919) % n) for i in range(0, n, 2))
    assert got == {"a": (n // 2, values[n // 4 - 1], values[n // 2 * 95 // 100 - 1]), None: (n // 2, None, None)}


def test_probes_are_measured_until_the_recall_is_there(spark, tmp_path):
    import numpy as np

    from corpusq.operators import search
    from corpusq.operators.cells import StoredCells

    rng = np.random.default_rng(3)
    rows = [(i, "w", [float(x) for x in rng.normal(size=24)]) for i in range(1500)]
    vectors = spark.createDataFrame(rows, "chunk_id long, workspace_id string, dense array<double>")
    index = StoredCells.build(vectors, str(tmp_path / "cells"), 8)
    probes = index.probes_for(5, 0.95, 100)
    queries = spark.createDataFrame(
        [(i, "w", [float(x) for x in rng.normal(size=24)]) for i in range(60)], "query_id long, workspace_id string, dense array<double>"
    )
    exact = search.dense_topk(queries, vectors, 5).select("query_id", "chunk_id")

    def recall(nprobe):
        return index.search(queries, 5, nprobe=nprobe).join(exact, ["query_id", "chunk_id"]).count() / exact.count()

    assert 1 < probes <= 8 and recall(probes) >= 0.9 > recall(1)


def test_outlines_and_imports_are_computed_once_and_after_the_spread(spark):
    from corpusq.operators import chunking, outline

    files = spark.createDataFrame(
        [(1, "python", "import a\n\nclass K:\n    def m(self): pass\n"), (2, "python", ""), (3, "none", "x"), (4, "python", None)],
        "file_id long, language string, content string",
    ).repartition(3, "file_id")
    outlined = outline.symbol_outline(files)
    rows = {
        "imports": (outline.import_edges(files), 1),
        "spans": (chunking.outermost_spans(outlined.drop("content")), 1),
        "lines": (chunking.explode_lines(files), 5),
        "markdown": (chunking.chunk_markdown(files), 2),
    }
    for name, (df, count) in rows.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Repartition") :]
        assert "Filter" not in below, (name, below)
        assert df.count() == count, name


def test_runs_drop_what_they_staged_and_encoders_give_vectors_batch_by_batch(spark, tmp_path):
    import os

    from corpusq.functions.encoders import hashed_encoder
    from corpusq.operators import embedding, persisted
    from corpusq.session import checkpoint_root

    folder = f"{checkpoint_root(spark)}/staged"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    tables = persisted.open_index(spark, str(tmp_path / "index"), 2)
    scan = spark.createDataFrame(
        [("r", f"{n}.md", bytearray(f"# T{n}\nsame words\n".encode()), 20) for n in range(5)],
        "repository_id string, path string, content binary, length long",
    )
    _, results = persisted.run_index(tables, scan, hashed_encoder(), "m", "w")
    assert results.where("status = 'new' AND chunks = 1").count() == 5
    assert set(os.listdir(folder)) - before == set()
    assert tables.read("chunks").where("content LIKE '%same words%'").count() == tables.read("vectors").count() == 5
    texts = spark.createDataFrame([(n, f"word{n}") for n in range(100)], "n long, text string").coalesce(1)
    rows = embedding.encode(texts, hashed_encoder(), "m", batch_size=7).where("size(sparse.ids) = 1 AND error IS NULL")
    assert rows.count() == 100


def test_stream_limits_hold_times_and_ids_only(spark, tmp_path):
    import numpy as np
    import pandas as pd

    from corpusq.streaming import rate_limit as rl

    frames = [pd.DataFrame({"_t": np.arange(5_000) // 3, "id": np.arange(5_000)[::-1] + 5_000 * n, "wide": ["x" * 400] * 5_000}) for n in range(4)]
    t, ids = rl._gathered(iter(frames), "id")
    assert t.dtype == ids.dtype == np.int64 and len(t) == len(ids) == 20_000
    order = np.argsort(t, kind="stable")
    t, ids = t[order], ids[order]
    rl._by_id_in_ties(t, ids)
    want = pd.concat(frames).sort_values(["_t", "id"])
    assert (want["_t"].to_numpy() == t).all() and (want["id"].to_numpy() == ids).all()
    words = np.array(["b", "a", "c", None, "d"], dtype=object)
    rl._by_id_in_ties(np.array([1, 1, 2, 2, 2]), words)
    assert words.tolist() == ["a", "b", "c", "d", None]

    # More hits in a window than a result frame holds, over two micro-batches, beside unused wide columns.
    n = rl.SLICE_ROWS * 2 + 7
    log = spark.range(n).select(
        F.lit("a").alias("path"), F.timestamp_millis(1_700_000_000_000 + F.col("id")).alias("ts"), F.col("id").alias("event_id"), F.repeat(F.lit("x"), 50).alias("wide")
    )
    for rows in (log.where(f"event_id < {n // 2}"), log.where(f"event_id >= {n // 2}")):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = rl.rate_limit_stream(stream, ["path"], "ts", "event_id", 5, 3600, delay="1 hour")
    job = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == n and rows.select("hit").distinct().count() == n and rows.agg(F.max("hit")).first()[0] == n
    assert rows.where("allowed").count() == 5 and rows.select("window_start").distinct().count() == 1


def test_long_files_are_read_in_pieces_and_come_back_whole(spark, tmp_path):
    import os

    from corpusq.sources import files as source

    root = tmp_path / "corpus"
    (root / "sub").mkdir(parents=True)
    contents = {"sub/long.bin": os.urandom(10_500), "even.bin": os.urandom(4_000), "short.bin": b"\x00\xff", "empty": b"", "edge": os.urandom(1_000)}
    for name, content in contents.items():
        (root / name).write_bytes(content)
    listed = source.list_files(spark, str(root)).unionByName(
        spark.createDataFrame([("gone", False, 5_000, None), ("refused", False, 5_000, "over 9 bytes")], source.LISTED)
    )
    # The list is kept beside: other columns stay with their file.
    read = source.read_files(listed.withColumn("tag", F.upper("path")), str(root), piece_bytes=1_000)
    rows = {r.path: r for r in read.collect()}
    assert {p: bytes(r.content) for p, r in rows.items() if r.content is not None} == contents
    assert {p: r.tag for p, r in rows.items()} == {p: p.upper() for p in rows} and len(rows) == len(contents) + 2
    assert rows["gone"].problem.startswith("cannot be read") and rows["refused"].problem == "over 9 bytes"
    assert {r.path: r.length for r in rows.values()}["sub/long.bin"] == 10_500
    # What reads no contents does not carry them past the readers.
    plan = read.select("path", "length")._jdf.queryExecution().optimizedPlan().toString()
    assert "listagg" not in plan


def test_vectors_are_scored_in_slices_bounded_in_numbers(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from corpusq.operators import search

    monkeypatch.setattr(search, "SCORE_NUMBERS", 100)
    lengths = np.array([30, 30, 30, 30, 500, 0, 0, 99, 1, 1])
    assert list(search._slices(lengths, 4)) == [(0, 3), (3, 4), (4, 5), (5, 9), (9, 10)]
    assert list(search._slices(lengths[:0], 4)) == []

    rng = np.random.default_rng(5)
    rows = [{"ids": np.sort(rng.choice(400, n, replace=False)).tolist(), "weights": rng.random(n).tolist()} if n else None for n in [0, *rng.integers(1, 60, 80)]]
    sparse = pa.array(rows, pa.struct([("ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64()))]))
    batch = pa.record_batch({"chunk_id": pa.array(range(81)), "workspace_id": pa.array(["w"] * 81), "sparse": sparse})
    kernel, sizes = search._Sparse([rows[5], rows[9]]), []
    monkeypatch.setattr(kernel, "score", lambda column, score=kernel.score: sizes.append(sum(len(x["ids"]) for x in column.to_pylist())) or score(column))
    best = search._BestK(100)
    search._scan(batch.slice(0, 81), {"w": [search._Group(("w",), ["a", "b"], kernel)]}, "sparse", ["workspace_id"], best)
    assert len(sizes) > 10 and max(sizes) <= 100
    got = {(q, c): s for q, c, s in best.compact().itertuples(index=False)}
    for name, query in (("a", rows[5]), ("b", rows[9])):
        weights = dict(zip(query["ids"], query["weights"], strict=True))
        for c, row in enumerate(rows):
            want = sum(w * weights.get(i, 0) for i, w in zip(row["ids"], row["weights"], strict=True)) if row else 0
            assert abs(got.get((name, c), 0) - want) < 1e-5

    # Batches for Python are bounded in bytes as well as in rows.
    wide = spark.range(0, 3000, 1, 1).select(F.col("id").alias("chunk_id"), F.lit("w").alias("workspace_id"), F.array_repeat(F.lit(1.0), 2000).alias("dense"))
    asked = spark.createDataFrame([(0, "w", [1.0] * 2000)], "query_id long, workspace_id string, dense array<double>")
    assert search.dense_topk(asked, wide, 3).count() == 3
    sent = wide.mapInArrow(lambda batches: (b.slice(0, 1).select(["chunk_id"]).set_column(0, "b", pa.array([b.nbytes])) for b in batches), "b long")
    assert sent.agg(F.max("b")).first()[0] < search.BATCH_BYTES * 1.1


def test_plain_texts_are_cut_as_the_tokenizer_cuts_them():
    import numpy as np

    from corpusq.llm import packing
    from corpusq.llm.plans import vocabulary

    words = packing.Words(vocabulary("word_bpe_49k.json"))
    characters = [chr(c) for c in [9, 10, *range(32, 127), *range(0xC0, 0x250)]]
    for c in characters:
        assert words.plain_text(c) and words.split_plain(f"a{c}1".lower()) == words.split(f"a{c}1".lower()), c
    rng = np.random.default_rng(11)
    texts = ["it's  'Re-read', 10.5%...\n\tI'LL İȺ×ß we've", "", " ", "<|startoftext|> a", "é 中文 x y", "'" * 5 + "s"]
    texts += ["".join(rng.choice(characters, 60)) for _ in range(200)]
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text
    # A word and its mark are kept once each, not also as one.
    known = packing.Words(vocabulary("word_bpe_49k.json"))
    known.encode(["Word, word. word! WORD"])
    assert sorted(known.pieces) == ["!", ",", ".", "word"] and not known.words
