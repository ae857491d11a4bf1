"""Each stage of the pipeline on what its predecessor kept, against a plain version; hostile rows through all."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from corpusq.llm import common, quality
from corpusq.llm.common import staged, table
from corpusq.llm.plans import quality_model
from tests.llm import hostile
from tests.llm.test_llm_dedup import in_order, plain_components, plain_lines, plain_repeats

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF_DIR, "documents")
    stages = dict(corpus_pipeline.STAGES)
    held = rows_of(docs)

    model = quality_model(spark, docs, SF_DIR)
    good = staged(stages["quality_classifier"](spark, docs, SF_DIR), "test")
    scores = model.score(quality.matrix(pd.Series([t for _, t in held])))
    assert sorted(rows_of(good)) == sorted(r for r, s in zip(held, scores, strict=True) if s >= 0.7)

    lines = staged(stages["line_dedup"](spark, good, SF_DIR), "test")
    assert sorted(rows_of(lines)) == sorted((i, t) for i, _, _, t in plain_lines(rows_of(good)))

    near = staged(stages["ngram_jaccard_join"](spark, lines, SF_DIR), "test")
    keep = {i for i, _, c in plain_components(rows_of(lines)) if i == c}
    assert sorted(rows_of(near)) == sorted(r for r in rows_of(lines) if r[0] in keep)

    clean = staged(stages["suffix_array_dedup"](spark, near, SF_DIR), "test")
    want = plain_repeats(in_order(spark, rows_of(near)))
    assert sorted(rows_of(clean)) == sorted((i, kept.decode("utf-8", "ignore")) for (i, _), (_, _, kept) in want.items())

    for df in (good, lines, near, clean):
        assert df.columns == COLUMNS
        assert df.where(F.col("n_chars") != F.char_length("text")).count() == 0
    pieces = stages["packing"](spark, clean, SF_DIR)
    totals = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert len(totals) == clean.count() and all(r.n == r.t for r in totals)


def test_hostile_rows_and_an_empty_table_go_through(spark):
    for rows in (hostile.texts(), []):
        docs = hostile.documents(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0)})
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = staged(stage(spark, docs, SF_DIR), name)
        assert (docs.count() > 0) == bool(rows)


def test_workers_give_memory_back_and_get_bounded_batches(spark, monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batches = [pa.RecordBatch.from_pydict({"text": ["some text"] * 5}) for _ in range(3)]
    blocks = common.text_blocks(batches, 20)
    assert len(list(blocks)) == 9 and len(given) == 3

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    docs = hostile.documents(spark)
    try:
        for stage in dict(corpus_pipeline.STAGES).values():
            if stage is corpus_pipeline.line_stage:
                continue
            spark.conf.unset(key)
            try:
                stage(spark, docs, SF_DIR)
            finally:
                assert spark.conf.get(key) == str(corpus_pipeline.BATCH_BYTES)
        spark.conf.set(key, "1234567")
        corpus_pipeline.packing_stage(spark, docs, SF_DIR)
        assert spark.conf.get(key) == "1234567"
    finally:
        spark.conf.set(key, own) if own else spark.conf.unset(key)
