"""Conversations, prompts, completion and answers."""

import pytest
from pyspark.sql import functions as F

from corpusq.operators import turns


def messages(spark, rows):
    return spark.createDataFrame(rows, "conversation_id long, turn long, role string, content string")


def test_trim_stops_at_the_first_that_does_not_fit(spark):
    m = messages(spark, [(1, 0, "u", "a b"), (1, 1, "u", "c d"), (1, 2, "u", "e f"),
                         (2, 0, "u", "x"), (2, 1, "u", "a b c d e"), (2, 2, "u", "y")])
    kept = lambda keep, n: {(r.conversation_id, r.turn) for r in turns.trim_to_budget(m, n, keep).collect()}
    assert kept("newest", 4) == {(1, 1), (1, 2), (2, 2)}
    assert kept("highest_relevance", 4) == {(1, 0), (1, 1), (2, 0)}
    assert kept("newest", 0) == set()


def test_window_keeps_the_last_turns_in_order(spark):
    m = messages(spark, [(1, n, "user", f"t{n}") for n in range(30)])
    c = spark.createDataFrame([(1, "old summary"), (2, None)], "conversation_id long, summary string")
    rows = turns.context_window(m, c, 3).orderBy("conversation_id").collect()
    assert [x.content for x in rows[0].history] == ["t27", "t28", "t29"] and rows[0].summary == "old summary"
    assert rows[1].history is None


def test_prompt_needs_its_query(spark):
    df = spark.createDataFrame([(None,)], "query string")
    with pytest.raises(Exception, match="needs query"):
        turns.build_prompt(df, "classify").collect()


def test_completion_retries_only_what_may_help(spark):
    def completer(prompts):
        if prompts == ["down"]:
            raise turns.TransientError("server down")
        if prompts == ["bad"]:
            raise ValueError("bad request")
        return [{"text": p.upper(), "prompt_tokens": 1, "completion_tokens": 1, "finish_reason": "stop"} for p in prompts]

    df = spark.createDataFrame([("ok",), ("down",), ("bad",)], "prompt string")
    rows = {r.prompt: r for r in turns.complete(df, completer, retries=1, batch_size=1, backoff_seconds=0.01).collect()}
    assert rows["ok"].text == "OK" and rows["ok"].error is None and rows["ok"].finish_reason == "stop"
    assert rows["down"].error == "server down" and rows["bad"].error == "bad request"


def test_summaries_skip_deleted_and_keep_the_old_on_failure(spark):
    c = spark.createDataFrame([(1, "old", False), (2, "old", True), (3, "old", False)],
                              "conversation_id long, summary string, is_deleted boolean")
    m = messages(spark, [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (3, 0, "user", "fail")])

    def completer(prompts):
        if any("fail" in p for p in prompts):
            raise ValueError("no")
        return [{"text": "new"} for _ in prompts]

    one_row_per_batch = m.sparkSession
    one_row_per_batch.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = {r.conversation_id: r.summary for r in turns.summarize(c, m, completer).collect()}
    finally:
        one_row_per_batch.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows == {1: "new", 2: "old", 3: "old"}


def test_answers(spark):
    df = spark.createDataFrame([("yes", None, "c"), ("", None, "c"), (None, "boom", "c")], "text string, error string, citations string")
    rows = turns.finalize_answers(df).collect()
    assert [r.content for r in rows] == ["yes", turns.EMPTY_ANSWER, turns.ERROR_ANSWER + "boom"]
    assert [r.citations for r in rows] == ["c", "c", None]


def test_overlapping_context_merges(spark):
    rows = [(1, "f", 1, 3, 2, 0.5, "a\nb\nc"), (1, "f", 3, 4, 1, 0.9, "c\nd"), (1, "f", 5, 5, 3, 0.1, "e"), (1, "g", 1, 1, 4, 0.2, "z")]
    df = spark.createDataFrame(rows, "query_id long, file_path string, start_line int, end_line int, rank int, score double, text string")
    got = {(r.file_path, r.start_line, r.end_line, r["rank"], r.text) for r in turns.merge_context_overlaps(df).collect()}
    assert got == {("f", 1, 4, 1, "a\nb\nc\nd"), ("f", 5, 5, 3, "e"), ("g", 1, 1, 4, "z")}


def test_rewrites(spark):
    df = spark.createDataFrame([("q", None, "r"), ("q", ["h"], " "), ("q", ["h"], " r ")], "query string, history array<string>, rewrite string")
    rows = turns.rewrite_needed(df).collect()
    assert [(r.needs_rewrite, r.rewritten_query) for r in rows] == [(False, "q"), (True, "q"), (True, "r")]


def test_soft_delete_and_pages(spark):
    c = spark.createDataFrame([(n, "u", "w", n * 10, n == 4) for n in range(1, 6)],
                              "conversation_id long, user_id string, workspace_id string, updated_at long, is_deleted boolean")
    page = turns.list_conversations(c, "u", "w", limit=2, offset=1).collect()
    assert [r.conversation_id for r in page] == [3, 2]
    gone = turns.soft_delete(c, spark.createDataFrame([(1,), (1,)], "conversation_id long"))
    assert {r.conversation_id for r in gone.where("is_deleted").collect()} == {1, 4} and gone.count() == 5
    assert turns.token_usage(spark.createDataFrame([("p", 2), ("c", 3)], "direction string, tokens int")).where(F.col("direction").isNull()).first().tokens == 5
