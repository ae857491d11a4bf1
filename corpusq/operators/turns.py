"""Conversations, context windows, prompts and answers for all conversations at once.

messages       conversation_id, turn, role, content
conversations  conversation_id, workspace_id, user_id, summary, turn_count, is_deleted, updated_at
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import token_count
from corpusq.operators.running import running_number, running_total

TURN_BUCKET = 10_000  # turns of one conversation sorted together


def context_window(messages: DataFrame, conversations: DataFrame, max_turns: int = 20) -> DataFrame:
    """Last ``max_turns`` messages per conversation in time order, with the summary.

    Spark keeps ``max_turns`` rows per conversation in each map task before it
    shuffles, so a huge conversation costs no more than a small one.
    """
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("turn"))
    last = messages.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= max_turns)
    window = last.groupBy("conversation_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("history")
    )
    return conversations.select("conversation_id", "summary").join(window, "conversation_id", "left")


def append_messages(
    conversations: DataFrame, messages: DataFrame, new: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(messages with the new ones, conversations with their turn counts moved on)."""
    counted = new.withColumn("token_count", token_count(F.col("content")))
    added = new.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("added"))
    moved = (
        conversations.join(added, "conversation_id", "left")
        .withColumn("turn_count", F.col("turn_count") + F.coalesce("added", F.lit(0)))
        .drop("added")
    )
    return messages.unionByName(counted, allowMissingColumns=True), moved


def summary_due(messages: DataFrame, threshold: int = 10) -> DataFrame:
    """One row each time a conversation's turn count reaches a multiple of the threshold."""
    numbered = running_number(
        messages.select("conversation_id", "turn"),
        ["conversation_id"],
        ["turn"],
        F.floor(F.col("turn") / TURN_BUCKET),
        "turn_count",
    )
    return numbered.where(F.col("turn_count") % threshold == 0)


def list_conversations(
    conversations: DataFrame, user_id, workspace_id=None, limit: int = 20, offset: int = 0
) -> DataFrame:
    wanted = conversations.where((F.col("user_id") == F.lit(user_id)) & ~F.col("is_deleted"))
    if workspace_id is not None:
        wanted = wanted.where(F.col("workspace_id") == F.lit(workspace_id))
    return wanted.orderBy(F.desc("updated_at"), F.asc("conversation_id")).offset(offset).limit(limit)


def conversation_pages(conversations: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """The same page for every user at once, with ``place`` counted from 1."""
    w = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.asc("conversation_id"))
    return (
        conversations.where(~F.col("is_deleted"))
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= offset + limit)
        .where(F.col("place") > offset)
    )


def soft_delete(df: DataFrame, ids: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Mark rows deleted; they stay readable by id."""
    marked = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return (
        df.join(marked, key, "left")
        .withColumn("is_deleted", F.col("is_deleted") | F.col("_hit").isNotNull())
        .drop("_hit")
    )


def trim_to_budget(
    segments: DataFrame,
    max_tokens: int,
    keep: str = "newest",
    key: str = "conversation_id",
    position: str = "turn",
    text: str = "content",
) -> DataFrame:
    """Drop whole segments; stop at the first that does not fit.

    Token counts are not negative, so the running total never falls and stopping
    there equals a cut by the running total.
    """
    if keep not in ("newest", "highest_relevance"):
        raise ValueError("keep must be 'newest' or 'highest_relevance'")
    totals = running_total(
        segments.withColumn("tokens", token_count(F.col(text))),
        [key],
        [position],
        F.floor(F.col(position) / TURN_BUCKET),
        F.col("tokens").cast("long"),
        "running_tokens",
        descending=keep == "newest",
    )
    return totals.where(F.col("running_tokens") <= max_tokens)


# --- prompts ----------------------------------------------------------------------

INSTRUCTIONS = {
    "rag": "Answer the question from the excerpts below and name the path and lines of each one you use.",
    "general": "Reply briefly; this message is not about the corpus.",
    "docs": "Write a Markdown document about the excerpts below, without inventing anything.",
    "rewrite": "Restate the latest question so that it stands on its own. Give only the question.",
    "summarize": "Summarize the conversation and keep paths, names and decisions. Give only the summary.",
    "classify": "Name the one category the message belongs to: code_qa, debugging, architecture_explain, doc_generation or general_chat.",
}


def _required(name: str, kind: str) -> Column:
    value = F.col(name)
    return F.when(
        value.isNull(), F.raise_error(F.lit(f"{kind} prompt needs {name}"))
    ).otherwise(value)


def _history() -> Column:
    lines = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return F.when(F.size("history") > 0, F.array_join(lines, "\n"))


def _excerpts() -> Column:
    blocks = F.transform(
        "chunks",
        lambda c: F.concat(
            c["file_path"], F.lit(":"), c["start_line"].cast("string"), F.lit("-"),
            c["end_line"].cast("string"), F.lit("\n"), F.coalesce(c["text"], F.lit("")),
        ),
    )
    return F.when(F.size("chunks") > 0, F.array_join(blocks, "\n---\n"))


def _tool_notes() -> Column:
    good = F.filter("tool_calls", lambda c: c["error"].isNull() & (F.coalesce(c["result"], F.lit("")) != ""))
    return F.when(F.size(good) > 0, F.array_join(F.transform(good, lambda c: c["result"]), "\n---\n"))


def prompt_text(kind: str) -> Column:
    """Prompt of one kind from the columns it needs; parts that are null are left out."""
    head = F.lit(INSTRUCTIONS[kind])
    question = F.concat(F.lit("Question: "), F.coalesce("rewritten_query", _required("query", kind))) if kind in ("rag", "general") else None
    summary = F.concat(F.lit("Summary: "), F.nullif("summary", F.lit("")))
    parts = {
        "rag": lambda: [summary, _history(), _excerpts(), _tool_notes(), question],
        "general": lambda: [_history(), question],
        "docs": lambda: [
            F.concat(F.lit("Scope: "), _required("scope", kind), F.coalesce(F.concat(F.lit(" "), F.col("path")), F.lit(""))),
            _excerpts(),
        ],
        "rewrite": lambda: [_history(), F.concat(F.lit("Question: "), _required("query", kind))],
        "summarize": lambda: [summary, _history()],
        "classify": lambda: [F.concat(F.lit("Message: "), _required("query", kind))],
    }[kind]()
    return F.concat_ws("\n\n", head, *parts)


def build_prompt(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("prompt", prompt_text(kind))


def select_context(hits: DataFrame, intents: DataFrame, count: int = 8) -> DataFrame:
    """First ``count`` reranked hits of each query; none for general chat."""
    wanted = intents.where(F.col("intent") != "general_chat").select("query_id")
    return hits.where(F.col("rank") <= count).join(wanted, "query_id", "left_semi")


def cite(context: DataFrame) -> DataFrame:
    """Citations are exactly the context rows (at most the context size per query)."""
    rows = F.sort_array(
        F.collect_list(F.struct("rank", "chunk_id", "file_path", "start_line", "end_line", "score"))
    )
    return context.groupBy("query_id").agg(rows.alias("c")).select(
        "query_id",
        F.transform(
            "c",
            lambda c: F.struct(
                c["chunk_id"].alias("chunk_id"),
                c["file_path"].alias("file_path"),
                c["start_line"].alias("start_line"),
                c["end_line"].alias("end_line"),
                c["score"].alias("score"),
            ),
        ).alias("citations"),
    )


def merge_context_overlaps(context: DataFrame) -> DataFrame:
    """Overlapping hits of one file become one span with each line once."""
    keys = ["query_id", "file_path"]
    in_order = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        context.withColumn("opens", (reach.isNull() | (F.col("start_line") > reach)).cast("int"))
        .withColumn("island", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    lines = (
        islands.select(
            *keys, "island", "start_line", "rank", "score",
            F.posexplode(F.split("text", "\n")).alias("n", "line"),
        )
        .groupBy(*keys, "island", (F.col("start_line") + F.col("n")).alias("line_no"))
        .agg(F.max("line").alias("line"), F.min("rank").alias("rank"), F.max("score").alias("score"))
    )
    return (
        lines.groupBy(*keys, "island")
        .agg(
            F.min("line_no").alias("start_line"),
            F.max("line_no").alias("end_line"),
            F.min("rank").alias("rank"),
            F.max("score").alias("score"),
            F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"),
        )
        .withColumn("text", F.array_join(F.col("lines.line"), "\n"))
        .drop("lines", "island")
    )


# --- completion ---------------------------------------------------------------------


class TransientError(Exception):
    """Raised by a completer when trying again may help (connection, server fault)."""


Completer = Callable[[list[str]], list[dict]]

COMPLETION = "text string, prompt_tokens long, completion_tokens long, finish_reason string, error string"


def complete(
    prompts: DataFrame,
    completer: Completer,
    retries: int = 3,
    batch_size: int = 16,
    backoff_seconds: float = 0.5,
) -> DataFrame:
    """Batch completion over a prompt table; a failure becomes a value in ``error``.

    ``completer(prompts)`` gives one dict per prompt with text, prompt_tokens,
    completion_tokens and finish_reason. Only ``TransientError`` is retried.
    """

    @F.pandas_udf(f"struct<{', '.join(c.replace(' ', ':', 1) for c in COMPLETION.split(', '))}>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COMPLETION.split(", ")]
        for batch in batches:
            rows: list[dict] = []
            for low in range(0, len(batch), batch_size):
                part = batch.iloc[low : low + batch_size].tolist()
                for attempt in range(retries + 1):
                    try:
                        rows += [dict(r) for r in completer(part)]
                        break
                    except TransientError as exc:
                        if attempt == retries:
                            rows += [{"error": str(exc)}] * len(part)
                        else:
                            time.sleep(backoff_seconds * 2**attempt)
                    except Exception as exc:
                        rows += [{"error": str(exc) or type(exc).__name__}] * len(part)
                        break
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    others = prompts.columns
    return prompts.withColumn("completion", call("prompt")).select(*others, "completion.*")


def summarize(
    conversations: DataFrame, messages: DataFrame, completer: Completer, max_turns: int = 20
) -> DataFrame:
    """Conversations with a new summary; deleted ones are refused, failures keep the old one."""
    alive = conversations.where(~F.col("is_deleted"))
    prompts = build_prompt(context_window(messages, alive, max_turns), "summarize")
    done = complete(prompts.select("conversation_id", "prompt"), completer).select(
        "conversation_id", F.col("text").alias("_summary")
    )
    return (
        conversations.join(done, "conversation_id", "left")
        .withColumn("summary", F.coalesce(F.nullif(F.trim("_summary"), F.lit("")), F.col("summary")))
        .drop("_summary")
    )


# What is said when there is no answer.
EMPTY_ANSWER = (
    "I wasn't able to produce an answer for that within the model's response budget. "
    "Try rephrasing your question more narrowly."
)
ERROR_ANSWER = "Sorry, I couldn't process that request due to a system error. Details: "


def finalize_answers(df: DataFrame) -> DataFrame:
    """Answer rows (text, error, citations) -> assistant messages."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return (
        df.withColumn(
            "content",
            F.when(failed, F.concat(F.lit(ERROR_ANSWER), F.col("error"))).otherwise(
                F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit(EMPTY_ANSWER))
            ),
        )
        .withColumn("citations", F.when(~failed, F.col("citations")))
        .withColumn("role", F.lit("assistant"))
    )


def rewrite_needed(turns: DataFrame) -> DataFrame:
    """``needs_rewrite`` is false without earlier turns; a blank rewrite keeps the query.

    ``turns`` holds query, history (strictly before the turn) and, where a rewrite
    was made, rewrite.
    """
    needed = F.size(F.coalesce("history", F.array())) > 0
    rewritten = F.coalesce(F.nullif(F.trim("rewrite"), F.lit("")), F.col("query"))
    return turns.withColumn("needs_rewrite", needed).withColumn(
        "rewritten_query", F.when(needed, rewritten).otherwise(F.col("query"))
    )


def reconstruct_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Text of each file from its active chunks, headed by the path.

    A file's text is bounded by the size cap of the scan, so one group is too.
    """
    body = (
        chunks.where("is_active")
        .groupBy("file_id")
        .agg(F.sort_array(F.collect_list(F.struct("start_line", "content"))).alias("parts"))
        .select("file_id", F.array_join(F.col("parts.content"), "\n\n").alias("body"))
    )
    return files.select("file_id", "path").join(body, "file_id").select(
        "file_id", F.concat("path", F.lit(":\n"), "body").alias("content")
    )


def tool_audit(calls: DataFrame, cap: int = 3) -> DataFrame:
    """First ``cap`` tool calls of each turn, with the turn's counts of calls and errors kept."""
    order = Window.partitionBy("turn_id").orderBy("seq")
    kept = calls.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    trail = kept.groupBy("turn_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "tool_name"))).alias("trail")
    )
    totals = calls.groupBy("turn_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("error").isNotNull().cast("long")).alias("errors"),
    )
    return totals.join(trail, "turn_id")


def token_usage(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Token totals by direction with a grand total (direction null)."""
    columns = ["direction", *(by or [])]
    return log.rollup(*columns).agg(F.sum("tokens").alias("tokens"))
