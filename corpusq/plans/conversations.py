"""Conversation, context, prompt and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.functions.text import INTENTS, parse_label, token_count
from corpusq.operators import filters, search, turns
from corpusq.plans import tables as t
from corpusq.plans.chunks import TOKENS
from corpusq.plans.registry import query


def messages(spark, sf):
    return t.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content")
    )


def conversations(spark, sf):
    """One row per conversation; those with a system turn count as deleted."""
    return (
        messages(spark, sf)
        .groupBy("conversation_id")
        .agg(
            F.count(F.lit(1)).alias("turn_count"),
            F.sum(F.length("content")).alias("updated_at"),
            F.max(F.col("role") == "system").alias("is_deleted"),
            F.min("content").alias("summary"),
        )
        .withColumn("user_id", F.col("conversation_id") % 7)
        .withColumn("workspace_id", F.lit("main"))
    )


SQL_CONV = """
messages AS (SELECT conv_id AS conversation_id, turn, role, text AS content FROM conversations),
conv AS (
  SELECT conversation_id, count(*) AS turn_count, sum(length(content))::BIGINT AS updated_at,
         bool_or(role = 'system') AS is_deleted, min(content) AS summary, conversation_id % 7 AS user_id
  FROM messages GROUP BY conversation_id)"""

SQL_WINDOW = """
newest AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS n FROM messages),
windows AS (
  SELECT conversation_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS history, count(*) AS turns
  FROM newest WHERE n <= 4 GROUP BY conversation_id)"""


@query(
    "a1_context_window",
    f"""WITH {SQL_CONV},{SQL_WINDOW}
SELECT conversation_id, md5(summary) AS summary_md5, md5(history) AS history_md5, turns
FROM conv LEFT JOIN windows USING (conversation_id)""",
)
def context_window(spark, sf):
    df = turns.context_window(messages(spark, sf), conversations(spark, sf), 4)
    lines = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return df.select(
        "conversation_id",
        F.md5("summary").alias("summary_md5"),
        F.md5(F.array_join(lines, "\n")).alias("history_md5"),
        F.size("history").cast("long").alias("turns"),
    )


@query(
    "a2_append_messages",
    f"""WITH {SQL_CONV} SELECT conversation_id, turn_count + (SELECT count(*) FROM messages m
  WHERE m.conversation_id = conv.conversation_id AND m.role = 'user') AS turn_count FROM conv""",
)
def append_messages(spark, sf):
    """Every user message is appended once more."""
    m = messages(spark, sf)
    new = m.where("role = 'user'").withColumn("turn", F.col("turn") + 1000)
    _, moved = turns.append_messages(conversations(spark, sf), m, new)
    return moved.select("conversation_id", "turn_count")


@query(
    "a2_appended_tokens",
    f"""WITH {SQL_CONV} SELECT conversation_id, turn, NULL::BIGINT AS token_count FROM messages
UNION ALL SELECT conversation_id, turn + 1000, len(regexp_extract_all(content, '{TOKENS}'))
FROM messages WHERE role = 'user'""",
)
def appended(spark, sf):
    m = messages(spark, sf)
    new = m.where("role = 'user'").withColumn("turn", F.col("turn") + 1000)
    grown, _ = turns.append_messages(conversations(spark, sf), m, new)
    return grown.select("conversation_id", "turn", F.col("token_count").cast("long").alias("token_count"))


@query(
    "a3_summary_due",
    f"""WITH {SQL_CONV} SELECT * FROM (
  SELECT conversation_id, turn, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS turn_count
  FROM messages) WHERE turn_count % 3 = 0""",
)
def summary_due(spark, sf):
    return turns.summary_due(messages(spark, sf), 3)


SQL_SUMMARY_PROMPT = f"""
prompts AS (
  SELECT conversation_id, concat_ws(chr(10) || chr(10), '{turns.INSTRUCTIONS["summarize"]}', 'Summary: ' || summary, history) AS prompt
  FROM conv LEFT JOIN windows USING (conversation_id))"""


@query(
    "a4_summarize",
    f"""WITH {SQL_CONV},{SQL_WINDOW},{SQL_SUMMARY_PROMPT}
SELECT conversation_id, CASE WHEN is_deleted THEN summary ELSE length(prompt) || ' characters' END AS summary, is_deleted
FROM conv JOIN prompts USING (conversation_id)""",
)
def summarize(spark, sf):
    """With a stand-in completer that answers with the length of its prompt."""

    def completer(prompts):
        return [{"text": f"{len(p)} characters", "finish_reason": "stop"} for p in prompts]

    df = turns.summarize(conversations(spark, sf), messages(spark, sf), completer, 4)
    return df.select("conversation_id", "summary", "is_deleted")


@query(
    "a5_conversation_pages",
    f"""WITH {SQL_CONV} SELECT user_id, conversation_id, place FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, conversation_id) AS place
  FROM conv WHERE NOT is_deleted) WHERE place BETWEEN 3 AND 7""",
)
def pages(spark, sf):
    df = turns.conversation_pages(conversations(spark, sf), limit=5, offset=2)
    return df.select("user_id", "conversation_id", F.col("place").cast("long").alias("place"))


@query(
    "a5_list_conversations",
    f"""WITH {SQL_CONV} SELECT conversation_id, updated_at FROM conv WHERE user_id = 3 AND NOT is_deleted
ORDER BY updated_at DESC, conversation_id LIMIT 20 OFFSET 1""",
)
def list_conversations(spark, sf):
    return turns.list_conversations(conversations(spark, sf), 3, offset=1).select(
        "conversation_id", "updated_at"
    )


@query(
    "a6_soft_delete",
    f"""WITH {SQL_CONV} SELECT conversation_id,
  is_deleted OR conversation_id IN (SELECT conversation_id FROM messages WHERE turn = 7) AS is_deleted FROM conv""",
)
def soft_delete(spark, sf):
    ids = messages(spark, sf).where("turn = 7")
    return turns.soft_delete(conversations(spark, sf), ids).select("conversation_id", "is_deleted")


SQL_TOKENS = f"""
sized AS (SELECT *, len(regexp_extract_all(content, '{TOKENS}')) AS tokens FROM messages)"""


def _trim_sql(order: str) -> str:
    return f"""WITH {SQL_CONV},{SQL_TOKENS} SELECT conversation_id, turn, running_tokens::BIGINT AS running_tokens FROM (
  SELECT *, sum(tokens) OVER (PARTITION BY conversation_id ORDER BY turn {order}) AS running_tokens FROM sized)
WHERE running_tokens <= 150"""


@query("a7_trim_newest", _trim_sql("DESC"))
def trim_newest(spark, sf):
    return turns.trim_to_budget(messages(spark, sf), 150).select(
        "conversation_id", "turn", "running_tokens"
    )


@query("a7_trim_most_relevant", _trim_sql("ASC"))
def trim_relevant(spark, sf):
    return turns.trim_to_budget(messages(spark, sf), 150, "highest_relevance").select(
        "conversation_id", "turn", "running_tokens"
    )


def _search(spark, sf):
    q, v, c, f = t.search_queries(spark, sf), t.vectors(spark, sf), t.chunks(spark, sf), t.files(spark, sf)
    return q, search.hybrid_search(q, v, c, f)


SQL_SEARCH = f"{t.SQL_HYBRID},{t.SQL_HITS},{t.SQL_RERANKED}"

# Intent by the number of the query item: every label in turn.
SQL_INTENTS = f"""
intents AS (
  SELECT query_id, {INTENTS}[1 + query_id % 5] AS intent FROM queries),
context AS (
  SELECT r.* FROM reranked r JOIN intents USING (query_id) WHERE rank <= 8 AND intent <> 'general_chat')"""


def _intents(queries):
    labels = F.array(*[F.lit(i) for i in INTENTS])
    return queries.select(
        "query_id", F.get(labels, (F.col("query_id") % 5).cast("int")).alias("intent")
    )


@query(
    "a9_select_context",
    f"WITH {SQL_SEARCH},{SQL_INTENTS} SELECT query_id, chunk_id, rank FROM context",
)
def select_context(spark, sf):
    q, hits = _search(spark, sf)
    return turns.select_context(hits, _intents(q)).select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank")
    )


@query(
    "a10_cite",
    f"""WITH {SQL_SEARCH},{SQL_INTENTS}
SELECT query_id, string_agg(chunk_id || '@' || file_path || ':' || start_line || '-' || end_line, ';' ORDER BY rank)
       AS citations FROM context GROUP BY query_id""",
)
def cite(spark, sf):
    q, hits = _search(spark, sf)
    cited = turns.cite(turns.select_context(hits, _intents(q)))
    one = F.transform(
        "citations",
        lambda c: F.concat(
            c["chunk_id"].cast("string"), F.lit("@"), c["file_path"], F.lit(":"),
            c["start_line"].cast("string"), F.lit("-"), c["end_line"].cast("string"),
        ),
    )
    return cited.select("query_id", F.array_join(one, ";").alias("citations"))


def _rag_rows(spark, sf):
    """Each query with its context, the conversation of the same number, and two tool calls."""
    q, hits = _search(spark, sf)
    context = turns.select_context(hits, _intents(q)).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "file_path", "start_line", "end_line", "text"))).alias("chunks")
    )
    windows = turns.context_window(messages(spark, sf), conversations(spark, sf), 4).withColumnRenamed(
        "conversation_id", "query_id"
    )
    call = "struct<result:string,error:string>"
    calls = F.array(
        F.struct(F.lit("blame of it").alias("result"), F.lit(None).cast("string").alias("error")).cast(call),
        F.struct(F.lit("lost").alias("result"), F.lit("no clone").alias("error")).cast(call),
    )
    return (
        q.select("query_id", F.col("query_text").alias("query"))
        .join(context, "query_id", "left")
        .join(windows, "query_id", "left")
        .withColumn("tool_calls", calls)
        .withColumn("rewritten_query", F.lit(None).cast("string"))
    )


@query(
    "a8_build_prompt",
    f"""WITH {SQL_SEARCH},{SQL_INTENTS},{SQL_CONV},{SQL_WINDOW},
blocks AS (
  SELECT query_id, string_agg(file_path || ':' || start_line || '-' || end_line || chr(10) || text,
                              chr(10) || '---' || chr(10) ORDER BY rank) AS excerpts
  FROM context GROUP BY query_id)
SELECT query_id, md5(concat_ws(chr(10) || chr(10),
    '{turns.INSTRUCTIONS["rag"]}', 'Summary: ' || summary, history, excerpts, 'blame of it',
    'Question: ' || query_text)) AS prompt_md5
FROM queries LEFT JOIN blocks USING (query_id)
LEFT JOIN conv ON conv.conversation_id = query_id LEFT JOIN windows w ON w.conversation_id = query_id""",
)
def build_prompt(spark, sf):
    return turns.build_prompt(_rag_rows(spark, sf), "rag").select(
        "query_id", F.md5("prompt").alias("prompt_md5")
    )


@query(
    "a11_complete",
    f"""WITH {SQL_CONV},{SQL_WINDOW},{SQL_SUMMARY_PROMPT}
SELECT conversation_id, right(prompt, 40) AS text, len(regexp_extract_all(prompt, '\\S+'))::BIGINT AS prompt_tokens,
       len(regexp_extract_all(right(prompt, 40), '\\S+'))::BIGINT AS completion_tokens, 'stop' AS finish_reason, NULL::VARCHAR AS error
FROM prompts""",
)
def complete(spark, sf):
    """With a stand-in completer; every prompt is the summary prompt of a conversation."""

    def completer(prompts):
        return [
            {
                "text": p[-40:], "prompt_tokens": len(p.split()), "completion_tokens": len(p[-40:].split()),
                "finish_reason": "stop",
            }
            for p in prompts
        ]

    prompts = turns.build_prompt(
        turns.context_window(messages(spark, sf), conversations(spark, sf), 4), "summarize"
    ).select("conversation_id", "prompt")
    return turns.complete(prompts, completer).drop("prompt")


@query(
    "a12_finalize_answers",
    f"""WITH {SQL_CONV} SELECT conversation_id, turn, 'assistant' AS role,
  CASE WHEN role = 'system' THEN '{turns.ERROR_ANSWER}model is down'
       WHEN role = 'user' THEN '{turns.EMPTY_ANSWER.replace("'", "''")}' ELSE content END AS content,
  CASE WHEN role <> 'system' THEN 'c' || turn END AS citations FROM messages""".replace(
        "'Sorry, I couldn't", "'Sorry, I couldn''t"
    ),
)
def finalize(spark, sf):
    answers = messages(spark, sf).select(
        "conversation_id",
        "turn",
        F.when(F.col("role") == "system", F.lit("model is down")).alias("error"),
        F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("content")).alias("text"),
        F.concat(F.lit("c"), F.col("turn").cast("string")).alias("citations"),
    )
    return turns.finalize_answers(answers).select("conversation_id", "turn", "role", "content", "citations")


@query(
    "a13_rewrite_needed",
    f"""WITH {SQL_CONV} SELECT conversation_id, turn,
  EXISTS (SELECT 1 FROM messages p WHERE p.conversation_id = m.conversation_id AND p.turn < m.turn) AS needs_rewrite,
  CASE WHEN EXISTS (SELECT 1 FROM messages p WHERE p.conversation_id = m.conversation_id AND p.turn < m.turn)
            AND turn % 4 <> 0 THEN 'about ' || conversation_id ELSE content END AS rewritten_query
FROM messages m WHERE role = 'user'""",
)
def rewrite(spark, sf):
    """User turns; those after the first turn have a history. Some rewrites are blank."""
    m = messages(spark, sf)
    first = m.groupBy("conversation_id").agg(F.min("turn").alias("first_turn"))
    rows = (
        m.join(first, "conversation_id")
        .where("role = 'user'")
        .select(
            "conversation_id",
            "turn",
            F.col("content").alias("query"),
            F.when(F.col("turn") > F.col("first_turn"), F.array("first_turn")).alias("history"),
            F.when(F.col("turn") % 4 == 0, F.lit("  ")).otherwise(
                F.concat(F.lit("about "), F.col("conversation_id").cast("string"))
            ).alias("rewrite"),
        )
    )
    return turns.rewrite_needed(rows).select("conversation_id", "turn", "needs_rewrite", "rewritten_query")


@query(
    "a14_reconstruct_files",
    """WITH parts AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS l,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id AS file_id, md5(lang || '/' || source || '/' || doc_id || '.md:' || chr(10)
       || string_agg(l, chr(10) || chr(10) ORDER BY i)) AS content_md5
FROM parts WHERE l <> '' GROUP BY doc_id, lang, source""",
)
def reconstruct(spark, sf):
    """Every line of a document as a chunk; empty lines are inactive."""
    f = t.files(spark, sf)
    chunks = f.select("file_id", F.posexplode(F.split("content", "\n")).alias("n", "content")).select(
        "file_id", (F.col("n") + 1).alias("start_line"), "content", (F.col("content") != "").alias("is_active")
    )
    return turns.reconstruct_files(chunks, f).select("file_id", F.md5("content").alias("content_md5"))


@query(
    "a15_tool_audit",
    """WITH calls AS (
  SELECT user_id AS turn_id, event_type AS tool_name, event_type = 'error' AS failed,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT turn_id, count(*) AS calls, sum(failed::INT)::BIGINT AS errors,
       string_agg(tool_name, ',' ORDER BY n) FILTER (n <= 3) AS trail
FROM calls GROUP BY turn_id""",
)
def audit(spark, sf):
    calls = t.table(spark, sf, "events").select(
        F.col("user_id").alias("turn_id"),
        F.struct("ts", "event_id").alias("seq"),
        F.col("event_type").alias("tool_name"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
    )
    df = turns.tool_audit(calls)
    return df.select("turn_id", "calls", "errors", F.array_join(F.col("trail.tool_name"), ",").alias("trail"))


@query(
    "a16_token_usage",
    f"""WITH {SQL_CONV},{SQL_TOKENS},
directed AS (SELECT CASE WHEN role = 'assistant' THEN 'completion' ELSE 'prompt' END AS direction, tokens FROM sized)
SELECT direction, sum(tokens)::BIGINT AS tokens FROM directed GROUP BY ROLLUP (direction)""",
)
def usage(spark, sf):
    log = messages(spark, sf).select(
        F.when(F.col("role") == "assistant", F.lit("completion")).otherwise(F.lit("prompt")).alias("direction"),
        token_count(F.col("content")).alias("tokens"),
    )
    return turns.token_usage(log)


@query(
    "a17_merge_context_overlaps",
    """WITH src AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i
  FROM documents),
spans AS (
  SELECT doc_id, ls, i AS s, least(i + length(ls[i]) % 5, len(ls)) AS e FROM src WHERE length(ls[i]) > 250),
flagged AS (
  SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM spans),
islands AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS g
  FROM flagged)
SELECT doc_id AS query_id, min(s) AS start_line, max(e) AS end_line, min(s) AS rank,
       md5(array_to_string(list_slice(any_value(ls), min(s), max(e)), chr(10))) AS text_md5
FROM islands GROUP BY doc_id, g""",
)
def merge_overlaps(spark, sf):
    """Spans opening at the long lines of a document, as hits of one query."""
    d = t.documents(spark, sf).withColumn("ls", F.split("text", "\n"))
    spans = d.select("doc_id", "ls", F.posexplode("ls").alias("n", "line")).where("length(line) > 250")
    end = F.least(F.col("n") + 1 + F.length("line") % 5, F.size("ls"))
    context = spans.select(
        F.col("doc_id").alias("query_id"),
        F.lit("f").alias("file_path"),
        (F.col("n") + 1).alias("start_line"),
        end.alias("end_line"),
        (F.col("n") + 1).alias("rank"),
        F.lit(1.0).alias("score"),
        F.array_join(F.slice("ls", F.col("n") + 1, end - F.col("n")), "\n").alias("text"),
    )
    return turns.merge_context_overlaps(context).select(
        "query_id",
        *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "rank")],
        F.md5("text").alias("text_md5"),
    )


_LABEL_SQL = "CASE " + " ".join(f"WHEN contains(x, '{i}') THEN '{i}'" for i in INTENTS) + " ELSE 'code_qa' END"


def _label_sql() -> str:
    return f"""answers AS (
  SELECT conversation_id, turn, CASE turn % 4 WHEN 0 THEN ' Category: DEBUGGING. '
         WHEN 1 THEN 'general_chat or doc_generation' WHEN 2 THEN 'architecture_explain' ELSE '' END || content AS x0,
         content FROM messages),
labelled AS (SELECT *, {_LABEL_SQL} AS intent FROM (SELECT *, lower(trim(x0)) AS x FROM answers))"""


def _labelled(spark, sf):
    said = (
        F.when(F.col("turn") % 4 == 0, F.lit(" Category: DEBUGGING. "))
        .when(F.col("turn") % 4 == 1, F.lit("general_chat or doc_generation"))
        .when(F.col("turn") % 4 == 2, F.lit("architecture_explain"))
        .otherwise(F.lit(""))
    )
    return messages(spark, sf).withColumn("intent", parse_label(F.concat(said, F.col("content"))))


@query("f10_parse_label", f"WITH {SQL_CONV},{_label_sql()} SELECT conversation_id, turn, intent FROM labelled")
def label(spark, sf):
    return _labelled(spark, sf).select("conversation_id", "turn", "intent")


@query(
    "f11_route",
    f"""WITH {SQL_CONV},{_label_sql()},
state AS (
  SELECT l.conversation_id, l.turn, intent, m.role = 'system' AS failed, l.turn % 3 AS hit_count,
         l.turn % 2 = 1 AS called
  FROM labelled l JOIN messages m USING (conversation_id, turn))
SELECT conversation_id, turn,
  CASE WHEN failed THEN 'error_handler' WHEN intent = 'general_chat' THEN 'generate_answer' ELSE 'rewrite_query' END AS next_step,
  CASE WHEN intent = 'debugging' AND hit_count > 0 AND NOT called THEN 'get_git_blame' END AS next_tool
FROM state""",
)
def route(spark, sf):
    state = _labelled(spark, sf).select(
        "conversation_id",
        "turn",
        "intent",
        F.when(F.col("role") == "system", F.lit("down")).alias("error"),
        (F.col("turn") % 3).alias("hit_count"),
        F.when(F.col("turn") % 2 == 1, F.array(F.lit("get_git_blame"))).otherwise(
            F.array(F.lit("run_search"))
        ).alias("tool_calls"),
    )
    return filters.route(state).select("conversation_id", "turn", "next_step", "next_tool")


@query(
    "f16_owned_by",
    f"""WITH {SQL_CONV} SELECT conversation_id, turn FROM messages m
WHERE EXISTS (SELECT 1 FROM conv c WHERE c.conversation_id = m.conversation_id AND c.user_id = 3)""",
)
def owned(spark, sf):
    mine = conversations(spark, sf).where("user_id = 3")
    return filters.owned_by(messages(spark, sf), mine, ["conversation_id"]).select("conversation_id", "turn")
