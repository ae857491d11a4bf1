"""Event, stream, metric and quality queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusq.operators import filters, metrics, search
from corpusq.plans import tables as t
from corpusq.plans.chunks import sql_markdown
from corpusq.plans.indexing import progress_messages
from corpusq.plans.registry import query
from corpusq.session import CODEC, checkpoint_root, drop_staged, stage
from corpusq.streaming import events as ev
from corpusq.streaming import rate_limit as rl


def events(spark, sf):
    return t.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def replay(spark, sf, name, build):
    """Run a streaming query over the table as it lies and read back what it wrote."""
    folder = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    path = f"{sf}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/{name}.parquet*")
    out = build(stream)
    job = (
        out.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


HOUR, LIMIT = 3600, 3

# One step per hit: the window of the hit before is kept or a new one opens.
_LIMIT_SQL = """
WITH RECURSIVE numbered AS (
  SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT event_type, event_id, ts, n, ts AS start, 1 AS hit FROM numbered WHERE n = 1
  UNION ALL
  SELECT e.event_type, e.event_id, e.ts, e.n,
         CASE WHEN e.ts >= w.start + INTERVAL 3600 SECOND THEN e.ts ELSE w.start END,
         CASE WHEN e.ts >= w.start + INTERVAL 3600 SECOND THEN 1 ELSE w.hit + 1 END
  FROM walk w JOIN numbered e ON e.event_type = w.event_type AND e.n = w.n + 1)
SELECT event_type, event_id, epoch_us(start) AS window_start, hit::BIGINT AS hit, hit <= 3 AS allowed,
       CASE WHEN hit > 3 THEN 3600 END::BIGINT AS retry_after FROM walk"""


def _limited(df):
    return df.select(
        "event_type",
        "event_id",
        F.unix_micros("window_start").alias("window_start"),
        F.col("hit").cast("long").alias("hit"),
        "allowed",
        F.col("retry_after").cast("long").alias("retry_after"),
    )


@query("st1_rate_limit", _LIMIT_SQL)
def rate_limit(spark, sf):
    return _limited(
        rl.rate_limit(
            events(spark, sf), ["event_type"], "ts", "event_id", LIMIT, seconds=HOUR,
            bucket_seconds=48 * HOUR,
        )
    )


@query("st1_rate_limit_stream", _LIMIT_SQL)
def rate_limit_stream(spark, sf):
    return _limited(
        replay(
            spark, sf, "events",
            lambda s: rl.rate_limit_stream(s, ["event_type"], "ts", "event_id", LIMIT, HOUR, delay="10 minutes"),
        )
    )


@query(
    "st1_rate_limit_aligned",
    """SELECT user_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, count(*) AS hits,
  greatest(count(*) - 1, 0) AS rejected FROM events GROUP BY ALL""",
)
def rate_limit_aligned(spark, sf):
    df = rl.rate_limit_aligned(events(spark, sf), ["user_id"], "ts", 1, HOUR)
    return df.withColumn("window_start", F.unix_micros("window_start")).withColumn(
        "rejected", F.col("rejected").cast("long")
    )


@query(
    "st2_index_stream",
    f"""WITH RECURSIVE md AS (
  SELECT lang || '/' || source || '/' || doc_id || '.md' AS file_id, text FROM documents),
{sql_markdown("dummy AS (SELECT 1)", 128, 32).strip()},
counts AS (SELECT file_id, count(*) AS chunks FROM markdown_chunks GROUP BY file_id)
SELECT source AS repository_id, lang || '/' || source || '/' || doc_id || '.md' AS path, 'new' AS status,
       coalesce(chunks, 0) AS chunks
FROM documents LEFT JOIN counts ON file_id = lang || '/' || source || '/' || doc_id || '.md'""",
)
def index_stream(spark, sf):
    """All documents arrive as a stream of files; the results of the run are read back."""
    from corpusq.functions.encoders import hashed_encoder
    from corpusq.operators import indexing
    from corpusq.streaming.index import index_stream as start

    run = uuid.uuid4().hex
    out = f"{checkpoint_root(spark)}/indexed-{run}"
    path = f"{sf}/documents.parquet"
    arriving = (
        spark.readStream.schema(spark.read.parquet(path).schema)
        .parquet(f"{path}*")
        .select(
            F.col("source").alias("repository_id"),
            F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
            F.col("text").cast("binary").alias("content"),
            F.col("n_chars").alias("length"),
        )
    )

    def save(tables, results, number):
        results.write.mode("overwrite").parquet(f"{out}/batch={number}")

    start(
        arriving, lambda: indexing.empty_tables(spark), save, hashed_encoder(), "hashed-64", "main", run,
        max_tokens=128, min_tokens=32,
    ).awaitTermination()
    return spark.read.parquet(out).select("repository_id", "path", "status", "chunks")


@query(
    "st2_index_stream_repeats",
    """SELECT source AS repository_id, lang || '/' || source || '/' || doc_id || '.md' AS path,
       sha256(text) AS content_hash, 1 AS copies FROM documents""",
)
def index_stream_repeats(spark, sf):
    """Every path arrives twice, first with an old text; files arrive in several micro-batches
    and the state is carried from one to the next."""
    from corpusq.functions.encoders import hashed_encoder
    from corpusq.operators import indexing
    from corpusq.streaming.index import index_stream as start

    run = uuid.uuid4().hex
    root = f"{checkpoint_root(spark)}/arrivals-{run}"
    docs = t.table(spark, sf, "documents").select(
        F.col("source").alias("repository_id"),
        F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.col("text").cast("binary").alias("content"),
        F.col("n_chars").alias("length"),
    )
    old = docs.withColumn("content", F.concat(F.encode(F.lit("# Draft\n"), "utf-8"), "content"))
    both = old.withColumn("arrived_at", F.lit(1)).unionByName(docs.withColumn("arrived_at", F.lit(2)))
    both.repartition(3, "path").write.option("compression", CODEC).parquet(f"{root}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 1)
    state = {"tables": indexing.empty_tables(spark), "last": -1}

    def save(tables, results, number):
        if number > state["last"]:
            folders = []
            kept = [stage(getattr(tables, part), folders) for part in ("files", "chunks", "vectors", "cache")]
            # What the batch has staged and the state before it are not read any more.
            drop_staged(spark, tables.folders)
            state.update(tables=indexing.IndexTables(*kept, folders), last=number)

    start(
        stream.parquet(f"{root}/in"), lambda: state["tables"], save, hashed_encoder(), "hashed-64", "main", run,
        max_tokens=128, min_tokens=32,
    ).awaitTermination()
    files = state["tables"].files
    return files.groupBy("repository_id", "path").agg(
        F.max("content_hash").alias("content_hash"), F.count(F.lit(1)).cast("int").alias("copies")
    )


_PROGRESS_SQL = """
WITH ends AS (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT e.user_id AS job_id, event_id, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'progress' END AS kind,
       CASE WHEN event_type <> 'purchase' THEN event_type END AS stage
FROM events e LEFT JOIN ends USING (user_id) WHERE stop IS NULL OR event_id <= stop"""


@query("st3_progress", _PROGRESS_SQL)
def progress(spark, sf):
    raw = progress_messages(spark, sf)
    return ev.progress_until_done(raw, seq="event_id").select("job_id", "event_id", "kind", "stage")


@query("st3_progress_stream", _PROGRESS_SQL)
def progress_stream(spark, sf):
    def build(stream):
        data = F.when(
            F.col("event_type") == "purchase", F.lit('{"event":"done"}')
        ).otherwise(F.to_json(F.struct(F.col("event_type").alias("stage"), F.col("props").alias("message"))))
        raw = stream.select("event_id", F.col("user_id").alias("job_id"), data.alias("data"))
        return ev.progress_stream(raw, seq="event_id")

    return replay(spark, sf, "events", build).select("job_id", "event_id", "kind", "stage")


IDLE = 12 * 3600

_IDLE_SQL = """
WITH spaced AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events)
SELECT user_id, epoch_us(min(ts) + INTERVAL 43200 SECOND) AS timed_out_at, 'idle_timeout' AS error
FROM spaced WHERE following > ts + INTERVAL 43200 SECOND GROUP BY user_id"""


@query("st4_idle_timeouts", _IDLE_SQL)
def idle(spark, sf):
    df = ev.idle_timeouts(events(spark, sf), "user_id", "ts", IDLE, bucket_seconds=86400)
    return df.withColumn("timed_out_at", F.unix_micros("timed_out_at"))


# Decided is what the watermark has passed: the end of the bucket in which the next event was due.
_IDLE_STREAM_SQL = """
WITH spaced AS (
  SELECT user_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events),
mark AS (SELECT epoch_us(max(ts)) - 600000000 AS w FROM events)
SELECT user_id, min(t) + 43200000000 AS timed_out_at, 'idle_timeout' AS error FROM spaced, mark
WHERE (following IS NULL OR following > t + 43200000000) AND ((t + 43200000000) // 43200000000 + 1) * 43200000000 < w
GROUP BY user_id"""


@query("st4_idle_timeouts_stream", _IDLE_STREAM_SQL)
def idle_stream(spark, sf):
    """Events arrive in six files by day, each with its rows in no order, one file per micro-batch."""
    folder = f"{checkpoint_root(spark)}/idle-{uuid.uuid4().hex}"
    whole = events(spark, sf)
    edges = whole.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    share = (F.col("ts").cast("double") - F.lit(edges["low"].timestamp())) / max(1.0, edges["high"].timestamp() - edges["low"].timestamp())
    part = F.least(F.floor(share * 6), F.lit(5)).cast("int")
    for n in range(6):
        own = whole.where(part == n).orderBy(F.xxhash64("event_id"))
        own.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = ev.idle_timeouts_stream(stream, "user_id", "ts", IDLE, delay="10 minutes")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").withColumn("timed_out_at", F.unix_micros("timed_out_at"))


@query(
    "st5_assemble_tokens",
    """WITH words AS (
  SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i
  FROM conversations)
SELECT conv_id || ':' || turn AS answer_id, md5(string_agg(w || ' ', '' ORDER BY i)) AS answer_md5,
       'conv ' || conv_id AS citations, CASE WHEN turn % 3 = 0 THEN 'error' ELSE 'done' END AS ended_with
FROM words GROUP BY conv_id, turn""",
)
def assemble(spark, sf):
    """Each turn as a stream of word events, then its citation and its end."""
    c = t.table(spark, sf, "conversations")
    answer = F.concat_ws(":", "conv_id", "turn").alias("answer_id")
    tokens = c.select(answer, F.posexplode(F.split("text", " ")).alias("seq", "w")).select(
        "answer_id", "seq", F.lit("token").alias("type"), F.concat("w", F.lit(" ")).alias("text")
    )
    ends = c.select(
        answer,
        F.inline(
            F.array(
                F.struct(F.lit(10**9).alias("seq"), F.lit("citations").alias("type"), F.concat(F.lit("conv "), F.col("conv_id").cast("string")).alias("text")),
                F.struct(
                    F.lit(10**9 + 1).alias("seq"),
                    F.when(F.col("turn") % 3 == 0, F.lit("error")).otherwise(F.lit("done")).alias("type"),
                    F.lit("").alias("text"),
                ),
            )
        ),
    )
    df = ev.assemble_tokens(tokens.unionByName(ends))
    return df.select("answer_id", F.md5("answer").alias("answer_md5"), "citations", "ended_with")


@query(
    "st6_active_sessions",
    """WITH revoked AS (
  SELECT user_id AS token_id, min(ts) AS revoked_at, CASE WHEN user_id % 5 = 0 THEN 0 ELSE 86400 * (1 + user_id % 7) END AS ttl
  FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT event_id, user_id AS token_id FROM events e
WHERE NOT EXISTS (SELECT 1 FROM revoked r WHERE r.token_id = e.user_id AND r.ttl > 0
                  AND e.ts >= r.revoked_at AND e.ts < r.revoked_at + to_seconds(r.ttl))""",
)
def sessions(spark, sf):
    """A user's token is revoked at the first error, for some days."""
    e = events(spark, sf)
    revoked = e.where("event_type = 'error'").groupBy(F.col("user_id").alias("token_id")).agg(
        F.min("ts").alias("revoked_at")
    ).withColumn(
        "ttl_seconds", F.when(F.col("token_id") % 5 == 0, F.lit(0)).otherwise(86400 * (1 + F.col("token_id") % 7))
    )
    tagged = e.withColumnRenamed("user_id", "token_id")
    return ev.active_sessions(tagged, revoked).select("event_id", "token_id")


@query(
    "st7_parse_event_log",
    """SELECT event_id, i::BIGINT AS seq, name, data FROM (
  SELECT event_id, 1 AS i, event_type AS name, props AS data FROM events
  UNION ALL SELECT event_id, 4, 'done', '[1,' || chr(10) || '2]' FROM events)""",
)
def event_log(spark, sf):
    """Five blocks per event: good, without data, not JSON, on two lines, incomplete."""
    log = F.concat(
        F.lit("event: "), F.col("event_type"), F.lit("\ndata: "), F.col("props"), F.lit("\n\n"),
        F.lit("event: empty\n\n"),
        F.lit("event: bad\ndata: {oops\n\n"),
        F.lit("event: done\ndata: [1,\ndata: 2]\n\n"),
        F.lit("event: cut\ndata: 1"),
    )
    e = t.table(spark, sf, "events").select("event_id", log.alias("log"))
    return ev.parse_event_log(e).withColumn("seq", F.col("seq").cast("long"))


# --- metrics --------------------------------------------------------------------------

_BOUNDS = ", ".join(f"('{b}')" for b in [*metrics.BUCKETS, "inf"])
_HISTOGRAM_SQL = f"""
SELECT event_type AS stage, le::DOUBLE AS le, sum((value <= le::DOUBLE)::INT)::BIGINT AS cumulative,
       count(*) AS count, round(sum(value), 4) AS sum
FROM events, (VALUES {_BOUNDS}) b(le) GROUP BY ALL"""


@query("m1_duration_histogram", _HISTOGRAM_SQL)
def histogram(spark, sf):
    log = t.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration"))
    return metrics.duration_histogram(log).withColumn("sum", F.round("sum", 4))


def replay_updates(spark, sf, name, build, keys):
    """The same in update mode: every change of a result row is written, the newest one counts."""
    folder = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    path = f"{sf}/{name}.parquet"
    out = build(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/{name}.parquet*"))

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    out.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", f"{folder}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(out.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return filters.latest_per_key(rows, keys, [F.desc("batch")]).drop("batch", "rank")


@query(
    "m1_duration_histogram_stream",
    f"""SELECT epoch_us(date_trunc('day', ts)) AS "window", event_type AS stage, le::DOUBLE AS le,
       sum((value <= le::DOUBLE)::INT)::BIGINT AS cumulative, count(*) AS count, round(sum(value), 4) AS sum
FROM events, (VALUES {_BOUNDS}) b(le) GROUP BY ALL""",
)
def histogram_stream(spark, sf):
    """By day. Update mode delivers the last day too, which append mode would hold back."""

    def build(stream):
        log = stream.select(
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.col("value").alias("duration")
        ).withWatermark("ts", "10 minutes")
        return metrics.duration_histogram(log, window=F.window("ts", "1 day")).withColumns(
            {"window": F.unix_micros("window.start"), "sum": F.round("sum", 4)}
        )

    return replay_updates(spark, sf, "events", build, ["window", "stage", "le"])


@query(
    "r11_stage_timings",
    """WITH log AS (SELECT ['dense', 'sparse', 'fuse', 'rerank'][1 + event_id % 4] AS stage, value / 100 AS d FROM events)
SELECT stage, count(*) AS count, round(sum(d), 4) AS sum, sum((d <= 0.1)::INT)::BIGINT AS within_100ms,
       sum((d <= 1)::INT)::BIGINT AS within_1s FROM log GROUP BY stage""",
)
def stage_timings(spark, sf):
    stages = F.array(*[F.lit(s) for s in ("dense", "sparse", "fuse", "rerank")])
    log = t.table(spark, sf, "events").select(
        F.get(stages, (F.col("event_id") % 4).cast("int")).alias("stage"), (F.col("value") / 100).alias("duration")
    )
    rows = metrics.duration_histogram(log)
    return rows.groupBy("stage", "count", F.round("sum", 4).alias("sum")).agg(
        F.max(F.when(F.col("le") == 0.1, F.col("cumulative"))).alias("within_100ms"),
        F.max(F.when(F.col("le") == 1.0, F.col("cumulative"))).alias("within_1s"),
    )


@query(
    "m2_latency_quantiles",
    """SELECT event_type AS route, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS window_start, count(*) AS requests,
  quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL""",
)
def quantiles(spark, sf):
    log = events(spark, sf).withColumnRenamed("event_type", "route")
    return metrics.latency_quantiles(log, ["route"], "ts", "value", "1 day").withColumn(
        "window_start", F.unix_micros("window_start")
    )


@query(
    "m2_failure_alerts",
    """WITH windows AS (
  SELECT e.event_type, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(10 * k) AS w FROM events e, range(6) r(k))
SELECT epoch_us(w) AS window_start, count(*) AS total, sum((event_type = 'error')::INT)::BIGINT AS failures
FROM windows GROUP BY w HAVING sum((event_type = 'error')::INT) > count(*) * 0.1""",
)
def failures(spark, sf):
    df = metrics.failure_alerts(events(spark, sf), "ts", F.col("event_type") == "error")
    return df.withColumn("window_start", F.unix_micros("window_start"))


@query(
    "m2_queue_alerts",
    """SELECT event_type AS queue, epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) AS window_start, min((props->>'k')::DOUBLE) AS lowest
FROM events GROUP BY ALL HAVING min((props->>'k')::DOUBLE) > 50""",
)
def queue(spark, sf):
    samples = events(spark, sf).select(
        F.col("event_type").alias("queue"), "ts", F.get_json_object("props", "$.k").cast("double").alias("depth")
    )
    return metrics.queue_alerts(samples, "ts", "queue", "depth").withColumn(
        "window_start", F.unix_micros("window_start")
    )


@query(
    "m2_latency_alerts",
    """SELECT event_type AS route, epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS window_start, quantile_disc(value, 0.95) AS p95
FROM events GROUP BY ALL HAVING quantile_disc(value, 0.95) > 40""",
)
def latency_alerts(spark, sf):
    log = events(spark, sf).withColumnRenamed("event_type", "route")
    found = metrics.latency_alerts(metrics.latency_quantiles(log, ["route"], "ts", "value"), 40)
    return found.select("route", F.unix_micros("window_start").alias("window_start"), "p95")


# --- retrieval quality ------------------------------------------------------------------

SQL_EXPECTED = """
expected AS (
  SELECT q.query_id, e.vec_id AS chunk_id FROM queries q
  JOIN embeddings own ON own.vec_id = q.query_id
  JOIN embeddings e ON e.label = own.label
  JOIN documents d ON d.doc_id = e.vec_id AND d.lang = q.workspace_id)"""


@query(
    "q1_retrieval_metrics",
    f"""WITH {t.SQL_QUERIES},{t.SQL_DENSE},{SQL_EXPECTED},
sizes AS (SELECT query_id, count(*) AS relevant FROM expected GROUP BY query_id),
found AS (
  SELECT query_id, count(*) AS found, min(rank) AS first FROM dense_ranked JOIN expected USING (query_id, chunk_id)
  WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, round(coalesce(found, 0) / relevant, 6) AS recall, round(coalesce(found, 0) / 10, 6) AS precision,
       round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank
FROM sizes LEFT JOIN found USING (query_id)""",
)
def quality(spark, sf):
    """Dense search of the query vectors; relevant is what has the same label."""
    q, v = t.search_queries(spark, sf), t.vectors(spark, sf)
    e = t.table(spark, sf, "embeddings")
    own = q.select("query_id", "workspace_id").join(
        e.select(F.col("vec_id").alias("query_id"), "label"), "query_id"
    )
    documents = t.documents(spark, sf).select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("workspace_id"))
    expected = e.select("vec_id", "label").join(documents, "vec_id").join(own, ["label", "workspace_id"]).select(
        "query_id", F.col("vec_id").alias("chunk_id")
    )
    results = search.dense_topk(q.where("dense IS NOT NULL"), v, 10)
    scored = metrics.retrieval_metrics(results, expected, 10)
    return scored.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")])
