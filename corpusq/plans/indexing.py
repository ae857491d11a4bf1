"""Table, source, embedding and job queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusq.functions.encoders import hashed_encoder
from corpusq.functions.text import cache_key, slugify
from corpusq.operators import embedding, filters, indexing
from corpusq.plans import tables as t
from corpusq.plans.chunks import sql_markdown
from corpusq.plans.registry import query
from corpusq.session import checkpoint_root
from corpusq.sources import files as source
from corpusq.sources import tables as store

# The earlier snapshot: one source was not there yet, French documents had another
# text, and beside every Spanish one lay a file that is gone now.
SQL_KNOWN = """
known AS (
  SELECT doc_id AS file_id, source AS repository_id, lang || '/' || source || '/' || doc_id || '.md' AS path,
         sha256(CASE WHEN lang = 'fr' THEN text || ' old' ELSE text END) AS content_hash
  FROM documents WHERE source <> 'src7'
  UNION ALL
  SELECT doc_id + 1000000000, source, lang || '/' || source || '/gone' || doc_id || '.md', sha256(text)
  FROM documents WHERE lang = 'es'),
scanned AS (
  SELECT doc_id AS file_id, source AS repository_id, lang || '/' || source || '/' || doc_id || '.md' AS path,
         sha256(text) AS content_hash, text, n_chars
  FROM documents),
changes AS (
  SELECT coalesce(k.repository_id, s.repository_id) AS repository_id, coalesce(k.path, s.path) AS path,
         k.file_id, CASE WHEN k.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'deleted'
                         WHEN k.content_hash = s.content_hash THEN 'unchanged' ELSE 'changed' END AS change
  FROM known k FULL JOIN scanned s ON s.repository_id = k.repository_id AND s.path = k.path)"""


def scanned(spark, sf):
    f = t.files(spark, sf, t.texts(spark, sf))
    return source.content_hash(
        f.select("repository_id", "path", F.col("content").cast("binary").alias("content"), F.col("size_bytes").alias("length"))
    )


def known(spark, sf):
    f = t.files(spark, sf)
    old = F.when(F.col("workspace_id") == "fr", F.concat("content", F.lit(" old"))).otherwise(F.col("content"))
    here = f.where("repository_id <> 'src7'").withColumn("content", old)
    gone = f.where("workspace_id = 'es'").select(
        (F.col("file_id") + 1000000000).alias("file_id"), "repository_id", "workspace_id",
        F.concat_ws("/", "workspace_id", "repository_id", F.concat(F.lit("gone"), F.col("file_id").cast("string"), F.lit(".md"))).alias("path"),
        "content", "size_bytes",
    )
    return source.content_hash(here.unionByName(gone))


@query("s1_scan_corpus")
def scan(spark, sf):
    """The folder of the given tables, seen as a corpus of files."""
    return source.scan_corpus(spark, sf).select("path", "length")


RULES = ["# noise", "fr/", "*7.md", "!de/**/*7.md", "/es/src1/", "en/src[23]/?.md"]


@query(
    "s2_apply_ignore_rules",
    f"""WITH {t.SQL_FILES}
SELECT file_id, path FROM files
WHERE NOT CASE
  WHEN regexp_matches(path, '^en/src[23]/[^/][.]md$') THEN true
  WHEN starts_with(path, 'es/src1/') THEN true
  WHEN starts_with(path, 'de/') AND path LIKE '%7.md' THEN false
  WHEN path LIKE '%7.md' THEN true
  WHEN starts_with(path, 'fr/') THEN true
  ELSE false END""",
)
def ignore(spark, sf):
    return source.apply_ignore_rules(t.files(spark, sf), RULES).select("file_id", "path")


@query(
    "s3_decode_text",
    "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE lang <> 'de'",
)
def decode(spark, sf):
    """German documents end in a byte that no UTF-8 text holds."""
    raw = t.documents(spark, sf).select(
        "doc_id",
        F.when(F.col("lang") == "de", F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF"))))
        .otherwise(F.col("text").cast("binary"))
        .alias("content"),
    )
    return source.decode_text(raw).select("doc_id", F.md5("content").alias("text_md5"))


@query("s4_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def hashes(spark, sf):
    return source.content_hash(t.documents(spark, sf), "text").select("doc_id", "content_hash")


@query(
    "s6_append_chunks",
    "SELECT doc_id AS chunk_id, source AS repository_id, md5(text) AS text_md5 FROM documents",
)
def append(spark, sf):
    path = f"{checkpoint_root(spark)}/append-{uuid.uuid4().hex}"
    store.append_chunks(t.chunks(spark, sf), path)
    return spark.read.parquet(path).select(
        "chunk_id", F.col("repository_id").cast("string").alias("repository_id"), F.md5("content").alias("text_md5")
    )


@query(
    "s7_upsert_files",
    f"""WITH {SQL_KNOWN}
SELECT coalesce(k.file_id, s.file_id) AS file_id, coalesce(k.path, s.path) AS path,
       coalesce(s.content_hash, k.content_hash) AS content_hash
FROM known k FULL JOIN scanned s ON s.repository_id = k.repository_id AND s.path = k.path""",
)
def upsert_files(spark, sf):
    columns = ["file_id", "repository_id", "path", "content_hash"]
    incoming = source.content_hash(t.files(spark, sf)).select(*columns)
    return store.upsert_files(known(spark, sf).select(*columns), incoming).drop("repository_id")


@query(
    "s8_upsert_vectors",
    """SELECT vec_id AS chunk_id, 'new' AS state, label FROM embeddings WHERE label < 5
UNION ALL SELECT vec_id, 'old', label FROM embeddings WHERE label >= 5
UNION ALL SELECT vec_id + 1000000, 'new', label FROM embeddings WHERE label = 0""",
)
def upsert_vectors(spark, sf):
    e = t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.lit("main").alias("workspace_id"), "label", F.lit("old").alias("state")
    )
    again = e.where("label < 5").withColumn("state", F.lit("new"))
    added = e.where("label = 0").withColumn("chunk_id", F.col("chunk_id") + 1000000).withColumn("state", F.lit("new"))
    return store.upsert_vectors(e, again.unionByName(added), "main").select("chunk_id", "state", "label")


@query(
    "s9_delete_by_filter",
    "SELECT doc_id AS file_id, lang AS workspace_id FROM documents WHERE NOT (lang = 'en' AND source = 'src4')",
)
def delete(spark, sf):
    return store.delete_by_filter(t.files(spark, sf), "en", "src4").select("file_id", "workspace_id")


@query(
    "s10_delete_cascade",
    """SELECT kind, doc_id AS id FROM documents, (VALUES ('file'), ('chunk')) k(kind)
WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING count(*) < 50)""",
)
def cascade(spark, sf):
    """Repositories of fewer than fifty files go."""
    f, c = t.files(spark, sf), t.chunks(spark, sf)
    small = f.groupBy("repository_id").count().where("count < 50")
    left = store.delete_cascade(small, files=f, chunks=c)
    return left["files"].select(F.lit("file").alias("kind"), F.col("file_id").alias("id")).unionByName(
        left["chunks"].select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    )


@query(
    "s11_versions",
    "SELECT doc_id AS chunk_id, '2,3,10' AS versions, 'v3' AS generation FROM documents",
)
def versions(spark, sf):
    v = store.VersionedTable(
        spark, f"vectors_{uuid.uuid4().hex[:8]}", f"{checkpoint_root(spark)}/versions-{uuid.uuid4().hex}"
    )
    base = t.documents(spark, sf).select(F.col("doc_id").alias("chunk_id"))
    for n in (2, 3, 10):
        v.write(base.withColumn("generation", F.lit(f"v{n}")), n)
        if n < 10:
            v.activate(n)
    listed = ",".join(str(n) for n in v.versions())
    return v.active().withColumn("versions", F.lit(listed))


SQL_CACHE = """
keyed AS (
  SELECT doc_id, lang, source, text, plain, sha256(plain) AS cache_key FROM (
    SELECT doc_id, lang, source, text, 'model:' || regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS plain
    FROM documents)),
cache AS (
  SELECT cache_key, doc_id AS written, source <> 'src3' AS live,
         row_number() OVER (PARTITION BY cache_key ORDER BY doc_id DESC) AS n
  FROM keyed WHERE lang <> 'en')"""


def _cache(spark, sf):
    """All but the English documents were embedded, at a time given by their number;
    the entries of one source are past their time."""
    d = t.texts(spark, sf).where("lang <> 'en'")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    return d.select(
        cache_key(F.col("text"), "model").alias("cache_key"),
        "doc_id",
        at.alias("written_at"),
        F.when(F.col("source") == "src3", at).otherwise(F.lit("2100-01-01").cast("timestamp")).alias("expires_at"),
    )


def _now():
    return F.lit("2050-01-01").cast("timestamp")


@query(
    "s12_read_cache",
    f"WITH {SQL_CACHE} SELECT cache_key, written AS doc_id FROM cache WHERE n = 1 AND live",
)
def read_cache(spark, sf):
    keys = t.texts(spark, sf).select(cache_key(F.col("text"), "model").alias("cache_key"))
    return store.read_cache(keys, _cache(spark, sf), _now()).select("cache_key", "doc_id")


@query(
    "e1_plan_batch",
    f"""WITH {SQL_CACHE} SELECT doc_id, cache_key,
  cache_key IN (SELECT cache_key FROM cache WHERE n = 1 AND live) AS hit FROM keyed""",
)
def plan_batch(spark, sf):
    d = t.texts(spark, sf).select("doc_id", "text")
    return embedding.plan_batch(d, _cache(spark, sf), "model", _now()).select("doc_id", "cache_key", "hit")


def _sql_encoded() -> str:
    return (
        t.sql_weights("documents", "doc_id", "text", "term_weights")
        + """,
hashed AS (SELECT doc_id, weight, ('0x' || left(md5(term), 15))::BIGINT AS h FROM term_weights),
places AS (
  SELECT doc_id, h % 64 AS place, sum(CASE WHEN (h // 64) % 2 = 1 THEN weight ELSE -weight END) AS x
  FROM hashed GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM places GROUP BY doc_id),
encoded AS (
  SELECT d.doc_id, coalesce(round((x / norm)::FLOAT::DOUBLE, 6), 0) AS first,
         (SELECT count(*) FROM hashed w WHERE w.doc_id = d.doc_id)::INTEGER AS terms
  FROM documents d LEFT JOIN norms USING (doc_id) LEFT JOIN places p ON p.doc_id = d.doc_id AND place = 0)"""
    )


@query(
    "e1_embed_batch",
    f"""WITH {SQL_CACHE},{_sql_encoded()}
SELECT doc_id, sha256('hashed-64:' || substr(plain, 7)) AS cache_key, first, terms, 'hashed-64' AS model_id
FROM keyed JOIN encoded USING (doc_id)""",
)
def embed(spark, sf):
    d = t.texts(spark, sf).select("doc_id", "text")
    empty = spark.createDataFrame([], indexing.CACHE)
    rows, _ = embedding.embed_batch(d, hashed_encoder(), empty, "hashed-64")
    return rows.select(
        "doc_id", "cache_key", _first("dense"), F.size("sparse.ids").alias("terms"), "model_id"
    )


def _first(dense: str):
    return F.round(F.get(dense, F.lit(0)).cast("double"), 6).alias("first")


@query("e2_encode", f"WITH {_sql_encoded()} SELECT doc_id, first, terms, 'hashed-64' AS model_id FROM encoded")
def encode(spark, sf):
    d = t.texts(spark, sf).select("doc_id", "text")
    rows = embedding.encode(d, hashed_encoder(), "hashed-64")
    return rows.select("doc_id", _first("dense"), F.size("sparse.ids").alias("terms"), "model_id")


@query(
    "e3_cache_stats",
    """SELECT event_type AS cache, sum((value > 10)::INT)::BIGINT AS hits, sum((NOT value > 10)::INT)::BIGINT AS misses,
       round(avg((value > 10)::INT), 6) AS hit_ratio FROM events GROUP BY event_type""",
)
def cache_stats(spark, sf):
    log = t.table(spark, sf, "events").select(F.col("event_type").alias("cache"), (F.col("value") > 10).alias("hit"))
    return embedding.cache_stats(log).withColumn("hit_ratio", F.round("hit_ratio", 6))


@query(
    "s13_parse_progress",
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'done' ELSE 'progress' END AS kind,
  CASE WHEN event_type <> 'purchase' THEN event_type END AS stage,
  CASE WHEN event_type <> 'purchase' AND user_id % 2 = 0 THEN (props->>'k')::DOUBLE END AS percent FROM events""",
)
def progress(spark, sf):
    return store.parse_progress(progress_messages(spark, sf)).select("event_id", "kind", "stage", "percent")


def progress_messages(spark, sf):
    """Events as raw progress messages: purchase ends a job, the percent is optional."""
    e = t.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    data = F.when(
        F.col("event_type") == "purchase", F.to_json(F.struct(F.lit("done").alias("event")))
    ).otherwise(
        F.to_json(
            F.struct(
                F.col("event_type").alias("stage"),
                F.when(F.col("user_id") % 2 == 0, k).alias("percent"),
                F.col("props").alias("message"),
            )
        )
    )
    return e.select("event_id", F.col("user_id").alias("job_id"), "ts", data.alias("data"))


@query(
    "s14_check_corpus_size",
    """WITH big AS (SELECT source FROM documents GROUP BY source HAVING sum(n_chars) > 1048576 / 8)
SELECT doc_id AS file_id, source AS repository_id FROM documents WHERE source NOT IN (SELECT source FROM big)""",
)
def corpus_size(spark, sf):
    accepted, _ = source.check_corpus_size(t.files(spark, sf), max_mb=1 / 8, size="size_bytes")
    return accepted.select("file_id", "repository_id")


# --- scalar functions -----------------------------------------------------------------

EXTENSIONS = ["py", "jsx", "ts", "go", "java", "MD", "PY", "x"]


@query(
    "f4_detect_language",
    """WITH named AS (
  SELECT doc_id, doc_id % 9 AS k, 'a.b/f' || doc_id || ['.py', '.jsx', '.ts', '.go', '.java', '.MD', '.PY', '.x', ''][1 + doc_id % 9] AS path,
         doc_id % 4 AS s FROM documents)
SELECT doc_id, CASE WHEN k = 0 THEN 'python' WHEN k = 1 THEN 'javascript' WHEN k = 2 THEN 'typescript' WHEN k = 3 THEN 'go'
  WHEN k = 4 THEN 'java' WHEN k = 5 THEN 'markdown' WHEN s = 0 THEN 'python' WHEN s = 1 THEN 'javascript' END AS language
FROM named""",
)
def language(spark, sf):
    endings = F.array(*[F.lit(f".{e}") for e in EXTENSIONS], F.lit(""))
    heads = F.array(
        F.lit("#!/usr/bin/env python3\n"), F.lit("#! /opt/node --flag\n"), F.lit("#!/bin/sh\n"), F.lit("")
    )
    named = t.documents(spark, sf).select(
        "doc_id",
        F.concat(F.lit("a.b/f"), F.col("doc_id").cast("string"), F.get(endings, (F.col("doc_id") % 9).cast("int"))).alias("path"),
        F.concat(F.get(heads, (F.col("doc_id") % 4).cast("int")), F.col("text")).alias("content"),
    )
    return source.detect_language(named).select("doc_id", "language")


@query(
    "f5_validate_repo_url",
    """WITH forms AS (
  SELECT page_id, CASE page_id % 7
    WHEN 0 THEN url WHEN 1 THEN 'https' || substr(url, strpos(url, ':'))
    WHEN 2 THEN 'https://me:pw@host/x' || page_id WHEN 3 THEN 'https://me@host/x' || page_id
    WHEN 4 THEN 'ssh://git@host:22/x' || page_id WHEN 5 THEN 'https://host:6379/x' || page_id
    ELSE 'https:///x' || page_id END AS url
  FROM pages)
SELECT page_id, CASE WHEN page_id % 7 = 0 AND NOT starts_with(url, 'https:') THEN 'scheme'
  WHEN page_id % 7 = 2 THEN 'password' WHEN page_id % 7 = 3 THEN 'username'
  WHEN page_id % 7 = 5 THEN 'port' WHEN page_id % 7 = 6 THEN 'host' END AS problem FROM forms""",
)
def repo_url(spark, sf):
    k, number = F.col("page_id") % 7, F.col("page_id").cast("string")
    url = (
        F.when(k == 0, F.col("url"))
        .when(k == 1, F.concat(F.lit("https"), F.expr("substr(url, instr(url, ':'))")))
        .when(k == 2, F.concat(F.lit("https://me:pw@host/x"), number))
        .when(k == 3, F.concat(F.lit("https://me@host/x"), number))
        .when(k == 4, F.concat(F.lit("ssh://git@host:22/x"), number))
        .when(k == 5, F.concat(F.lit("https://host:6379/x"), number))
        .otherwise(F.concat(F.lit("https:///x"), number))
    )
    p = t.table(spark, sf, "pages").withColumn("url", url)
    return filters.validate_repo_url(p).select("page_id", "problem")


def _ip_sql() -> str:
    cases = ""
    for network, prefix, flag in filters.IPV4_BLOCKS:
        low = sum(int(o) << s for o, s in zip(network.split("."), (24, 16, 8, 0), strict=True))
        cases += f" WHEN n BETWEEN {low} AND {low + 2 ** (32 - prefix) - 1} THEN '{flag}'"
    return cases


@query(
    "f6_classify_ip",
    f"""WITH ips AS (
  SELECT event_id, [10, 127, 169, 172, 192, 198, 203, 224, 8, 0, 255, 100][1 + event_id % 12]::BIGINT AS a,
         [168, 254, 16, 0, 51, 18, 7][1 + event_id % 7]::BIGINT AS b, event_id % 256 AS c, user_id % 256 AS d FROM events),
numbers AS (SELECT *, ((a * 256 + b) * 256 + c) * 256 + d AS n FROM ips)
SELECT event_id, CASE {_ip_sql()} ELSE 'public' END AS ip_class FROM numbers""",
)
def ip_class(spark, sf):
    first = F.array(*[F.lit(x) for x in (10, 127, 169, 172, 192, 198, 203, 224, 8, 0, 255, 100)])
    second = F.array(*[F.lit(x) for x in (168, 254, 16, 0, 51, 18, 7)])
    e = t.table(spark, sf, "events").select(
        "event_id",
        F.concat_ws(
            ".",
            F.get(first, (F.col("event_id") % 12).cast("int")).cast("string"),
            F.get(second, (F.col("event_id") % 7).cast("int")).cast("string"),
            (F.col("event_id") % 256).cast("string"),
            (F.col("user_id") % 256).cast("string"),
        ).alias("ip"),
    )
    return filters.classify_ip(e).select("event_id", "ip_class")


@query(
    "f7_slugify",
    """SELECT doc_id, md5(coalesce(nullif(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'workspace')) AS slug_md5
FROM documents""",
)
def slug(spark, sf):
    return t.documents(spark, sf).select("doc_id", F.md5(slugify(F.col("text"))).alias("slug_md5"))


@query(
    "f8_find_conflicts",
    """SELECT doc_id, h AS content_hash, copies FROM (
  SELECT doc_id, md5(text) AS h, count(*) OVER (PARTITION BY lang, md5(text)) AS copies FROM documents) WHERE copies > 1""",
)
def conflicts(spark, sf):
    d = t.documents(spark, sf).select("doc_id", "lang", F.md5("text").alias("content_hash"))
    return filters.find_conflicts(d, "lang", "content_hash").select("doc_id", "content_hash", "copies")


@query(
    "f9_redact_fields",
    """SELECT event_id, '***REDACTED***' AS token, event_type AS kind, '***REDACTED***' AS nested_secret,
  value AS nested_value, '***REDACTED***' AS map_token, props AS map_other FROM events""",
)
def redact(spark, sf):
    e = t.table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("Token"),
        F.col("event_type").alias("kind"),
        F.array(F.struct(F.col("props").alias("SECRET"), "value")).alias("nested"),
        F.create_map(F.lit("access_TOKEN"), F.col("props"), F.lit("other"), F.col("props")).alias("extra"),
    )
    r = filters.redact_fields(e)
    return r.select(
        "event_id",
        F.col("Token").alias("token"),
        "kind",
        F.col("nested")[0]["SECRET"].alias("nested_secret"),
        F.col("nested")[0]["value"].alias("nested_value"),
        F.col("extra")["access_TOKEN"].alias("map_token"),
        F.col("extra")["other"].alias("map_other"),
    )


@query(
    "f12_cache_key",
    f"WITH {SQL_CACHE} SELECT doc_id, cache_key FROM keyed",
)
def keys(spark, sf):
    return t.texts(spark, sf).select("doc_id", cache_key(F.col("text"), "model").alias("cache_key"))


@query(
    "f14_validate_dense",
    """SELECT vec_id, CASE WHEN label = 3 THEN 'dimension' WHEN label = 4 THEN 'not finite' END AS dense_problem FROM embeddings""",
)
def dense(spark, sf):
    """Vectors of two labels are damaged first: one value missing, one value not a number."""
    e = t.table(spark, sf, "embeddings").withColumn(
        "dense",
        F.when(F.col("label") == 3, F.slice("embedding", 1, 63))
        .when(F.col("label") == 4, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float"))))
        .otherwise(F.col("embedding")),
    )
    return filters.validate_dense(e, 64, strict=False).select("vec_id", "dense_problem")


# --- jobs -----------------------------------------------------------------------------


@query("j1_detect_changes", f"WITH {SQL_KNOWN} SELECT repository_id, path, change FROM changes")
def changes(spark, sf):
    return indexing.detect_changes(known(spark, sf), scanned(spark, sf)).select("repository_id", "path", "change")


@query(
    "j2_supersede",
    f"""WITH {SQL_KNOWN} SELECT k.file_id, coalesce(c.change = 'unchanged', true) AS is_active
FROM known k LEFT JOIN changes c ON c.file_id = k.file_id""",
)
def supersede(spark, sf):
    k = known(spark, sf)
    gone = indexing.detect_changes(k, scanned(spark, sf)).where("change IN ('changed', 'deleted')")
    return indexing.supersede(k.select("file_id", F.lit(True).alias("is_active")), gone)


@query(
    "j3_isolate_failures",
    """SELECT conv_id AS file_id, turn FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def isolate(spark, sf):
    """Conversations as files; one with a system turn fails as a whole."""
    rows = t.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("file_id"), "turn", F.when(F.col("role") == "system", F.lit("refused")).alias("error")
    )
    return indexing.isolate_failures(rows)[0]


@query(
    "j4_job_progress",
    """SELECT source AS job_id, count(*) AS files_total, sum((lang <> 'fr')::INT)::BIGINT AS files_processed,
  sum(CASE WHEN lang <> 'fr' THEN n_chars // 100 ELSE 0 END)::BIGINT AS chunks_total FROM documents GROUP BY source""",
)
def job_progress(spark, sf):
    rows = t.documents(spark, sf).select(
        F.col("source").alias("job_id"),
        F.when(F.col("lang") == "fr", F.lit("pending")).otherwise(F.lit("done")).alias("status"),
        F.when(F.col("lang") != "fr", F.floor(F.col("n_chars") / 100)).alias("chunks"),
    )
    return indexing.job_progress(rows)


def _jobs(spark, sf):
    return t.table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("repository_id"),
        F.col("ts").alias("created_at"), "event_type",
    )


@query(
    "j5_job_history",
    """SELECT event_id AS job_id, user_id AS repository_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""",
)
def job_history(spark, sf):
    return indexing.job_history(_jobs(spark, sf), latest_only=True).select("job_id", "repository_id")


@query(
    "j6_job_outcome",
    """SELECT event_id AS job_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN event_type = 'error' THEN 'lost' END AS error_message,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ready' END AS repository_status,
  CASE WHEN event_type = 'error' THEN 'before' ELSE 'now' END AS last_indexed_commit_sha FROM events""",
)
def job_outcome(spark, sf):
    jobs = _jobs(spark, sf).select(
        "job_id", F.lit("embedding").alias("status"), F.lit("now").alias("commit_sha"),
        F.lit("before").alias("last_indexed_commit_sha"),
    )
    errors = _jobs(spark, sf).where("event_type = 'error'").select("job_id", F.lit("lost").alias("error"))
    return indexing.job_outcome(jobs, errors).drop("commit_sha")


@query(
    "j7_index_corpus",
    f"""WITH RECURSIVE {SQL_KNOWN},
md AS (SELECT path AS file_id, text FROM scanned),
{sql_markdown("dummy AS (SELECT 1)", 128, 32).strip().lstrip(",")},
counts AS (SELECT file_id AS path, count(*) AS chunks FROM markdown_chunks GROUP BY 1)
SELECT repository_id, path, change AS status,
       CASE WHEN change IN ('new', 'changed') THEN coalesce(chunks, 0) ELSE 0 END AS chunks
FROM changes LEFT JOIN counts USING (path)""",
)
def index_corpus(spark, sf):
    """One run over all documents against the earlier snapshot."""
    empty = indexing.empty_tables(spark)
    before = known(spark, sf).select(
        F.col("file_id").cast("string").alias("file_id"), "repository_id", "path",
        F.lit("markdown").alias("language"), "size_bytes", "content_hash", F.lit(False).alias("is_deleted"),
    )
    empty.files = before
    _, results = indexing.index_files(
        scanned(spark, sf).drop("content_hash"), empty, hashed_encoder(), "hashed-64", F.lit("main"),
        max_tokens=128, min_tokens=32,
    )
    return results.select("repository_id", "path", "status", F.col("chunks").cast("long").alias("chunks"))


def _one_run(rows, tables, repositories):
    return indexing.index_files(
        rows, tables, hashed_encoder(), "hashed-64", F.lit("main"), repositories=repositories,
        max_tokens=128, min_tokens=32,
    )


@query(
    "j7_two_repositories",
    """WITH halves AS (SELECT *, md5(source) < '8' AS first, lang || '/' || source || '/' || doc_id || '.md' AS path FROM documents)
SELECT source AS repository_id, path, first OR lang <> 'en' AS is_live,
       CASE WHEN NOT first AND lang = 'en' THEN 'deleted' WHEN NOT first THEN 'unchanged' END AS status
FROM halves""",
)
def two_repositories(spark, sf):
    """Half of all repositories, then the other half; then these again without their English files."""
    files = scanned(spark, sf).drop("content_hash")
    first = F.md5("repository_id") < "8"
    tables = indexing.empty_tables(spark)
    for half in (first, ~first):
        tables, _ = _one_run(files.where(half), tables, None)
    left = [r[0] for r in files.where(~first).select("repository_id").distinct().collect()]
    tables, results = _one_run(files.where(~first & ~F.startswith("path", F.lit("en/"))), tables, left)
    return tables.files.select("repository_id", "path", (~F.col("is_deleted")).alias("is_live")).join(
        results.select("repository_id", "path", "status"), ["repository_id", "path"], "left"
    )


@query(
    "j7_failed_reads",
    """SELECT source AS repository_id, lang || '/' || source || '/' || doc_id || '.md' AS path,
       CASE WHEN lang = 'de' THEN 'failed' WHEN doc_id % 5 = 0 THEN 'failed'
            WHEN lang = 'es' THEN 'deleted' ELSE 'unchanged' END AS status,
       lang <> 'es' OR doc_id % 5 = 0 AS is_live FROM documents""",
)
def failed_reads(spark, sf):
    """A second scan cannot list the German folders nor read some files, and misses the Spanish ones."""
    files = scanned(spark, sf).drop("content_hash")
    tables, _ = _one_run(files, indexing.empty_tables(spark), None)
    number = F.regexp_extract("path", r"/(\d+)\.md$", 1).cast("long")
    again = files.where("NOT startswith(path, 'de/') AND (NOT startswith(path, 'es/') OR " + "cast(regexp_extract(path, '/([0-9]+)[.]md$', 1) as long) % 5 = 0)")
    unread = F.when(number % 5 == 0, F.lit("cannot be read"))
    again = again.withColumn("problem", unread).withColumn("is_dir", F.lit(False))
    folders = files.where("startswith(path, 'de/')").select("repository_id").distinct().select(
        "repository_id", F.concat(F.lit("de/"), "repository_id").alias("path"), F.lit(None).cast("binary").alias("content"),
        F.lit(0).cast("long").alias("length"), F.lit("cannot be listed").alias("problem"), F.lit(True).alias("is_dir"),
    )
    tables, results = _one_run(again.unionByName(folders), tables, None)
    return tables.files.select("repository_id", "path", (~F.col("is_deleted")).alias("is_live")).join(
        results.select("repository_id", "path", "status"), ["repository_id", "path"]
    )


@query(
    "j8_find_orphans",
    """SELECT doc_id AS chunk_id, 'chunk' AS side FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'vector' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""",
)
def orphans(spark, sf):
    v = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return indexing.find_orphans(t.chunks(spark, sf), v)


@query(
    "j9_purge_inactive",
    "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0",
)
def purge(spark, sf):
    d = t.documents(spark, sf).select("doc_id").join(t.table(spark, sf, "labels"), "doc_id", "left")
    return indexing.purge_inactive(
        d.withColumn("is_active", F.coalesce("toxic", F.lit(0)) == 0)
    ).select("doc_id")


@query(
    "j10_list_by_parent",
    "SELECT doc_id AS file_id, source AS repository_id FROM documents WHERE source IN (SELECT source FROM documents WHERE n_chars > 20000)",
)
def children(spark, sf):
    f = t.files(spark, sf)
    parents = f.where("size_bytes > 20000").select("repository_id").distinct()
    return indexing.list_by_parent(f, "repository_id", parents).select("file_id", "repository_id")
