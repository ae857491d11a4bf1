"""Search queries: dense, sparse, fusion, hydration, reranking, scopes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusq.functions.text import lexical_weights, rerank_text, sparse_vector
from corpusq.operators import filters, search
from corpusq.plans import tables as t
from corpusq.plans.registry import query
from corpusq.session import checkpoint_root, inline_rows


def _round6(df):
    return df.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


def _parts(spark, sf):
    return t.search_queries(spark, sf), t.vectors(spark, sf), t.chunks(spark, sf), t.files(spark, sf)


@query(
    "r1_dense_topk",
    f"WITH {t.SQL_QUERIES},{t.SQL_DENSE} SELECT query_id, chunk_id, score, rank FROM dense_ranked WHERE rank <= 40",
)
def dense_topk(spark, sf):
    q, v, _, _ = _parts(spark, sf)
    return _round6(search.dense_topk(q.where("dense IS NOT NULL"), v))


@query(
    "r2_sparse_topk",
    f"WITH {t.SQL_QUERIES},{t.SQL_SPARSE} SELECT query_id, chunk_id, score, rank FROM sparse_ranked WHERE rank <= 40",
)
def sparse_topk(spark, sf):
    q, v, _, _ = _parts(spark, sf)
    return _round6(search.sparse_topk(q, v))


@query(
    "e4_lexical_weights",
    "WITH "
    + t.sql_weights("documents", "doc_id", "text", "w")
    + " SELECT doc_id, term, round(weight, 6) AS weight FROM w",
)
def weights(spark, sf):
    return (
        inline_rows(t.texts(spark, sf), ["doc_id"], lexical_weights(F.col("text")), "term")
        .withColumn("weight", F.round("weight", 6))
    )


@query(
    "r3_rrf",
    f"WITH {t.SQL_HYBRID} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM fused",
)
def rrf(spark, sf):
    q, v, _, _ = _parts(spark, sf)
    return _round6(
        search.rrf(
            [search.dense_topk(q.where("dense IS NOT NULL"), v), search.sparse_topk(q, v)]
        )
    )


@query(
    "r4_hydrate",
    f"""WITH {t.SQL_HYBRID},{t.SQL_HITS}
SELECT query_id, chunk_id, file_path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line,
       round(score, 6) AS score, 'fused' AS source, md5(text) AS text_md5, rank FROM hits""",
)
def hydrate(spark, sf):
    hits = search.fused_hits(*_parts(spark, sf))
    return _round6(hits).select(
        "query_id",
        "chunk_id",
        "file_path",
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        "score",
        "source",
        F.md5("text").alias("text_md5"),
        "rank",
    )


def _stored_chunks(spark, sf):
    """All chunks, published in buckets by their id."""
    stored = search.open_chunks(spark, f"{checkpoint_root(spark)}/chunks-{uuid.uuid4().hex}", "long", 32)
    paths = t.files(spark, sf).select("file_id", F.col("path").alias("file_path"))
    rows = t.chunks(spark, sf).join(paths, "file_id").withColumn("is_active", F.lit(True))
    stored.publish(stored.snapshot(), "first", {"chunks": stored.write("chunks", rows, "first")})
    return stored


@query(
    "r4_hydrate_stored",
    f"""WITH {t.SQL_HYBRID},{t.SQL_HITS}
SELECT query_id, chunk_id, file_path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line,
       round(score, 6) AS score, 'fused' AS source, md5(text) AS text_md5, rank FROM hits""",
)
def hydrate_stored(spark, sf):
    q, v, _, _ = _parts(spark, sf)
    hits = search.hydrate_stored(search.fused(q, v, 40, 50), _stored_chunks(spark, sf))
    return _round6(hits).select(
        "query_id", "chunk_id", "file_path", *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")],
        "score", "source", F.md5("text").alias("text_md5"), "rank",
    )


@query(
    "r6_hybrid_search_stored",
    f"""WITH {t.SQL_HYBRID},{t.SQL_HITS},{t.SQL_RERANKED}
SELECT query_id, chunk_id, file_path, score, 'reranked' AS source, rank FROM reranked WHERE rank <= 10""",
)
def hybrid_stored(spark, sf):
    q, v, _, _ = _parts(spark, sf)
    return _round6(search.hybrid_search_stored(q, v, _stored_chunks(spark, sf))).select(*SEARCH_COLUMNS)


SEARCH_COLUMNS = ["query_id", "chunk_id", "file_path", "score", "source", "rank"]


@query(
    "r5_rerank",
    f"""WITH {t.SQL_HYBRID},{t.SQL_HITS},{t.SQL_RERANKED}
SELECT query_id, chunk_id, file_path, score, 'reranked' AS source, rank FROM reranked""",
)
def rerank(spark, sf):
    q, v, c, f = _parts(spark, sf)
    return _round6(search.rerank(search.fused_hits(q, v, c, f), q)).select(*SEARCH_COLUMNS)


@query(
    "u2_scorer_fails_open",
    f"""WITH {t.SQL_HYBRID},{t.SQL_HITS},
judged AS (
  SELECT h.query_id, chunk_id, h.rank AS place, round(score, 6) AS fused, length(query_text) % 2 = 1 AS refused, (length(text) % 97) / 97 AS told
  FROM hits h JOIN queries q USING (query_id))
SELECT query_id, chunk_id, CASE WHEN refused THEN fused ELSE round(told, 6) END AS score,
       CASE WHEN refused THEN 'fused' ELSE 'reranked' END AS source,
       row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN refused THEN 0 ELSE -told END, place) AS rank FROM judged""",
)
def scorer_fails_open(spark, sf):
    """A scorer of the caller's that refuses every query of odd length: those keep their fused order."""

    def scorer(queries, texts):
        if any(len(q) % 2 for q in queries):
            raise ValueError("refused")
        return [(len(x) % 97) / 97 for x in texts]

    q, v, c, f = _parts(spark, sf)
    return _round6(search.rerank(search.fused_hits(q, v, c, f), q, scorer)).select("query_id", "chunk_id", "score", "source", "rank")


@query(
    "r6_hybrid_search",
    f"""WITH {t.SQL_HYBRID},{t.SQL_HITS},{t.SQL_RERANKED}
SELECT query_id, chunk_id, file_path, score, 'reranked' AS source, rank FROM reranked WHERE rank <= 10""",
)
def hybrid(spark, sf):
    return _round6(search.hybrid_search(*_parts(spark, sf))).select(*SEARCH_COLUMNS)


@query(
    "r7_hybrid_search_no_rerank",
    f"""WITH {t.SQL_HYBRID},{t.SQL_HITS}
SELECT query_id, chunk_id, file_path, round(score, 6) AS score, 'fused' AS source, rank FROM hits WHERE rank <= 10""",
)
def hybrid_fused(spark, sf):
    return _round6(search.hybrid_search_no_rerank(*_parts(spark, sf))).select(*SEARCH_COLUMNS)


# Queries that look for the other workspaces' rare repositories find nothing in the
# first attempt when the cut is narrow, so k1 = k2 = 2 with a path prefix.
_RETRY_SQL = f"""
WITH {t.SQL_QUERIES},{t.SQL_DENSE},{t.SQL_SPARSE},{t.sql_fused(2, "fused1")},{t.sql_fused(8, "fused2")},
prefixed AS (SELECT query_id, workspace_id || '/src1' AS prefix FROM queries),
hits1 AS (
  SELECT f.query_id, f.chunk_id, f.score, f.rank AS fused_rank, 1 AS attempt
  FROM fused1 f JOIN documents d ON d.doc_id = f.chunk_id JOIN prefixed p USING (query_id)
  WHERE f.rank <= 3 AND starts_with(d.lang || '/' || d.source, p.prefix)),
hits2 AS (
  SELECT f.query_id, f.chunk_id, f.score, f.rank AS fused_rank, 2 AS attempt
  FROM fused2 f JOIN documents d ON d.doc_id = f.chunk_id JOIN prefixed p USING (query_id)
  WHERE f.rank <= 12 AND starts_with(d.lang || '/' || d.source, p.prefix)
    AND f.query_id NOT IN (SELECT query_id FROM hits1)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank
  FROM (SELECT * FROM hits1 UNION ALL SELECT * FROM hits2))
SELECT query_id, chunk_id, round(score, 6) AS score, attempt::BIGINT AS attempt, rank FROM ranked WHERE rank <= 10"""


@query("r8_retry_widened", _RETRY_SQL)
def retry(spark, sf):
    q, v, c, f = _parts(spark, sf)
    q = q.withColumn("path_prefix", F.concat("workspace_id", F.lit("/src1")))
    found = search.retry_widened(q, v, c, f, max_attempts=2, multiplier=4, k1=2, k2=3)
    return _round6(found).select(
        "query_id", "chunk_id", "score", F.col("attempt").cast("long").alias("attempt"), "rank"
    )


_SCOPE_SQL = f"""
WITH requests AS (
  SELECT DISTINCT lang AS workspace_id, source AS repository_id FROM documents),
queries AS (
  SELECT r.workspace_id || ':' || r.repository_id || ':' || s.scope AS query_id, r.*, s.query_text,
         CASE WHEN s.scope <> 'repository' THEN r.workspace_id || '/' || r.repository_id || '/' END AS prefix
  FROM requests r CROSS JOIN (VALUES
    ('module', 'code and behavior implemented in this module'),
    ('repository', 'overview of the repository''s architecture and main components')) s(scope, query_text)),
{t.sql_weights("documents", "doc_id, lang, source", "text", "doc_terms")},
{t.sql_weights("queries", "query_id, workspace_id, repository_id", "query_text", "query_terms")},
sparse_scores AS (
  SELECT query_id, doc_id AS chunk_id, round(sum(q.weight * d.weight), 6) AS score
  FROM query_terms q JOIN doc_terms d
    ON d.term = q.term AND d.lang = q.workspace_id AND d.source = q.repository_id
  GROUP BY ALL),
sparse_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sparse_scores),
fused AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS score, rank FROM sparse_ranked WHERE rank <= 40),
{t.SQL_HITS},{t.SQL_RERANKED}
SELECT query_id, chunk_id, file_path, score, rank FROM reranked WHERE rank <= 20"""


@query("r9_scoped_search", _SCOPE_SQL)
def scoped(spark, sf):
    """Documentation requests for every repository, as a module and as a whole.

    Query texts are fixed words, so only the sparse side has a vector here.
    """
    v, c, f = t.vectors(spark, sf), t.chunks(spark, sf), t.files(spark, sf)
    pairs = t.documents(spark, sf).select(
        F.col("lang").alias("workspace_id"), F.col("source").alias("repository_id")
    ).distinct()
    requests = pairs.withColumn(
        "scope", F.explode(F.array(F.lit("module"), F.lit("repository")))
    ).withColumn("path", F.concat_ws("/", "workspace_id", "repository_id", F.lit("")))
    q = search.scoped_queries(requests).select(
        F.concat_ws(":", "workspace_id", "repository_id", "scope").alias("query_id"),
        "workspace_id",
        "repository_id",
        "query_text",
        "path_prefix",
        F.lit(None).cast("array<float>").alias("dense"),
        sparse_vector(F.col("query_text")).alias("sparse"),
    )
    return _round6(search.hybrid_search(q, v, c, f, n=20)).select(
        "query_id", "chunk_id", "file_path", "score", "rank"
    )


@query(
    "f3_path_prefix_filter",
    f"""WITH {t.SQL_HYBRID},{t.SQL_HITS}
SELECT query_id, chunk_id, file_path, rank FROM hits h JOIN queries q USING (query_id)
WHERE starts_with(file_path, workspace_id || '/src1')""",
)
def path_prefix(spark, sf):
    q, v, c, f = _parts(spark, sf)
    q = q.withColumn("path_prefix", F.concat("workspace_id", F.lit("/src1")))
    return _round6(search.fused_hits(q, v, c, f)).select("query_id", "chunk_id", "file_path", "rank")


@query(
    "f15_format_hits",
    f"""WITH {t.SQL_HYBRID},{t.SQL_HITS},{t.SQL_RERANKED},
listed AS (
  SELECT query_id, string_agg(printf('%s:%d-%d (score=%.3f)', file_path, start_line, end_line, score),
                              chr(10) ORDER BY rank) AS listing
  FROM reranked WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, coalesce(listing, 'No results found for: ' || query_text) AS listing
FROM queries LEFT JOIN listed USING (query_id)""",
)
def listing(spark, sf):
    q, v, c, f = _parts(spark, sf)
    return search.format_hits(search.hybrid_search(q, v, c, f), q)


@query(
    "f13_rerank_text",
    "SELECT doc_id, md5(substr(text, 1, 2048)) AS cut_md5, length(substr(text, 1, 2048))::BIGINT AS cut_chars FROM documents",
)
def cut_text(spark, sf):
    cut = rerank_text(F.col("text"))
    return t.documents(spark, sf).select(
        "doc_id", F.md5(cut).alias("cut_md5"), F.length(cut).cast("long").alias("cut_chars")
    )


_ATTRIBUTES_SQL = """
attributed AS (
  SELECT d.doc_id AS chunk_id, lang AS workspace_id, source AS repository_id, doc_id AS file_id,
         coalesce(toxic, 0) = 0 AS is_active, 'v' || coalesce(quality, 1) AS embedding_version,
         'markdown' AS language, 'markdown_section' AS symbol_kind
  FROM documents d LEFT JOIN labels USING (doc_id))"""


def _attributed(spark, sf):
    d = t.documents(spark, sf).select("doc_id", "lang", "source")
    return d.join(t.table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("lang").alias("workspace_id"),
        F.col("source").alias("repository_id"),
        F.col("doc_id").alias("file_id"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("is_active"),
        F.concat(F.lit("v"), F.coalesce("quality", F.lit(1)).cast("string")).alias("embedding_version"),
        F.lit("markdown").alias("language"),
        F.lit("markdown_section").alias("symbol_kind"),
    )


@query(
    "f1_tenant_scope",
    f"WITH {_ATTRIBUTES_SQL} SELECT chunk_id, repository_id, is_active FROM attributed WHERE workspace_id = 'en' AND repository_id = 'src3'",
)
def tenant(spark, sf):
    return filters.tenant_scope(_attributed(spark, sf), "en", repository_id="src3").select(
        "chunk_id", "repository_id", "is_active"
    )


@query(
    "f2_retrieval_filter",
    f"""WITH {_ATTRIBUTES_SQL} SELECT chunk_id, workspace_id FROM attributed
WHERE is_active AND embedding_version = 'v1' AND language = 'markdown' AND symbol_kind = 'markdown_section'""",
)
def active_rows(spark, sf):
    return filters.retrieval_filter(
        _attributed(spark, sf), "v1", "markdown", "markdown_section"
    ).select("chunk_id", "workspace_id")


@query(
    "s5_read_by_ids",
    f"""WITH {t.SQL_QUERIES},{t.SQL_DENSE}
SELECT doc_id AS file_id, md5(text) AS text_md5 FROM documents
WHERE doc_id IN (SELECT chunk_id FROM dense_ranked WHERE rank <= 40)""",
)
def by_ids(spark, sf):
    q, v, _, f = _parts(spark, sf)
    hits = search.dense_topk(q.where("dense IS NOT NULL"), v).select(F.col("chunk_id").alias("file_id"))
    return search.read_by_ids(f, hits, "file_id").select("file_id", F.md5("content").alias("text_md5"))
