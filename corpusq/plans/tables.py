"""The engine's tables projected from the given Parquet tables, in Spark and in SQL.

documents     -> files and chunks: workspace = lang, repository = source
embeddings    -> dense vectors of the documents with the same id
benchmark     -> search queries; the dense side is the embedding with the same id
conversations -> messages; events -> request, metric and progress logs
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.text import sparse_vector
from corpusq.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ahead of heavy work on their text."""
    return spread(documents(spark, sf_dir), "doc_id")


def files(spark: SparkSession, sf_dir: str, d: DataFrame | None = None) -> DataFrame:
    d = documents(spark, sf_dir) if d is None else d
    return d.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("repository_id"),
        F.col("lang").alias("workspace_id"),
        F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.col("text").alias("content"),
        F.col("n_chars").alias("size_bytes"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document."""
    f = files(spark, sf_dir)
    return f.select(
        F.col("file_id").alias("chunk_id"),
        "file_id",
        "repository_id",
        "workspace_id",
        F.lit(1).alias("start_line"),
        F.size(F.split("content", "\n")).alias("end_line"),
        F.lit(None).cast("string").alias("symbol_name"),
        "content",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense vectors cover a part of the documents only, as in a half-built index."""
    d = texts(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("lang").alias("workspace_id"),
        F.col("source").alias("repository_id"),
        F.col("embedding").alias("dense"),
        sparse_vector(F.col("text")).alias("sparse"),
    )


# Query items are spread over the workspaces by their number.
WORKSPACES = ["en", "fr", "de", "es"]


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings")
    names = F.array(*[F.lit(w) for w in WORKSPACES])
    return b.join(e, b.item_id == e.vec_id, "left").select(
        F.col("item_id").alias("query_id"),
        F.get(names, (F.col("item_id") % 4).cast("int")).alias("workspace_id"),
        F.col("text").alias("query_text"),
        F.col("embedding").alias("dense"),
        sparse_vector(F.col("text")).alias("sparse"),
    )


# --- the same projections as SQL ----------------------------------------------

SQL_FILES = """
files AS (
  SELECT doc_id AS file_id, source AS repository_id, lang AS workspace_id,
         lang || '/' || source || '/' || doc_id || '.md' AS path,
         text AS content, n_chars AS size_bytes
  FROM documents)"""

SQL_QUERIES = """
queries AS (
  SELECT item_id AS query_id, ['en', 'fr', 'de', 'es'][1 + item_id % 4] AS workspace_id,
         text AS query_text, embedding AS dense
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id)"""


def sql_weights(source: str, key: str, text: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT {key}, term, 1 + ln(count(*)) AS weight
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS term
        FROM {source})
  GROUP BY ALL)"""


SQL_DENSE = """
dense_scores AS (
  SELECT q.query_id, d.doc_id AS chunk_id,
         round(list_dot_product(q.dense::DOUBLE[], e.embedding::DOUBLE[])
               / sqrt(list_dot_product(q.dense::DOUBLE[], q.dense::DOUBLE[]))
               / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) AS score
  FROM queries q
  JOIN documents d ON d.lang = q.workspace_id
  JOIN embeddings e ON e.vec_id = d.doc_id
  WHERE q.dense IS NOT NULL),
dense_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM dense_scores)"""

SQL_SPARSE = (
    sql_weights("documents", "doc_id, lang", "text", "doc_terms")
    + ","
    + sql_weights("queries", "query_id, workspace_id", "query_text", "query_terms")
    + """,
sparse_scores AS (
  SELECT query_id, doc_id AS chunk_id, round(sum(q.weight * d.weight), 6) AS score
  FROM query_terms q JOIN doc_terms d ON d.term = q.term AND d.lang = q.workspace_id
  GROUP BY ALL),
sparse_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM sparse_scores WHERE score > 0)"""
)


def sql_fused(k1: int = 40, name: str = "fused") -> str:
    return f"""
both_{name} AS (
  SELECT query_id, chunk_id, rank, 0 AS list FROM dense_ranked WHERE rank <= {k1}
  UNION ALL
  SELECT query_id, chunk_id, rank, 1 AS list FROM sparse_ranked WHERE rank <= {k1}),
sums_{name} AS (
  SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score,
         min(CASE WHEN list = 0 THEN rank END) AS dense_rank,
         min(CASE WHEN list = 1 THEN rank END) AS sparse_rank
  FROM both_{name} GROUP BY ALL),
{name} AS (
  SELECT query_id, chunk_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST,
                            sparse_rank NULLS LAST, chunk_id) AS rank
  FROM sums_{name})"""


SQL_HYBRID = SQL_QUERIES + "," + SQL_DENSE + "," + SQL_SPARSE + "," + sql_fused()

SQL_HITS = """
hits AS (
  SELECT f.query_id, f.chunk_id, lang || '/' || source || '/' || doc_id || '.md' AS file_path,
         1 AS start_line, len(string_split(text, chr(10))) AS end_line, score, text, rank
  FROM fused f JOIN documents d ON d.doc_id = f.chunk_id WHERE rank <= 50)"""

SQL_RERANKED = """
scored AS (
  SELECT h.* EXCLUDE (score, rank), h.rank AS fused_rank,
         round(len(list_intersect(
                 list_distinct(regexp_extract_all(lower(q.query_text), '[\\p{L}\\p{N}_]+')),
                 regexp_extract_all(lower(h.text), '[\\p{L}\\p{N}_]+')))
               / len(list_distinct(regexp_extract_all(lower(q.query_text), '[\\p{L}\\p{N}_]+'))), 6) AS score
  FROM hits h JOIN queries q USING (query_id)),
reranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank
  FROM scored)"""
