"""Hybrid search for whole tables of queries: dense, sparse, fuse, hydrate, rerank.

Tables
    queries   query_id, workspace_id, query_text, dense array<float|double>,
              sparse struct<ids array<bigint>, weights array<double>>, and
              optionally repository_id (null = any) and path_prefix (null = any)
    vectors   chunk_id, workspace_id, dense, sparse, and any filter columns
    chunks    chunk_id, file_id, start_line, end_line, symbol_name, content
    files     file_id, path
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusq.functions.text import let, term_overlap, terms
from corpusq.session import (
    MAX_BROADCAST_BYTES,
    bound_batches,
    broadcast_if_small,
    cut_lineage,
    inline_rows,
    measured_bytes,
    small_side,
)
from corpusq.sources.published import PublishedTables

# Bounds of one in-memory block. Queries beyond the bound are never broadcast.
MAX_BROADCAST_NUMBERS = 8_000_000  # numbers over all query vectors (64 MB as doubles)
CELL_ROWS = 65_536  # vectors per cell when queries do not fit one broadcast
SCORE_CELLS = 1 << 20  # scores held at once inside a task
SCORE_NUMBERS = 1 << 20  # numbers of the vectors scored at once
BATCH_BYTES = 16 << 20  # of vectors handed to a task at once

SCOPE = ["workspace_id", "repository_id"]


# --- kernels: scores of a slice of vectors against a group of queries -----------


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets from 0) of a list column slice."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.to_numpy(zero_copy_only=False), offsets - offsets[0]


class _Dense:
    """Cosine similarity; a zero vector scores 0."""

    column = "dense"
    only_positive = False
    prune_nulls = True

    @staticmethod
    def numbers() -> Column:
        return F.size("dense")

    @staticmethod
    def lengths(column: pa.Array) -> pa.Array:
        return pc.list_value_length(column)

    def __init__(self, vectors: list) -> None:
        self.matrix = self._unit(np.asarray([np.asarray(v, dtype=np.float64) for v in vectors]))

    @staticmethod
    def _unit(m: np.ndarray) -> np.ndarray:
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(norm == 0, 1.0, norm)

    def score(self, column: pa.Array) -> np.ndarray:
        values, _ = _flat(column)
        block = values.astype(np.float64).reshape(len(column), -1)
        return self._unit(block) @ self.matrix.T


class _Sparse:
    """Dot product over shared ids; a pair that shares none is not a hit."""

    column = "sparse"
    only_positive = True
    # Sparse vectors are often computed on the way, and a filter would be pushed
    # below and compute them a second time: nulls are left out in the scan instead.
    prune_nulls = False

    @staticmethod
    def numbers() -> Column:
        return F.size("sparse.ids") * 2

    @staticmethod
    def lengths(column: pa.Array) -> pa.Array:
        return pc.list_value_length(pc.struct_field(column, "ids"))

    def __init__(self, vectors: list) -> None:
        ids = [np.asarray(v["ids"], dtype=np.int64) for v in vectors]
        owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        weights = np.concatenate([np.asarray(v["weights"], dtype=np.float64) for v in vectors])
        order = np.argsort(flat, kind="stable")
        self.count = len(vectors)
        self.owner, self.weight = owner[order], weights[order]
        self.ids, first = np.unique(flat[order], return_index=True)
        self.bounds = np.append(first, len(flat))

    def score(self, column: pa.Array) -> np.ndarray:
        ids, offsets = _flat(column.field("ids"))
        weights, _ = _flat(column.field("weights"))
        rows = np.repeat(np.arange(len(column)), np.diff(offsets))
        out = np.zeros(len(column) * self.count)
        if len(self.ids) and len(ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            hit = self.ids[at] == ids
            at, rows, weights = at[hit], rows[hit], weights[hit]
            times = self.bounds[at + 1] - self.bounds[at]
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            entry = np.repeat(self.bounds[at], times) + step
            cell = np.repeat(rows, times) * self.count + self.owner[entry]
            out = np.bincount(
                cell, weights=np.repeat(weights, times) * self.weight[entry], minlength=len(out)
            )
        return out.reshape(len(column), self.count)


class _BestK:
    """Running top k per query: score rounded to six places, then id."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.size = k, [], 0
        self.floor: dict = {}

    def add(self, scores: np.ndarray, chunk_ids: np.ndarray, query_ids: list, positive: bool) -> None:
        scores = np.round(scores, 6)
        floor = np.array([self.floor.get(q, -np.inf) for q in query_ids])
        if len(scores) > self.k:
            place = len(scores) - self.k
            floor = np.maximum(floor, np.partition(scores, place, axis=0)[place])
        keep = scores >= floor
        if positive:
            keep &= scores > 0
        row, col = np.nonzero(keep)
        if len(row):
            ids = np.asarray(query_ids, dtype=object)[col]
            self.parts.append(
                pd.DataFrame({"q": ids, "c": chunk_ids[row], "s": scores[row, col]})
            )
            self.size += len(row)
        if self.size > 50 * self.k * max(1, len(query_ids)):
            self.compact()

    def compact(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"q": [], "c": [], "s": []})
        rows = pd.concat(self.parts, ignore_index=True)
        rows = rows.sort_values(["s", "c"], ascending=[False, True], kind="stable")
        rows = rows.groupby("q", sort=False).head(self.k)
        full = rows.groupby("q", sort=False)["s"].agg(["size", "min"])
        full = full[full["size"] >= self.k]
        self.floor = dict(zip(full.index, full["min"], strict=True))
        self.parts, self.size = [rows], len(rows)
        return rows


@dataclass
class _Group:
    scope: tuple
    query_ids: list
    kernel: object


def _groups(kernel: type, queries: pd.DataFrame, scope: list[str]) -> dict:
    """Queries by workspace, then by the rest of their scope."""
    found: dict = {}
    keys = queries[scope].astype(object).where(queries[scope].notna(), None)
    for key, index in keys.groupby(scope, dropna=False, sort=False).indices.items():
        key = key if isinstance(key, tuple) else (key,)
        key = tuple(None if pd.isna(part) else part for part in key)
        part = queries.iloc[index]
        group = _Group(key, part["query_id"].tolist(), kernel(part[kernel.column].tolist()))
        found.setdefault(key[0], []).append(group)
    return found


def _slices(lengths: np.ndarray, most_rows: int) -> Iterator[tuple[int, int]]:
    """Runs of at most ``most_rows`` rows and about ``SCORE_NUMBERS`` numbers; a longer row is one by itself."""
    ends = np.cumsum(lengths)
    low = 0
    while low < len(ends):
        done = ends[low - 1] if low else 0
        high = int(np.searchsorted(ends, done + SCORE_NUMBERS, side="right"))
        high = max(low + 1, min(high, low + most_rows))
        yield low, high
        low = high


def _scan(batch: pa.RecordBatch | pa.Table, groups: dict, column: str, scope: list[str], best: _BestK):
    workspaces = batch.column("workspace_id").to_numpy(zero_copy_only=False)
    chunk_ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
    others = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in scope[1:]}
    vectors = batch.column(column)
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    lengths = None
    for workspace in pd.unique(workspaces):
        for group in groups.get(workspace, ()):
            mask = present & (workspaces == workspace)
            for name, wanted in zip(scope[1:], group.scope[1:], strict=True):
                if wanted is not None:
                    mask &= others[name] == wanted
            at = np.flatnonzero(mask)
            if lengths is None and len(at):
                lengths = pc.fill_null(group.kernel.lengths(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            step = max(1, SCORE_CELLS // max(1, len(group.query_ids)))
            for low, high in _slices(lengths[at] if len(at) else at, step):
                rows = at[low:high]
                best.add(
                    group.kernel.score(vectors.take(pa.array(rows))),
                    chunk_ids[rows],
                    group.query_ids,
                    group.kernel.only_positive,
                )


def _topk(
    queries: DataFrame, vectors: DataFrame, k: int, kernel: type, more_scope: tuple[str, ...] = ()
) -> DataFrame:
    spark = vectors.sparkSession
    bound_batches(spark, BATCH_BYTES)
    scope = [c for c in (*SCOPE, *more_scope) if c in queries.columns and (c in vectors.columns)]
    if scope[:1] != ["workspace_id"]:
        raise TypeError("queries and vectors need workspace_id")
    wanted = queries.select("query_id", *scope, kernel.column)
    given = vectors.select("chunk_id", *scope, kernel.column)
    if kernel.prune_nulls:
        given = given.where(F.col(kernel.column).isNotNull())
    out = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out.fields])

    def emit(best: _BestK) -> pa.Table:
        rows = best.compact()
        return pa.table(
            [
                pa.array(rows["q"].tolist(), arrow.field(0).type),
                pa.array(rows["c"].tolist(), arrow.field(1).type),
                pa.array(rows["s"].to_numpy(dtype=np.float64), arrow.field(2).type),
            ],
            schema=arrow,
        )

    numbers = wanted.agg(F.sum(kernel.numbers()).alias("n")).first()["n"] or 0
    if numbers <= MAX_BROADCAST_NUMBERS:
        # Checked bound: the queries go to every task, the vectors stay where they
        # are, and each task gives back at most k rows per query.
        shared = spark.sparkContext.broadcast(wanted.toPandas())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            groups = _groups(kernel, shared.value, scope)
            best = _BestK(k)
            for batch in batches:
                _scan(batch, groups, kernel.column, scope, best)
            yield from emit(best).to_batches()

        scored = given.mapInArrow(scan, out)
    else:
        # Block product: query blocks x vector blocks, each cell bounded in size.
        # Queries are copied to every vector block and vectors to every query
        # block; a cell gives back at most k rows per query.
        query_blocks = math.ceil(numbers / MAX_BROADCAST_NUMBERS)
        vector_blocks = max(1, math.ceil(given.count() / CELL_ROWS))

        def copies(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
            return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(
                other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
            )

        left = copies(wanted, "query_id", "qb", query_blocks, "vb", vector_blocks)
        right = copies(given, "chunk_id", "vb", vector_blocks, "qb", query_blocks)

        def cell(block: pa.Table, part: pa.Table) -> pa.Table:
            best = _BestK(k)
            if block.num_rows and part.num_rows:
                groups = _groups(kernel, block.to_pandas(), scope)
                _scan(part, groups, kernel.column, scope, best)
            return emit(best)

        scored = (
            left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(cell, out)
        )
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 40) -> DataFrame:
    """Exact cosine top k per query inside its tenant scope. Filter ``vectors`` first."""
    return _topk(queries, vectors, k, _Dense)


def sparse_topk(queries: DataFrame, vectors: DataFrame, k: int = 40) -> DataFrame:
    """Exact sparse dot-product top k per query inside its tenant scope.

    Vectors are scored in the row that holds them. There is no posting list, so a
    term found in a third of the corpus is no hot key and no pair is shuffled.
    """
    return _topk(queries, vectors, k, _Sparse)


class CellIndex:
    """Approximate dense search: vectors are put into k-means cells, a query looks
    into the ``nprobe`` cells whose centres are nearest.

    For assigned vectors in memory or on the way: every cell is read, and scored only for the
    queries that probe it. ``cells.StoredCells`` keeps them on disk and reads what is probed.
    """

    def __init__(self, centres: list[list[float]]) -> None:
        self.centres = centres

    @classmethod
    def train(cls, vectors: DataFrame, cells: int, seed: int = 7, train_fraction: float = 1.0) -> CellIndex:
        """Centres by k-means. A fraction below 1 trains on a sample; every vector is
        still assigned and searched."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        data = vectors.where(F.col("dense").isNotNull())
        if train_fraction < 1.0:
            data = data.sample(train_fraction, seed)
        features = data.select(array_to_vector(F.col("dense").cast("array<double>")).alias("features"))
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(features)
        return cls([c.tolist() for c in model.clusterCenters()])

    def _nearest(self, count: int):
        centres = np.asarray(self.centres)

        @F.pandas_udf("array<int>")
        def nearest(dense: pd.Series) -> pd.Series:
            block = np.stack([np.asarray(v, dtype=np.float64) for v in dense])
            distance = (centres**2).sum(axis=1) - 2 * block @ centres.T
            return pd.Series(list(np.argsort(distance, axis=1, kind="stable")[:, :count].astype("int32")))

        return nearest

    def assign(self, vectors: DataFrame) -> DataFrame:
        return vectors.where(F.col("dense").isNotNull()).withColumn(
            "cell", F.get(self._nearest(1)("dense"), F.lit(0))
        )

    def search(self, queries: DataFrame, assigned: DataFrame, k: int = 40, nprobe: int = 4) -> DataFrame:
        probing = queries.withColumn("cell", F.explode(self._nearest(nprobe)("dense")))
        return _topk(probing, assigned, k, _Dense, ("cell",))


# --- fusion and hydration --------------------------------------------------------


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of any number of (query_id, chunk_id, rank) lists.

    Equal scores keep first-seen order: by rank in the first list, then the second…
    """
    tagged = [
        r.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.lit(n).alias("list"))
        for n, r in enumerate(rankings)
    ]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    positions = [f"rank_{n}" for n in range(len(rankings))]
    fused = union.groupBy("query_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"),
        *[
            F.min(F.when(F.col("list") == n, F.col("rank"))).alias(name)
            for n, name in enumerate(positions)
        ],
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), *[F.asc_nulls_last(p) for p in positions], F.asc("chunk_id")
    )
    return fused.withColumn("rank", F.row_number().over(order)).drop(*positions)


# Hits are small by construction: lists x k rows per query. Beyond this many rows
# they are shuffled instead of broadcast.
MAX_BROADCAST_HITS = 1_000_000


def read_by_ids(table: DataFrame, ids: DataFrame, key: str, max_ids: int | None = None) -> DataFrame:
    """Rows of ``table`` whose key occurs in ``ids``; broadcast only within a proven bound."""
    return table.join(small_side(ids.select(key), max_ids), key, "left_semi")


def hydrate(
    fused: DataFrame,
    chunks: DataFrame,
    files: DataFrame,
    max_hits: int | None = None,
) -> DataFrame:
    """Add text, lines, symbol and path to fused hits; order is carried in ``rank``.

    Hits whose chunk is gone or inactive drop out; a missing file gives an empty path.
    """
    if "is_active" in chunks.columns:
        chunks = chunks.where("is_active")
    small = max_hits is not None and max_hits <= MAX_BROADCAST_HITS
    hits = F.broadcast(fused) if small else fused
    text = chunks.select("chunk_id", "file_id", "start_line", "end_line", "symbol_name", "content")
    paths = files.select("file_id", F.col("path").alias("file_path"))
    return (
        text.join(hits, "chunk_id")
        .join(paths, "file_id", "left")
        .select(
            "query_id",
            "chunk_id",
            F.coalesce("file_path", F.lit("")).alias("file_path"),
            "start_line",
            "end_line",
            "symbol_name",
            "score",
            F.lit("fused").alias("source"),
            F.col("content").alias("text"),
            "rank",
        )
    )


# Chunks as they are looked up: by id, with the path of their file in the row.
STORED_CHUNKS = (
    "chunk_id {id}, file_path string, start_line int, end_line int, symbol_name string, content string, is_active boolean"
)


def open_chunks(spark, root: str, id_type: str = "string", buckets: int = 256) -> PublishedTables:
    """Chunk rows below ``root`` in buckets by chunk id."""
    return PublishedTables(spark, root, {"chunks": STORED_CHUNKS.format(id=id_type)}, {"chunks": "chunk_id"}, buckets)


def hydrate_stored(fused: DataFrame, chunks: PublishedTables) -> DataFrame:
    """As ``hydrate``, from chunks in buckets: only buckets that hold a hit are listed and read.

    The hits are written once, as both their buckets and the join need them; they are
    broadcast if they measure less than 64 MB, else both sides shuffle.
    """
    hits = cut_lineage(fused.select("query_id", "chunk_id", "score", "rank"))
    text = chunks.read("chunks", buckets=chunks.buckets_of(hits, "chunk_id")).where("is_active")
    return text.join(broadcast_if_small(hits), "chunk_id").select(
        "query_id", "chunk_id", F.coalesce("file_path", F.lit("")).alias("file_path"), "start_line", "end_line", "symbol_name",
        "score", F.lit("fused").alias("source"), F.col("content").alias("text"), "rank",
    )


# --- reranking -------------------------------------------------------------------

Scorer = Callable[[list[str], list[str]], list[float]]


def _rerank_order(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))
    return scored.withColumn("rank", F.row_number().over(order))


def rerank(
    hits: DataFrame,
    queries: DataFrame,
    scorer: Scorer | None = None,
    fail_open: bool = True,
    max_length: int | None = None,
    batch_size: int = 16,
) -> DataFrame:
    """Score each (query, text) pair and sort again; all rows are returned.

    Without a scorer the share of query terms found in the whole text is used, in
    the JVM. A scorer is called with lists of queries and whole texts, cut to four
    characters for each of ``max_length`` tokens only if that is given; if it fails for
    any row of a query, that query keeps its fused order, scores and source.
    """
    pairs = hits.join(queries.select("query_id", "query_text"), "query_id")
    if scorer is None:
        scored = pairs.withColumn("score", F.round(term_overlap(F.col("query_text"), F.col("text")), 6))
        return _rerank_order(
            scored.withColumn("source", F.lit("reranked")).drop("query_text")
        )

    def call(queries: list[str], texts: list[str]) -> list[tuple]:
        values = [float(v) for v in scorer(queries, texts)]
        if len(values) != len(queries):
            raise ValueError(f"{len(values)} scores for {len(queries)} pairs")
        return [(v, None) for v in values]

    @F.pandas_udf("struct<value:double,error:string>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for query, text in batches:
            rows: list[tuple] = []
            for low in range(0, len(query), batch_size):
                q = query.iloc[low : low + batch_size].tolist()
                t = text.iloc[low : low + batch_size].tolist()
                try:
                    rows += call(q, t)
                except Exception:
                    if not fail_open:
                        raise
                    # A batch holds pairs of several queries: only those that fail alone have failed.
                    for one, other in zip(q, t, strict=True):
                        try:
                            rows += call([one], [other])
                        except Exception as exc:
                            rows.append((None, str(exc) or type(exc).__name__))
            yield pd.DataFrame(rows, columns=["value", "error"])

    cut = F.coalesce("text", F.lit(""))
    if max_length is not None:
        cut = F.substring(cut, 1, max_length * 4)
    whole = Window.partitionBy("query_id")
    scored = (
        pairs.withColumn("pair", score("query_text", cut))
        .withColumn("failed", F.max(F.col("pair.error").isNotNull()).over(whole))
        .withColumn("source", F.when(~F.col("failed"), F.lit("reranked")).otherwise(F.col("source")))
        .withColumn("fused_score", F.col("score"))
        .withColumn("score", F.when(~F.col("failed"), F.col("pair.value")).otherwise(F.col("score")))
        .withColumn("sort_key", F.when(~F.col("failed"), F.col("score")).otherwise(-F.col("rank")))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("sort_key"), F.asc("rank"))
    return scored.withColumn("rank", F.row_number().over(order)).select(*hits.columns)


# --- compositions ----------------------------------------------------------------


def fused(queries: DataFrame, vectors: DataFrame, k1: int, k2: int) -> DataFrame:
    dense = dense_topk(queries.where(F.col("dense").isNotNull()), vectors, k1)
    sparse = sparse_topk(queries.where(F.col("sparse").isNotNull()), vectors, k1)
    return rrf([dense, sparse]).where(F.col("rank") <= k2)


def _below(prefix: Column, path: Column) -> Column:
    return prefix.isNull() | F.startswith(path, F.coalesce(prefix, F.lit("")))


def fused_hits(
    queries: DataFrame,
    vectors: DataFrame,
    chunks: DataFrame,
    files: DataFrame,
    k1: int = 40,
    k2: int = 50,
) -> DataFrame:
    """Both searches, fused, cut to k2, hydrated, and only then filtered by path prefix."""
    return _below_prefix(queries, hydrate(fused(queries, vectors, k1, k2), chunks, files, max_hits=queries.count() * k2))


def _below_prefix(queries: DataFrame, hits: DataFrame) -> DataFrame:
    if "path_prefix" not in queries.columns:
        return hits
    prefix = queries.select("query_id", "path_prefix")
    return (
        hits.join(prefix, "query_id")
        .where(_below(F.col("path_prefix"), F.col("file_path")))
        .drop("path_prefix")
    )


def hybrid_search_stored(
    queries: DataFrame,
    vectors: DataFrame,
    chunks: PublishedTables,
    n: int = 10,
    k1: int = 40,
    k2: int = 50,
    scorer: Scorer | None = None,
    fail_open: bool = True,
) -> DataFrame:
    """``hybrid_search`` over chunks in buckets: only buckets with a hit are read."""
    if not 1 <= n <= 50:
        raise ValueError("n must be between 1 and 50")
    hits = _below_prefix(queries, hydrate_stored(fused(queries, vectors, k1, k2), chunks))
    return rerank(hits, queries, scorer, fail_open).where(F.col("rank") <= n)


# Queries whose hits on one chunk are scored together; bounds the size of a group.
QUERIES_PER_GROUP = 1024


def _scored_hits(
    queries: DataFrame, vectors: DataFrame, chunks: DataFrame, files: DataFrame, k1: int, k2: int
) -> DataFrame:
    """Fused hits with their term-overlap scores.

    A chunk is often a hit of many queries: its terms are cut out once and compared
    with all of them in its row. Queries are salted, so such a row holds at most
    about ``QUERIES_PER_GROUP`` of them even for a chunk that every query finds.
    """
    count = queries.count()
    hash_terms = F.array_distinct(F.transform(terms(F.col("query_text")), lambda x: F.xxhash64(x)))
    prefix = F.col("path_prefix") if "path_prefix" in queries.columns else F.lit(None).cast("string")
    asked = queries.select("query_id", hash_terms.alias("wanted"), prefix.alias("prefix"))
    salt = F.pmod(F.xxhash64("query_id"), F.lit(math.ceil(max(count, 1) / QUERIES_PER_GROUP)))
    grouped = (
        fused(queries, vectors, k1, k2)
        .join(asked, "query_id")
        .groupBy("chunk_id", salt.alias("salt"))
        .agg(F.collect_list(F.struct("query_id", "rank", "wanted", "prefix")).alias("hits"))
        .drop("salt")
    )
    if "is_active" in chunks.columns:
        chunks = chunks.where("is_active")
    # A query's terms go out with each of its at most k2 hits: bounded in bytes before any search.
    small = k2 * measured_bytes(asked) <= MAX_BROADCAST_BYTES
    paths = files.select("file_id", F.col("path").alias("file_path"))
    rows = (
        chunks.select("chunk_id", "file_id", "start_line", "end_line", "symbol_name", "content")
        .join(F.broadcast(grouped) if small else grouped, "chunk_id")
        .join(paths, "file_id", "left")
        .withColumn("file_path", F.coalesce("file_path", F.lit("")))
    )
    found = F.array_distinct(F.transform(terms(F.col("content")), lambda x: F.xxhash64(x)))
    scored = let(
        found,
        lambda have: F.transform(
            F.filter("hits", lambda h: _below(h["prefix"], F.col("file_path"))),
            lambda h: F.struct(
                h["query_id"].alias("query_id"),
                F.when(
                    F.size(h["wanted"]) > 0,
                    F.round(F.size(F.array_intersect(have, h["wanted"])) / F.size(h["wanted"]), 6),
                )
                .otherwise(F.lit(0.0))
                .alias("score"),
                h["rank"].alias("rank"),
            ),
        ),
    )
    kept = ["chunk_id", "file_path", "start_line", "end_line", "symbol_name"]
    return inline_rows(rows, [*kept, F.lit("reranked").alias("source"), F.col("content").alias("text")], scored, "rank")


def _first_n(hits: DataFrame, n: int) -> DataFrame:
    """Re-number after rows dropped out, then cut."""
    order = Window.partitionBy("query_id").orderBy(F.asc("rank"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hybrid_search(
    queries: DataFrame,
    vectors: DataFrame,
    chunks: DataFrame,
    files: DataFrame,
    n: int = 10,
    k1: int = 40,
    k2: int = 50,
    scorer: Scorer | None = None,
    fail_open: bool = True,
) -> DataFrame:
    """One job for a whole table of queries; a query without hits gives no rows."""
    if not 1 <= n <= 50:
        raise ValueError("n must be between 1 and 50")
    if scorer is None:
        ranked = _rerank_order(_scored_hits(queries, vectors, chunks, files, k1, k2))
    else:
        ranked = rerank(fused_hits(queries, vectors, chunks, files, k1, k2), queries, scorer, fail_open)
    return ranked.where(F.col("rank") <= n)


def hybrid_search_no_rerank(
    queries: DataFrame,
    vectors: DataFrame,
    chunks: DataFrame,
    files: DataFrame,
    n: int = 10,
    k1: int = 40,
    k2: int = 50,
) -> DataFrame:
    return _first_n(fused_hits(queries, vectors, chunks, files, k1, k2), n)


def retry_widened(
    queries: DataFrame,
    vectors: DataFrame,
    chunks: DataFrame,
    files: DataFrame,
    max_attempts: int = 2,
    multiplier: int = 2,
    n: int = 10,
    k1: int = 40,
    k2: int = 50,
) -> DataFrame:
    """Queries without hits run again with wider cuts; ``attempt`` counts from 1."""
    answered: DataFrame | None = None
    open_queries = queries
    for attempt in range(max_attempts):
        widen = multiplier**attempt
        hits = hybrid_search_no_rerank(
            open_queries, vectors, chunks, files, n, k1 * widen, k2 * widen
        ).withColumn("attempt", F.lit(attempt + 1))
        if attempt + 1 < max_attempts:
            # At most n rows per query; written once because it is read three times.
            hits = cut_lineage(hits)
        answered = hits if answered is None else answered.unionByName(hits)
        if attempt + 1 < max_attempts:
            open_queries = open_queries.join(hits.select("query_id"), "query_id", "left_anti")
            if open_queries.isEmpty():
                break
    return answered


# What is searched for when a document is asked for, by scope.
SCOPE_TEXTS = {
    "file": "code and behavior implemented in this file",
    "module": "code and behavior implemented in this module",
    "repository": "overview of the repository's architecture and main components",
}


def scoped_queries(requests: DataFrame) -> DataFrame:
    """Requests (scope, workspace_id, repository_id, path) -> query rows without vectors."""
    text = F.lit(None).cast("string")
    for scope, words in SCOPE_TEXTS.items():
        text = F.when(F.col("scope") == scope, F.lit(words)).otherwise(text)
    needs_path = (F.col("scope") != "repository") & (F.coalesce("path", F.lit("")) == "")
    return (
        requests.withColumn(
            "query_text",
            F.when(text.isNull(), F.raise_error(F.lit("unknown scope")))
            .when(needs_path, F.raise_error(F.lit("path is required for this scope")))
            .otherwise(text),
        )
        .withColumn("path_prefix", F.when(F.col("scope") != "repository", F.col("path")))
    )


def format_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One text per query: ``path:start-end (score=0.123)`` lines in rank order."""

    @F.pandas_udf("string")
    def three_places(score: pd.Series) -> pd.Series:
        # Rounds the exact binary value; the JVM's format rounds its decimal print.
        return score.map("{:.3f}".format)

    line = F.concat(
        F.format_string("%s:%d-%d (score=", "file_path", "start_line", "end_line"),
        three_places("score"),
        F.lit(")"),
    )
    hits = hits.withColumn("line", line)
    lines = (
        hits.groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("lines"))
        .select("query_id", F.array_join(F.col("lines.line"), "\n").alias("listing"))
    )
    return queries.join(lines, "query_id", "left").select(
        "query_id",
        F.coalesce(
            "listing", F.concat(F.lit("No results found for: "), F.col("query_text"))
        ).alias("listing"),
    )
