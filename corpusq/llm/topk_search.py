"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.session import cut_lineage

# float64 holds integers exactly up to here.
EXACT = 2.0**53
NO_SCORE = -np.inf


def scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: as floats where these hold every partial sum, else as Python integers."""
    if queries.size and shard.size:
        bound = np.abs(queries).max() * np.abs(shard).max() * queries.shape[1]
        if bound >= EXACT:
            whole = [[int(x) for x in row] for row in queries], [[int(x) for x in row] for row in shard]
            return np.array(whole[0], object) @ np.array(whole[1], object).T
    return queries @ shard.T


def select(
    product: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best k of each row as (row, column, score); ``ids`` are ascending, so ties go to the left."""
    n, m = product.shape
    rows, columns, values = [], [], []
    if product.dtype == object or m * max(1.0, np.abs(product).max(initial=0.0)) >= EXACT / 2:
        for i in range(n):
            own = [j for j in range(m) if ids[j] != query_ids[i]]
            best = sorted(own, key=lambda j: (-int(product[i, j]), j))[:k]
            rows += [i] * len(best)
            columns += best
            values += [int(product[i, j]) for j in best]
        return np.array(rows, np.int64), np.array(columns, np.int64), values
    # One sortable number per cell: score first, then position.
    packed = product * m - np.arange(m)
    packed[query_ids[:, None] == ids[None, :]] = NO_SCORE
    take = min(k, m)
    best = np.argpartition(-packed, take - 1, axis=1)[:, :take]
    row = np.repeat(np.arange(n), take)
    column = best.reshape(-1)
    there = packed[row, column] > NO_SCORE
    row, column = row[there], column[there]
    return row, column, product[row, column].astype(np.int64).tolist()


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    query_rows: int = 1024,
    shard_rows: int = 8192,
    fan_in: int = 64,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` best of ``vectors`` for each of ``queries``.

    A component x counts as floor(``scale`` * x), the score is the inner product, ties go to
    the smaller id, a query's own id is left out. Vectors are dealt by hash to shards, queries
    to blocks; a tile is one shard and one block, so its memory is bounded by ``shard_rows`` +
    ``query_rows`` vectors and their product, whatever the input. Tiles keep ``k`` rows per
    query; these are merged ``fan_in`` shards at a time.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do
    rows with a null id. Only vectors of the same length are compared. Repeated ids are each a
    candidate; as queries, rows of one id must be equal. A query without any candidate has no
    row. Other columns are not read. An empty table gives an empty result. Scores beyond a
    64-bit integer raise an error.
    """

    def clean(df: DataFrame) -> DataFrame:
        x = F.col("v")
        rows = df.select(
            F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
        ).where(F.col("id").isNotNull() & (F.size(x) > 0))
        finite = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
        return rows.where(finite)

    # Ids and counts only; the vectors are read where they are used.
    n, asked = clean(vectors).count(), clean(queries).count()
    # A hash deals unevenly: some room is left below the bounds.
    shards = max(1, math.ceil(n / shard_rows * 1.1))
    blocks = max(1, math.ceil(asked / query_rows * 1.1))
    dim = F.size("v")
    deal = F.xxhash64("id", "v")
    columns = ["id", "v", "shard", "block", "query"]
    left = clean(vectors).withColumn("shard", F.pmod(deal, F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ).withColumn("query", F.lit(False))
    # A row repeated in the queries asks once.
    right = clean(queries).dropDuplicates(["id"]).withColumn("block", F.pmod(deal, F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    ).withColumn("query", F.lit(True))
    cells = left.select(columns).unionByName(
        right.select("id", "v", F.col("shard").cast("long"), "block", "query"), allowMissingColumns=False
    )

    def tile(rows: pa.Table) -> pa.Table:
        asks = rows["query"].to_numpy()
        ids = rows["id"].to_numpy()
        flat = rows["v"].combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        width = rows["dim"][0].as_py()
        matrix = np.floor(flat.flatten().to_numpy() * scale).reshape(len(ids), width)
        order = np.argsort(ids[~asks], kind="stable")
        shard_ids, shard = ids[~asks][order], matrix[~asks][order]
        query_ids, query = ids[asks], matrix[asks]
        found: tuple[list, list, list] = ([], [], [])
        step = max(1, (4 << 20) // max(1, len(shard_ids)))
        for at in range(0, len(query_ids) if len(shard_ids) else 0, step):
            part = query_ids[at : at + step]
            row, column, value = select(scores(query[at : at + step], shard), part, shard_ids, k)
            found[0].extend(part[row].tolist())
            found[1].extend(shard_ids[column].tolist())
            found[2].extend(value)
        return pa.table(
            {
                "query_id": pa.array(found[0], pa.int64()),
                "vec_id": pa.array(found[1], pa.int64()),
                "score": pa.array(found[2], pa.int64()),
                "part": pa.array([rows["shard"][0].as_py()] * len(found[0]), pa.int64()),
            }
        )

    tiles = cells.withColumn("dim", dim).groupBy("dim", "shard", "block")
    best = tiles.applyInArrow(tile, "query_id long, vec_id long, score long, part long")
    order = (F.col("score").desc(), F.col("vec_id").asc())
    while shards > fan_in:
        shards = -(-shards // fan_in)
        best = best.withColumn("part", F.pmod("part", F.lit(shards)))
        window = Window.partitionBy("query_id", "part").orderBy(*order)
        best = best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).drop("rank")
    best = cut_lineage(best)
    window = Window.partitionBy("query_id").orderBy(*order)
    return (
        best.withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
