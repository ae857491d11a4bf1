"""Exact dedup: a two-pass Bloom filter finds hashes that may repeat; only their rows shuffle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import ascii_lower
from corpusq.session import cut_lineage

# Bits of one bitmap of bitmap_construct_agg.
BITMAP_BITS = 32_768


def _repeated_cells(digests: DataFrame) -> DataFrame:
    """First pass: cells of the filter hit at least twice, as one bitmap per bucket.

    Counts are combined before the shuffle, so a text that fills a third of the table sends
    one count per task.
    """
    hits = digests.select("slice", "bucket", F.explode(F.array("cell_a", "cell_b")).alias("cell"))
    twice = hits.groupBy("slice", "bucket", "cell").count().where("count > 1")
    return twice.groupBy("slice", "bucket").agg(F.expr("bitmap_construct_agg(cell)").alias("bitmap"))


def _bit(cell: str) -> str:
    byte = f"cast(conv(hex(substring(bitmap, cast({cell} div 8 as int) + 1, 1)), 16, 10) as int)"
    return f"(shiftright({byte}, cast({cell} % 8 as int)) & 1) = 1"


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    filter_bytes: int = 32 << 20,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id
    stays. The filter has ``bits_per_row`` bits a row, cut by hash into slices of at most
    ``filter_bytes``, so what is broadcast at a time has a fixed bound at any input size.

    A null text counts as empty, empty texts equal each other. A null id is smaller than
    any other; a group of null ids only has keep_id null and keeps its rows. Rows repeated
    with the same id and text all carry kept = true when theirs is the largest id. Other
    columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digests = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"), F.unhex(F.sha2(ascii_lower(text), 256)).alias("digest")
        )
    )
    rows = digests.count()
    slices = max(1, math.ceil(rows * bits_per_row / 8 / filter_bytes))
    buckets = max(1, math.ceil(rows * bits_per_row / slices / BITMAP_BITS))
    placed = digests.select(
        "doc_id",
        "digest",
        F.pmod(F.xxhash64(F.lit(1), "digest"), F.lit(slices)).alias("slice"),
        F.pmod(F.xxhash64(F.lit(2), "digest"), F.lit(buckets)).alias("bucket"),
        F.pmod(F.xxhash64(F.lit(3), "digest"), F.lit(BITMAP_BITS)).alias("cell_a"),
        F.pmod(F.xxhash64(F.lit(4), "digest"), F.lit(BITMAP_BITS)).alias("cell_b"),
    )
    bitmaps = cut_lineage(_repeated_cells(placed))
    tested = None
    for part in range(slices):
        own = placed.where(F.col("slice") == part).drop("slice")
        filters = F.broadcast(bitmaps.where(F.col("slice") == part).drop("slice"))
        marked = own.join(filters, "bucket", "left").select(
            "doc_id",
            "digest",
            F.expr(f"bitmap IS NOT NULL AND {_bit('cell_a')} AND {_bit('cell_b')}").alias("maybe"),
        )
        tested = marked if tested is None else tested.unionByName(marked)
    maybe = tested.where("maybe").drop("maybe")
    groups = cut_lineage(
        maybe.groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    # Both sides of this join are plain exchanges, so AQE can split a hot group.
    doubled = maybe.join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "digest",
    )
    single = tested.where("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest"
    )
    return single.unionByName(doubled).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
