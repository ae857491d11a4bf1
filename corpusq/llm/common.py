"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.session import checkpoint_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text without other capitals takes the quick path, with the same result."""
    return F.when(
        F.octet_length(text) == F.char_length(text), F.lower(text)
    ).otherwise(F.translate(text, UPPER, UPPER.lower()))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/corpusq-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hand freed Arrow memory back to the system: an idle Python worker would keep it."""
    pa.default_memory_pool().release_unused()


def text_blocks(
    batches: Iterable[pa.RecordBatch], max_bytes: int = 1 << 19
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches whose last column is a text into blocks of about ``max_bytes`` of text.

    Yields the rows, their UTF-8 bytes in one array, and the offsets of the rows in it. A
    single text longer than the bound makes a block of its own. Nothing is copied.
    """
    for batch in batches:
        col = batch.column(batch.num_columns - 1)
        if col.null_count:
            col = pc.fill_null(col, "")
        n = len(col)
        if not n:
            continue
        buffers = col.buffers()
        kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
        offsets = np.frombuffer(buffers[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            end = min(n, max(end, at + 1))
            own = offsets[at : end + 1]
            yield batch.slice(at, end - at), data[own[0] : own[-1]], own - own[0]
            at = end
        del batch, col, buffers, offsets, data, own
        give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
