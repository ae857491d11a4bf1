"""Session builder with the settings the operators assume."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app_name: str = "corpusq", master: str | None = None, **conf: str) -> SparkSession:
    """UTC time zone, AQE with skew handling, Arrow batches, RocksDB state.

    Cluster settings given by the submitter win: only keys passed in ``conf`` and
    the semantic ones below (time zone, AQE) are set here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # Stack capture per column call doubles the time to build large expressions.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage, staging tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master without
    that setting (tests) falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    folder = os.environ.get("CORPUSQ_LOCAL_CHECKPOINTS") or tempfile.mkdtemp(prefix="corpusq-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this store; a session that names another kind of RocksDB keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, ROCKSDB)


def bound_batches(spark: SparkSession, most: int) -> None:
    """Batches for Python are bounded in bytes, not in rows only; a session that names a bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(most))


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of what is run inside go when it ends, not when the driver happens to collect garbage.

    For writes whose rows are read from where they were written. A session that sets the key keeps it.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.conf.get(key, "false") == "true":
        yield
        return
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, "false")


# Codec of tables that the operators write: most columns are digests, numbers and text.
CODEC = "zstd"


def cut_lineage(df):
    """Reliable checkpoint of ``df`` in the shared folder (survives executor loss)."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    with freed_shuffles(spark):
        # A plan of its own, as the one of ``df`` may run again.
        return df.select("*").checkpoint(eager=True)


def stage(df, folders: list[str]):
    """``df`` written once to the shared folder as Parquet, for large rows that several results read.

    Unlike a checkpoint it is compressed, only the columns a reader needs are read, and it can
    be dropped: the folder is added to ``folders``.
    """
    spark = df.sparkSession
    folders.append(f"{checkpoint_root(spark)}/staged/{uuid.uuid4().hex}")
    with freed_shuffles(spark):
        df.write.option("compression", CODEC).parquet(folders[-1])
    return spark.read.schema(df.schema).parquet(folders[-1])


def drop_staged(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df, *keys: str):
    """Use every core when a table lies in fewer files than there are cores.

    Only for a plain scan ahead of heavy work inside the row. A table with at least
    as many splits as the cluster has cores comes back as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def inline_rows(df, keep: list, array, present: str):
    """Columns ``keep`` and one row per struct of ``array``, whose field ``present`` is never null.

    For an inner generator Spark adds a filter on the size of the array and moves it below
    ``spread``: a computed array is then computed twice, and first in as few tasks as the table
    has files. An outer generator gets no such filter.
    """
    from pyspark.sql import functions as F

    return df.select(*keep, F.inline_outer(array)).where(F.col(present).isNotNull())


# Rows of keys that may be sent to every executor; beyond it both sides are shuffled.
MAX_BROADCAST_KEYS = 1_000_000


def small_side(df, max_rows: int | None):
    """Broadcast a narrow side whose number of rows is proven; otherwise leave the
    choice to Spark."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if max_rows is not None and max_rows <= MAX_BROADCAST_KEYS else df


# Bytes of rows that may be sent to every executor.
MAX_BROADCAST_BYTES = 64 << 20


def measured_bytes(df) -> int:
    """Size of the rows by one aggregate: eight bytes per fixed field, strings and arrays by their length."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    parts = [F.lit(16)]
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            parts.append(F.coalesce(F.octet_length(column), F.lit(0)) + 8)
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            parts.append(F.length(F.to_json(F.struct(column))))
        else:
            parts.append(F.lit(8))
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return df.agg(F.sum(total.cast("long"))).first()[0] or 0


def broadcast_if_small(df, max_bytes: int = MAX_BROADCAST_BYTES):
    """Broadcast a side whose size in bytes has been measured; beyond the bound Spark shuffles."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df
