"""Chunk, file and vector tables: append, upsert, delete, versions, embedding cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.operators.filters import tenant_predicate
from corpusq.session import broadcast_if_small, cut_lineage, small_side


def append_chunks(chunks: DataFrame, path: str, partition: str = "repository_id") -> None:
    """Append chunk rows, one directory per repository.

    AQE splits the shuffle partition of a huge repository, so one writer task
    never gets all of it.
    """
    (
        chunks.hint("rebalance", F.col(partition))
        .write.mode("append")
        .partitionBy(partition)
        .parquet(path)
    )


def upsert_files(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert, or replace what can change on (repository_id, path); the old id stays."""
    keys = ["repository_id", "path"]
    changing = [c for c in current.columns if c not in (*keys, "file_id")]
    new = incoming.select(
        *keys, F.col("file_id").alias("new_id"), F.lit(True).alias("is_new"),
        *[F.col(c).alias(f"new_{c}") for c in changing],
    )
    joined = current.join(new, keys, "full_outer")
    return joined.select(
        F.coalesce("file_id", "new_id").alias("file_id"),
        *keys,
        *[
            F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
            for c in changing
        ],
    ).select(*current.columns)


def upsert_vectors(
    current: DataFrame, incoming: DataFrame, workspace_id, max_ids: int | None = None
) -> DataFrame:
    """Replace by chunk id. One row of another workspace fails the whole batch.

    With ``max_ids``, a proven bound of the incoming rows, a small batch is broadcast
    and the table is not shuffled.
    """
    own = F.col("workspace_id") == F.lit(workspace_id)
    checked = incoming.withColumn(
        "workspace_id",
        F.when(own, F.col("workspace_id")).otherwise(
            F.raise_error(F.lit("batch holds rows of another workspace"))
        ),
    )
    ids = small_side(incoming.select("chunk_id"), max_ids)
    return current.join(ids, "chunk_id", "left_anti").unionByName(checked)


def delete_by_filter(
    df: DataFrame, workspace_id, repository_id=None, file_id=None
) -> DataFrame:
    """What remains after removing a tenant's matching rows; rows with null keys remain."""
    doomed = tenant_predicate(workspace_id, repository_id, file_id)
    return df.where(~F.coalesce(doomed, F.lit(False)))


def delete_cascade(
    ids: DataFrame, max_ids: int | None = None, **tables: DataFrame
) -> dict[str, DataFrame]:
    """Remove repositories and everything that hangs on them.

    ``ids`` holds repository_id. ``tables`` may be repositories, files, chunks,
    jobs, vectors; all of them carry repository_id.
    """
    gone = small_side(ids.select("repository_id").distinct(), max_ids)
    return {name: df.join(gone, "repository_id", "left_anti") for name, df in tables.items()}


# --- versions ----------------------------------------------------------------------


class VersionedTable:
    """Tables ``{prefix}_v{n}`` with a view ``{prefix}_active`` that readers use.

    Moving the view is one statement, so readers see the old version or the new one.
    """

    def __init__(self, spark: SparkSession, prefix: str, path: str) -> None:
        self.spark, self.prefix, self.path = spark, prefix, path.rstrip("/")

    def write(self, df: DataFrame, version: int, partition_by: list[str] | None = None) -> str:
        name = f"{self.prefix}_v{version}"
        writer = df.write.mode("error").format("parquet").option("path", f"{self.path}/{name}")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(name)
        return name

    def activate(self, version: int) -> None:
        self.spark.sql(
            f"CREATE OR REPLACE VIEW {self.prefix}_active AS SELECT * FROM {self.prefix}_v{version}"
        )

    def active(self) -> DataFrame:
        return self.spark.table(f"{self.prefix}_active")

    def versions(self) -> list[int]:
        """Ascending by number, not by name."""
        start = f"{self.prefix}_v"
        names = [t.name for t in self.spark.catalog.listTables() if t.name.startswith(start)]
        return sorted(int(n[len(start) :]) for n in names if n[len(start) :].isdigit())


# --- embedding cache ----------------------------------------------------------------

CACHE_TTL_SECONDS = 2_592_000  # 30 days


def read_cache(keys: DataFrame, cache: DataFrame, now: Column | None = None) -> DataFrame:
    """Live entries of the wanted keys: the newest of each key, if it has not expired.

    Keys and times alone decide which entries these are; only then are vectors read, and only
    those of the found entries move. The found keys are written once, as they are measured
    before they are broadcast.
    """
    now = F.current_timestamp() if now is None else now
    times = cache.select("cache_key", "written_at", "expires_at")
    newest = (
        times.join(keys.select("cache_key").distinct(), "cache_key", "left_semi")
        .groupBy("cache_key")
        .agg(F.max(F.struct("written_at", "expires_at")).alias("entry"))
    )
    live = cut_lineage(newest.where(F.col("entry.expires_at") > now).select("cache_key"))
    return compact_cache(cache.join(broadcast_if_small(live), "cache_key", "left_semi")).select(*cache.columns)


def write_cache(
    entries: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS, now: Column | None = None
) -> DataFrame:
    """Entries stamped with their times, ready to append."""
    now = F.current_timestamp() if now is None else now
    return entries.withColumn("written_at", now).withColumn(
        "expires_at", now + F.make_interval(secs=F.lit(ttl_seconds))
    )


def compact_cache(cache: DataFrame) -> DataFrame:
    """Newest entry per key."""
    w = Window.partitionBy("cache_key").orderBy(F.desc("written_at"), F.desc("expires_at"))
    return cache.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


# --- progress messages ----------------------------------------------------------------

PROGRESS_SCHEMA = "stage string, percent double, message string, event string"


def parse_progress(raw: DataFrame, text: str = "data") -> DataFrame:
    """JSON progress messages; ``kind`` is done or progress. Works on streams as well."""
    parsed = raw.withColumn("_p", F.from_json(text, PROGRESS_SCHEMA))
    done = F.coalesce(F.col("_p.event") == "done", F.lit(False))
    others = [c for c in raw.columns if c != text]
    return parsed.select(
        *others,
        F.when(done, F.lit("done")).otherwise(F.lit("progress")).alias("kind"),
        *[F.when(~done, F.col(f"_p.{c}")).alias(c) for c in ("stage", "percent", "message")],
    )
