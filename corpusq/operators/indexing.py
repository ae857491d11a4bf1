"""Incremental indexing: changes, supersession, failures, jobs, and the whole run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.functions.spans import split_lines
from corpusq.functions.text import cache_key, let
from corpusq.operators import chunking, outline
from corpusq.operators.embedding import EncoderFactory, embed_keys
from corpusq.operators.filters import latest_per_key, validate_dense
from corpusq.session import cut_lineage, small_side, stage
from corpusq.sources import files as source


def detect_changes(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """new, changed, unchanged or deleted per (repository_id, path), by content hash."""
    keys = ["repository_id", "path"]
    old = known.select(*keys, "file_id", F.col("content_hash").alias("old_hash"))
    new = scanned.select(*keys, F.col("content_hash").alias("new_hash"))
    return old.join(new, keys, "full_outer").withColumn(
        "change",
        F.when(F.col("old_hash").isNull(), F.lit("new"))
        .when(F.col("new_hash").isNull(), F.lit("deleted"))
        .when(F.col("old_hash") == F.col("new_hash"), F.lit("unchanged"))
        .otherwise(F.lit("changed")),
    )


def supersede(
    rows: DataFrame, changed_files: DataFrame, max_files: int | None = None
) -> DataFrame:
    """Rows of changed files turn inactive. Call it on chunks and on vectors alike.

    With ``max_files``, a proven bound, few changed files are broadcast and the big
    tables stay where they are.
    """
    hit = changed_files.select("file_id").distinct().withColumn("_hit", F.lit(True))
    return (
        rows.join(small_side(hit, max_files), "file_id", "left")
        .withColumn("is_active", F.col("is_active") & F.col("_hit").isNull())
        .drop("_hit")
    )


def isolate_failures(rows: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(rows of files without any error, one row per failed file with an error).

    A file is taken only if all its rows are good; one bad file does not stop the job.
    """
    failed = rows.where("error IS NOT NULL").groupBy(key).agg(F.min("error").alias("error"))
    return rows.join(failed.select(key), key, "left_anti").drop("error"), failed


def job_progress(results: DataFrame) -> DataFrame:
    """Totals per job from one row per file: job_id, status, chunks.

    Failed and skipped files count as processed.
    """
    return results.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("files_total"),
        F.sum((F.col("status") != "pending").cast("long")).alias("files_processed"),
        F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks_total"),
    )


def job_history(jobs: DataFrame, repository_id=None, latest_only: bool = False) -> DataFrame:
    """Jobs newest first; with ``latest_only`` one per repository."""
    if repository_id is not None:
        jobs = jobs.where(F.col("repository_id") == F.lit(repository_id))
    if latest_only:
        w = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("job_id"))
        return jobs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id"))


def job_outcome(jobs: DataFrame, errors: DataFrame) -> DataFrame:
    """Finished jobs: completed with the commit they saw, or failed with the message.

    Progress columns stay as they are either way.
    """
    found = errors.groupBy("job_id").agg(F.min("error").alias("_error"))
    failed = F.col("_error").isNotNull()
    return (
        jobs.join(found, "job_id", "left")
        .withColumn("status", F.when(failed, F.lit("failed")).otherwise(F.lit("completed")))
        .withColumn("error_message", F.col("_error"))
        .withColumn("repository_status", F.when(failed, F.lit("failed")).otherwise(F.lit("ready")))
        .withColumn(
            "last_indexed_commit_sha",
            F.when(failed, F.col("last_indexed_commit_sha")).otherwise(F.col("commit_sha")),
        )
        .drop("_error")
    )


def find_orphans(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors without chunk and chunks without vector."""
    c, v = chunks.select("chunk_id"), vectors.select("chunk_id")
    lonely_vectors = v.join(c, "chunk_id", "left_anti").withColumn("side", F.lit("vector"))
    return lonely_vectors.unionByName(
        c.join(v, "chunk_id", "left_anti").withColumn("side", F.lit("chunk"))
    )


def purge_inactive(rows: DataFrame) -> DataFrame:
    return rows.where("is_active")


def list_by_parent(df: DataFrame, key: str, value: object) -> DataFrame:
    """Children of one parent, or of all parents in a DataFrame holding ``key``."""
    if isinstance(value, DataFrame):
        return df.join(value.select(key), key, "left_semi")
    return df.where(F.col(key) == F.lit(value))


# --- the whole run -----------------------------------------------------------------


@dataclass
class IndexTables:
    """State between runs. ``files``: file_id, repository_id, path, language, size_bytes,
    content_hash, is_deleted. ``chunks`` and ``vectors`` carry file_id and is_active. ``folders``
    are staged ones that the tables still read: whoever has stored the tables may drop them."""

    files: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    cache: DataFrame
    folders: list[str] = field(default_factory=list)


FILES = (
    "file_id string, repository_id string, path string, language string, size_bytes long, "
    "content_hash string, is_deleted boolean"
)
CHUNKS = (
    "chunk_id string, file_id string, repository_id string, symbol_name string, symbol_kind string, "
    "start_line int, end_line int, content string, content_tokens int, chunk_type string, "
    "imports array<string>, is_active boolean"
)
VECTORS = (
    "chunk_id string, file_id string, workspace_id string, repository_id string, file_path string, "
    "language string, symbol_kind string, start_line int, end_line int, dense array<float>, "
    "sparse struct<ids:array<bigint>,weights:array<double>>, embedding_version string, is_active boolean"
)
CACHE = (
    "cache_key string, dense array<float>, sparse struct<ids:array<bigint>,weights:array<double>>, "
    "model_id string, written_at timestamp, expires_at timestamp"
)


def empty_tables(spark: SparkSession) -> IndexTables:
    return IndexTables(*[spark.createDataFrame([], s) for s in (FILES, CHUNKS, VECTORS, CACHE)])


def make_chunks(
    changed: DataFrame, max_tokens: int = 512, min_tokens: int = 64, target: int = 256
) -> DataFrame:
    """Chunk rows of new and changed files (decoded text in ``content``).

    With a column ``error``, a file gives at least one row: a row without lines says that the
    file has been read, or why it has not.
    """
    text, language = F.col("content"), F.col("language")
    told = ["error"] if "error" in changed.columns else []

    def pieces(ls: Column) -> Column:
        prose = chunking.markdown_chunks(ls, max_tokens, min_tokens)
        code = let(
            outline.symbols_of(ls, language),
            lambda symbols: chunking.code_chunks(ls, symbols, max_tokens, min_tokens, target),
        )
        return F.when(language == "markdown", prose).when(language.isNotNull(), code)

    modules = F.transform(outline.imports_of(text, language), lambda e: e["module"])
    # Prose and code in one projection: the files are read and cut once.
    rows = (
        changed.withColumn("imports", F.coalesce(modules, F.array().cast("array<string>")))
        .withColumn("_pieces", let(split_lines(text), pieces))
        .select("file_id", "repository_id", "path", "language", "imports", *told, F.inline_outer("_pieces"))
    )
    rows = rows if told else rows.where("start_line IS NOT NULL")
    return rows.select(
        F.sha2(
            F.concat_ws(":", "repository_id", "path", "start_line", "end_line", F.sha2("text", 256)), 256
        ).alias("chunk_id"),
        "file_id",
        "repository_id",
        "path",
        "language",
        "symbol_name",
        "symbol_kind",
        "start_line",
        "end_line",
        F.col("text").alias("content"),
        "content_tokens",
        F.when(language == "markdown", F.lit("prose")).otherwise(F.lit("code")).alias("chunk_type"),
        "imports",
        *told,
    )


def mark_deleted(files: DataFrame, deleted: DataFrame) -> DataFrame:
    return (
        files.join(deleted.withColumn("_gone", F.lit(True)), "file_id", "left")
        .withColumn("is_deleted", F.col("is_deleted") | F.col("_gone").isNotNull())
        .select(*files.columns)
    )


def _newest(scanned: DataFrame) -> DataFrame:
    """One row per (repository_id, path): the newest arrival, where arrivals have a time."""
    if "arrived_at" not in scanned.columns:
        return scanned
    keys = ["repository_id", "path"]
    order = [F.desc("arrived_at"), F.desc(F.sha2(F.col("content").cast("binary"), 256))]
    return latest_per_key(scanned, keys, order).drop("rank", "arrived_at")


def unread_paths(known: DataFrame, problems: DataFrame) -> DataFrame:
    """Known files a scan could not speak for: (repository_id, path, error).

    ``problems`` has files that could not be read and folders (``is_dir``) that could not be
    listed; a folder stands for all that is below it, the empty path for the repository.
    """
    keys = ["repository_id", "path"]
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    folders = problems.where("is_dir").select("repository_id", F.col("path").alias("_folder"), "problem")
    files = problems.where("NOT is_dir").select(*keys, "problem")
    below = known.select(*keys, F.explode(above).alias("_folder")).join(folders, ["repository_id", "_folder"])
    return (
        below.select(*keys, "problem")
        .unionByName(known.select(*keys).join(files, keys))
        .groupBy(*keys)
        .agg(F.min("problem").alias("error"))
    )


@dataclass
class Delta:
    """What a run has found: all that the tables need, nothing of what stays as it is.

    ``counts`` has the number of files per kind of change. Without new or changed files the
    rows, chunks, vectors and entries are empty.
    """

    counts: dict[str, int]
    deleted: DataFrame
    rows: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    entries: DataFrame
    results: DataFrame
    chunk_count: int = 0
    folders: list[str] = field(default_factory=list)
    keyed_vectors: DataFrame | None = None  # ``vectors`` with their cache_key, by which they were joined


def named_file() -> Column:
    """Id of a file that has none yet."""
    return F.sha2(F.concat_ws(":", "repository_id", "path"), 256)


def find_delta(
    scanned: DataFrame,
    known_files: DataFrame,
    cache: DataFrame,
    factory: EncoderFactory,
    model_id: str,
    workspace_id: Column,
    now: Column | None = None,
    repositories: list[str] | None = None,
    read: Callable[[DataFrame], DataFrame] | None = None,
    dim: int | None = None,
    stage_vectors: bool = True,
    **budget: int,
) -> Delta:
    """Compare a scan with the known files, and cut and embed what is new or changed.

    The rules are those of ``index_files``. A file whose second reading fails, differs from the
    first or gives nothing is ``failed``: it keeps its old row, so the next run takes it up.
    Without ``stage_vectors`` the vector rows are joined where they are read, for a caller that
    writes them once: they then lie on disk by key only.
    """
    keys = ["repository_id", "path"]
    for name, kind in (("problem", "string"), ("is_dir", "boolean")):
        if name not in scanned.columns:
            scanned = scanned.withColumn(name, F.lit(None if name == "problem" else False).cast(kind))
    scanned = _newest(scanned)
    contents = read(scanned) if read else scanned
    # All that later steps need of a file but its text.
    seen = cut_lineage(
        source.detect_language(source.content_hash(contents))
        .withColumn("is_text", F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False)))
        .select(*keys, "length", "content_hash", "language", "is_text", "problem", "is_dir")
    )
    spark = seen.sparkSession
    scope = (
        seen.select("repository_id").distinct()
        if repositories is None
        else spark.createDataFrame([(r,) for r in repositories], "repository_id string")
    )
    known = known_files.where("NOT is_deleted").join(scope, "repository_id", "left_semi")
    found = seen.where("problem IS NULL")
    problems = seen.where("problem IS NOT NULL")
    changes = detect_changes(known, found).withColumn("error", F.lit(None).cast("string"))
    if not problems.isEmpty():
        unread = unread_paths(known, problems)
        fresh = problems.where("NOT is_dir").join(known.select(keys), keys, "left_anti")
        changes = (
            changes.drop("error")
            .join(unread, keys, "left")
            .withColumn("error", F.when(F.col("change") == "deleted", F.col("error")))
            .withColumn("change", F.when(F.col("error").isNotNull(), F.lit("failed")).otherwise(F.col("change")))
            .unionByName(
                fresh.select(*keys, F.lit("failed").alias("change"), F.col("problem").alias("error")),
                allowMissingColumns=True,
            )
        )
    changes = cut_lineage(changes)
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    deleted = changes.where("change = 'deleted'").select("file_id")
    named = F.coalesce("file_id", named_file())
    if not counts.get("new") and not counts.get("changed"):
        results = changes.select(
            named.alias("file_id"), "repository_id", "path", F.col("change").alias("status"),
            F.lit(0).cast("long").alias("chunks"), "error",
        )
        nothing = [spark.createDataFrame([], s) for s in (FILES, CHUNKS, VECTORS, CACHE)]
        return Delta(counts, deleted, *nothing, results)
    wanted = changes.where("change IN ('new', 'changed')").select(*keys, named.alias("file_id"))
    taken = cut_lineage(found.join(wanted, keys))
    readable = taken.where("is_text AND language IS NOT NULL").select(
        *keys, "file_id", "language", F.col("content_hash").alias("_first_hash")
    )
    # Its rows are counted: texts stay where they are while their paths are matched.
    count = counts.get("new", 0) + counts.get("changed", 0)
    again = scanned.join(small_side(readable, count), keys)
    again = (read(again) if read else again).withColumn(
        "error",
        F.coalesce(
            F.col("problem"),
            F.when(F.sha2(F.col("content").cast("binary"), 256) != F.col("_first_hash"), F.lit("changed while it was read")),
        ),
    )
    # A text that is not the compared one is not cut.
    again = again.withColumn("content", F.when(F.col("error").isNull(), F.col("content").cast("binary")).otherwise(F.lit(b"")))
    folders: list[str] = []
    made = make_chunks(source.decode_text(again), **budget)
    cut = stage(made.withColumn("cache_key", cache_key(F.col("content"), model_id)), folders)
    chunks = cut.where("start_line IS NOT NULL").drop("error")
    gone = readable.select("file_id").join(cut.select("file_id").distinct(), "file_id", "left_anti")
    unread = cut.where("error IS NOT NULL").select("file_id", "error").unionByName(
        gone.withColumn("error", F.lit("gone while it was read"))
    )
    # Texts do not move with their vectors; both meet again in the tables, by chunk_id.
    vectors, entries = embed_keys(chunks, factory, cache, model_id, now, text="content", folders=folders)
    embedded = chunks.drop("content", "content_tokens", "imports", "symbol_name").join(vectors.drop("error"), "cache_key", "left")
    if stage_vectors:
        embedded = stage(embedded, folders)
    # Vectors are checked by key; only keys and what is wrong with them meet the files.
    checked = validate_dense(vectors, dim if dim is not None else F.size("dense"), strict=False).select(
        "cache_key", F.lit(True).alias("_held"), F.coalesce("error", F.concat(F.lit("bad dense vector: "), "dense_problem")).alias("error")
    )
    told = chunks.select("file_id", "cache_key").join(checked, "cache_key", "left").withColumn(
        "error", F.when(F.col("_held"), F.col("error")).otherwise(F.lit("bad dense vector: dimension"))
    )
    failed = told.where("error IS NOT NULL").groupBy("file_id").agg(F.min("error").alias("error"))
    failed = cut_lineage(failed.unionByName(unread))
    failures = failed.count()

    def good(rows: DataFrame) -> DataFrame:
        return rows.join(small_side(failed.select("file_id"), failures), "file_id", "left_anti") if failures else rows

    # The hash that was compared stays with the row: a file that changes on disk later,
    # even during this run, differs from it and is taken up by the next run.
    rows = cut_lineage(
        good(taken).select(
            "file_id", "repository_id", "path", "language",
            F.col("length").alias("size_bytes"), "content_hash", F.lit(False).alias("is_deleted"),
        )
    )
    new_chunks = good(chunks).select(
        "chunk_id", "file_id", "repository_id", "symbol_name", "symbol_kind", "start_line", "end_line",
        "content", "content_tokens", "chunk_type", "imports", F.lit(True).alias("is_active"),
    )
    keyed_vectors = good(embedded).select(
        "cache_key", "chunk_id", "file_id", workspace_id.alias("workspace_id"), "repository_id",
        F.col("path").alias("file_path"), "language", "symbol_kind", "start_line", "end_line",
        "dense", "sparse", F.col("model_id").alias("embedding_version"), F.lit(True).alias("is_active"),
    )
    made = good(chunks).groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    skipped = taken.where("NOT is_text OR language IS NULL").select("file_id", F.lit(True).alias("_skipped"))
    results = (
        changes.withColumn("file_id", named)
        .join(made, "file_id", "left")
        .join(failed.select("file_id", F.col("error").alias("_failure")), "file_id", "left")
        .join(skipped, "file_id", "left")
        .select(
            "file_id", "repository_id", "path",
            F.when(F.col("_failure").isNotNull(), F.lit("failed"))
            .when(F.col("_skipped"), F.lit("skipped"))
            .otherwise(F.col("change"))
            .alias("status"),
            F.coalesce("chunks", F.lit(0)).alias("chunks"),
            F.coalesce("_failure", "error").alias("error"),
        )
    )
    return Delta(
        counts, deleted, rows, new_chunks, keyed_vectors.drop("cache_key"), entries, results, chunks.count(), folders, keyed_vectors
    )


def index_files(
    scanned: DataFrame,
    tables: IndexTables,
    factory: EncoderFactory,
    model_id: str,
    workspace_id: Column,
    now: Column | None = None,
    repositories: list[str] | None = None,
    read: Callable[[DataFrame], DataFrame] | None = None,
    dim: int | None = None,
    **budget: int,
) -> tuple[IndexTables, DataFrame]:
    """One run over scanned files (repository_id, path, content binary, length).

    The scan speaks for ``repositories`` (by default those it holds rows of): files of others
    are not looked at, files gone from these turn deleted. Rows may carry ``problem`` (and
    ``is_dir``): such files, and all known ones below such a folder, are ``failed`` and keep
    their state. With ``arrived_at``, the newest row of a path counts. With ``read``, rows have
    no content yet: all files are read once to compare hashes, and only new and changed ones
    again.

    Gives the next state and one result row per file (status, chunks, error). Unchanged files
    skip all later work; a file whose second reading or embedding failed, or whose vectors are
    not finite or not of ``dim`` numbers, keeps its old row, chunks and vectors, so the next run
    tries it again. Files without a language or not UTF-8 are kept as known but ``skipped``. What
    several results read is written once to the checkpoint folder. ``persisted.run_index`` does
    the same on published tables, touching only what a run changes.
    """
    d = find_delta(
        scanned, tables.files, tables.cache, factory, model_id, workspace_id, now, repositories, read, dim, **budget
    )
    if not d.counts.get("new") and not d.counts.get("changed"):
        # Nothing was read, cut or embedded: only the rows of deleted files flip.
        gone = d.counts.get("deleted", 0)
        state = IndexTables(
            mark_deleted(tables.files, d.deleted),
            supersede(tables.chunks, d.deleted, gone).select(*tables.chunks.columns),
            supersede(tables.vectors, d.deleted, gone).select(*tables.vectors.columns),
            tables.cache,
            tables.folders,
        )
        return state, d.results
    replaced = d.rows.select("file_id").unionByName(d.deleted)
    kept_files = mark_deleted(tables.files.join(d.rows.select("file_id"), "file_id", "left_anti"), d.deleted)
    # Counted on what the checkpoints hold, so no file is read again.
    file_count = sum(d.counts.get(change, 0) for change in ("new", "changed", "deleted"))

    def renewed(old: DataFrame, new: DataFrame) -> DataFrame:
        # An id comes back when a file returns to an earlier text: the new row wins.
        ids = small_side(new.select("chunk_id"), d.chunk_count)
        kept = supersede(old, replaced, file_count).join(ids, "chunk_id", "left_anti")
        return kept.select(*old.columns).unionByName(new)

    state = IndexTables(
        files=kept_files.select(*d.rows.columns).unionByName(d.rows),
        chunks=renewed(tables.chunks, d.chunks),
        vectors=renewed(tables.vectors, d.vectors),
        cache=tables.cache.unionByName(d.entries.select(*tables.cache.columns)),
        folders=[*tables.folders, *d.folders],
    )
    return state, d.results


def index_corpus(
    spark: SparkSession,
    root: str,
    repository_id: str,
    tables: IndexTables,
    factory: EncoderFactory,
    model_id: str,
    workspace_id: str,
    ignore_rules: list[str] | None = None,
    max_mb: float | None = None,
    max_bytes: int | None = None,
    **budget: int,
) -> tuple[IndexTables, DataFrame]:
    """Scan a folder and bring the tables up to date with it; other repositories stay as they are.

    Sizes come from the listing. A repository over ``max_mb``, if that is given, keeps its
    state and gives one failed row; so do files over ``max_bytes``.
    """
    listed = source.list_files(spark, root, max_bytes=max_bytes)
    if ignore_rules:
        listed = source.apply_ignore_rules(listed, ignore_rules)
    listed = listed.withColumn("repository_id", F.lit(repository_id))
    if max_mb is not None:
        rejected = source.check_corpus_size(listed, max_mb)[1].first()
        if rejected is not None:
            message = f"repository of {rejected['total_bytes']} bytes is over {max_mb} MB"
            row = [(None, repository_id, None, "failed", 0, message)]
            return tables, spark.createDataFrame(
                row, "file_id string, repository_id string, path string, status string, chunks long, error string"
            )
    return index_files(
        listed, tables, factory, model_id, F.lit(workspace_id), repositories=[repository_id],
        read=lambda files: source.read_files(files, root), **budget,
    )
