"""Corpus files: scan, ignore rules, decoding, hashes, language."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.plugins import REGISTRY, LanguageRegistry
from corpusq.session import cut_lineage

# Fixed value: directories never entered.
EXCLUDED_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", "target"]


LISTED = "path string, is_dir boolean, length long, problem string"


def list_files(
    spark: SparkSession, root: str, excluded_dirs: list[str] = EXCLUDED_DIRS, max_bytes: int | None = None
) -> DataFrame:
    """Files below ``root``: path (relative), length, problem, is_dir; no content is read.

    Directories are listed level by level in Spark tasks; excluded ones are never entered and
    symbolic links are skipped. A directory that cannot be listed is a row with ``is_dir`` and
    its ``problem``; a file over ``max_bytes`` (no limit unless asked for) is a row with a
    problem too, so that nothing that is there is taken for gone.
    """
    root = os.path.abspath(root) if "://" not in root else root.rstrip("/")
    skip = set(excluded_dirs)

    def list_dirs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                fs, inner = pafs.FileSystem.from_uri(folder)
                prefix = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
                local = isinstance(fs, pafs.LocalFileSystem)
                try:
                    found = fs.get_file_info(pafs.FileSelector(inner))
                except OSError as exc:
                    rows = [(folder, True, None, f"cannot be listed: {exc}")]
                    yield pd.DataFrame(rows, columns=["path", "is_dir", "length", "problem"])
                    continue
                rows = [
                    (
                        prefix + f.path,
                        f.type == pafs.FileType.Directory,
                        f.size or 0,
                        f"over {max_bytes} bytes"
                        if max_bytes is not None and f.type == pafs.FileType.File and f.size > max_bytes
                        else None,
                    )
                    for f in found
                    if f.type in (pafs.FileType.Directory, pafs.FileType.File)
                    and not (local and os.path.islink(f.path))
                    and not (f.type == pafs.FileType.Directory and f.base_name in skip)
                ]
                yield pd.DataFrame(rows, columns=["path", "is_dir", "length", "problem"])

    level = spark.createDataFrame([(root,)], "path string")
    levels: list[DataFrame] = []
    cores = spark.sparkContext.defaultParallelism
    while True:
        listed = cut_lineage(level.mapInPandas(list_dirs, LISTED))
        levels.append(listed.where("NOT is_dir OR problem IS NOT NULL"))
        level = listed.where("is_dir AND problem IS NULL").select("path").repartition(cores, "path")
        if level.isEmpty():
            break
    relative = F.expr(f"substring(path, {len(root) + 2})")
    return reduce(DataFrame.unionByName, levels).withColumn("path", relative)


# Bytes of a file that a task holds at once; longer files are read in pieces of this size.
PIECE_BYTES = 8 << 20


def read_files(listed: DataFrame, root: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``listed`` with ``content``, read where the tasks run; other columns are kept.

    A file that cannot be read has a null content and says so in ``problem``; rows that
    already have a problem are passed through unread. Files listed as longer than
    ``piece_bytes`` are read in pieces, by several tasks, and joined again outside of Python:
    only there does a content have to fit into memory, and only if it is used.
    """
    root = os.path.abspath(root) if "://" not in root else root.rstrip("/")
    spark = listed.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, spark_partitions(spark))
    # Both ways below read this list, which has no contents.
    found = cut_lineage(listed.drop("content"))
    schema = T.StructType([*found.schema.fields, T.StructField("content", T.BinaryType())])
    long = F.col("problem").isNull() & (F.coalesce("length", F.lit(0)) > piece_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = batch.column(names.index("_at")).to_pylist() if "_at" in names else [None] * batch.num_rows
            paths = batch.column(names.index("path")).to_pylist()
            lengths = batch.column(names.index("length")).to_pylist()
            problems = batch.column(names.index("problem")).to_pylist()
            for i, (path, length, problem, start) in enumerate(zip(paths, lengths, problems, at, strict=True)):
                # One file or piece at a time: a batch of contents need not fit into memory.
                content = None
                if problem is None:
                    try:
                        # The last piece goes to the end, should the file have grown since it was listed.
                        last = start is None or start + piece_bytes >= length
                        content = _content(f"{root}/{path}", start, None if last else piece_bytes)
                    except OSError as exc:
                        problem = f"cannot be read: {exc}"
                row = {n: batch.column(k).slice(i, 1) for k, n in enumerate(names)}
                row["problem"] = pa.array([problem], row["problem"].type)
                row["content"] = pa.array([content], pa.binary())
                yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

    whole = found.where(~long).repartition(tasks, "path").mapInArrow(read, schema)
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(piece_bytes).cast("long"))
    cut = found.where(long).withColumn("_file", F.monotonically_increasing_id()).withColumn("_at", F.explode(starts))
    pieces = cut.repartition(tasks, "_file", "_at").mapInArrow(read, T.StructType([*cut.schema.fields, schema["content"]]))
    joined = pieces.groupBy("_file").agg(
        *[F.first(f"`{c}`").alias(c) for c in found.columns if c != "problem"],
        F.min("problem").alias("problem"),
        F.expr("CASE WHEN min(problem) IS NULL THEN listagg(content) WITHIN GROUP (ORDER BY _at) END").alias("content"),
    )
    return whole.unionByName(joined.select(*schema.names))


def _content(path: str, start: int | None, most: int | None) -> bytes:
    """The file, or what it holds from ``start``: ``most`` bytes or all."""
    fs, inner = pafs.FileSystem.from_uri(path)
    if start is None:
        with fs.open_input_stream(inner) as stream:
            return stream.read()
    with fs.open_input_file(inner) as file:
        left = max(0, file.size() - start)
        return file.read_at(left if most is None else min(most, left), start)


def scan_corpus(
    spark: SparkSession,
    root: str,
    max_bytes: int | None = None,
    excluded_dirs: list[str] = EXCLUDED_DIRS,
) -> DataFrame:
    """Files below ``root``: path (relative), content, length, problem.

    Names that begin with a dot or an underscore count, which Spark's own file
    listing would hide. What could not be listed or read is a row with its problem.
    """
    listed = list_files(spark, root, excluded_dirs, max_bytes)
    return read_files(listed, root).select("path", "content", "length", "problem", "is_dir")


def spark_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scan_corpus_hadoop(
    spark: SparkSession,
    root: str,
    max_bytes: int | None = None,
    excluded_dirs: list[str] = EXCLUDED_DIRS,
) -> DataFrame:
    """The same through Spark's binary file source, for stores only Hadoop can reach.

    A length filter, if asked for, reaches the source, which skips the content of larger
    files. A failed read stops the job. Such a listing follows links and hides names that
    begin with a dot or underscore.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root.rstrip("/"))
    )
    if max_bytes is not None:
        listed = listed.where(F.col("length") <= max_bytes)
    plain_root = re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/"))
    relative = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    relative = F.regexp_replace(relative, "^" + re.escape(plain_root) + "/", "")
    parts = F.split(relative, "/")
    excluded = F.array(*[F.lit(d) for d in excluded_dirs])
    return (
        listed.withColumn("path", relative)
        .where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), excluded))
        .select("path", "content", "length")
    )


def rule_pattern(rule: str) -> tuple[str, bool] | None:
    """One ignore rule as (regular expression over the relative path, keep?)."""
    rule = rule.rstrip("\n").rstrip("\r")
    if not rule.strip() or rule.startswith("#"):
        return None
    keep = rule.startswith("!")
    rule = rule[1:] if keep else rule
    rule = rule.rstrip()
    if rule.startswith("\\"):
        rule = rule[1:]
    directory = rule.endswith("/")
    body = rule.strip("/")
    anchored = "/" in rule.rstrip("/")
    out = ""
    while body:
        if body.startswith("/**/"):
            out, body = out + "/(?:.*/)?", body[4:]
        elif body.startswith("**/"):
            out, body = out + "(?:.*/)?", body[3:]
        elif body == "**" or body.startswith("/**"):
            out, body = out + ("/.*" if body.startswith("/") else ".*"), body[3 if body.startswith("/") else 2:]
        elif body[0] == "*":
            out, body = out + "[^/]*", body[1:]
        elif body[0] == "?":
            out, body = out + "[^/]", body[1:]
        elif body[0] == "[" and "]" in body[2:]:
            end = body.index("]", 2)
            inside = body[1:end].replace("\\", "\\\\")
            out, body = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", body[end + 1 :]
        else:
            out, body = out + re.escape(body[0]), body[1:]
    head = "^" if anchored else "^(?:.*/)?"
    tail = "/.*$" if directory else "(?:/.*)?$"
    return head + out + tail, keep


def apply_ignore_rules(files: DataFrame, rules: list[str], path: str = "path") -> DataFrame:
    """Drop files that the root ignore file names; the last matching rule wins."""
    ignored = F.lit(False)
    for rule in rules:
        parsed = rule_pattern(rule)
        if parsed is not None:
            pattern, keep = parsed
            ignored = F.when(F.col(path).rlike(pattern), F.lit(not keep)).otherwise(ignored)
    return files.where(~ignored)


def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Strict UTF-8: files that do not decode are left out."""
    as_text = F.col(content).cast("string")
    return files.where(F.is_valid_utf8(as_text)).withColumn(content, as_text)


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))


def language_of(path: Column, head: Column, registry: LanguageRegistry = REGISTRY) -> Column:
    """By extension (case-sensitive), else by the interpreter of a ``#!`` first line."""

    def lookup(values: dict[str, str], key: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
        return F.try_element_at(table, key)

    extension = F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1)
    first = F.substring_index(head, "\n", 1)
    words = F.filter(F.split(F.regexp_extract(first, r"^#!(.*)$", 1), r"\s+"), lambda w: w != "")
    base = lambda word: F.substring_index(word, "/", -1)
    program = F.when(base(F.get(words, F.lit(0))) == "env", F.try_element_at(words, F.lit(-1))).otherwise(
        F.get(words, F.lit(0))
    )
    return F.coalesce(
        lookup(registry.extension_map(), extension), lookup(registry.interpreter_map(), base(program))
    )


def detect_language(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Adds ``language``; Markdown is decided by its extension first."""
    markdown = F.lower(F.col(path)).rlike(r"\.(md|markdown)$")
    return files.withColumn(
        "language",
        F.when(markdown, F.lit("markdown")).otherwise(language_of(F.col(path), F.col(content))),
    )


def check_corpus_size(
    files: DataFrame, max_mb: float, size: str = "length"
) -> tuple[DataFrame, DataFrame]:
    """(files of repositories within the cap, rejected repositories with their bytes).

    Sizes are added up before the shuffle. The rejected list has one row per
    repository over the cap, so the anti join is decided by AQE on its real size.
    """
    totals = files.groupBy("repository_id").agg(F.sum(size).alias("total_bytes"))
    rejected = totals.where(F.col("total_bytes") > max_mb * 1024 * 1024)
    return files.join(rejected, "repository_id", "left_anti"), rejected
