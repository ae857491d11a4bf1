"""Scan, change detection, embedding cache, whole indexing runs, tables."""

import pytest
from pyspark.sql import functions as F

from corpusq import plugins
from corpusq.functions.encoders import hashed_encoder
from corpusq.functions.text import cache_key, slugify
from corpusq.operators import embedding, filters, indexing
from corpusq.sources import files as source
from corpusq.sources import tables as store


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "node_modules").mkdir(parents=True)
    (root / "src").mkdir()
    (root / "main.py").write_text("import os\n\n\ndef main():\n    return os.name\n")
    (root / "README.md").write_text("# Title\n\nSome words.\n\n## More\n\nOther words.\n")
    (root / ".gitignore").write_text("ignored.py\n")
    (root / "ignored.py").write_text("x = 1\n")
    (root / "node_modules" / "big.js").write_text("function f() {}\n")
    (root / "src" / "bin.py").write_bytes(b"\xff\xfe")
    (root / "src" / "huge.py").write_text("x" * 2000)
    return root


def scan(spark, root, **kwargs):
    df = source.scan_corpus(spark, str(root), **kwargs)
    return source.apply_ignore_rules(df, ["ignored.py"]).withColumn("repository_id", F.lit("r"))


def test_scan_prunes_directories_rules_and_size(spark, repo):
    rows = scan(spark, repo, max_bytes=1000).collect()
    assert {r.path for r in rows if not r.problem} == {"main.py", "README.md", ".gitignore", "src/bin.py"}
    assert {r.path: r.problem for r in rows if r.problem} == {"src/huge.py": "over 1000 bytes"}
    assert {r.length for r in scan(spark, repo).collect() if r.path == "src/huge.py"} == {2000}
    assert "src/bin.py" not in {r.path for r in source.decode_text(scan(spark, repo)).collect()}


def run(spark, root, tables, factory=None, calls=None):
    return indexing.index_files(
        scan(spark, root, max_bytes=1000), tables, factory or hashed_encoder(16), "m", F.lit("w")
    )


def statuses(results):
    return {r.path: (r.status, r.chunks) for r in results.collect()}


def test_first_run_unchanged_rerun_and_supersession(spark, repo):
    tables, results = run(spark, repo, indexing.empty_tables(spark))
    first = statuses(results)
    assert first["README.md"] == ("new", 2) and first["main.py"] == ("new", 2)
    assert first[".gitignore"] == ("skipped", 0) and first["src/bin.py"] == ("skipped", 0)
    assert first["src/huge.py"] == ("failed", 0)
    assert tables.chunks.where("is_active").count() == tables.vectors.where("is_active").count() == 4

    def refuse():
        raise AssertionError("the encoder must not be built")

    again, results = run(spark, repo, tables, refuse)
    assert {s for p, (s, _) in statuses(results).items() if p != "src/huge.py"} == {"unchanged"}
    assert again.chunks.count() == 4

    (repo / "README.md").write_text("# Title\n\nSome words.\n\n## More\n\nChanged.\n")
    (repo / "main.py").unlink()
    third, results = run(spark, repo, tables)
    assert statuses(results)["README.md"] == ("changed", 2) and statuses(results)["main.py"][0] == "deleted"
    active = {r.content for r in third.chunks.where("is_active").collect()}
    assert active == {"# Title\n\nSome words.\n\n", "## More\n\nChanged.\n"}
    alive = lambda t: {r.chunk_id for r in t.where("is_active").collect()}
    assert alive(third.vectors) == alive(third.chunks)
    assert third.files.where("is_deleted").count() == 1
    assert indexing.find_orphans(third.chunks, third.vectors).count() == 0


def test_a_failing_file_is_isolated_and_tried_again(spark, repo):
    def factory():
        encode = hashed_encoder(16)()

        def sometimes(texts):
            if any("Other" in t for t in texts):
                raise RuntimeError("model refused")
            return encode(texts)

        return sometimes

    tables, results = run(spark, repo, indexing.empty_tables(spark), factory)
    assert statuses(results)["README.md"] == ("failed", 0)
    assert {r.path for r in tables.files.collect()} == {"main.py", ".gitignore", "src/bin.py"}
    _, results = run(spark, repo, tables)
    assert statuses(results)["README.md"] == ("new", 2)
    assert statuses(results)["main.py"][0] == "unchanged"


def rows_of(spark, *rows):
    """Scanned rows (repository, path, text or None, problem, is_dir)."""
    data = [(r, p, t.encode() if t is not None else None, len(t or ""), e, d) for r, p, t, e, d in rows]
    schema = "repository_id string, path string, content binary, length long, problem string, is_dir boolean"
    return spark.createDataFrame(data, schema)


def index(spark, tables, *rows, **options):
    return indexing.index_files(rows_of(spark, *rows), tables, hashed_encoder(16), "m", F.lit("w"), **options)


def test_a_run_speaks_for_its_repositories_only(spark):
    tables, _ = index(spark, indexing.empty_tables(spark), ("a", "one.md", "# One\n\nText.\n", None, False))
    tables, results = index(spark, tables, ("b", "two.md", "# Two\n\nText.\n", None, False))
    assert statuses(results) == {"two.md": ("new", 1)}
    assert tables.files.where("is_deleted").count() == 0 and tables.chunks.where("is_active").count() == 2
    # A repository without any file left is named by the caller.
    tables, results = index(spark, tables, repositories=["a"])
    assert statuses(results) == {"one.md": ("deleted", 0)}
    assert [r.repository_id for r in tables.chunks.where("is_active").collect()] == ["b"]


def test_what_cannot_be_read_keeps_its_state(spark):
    text = "# Words\n\nText.\n"
    paths = ["a.md", "in/b.md", "in/deep/c.md", "other/d.md", "e.md"]
    tables, _ = index(spark, indexing.empty_tables(spark), *[("r", p, text, None, False) for p in paths])
    after, results = index(
        spark, tables,
        ("r", "a.md", None, "cannot be read: x", False), ("r", "in", None, "cannot be listed: y", True),
        ("r", "e.md", text, None, False), ("r", "new.md", None, "cannot be read: z", False),
    )
    got = {r.path: (r.status, r.error) for r in results.collect()}
    assert got == {
        "a.md": ("failed", "cannot be read: x"), "in/b.md": ("failed", "cannot be listed: y"),
        "in/deep/c.md": ("failed", "cannot be listed: y"), "other/d.md": ("deleted", None),
        "e.md": ("unchanged", None), "new.md": ("failed", "cannot be read: z"),
    }
    assert {r.path for r in after.files.where("NOT is_deleted").collect()} == set(paths) - {"other/d.md"}
    assert after.chunks.where("is_active").count() == 4


def test_newest_arrival_of_a_path_counts(spark):
    rows = rows_of(spark, ("r", "a.md", "# Old\n", None, False), ("r", "a.md", "# New\n", None, False))
    timed = rows.withColumn("arrived_at", F.when(F.col("content") == F.lit(b"# New\n"), 2).otherwise(1))
    tables, results = indexing.index_files(timed, indexing.empty_tables(spark), hashed_encoder(16), "m", F.lit("w"))
    assert tables.files.count() == results.count() == 1
    assert [r.content for r in tables.chunks.where("is_active").collect()] == ["# New\n"]


def test_bad_vectors_fail_their_file(spark):
    def factory():
        encode = hashed_encoder(16)()

        def broken(texts):
            dense, *rest = encode(texts)
            return [d if "Good" in t else [float("nan")] * 16 for d, t in zip(dense, texts, strict=True)], *rest

        return broken

    rows = rows_of(spark, ("r", "a.md", "# Good\n", None, False), ("r", "b.md", "# Bad\n", None, False))
    tables, results = indexing.index_files(rows, indexing.empty_tables(spark), factory, "m", F.lit("w"))
    assert {r.path: (r.status, r.error) for r in results.collect()} == {
        "a.md": ("new", None), "b.md": ("failed", "bad dense vector: not finite"),
    }
    assert tables.vectors.count() == 1


def test_corpus_run_reads_changed_files_again_only(spark, repo, monkeypatch):
    reads = spark.sparkContext.accumulator(0)
    plain = source.read_files

    def counted(listed, root):
        def count(batches):
            for batch in batches:
                reads.add(len(batch))
                yield batch

        return plain(listed.mapInPandas(count, listed.schema), root)

    monkeypatch.setattr(source, "read_files", counted)
    start = indexing.empty_tables(spark)
    tables, _ = indexing.index_corpus(spark, str(repo), "r", start, hashed_encoder(16), "m", "w")
    first = reads.value
    # Six files for their hashes; the texts of the readable ones once more.
    assert first <= 6 + 4
    (repo / "README.md").write_text("# Title\n\nOther.\n")
    _, results = indexing.index_corpus(spark, str(repo), "r", tables, hashed_encoder(16), "m", "w")
    assert statuses(results)["README.md"] == ("changed", 1)
    assert reads.value - first == 6 + 1
    same, results = indexing.index_corpus(spark, str(repo), "r", tables, hashed_encoder(16), "m", "w", max_mb=0)
    assert same is tables and [(r.status, r.path) for r in results.collect()] == [("failed", None)]


def test_cache_is_asked_first_and_duplicates_encode_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def factory():
        encode = hashed_encoder(4)()

        def counted(texts):
            seen.add(len(texts))
            return encode(texts)

        return counted

    texts = spark.createDataFrame([(1, "foo  bar"), (2, "foo bar"), (3, "baz")], "id long, text string")
    cache = spark.createDataFrame([], indexing.CACHE)
    rows, entries = embedding.embed_batch(texts, factory, cache, "m")
    assert rows.where("dense IS NOT NULL").count() == 3 and entries.count() == 2 and seen.value == 2
    rows, entries = embedding.embed_batch(texts, factory, entries, "m")
    assert rows.where("dense IS NOT NULL").count() == 3 and entries.count() == 0 and seen.value == 2


def test_cache_keys(spark):
    row = spark.range(1).select(
        cache_key(F.lit(" foo \t bar\n"), "m").alias("a"), cache_key(F.lit("foo bar"), "m").alias("b"),
        cache_key(F.lit("foo bar"), "n").alias("c"),
    ).first()
    assert row.a == row.b != row.c


def test_ignore_rules(spark):
    paths = ["a.log", "x/a.log", "keep.log", "build/x", "src/build/x", "docs/a/b.txt", "docs/b.txt", "q1.c", "q12.c"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rules = ["*.log", "!keep.log", "/build/", "docs/**/b.txt", "q?.c", "", "# note"]
    assert {r.path for r in source.apply_ignore_rules(df, rules).collect()} == {"keep.log", "src/build/x", "q12.c"}


def test_languages(spark):
    cases = {
        "a.py": "python", "a.tsx": "typescript", "A.PY": None, "x.Markdown": "markdown", "run": "python", ".py": None, "b.go": "go",
    }
    df = spark.createDataFrame([(p, "#!/usr/bin/env python3\n" if p == "run" else "text") for p in cases], "path string, content string")
    assert {r.path: r.language for r in source.detect_language(df).collect()} == cases


def test_language_registry_rejects_duplicates():
    registry = plugins.default_registry()
    with pytest.raises(plugins.LanguageError):
        registry.register(plugins.Language("python", (".pyx",)))
    with pytest.raises(plugins.LanguageError):
        registry.register(plugins.Language("cython", (".py",)))
    with pytest.raises(plugins.LanguageError):
        registry.get("cobol")
    assert registry.by_extension(".zig") is None


def test_repo_urls(spark):
    cases = {
        "https://host/x": None, "ssh://git@host/x": None, "https://host:443/x": None, "http://host/x": "scheme",
        "git@host:org/x": "scheme", "https:///x": "host", "https://u:p@h/x": "password", "ssh://u:p@h/x": "password",
        "https://u@h/x": "username", "https://h:80/x": "port", "ssh://h:443/x": "port", "HTTPS://h/x": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.problem for r in filters.validate_repo_url(df).collect()} == cases


def test_addresses(spark):
    cases = {
        "8.8.8.8": "public", "10.1.2.3": "private", "127.0.0.1": "loopback", "169.254.169.254": "link_local",
        "224.0.0.1": "multicast", "240.0.0.1": "reserved", "0.0.0.0": "unspecified", "172.31.0.1": "private",
        "172.32.0.1": "public", "::1": "loopback", "::": "unspecified", "fe80::1": "link_local", "ff02::1": "multicast",
        "fd00::1": "private", "2606:4700::1": "public", "1.2.3": "invalid", "300.1.1.1": "invalid",
    }
    df = spark.createDataFrame([(i,) for i in cases], "ip string")
    assert {r.ip: r.ip_class for r in filters.classify_ip(df).collect()} == cases


def test_slugs(spark):
    df = spark.createDataFrame([(" My  Team! ",), ("---",), ("Ünï",)], "n string")
    assert [r.s for r in df.select(slugify(F.col("n")).alias("s")).collect()] == ["my-team", "workspace", "n"]


def test_bad_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [float("nan"), 1.0]), (4, None)], "id int, dense array<double>")
    rows = filters.validate_dense(df, 2, strict=False).orderBy("id").collect()
    assert [r.dense_problem for r in rows] == [None, "dimension", "not finite", "dimension"]
    with pytest.raises(Exception, match="dimension"):
        filters.validate_dense(df.where("id = 2"), 2).collect()


def test_upsert_refuses_a_foreign_row(spark):
    schema = "chunk_id long, workspace_id string, v int"
    current = spark.createDataFrame([(1, "w", 1), (2, "w", 1)], schema)
    rows = store.upsert_vectors(current, spark.createDataFrame([(2, "w", 2), (3, "w", 2)], schema), "w", max_ids=2)
    assert {(r.chunk_id, r.v) for r in rows.collect()} == {(1, 1), (2, 2), (3, 2)}
    assert store.upsert_vectors(current, spark.createDataFrame([], schema), "w").count() == 2
    with pytest.raises(Exception, match="another workspace"):
        store.upsert_vectors(current, spark.createDataFrame([(9, "other", 2)], schema), "w").collect()


def test_deletes(spark):
    schema = "id long, workspace_id string, repository_id string"
    df = spark.createDataFrame([(1, "w", "r"), (2, "w", None), (3, "x", "r")], schema)
    assert {r.id for r in store.delete_by_filter(df, "w", "r").collect()} == {2, 3}
    left = store.delete_cascade(df.where("id = 1"), max_ids=1, files=df, vectors=df)
    assert {r.id for r in left["vectors"].collect()} == {2}


def test_versions_sort_by_number_and_move_at_once(spark, tmp_path):
    table = store.VersionedTable(spark, "tv", str(tmp_path))
    for n in (2, 10):
        table.write(spark.range(n), n)
        table.activate(n)
    assert table.versions() == [2, 10] and table.active().count() == 10
    table.activate(2)
    assert table.active().count() == 2


def test_job_outcome_keeps_progress(spark):
    jobs = spark.createDataFrame([(1, "embedding", 5, "new", "old"), (2, "embedding", 7, "new", "old")],
                                 "job_id int, status string, files_processed int, commit_sha string, last_indexed_commit_sha string")
    errors = spark.createDataFrame([(2, "boom")], "job_id int, error string")
    rows = indexing.job_outcome(jobs, errors).orderBy("job_id").collect()
    assert [(r.status, r.repository_status, r.last_indexed_commit_sha, r.files_processed, r.error_message) for r in rows] == [
        ("completed", "ready", "new", 5, None), ("failed", "failed", "old", 7, "boom")]


def test_cache_vectors_do_not_move_before_their_keys_are_found(spark, tmp_path):
    rows = [(f"k{i}", [float(i)] * 4, written, expires) for i in range(20) for written, expires in ((1, 9), (2, 5 if i % 2 else 9))]
    rows += [("k0", [7.0] * 4, 2, 9), ("other", [1.0] * 4, 1, 9)]
    shape = "cache_key string, dense array<double>, written_at int, expires_at int"
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    keys = spark.createDataFrame([(f"k{i}",) for i in (0, 1, 2, 2, 99)], "cache_key string")
    found = store.read_cache(keys, cache, F.lit(6))
    assert sorted((r.cache_key, r.written_at) for r in found.collect()) == [("k0", 2), ("k2", 2)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin") < plan.index("FileScan parquet")
    assert plan.count("Exchange hashpartitioning") == 1
    assert store.read_cache(keys.where("false"), cache, F.lit(6)).count() == 0
