"""Findings of the fourth round."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from corpusq import plans, session
from corpusq.functions.encoders import hashed_encoder
from corpusq.operators import outline, persisted
from corpusq.plugins import ECMASCRIPT
from corpusq.sources.published import PublishedTables


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def _typescript(spark, text):
    return spark.createDataFrame([(1, "typescript", text)], "file_id long, language string, content string")


def test_lines_with_strings_are_found_once_per_file(spark):
    text = "".join(f"import {{ a{i},\n  b as c{i} }} from 'm{i}'; let x{i} = 'y'\n" for i in range(400))
    edges = outline.import_edges(_typescript(spark, text))
    # Each step of each statement's search used to look through all lines for strings.
    assert _plan(edges).count(outline.STRING + ")") == 1
    got = [(r["module"], r["names"], r["line"]) for r in edges.collect()]
    assert sorted(got, key=lambda r: r[2]) == [(f"m{i}", [f"a{i}", f"c{i}"], 2 * i + 1) for i in range(400)]


def test_lexemes_are_cut_by_one_scan_and_slashes_come_before_what_is_left_of_them(spark):
    text = "let a = /[}]{/.test(b) / 2 / c\nfunction f() { return /'}/g }\nlet m = '\u0003' // }\nclass K { g() { return `\n}` } }\n"
    assert ECMASCRIPT.strings[-1].startswith("(?=/)")
    got = []
    # A text that holds the mark of the cuts itself gives the same.
    for content in (text, text.replace("\u0003", "x")):
        rows = outline.symbol_outline(_typescript(spark, content)).select(F.inline("symbols")).collect()
        got.append([tuple(r) for r in rows])
    assert got[0] == got[1] == [(2, 2, "function", "f", 0), (4, 5, "class", "K", 0)]


def test_closed_symbols_are_not_copied_on_each_line(spark):
    count = 300
    text = "".join(f"class K{i} {{\n  m{i}() {{\n    a(\n      1)\n  }}\n}}\n" for i in range(count))
    df = outline.symbol_outline(_typescript(spark, text)).select(F.inline("symbols"))
    # The symbols found so far lie beside what a line changes, not in it.
    assert "now" in _plan(df) and "ended" in _plan(df)
    want = [(6 * i + 1, 6 * i + 6, "class", f"K{i}", 0) for i in range(count)]
    want += [(6 * i + 2, 6 * i + 5, "method", f"m{i}", 1) for i in range(count)]
    assert [tuple(r) for r in df.collect()] == sorted(want)


def _shuffle_files(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name for folder in folders for p in Path(folder).rglob("shuffle_*.data")}


def test_what_a_written_step_has_shuffled_goes_with_it(spark, tmp_path):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    summed = rows.repartition(3, "k").groupBy("k").agg(F.sum("id").alias("s"))
    before, folders = _shuffle_files(spark), []
    cut, staged = session.cut_lineage(summed), session.stage(summed, folders)
    assert _shuffle_files(spark) <= before
    assert cut.collect() and sorted(cut.collect()) == sorted(staged.collect())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    # The frame itself can be read again.
    assert sorted(tuple(r) for r in summed.collect()) == sorted(tuple(r) for r in summed.collect())
    session.drop_staged(spark, folders)


def _index(spark, path, files, **args):
    tables = persisted.open_index(spark, str(path), 8)
    scans = [files, {p: t + "more\n" if n % 2 else t for n, (p, t) in enumerate(files.items()) if n != 2}]
    for scan in scans:
        rows = [("r", p, t.encode(), len(t)) for p, t in scan.items()]
        frame = spark.createDataFrame(rows, "repository_id string, path string, content binary, length long")
        persisted.run_index(tables, frame, hashed_encoder(8), "m", "w", **args)
    return tables


def _rows(tables):
    found = {}
    for name, columns in (
        ("files", ["path", "content_hash", "is_deleted"]),
        ("chunks", ["chunk_id", "file_id", "content", "is_active"]),
        ("vectors", ["chunk_id", "file_path", "dense", "sparse", "embedding_version", "is_active"]),
        ("cache", ["cache_key", "dense", "sparse"]),
    ):
        found[name] = sorted(str(tuple(r)) for r in tables.read(name).select(*columns).collect())
    return found


def test_tables_written_in_turns_hold_the_same(spark, tmp_path, monkeypatch):
    files = {f"f{i}.md": f"# T{i % 4}\n\nwords {i % 5}\n" for i in range(12)}
    whole = _index(spark, tmp_path / "whole", files, units=2)
    monkeypatch.setattr(persisted, "TURN_ROWS", 4)
    versions = []
    publish = PublishedTables.publish

    def seen(self, *args, **more):
        versions.append(len(self.versions()))
        return publish(self, *args, **more)

    monkeypatch.setattr(PublishedTables, "publish", seen)
    parts = _index(spark, tmp_path / "parts", files, units=2, keep=1)
    assert _rows(whole) == _rows(parts)
    # Versions that are not kept go after each unit, not after the last one.
    assert max(versions) == 1
    staged = Path(session.checkpoint_root(spark)) / "staged"
    assert not staged.exists() or not any(staged.iterdir())


def test_a_stream_with_its_own_state_drops_what_it_has_staged(spark, tmp_path):
    staged = Path(session.checkpoint_root(spark)) / "staged"
    before = set(staged.iterdir()) if staged.exists() else set()
    for name, text in (("documents", "# A\n\nb {}\n"),):
        spark.createDataFrame(
            [(i, text.format(i), "en", "src1", 10) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long"
        ).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = plans.queries()["st2_index_stream_repeats"](spark, str(tmp_path)).collect()
    assert len(rows) == 6 and {r["copies"] for r in rows} == {1}
    # The last state: files, chunks, vectors and cache.
    assert len(set(staged.iterdir()) - before) == 4
