"""Chunking: known answers, invariants, and plain loops as the yardstick."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusq.functions import spans
from corpusq.functions.text import let
from corpusq.operators import chunking, outline

TOKEN = re.compile(r"\w+|[^\w\s]")


def tokens(text):
    return len(TOKEN.findall(text))


def files(spark, *texts, **columns):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "file_id long, content string")
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return df


def sections(df):
    return [(r.name, r.start_line, r.end_line) for r in df.orderBy("file_id", "start_line").collect()]


def test_lines_keep_their_terminators(spark):
    df = chunking.explode_lines(files(spark, "a\nb\r\n\nc", "", "x\n"))
    got = [(r.file_id, r.line_no, r.line) for r in df.orderBy("file_id", "line_no").collect()]
    assert got == [(0, 1, "a\n"), (0, 2, "b\r\n"), (0, 3, "\n"), (0, 4, "c"), (2, 1, "x\n")]


def test_headings(spark):
    df = chunking.heading_sections(files(spark, "# One\n\nBody one.\n\n# Two\n\nBody two.\n", "intro\n## A\n#no\n####### B\n"))
    assert sections(df) == [("One", 1, 4), ("Two", 5, 7), (None, 1, 1), ("A", 2, 4)]


def test_empty_heading_takes_the_next_section(spark):
    text = "# Title\n\nIntro paragraph.\n\n## Empty\n\n### Real\n\nActual content.\n"
    rows = chunking.chunk_markdown(files(spark, text)).orderBy("start_line").collect()
    assert [r.symbol_name for r in rows] == ["Title", "Empty"]
    assert "Actual content." in rows[1].text


@pytest.mark.parametrize(
    ("run", "names"),
    [(1, ["E1"]), (2, ["E1", "Full"]), (3, ["E1", "E3"]), (4, ["E1", "E3", "Full"])],
)
def test_runs_of_empty_headings_merge_pairwise(spark, run, names):
    text = "".join(f"# E{i}\n" for i in range(1, run + 1)) + "# Full\nbody\n"
    assert [n for n, _, _ in sections(chunking.merge_empty_headings(files(spark, text)))] == names


def test_trailing_empty_headings(spark):
    df = chunking.merge_empty_headings(files(spark, "# A\nx\n# E1\n# E2\n# E3\n", "# Only\n"))
    assert sections(df) == [("A", 1, 2), ("E1", 3, 4), ("E3", 5, 5), ("Only", 1, 1)]


def test_oversize_section_is_cut_at_paragraphs(spark):
    text = "# Big\n\n" + "\n\n".join(f"Paragraph {i} " + "word " * 10 for i in range(6)) + "\n"
    rows = chunking.chunk_markdown(files(spark, text), 30, 2).orderBy("start_line").collect()
    assert len(rows) > 1 and all(r.content_tokens <= 30 for r in rows)
    assert "".join(r.text for r in rows) == text
    assert all(b.start_line == a.end_line + 1 for a, b in zip(rows, rows[1:], strict=False))


def greedy(sizes, limit):
    starts, total = [], 0
    for n, size in enumerate(sizes):
        if not starts or total + size > limit:
            starts.append(n)
            total = 0
        total += size
    return starts


def test_line_windows_equal_a_plain_loop(spark):
    rng = random.Random(5)
    texts = ["\n".join("w " * rng.choice([0, 1, 3, 9, 40]) for _ in range(rng.randint(1, 60))) + "\n" for _ in range(40)]
    got = {}
    for r in chunking.line_windows(files(spark, *texts), 20, 6).collect():
        got.setdefault(r.file_id, []).append((r.start_line, r.end_line))
    for i, text in enumerate(texts):
        sizes = [tokens(line) for line in text.splitlines()]
        starts = greedy(sizes, 20)
        if len(starts) > 1 and sum(sizes[starts[-1] :]) < 6:
            starts.pop()
        ends = [s for s in starts[1:]] + [len(sizes)]
        assert sorted(got[i]) == [(s + 1, e) for s, e in zip(starts, ends, strict=True)]


def code(spark, text, language="python", **budget):
    df = outline.symbol_outline(files(spark, text, language=language))
    return chunking.chunk_code(df, **budget).orderBy("start_line").collect()


def test_gap_before_a_function_is_a_module_chunk(spark):
    rows = code(spark, "import os\nCONST = 1\n\n\ndef foo():\n    pass\n")
    assert [(r.symbol_kind, r.start_line, r.end_line) for r in rows] == [("module", 1, 4), ("function", 5, 6)]


def test_small_functions_merge_without_the_blank_lines(spark):
    text = "def a(): pass\n\ndef b(): pass\n\ndef c(): pass\n"
    rows = code(spark, text, target=200)
    assert [(r.symbol_name, r.start_line, r.end_line, r.source_stage) for r in rows] == [("a", 1, 5, "merged")]
    assert rows[0].text == "def a(): pass\ndef b(): pass\ndef c(): pass\n"


def test_kinds_do_not_merge(spark):
    rows = code(spark, "class A:\n    x = 1\ndef b():\n    pass\n", target=200)
    assert [r.symbol_kind for r in rows] == ["class", "function"]


def test_code_chunks_cover_the_file_in_order(spark):
    rng = random.Random(9)
    lines = []
    for c in range(12):
        lines.append(f"class C{c}:")
        for m in range(rng.randint(1, 6)):
            lines.append(f"    def m{m}(self):")
            lines += [f"        x{n} = {n} + {m}" for n in range(rng.randint(1, 12))]
            lines.append("")
        lines += ["", "y = 1", ""]
    text = "\n".join(lines) + "\n"
    rows = code(spark, text, max_tokens=60, min_tokens=5, target=0)
    assert all(r.content_tokens <= 60 + 5 for r in rows)
    last = 0
    for r in rows:
        assert r.start_line > last
        assert not "".join(lines[last : r.start_line - 1]).strip()
        last = r.end_line
    assert not "".join(lines[last:]).strip()


def plain_split(sizes, symbols, start, end, limit, low, level=1):
    """The same rules as loops over one piece."""
    total = sum(sizes[start - 1 : end])
    if total <= limit:
        return [(start, end)]
    inside = [s for s in symbols if s[4] == level and s[0] >= start and s[1] <= end]
    if not inside and level < 3:
        return plain_split(sizes, symbols, start, end, limit, low, level + 1)
    if not inside:
        starts = [start + n for n in greedy(sizes[start - 1 : end], limit)]
        if len(starts) > 1 and sum(sizes[starts[-1] - 1 : end]) < low:
            starts.pop()
        return list(zip(starts, [s - 1 for s in starts[1:]] + [end], strict=True))
    begins = [start] + [s[0] for s in inside[1:]]
    ends = [b - 1 for b in begins[1:]] + [end]
    units = [sum(sizes[b - 1 : e]) for b, e in zip(begins, ends, strict=True)]
    at = greedy(units, limit)
    out = []
    for n, i in enumerate(at):
        stop = ends[(at[n + 1] if n + 1 < len(at) else len(units)) - 1]
        if level < 3:
            out += plain_split(sizes, symbols, begins[i], stop, limit, low, level + 1)
        else:
            out.append((begins[i], stop))
    return out


def test_oversize_split_equals_a_plain_loop(spark):
    rng = random.Random(11)
    text = ""
    for c in range(6):
        text += f"class C{c}:\n"
        for m in range(rng.randint(1, 4)):
            text += f"    class D{m}:\n"
            for f in range(rng.randint(1, 4)):
                text += f"        def f{f}(self):\n" + "            call(1)\n" * rng.randint(1, 9)
    df = outline.symbol_outline(files(spark, text, language="python"))
    symbols = sorted(tuple(s) for s in df.first().symbols)
    cut = df.select(
        F.inline(
            let(
                spans.split_lines(F.col("content")),
                lambda ls: let(
                    spans.line_tokens(ls),
                    lambda ts: chunking.split_oversize(
                        spans.outermost_spans(F.sort_array("symbols")), F.sort_array("symbols"), ts, 40, 8
                    ),
                ),
            )
        )
    )
    got = sorted((r.start_line, r.end_line) for r in cut.collect())
    sizes = [tokens(line) for line in text.splitlines()]
    want = []
    for s in symbols:
        if s[4] == 0:
            want += plain_split(sizes, symbols, s[0], s[1], 40, 8)
    assert got == sorted(want)


def test_outside_tokenizer(spark):
    df = chunking.count_with(lambda: lambda texts: [len(t) for t in texts], files(spark, "abc", "", None), "content")
    assert [r.content_tokens for r in df.orderBy("file_id").collect()] == [3, 0, 0]


def test_chunking_moves_no_rows(spark):
    plan = chunking.chunk_markdown(files(spark, "# A\nb\n"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# --- symbols, imports, history ---------------------------------------------------------


def symbols(spark, text, language="python"):
    rows = outline.symbol_outline(files(spark, text, language=language)).select(F.inline("symbols")).collect()
    return [(r.kind, r.name, r.start_line, r.end_line) for r in rows]


def test_python_outline(spark):
    text = (
        "import os\n\nclass Foo:\n    @property\n    def bar(self):\n        return 1\n\n    def baz(self):\n"
        "        def hidden():\n            pass\n        return hidden\n\nasync def top():\n    def nested():\n"
        "        pass\n    return nested\n\nif True:\n    def inside():\n        pass\n"
    )
    assert symbols(spark, text) == [
        ("class", "Foo", 3, 11), ("method", "bar", 5, 6), ("method", "baz", 8, 11),
        ("function", "top", 13, 16), ("function", "inside", 19, 20),
    ]


def test_javascript_outline(spark):
    text = (
        "import a from 'a';\nexport class Foo {\n  bar() {\n    if (x) { y(); }\n  }\n  async baz(a, b) {\n"
        "    const q = () => { return '}'; };\n  }\n}\nfunction top() {\n  function nested() {\n  }\n}\n"
        "const f = (a) => {\n  return a;\n};\nconst g = x => x;\nconst n = 5;\n"
    )
    assert symbols(spark, text, "javascript") == [
        ("class", "Foo", 2, 9), ("method", "bar", 3, 5), ("method", "baz", 6, 8),
        ("function", "top", 10, 13), ("function", "f", 14, 16), ("function", "g", 17, 17),
    ]


def imports(spark, text, language):
    rows = outline.import_edges(files(spark, text, language=language)).collect()
    return [(r.module, r.names, r.line) for r in rows]


def test_python_imports(spark):
    text = (
        "import os.path as op, sys\nfrom . import utils\nfrom .sub import thing as t\nfrom pkg import a, b  # (c\n"
        "from deep import (\n    one,\n    two as deux,  # note\n)\nfrom z import *\ndef f():\n    import hidden\n"
    )
    assert imports(spark, text, "python") == [
        ("os.path", [], 1), ("sys", [], 1), (".", ["utils"], 2), (".sub", ["t"], 3), ("pkg", ["a", "b"], 4),
        ("deep", ["one", "deux"], 5), ("z", ["*"], 9),
    ]


def test_es_imports(spark):
    text = "import d, { a as b, c } from 'mod';\nimport * as ns from \"other\";\nimport 'side';\nimport {\n  x,\n  y as z\n} from './local';\n"
    assert imports(spark, text, "typescript") == [
        ("mod", ["d", "b", "c"], 1), ("other", ["ns"], 2), ("side", [], 3), ("./local", ["x", "z"], 4),
    ]


def test_blame_records_need_all_three_values(spark):
    one, two = "a" * 40, "b" * 40
    dump = (
        f"{one} 1 1 2\nauthor Ann\nauthor-mail <a>\nauthor-time 1700000000\n\tline one\n"
        f"{two} 2 2\nauthor Bob\n\tno time\n"
        f"{two} 3 3\nauthor Bob\nauthor-time 1700000060\n\tauthor-time 5\n"
    )
    df = spark.createDataFrame([(1, dump)], "file_id long, porcelain string")
    rows = outline.parse_blame(df).orderBy("line_no").collect()
    assert [(r.line_no, r.author, r.commit_sha) for r in rows] == [(1, "Ann", one), (3, "Bob", two)]
    assert rows[0].committed_at.timestamp() == 1700000000
