"""Symbols and imports of code whose headers, strings and comments span lines; rules of a user's language."""

import pytest
from pyspark.sql import functions as F

from corpusq.operators import outline
from corpusq.plans.outlines import GO
from corpusq.plugins import Language, LanguageError, LanguageRegistry

PYTHON = r"""
import a; import b.c as d
from x import (  # comment (
    y,
    z as w,
)
from . import \
    u
if True:
    import hidden
TEXT = QQQ
import fake
def fake():
QQQ
def first(
    a="):",
    b=[1,
 2],
):
    return {
        "x": 1,
}


class K(
    Base,
):
    QQQDoc's

def not_one():
    QQQ

    @property
    def m(self):
        x = '''
class nope:
'''
        return x
        # trailing

    def n(self): return "def z():"

    class Inner:
        def deep(self):
            def nested():
                pass
            return 1
async def last():
    pass
# end
def tail(): pass
""".strip("\n").replace("QQQ", '"' * 3)

TYPESCRIPT = r"""
import a, { b as c, type D } from "mod-a"; import 'side'
import {
  e, // x
  f as g,
} from 'mod-b'
import * as ns from "ns"
const notImport = import("x")
/* function fake() {
   class Nope { */
function first(
  a: string = "{",
  b: number,
): { x: number } 
{
  return { x: `}${`{`}` }
}
class K
  extends Base
{
  private x = { y: 1 };
  constructor(
    private a: string,
  ) {
    super(); foo(() => { bar() });
  }
  over(a: string): void;
  over(a: any): void {
    if (a) {
      function inner() {}
    } else { x() }
  }
  get v() { return '}' }
  handle = () => {
    call(1)
  }
  async *gen<T>(x: T) { /* } */ }
}
const g = () => 2
export const h = async (
  a,
  b,
) => {
  return /[{]/.test(a)
}
const notFn = (1 + 2) * 3
const obj = {
  m() { return 1 },
}
const chain = (x) =>
  x.map(y => y)
   .filter(Boolean)
let k = function named() { return 1 }
export default {
  method() {
    return 1
  },
}
export abstract class L { z() {} }
function* tail() { yield 1 }
""".strip("\n")


def outlined(spark, text, language, **args):
    df = spark.createDataFrame([("f", text, language)], "file_id string, content string, language string")
    symbols = outline.symbol_outline(df, **args).first().symbols
    edges = outline.import_edges(df, **args).collect()
    return [tuple(s) for s in symbols], sorted((e.line, e.module, tuple(e.names)) for e in edges)


def test_python_over_several_lines(spark):
    symbols, edges = outlined(spark, PYTHON, "python")
    assert symbols == [
        (14, 21, "function", "first", 0), (24, 46, "class", "K", 0), (33, 37, "method", "m", 1), (40, 40, "method", "n", 1),
        (42, 46, "class", "Inner", 1), (43, 46, "method", "deep", 2), (47, 48, "function", "last", 0), (50, 50, "function", "tail", 0),
    ]
    assert edges == [(1, "a", ()), (1, "b.c", ()), (2, "x", ("y", "w")), (6, ".", ("u",))]


def test_typescript_over_several_lines(spark):
    symbols, edges = outlined(spark, TYPESCRIPT, "typescript")
    assert symbols == [
        (10, 16, "function", "first", 0), (17, 37, "class", "K", 0), (21, 25, "method", "constructor", 1),
        (27, 31, "method", "over", 1), (32, 32, "method", "v", 1), (36, 36, "method", "gen", 1), (38, 38, "function", "g", 0),
        (39, 44, "function", "h", 0), (49, 51, "function", "chain", 0), (52, 52, "function", "k", 0),
        (54, 56, "method", "method", 0), (58, 58, "class", "L", 0), (59, 59, "function", "tail", 0),
    ]
    assert edges == [(1, "mod-a", ("a", "c", "D")), (1, "side", ()), (2, "mod-b", ("e", "g")), (6, "ns", ("ns",))]


def test_line_ends_and_texts_without_code(spark):
    windows = PYTHON.replace("\n", "\r\n")
    assert outlined(spark, windows, "python") == outlined(spark, PYTHON, "python")
    assert outlined(spark, TYPESCRIPT.replace("\n", "\r"), "typescript")[0] == outlined(spark, TYPESCRIPT, "typescript")[0]
    for text in ("", "\n\n", "# only", "// only", '"' * 3, "/*", "`", "'", ")" * 5, "}" * 5, "\\"):
        for language in ("python", "typescript"):
            assert outlined(spark, text, language) == ([], [])


def test_long_strings_do_not_exhaust_the_stack(spark):
    inside = "x{" * 60_000 + r"\"" * 3_000
    for language, end in (("python", "def f():\n    pass"), ("typescript", "function f() {\n}")):
        symbols, _ = outlined(spark, f'a = "{inside}"\n{end}', language)
        assert symbols == [(2, 3, "function", "f", 0)]


def test_what_is_open_at_the_end_reaches_the_last_line(spark):
    assert outlined(spark, "class A {\n  m() {\n    x()\n", "typescript")[0] == [(1, 3, "class", "A", 0), (2, 3, "method", "m", 1)]
    assert outlined(spark, "def f(\n  a,\n", "python")[0] == [(1, 2, "function", "f", 0)]


def test_a_language_with_own_rules(spark):
    registry = LanguageRegistry()
    registry.register(Language("go-like", (".gol",), outline=GO))
    text = 'import "far"\n// func no() {\ntype T struct {\n}\nfunc (t *T) m(\n  a int,\n) {\n  `\nfunc no() {\n`\n}\n'
    symbols, edges = outlined(spark, text, "go-like", registry=registry)
    assert symbols == [(3, 4, "class", "T", 0), (5, 11, "function", "m", 0)] and edges == [(1, "far", ())]
    with pytest.raises(LanguageError):
        Language("x", (".x",), outline="columns")


def test_blame_of_spans_is_found_by_binary_search(spark):
    lines = [("f", n, f"a{n}", f"c{n}", n) for n in (2, 3, 5, 8, 13, 21)] + [("g", 1, "x", "y", 1)]
    blame = spark.createDataFrame(lines, "file_id string, line_no int, author string, commit_sha string, committed_at int")
    blame = blame.withColumn("committed_at", F.timestamp_seconds("committed_at"))
    spans = [("f", s, e) for s in range(0, 24) for e in range(s - 1, 24)] + [("h", 1, 9), ("f", 2, 5), ("f", None, 3)]
    frame = spark.createDataFrame(spans, "file_id string, start_line int, end_line int")
    rows = outline.blame_for_spans(frame, blame)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "line_no" not in plan.split("Join", 1)[1].split("\n", 1)[0]
    got = sorted((r.file_id, r.start_line, r.end_line, r.line_no, r.author) for r in rows.collect())
    assert got == sorted(
        (f, s, e, n, a) for f, s, e in spans if s is not None for g, n, a, _, _ in lines if f == g and s <= n <= e
    )
