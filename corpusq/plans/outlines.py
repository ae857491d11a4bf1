"""Symbols and imports of program text whose headers, strings and comments span lines.

Each line of a document becomes one block of several lines. What a block holds is known from how
it is made, so the expected symbols are sums of block heights; nothing is parsed in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.operators import outline
from corpusq.plans import tables as t
from corpusq.plans.registry import query
from corpusq.plugins import Language, LanguageRegistry, OutlineRules
from corpusq.session import inline_rows

# {i} is the number of the line, {t} its text without quotes, backslashes and slashes.
PYTHON_BLOCKS = [
    '''class K{i}(
    Base,  # {t}
):
    """{t}
def not_one():
    """

    def m{i}(
        self,
        a="):",
        b=(1, [2, {"x": "("}]),
    ):
        return [
            a,
]
        # {t}

    class Inner{i}:
        def deep(self): return """
class Neither:
""" + self.x

''',
    """def h{i}(a, \\
        b): return '{t}'
import a{i}, b{i}.c as d; from x{i} import (  # {t}
    y, z as w{i},
)
""",
    """@decorated(
    "def fake():"
)
async def g{i}():
    text = '''
{t}
  '''
    def inner():
        pass
    return text
if True:
    import hidden
    class Late{i}: pass
""",
]
TYPESCRIPT_BLOCKS = [
    """/* {t} {
   class Fake { */
export class K{i}<T>
  extends Base
{
  text = `{ ${ x ? `}` : "{" } {t}
  }`;
  constructor(
    private a: string = "}",
  ) {
    super(); call(() => { other({ b: '{' }) });
  }
  over(a: string): void;
  over(a: any): { x: number }
  {
    if (a) { return { x: 1 } } // }
    function inner() {}
  }
  handler = (e) => {
    this.over(e)
  }
  get v{i}() { return /[{]/.test(this.text) }
}""",
    """import d{i}, { a as b{i}, type C } from 'mod{i}'; import "side{i}"
import {
  e, // {t}
  f{i} as g,
} from "far{i}"
const lazy = import("x")
const g{i} = () => 2 // {t}
export const h{i} = async (
  a = "{",
  b,
): Promise<void> => {
  await a
}
const none{i} = (1 + 2) * 3, other = { m() { return 1 } }
let chain{i} = x =>
  x.map(y => y)
   .filter(Boolean)
""",
    """export default async function f{i}(
  a: string, /* ) { */
): Promise<{ x: number }>
{
  return { x: `{` }
}
export default {
  method{i}() {
    return "{t}"
  },
}
""",
]
# Block, kind, start of the name, first and last line in the block, depth.
TYPESCRIPT_SYMBOLS = [
    (0, "class", "K", 3, 23, 0), (0, "method", "constructor", 8, 12, 1), (0, "method", "over", 14, 18, 1),
    (0, "method", "v", 22, 22, 1), (1, "function", "g", 7, 7, 0), (1, "function", "h", 8, 13, 0),
    (1, "function", "chain", 15, 17, 0), (2, "function", "f", 1, 6, 0), (2, "method", "method", 8, 10, 0),
]
PYTHON_SYMBOLS = [
    (0, "class", "K", 1, 21, 0), (0, "method", "m", 8, 15, 1), (0, "class", "Inner", 18, 21, 1), (0, "method", "deep", 19, 21, 2),
    (1, "function", "h", 1, 2, 0), (2, "function", "g", 4, 10, 0), (2, "class", "Late", 13, 13, 0),
]
UNNUMBERED = ("deep", "constructor", "over")
# Block, module, names, line.
PYTHON_IMPORTS = [(1, "a{i}", "", 3), (1, "b{i}.c", "", 3), (1, "x{i}", "y,w{i}", 3)]
TYPESCRIPT_IMPORTS = [(1, "mod{i}", "d{i},b{i},C", 1), (1, "side{i}", "", 1), (1, "far{i}", "e,g", 2)]

GO_BLOCKS = [
    """// {t} func Fake() {
type K{i} struct {
  a string
}
func (k *K{i}) m{i}(
  a string,
) error {
  return f(`{
func Neither() {
`)
}
import "far/{i}"
""",
    """/* {t}
func Fake() { */
func h{i}() {
  if true {
  }
}
""",
]
GO_SYMBOLS = [(0, "class", "K", 2, 4, 0), (0, "function", "m", 5, 11, 0), (1, "function", "h", 3, 6, 0)]
GO_IMPORTS = [(0, "far/{i}", "", 12)]
GO = OutlineRules(
    style="braces",
    comments=(r"//[^\r\n]*+", r"/\*[\s\S]*?(?:\*/|\z)"),
    strings=(r"`[^`]*+`?", r"\"[^\"\r\n]*+\"?"),
    class_head=r"^type\s+(\w+)\s+(?:struct|interface)\b",
    function_head=r"^func\s+(?:\([^)]*\)\s*)?(\w+)",
    imports=r"^import\s+\"([^\"]+)\"",
)
CASES = {
    "python": (PYTHON_BLOCKS, PYTHON_SYMBOLS, PYTHON_IMPORTS),
    "typescript": (TYPESCRIPT_BLOCKS, TYPESCRIPT_SYMBOLS, TYPESCRIPT_IMPORTS),
    "go-like": (GO_BLOCKS, GO_SYMBOLS, GO_IMPORTS),
}


def own_registry() -> LanguageRegistry:
    """A registry of a user's: one language with rules of its own."""
    registry = LanguageRegistry()
    registry.register(Language("go-like", (".gol",), outline=GO))
    return registry


def program_files(spark, sf, language: str):
    blocks = CASES[language][0]

    def block(line, n):
        i = (n + 1).cast("string")
        text = F.translate(line, "\"'`\\/*{}$", "")
        made = F.lit("")
        for k, pattern in enumerate(blocks):
            filled = F.replace(F.replace(F.lit(pattern), F.lit("{i}"), i), F.lit("{t}"), text)
            made = F.when(n % len(blocks) == k, filled).otherwise(made)
        return made

    return t.texts(spark, sf).select(
        F.col("doc_id").alias("file_id"),
        F.lit(language).alias("language"),
        F.array_join(F.transform(F.split("text", "\n"), block), "\n").alias("content"),
    )


def _heights(blocks: list[str]) -> list[int]:
    return [b.count("\n") + 1 for b in blocks]


def _sql_blocks(language: str) -> str:
    """places(file_id, i, k, before): number, block and lines above, per line of a document."""
    heights = _heights(CASES[language][0])
    cases = " ".join(f"WHEN {k} THEN {h}" for k, h in enumerate(heights))
    return f"""doc_lines AS (
  SELECT doc_id AS file_id, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
tall AS (SELECT file_id, i, (i - 1) % {len(heights)} AS k, CASE (i - 1) % {len(heights)} {cases} END AS h FROM doc_lines),
places AS (
  SELECT file_id, i, k, CAST(coalesce(sum(h) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM tall)"""


def _sql_symbols(language: str) -> str:
    rows = ", ".join(
        f"({k}, '{kind}', '{name}', {str(name not in UNNUMBERED).lower()}, {s}, {e}, {d})" for k, kind, name, s, e, d in CASES[language][1]
    )
    return f"""WITH {_sql_blocks(language)}
SELECT file_id, before + s AS start_line, before + e AS end_line, kind, CASE WHEN numbered THEN name || i ELSE name END AS name,
       d::BIGINT AS depth
FROM places JOIN (VALUES {rows}) v(k, kind, name, numbered, s, e, d) USING (k)"""


def _sql_imports(language: str) -> str:
    rows = ", ".join(f"({k}, '{m}', '{names}', {n})" for k, m, names, n in CASES[language][2])
    return f"""WITH {_sql_blocks(language)}
SELECT file_id, replace(module, '{{i}}', i::VARCHAR) AS module, replace(names, '{{i}}', i::VARCHAR) AS names, before + n AS line
FROM places JOIN (VALUES {rows}) v(k, module, names, n) USING (k)"""


def _symbols(spark, sf, language: str, **args):
    rows = inline_rows(outline.symbol_outline(program_files(spark, sf, language), **args), ["file_id"], F.col("symbols"), "start_line")
    lines = [F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "depth")]
    return rows.select("file_id", "kind", "name", *lines)


def _imports(spark, sf, language: str, **args):
    edges = outline.import_edges(program_files(spark, sf, language), **args)
    return edges.select("file_id", "module", F.array_join("names", ",").alias("names"), F.col("line").cast("long").alias("line"))


@query("p1_outline_python_blocks", _sql_symbols("python"))
def python_outline(spark, sf):
    return _symbols(spark, sf, "python")


@query("p1_outline_typescript_blocks", _sql_symbols("typescript"))
def typescript_outline(spark, sf):
    return _symbols(spark, sf, "typescript")


@query("p1_outline_user_language", _sql_symbols("go-like"))
def user_outline(spark, sf):
    """A language that only the caller knows, by rules of the caller's."""
    return _symbols(spark, sf, "go-like", registry=own_registry())


@query("p2_imports_python_blocks", _sql_imports("python"))
def python_imports(spark, sf):
    return _imports(spark, sf, "python")


@query("p2_imports_typescript_blocks", _sql_imports("typescript"))
def typescript_imports(spark, sf):
    return _imports(spark, sf, "typescript")


@query("p2_imports_user_language", _sql_imports("go-like"))
def user_imports(spark, sf):
    return _imports(spark, sf, "go-like", registry=own_registry())
