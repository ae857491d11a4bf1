"""Symbols, imports and history of program text made from document lines by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.operators import chunking, outline
from corpusq.plans import tables as t
from corpusq.plans.chunks import SQL_GAPS, TOKENS, sql_greedy, sql_lines, sql_tail_fix
from corpusq.plans.registry import query
from corpusq.session import inline_rows

# What line i of a document becomes, by i mod 11; the line itself stays as a comment.
SHAPES = {
    1: "import m{i}.sub",
    2: "from pkg{r} import a{i}, b as c{i}",
    3: "class K{i}:",
    4: "    def f{i}(self):",
    5: "        return {i}",
    6: "    def g{i}(self):",
    7: "        return {i}",
    8: "def h{i}():",
    9: "    def inner{i}():",
    10: "        return {i}",
    0: "",
}

# The same with classes in classes, five deep, and methods on several levels; by i mod 13.
DEEP_SHAPES = {
    1: "class A{i}:",
    2: "    def a{i}(self): return {i}",
    3: "    class B{i}:",
    4: "        class C{i}:",
    5: "            def c{i}(self):",
    6: "                return {i}",
    7: "            class D{i}:",
    8: "                class E{i}:",
    9: "                    def e{i}(self):",
    10: "                        return {i}",
    11: "                    def f{i}(self):",
    12: "                        return {i}",
    0: "",
}


def code_files(spark, sf, shapes=SHAPES):
    def shape(line, n):
        i = n + 1
        text = F.lit("")
        for rest, pattern in shapes.items():
            made = F.replace(
                F.replace(F.lit(pattern), F.lit("{i}"), i.cast("string")),
                F.lit("{r}"),
                (i % 5).cast("string"),
            )
            text = F.when(i % len(shapes) == rest, made).otherwise(text)
        return F.concat(text, F.lit("  # "), line)

    return t.texts(spark, sf).select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("repository_id"),
        F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"),
        F.lit("python").alias("language"),
        F.array_join(F.transform(F.split("text", "\n"), shape), "\n").alias("content"),
    )


def _sql_shape(shapes) -> str:
    cases = " ".join(
        f"WHEN {rest} THEN replace(replace('{pattern}', '{{i}}', i::VARCHAR), '{{r}}', (i % 5)::VARCHAR)"
        for rest, pattern in shapes.items()
    )
    return f"CASE i % {len(shapes)} {cases} END"


def sql_code(shapes=SHAPES) -> str:
    return f"""
doc_lines AS (
  SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS l,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
code AS (
  SELECT file_id, string_agg({_sql_shape(shapes)} || '  # ' || l, chr(10) ORDER BY i) AS text
  FROM doc_lines GROUP BY file_id),
{sql_lines('code')},
code_lines AS (
  SELECT file_id, line_no, line, length(regexp_extract(line, '^([ \\t]*)', 1)) AS indent,
         regexp_extract(line, '^\\s*class\\s+(\\w+)', 1) AS class_name,
         regexp_extract(line, '^\\s*(?:async\\s+)?def\\s+(\\w+)', 1) AS def_name
  FROM lines WHERE regexp_matches(line, '^\\s*[^\\s#]')),
definitions AS (
  SELECT d.*, coalesce(
      (SELECT min(c.line_no) FROM code_lines c
       WHERE c.file_id = d.file_id AND c.line_no > d.line_no AND c.indent <= d.indent), 1000000000) AS stop
  FROM code_lines d WHERE class_name <> '' OR def_name <> ''),
ended AS (
  SELECT d.*, (SELECT max(c.line_no) FROM code_lines c
               WHERE c.file_id = d.file_id AND c.line_no >= d.line_no AND c.line_no < d.stop) AS last
  FROM definitions d),
outer_ones AS (
  SELECT d.file_id, d.line_no, count(o.line_no) AS depth,
         coalesce(bool_or(o.def_name <> ''), false) AS inside_function
  FROM ended d LEFT JOIN ended o
    ON o.file_id = d.file_id AND o.line_no < d.line_no AND o.last >= d.line_no
  GROUP BY d.file_id, d.line_no),
symbols AS (
  SELECT file_id, line_no AS s, last AS e,
         CASE WHEN class_name <> '' THEN 'class' WHEN depth > 0 THEN 'method' ELSE 'function' END AS kind,
         CASE WHEN class_name <> '' THEN class_name ELSE def_name END AS name, depth
  FROM ended JOIN outer_ones USING (file_id, line_no) WHERE NOT inside_function)"""


SQL_CODE = sql_code()


def _symbols(spark, sf):
    files = outline.symbol_outline(code_files(spark, sf))
    return inline_rows(files, ["file_id"], F.col("symbols"), "start_line")


@query(
    "p1_symbol_outline",
    f"WITH {SQL_CODE} SELECT file_id, s AS start_line, e AS end_line, kind, name, depth::BIGINT AS depth FROM symbols",
)
def symbol_outline(spark, sf):
    return _symbols(spark, sf).select(
        "file_id",
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        "kind",
        "name",
        F.col("depth").cast("long").alias("depth"),
    )


SQL_IMPORTS = """
edges AS (
  SELECT file_id, regexp_extract(line, '^import ([\\w.]+)', 1) AS module, '' AS names, line_no AS line
  FROM lines WHERE regexp_matches(line, '^import ')
  UNION ALL
  SELECT file_id, regexp_extract(line, '^from ([\\w.]+) import', 1),
         regexp_extract(line, 'import (\\w+), b as', 1) || ',' || regexp_extract(line, 'b as (\\w+)', 1), line_no
  FROM lines WHERE regexp_matches(line, '^from '))"""


@query("p2_import_edges", f"WITH {SQL_CODE},{SQL_IMPORTS} SELECT file_id, module, names, line FROM edges")
def import_edges(spark, sf):
    edges = outline.import_edges(code_files(spark, sf))
    return edges.select(
        "file_id", "module", F.array_join("names", ",").alias("names"), F.col("line").cast("long").alias("line")
    )


@query(
    "p6_symbol_references",
    f"WITH {SQL_CODE},{SQL_IMPORTS} SELECT module, count(DISTINCT file_id) AS files FROM edges GROUP BY module",
)
def references(spark, sf):
    return outline.symbol_references(outline.import_edges(code_files(spark, sf)))


def blame_dumps(spark, sf):
    """One porcelain text per document; the time is missing on every seventh line."""

    def record(line, n):
        i = n + 1
        return F.concat(
            F.sha1(F.concat_ws("-", F.col("doc_id").cast("string"), (i - i % 4).cast("string"))),
            F.lit(" "), i.cast("string"), F.lit(" "), i.cast("string"),
            F.lit("\nauthor dev"), (i % 3).cast("string"),
            F.when(i % 7 == 0, F.lit("")).otherwise(
                F.concat(F.lit("\nauthor-time "), (F.lit(1700000000) + i * 3600).cast("string"))
            ),
            F.lit("\nfilename x\n\t"), line, F.lit("\n"),
        )

    return t.texts(spark, sf).select(
        F.col("doc_id").alias("file_id"),
        F.array_join(F.transform(F.split("text", "\n"), record), "").alias("porcelain"),
    )


SQL_BLAME = """
blame AS (
  SELECT file_id, i AS line_no, 'dev' || i % 3 AS author, sha1(file_id || '-' || (i - i % 4)) AS commit_sha,
         1700000000 + i * 3600 AS stamp
  FROM doc_lines WHERE i % 7 <> 0)"""


@query(
    "p4_parse_blame",
    f"WITH {SQL_CODE},{SQL_BLAME} SELECT file_id, line_no, author, commit_sha, stamp AS committed_at FROM blame",
)
def parse_blame(spark, sf):
    return outline.parse_blame(blame_dumps(spark, sf)).select(
        "file_id",
        F.col("line_no").cast("long").alias("line_no"),
        "author",
        "commit_sha",
        F.unix_timestamp("committed_at").alias("committed_at"),
    )


@query(
    "p5_blame_for_spans",
    f"""WITH {SQL_CODE},{SQL_BLAME}
SELECT s.file_id, s.s AS start_line, s.e AS end_line, line_no, author, commit_sha
FROM symbols s JOIN blame b ON b.file_id = s.file_id AND b.line_no BETWEEN s.s AND s.e""",
)
def blame_for_spans(spark, sf):
    spans = _symbols(spark, sf).select("file_id", "start_line", "end_line")
    rows = outline.blame_for_spans(spans, outline.parse_blame(blame_dumps(spark, sf)))
    return rows.select(
        "file_id",
        *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "line_no")],
        "author",
        "commit_sha",
    )


@query(
    "p3_symbol_metadata",
    f"""WITH {SQL_CODE},{SQL_IMPORTS},{SQL_BLAME},
modules AS (SELECT file_id, string_agg(module, ',' ORDER BY line) AS modules FROM edges GROUP BY file_id),
entries AS (
  SELECT s.file_id, s.s, s.e, string_agg(left(commit_sha, 8) || '@' || author, ',' ORDER BY line_no) AS blame
  FROM symbols s JOIN blame b ON b.file_id = s.file_id AND b.line_no BETWEEN s.s AND s.e GROUP BY ALL)
SELECT s.file_id, s.s AS start_line, s.e AS end_line, kind, name, modules, blame
FROM symbols s LEFT JOIN modules USING (file_id) LEFT JOIN entries USING (file_id, s, e)""",
)
def symbol_metadata(spark, sf):
    files = code_files(spark, sf)
    rows = outline.symbol_metadata(
        _symbols(spark, sf), outline.import_edges(files), outline.parse_blame(blame_dumps(spark, sf))
    )
    return rows.select(
        "file_id",
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        "kind",
        "name",
        F.array_join("modules", ",").alias("modules"),
        F.array_join(
            F.transform("blame", lambda b: F.concat_ws("@", F.substring(b["commit_sha"], 1, 8), b["author"])), ","
        ).alias("blame"),
    )


@query(
    "f15_format_blame",
    f"""WITH {SQL_CODE},{SQL_BLAME},
spans AS (
  SELECT file_id, lang || '/' || source || '/' || file_id || '.py' AS path, s, e
  FROM symbols JOIN documents ON doc_id = file_id WHERE kind = 'class')
SELECT s.file_id, s.s AS start_line, s.e AS end_line,
       path || ':' || s.s || '-' || s.e || chr(10) || string_agg(
         left(commit_sha, 8) || ' ' || author || ' ' || strftime(make_timestamp(stamp * 1000000), '%Y-%m-%d'),
         chr(10) ORDER BY line_no) AS listing
FROM spans s JOIN blame b ON b.file_id = s.file_id AND b.line_no BETWEEN s.s AND s.e
GROUP BY s.file_id, path, s.s, s.e""",
)
def format_blame(spark, sf):
    classes = _symbols(spark, sf).where("kind = 'class'").select("file_id", "start_line", "end_line")
    paths = code_files(spark, sf).select("file_id", F.col("path").alias("file_path"))
    rows = outline.blame_for_spans(
        classes.join(paths, "file_id"), outline.parse_blame(blame_dumps(spark, sf))
    )
    df = outline.format_blame(rows)
    return df.select(
        "file_id",
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        "listing",
    )


MAX, MIN, TARGET = 60, 10, 40


def _sql_level(level: int, deepest: int) -> str:
    """pieces{level} from the pieces of the level above: what is too long is cut at its symbols of this depth."""
    above, d = f"pieces{level - 1}", level
    leaf = "" if level == deepest else f"""
  UNION ALL SELECT z.file_id, s, e, kind, name FROM sized{d} z WHERE tok > {MAX} AND z.kind <> 'module'
    AND NOT EXISTS (SELECT 1 FROM kids{d} k WHERE k.file_id = z.file_id AND k.g = z.s)"""
    windowed = "z.kind = 'module'" if level < deepest else (
        f"(z.kind = 'module' OR NOT EXISTS (SELECT 1 FROM kids{d} k WHERE k.file_id = z.file_id AND k.g = z.s))"
    )
    return f"""sized{d} AS (
  SELECT f.file_id, f.s, f.e, f.kind, f.name, sum(l.tok) AS tok
  FROM {above} f JOIN lines l ON l.file_id = f.file_id AND l.line_no BETWEEN f.s AND f.e GROUP BY ALL),
kids{d} AS (
  SELECT z.file_id, z.s AS g, z.e AS ge, c.s AS cs, row_number() OVER w AS k, lead(c.s) OVER w AS following
  FROM sized{d} z JOIN symbols c ON c.file_id = z.file_id AND c.depth = {level} AND c.s >= z.s AND c.e <= z.e
  WHERE z.tok > {MAX} AND z.kind <> 'module' WINDOW w AS (PARTITION BY z.file_id, z.s ORDER BY c.s)),
kid_spans{d} AS (
  SELECT file_id, g, k, CASE WHEN k = 1 THEN g ELSE cs END AS s, coalesce(following - 1, ge) AS e FROM kids{d}),
units{d} AS (
  SELECT u.file_id, g, k, u.s, u.e, sum(l.tok) AS tok
  FROM kid_spans{d} u JOIN lines l ON l.file_id = u.file_id AND l.line_no BETWEEN u.s AND u.e GROUP BY ALL),
{sql_greedy(f'units{d}', f'packed{d}', MAX, ['file_id', 'g'])},
long_lines{d} AS (
  SELECT z.file_id, z.s AS g, row_number() OVER (PARTITION BY z.file_id, z.s ORDER BY l.line_no) AS k,
         l.line_no AS s, l.line_no AS e, l.tok
  FROM sized{d} z JOIN lines l ON l.file_id = z.file_id AND l.line_no BETWEEN z.s AND z.e
  WHERE z.tok > {MAX} AND {windowed}),
{sql_greedy(f'long_lines{d}', f'windows{d}', MAX, ['file_id', 'g'])},
{sql_tail_fix(f'windows{d}', f'fixed{d}', MIN, ['file_id', 'g'])},
pieces{d} AS (
  SELECT file_id, s, e, kind, name FROM sized{d} WHERE tok <= {MAX}
  UNION ALL SELECT p.file_id, p.s, p.e, z.kind, z.name FROM packed{d} p JOIN sized{d} z ON z.file_id = p.file_id AND z.s = p.g
  UNION ALL SELECT x.file_id, x.s, x.e, z.kind, z.name FROM fixed{d} x JOIN sized{d} z
    ON z.file_id = x.file_id AND x.s BETWEEN z.s AND z.e{leaf}),
"""


def sql_code_chunks(target: int, shapes=SHAPES, deepest: int = 2) -> str:
    """Chunks of the made-up code; ``deepest`` is one level below its symbols, where lines are cut."""
    return f"""WITH RECURSIVE {sql_code(shapes)},
outermost AS (SELECT file_id, s, e, kind, name FROM symbols WHERE depth = 0),
{SQL_GAPS},
pieces0 AS (SELECT file_id, s, e, kind, name FROM filled),
{"".join(_sql_level(d, deepest) for d in range(1, deepest + 1))}pieces AS (
  SELECT p.file_id, p.s, p.e, sum(l.tok) AS tok
  FROM pieces{deepest} p JOIN lines l ON l.file_id = p.file_id AND l.line_no BETWEEN p.s AND p.e GROUP BY ALL),
named AS (
  SELECT p.*, f.kind, f.name, row_number() OVER (PARTITION BY p.file_id ORDER BY p.s) AS k
  FROM pieces p JOIN filled f ON f.file_id = p.file_id AND p.s BETWEEN f.s AND f.e),
walk AS (
  SELECT file_id, k, s, e, tok, kind, name, 1 AS piece, tok AS total FROM named WHERE k = 1
  UNION ALL
  SELECT u.file_id, u.k, u.s, u.e, u.tok, u.kind, u.name,
         CASE WHEN u.kind <> r.kind OR r.total + u.tok > {target} THEN r.piece + 1 ELSE r.piece END,
         CASE WHEN u.kind <> r.kind OR r.total + u.tok > {target} THEN u.tok ELSE r.total + u.tok END
  FROM walk r JOIN named u ON u.file_id = r.file_id AND u.k = r.k + 1),
joined AS (
  SELECT file_id, piece, min(s) AS start_line, max(e) AS end_line, min(kind) AS symbol_kind,
         arg_min(name, k) AS symbol_name, CASE WHEN count(*) > 1 THEN 'merged' ELSE 'ast' END AS source_stage,
         sum(tok)::BIGINT AS content_tokens
  FROM walk GROUP BY file_id, piece),
code_chunks AS (
  SELECT j.file_id, start_line, end_line, symbol_kind, symbol_name, source_stage, content_tokens,
         md5(string_agg(l.line, '' ORDER BY l.line_no)) AS text_md5
  FROM joined j JOIN walk w ON w.file_id = j.file_id AND w.piece = j.piece
  JOIN lines l ON l.file_id = w.file_id AND l.line_no BETWEEN w.s AND w.e GROUP BY ALL)"""


def _code_rows(spark, sf, target, *columns, shapes=SHAPES):
    files = outline.symbol_outline(code_files(spark, sf, shapes))
    rows = chunking.chunk_code(files, MAX, MIN, target)
    return rows.select(
        "file_id",
        *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "content_tokens")],
        *columns,
    )


@query(
    "c13_chunk_code",
    sql_code_chunks(TARGET)
    + " SELECT file_id, start_line, end_line, content_tokens, symbol_kind, symbol_name, source_stage, text_md5 FROM code_chunks",
)
def chunk_code(spark, sf):
    return _code_rows(
        spark, sf, TARGET, "symbol_kind", "symbol_name", "source_stage", F.md5("text").alias("text_md5")
    )


@query(
    "c9_split_oversize",
    sql_code_chunks(0) + " SELECT file_id, start_line, end_line, content_tokens, symbol_kind, symbol_name FROM code_chunks",
)
def split_oversize(spark, sf):
    """As c13 with a merge target of nothing: the pieces before small ones are merged."""
    return _code_rows(spark, sf, 0, "symbol_kind", "symbol_name")


@query(
    "c9_split_oversize_deep",
    sql_code_chunks(0, DEEP_SHAPES, 6)
    + " SELECT file_id, start_line, end_line, content_tokens, symbol_kind, symbol_name FROM code_chunks",
)
def split_oversize_deep(spark, sf):
    """Classes five deep: cut at the symbols of every level that its piece still needs."""
    return _code_rows(spark, sf, 0, "symbol_kind", "symbol_name", shapes=DEEP_SHAPES)


@query(
    "c13_chunk_code_deep",
    sql_code_chunks(TARGET, DEEP_SHAPES, 6)
    + " SELECT file_id, start_line, end_line, content_tokens, symbol_kind, symbol_name, source_stage, text_md5 FROM code_chunks",
)
def chunk_code_deep(spark, sf):
    return _code_rows(
        spark, sf, TARGET, "symbol_kind", "symbol_name", "source_stage", F.md5("text").alias("text_md5"), shapes=DEEP_SHAPES
    )


@query(
    "c14_assemble_chunks",
    f"""WITH {SQL_CODE},{SQL_IMPORTS},{SQL_BLAME},
modules AS (SELECT file_id, string_agg(module, ',' ORDER BY line) AS modules FROM edges GROUP BY file_id),
entries AS (
  SELECT s.file_id, s.s, s.e, string_agg(left(commit_sha, 8) || '@' || author, ',' ORDER BY line_no) AS blame
  FROM symbols s JOIN blame b ON b.file_id = s.file_id AND b.line_no BETWEEN s.s AND s.e GROUP BY ALL),
candidates AS (
  SELECT file_id, s, e, kind, name, (s.depth > 0) AS inner_one,
         (SELECT string_agg(line, '' ORDER BY line_no) FROM lines l
          WHERE l.file_id = s.file_id AND l.line_no BETWEEN s.s AND s.e) AS body
  FROM symbols s)
SELECT sha256(concat_ws(':', source, lang || '/' || source || '/' || c.file_id || '.py', c.s, c.e, sha256(body))) AS chunk_id,
       c.file_id, c.s AS start_line, c.e AS end_line, kind AS symbol_kind, name AS symbol_name,
       len(regexp_extract_all(body, '{TOKENS}'))::BIGINT AS content_tokens, 'code' AS chunk_type,
       coalesce(modules, '') AS imports, blame
FROM candidates c JOIN documents d ON d.doc_id = c.file_id
LEFT JOIN modules USING (file_id) LEFT JOIN entries n ON n.file_id = c.file_id AND n.s = c.s AND n.e = c.e""",
)
def assemble(spark, sf):
    """One candidate per symbol, so that every blame range matches exactly."""
    from corpusq.functions import spans
    from corpusq.functions.text import let, token_count

    files = code_files(spark, sf)
    outlined = outline.symbol_outline(files)
    with_text = let(
        spans.split_lines(F.col("content")),
        lambda ls: F.transform(
            "symbols",
            lambda s: F.struct(
                s["start_line"].alias("start_line"),
                s["end_line"].alias("end_line"),
                s["kind"].alias("symbol_kind"),
                s["name"].alias("symbol_name"),
                spans.span_text(ls, s["start_line"], s["end_line"]).alias("text"),
            ),
        ),
    )
    candidates = (
        inline_rows(outlined, ["file_id", "repository_id", "path", "language"], with_text, "start_line")
        .withColumn("content_tokens", token_count(F.col("text")))
    )
    edges = outline.import_edges(files)
    metadata = outline.symbol_metadata(
        _symbols(spark, sf), edges, outline.parse_blame(blame_dumps(spark, sf))
    )
    rows = chunking.assemble_chunks(candidates, metadata, outline.file_imports(edges))
    return rows.select(
        "chunk_id",
        "file_id",
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        "symbol_kind",
        "symbol_name",
        F.col("content_tokens").cast("long").alias("content_tokens"),
        "chunk_type",
        F.array_join("imports", ",").alias("imports"),
        F.array_join(
            F.transform("git_blame", lambda b: F.concat_ws("@", F.substring(b["commit_sha"], 1, 8), b["author"])), ","
        ).alias("blame"),
    )
