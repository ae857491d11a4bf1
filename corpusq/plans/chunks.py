"""Chunking queries over whole documents, with headings and blank lines put in by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq.functions import spans
from corpusq.functions.text import TOKEN_PATTERN, token_count
from corpusq.operators import chunking
from corpusq.plans import tables as t
from corpusq.plans.registry import query

MAX, MIN, TARGET = 128, 32, 64


def markdown_files(spark, sf):
    """Documents as markdown: headings at every fifth line, blank lines, empty headings."""
    d = t.texts(spark, sf)

    def mark(line, n):
        i = n + 1
        return F.concat(
            F.when(i % 5 == 1, F.concat(F.repeat(F.lit("#"), 1 + i % 3), F.lit(" "))).otherwise(F.lit("")),
            line,
            F.when(i % 3 == 0, F.lit("\n")).otherwise(F.lit("")),
            F.when(i % 7 == 0, F.concat(F.lit("\n### Part "), i.cast("string"))).otherwise(F.lit("")),
            F.when(i % 14 == 0, F.concat(F.lit("\n#### Sub "), i.cast("string"))).otherwise(F.lit("")),
        )

    return d.select(
        F.col("doc_id").alias("file_id"),
        F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("content"),
    )


TOKENS = TOKEN_PATTERN.replace("'", "''")
HEAD = "^(#{1,6})\\s+(.*\\S)\\s*$"

SQL_MD = """
raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
md AS (
  SELECT doc_id AS file_id, string_agg(
    CASE WHEN i % 5 = 1 THEN repeat('#', 1 + i % 3) || ' ' ELSE '' END || l
    || CASE WHEN i % 3 = 0 THEN chr(10) ELSE '' END
    || CASE WHEN i % 7 = 0 THEN chr(10) || '### Part ' || i ELSE '' END
    || CASE WHEN i % 14 = 0 THEN chr(10) || '#### Sub ' || i ELSE '' END, chr(10) ORDER BY i) AS text
  FROM raw_lines GROUP BY doc_id)"""


def sql_lines(source: str = "md") -> str:
    return f"""
line_parts AS (SELECT file_id, string_split(text, chr(10)) AS parts FROM {source}),
line_numbers AS (SELECT *, unnest(generate_series(1, len(parts))) AS line_no FROM line_parts),
lines AS (
  SELECT file_id, line_no, line, len(regexp_extract_all(line, '{TOKENS}')) AS tok,
         regexp_matches(line, '\\S') AS is_text, regexp_matches(line, '{HEAD}') AS is_head
  FROM (SELECT file_id, line_no,
               parts[line_no] || CASE WHEN line_no < len(parts) THEN chr(10) ELSE '' END AS line
        FROM line_numbers)
  WHERE line <> '')"""


SQL_SECTIONS = f"""
headed AS (
  SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS sec
  FROM lines),
sections AS (
  SELECT file_id, sec, min(line_no) AS s, max(line_no) AS e,
         max(CASE WHEN is_head THEN length(regexp_extract(line, '{HEAD}', 1)) ELSE 0 END) AS level,
         max(CASE WHEN is_head THEN regexp_extract(line, '{HEAD}', 2) END) AS name,
         sec = 0 OR bool_or(is_text AND NOT is_head) AS has_body
  FROM headed GROUP BY file_id, sec)"""

SQL_MERGED = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sec) AS k FROM sections),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY file_id, has_body ORDER BY k) AS run FROM numbered),
places AS (SELECT *, row_number() OVER (PARTITION BY file_id, has_body, run ORDER BY k) AS p FROM runs),
taken AS (
  SELECT *, coalesce(lag(NOT has_body AND p % 2 = 1) OVER (PARTITION BY file_id ORDER BY k), false) AS absorbed
  FROM places),
groups AS (
  SELECT *, sum(CASE WHEN absorbed THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY k) AS g FROM taken),
merged AS (
  SELECT file_id, g, min(s) AS s, max(e) AS e, arg_min(level, k) AS level, arg_min(name, k) AS name
  FROM groups GROUP BY file_id, g)"""


def sql_units(source: str, name: str = "units", keys: str = "file_id") -> str:
    """Paragraph units of spans (keys…, line_no, is_text, tok) numbered k from 1."""
    return f"""
{name}_flags AS (
  SELECT *, is_text AND coalesce(NOT lag(is_text) OVER w, true) AS opens FROM {source}
  WINDOW w AS (PARTITION BY {keys} ORDER BY line_no)),
{name}_ids AS (
  SELECT *, greatest(1, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY line_no)) AS k
  FROM {name}_flags),
{name} AS (
  SELECT {keys}, k, min(line_no) AS s, max(line_no) AS e, sum(tok) AS tok FROM {name}_ids GROUP BY {keys}, k)"""


def sql_greedy(units: str, name: str, max_tokens: int, keys: list[str]) -> str:
    """Greedy packing of numbered units as a recursive walk; piece numbers from 1."""
    cols = ", ".join(keys)
    r_cols = ", ".join(f"u.{c}" for c in keys)
    on = " AND ".join(f"u.{c} = r.{c}" for c in keys)
    return f"""
{name}_walk AS (
  SELECT {cols}, k, s, e, tok, 1 AS piece, tok AS total FROM {units} WHERE k = 1
  UNION ALL
  SELECT {r_cols}, u.k, u.s, u.e, u.tok,
         CASE WHEN r.total + u.tok > {max_tokens} THEN r.piece + 1 ELSE r.piece END,
         CASE WHEN r.total + u.tok > {max_tokens} THEN u.tok ELSE r.total + u.tok END
  FROM {name}_walk r JOIN {units} u ON {on} AND u.k = r.k + 1),
{name} AS (
  SELECT {cols}, piece, min(s) AS s, max(e) AS e, sum(tok) AS tok FROM {name}_walk GROUP BY {cols}, piece)"""


def sql_tail_fix(pieces: str, name: str, min_tokens: int, keys: list[str]) -> str:
    cols = ", ".join(keys)
    return f"""
{name}_marked AS (
  SELECT *, CASE WHEN piece = max(piece) OVER w AND piece > 1 AND tok < {min_tokens} THEN piece - 1 ELSE piece END AS p2
  FROM {pieces} WINDOW w AS (PARTITION BY {cols})),
{name} AS (
  SELECT {cols}, p2 AS piece, min(s) AS s, max(e) AS e, sum(tok) AS tok FROM {name}_marked GROUP BY {cols}, p2)"""


def _span_rows(df, *more):
    return df.select(
        "file_id",
        F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"),
        *more,
    )


@query(
    "c1_explode_lines",
    f"WITH {SQL_MD},{sql_lines()} SELECT file_id, line_no, line FROM lines",
)
def explode_lines(spark, sf):
    df = chunking.explode_lines(markdown_files(spark, sf))
    return df.select("file_id", F.col("line_no").cast("long").alias("line_no"), "line")


_SECTION_COLUMNS = "file_id, s AS start_line, e AS end_line, level::BIGINT AS level, name"


@query(
    "c2_heading_sections",
    f"WITH {SQL_MD},{sql_lines()},{SQL_SECTIONS} SELECT {_SECTION_COLUMNS} FROM sections",
)
def heading_sections(spark, sf):
    df = chunking.heading_sections(markdown_files(spark, sf))
    return _span_rows(df, F.col("level").cast("long").alias("level"), "name")


@query(
    "c3_merge_empty_headings",
    f"WITH {SQL_MD},{sql_lines()},{SQL_SECTIONS},{SQL_MERGED} SELECT {_SECTION_COLUMNS} FROM merged",
)
def merge_empty_headings(spark, sf):
    df = chunking.merge_empty_headings(markdown_files(spark, sf))
    return _span_rows(df, F.col("level").cast("long").alias("level"), "name")


@query(
    "c4_paragraph_units",
    f"WITH {SQL_MD},{sql_lines()},{sql_units('lines')} SELECT file_id, s AS start_line, e AS end_line FROM units",
)
def paragraph_units(spark, sf):
    return _span_rows(chunking.paragraph_units(markdown_files(spark, sf)))


@query(
    "c5_pack_budget",
    f"""WITH RECURSIVE {SQL_MD},{sql_lines()},{sql_units('lines')},
{sql_greedy('units', 'packed', MAX, ['file_id'])}
SELECT file_id, s AS start_line, e AS end_line FROM packed""",
)
def pack_budget(spark, sf):
    return _span_rows(chunking.pack_budget(markdown_files(spark, sf), MAX))


_LINE_UNITS = "line_units AS (SELECT file_id, line_no AS k, line_no AS s, line_no AS e, tok FROM lines)"


@query(
    "c6_line_windows",
    f"""WITH RECURSIVE {SQL_MD},{sql_lines()},{_LINE_UNITS},
{sql_greedy('line_units', 'windows', MAX, ['file_id'])},{sql_tail_fix('windows', 'fixed', MIN, ['file_id'])}
SELECT file_id, s AS start_line, e AS end_line FROM fixed""",
)
def line_windows(spark, sf):
    return _span_rows(chunking.line_windows(markdown_files(spark, sf), MAX, MIN))


@query(
    "c11_token_count",
    f"SELECT doc_id, len(regexp_extract_all(text, '{TOKENS}'))::BIGINT AS tokens FROM documents",
)
def count_tokens(spark, sf):
    return t.texts(spark, sf).select(
        "doc_id", token_count(F.col("text")).cast("long").alias("tokens")
    )


def sql_markdown(source: str, max_tokens: int, min_tokens: int) -> str:
    """Chunks of md(file_id, text), which ``source`` defines."""
    return f"""
{source},{sql_lines()},{SQL_SECTIONS},{SQL_MERGED},
section_lines AS (
  SELECT l.*, m.g, m.name, sum(l.tok) OVER w AS section_tok, bool_or(l.is_text) OVER w AS any_text
  FROM lines l JOIN merged m ON m.file_id = l.file_id AND l.line_no BETWEEN m.s AND m.e
  WINDOW w AS (PARTITION BY l.file_id, m.g)),
whole AS (
  SELECT file_id, g, name, min(line_no) AS s, max(line_no) AS e FROM section_lines
  WHERE any_text AND section_tok <= {max_tokens} GROUP BY ALL),
long_lines AS (SELECT * FROM section_lines WHERE any_text AND section_tok > {max_tokens}),
{sql_units('long_lines', 'units', 'file_id, g')},
{sql_greedy('units', 'packed', max_tokens, ['file_id', 'g'])},
big_units AS (
  SELECT l.file_id, p.s AS g, row_number() OVER (PARTITION BY l.file_id, p.s ORDER BY l.line_no) AS k,
         l.line_no AS s, l.line_no AS e, l.tok
  FROM packed p JOIN lines l ON l.file_id = p.file_id AND l.line_no BETWEEN p.s AND p.e
  WHERE p.tok > {max_tokens}),
{sql_greedy('big_units', 'windows', max_tokens, ['file_id', 'g'])},
{sql_tail_fix('windows', 'fixed', min_tokens, ['file_id', 'g'])},
pieces AS (
  SELECT file_id, s, e FROM whole
  UNION ALL SELECT file_id, s, e FROM packed WHERE tok <= {max_tokens}
  UNION ALL SELECT file_id, s, e FROM fixed),
markdown_chunks AS (
  SELECT p.file_id, p.s AS start_line, p.e AS end_line, arg_min(l.name, l.line_no) AS symbol_name,
         string_agg(l.line, '' ORDER BY l.line_no) AS chunk_text, sum(l.tok) AS tokens
  FROM pieces p JOIN section_lines l ON l.file_id = p.file_id AND l.line_no BETWEEN p.s AND p.e
  GROUP BY p.file_id, p.s, p.e)"""


@query(
    "c12_chunk_markdown",
    f"""WITH RECURSIVE {sql_markdown(SQL_MD, MAX, MIN)}
SELECT file_id, start_line, end_line, symbol_name, md5(chunk_text) AS text_md5, tokens::BIGINT AS tokens
FROM markdown_chunks""",
)
def chunk_markdown(spark, sf):
    df = chunking.chunk_markdown(markdown_files(spark, sf), MAX, MIN)
    return _span_rows(
        df,
        "symbol_name",
        F.md5("text").alias("text_md5"),
        F.col("content_tokens").cast("long").alias("tokens"),
    )


# --- spans of code: symbols by rule, one opening at every long line -------------------

WIDE = 250


def files_with_symbols(spark, sf):
    d = t.texts(spark, sf)
    lines = F.split("text", "\n")
    marked = F.filter(
        F.transform(
            lines,
            lambda line, n: F.struct(
                (n + 1).alias("start_line"),
                F.least(n + 1 + F.length(line) % 9, F.size(lines)).alias("end_line"),
                F.when((n + 1) % 2 == 0, F.lit("function")).otherwise(F.lit("class")).alias("kind"),
                F.concat(F.lit("s"), (n + 1).cast("string")).alias("name"),
                (F.length(line) > WIDE).alias("wide"),
            ),
        ),
        lambda s: s["wide"],
    )
    symbols = F.transform(
        marked,
        lambda s: F.struct(*[s[c].alias(c) for c in ("start_line", "end_line", "kind", "name")]),
    )
    # Every fourth line of the text is blank, so gaps of blank lines occur.
    spaced = F.array_join(
        F.transform(lines, lambda line, n: F.when((n + 1) % 4 == 1, F.lit("")).otherwise(line)), "\n"
    )
    return d.select(F.col("doc_id").alias("file_id"), symbols.alias("symbols"), spaced.alias("content"))


SQL_SYMBOLS = f"""
src AS (
  SELECT doc_id AS file_id, len(string_split(text, chr(10))) AS n,
         unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
spaced AS (
  SELECT file_id, string_agg(CASE WHEN i % 4 = 1 THEN '' ELSE l END, chr(10) ORDER BY i) AS text
  FROM src GROUP BY file_id),
symbols AS (
  SELECT file_id, i AS s, least(i + length(l) % 9, n) AS e,
         CASE WHEN i % 2 = 0 THEN 'function' ELSE 'class' END AS kind, 's' || i AS name
  FROM src WHERE length(l) > {WIDE}),
outermost AS (
  SELECT * FROM (
    SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM symbols)
  WHERE before IS NULL OR e > before)"""


@query(
    "c7_outermost_spans",
    f"WITH {SQL_SYMBOLS} SELECT file_id, s AS start_line, e AS end_line, kind, name FROM outermost",
)
def outermost_spans(spark, sf):
    df = files_with_symbols(spark, sf).drop("content")
    return _span_rows(chunking.outermost_spans(df), "kind", "name")


SQL_GAPS = """
line_counts AS (SELECT file_id, max(line_no) AS n FROM lines GROUP BY file_id),
borders AS (
  SELECT file_id, coalesce(lag(e) OVER w, 0) + 1 AS s, s - 1 AS e FROM outermost
  WINDOW w AS (PARTITION BY file_id ORDER BY s)
  UNION ALL
  SELECT c.file_id, coalesce(max(o.e), 0) + 1, n FROM line_counts c LEFT JOIN outermost o USING (file_id)
  GROUP BY c.file_id, n),
gaps AS (
  SELECT b.file_id, b.s, b.e FROM borders b
  JOIN lines l ON l.file_id = b.file_id AND l.line_no BETWEEN b.s AND b.e
  GROUP BY ALL HAVING bool_or(l.is_text)),
filled AS (
  SELECT file_id, s, e, kind, name FROM outermost
  UNION ALL SELECT file_id, s, e, 'module', NULL FROM gaps)"""


@query(
    "c8_fill_gaps",
    f"""WITH {SQL_SYMBOLS},{sql_lines('spaced')},{SQL_GAPS}
SELECT file_id, s AS start_line, e AS end_line, kind, name FROM filled""",
)
def fill_gaps(spark, sf):
    return _span_rows(chunking.fill_gaps(files_with_symbols(spark, sf)), "kind", "name")


@query(
    "c10_merge_small",
    f"""WITH RECURSIVE {SQL_MD},{sql_lines()},{sql_units('lines')},
kinds AS (
  SELECT *, CASE WHEN k % 5 < 3 THEN 'function' ELSE 'method' END AS kind FROM units),
walk AS (
  SELECT file_id, k, s, e, tok, kind, 1 AS piece, tok AS total FROM kinds WHERE k = 1
  UNION ALL
  SELECT u.file_id, u.k, u.s, u.e, u.tok, u.kind,
         CASE WHEN u.kind <> r.kind OR r.total + u.tok > {TARGET} THEN r.piece + 1 ELSE r.piece END,
         CASE WHEN u.kind <> r.kind OR r.total + u.tok > {TARGET} THEN u.tok ELSE r.total + u.tok END
  FROM walk r JOIN kinds u ON u.file_id = r.file_id AND u.k = r.k + 1),
joined AS (
  SELECT file_id, piece, min(s) AS start_line, max(e) AS end_line, min(kind) AS kind,
         CASE WHEN count(*) > 1 THEN 'merged' ELSE 'ast' END AS source_stage
  FROM walk GROUP BY file_id, piece)
SELECT j.file_id, start_line, end_line, kind, source_stage, md5(string_agg(l.line, '' ORDER BY l.line_no)) AS text_md5
FROM joined j JOIN lines l ON l.file_id = j.file_id AND l.line_no BETWEEN j.start_line AND j.end_line
GROUP BY ALL""",
)
def merge_small(spark, sf):
    """Paragraph units as pieces, alternating between two kinds."""
    f = markdown_files(spark, sf)
    lines = f.select("file_id", F.explode(F.array(spans.split_lines(F.col("content")))).alias("lines"))
    pieces = lines.withColumn("tokens", spans.line_tokens(F.col("lines"))).withColumn(
        "pieces",
        F.transform(
            spans.paragraph_units(F.col("lines"), F.lit(1), F.size("lines")),
            lambda u, n: F.struct(
                u["start_line"].alias("start_line"),
                u["end_line"].alias("end_line"),
                F.when((n + 1) % 5 < 3, F.lit("function")).otherwise(F.lit("method")).alias("kind"),
                F.lit(None).cast("string").alias("name"),
            ),
        ),
    )
    df = chunking.merge_small(pieces, TARGET)
    return _span_rows(df, "kind", "source_stage", F.md5("text").alias("text_md5"))
