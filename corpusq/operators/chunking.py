"""Text to chunk rows. Input rows carry the whole text of one file.

Every operator is a narrow projection over the file row (see ``functions.spans``),
so a corpus is chunked without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions import spans
from corpusq.functions.text import let, token_count
from corpusq.session import inline_rows

MAX_TOKENS, MIN_TOKENS, MERGE_TARGET = 512, 64, 256


def explode_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per line: ``line_no`` from 1 and ``line`` with its terminator."""
    others = [c for c in files.columns if c != text]
    lines = files.select(*others, F.posexplode_outer(spans.split_lines(F.col(text))).alias("line_no", "line"))
    return lines.where("line IS NOT NULL").withColumn("line_no", F.col("line_no") + 1)


def _inline(files: DataFrame, text: str, array: Column) -> DataFrame:
    others = [c for c in files.columns if c != text]
    return inline_rows(files, others, array, "start_line")


def _over_lines(text: str, body) -> Column:
    return let(spans.split_lines(F.col(text)), body)


def heading_sections(files: DataFrame, text: str = "content") -> DataFrame:
    return _inline(files, text, _over_lines(text, spans.heading_sections))


def merge_empty_headings(files: DataFrame, text: str = "content") -> DataFrame:
    return _inline(
        files,
        text,
        _over_lines(text, lambda ls: spans.merge_empty_headings(spans.heading_sections(ls), ls)),
    )


def paragraph_units(files: DataFrame, text: str = "content") -> DataFrame:
    """Paragraph units of the whole text taken as one span."""
    return _inline(
        files, text, _over_lines(text, lambda ls: spans.paragraph_units(ls, F.lit(1), F.size(ls)))
    )


def pack_budget(files: DataFrame, max_tokens: int = MAX_TOKENS, text: str = "content") -> DataFrame:
    """Paragraph units packed greedily under the token budget."""

    def body(ls: Column) -> Column:
        return let(
            spans.line_tokens(ls),
            lambda ts: spans.pack_units(
                spans.paragraph_units(ls, F.lit(1), F.size(ls)), ts, max_tokens, F.size(ls)
            ),
        )

    return _inline(files, text, _over_lines(text, body))


def line_windows(
    files: DataFrame,
    max_tokens: int = MAX_TOKENS,
    min_tokens: int = MIN_TOKENS,
    text: str = "content",
) -> DataFrame:
    def body(ls: Column) -> Column:
        return let(
            spans.line_tokens(ls),
            lambda ts: spans.line_windows(ts, F.lit(1), F.size(ls), max_tokens, min_tokens),
        )

    return _inline(files, text, _over_lines(text, body))


def outermost_spans(files: DataFrame, symbols: str = "symbols") -> DataFrame:
    others = [c for c in files.columns if c != symbols]
    return inline_rows(files, others, spans.outermost_spans(F.sort_array(symbols)), "start_line")


def fill_gaps(files: DataFrame, symbols: str = "symbols", text: str = "content") -> DataFrame:
    """Outermost symbols plus ``module`` spans for the lines between them."""
    others = [c for c in files.columns if c not in (symbols, text)]
    array = _over_lines(text, lambda ls: spans.fill_gaps(spans.outermost_spans(F.sort_array(symbols)), ls))
    return inline_rows(files, others, array, "start_line")


def _chunk(content: Column, span: Column, name: Column, kind: Column, stage: Column) -> Column:
    return let(
        content,
        lambda text: F.struct(
            span["start_line"].alias("start_line"),
            span["end_line"].alias("end_line"),
            name.alias("symbol_name"),
            kind.alias("symbol_kind"),
            text.alias("text"),
            token_count(text).alias("content_tokens"),
            stage.alias("source_stage"),
        ),
    )


def markdown_chunks(ls: Column, max_tokens: int, min_tokens: int) -> Column:
    """Chunks of one prose file as an array."""
    return F.transform(
        spans.markdown_spans(ls, max_tokens, min_tokens),
        lambda p: _chunk(
            spans.span_text(ls, p["start_line"], p["end_line"]),
            p, p["symbol_name"], F.lit("markdown_section"), F.lit("semantic"),
        ),
    )


def chunk_markdown(
    files: DataFrame,
    max_tokens: int = MAX_TOKENS,
    min_tokens: int = MIN_TOKENS,
    text: str = "content",
) -> DataFrame:
    """Chunk rows of prose files: section, paragraph, then line boundaries."""
    return _inline(
        files, text, _over_lines(text, lambda ls: markdown_chunks(ls, max_tokens, min_tokens))
    )


def split_oversize(
    pieces: Column, symbols: Column, tokens: Column, max_tokens: int, min_tokens: int
) -> Column:
    """Pieces over the budget are cut at the child spans, one nesting level at a time.

    The levels are those of the row: a fold over 1 to one below its deepest symbol. There
    what is still too long is cut at line boundaries; so is a gap between symbols, which has
    no children.
    """
    piece = "array<struct<start_line:int,end_line:int,kind:string,name:string>>"
    last = F.coalesce(F.array_max(F.transform(symbols, lambda s: s["depth"])), F.lit(0)) + 1

    def cut(p: Column, level: Column) -> Column:
        start, end = p["start_line"], p["end_line"]
        whole = F.array(F.struct(start.alias("start_line"), end.alias("end_line")))
        windows = spans.line_windows(tokens, start, end, max_tokens, min_tokens)
        inside = F.filter(
            symbols,
            lambda c: (c["depth"] == level) & (c["start_line"] >= start) & (c["end_line"] <= end),
        )
        by_children = let(
            inside,
            lambda cs: F.when(
                F.size(cs) > 0,
                spans.pack_units(spans.child_units(cs, start, end), tokens, max_tokens, end),
            ).otherwise(F.when(level == last, windows).otherwise(whole)),
        )
        fits = spans.span_tokens(tokens, start, end) <= max_tokens
        return F.transform(
            F.when(fits, whole).when(p["kind"] == "module", windows).otherwise(by_children),
            lambda s: F.struct(
                s["start_line"].alias("start_line"),
                s["end_line"].alias("end_line"),
                p["kind"].alias("kind"),
                p["name"].alias("name"),
            ),
        )

    bare = F.transform(pieces, lambda p: F.struct(*[p[f].alias(f) for f in ("start_line", "end_line", "kind", "name")]))
    return F.aggregate(
        F.sequence(F.lit(1), last),
        bare.cast(piece),
        lambda held, level: F.flatten(F.transform(held, lambda p: cut(p, level))).cast(piece),
    )


def code_chunks(
    ls: Column, symbols: Column, max_tokens: int, min_tokens: int, target: int
) -> Column:
    """Chunks of one code file as an array."""

    def body(ss: Column, tokens: Column) -> Column:
        pieces = spans.fill_gaps(spans.outermost_spans(ss), ls)
        cut = split_oversize(pieces, ss, tokens, max_tokens, min_tokens)

        def content(m: Column) -> Column:
            return F.array_join(
                F.transform(
                    m["parts"], lambda p: spans.span_text(ls, p["start_line"], p["end_line"])
                ),
                "",
            )

        return F.transform(
            spans.merge_small(cut, tokens, target),
            lambda m: _chunk(content(m), m, m["name"], m["kind"], m["source_stage"]),
        )

    return let(
        F.sort_array(symbols), lambda ss: let(spans.line_tokens(ls), lambda ts: body(ss, ts))
    )


def chunk_code(
    files: DataFrame,
    max_tokens: int = MAX_TOKENS,
    min_tokens: int = MIN_TOKENS,
    target: int = MERGE_TARGET,
    text: str = "content",
    symbols: str = "symbols",
) -> DataFrame:
    """Chunk rows of code files.

    ``symbols`` is an array of (start_line, end_line, kind, name, depth), as made by
    ``operators.outline``. Outermost symbols and the gaps between them are cut to
    the budget, then small neighbours of one kind are merged; a merged chunk leaves
    out the blank lines between its parts.
    """
    array = _over_lines(
        text, lambda ls: code_chunks(ls, F.col(symbols), max_tokens, min_tokens, target)
    )
    return _inline(files, text, array).drop(symbols)


def merge_small(pieces: DataFrame, target: int = MERGE_TARGET) -> DataFrame:
    """Rows (file_id, lines, tokens, pieces) to merged spans with their text."""
    merged = spans.merge_small(F.col("pieces"), F.col("tokens"), target)
    rows = inline_rows(pieces, ["file_id", "lines"], merged, "start_line")
    text = F.array_join(
        F.transform("parts", lambda p: spans.span_text(F.col("lines"), p["start_line"], p["end_line"])),
        "",
    )
    return rows.select(
        "file_id", "start_line", "end_line", "kind", "name", "source_stage", text.alias("text")
    )


def count_with(tokenizer_factory, df: DataFrame, text: str, out: str = "content_tokens") -> DataFrame:
    """Token counts by a user's tokenizer, built once per Python worker.

    ``tokenizer_factory()`` gives a function from a list of texts to a list of counts.
    """

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = tokenizer_factory()
        for texts in batches:
            yield pd.Series(counter(texts.fillna("").tolist()), dtype="int32")

    return df.withColumn(out, F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(count(text)))


def assemble_chunks(candidates: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Chunk rows with a stable id, type, file-wide imports and blame.

    ``symbols`` (file_id, start_line, end_line, blame) gives blame only on an exact
    line match. ``imports`` (file_id, modules) is one row per file.
    The id is a hash of place and content, so a rerun gives the same ids.
    """
    blame = symbols.select("file_id", "start_line", "end_line", "blame").dropDuplicates(
        ["file_id", "start_line", "end_line"]
    )
    return (
        candidates.join(blame, ["file_id", "start_line", "end_line"], "left")
        .join(imports, "file_id", "left")
        .select(
            F.sha2(
                F.concat_ws(
                    ":", "repository_id", "path", "start_line", "end_line", F.sha2("text", 256)
                ),
                256,
            ).alias("chunk_id"),
            "file_id",
            "repository_id",
            "symbol_name",
            "symbol_kind",
            "start_line",
            "end_line",
            F.col("text").alias("content"),
            "content_tokens",
            F.when(F.col("language") == "markdown", F.lit("prose"))
            .otherwise(F.lit("code"))
            .alias("chunk_type"),
            F.coalesce("modules", F.array().cast("array<string>")).alias("imports"),
            F.when(F.size("blame") > 0, F.col("blame")).alias("git_blame"),
        )
    )
