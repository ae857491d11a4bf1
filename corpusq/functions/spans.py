"""In-row text splitting: lines, sections, paragraphs and greedy packing.

A file's text lives in one row (its size is capped when the corpus is scanned), so
every step here is an expression over that row's own line array. Chunking a corpus
is therefore a narrow projection: no shuffle, and no key can become hot.

Spans are ``struct<start_line:int, end_line:int, ...>``, 1-based and inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusq.functions.text import let, token_count

# Fixed pattern: one to six hashes, white space, then a name.
HEADING_PATTERN = r"(?U)^(#{1,6})\s+(.*\S)\s*$"

INT_ARRAY = "array<int>"


def split_lines(text: Column) -> Column:
    """Lines with their terminators; a final newline opens no extra line."""
    parts = F.split(text, r"(?<=\n)|(?<=\r)(?!\n)")
    return F.filter(parts, lambda line: line != "")


def line_tokens(lines: Column) -> Column:
    return F.transform(lines, token_count)


def span_text(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start, end - start + 1), "")


def span_tokens(tokens: Column, start: Column, end: Column) -> Column:
    return F.aggregate(
        F.slice(tokens, start, end - start + 1), F.lit(0), lambda total, t: total + t
    )


def is_text(line: Column) -> Column:
    return line.rlike(r"(?U)\S")


def has_text(lines: Column, start: Column, end: Column) -> Column:
    return F.exists(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), is_text)


def _ints(start: Column, end: Column) -> Column:
    """start..end ascending, empty when end < start."""
    return F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast(INT_ARRAY))


def spans_from_starts(starts: Column, last: Column) -> Column:
    """Gap-free spans: each runs to the line before the next start."""
    return let(
        starts,
        lambda ss: F.transform(
            ss,
            lambda s, n: F.struct(
                s.alias("start_line"),
                F.coalesce(F.get(ss, n + 1) - 1, last).alias("end_line"),
            ),
        ),
    )


def heading_sections(lines: Column) -> Column:
    """Flat sections; any heading level opens one. Level 0 is the preamble."""

    def body(ls: Column) -> Column:
        heads = F.filter(
            _ints(F.lit(1), F.size(ls)), lambda i: F.get(ls, i - 1).rlike(HEADING_PATTERN)
        )
        starts = F.when(F.size(ls) == 0, F.array().cast(INT_ARRAY)).otherwise(
            F.array_union(F.array(F.lit(1)), heads)
        )
        return F.transform(
            spans_from_starts(starts, F.size(ls)),
            lambda s: let(
                F.get(ls, s["start_line"] - 1),
                lambda first: F.struct(
                    s["start_line"].alias("start_line"),
                    s["end_line"].alias("end_line"),
                    F.length(F.regexp_extract(first, HEADING_PATTERN, 1)).alias("level"),
                    F.nullif(F.regexp_extract(first, HEADING_PATTERN, 2), F.lit("")).alias("name"),
                ),
            ),
        )

    return let(lines, body)


def merge_empty_headings(sections: Column, lines: Column) -> Column:
    """Merge a heading without body into the section after it.

    Once merged, the pair holds a heading line and counts as having a body, so in a
    run of empty headings the first pairs with the second, the third with the
    fourth, and so on; an odd last one pairs with the section that ends the run, or
    stays alone at the end of the file. Between two sections with a body at
    positions ``a < b`` the surviving starts are therefore ``a+1, a+3, …``, which
    includes ``b`` exactly when the run between them is even.
    """

    def body(ss: Column) -> Column:
        count = F.size(ss)
        full = F.filter(
            _ints(F.lit(1), count),
            lambda i: let(
                F.get(ss, i - 1),
                lambda s: (s["level"] == 0)
                | has_text(lines, s["start_line"] + 1, s["end_line"]),
            ),
        )

        def kept(stops: Column) -> Column:
            runs = F.transform(
                stops,
                lambda stop, n: let(
                    F.coalesce(F.get(stops, n - 1), F.lit(0)) + 1,
                    lambda first: F.when(first <= stop, F.sequence(first, stop, F.lit(2))).otherwise(
                        F.array().cast(INT_ARRAY)
                    ),
                ),
            )
            return F.flatten(runs)

        # A run of empty headings at the end stops at the last section.
        closed = F.when(
            F.coalesce(F.try_element_at(full, F.lit(-1)), F.lit(0)) < count,
            F.concat(full, F.array(count)),
        ).otherwise(full)
        return let(
            let(closed, kept),
            lambda ks: F.transform(
                ks,
                lambda k, n: let(
                    F.get(ss, k - 1),
                    lambda s: F.struct(
                        s["start_line"].alias("start_line"),
                        F.get(
                            ss, F.coalesce(F.get(ks, n + 1) - 1, count) - 1
                        )["end_line"].alias("end_line"),
                        s["level"].alias("level"),
                        s["name"].alias("name"),
                    ),
                ),
            ),
        )

    return F.when(F.size(sections) > 0, let(sections, body)).otherwise(sections)


def paragraph_units(lines: Column, start: Column, end: Column) -> Column:
    """Units opening at each text line that follows a blank one; no gaps."""
    opens = F.filter(
        _ints(start, end),
        lambda i: is_text(F.get(lines, i - 1))
        & ((i == start) | ~is_text(F.get(lines, F.greatest(i - 2, F.lit(0))))),
    )
    starts = let(
        opens,
        lambda os: F.when(F.size(os) == 0, F.array(start)).otherwise(
            F.transform(os, lambda o, n: F.when(n == 0, start).otherwise(o))
        ),
    )
    return spans_from_starts(starts, end)


def pack_units(units: Column, tokens: Column, max_tokens: int, last: Column) -> Column:
    """Greedy packing: extend the open piece while it stays within the budget.

    The fold keeps only the starts of pieces, so its state is as small as its
    result.
    """
    empty = F.struct(F.array().cast(INT_ARRAY).alias("starts"), F.lit(0).alias("total"))

    def step(acc: Column, unit: Column) -> Column:
        size = span_tokens(tokens, unit["start_line"], unit["end_line"])
        return let(
            size,
            lambda t: F.when(
                (F.size(acc["starts"]) == 0) | (acc["total"] + t > max_tokens),
                F.struct(
                    F.concat(acc["starts"], F.array(unit["start_line"])).alias("starts"),
                    t.alias("total"),
                ),
            ).otherwise(
                F.struct(acc["starts"].alias("starts"), (acc["total"] + t).alias("total"))
            ),
        )

    starts = F.aggregate(units, empty, step, lambda acc: acc["starts"])
    return spans_from_starts(starts, last)


def line_windows(
    tokens: Column, start: Column, end: Column, max_tokens: int, min_tokens: int
) -> Column:
    """Greedy windows of single lines; a short last piece joins the one before.

    One over-long line stays whole, and the join may pass ``max_tokens``.
    """
    units = F.transform(
        _ints(start, end), lambda i: F.struct(i.alias("start_line"), i.alias("end_line"))
    )

    def fix(pieces: Column) -> Column:
        tail = F.try_element_at(pieces, F.lit(-1))
        short = (F.size(pieces) > 1) & (
            span_tokens(tokens, tail["start_line"], tail["end_line"]) < min_tokens
        )
        before = F.get(pieces, F.size(pieces) - 2)
        joined = F.struct(
            before["start_line"].alias("start_line"), tail["end_line"].alias("end_line")
        )
        return F.when(
            short, F.concat(F.slice(pieces, F.lit(1), F.size(pieces) - 2), F.array(joined))
        ).otherwise(pieces)

    return let(pack_units(units, tokens, max_tokens, end), fix)


def markdown_spans(lines: Column, max_tokens: int, min_tokens: int) -> Column:
    """Sections, then paragraphs, then lines: spans that fit the budget."""

    def body(ls: Column, tokens: Column) -> Column:
        sections = merge_empty_headings(heading_sections(ls), ls)

        def pieces(s: Column) -> Column:
            start, end = s["start_line"], s["end_line"]
            fits = span_tokens(tokens, start, end) <= max_tokens
            packed = pack_units(paragraph_units(ls, start, end), tokens, max_tokens, end)
            fine = F.flatten(
                F.transform(
                    packed,
                    lambda p: F.when(
                        span_tokens(tokens, p["start_line"], p["end_line"]) <= max_tokens,
                        F.array(p),
                    ).otherwise(
                        line_windows(tokens, p["start_line"], p["end_line"], max_tokens, min_tokens)
                    ),
                )
            )
            whole = F.array(F.struct(start.alias("start_line"), end.alias("end_line")))
            return F.transform(
                F.when(fits, whole).otherwise(fine),
                lambda p: F.struct(
                    p["start_line"].alias("start_line"),
                    p["end_line"].alias("end_line"),
                    s["name"].alias("symbol_name"),
                ),
            )

        kept = F.filter(sections, lambda s: has_text(ls, s["start_line"], s["end_line"]))
        return F.flatten(F.transform(kept, pieces))

    return let(lines, lambda ls: let(line_tokens(ls), lambda tokens: body(ls, tokens)))


# --- code ---------------------------------------------------------------------


def outermost_spans(symbols: Column) -> Column:
    """Sorted by start line, drop a span that lies inside the last kept one.

    Kept ends rise strictly, so a span is kept exactly when it ends after every
    span before it.
    """
    empty = F.struct(
        F.array().cast(INT_ARRAY).alias("kept"), F.lit(0).alias("last"), F.lit(0).alias("n")
    )

    def body(ss: Column) -> Column:
        kept = F.aggregate(
            ss,
            empty,
            lambda acc, s: F.when(
                s["end_line"] > acc["last"],
                F.struct(
                    F.concat(acc["kept"], F.array(acc["n"])).alias("kept"),
                    s["end_line"].alias("last"),
                    (acc["n"] + 1).alias("n"),
                ),
            ).otherwise(
                F.struct(
                    acc["kept"].alias("kept"), acc["last"].alias("last"), (acc["n"] + 1).alias("n")
                )
            ),
            lambda acc: acc["kept"],
        )
        return F.transform(kept, lambda i: F.get(ss, i))

    return let(symbols, body)


def fill_gaps(spans: Column, lines: Column) -> Column:
    """Lines before, between and after the spans become ``module`` spans.

    Gaps of blank lines only are dropped. Spans carry kind and name.
    """

    def module(start: Column, end: Column) -> Column:
        gap = F.struct(
            start.alias("start_line"),
            end.alias("end_line"),
            F.lit("module").alias("kind"),
            F.lit(None).cast("string").alias("name"),
        )
        return F.when((start <= end) & has_text(lines, start, end), F.array(gap)).otherwise(
            F.filter(F.array(gap), lambda _: F.lit(False))
        )

    def body(ss: Column) -> Column:
        inner = F.flatten(
            F.transform(
                ss,
                lambda s, n: F.concat(
                    module(
                        F.coalesce(F.get(ss, n - 1)["end_line"], F.lit(0)) + 1,
                        s["start_line"] - 1,
                    ),
                    F.array(
                        F.struct(
                            s["start_line"].alias("start_line"),
                            s["end_line"].alias("end_line"),
                            s["kind"].alias("kind"),
                            s["name"].alias("name"),
                        )
                    ),
                ),
            )
        )
        tail = module(F.coalesce(F.try_element_at(ss, F.lit(-1))["end_line"], F.lit(0)) + 1, F.size(lines))
        return F.concat(inner, tail)

    return let(spans, body)


def child_units(children: Column, start: Column, end: Column) -> Column:
    """One unit per child span inside [start, end].

    A unit runs to the line before the next child, the first one is stretched to
    ``start`` and the last to ``end``: full coverage without overlap.
    """
    starts = F.array_distinct(
        F.transform(children, lambda c, n: F.when(n == 0, start).otherwise(c["start_line"]))
    )
    return spans_from_starts(starts, end)


def merge_small(pieces: Column, tokens: Column, target: int) -> Column:
    """Left fold: join with the chunk before when the kind is the same and it fits.

    The lines between two joined pieces (blank gaps) are not part of the text, so a
    merged chunk lists the spans it is made of.
    """
    empty = F.struct(
        F.array().cast(INT_ARRAY).alias("starts"),
        F.lit(None).cast("string").alias("kind"),
        F.lit(0).alias("total"),
        F.lit(0).alias("n"),
    )

    def body(ps: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            return let(
                span_tokens(tokens, p["start_line"], p["end_line"]),
                lambda t: F.when(
                    (acc["kind"].eqNullSafe(p["kind"])) & (acc["total"] + t <= target),
                    F.struct(
                        acc["starts"].alias("starts"),
                        acc["kind"].alias("kind"),
                        (acc["total"] + t).alias("total"),
                        (acc["n"] + 1).alias("n"),
                    ),
                ).otherwise(
                    F.struct(
                        F.concat(acc["starts"], F.array(acc["n"])).alias("starts"),
                        p["kind"].alias("kind"),
                        t.alias("total"),
                        (acc["n"] + 1).alias("n"),
                    )
                ),
            )

        starts = F.aggregate(ps, empty, step, lambda acc: acc["starts"])
        return let(
            starts,
            lambda ss: F.transform(
                ss,
                lambda s, n: let(
                    F.slice(ps, s + 1, F.coalesce(F.get(ss, n + 1), F.size(ps)) - s),
                    lambda parts: F.struct(
                        parts[0]["start_line"].alias("start_line"),
                        F.try_element_at(parts, F.lit(-1))["end_line"].alias("end_line"),
                        parts[0]["kind"].alias("kind"),
                        parts[0]["name"].alias("name"),
                        F.when(F.size(parts) > 1, F.lit("merged"))
                        .otherwise(F.lit("ast"))
                        .alias("source_stage"),
                        parts.alias("parts"),
                    ),
                ),
            ),
        )

    return let(pieces, body)
