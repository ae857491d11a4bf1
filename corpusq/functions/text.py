"""Column expressions over text: terms, token counts, keys, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: a term is a run of letters, digits or underscores; a token is a
# term or one punctuation character. Both leave whitespace out, so counts add up
# over lines.
TERM_PATTERN = r"[\p{L}\p{N}_]+"
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    The optimizer inlines a projected column into a lambda that names it once, and
    the lambda then computes it again per element. A one-element ``transform``
    keeps the value bound.
    """
    return F.transform(F.array(value), body)[0]


def terms(text: Column) -> Column:
    """Lower-cased terms in order of appearance."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens; null and empty text count 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0))


def run_lengths(ordered: Column) -> Column:
    """Sorted array -> array of (value, times), in one pass over the row."""

    def body(xs: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(xs) - 1),
            lambda i: (i == 0) | (F.get(xs, i) != F.get(xs, i - 1)),
        )
        return let(
            starts,
            lambda ss: F.transform(
                ss,
                lambda s, n: F.struct(
                    F.get(xs, s).alias("value"),
                    (F.coalesce(F.get(ss, n + 1), F.size(xs)) - s).alias("times"),
                ),
            ),
        )

    return F.when(F.size(ordered) > 0, let(ordered, body))


def _weight(times: Column) -> Column:
    return F.lit(1.0) + F.log(times.cast("double"))


def lexical_weights(text: Column) -> Column:
    """Sparse vector of a text: array of (term, weight), weight = 1 + ln(frequency).

    Everything happens inside the row, so nothing is shuffled however large or
    skewed the corpus is.
    """
    counted = run_lengths(F.sort_array(terms(text)))
    return F.coalesce(
        F.transform(
            counted,
            lambda c: F.struct(c["value"].alias("term"), _weight(c["times"]).alias("weight")),
        ),
        F.array().cast("array<struct<term:string,weight:double>>"),
    )


def sparse_vector(text: Column) -> Column:
    """Lexical weights keyed by a 64-bit hash of the term: struct(ids, weights).

    Terms are hashed before they are sorted: longs sort and compare faster.
    """
    hashed = F.sort_array(F.transform(terms(text), lambda term: F.xxhash64(term)))
    empty = F.array().cast("array<struct<value:bigint,times:int>>")
    return let(
        F.coalesce(run_lengths(hashed), empty),
        lambda cs: F.struct(
            F.transform(cs, lambda c: c["value"]).alias("ids"),
            F.transform(cs, lambda c: _weight(c["times"])).alias("weights"),
        ),
    )


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "
    )


def cache_key(text: Column, model_id: str | Column) -> Column:
    """Key that ignores whitespace differences and changes with the model."""
    model = F.lit(model_id) if isinstance(model_id, str) else model_id
    return F.sha2(F.concat(model, F.lit(":"), collapse_whitespace(text)), 256)


def rerank_text(text: Column, max_length: int = 512) -> Column:
    """Chunk side of a pair handed to a model: four characters per allowed token."""
    return F.substring(text, 1, max_length * 4)


def term_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that occur anywhere in the text."""
    return let(
        F.array_distinct(terms(query)),
        lambda q: F.when(
            F.size(q) > 0,
            F.size(F.array_intersect(q, terms(text))) / F.size(q),
        ).otherwise(F.lit(0.0)),
    )


def slugify(name: Column) -> Column:
    slug = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("workspace"))


# Intent labels in the order they are tried.
INTENTS = ["code_qa", "debugging", "architecture_explain", "doc_generation", "general_chat"]


def parse_label(text: Column, labels: list[str] = INTENTS, default: str = "code_qa") -> Column:
    """First label, in declared order, that occurs in the text."""
    lowered = F.lower(F.trim(text))
    chain = F.lit(default)
    for label in reversed(labels):
        chain = F.when(F.contains(lowered, F.lit(label)), F.lit(label)).otherwise(chain)
    return chain
