r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``### role: text</turn>`` and a line end. The grammar of the result:
turns follow each other; a role holds no ``:``; a text holds neither ``###`` nor ``</turn>``;
``\0``, ``\1``, ``\2``, ``\3`` stand for ``\``, ``###``, ``</turn>`` and ``:``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
# In this order when escaping, in the reverse order when reading back.
ESCAPES = [("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\3"), ("\n", "\\4")]


def escape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs: list[tuple[str, str]] = ROLE_ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(": "), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Array of struct(role, text, raw) read from rendered turns; null where the grammar fails.

    The close mark is found first, the colon next: each step has one possible outcome.
    """
    # split() takes a regular expression; no character of the mark is special there.
    pieces = F.split(formatted, "</turn>\n")
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ":", 1)
        body = F.substring(piece, F.char_length(head) + 3, F.char_length(piece))
        lawful = (
            piece.startswith(OPEN)
            & F.substring(piece, F.char_length(head) + 1, F.lit(2)).eqNullSafe(F.lit(": "))
            & ~F.contains(F.substring(piece, F.lit(4), F.char_length(piece)), F.lit("###"))
            & ~F.contains(piece, F.lit("</turn>"))
        )
        role = F.substring(head, F.lit(len(OPEN) + 1), F.char_length(head))
        return F.when(
            lawful,
            F.struct(unescape(role).alias("role"), unescape(body).alias("text"), body.alias("raw")),
        )

    return F.transform(pieces, turn)


def _safe(role: Column, text: Column) -> Column:
    """Struct(role, text) to render: as they are when a turn reads back identical, else escaped."""
    back = F.element_at(parse(render(role, text)), 1)
    same = (F.size(parse(render(role, text))) == 1) & back["role"].eqNullSafe(role) & back["text"].eqNullSafe(text)
    return F.when(F.coalesce(same, F.lit(False)), F.struct(role.alias("role"), text.alias("text"))).otherwise(
        F.struct(escape(role, ROLE_ESCAPES).alias("role"), escape(text).alias("text"))
    )


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, turns, identical.

    ``formatted`` is the training text; ``loss_spans`` are (start, length) in its code points
    of every text of ``loss_role``; ``turns`` is what the parser reads from it, with the raw
    text of each turn; ``identical`` says that this equals the source. A turn is rendered as
    it is when it reads back identical, otherwise with its control strings escaped.

    Null roles and texts are empty texts, a null conversation id is a conversation of its own.
    Turns are ordered by turn, then role, then text, so ties and repeated rows have one order;
    a null turn comes first. Other columns are not read. An empty table gives an empty result.
    A conversation is one row of the result and must fit into memory as such.
    """
    clean = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("safe", _safe(F.col("role"), F.col("text")))
    shown = clean.withColumn("shown", render(F.col("safe.role"), F.col("safe.text")))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, -1
    )
    start = F.coalesce(F.sum(F.char_length("shown")).over(before), F.lit(0)) + F.char_length(
        F.concat(F.lit(OPEN), F.col("safe.role"), F.lit(": "))
    )
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    placed = shown.select(
        "conv_id",
        F.struct(
            order.alias("n"),
            "role",
            "text",
            "shown",
            start.cast("long").alias("start"),
            F.char_length("safe.text").cast("long").alias("length"),
        ).alias("row"),
    )
    # The window and the groups need the same distribution: one shuffle of the rows.
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    whole = rows.select("conv_id", "rows", F.concat_ws("", "rows.shown").alias("formatted"))
    read = whole.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    got = F.transform("turns", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    return read.select(
        "conv_id",
        "formatted",
        F.transform(
            F.filter("rows", lambda r: r["role"] == loss_role),
            lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length")),
        ).alias("loss_spans"),
        "turns",
        source.eqNullSafe(got).alias("identical"),
    )
