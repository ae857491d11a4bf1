"""Personal data by bootstrapped contextual extraction.

Rules find what is certain: these spans stand, and their values are the seeds. Seeds and all other
strings that look like identifiers occur in lexical patterns: the words around them, and their own
shape. Patterns and values form a graph over the whole corpus. Each round scores a pattern by the share
of its distinct values that are known, and a value by the patterns it occurs in; values that good
patterns agree on become known and count in the next round. Their places are the added spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind: string, start: int, end: int>>"
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A number starts at its first digit only, so a long one is not tried again from each of its digits.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# A token that holds a digit or '@', read once from its start.
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
EDGE_LEFT = re.compile(r"[^\w+(@]+|_+")
RUN = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"[0-9]")
ITEM = re.compile(r"[^\W_]+|[^\w\s]")
REACH = 64  # code points around an identifier in which its context words are looked for
WINDOW_TOKENS = 5
MIN_DIGITS = 7
LONG = 80
# Scores are whole thousandths and costs whole millionths, so that sums do not depend on their order.
UNIT, COST = 1000, 1_000_000
ROWS_OUT = 4096


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def _ip_holds(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _card_holds(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and _luhn(digits)


def _phone_holds(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


RULES = {"ip": (IP, _ip_holds), "card": (CARD, _card_holds), "phone": (PHONE, _phone_holds)}


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each '@': the characters before it back to the last match."""
    found, free, before, at = [], 0, 0, text.find("@")
    while at >= 0:
        lead = text[max(free, before) : at]
        start = at - (len(lead) - len(lead.rstrip(LOCAL)))
        before = at + 1
        if start < at and (host := DOMAIN.match(text, at + 1)):
            found.append((start, host.end()))
            free = host.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the rules find, by start, then kind. A match that fails its check is dropped, without another try."""
    found = [("email", *span) for span in emails(text)] if "@" in text else []
    for kind, (rule, holds) in RULES.items():
        found += [(kind, m.start(), m.end()) for m in rule.finditer(text) if holds(m.group())]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _short(text: str) -> str:
    """The text, or a digest in place of a long one."""
    return text if len(text) <= LONG else "#" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an occurrence: words to the left, words on both sides, and its own shape."""
    value = text[start:end]
    kind = "@" if "@" in value else "x" if RUN.search(value) else "n"

    def item(word: str) -> str:
        return re.sub(r"\d+", "0", word.lower())

    left = ["^", "^", "^", *map(item, ITEM.findall(text[max(0, start - REACH) : start]))][-3:]
    right = [*map(item, ITEM.findall(text[end : end + REACH])[:1]), "$"][:1]
    shape = DIGIT.sub("9", RUN.sub("a", value))
    return [
        _short(f"{kind} left {left[1]} {left[2]}"),
        _short(f"{kind} far {left[0]} {left[1]} {left[2]}"),
        _short(f"{kind} both {left[2]} _ {right[0]}"),
        _short(f"shape {shape}"),
    ]


def barred(value: str) -> list[str]:
    """Kinds whose rule covers the whole value and whose check refuses it."""
    return [k for k, (rule, holds) in RULES.items() if rule.fullmatch(value) and not holds(value)]


def windows(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Places of strings that look like identifiers and touch no base span.

    One token, or up to ``WINDOW_TOKENS`` neighbours without letters, with one space between
    them; an '@' or ``MIN_DIGITS`` digits at least; without punctuation at the ends.
    """
    spans = sorted((s, e) for _, s, e in taken)
    row: list[tuple[int, int, bool]] = []
    next_span = 0
    for m in TOKEN.finditer(text):
        word = m.group()
        lead = EDGE_LEFT.match(word)
        start = m.start() + (lead.end() if lead else 0)
        end = m.start() + len(word.rstrip("!\"#$%&'*+,-./:;<=>?@[\\]^_`{|}~(…»”’"))
        if start >= end:
            row = []
            continue
        # A key before the value, as in name=value, is context.
        cut = max(text.rfind("=", start, end), text.rfind(":", start, end)) + 1
        if cut and cut < end:
            lead = EDGE_LEFT.match(text, cut, end)
            start = lead.end() if lead else cut
        if start >= end:
            row = []
            continue
        numeric = not RUN.search(text[start:end]) and "@" not in text[start:end]
        joined = row and numeric and row[-1][2] and row[-1][1] + 1 == start and text[start - 1] == " " and start == m.start()
        row = [*row[-(WINDOW_TOKENS - 1) :], (start, end, numeric)] if joined else [(start, end, numeric)]
        if end != m.end():
            row[-1] = (start, end, False) if numeric else row[-1]
        for first, _, _ in row:
            while next_span < len(spans) and spans[next_span][1] <= row[0][0]:
                next_span += 1
            k, clash = next_span, False
            while k < len(spans) and spans[k][0] < end and not clash:
                clash = spans[k][1] > first
                k += 1
            value = text[first:end]
            if not clash and ("@" in value[1:-1] or len(DIGIT.findall(value)) >= MIN_DIGITS):
                yield first, end


def _scan(id_type: pa.DataType):
    """Rows of a text: one with its base spans, then one per occurrence of a seed or of a string like one."""
    names = ["row", "id", "base", "kind", "start", "end", "value", "barred", "patterns"]
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    types = [pa.int64(), id_type, pa.list_(span), pa.string(), pa.int32(), pa.int32(), pa.string()]
    types += [pa.list_(pa.string()), pa.list_(pa.string())]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, own, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                base = base_spans(text)
                out.append((row, own, [{"kind": k, "start": s, "end": e} for k, s, e in base], None, None, None, None, None, None))
                for kind, start, end in base:
                    out.append((row, None, None, kind, start, end, _short(text[start:end]), [], patterns(text, start, end)))
                for start, end in windows(text, base):
                    value = text[start:end]
                    out.append((row, None, None, None, start, end, _short(value), barred(value), patterns(text, start, end)))
                    if len(out) >= ROWS_OUT:
                        yield table(out)
                        out = []
            if out:
                yield table(out)

    return scan


def _bootstrap(
    seen: DataFrame, seeds: DataFrame | None, rounds: int, support: int, pattern_score: float, value_score: float
) -> DataFrame:
    """(value, kind, cost) of the values that the rounds have added; the higher the cost of an error, the surer."""
    occurring = seen.where("value IS NOT NULL")
    known = occurring.where("kind IS NOT NULL").select("value", "kind").distinct()
    if seeds is not None:
        known = known.union(seeds.select(F.col("value").cast("string"), F.col("kind").cast("string")).where("value IS NOT NULL AND kind IS NOT NULL")).distinct()
    known = staged(known.withColumn("score", F.lit(UNIT).cast("long")), "pii-known")
    # A pattern with fewer values than the support can never hold; most patterns of free text go here.
    links = staged(occurring.select("value", "barred", F.explode("patterns").alias("pattern")).distinct(), "pii-links")
    sizes = links.groupBy("pattern").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= support)
    links = staged(links.join(sizes, "pattern"), "pii-graph")
    added = None
    for turn in range(rounds):
        scores = known if added is None else known.unionByName(added.select("value", "kind", "score"))
        held = links.join(scores, "value").groupBy("pattern", "n", "kind").agg(F.sum("score").alias("held"))
        share = F.col("held") / ((F.col("n") + 1) * UNIT)
        good = held.where((F.col("held") >= support * UNIT) & (share >= pattern_score)).select(
            "pattern", "kind", F.floor(-F.log(1 - share) * COST).cast("long").alias("cost")
        )
        votes = links.join(good, "pattern").groupBy("value", "kind").agg(F.sum("cost").alias("cost"), F.first("barred").alias("barred"))
        sure = F.floor((1 - F.exp(-F.col("cost") / COST)) * UNIT).cast("long")
        new = votes.withColumn("score", sure).where(
            (F.col("score") >= int(value_score * UNIT)) & ~F.array_contains("barred", F.col("kind"))
        )
        added = staged(new.join(known.select("value"), "value", "left_anti").select("value", "kind", "score", "cost"), f"pii-added-{turn}")
    return added if seeds is None else added.select("value", "kind", "cost").union(
        known.join(occurring.where("kind IS NULL").select("value").distinct(), "value", "left_semi").select(
            "value", "kind", F.lit(1 << 62).cast("long").alias("cost")
        )
    )


def _merge(id_type: pa.DataType):
    """Base spans with the added ones: the surest first, the longer, the earlier; none touches another."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def order(s: dict) -> tuple:
        return s["start"], KINDS.index(s["kind"]) if s["kind"] in KINDS else len(KINDS), s["kind"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, extra in zip(batch["base"].to_pylist(), batch["extra"].to_pylist(), strict=True):
                free, held = [], set()
                for s in sorted(extra or (), key=lambda s: (-s["cost"], s["start"] - s["end"], *order(s))):
                    places = range(s["start"], s["end"])
                    if held.isdisjoint(places):
                        held.update(places)
                        free.append({k: s[k] for k in ("kind", "start", "end")})
                spans.append(sorted([*base, *free], key=order))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["base"], pa.array(spans, pa.list_(span))], names=["id", "base", "spans"])

    return merge


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seeds: DataFrame | None = None,
    rounds: int = 3,
    support: int = 5,
    pattern_score: float = 0.8,
    value_score: float = 0.9,
) -> DataFrame:
    """One row per document: id, base and spans, each a list of (kind, start, end) in code points.

    base is what the rules of the four kinds find; spans has these and the added ones. A pattern
    counts for a kind when at least ``support`` distinct values in it are of the kind, and they
    make up ``pattern_score`` of all its values; a value is added when its patterns agree on it
    with ``value_score`` (noisy or). A value that a kind's own check refuses is never added to
    it. ``seeds`` (kind, value) names further known identifiers, of any kind.

    Repeated texts count once per distinct value, so copies do not make a pattern. Null texts
    count as empty and have no spans. Null and repeated ids each keep their rows. Other columns
    are not read. An empty table gives an empty result. Texts are read once and do not move.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    id_name = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {id_name}, base {SPANS}, kind string, start int, end int, value string, barred array<string>, patterns array<string>"
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    seen = staged(rows.mapInArrow(_scan(id_type), schema), "pii-seen")
    added = _bootstrap(seen, seeds, rounds, support, pattern_score, value_score)
    places = seen.where("value IS NOT NULL AND kind IS NULL").select("row", "start", "end", "value").join(added, "value")
    extra = places.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "cost")).alias("extra"))
    whole = seen.where("base IS NOT NULL").select("row", "id", "base").join(extra, "row", "left").select("id", "base", "extra")
    return whole.mapInArrow(_merge(id_type), f"id {id_name}, base {SPANS}, spans {SPANS}").withColumnRenamed("id", id_col)
