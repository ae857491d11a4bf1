"""Awkward rows, and plain versions of the operators to hold them against."""

from __future__ import annotations

import hashlib
import random
import re

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
SPACES = " \t\n\x0b\x0c\r"
# Columns whose names the operators use inside.
CLASHES = "key string, n long, doc string, same int, row string, group long, start long, kept string, drop string, _doc long"


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "délta", "omega,", "it's", "ß", "京都", "x"]
    base = " ".join(rng.choice(words) for _ in range(120))
    near = base.replace("alpha", "Alpha", 1) + " tail words"
    far = " ".join(rng.choice(words) for _ in range(90))
    line = "A line that many documents hold, with enough bytes to be a passage of over one hundred bytes in all of them."
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, base), (6, base.upper().replace("É", "é")), (7, near),
        (8, line + "\n" + far), (9, far + "\n  " + line.upper() + " \n" + line), (10, "ab" * 900),
        (11, "\n".join([line, line, "short", "", base])), (12, "x" * 250 + "\n" + base + "\n" + "x" * 250),
        (13, "﻿  \u0085 'll don't  \r\n tail \x00\x01 <|endoftext|>"), (14, "one two three"),
        (15, "ONE two  three"), (16, "word " * 30_000 + far), (17, line), (18, line), (20, base), (20, base), (20, far),
        (None, base), (None, far + " and more"), (None, None),
    ]
    rows += [(100 + i, line + "\n" + " ".join(rng.choice(words) for _ in range(40))) for i in range(12)]
    return rows


def documents(spark, rows=None):
    from pyspark.sql import functions as F

    data = spark.createDataFrame(texts() if rows is None else rows, "doc_id long, text string")
    for field in CLASHES.split(", "):
        name, kind = field.split(" ")
        data = data.withColumn(name, F.lit(None if name == "n" else "7").cast(kind))
    return data


def sha(value: str | bytes) -> str:
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


def low(text: str) -> str:
    return text.translate(LOWER)


def order(doc_id):
    """Null ids come last."""
    return (doc_id is None, doc_id or 0)


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def linked(a: frozenset, b: frozenset, percent: int = 75) -> bool:
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
