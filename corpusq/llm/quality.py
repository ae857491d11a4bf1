"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Training goes round the features again and again
and fits a shallow tree on one of them to the current residuals; the trees of a feature add
up to its lookup table. Then the same is done for the pairs of features whose residuals show
the strongest interaction. A score is a sum of table entries, added for whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import give_back

FEATURES = [
    "log_bytes", "letter", "upper", "digit", "space", "line_ends", "stop", "exclaim", "pipe", "symbol",
    "brackets", "quotes", "beyond_ascii", "byte_entropy", "word_bytes", "longest_word", "unique_words",
    "repeated_word", "unique_lines", "line_bytes", "words_after_stop", "capital_words",
]


def _classes() -> np.ndarray:
    """Matrix of byte value by counted class."""
    groups = [
        [*range(97, 123), *range(65, 91), *range(128, 256)],
        [*range(65, 91)],
        [*range(48, 58)],
        [9, 11, 12, 13, 32],
        [10],
        [ord(c) for c in ".,;:?"],
        [ord("!")],
        [ord("|")],
        [ord(c) for c in "#$%&*@^~+=\\/_`"],
        [ord(c) for c in "()[]{}<>"],
        [ord(c) for c in "\"'"],
        [*range(128, 256)],
    ]
    table = np.zeros((256, len(groups)))
    for i, group in enumerate(groups):
        table[group, i] = 1
    return table


CLASSES = _classes()


def features(text: str | None) -> np.ndarray:
    """Features of one whole text; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    share = counts @ CLASSES / size
    seen = counts[counts > 0] / size
    entropy = float(-(seen * np.log2(seen)).sum())
    words = (text or "").split()
    n = max(1, len(words))
    same = sum(map(str.__eq__, words[1:], words))
    lines = (text or "").split("\n")
    after_stop = counts[ord(".")] + counts[ord("?")]
    return np.array(
        [
            np.log1p(len(raw)),
            *share,
            entropy,
            len(raw) / n,
            np.log1p(max(map(len, words), default=0)),
            len(set(words)) / n,
            same / n,
            len(set(lines)) / len(lines),
            np.log1p(len(raw) / len(lines)),
            n / (1 + after_stop),
            sum(w[:1].isupper() for w in words) / n,
        ]
    )


def matrix(texts: pd.Series) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    """``score = sigmoid(base + sum of table entries)``."""

    edges: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (i, j), (a, b), table in zip(self.pairs, self.pair_edges, self.pair_tables, strict=True):
            rows = np.searchsorted(a, x[:, i], side="right")
            total += table[rows, np.searchsorted(b, x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _split(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values by bin of a tree with up to ``leaves`` leaves: the best cut is made again and again."""
    total_g, total_h = np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], hess.cumsum()])
    parts = [(0, len(grad))]

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        cut = np.arange(a + 1, b)
        gl, hl = total_g[cut] - total_g[a], total_h[cut] - total_h[a]
        g, h = total_g[b] - total_g[a], total_h[b] - total_h[a]
        gains = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
        best = int(np.argmax(gains))
        return float(gains[best]), int(cut[best])

    while len(parts) < leaves:
        options = [(*gain(a, b), k) for k, (a, b) in enumerate(parts)]
        won, cut, k = max(options)
        if won <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (total_g[b] - total_g[a]) / (total_h[b] - total_h[a] + ridge)
    return out


def _bins(values: np.ndarray, most: int) -> np.ndarray:
    """Inner edges halfway between distinct values, at most ``most - 1`` of them, by quantiles."""
    distinct = np.unique(values)
    if len(distinct) > most:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, most), method="nearest"))
    return (distinct[1:] + distinct[:-1]) / 2


def train(
    x: np.ndarray,
    y: np.ndarray,
    bins: int = 64,
    rounds: int = 150,
    rate: float = 0.1,
    leaves: int = 3,
    pairs: int = 6,
    pair_bins: int = 12,
    pair_rounds: int = 40,
    ridge: float = 4.0,
) -> AdditiveModel:
    """Fit to rows ``x`` and labels ``y`` in {0, 1}. Without both labels, the score is their mean."""
    edges = [_bins(x[:, j], bins) for j in range(x.shape[1])] if len(x) else [np.zeros(0)] * x.shape[1]
    model = AdditiveModel(edges)
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model.base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    if len(y) == 0 or y.min() == y.max():
        return model
    placed = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-margin))
            size = len(table)
            grad = np.bincount(placed[j], y - p, size)
            hess = np.bincount(placed[j], p * (1 - p), size)
            step = rate * _split(grad, hess, leaves, ridge)
            table += step
            margin += step[placed[j]]
    # Pairs: how much of the residuals a coarse grid of two features explains.
    coarse = [_bins(x[:, j], pair_bins) for j in range(x.shape[1])]
    small = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    p = 1 / (1 + np.exp(-margin))
    strength = []
    for i, j in combinations(range(x.shape[1]), 2):
        width = len(coarse[j]) + 1
        cell, size = small[i] * width + small[j], (len(coarse[i]) + 1) * width
        g, h = np.bincount(cell, y - p, size), np.bincount(cell, p * (1 - p), size)
        strength.append((float((g**2 / (h + ridge)).sum()), i, j))
    for _, i, j in sorted(strength, reverse=True)[:pairs]:
        model.pairs.append((i, j))
        model.pair_edges.append((coarse[i], coarse[j]))
        model.pair_tables.append(np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)))
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-margin))
            height, width = table.shape
            cell = small[i] * width + small[j]
            g = np.bincount(cell, y - p, height * width).reshape(height, width)
            h = np.bincount(cell, p * (1 - p), height * width).reshape(height, width)
            step = _pair_tree(g, h, ridge) * rate
            table += step
            margin += step[small[i], small[j]]
    return model


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Values by cell of a tree of two levels: the best cut of one feature, then of the other on each side."""
    best = (-1.0, None)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(a)):
            out, won = np.zeros_like(a), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                gs, hs = a[side].sum(0), b[side].sum(0)
                values = _split(gs, hs, 2, ridge)
                won += float((values * gs).sum())
                out[side] = values
            if won > best[0]:
                best = (won, out if axis == 0 else out.T)
    return best[1] if best[1] is not None else np.zeros_like(g)


def held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Is a row kept from training? By the checksum of its id as text; a null id counts as empty."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 8000,
    **options,
) -> AdditiveModel:
    """Train on labelled documents outside the held-out fold, at most ``max_rows`` of them.

    The sample is the rows of smallest id hash, chosen before texts are read. Null ids, null
    labels and labels other than 0 and 1 are left out; of repeated labels the largest counts.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["_id"], "y": batch["_label"], "x": list(matrix(batch["_text"]))})

    # At most max_rows ids: their size is proven, so the texts stay where they are.
    sample = texts.join(F.broadcast(known), "_id").mapInPandas(
        rows, f"id {texts.schema[0].dataType.simpleString()}, y int, x array<double>"
    )
    got = sample.toPandas()
    x = np.stack(got["x"]) if len(got) else np.zeros((0, len(FEATURES)))
    # One order whatever the order of arrival, so training repeats exactly.
    order = np.lexsort((*x.T, got["id"].to_numpy())) if len(got) else np.zeros(0, int)
    return train(x[order], got["y"].to_numpy(np.float64)[order], **options)


def scorer(model: AdditiveModel):
    """Column function: text -> score in 0..1. A null or empty text has the score of an empty text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            scores = pd.Series(model.score(matrix(texts)))
            del texts
            give_back()
            yield scores

    return score
