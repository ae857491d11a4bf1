"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the hierarchy."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Never text of the page, whatever a model says.
UNSEEN = frozenset("script style head title template noscript iframe object svg textarea select".split())
RAW = frozenset("script style title textarea iframe noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
# A paragraph ends where one of these begins.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOILERPLATE_TAGS = frozenset("nav footer aside header form menu button dialog".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement adsense alert aside banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus foot footer form head header hidden legal login masthead menu modal nav "
    "navbar navigation newsletter notice notification pager pagination popup promo related reply search share "
    "sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
NAMED = ("class", "id", "role")
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
FEATURES = [
    "boilerplate_tag", "content_tag", "heading", "paragraph", "list", "text_run", "boilerplate_words",
    "content_words", "boilerplate_above", "content_above", "log_text", "link_share", "text_per_tag", "depth",
    "siblings", "position", "share_of_parent", "share_of_page", "stops", "content_below", "boilerplate_share",
]
# What a page without telling names does not have; hidden in half of the training rows.
NAMES = [FEATURES.index(f) for f in FEATURES if f.startswith(("boilerplate", "content"))]


@dataclass
class Page:
    """Nodes in document order, parents before children, and text segments by node."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    words: list[frozenset] = field(default_factory=lambda: [frozenset()])
    # (node, block, text, inside a link)
    segments: list[tuple[int, int, str, bool]] = field(default_factory=list)


def parse(source: str) -> Page:
    """A forgiving reader: unknown ends are passed over, open elements end with their parent."""
    page, stack, block, links = Page(), [0], 0, 0
    run, unseen, at = -1, 0, 0

    def add(tag: str, words: frozenset) -> int:
        page.tags.append(tag)
        page.parents.append(stack[-1])
        page.words.append(words)
        return len(page.tags) - 1

    def text(raw: str) -> None:
        nonlocal run
        if unseen or not raw or raw.isspace() and run < 0:
            return
        if run < 0:
            run = add("#text", frozenset())
        page.segments.append((run, block, html.unescape(raw), links > 0))

    def close(to: int) -> None:
        nonlocal unseen, run, block
        while len(stack) > to:
            unseen -= page.tags[stack.pop()] in UNSEEN
        run, block = -1, block + 1

    end = len(source)
    while at < end:
        found = source.find("<", at)
        if found < 0:
            text(source[at:])
            break
        match = TAG.match(source, found)
        if match is None:
            # A bare "<" is text.
            text(source[at : found + 1])
            at = found + 1
            continue
        text(source[at:found])
        at = match.end()
        if match[2] is None:
            continue
        tag, closing = match[2].lower(), match[1] == "/"
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            words = frozenset() if closing or not match[3] else names(match[3])
            if not closing and tag != "img" and words & BOILERPLATE_WORDS:
                # An inline element with a telling name is a node, its text stays in the block.
                stack.append(add(tag, words))
                run = -1
            elif closing and page.tags[stack[-1]] == tag:
                stack.pop()
                run = -1
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if page.tags[stack[k]] == tag:
                    close(k)
                    break
            else:
                run, block = -1, block + 1
            links = 0 if tag not in UNSEEN else links
            continue
        if tag in ENDS_PARAGRAPH and "p" in (page.tags[s] for s in stack[-4:]):
            for k in range(len(stack) - 1, 0, -1):
                if page.tags[stack[k]] == "p":
                    close(k)
                    break
        for k in range(len(stack) - 1, 0, -1):
            own = page.tags[stack[k]]
            if own in ITEMS.get(tag, ()):
                close(k)
            if own in ("ul", "ol", "dl", "table") or own in ITEMS.get(tag, ()):
                break
        run, block = -1, block + 1
        if tag == "body" and page.tags[stack[-1]] == "head":
            close(len(stack) - 1)
        if tag in VOID or match[3].endswith("/") and tag in RAW:
            continue
        node = add(tag, names(match[3]))
        stack.append(node)
        unseen += tag in UNSEEN
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            text(source[at : stop.start()])
            at = stop.end()
            close(len(stack) - 1)
    return page


def names(attributes: str) -> frozenset:
    """Words of class, id and role."""
    if "=" not in attributes:
        return frozenset()
    return frozenset(
        w.lower()
        for m in ATTRIBUTE.finditer(attributes)
        if m[1].lower() in NAMED
        for w in WORD.findall(m[2] or m[3] or m[4] or "")
    )


def features(page: Page) -> np.ndarray:
    """One row per node. Subtree sums go up from children to parents, ancestry comes down."""
    n, parents = len(page.tags), page.parents
    length, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for node, _, text, link in page.segments:
        size = len(text)
        length[node] += size
        linked[node] += size * link
        stops[node] += text.count(".") + text.count(",")
    bad_tag = [t in BOILERPLATE_TAGS for t in page.tags]
    good_tag = [t in CONTENT_TAGS for t in page.tags]
    bad_words = [len(w & BOILERPLATE_WORDS) for w in page.words]
    good_words = [len(w & CONTENT_WORDS) for w in page.words]
    depth, bad_above, good_above = [0] * n, [0] * n, [0] * n
    children, position = [0] * n, [0] * n
    for i in range(n):
        p = parents[i]
        bad, good = bad_tag[i] or bad_words[i] > 0, good_tag[i] or good_words[i] > 0
        if p >= 0:
            depth[i], bad, good = depth[p] + 1, bad + bad_above[p], good + good_above[p]
            position[i] = children[p]
            children[p] += 1
        bad_above[i], good_above[i] = bad, good
    tags, below, bad_text = np.ones(n), np.array(good_tag, float), length * (np.array(bad_above) > 0)
    for i in range(n - 1, 0, -1):
        p = parents[i]
        for sums in (length, linked, stops, tags, bad_text):
            sums[p] += sums[i]
        below[p] = max(below[p], below[i])
    up = np.maximum(parents, 0)
    chars = np.maximum(length, 1)
    return np.column_stack(
        [
            bad_tag,
            good_tag,
            [len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in page.tags],
            [t == "p" for t in page.tags],
            [t in ("ul", "ol", "li", "dl") for t in page.tags],
            [t == "#text" for t in page.tags],
            bad_words,
            good_words,
            np.minimum(bad_above, 3),
            np.minimum(good_above, 3),
            np.log1p(length),
            linked / chars,
            np.log1p(length / tags),
            np.minimum(depth, 20),
            np.minimum(np.array(children)[up], 50),
            np.array(position) / np.maximum(np.array(children)[up], 1),
            length / chars[up],
            length / max(1, length[0]),
            stops / chars * 100,
            below,
            bad_text / chars,
        ]
    ).astype(float)


def weak_labels(page: Page, x: np.ndarray) -> np.ndarray:
    """1 inside or above content elements, 0 inside boilerplate, -1 where names do not tell."""
    f = dict(zip(FEATURES, x.T, strict=True))
    label = np.full(len(x), -1)
    content = [False] * len(x)
    for i, p in enumerate(page.parents):
        content[i] = page.tags[i] in CONTENT_TAGS or p >= 0 and content[p]
    label[np.array(content) | (f["content_below"] > 0)] = 1
    label[f["boilerplate_above"] > 0] = 0
    return label


@dataclass
class BoostedTrees:
    """Additive trees over binned features; a tree is three levels of (feature, bin) and eight values."""

    edges: list[np.ndarray]
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def place(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        placed, total = self.place(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            total += value[descend(placed, feature, cut)]
        return total


DEPTH = 3


def descend(placed: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(placed), np.int64), np.arange(len(placed))
    for _ in range(DEPTH):
        right = placed[rows, feature[node]] > cut[node]
        node = 2 * node + 1 + right
    return node - (2**DEPTH - 1)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, bins: int = 32, ridge: float = 2.0) -> BoostedTrees:
    """Second-order boosting of trees of fixed depth on histograms. Without rows, every margin is 1."""
    if len(y) == 0:
        return BoostedTrees([np.zeros(0)] * len(FEATURES), 1.0)
    edges = []
    for j in range(x.shape[1]):
        distinct = np.unique(x[:, j])
        if len(distinct) > bins:
            distinct = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins), method="nearest"))
        edges.append((distinct[1:] + distinct[:-1]) / 2)
    model = BoostedTrees(edges)
    placed = model.place(x)
    width = max(len(e) for e in edges) + 1
    flat = placed + np.arange(x.shape[1]) * width
    margin = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, width, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                own = node == k
                if not own.any():
                    continue
                cells, size = flat[own].ravel(), x.shape[1] * width
                repeat = x.shape[1]
                g = np.bincount(cells, np.repeat(grad[own], repeat), size).reshape(-1, width).cumsum(1)
                h = np.bincount(cells, np.repeat(hess[own], repeat), size).reshape(-1, width).cumsum(1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge)
                gain -= g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                best = int(np.argmax(gain))
                if gain.flat[best] > 1e-9:
                    feature[k], cut[k] = divmod(best, width)
            right = placed[np.arange(len(y)), feature[node]] > cut[node]
            node = 2 * node + 1 + right
        leaf = node - (2**DEPTH - 1)
        value = rate * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + ridge)
        model.trees.append((feature, cut, value))
        margin += value[leaf]
    return model


def decode(page: Page, margin: np.ndarray) -> list[bool]:
    """The likeliest choice in which nothing is kept below a dropped node.

    Upwards, a node's best is either to drop its subtree or to keep it and take each child's
    best; downwards, a kept node lets its children choose.
    """
    keep_own, drop_own = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    dropped, best = drop_own.copy(), np.zeros(len(margin))
    kept = keep_own.copy()
    for i in range(len(margin) - 1, -1, -1):
        best[i] = max(kept[i], dropped[i])
        p = page.parents[i]
        if p >= 0:
            dropped[p] += dropped[i]
            kept[p] += best[i]
    out = [False] * len(margin)
    for i, p in enumerate(page.parents):
        out[i] = page.tags[i] not in UNSEEN and (p < 0 or out[p]) and kept[i] >= dropped[i]
    return out


def main_text(page: Page, keep: list[bool]) -> str:
    parts: list[str] = []
    last = None
    for node, block, text, _ in page.segments:
        if keep[node]:
            if block != last:
                parts.append(" ")
            parts.append(text)
            last = block
    return " ".join("".join(parts).split())


def fit(pages: DataFrame, html_col: str = "html", max_pages: int = 400) -> BoostedTrees:
    """Train on nodes whose names tell what they are, of at most ``max_pages`` pages.

    The sample is the pages of smallest hash of the whole html.
    """
    source = F.col(html_col).cast("string").alias("html")
    sample = pages.select(source).where(F.col("html").isNotNull()).orderBy(F.xxhash64("html"), "html").limit(max_pages)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["html"]:
                page = parse(text)
                x = features(page)
                y = weak_labels(page, x)
                yield pd.DataFrame({"y": y[y >= 0], "x": list(x[y >= 0])})

    got = sample.mapInPandas(rows, "y int, x array<double>").toPandas()
    if not len(got):
        return boost(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(got["x"]), got["y"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))
    return boost(*transplanted(x[order], y[order]))


def transplanted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training rows, and copies of them moved to where a page could also have them.

    Copies without telling names leave shape and text to decide. Boilerplate moved into an
    article stays boilerplate. Text of an article moved into boilerplate (comments, notices,
    sidebars) becomes boilerplate, whatever its shape. Containers may be named by words only.
    """
    column = {f: i for i, f in enumerate(FEATURES)}

    def copy(rows: np.ndarray, **values: float) -> np.ndarray:
        out = x[rows].copy()
        for name, value in values.items():
            out[:, column[name]] = value
        return out

    every = np.ones(len(x), bool)
    inside = (y == 1) & (x[:, column["content_above"]] > 0)
    outside = (y == 0) & (x[:, column["boilerplate_above"]] > 0)
    parts = [
        (x, y),
        (copy(every, **{FEATURES[j]: 0 for j in NAMES}), y),
        (copy(outside, content_above=1), y[outside]),
        (copy(outside, content_above=2), y[outside]),
    ]
    for above in (0, 1):
        parts.append((copy(inside, content_above=above, content_tag=0, boilerplate_above=1, boilerplate_share=1), np.zeros(inside.sum())))
        parts.append((copy(inside, content_above=above, content_tag=0, boilerplate_above=1, boilerplate_words=1, boilerplate_share=1), np.zeros(inside.sum())))
    named = inside & (x[:, column["content_tag"]] > 0)
    parts.append((copy(named, content_tag=0, content_words=1), y[named]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def extract(pages: DataFrame, model: BoostedTrees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: the id, the url and ``text``, the main text of the whole html.

    White space inside a block becomes one space, blocks are joined by one space. Null or
    empty html, and pages without any text kept, give an empty text. Ids and urls may be null
    or repeated. Other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                parsed = [parse(t or "") for t in part["_html"]]
                xs = [features(p) for p in parsed]
                margins = np.split(model.margin(np.concatenate(xs)), np.cumsum([len(x) for x in xs])[:-1])
                texts = [main_text(p, decode(p, m)) for p, m in zip(parsed, margins, strict=True)]
                yield part.drop(columns="_html").assign(text=texts)

    source = pages.select(id_col, url_col, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    kinds = [(f.name, f.dataType.simpleString()) for f in source.schema.fields[:2]]
    return source.mapInPandas(run, ", ".join(f"`{n}` {k}" for n, k in kinds) + ", text string")
