"""Main text by minimum-cut labelling.

A logistic classifier trained on the small labelled table gives every block of a page a cost for either label; the costs
are the capacities from the source (content) and to the sink (boilerplate). Neighbouring blocks, and successive blocks
of one container, are joined by edges that weigh more the nearer the blocks stand in the document tree. The minimum cut
between source and sink is the labelling. A block whose costs outweigh all its edges has its label beforehand (no cut
could gain by another), so the flow runs over the doubtful blocks alone.
"""

from __future__ import annotations

import functools
from collections import defaultdict, deque
from collections.abc import Iterator
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, batch_of, fields, pieces_of
from .html_blocks import Block, Element, blocks_of, tree_distance

#: Edge weights: between successive blocks, and between successive blocks of one container; how fast they fall with distance.
NEXT_WEIGHT, SIBLING_WEIGHT, FALL = 0.8, 0.8, 0.5
STEPS, RATE, DECAY = 300, 0.1, 1e-3
MAX_COST = 12.0

#: Names and tags in a block's path that the classifier looks for.
PATH_WORDS = {
    "nav": ("nav", ".nav", ".navbar", ".navigation", ".menu", ".breadcrumb", ".breadcrumbs", "menu"),
    "header": ("header", ".header", ".masthead", ".topbar", ".banner"),
    "footer": ("footer", ".footer", ".copyright", ".imprint"),
    "aside": ("aside", ".sidebar", ".aside", ".widget", ".complementary"),
    "ad": (".ad", ".ads", ".advert", ".advertisement", ".advertising", ".sponsor", ".sponsored", ".promo", ".promotion"),
    "notice": (".cookie", ".cookies", ".consent", ".notice", ".alert", ".gdpr", ".popup", ".modal", ".overlay", ".newsletter", ".subscribe", "dialog"),
    "comment": (".comment", ".comments", ".reply", ".replies", ".disqus", ".respond"),
    "share": (".share", ".sharing", ".social", ".related", ".recommended", ".tags", ".pagination", ".pager"),
    "form": ("form", "button", "select", "textarea", "fieldset", ".login", ".search", ".signup"),
    "article": ("article", ".article", ".post", ".entry", ".story"),
    "main": ("main", ".main", ".content", ".body", ".text"),
}
_WORD_OF = {w: k for k, words in PATH_WORDS.items() for w in words}


def block_features(block: Block) -> list[str]:
    """Names of the features a block has."""
    kinds = {_WORD_OF[w] for w in block.element.path if w in _WORD_OF}
    if kinds & {"article", "main"} and block.element.tag in ("h1", "h2", "h3", "p") and "header" in kinds:
        kinds.discard("header")  # the heading of an article, not of the site
    out = ["in " + k for k in kinds]
    at: Element | None = block.element
    while at is not None and not (nearest := sorted(k for w in (at.tag, *at.names) if (k := _WORD_OF.get(w)) in kinds)):
        at = at.parent
    out += ["nearest " + k for k in nearest] if at is not None else []
    n = len(block.text)
    share = block.linked / n
    out += [f"tag {block.element.tag}", f"length {min(7, int(log1p(n) / 0.9))}", f"linked {0 if share < 0.1 else 1 if share < 0.5 else 2}", "any"]
    if block.text[-1:] in ".!?":
        out.append("stops")
    if "©" in block.text or "opyright" in block.text:
        out.append("copyright")
    if not kinds:
        out.append("nowhere")
    return out


@functools.lru_cache(maxsize=1)
def trained() -> dict[str, float]:
    """Weight of each feature, by gradient steps with Adam on the labelled pages."""
    from .html_table import labelled_pages
    rows, labels = [], []
    for page, marked in labelled_pages():
        found = blocks_of(page)
        if len(found) != len(marked):
            raise ValueError("the labelled pages and their blocks differ")
        rows += [block_features(b) for b in found]
        labels += marked
    names = sorted({f for r in rows for f in r})
    number = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [number[f] for f in r]] = 1
    y, w = np.array(labels, dtype=np.float64), np.zeros(len(names))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(y) - DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return dict(zip(names, w.tolist(), strict=True))


def capacities(block: Block, weights: dict[str, float]) -> tuple[float, float]:
    """(cost as boilerplate, cost as content): negative logarithms of the classifier's probabilities."""
    z = max(-MAX_COST, min(MAX_COST, sum(weights.get(f, 0.0) for f in block_features(block))))
    return log1p(exp(z)), log1p(exp(-z))


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Edge weights between blocks (smaller number first)."""
    edges: dict[tuple[int, int], float] = defaultdict(float)
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            edges[i - 1, i] += NEXT_WEIGHT * exp(-FALL * tree_distance(blocks[i - 1].element, block.element))
        container = id(block.element.parent)
        if container in last:
            j = last[container]
            edges[j, i] += SIBLING_WEIGHT * exp(-FALL * tree_distance(blocks[j].element, block.element))
        last[container] = i
    return edges


def minimum_cut(costs: list[tuple[float, float]], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the source's side (content); nodes that could stand on either side stand with the sink."""
    n = len(costs)
    lead = [a - b for a, b in costs]  # cost saved by being content
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:  # a node whose lead outweighs its edges is settled; it then pulls its neighbours
        i = waiting.popleft()
        if label[i] is None and abs(lead[i]) > sum(near[i].values()) + 1e-12:
            label[i] = lead[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    lead[j] += w if label[i] else -w
                    del near[j][i]
                    waiting.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in _flow(rest, lead, near).items():
            label[i] = side
    return [bool(x) for x in label]


def _flow(nodes: list[int], lead: list[float], near: list[dict[int, float]]) -> dict[int, bool]:
    """The source's side of a maximum flow (shortest augmenting paths) over the unsettled nodes."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = defaultdict(dict)
    inside = set(nodes)
    for i in nodes:
        for j, w in near[i].items():
            if j in inside:
                left[i][j] = w
        if lead[i] > 0:
            left[source][i], left[i][source] = lead[i], 0.0
        elif lead[i] < 0:
            left[i][sink], left[sink][i] = -lead[i], 0.0
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            i = queue.popleft()
            for j, w in left[i].items():
                if w > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if sink not in came:
            return {i: i in came for i in nodes}
        path, i = [], sink
        while i != source:
            path.append((came[i], i))
            i = came[i]
        push = min(left[i][j] for i, j in path)
        for i, j in path:
            left[i][j] -= push
            left[j][i] = left[j].get(i, 0.0) + push


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The content blocks of a page, joined by line feeds; empty if there are none."""
    weights = weights or trained()
    blocks = blocks_of(page)
    side = minimum_cut([capacities(b, weights) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, content in zip(blocks, side, strict=True) if content)


def extracted(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    A null or empty page has an empty text. Null ids and urls and repeated rows keep their rows; other columns are not
    read; an empty table gives an empty result.
    """
    schema = T.StructType([*fields(pages, page_id, url), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    arrow, weights = arrow_schema(schema), trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, html):
            texts = [main_text(v, weights) for v in batch.column(html).to_pylist()]
            yield batch_of(arrow, {page_id: batch.column(page_id), url: batch.column(url), "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(page_id, url, html).mapInArrow(run, schema)
