"""The main text of web pages by minimum-cut labelling.

A classifier says how likely each block of text is content; its log-odds are capacities to two
terminals. Blocks that follow each other and blocks in the same containers are tied by smoothness
edges, whose capacity falls with the distance in the tree. The minimum cut is the labelling of
least total cost, so a short plain line amid paragraphs stays, and a long one in a menu goes.
"""

import random
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hoardbook.llm.page_blocks import PARTS, Block, Page, read_page

LESSONS = 300  # made-up pages the classifier is fitted on
NEXT, HOLDER, OUTER = 1.0, 0.7, 0.35  # capacities: to the next block, to the container, between containers
UNIT = 1000  # capacities are whole thousandths
_SURE = 8.0

_TAGS = ("p", "heading", "li", "cell", "quote")
_TAG_KIND = {
    "p": 0, **{f"h{i}": 1 for i in range(1, 7)}, "li": 2, "dd": 2, "dt": 2, "td": 3, "th": 3, "caption": 3,
    "blockquote": 4, "pre": 4, "figcaption": 4,
}
_STOPS = frozenset(".!?…。！？:;\"”’)")
_PLACE = {part: i for i, part in enumerate(PARTS)}


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block: a constant, length, share of links, sentence signs, element, parts."""
    rows = np.zeros((len(blocks), 5 + len(_TAGS) + len(_PLACE)))
    plain, ones = [], ([], [])
    for k, b in enumerate(blocks):
        text = b.text
        plain.append((
            text.count(" ") + 1, b.linked / len(text), text[-1] in _STOPS, text.count(",") + text.count(". ")
        ))
        places = [5 + len(_TAGS) + _PLACE[part] for part in b.parts]
        if (kind := _TAG_KIND.get(b.tag)) is not None:
            places.append(5 + kind)
        ones[0].extend([k] * len(places))
        ones[1].extend(places)
    words, linked, stop, signs = np.array(plain, float).reshape(-1, 4).T
    rows[:, 0], rows[:, 2], rows[:, 3] = 1, linked, stop
    rows[:, 1] = np.minimum(np.log2(1 + words), 7) / 7
    rows[:, 4] = np.minimum(1, 8 * signs / (words + 8))
    rows[ones] = 1
    return rows


# Lessons


def _sentence(r: random.Random, words: int) -> str:
    line = ["".join(r.choice("aeiourtnsl") for _ in range(r.randint(2, 9))) for _ in range(words)]
    return " ".join(w + ("," if r.random() < 0.1 else "") for w in line[:-1]) + f" {line[-1]}{r.choice('....!?')}"


def lesson(r: random.Random) -> tuple[str, list[bool]]:
    """A made-up page in one of many layouts, and which of its blocks are content."""
    out, truth = [], []
    within = "ad advert sponsored promo newsletter share related notice".split()

    def put(markup: str, content: bool, text: str) -> None:
        out.append(markup.format(text.strip()))
        truth.append(content)

    named = r.random()  # how much of the layout the markup names
    mark = lambda tag, words: tag if named < 0.4 else f'div class="{r.choice(words.split())}"' if named < 0.8 else "div"

    def wrap(tag: str, fill) -> None:
        out.append(f"<{tag}>")
        fill()
        out.append(f"</{tag.split()[0]}>")

    def links(n: int) -> None:
        out.append("<ul>")
        for _ in range(n):
            put('<li><a href="/x">{}</a></li>', False, _sentence(r, r.randint(1, 4))[:-1].strip())
        out.append("</ul>")

    def lines(n: int, low: int, high: int) -> None:
        for _ in range(n):
            put(r.choice(["<p>{}</p>", "<div>{}</div>"]), False, _sentence(r, r.randint(low, high)))

    def paragraphs() -> None:
        put("<h1>{}</h1>", True, _sentence(r, r.randint(3, 10))[:-1])
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.7:
                text = " ".join(_sentence(r, r.randint(1, 25)) for _ in range(r.choice([1, 1, 2, 4, 8])))
                put("<p>{}</p>", True, text)
            elif kind < 0.78:
                put("<h2>{}</h2>", True, _sentence(r, r.randint(1, 6))[:-1])
            elif kind < 0.86:
                out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    put("<li>{}</li>", True, _sentence(r, r.randint(2, 15)))
                out.append("</ul>")
            elif kind < 0.9:
                put("<blockquote>{}</blockquote>", True, _sentence(r, r.randint(5, 30)))
            elif kind < 0.94:
                out.append("<table>")
                for _ in range(r.randint(1, 3)):
                    out.append("<tr>")
                    for _ in range(3):
                        put("<td>{}</td>", True, _sentence(r, r.randint(1, 3))[:-1])
                    out.append("</tr>")
                out.append("</table>")
            else:
                wrap(r.choice(["form", "aside", *map('div class="{}"'.format, within)]),
                     lambda: lines(r.randint(1, 2), 2, 14))
        if r.random() < 0.2:
            wrap(r.choice(["footer", 'div class="tags share"', 'div class="related"']), lambda: lines(1, 1, 20))
        if r.random() < 0.2:
            comments()

    def comments() -> None:
        wrap(f'section class="{r.choice(["comments", "comment list", "replies", "discussion"])}"', discussion)

    def discussion() -> None:
        for _ in range(r.randint(1, 6)):
            put("<p>{}</p>", False, " ".join(_sentence(r, r.randint(2, 20)) for _ in range(r.randint(1, 4))))

    if r.random() < 0.7:
        wrap(mark("header", "header masthead banner topbar"), lambda: lines(r.randint(1, 2), 1, 8))
    if r.random() < 0.9:
        wrap(mark("nav", "nav menu navbar breadcrumbs"), lambda: links(r.randint(2, 8)))
    for words, odds in (("ad ads advert sponsored", 0.5), ("notice cookie consent alert popup", 0.4)):
        if r.random() < odds:
            wrap(f'div class="{r.choice(words.split())}"', lambda: lines(r.randint(1, 2), 3, 25))
    wrap(mark(r.choice(["article", "main"]), "content post article entry story"), paragraphs)
    if r.random() < 0.4:
        comments()
    if r.random() < 0.5:
        wrap(mark("aside", "sidebar related widget popular"),
             lambda: (links(r.randint(1, 6)), lines(r.randint(0, 3), 3, 20)))
    if r.random() < 0.3:
        wrap(r.choice(["form", 'div class="search form"', 'div class="login"']), lambda: lines(r.randint(1, 3), 1, 6))
    if r.random() < 0.9:
        wrap(mark("footer", "footer copyright legal"), lambda: lines(r.randint(1, 3), 2, 14))
    return "<!DOCTYPE html><html><body>" + "".join(out) + "</body></html>", truth


def train(lessons: int = LESSONS, seed: int = 17, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression by Newton's method over the blocks of ``lessons`` made-up
    pages: a bounded sample, the same on every run."""
    r = random.Random(seed)
    rows, labels = [], []
    for _ in range(lessons):
        markup, truth = lesson(r)
        rows.append(features(read_page(markup).blocks))
        labels += truth
    x, y = np.concatenate(rows), np.array(labels, float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w -= np.linalg.solve(curve, x.T @ (p - y) + w)
    return w


# Cut


def edges_of(page: Page) -> dict[tuple[int, int], float]:
    """Smoothness edges among blocks 0..n-1 and containers n + c, with their capacities.

    A block is tied to its container and a container to the one around it; blocks that follow each
    other are tied the less, the more containers lie between them."""
    n, edges = len(page.blocks), {}
    depth = [0] * len(page.parents)
    for c in range(1, len(depth)):
        depth[c] = depth[page.parents[c]] + 1

    def tie(a: int, b: int, capacity: float) -> None:
        edges[a, b] = edges.get((a, b), 0) + capacity

    held: set[int] = set()
    for k, block in enumerate(page.blocks):
        tie(k, n + block.holder, HOLDER)
        c = block.holder
        while c and c not in held:
            held.add(c)
            tie(n + c, n + page.parents[c], OUTER)
            c = page.parents[c]
        if k:
            a, b, apart = page.blocks[k - 1].holder, block.holder, 0
            while a != b and apart < 16:
                if depth[a] < depth[b]:
                    a, b = b, a
                a, apart = page.parents[a], apart + 1
            tie(k - 1, k, NEXT / (1 + apart))
    return edges


def minimum_cut(costs: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes lie on the source side of the minimum cut. ``costs``: capacity from the source if
    positive, to the sink if negative; of equal cuts the one with the smallest source side.

    Nodes whose own cost outweighs all their edges can lie on one side only and are settled first,
    their edges becoming costs of their neighbours; blocking flows settle the rest.
    """
    n = len(costs)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), capacity in edges.items():
        if a != b and capacity:
            near[a][b] = near[a].get(b, 0) + capacity
            near[b][a] = near[b].get(a, 0) + capacity
    excess, side = list(costs), [None] * n
    total = [sum(x.values()) for x in near]
    queue = deque(k for k in range(n) if abs(excess[k]) > total[k])
    while queue:
        k = queue.popleft()
        if side[k] is not None:
            continue
        side[k] = excess[k] > 0
        for other, capacity in near[k].items():
            if side[other] is None:
                excess[other] += capacity if side[k] else -capacity
                total[other] -= capacity
                del near[other][k]
                if abs(excess[other]) > total[other]:
                    queue.append(other)
        near[k] = {}
    left = [k for k in range(n) if side[k] is None]
    source, sink = n, n + 1
    rest: dict[int, dict[int, int]] = {k: near[k] for k in left}
    rest[source], rest[sink] = {}, {}
    for k in left:
        if excess[k] > 0:
            rest[source][k], rest[k][source] = excess[k], 0
        elif excess[k] < 0:
            rest[k][sink], rest[sink][k] = -excess[k], 0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, capacity in rest[a].items():
                if capacity and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            for k in left:
                side[k] = k in level
            return side
        ways, tried, path = {k: list(rest[k]) for k in level}, dict.fromkeys(level, 0), [source]
        while path:
            a = path[-1]
            if a == sink:
                steps = list(zip(path, path[1:]))
                flow = min(rest[x][y] for x, y in steps)
                for x, y in steps:
                    rest[x][y] -= flow
                    rest[y][x] += flow
                del path[1 + next(at for at, (x, y) in enumerate(steps) if not rest[x][y]):]
                continue
            while tried[a] < len(ways[a]):
                b = ways[a][tried[a]]
                if rest[a][b] and level.get(b) == level[a] + 1:
                    path.append(b)
                    break
                tried[a] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1


def content_blocks(page: Page, weights: np.ndarray) -> list[bool]:
    """Which blocks of a page are content."""
    if not page.blocks:
        return []
    odds = np.clip(features(page.blocks) @ weights, -_SURE, _SURE)
    costs = [int(v) for v in np.rint(odds * UNIT)] + [0] * len(page.parents)
    edges = {k: round(v * UNIT) for k, v in edges_of(page).items()}
    return minimum_cut(costs, edges)[: len(page.blocks)]


def main_text(markup: str | None, weights: np.ndarray) -> str:
    page = read_page(markup or "")
    kept = content_blocks(page, weights)
    return " ".join(b.text for b, keep in zip(page.blocks, kept) if keep)


def extracted(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", lessons: int = LESSONS
) -> DataFrame:
    """Per row of ``pages``: its key, url, text (the main text) and n_chars, its code points.

    Null and empty pages, and pages without content, give an empty text. Null, equal and repeated
    keys are rows like any other, other columns may bear any name, an empty table stays empty. Pages
    are read where they lie, without a shuffle; one is held whole by its task, as text and as
    blocks, whatever its length. The classifier is fitted on the driver from ``lessons`` made-up
    pages and sent to the tasks: some thirty numbers.
    """
    weights = train(lessons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (main_text(m.as_py(), weights) for m in batch.column("_html"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string())], ["_id", "_url", "text"]
            )

    kind = pages.schema[key].dataType.simpleString()
    link = pages.schema[url].dataType.simpleString()
    return pages.select(
        F.col(key).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html")
    ).mapInArrow(run, f"_id {kind}, _url {link}, text string").select(
        F.col("_id").alias(key), F.col("_url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars")
    )
