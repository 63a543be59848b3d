"""HTML extraction: gradient-boosted trees over DOM nodes, decoded over the tree.

Trees are fitted on a bounded sample of pages (SAMPLE, the first by the CRC-32 of page_id among those of up to LONGEST code
points). Labels come from extractors that have to agree on a page's main text: its semantic element, if there is one, the
subtree of densest prose, and repetition, as text that returns on other pages belongs to the template. Pages on which they
differ aren't learned from. What is learned has to hold without names: each page is also seen with its element names and
attributes disguised, at seeded random, and with blocks of common clutter set in, under the labels that it had before. So the
trees weigh tokens of attributes against subtree density, depth, siblings and the parent, and know pages whose main text is
in an element of any name.

Decoding chooses, for the whole tree at once, which nodes lie before, in or out of the main text with the
largest sum of log odds: what is under a dropped node of the main text is dropped, and what isn't under a chosen root is never in.

Cases: a null or empty page, or one without main text, has the text "" and 0 characters; repeated rows are extracted each by
itself; an empty table gives no rows; further columns are ignored. Pages are read whole, unclosed tags and truncated
references included; a reference that can't be decoded stays as it is.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 400
LONGEST = 1 << 17
TREES = 60
DEPTH = 4
RATE = 0.3
BINS = 24

#: Element names by kind.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
KINDS = (
    frozenset("article main".split()), frozenset("p blockquote pre".split()), frozenset("h1 h2 h3 h4 h5 h6".split()),
    frozenset("ul ol li dl dt dd menu".split()), frozenset("div section center".split()), frozenset("nav aside footer header".split()),
    frozenset("form button select option input fieldset".split()), frozenset("table tbody thead tr td th".split()),
    RAW | frozenset(["head"]), frozenset("html body".split()), frozenset("figure figcaption".split()),
)
#: Words of class, id and role attributes that name clutter, and some that name content.
CLUTTER = frozenset("ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar side rail widget cookie cookies consent notice alert gdpr popup modal newsletter subscribe signup login form search comment comments reply disqus discussion share social related recommended tags meta pagination pager copyright legal toolbar".split())
CONTENT = frozenset("article content main post story body entry text".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "depth", "chars", "links", "tags", "paragraphs", "stops", "blocks")

    def __init__(self, tag: str, attributes: str, parent: int, depth: int):
        self.tag, self.attributes, self.parent, self.depth = tag, attributes, parent, depth
        self.children: list[int] = []
        self.chars = self.links = self.paragraphs = self.stops = self.blocks = 0
        self.tags = 1


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block-level nodes in page order, a root first, and blocks of text, each with its node."""
    nodes = [Node("", "", -1, 0)]
    blocks: list[tuple[int, str]] = []
    page = page or ""
    stack, parts, links, at = [0], [], 0, 0
    is_open: Counter[str] = Counter()  # elements on the stack by name, so that a stray end tag costs nothing

    def flush() -> None:
        nonlocal parts
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts = []
            if text:
                k = stack[-1]
                blocks.append((k, text))
                n = nodes[k]
                n.chars += len(text)
                n.stops += text.count(".") + text.count(",")
                n.blocks += 1

    def close(tag: str) -> None:
        while is_open[tag]:
            top = nodes[stack.pop()].tag
            is_open[top] -= 1
            if top == tag:
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        run = page[at : m.start() if m else len(page)]
        if run:
            parts.append(run)
            if links:
                nodes[stack[-1]].links += len(run)
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        tag, ends = name.lower(), m[1]
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE or tag == "img":
            nodes[stack[-1]].tags += 1
            if tag == "a":
                links = 0 if ends else 1
            continue
        flush()
        links = 0
        if ends:
            close(tag)
            continue
        top = nodes[stack[-1]].tag
        if top == "p" or (tag == top and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
            close(top)
        if tag in VOID or m[3].endswith("/"):
            nodes[stack[-1]].tags += 1
            continue
        k = len(nodes)
        nodes.append(Node(tag, m[3], stack[-1], len(stack)))
        nodes[stack[-1]].children.append(k)
        if tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(k)
        is_open[tag] += 1
    flush()
    for k in range(len(nodes) - 1, 0, -1):
        n, up = nodes[k], nodes[nodes[k].parent]
        n.paragraphs += n.tag == "p"
        up.chars += n.chars
        up.links += n.links
        up.tags += n.tags
        up.paragraphs += n.paragraphs
        up.stops += n.stops
        up.blocks += n.blocks
    return nodes, blocks


def attribute_words(n: Node) -> set[str]:
    if not n.attributes:
        return set()
    return {w.lower() for m in _ATTRIBUTE.finditer(n.attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")}


def features(nodes: list[Node]) -> list[list[float]]:
    total = nodes[0].chars + 1
    out: list[list[float]] = []
    place, words, bad, good = {0: 0}, [], [], []
    for k, n in enumerate(nodes):
        for i, c in enumerate(n.children):
            place[c] = i
        words.append(attribute_words(n))
        up = nodes[n.parent] if k else n
        bad.append((bad[n.parent] if k else 0) + bool(words[k] & CLUTTER or n.tag in KINDS[5] or n.tag in KINDS[6]))
        good.append((good[n.parent] if k else 0) + bool(words[k] & CONTENT or n.tag in KINDS[0]))
        siblings = len(up.children) if k else 1
        alike = sum(nodes[c].tag == n.tag for c in up.children[max(0, place[k] - 8) : place[k] + 9]) if k else 1
        kind = [float(n.tag in group) for group in KINDS]
        out.append([
            *kind, float(len(words[k] & CLUTTER)), float(len(words[k] & CONTENT)), float(n.tag in ("nav", "footer", "aside")), float(n.depth),
            float(siblings), place[k] / siblings, alike / min(siblings, 17), float(len(n.children)), n.chars ** 0.5, n.links / (n.chars + 1), n.chars / n.tags,
            n.paragraphs ** 0.5, n.stops / (n.chars + 1), n.chars / total, n.chars / (n.blocks + 1), k / len(nodes),
            float(bad[k]), float(good[k]), up.chars / total, up.links / (up.chars + 1), up.stops / (up.chars + 1), up.paragraphs ** 0.5, n.chars / (up.chars + 1), up.chars / (up.blocks + 1)])
    return out


def _clutter(nodes: list[Node], blocks: list[tuple[int, str]]) -> list[bool]:
    """Nodes of clutter, and all below them: by name, as lists of links, or as clutter that was set in."""
    texts: dict[int, list[str]] = {}
    for k, t in blocks:
        texts.setdefault(k, []).append(t)
    out: list[bool] = []
    for k, n in enumerate(nodes):
        named = n.tag in KINDS[5] or n.tag in KINDS[6] or n.tag in KINDS[8] or bool(attribute_words(n) & CLUTTER)
        linked = k > 0 and n.chars > 0 and n.links > 0.6 * n.chars and not n.paragraphs
        template = n.blocks > 0 and n.blocks == len(texts.get(k, [])) and all(t in _set_in() for t in texts[k])
        out.append((k > 0 and out[n.parent]) or named or linked or template)
    return out


def _densest(nodes: list[Node], blocks: list[tuple[int, str]], out: list[bool]) -> int | None:
    """The node whose children hold the most prose, outside clutter; None without prose."""
    score = [0.0] * len(nodes)
    for k, t in blocks:
        if out[k] or len(t) < 25:
            continue
        prose = 1 + t.count(",") + t.count(".") + min(len(t) / 100, 3)
        up = nodes[k].parent if k and nodes[k].tag not in ("div", "section", "td", "article", "main", "center") else k
        score[up] += prose
        if up:
            score[nodes[up].parent] += prose / 2
    weighed = [s * (1 - min(1.0, n.links / (n.chars + 1))) for s, n in zip(score, nodes, strict=True)]
    return max(range(len(nodes)), key=lambda k: weighed[k]) if any(weighed) else None


def label(nodes: list[Node], blocks: list[tuple[int, str]], returning: set[str]) -> list[int] | None:
    """Whether a node is of the main text; None where the extractors don't agree on it."""
    out = _clutter(nodes, blocks)
    dense = _densest(nodes, blocks, out)
    named = [k for k, n in enumerate(nodes) if n.tag in KINDS[0] and not out[k]]
    if not named and dense is None:
        return None
    root = max(named, key=lambda k: nodes[k].chars) if named else dense
    inside: list[bool] = []
    for k, n in enumerate(nodes):
        inside.append(k == root or (k > 0 and inside[n.parent]))
    k = root if dense is None else dense
    while k > 0 and k != root:
        k = nodes[k].parent
    own = sum(len(t) for k, t in blocks if inside[k] and not out[k])
    unique = sum(len(t) for k, t in blocks if not out[k] and t not in returning and len(t) >= 25)
    if k != root or root == 0 or not own or (not named and own < 0.8 * unique):
        return None
    return [int(a and not b) for a, b in zip(inside, out, strict=True)]


#: Names that disguised elements get: none that tells anything, or a common one for content or for clutter.
PLAIN = ("", "", "", 'class="x1"', 'class="box wide"', 'id="c2"', 'class="row"', 'class="inner wrap"')
OFTEN = ('class="content"', 'id="content"', 'class="post"', 'id="main"', 'class="entry"', 'class="story text"', 'class="article-body"')


def disguise(nodes: list[Node], rng: random.Random) -> list[Node]:
    """The same tree, with semantic elements as plain ones and most attributes changed."""
    out = []
    keep = rng.random()
    for n in nodes:
        m = Node(n.tag, n.attributes, n.parent, n.depth)
        m.children, m.chars, m.links, m.tags, m.paragraphs, m.stops, m.blocks = n.children, n.chars, n.links, n.tags, n.paragraphs, n.stops, n.blocks
        if n.tag in KINDS[0]:
            m.tag, m.attributes = "div" if rng.random() < 0.8 else "section", rng.choice(OFTEN if rng.random() < 0.5 else PLAIN)
        elif n.tag in KINDS[5] and rng.random() > keep:
            m.tag, m.attributes = "div", rng.choice(PLAIN)
        elif n.attributes and rng.random() > keep:
            m.attributes = rng.choice(PLAIN)
        out.append(m)
    return out


#: Clutter that is set into sample pages, before, in and after the main text.
SET_IN = (
    '<header class="masthead"><div>Site name</div><ul><li>Home</li><li>News</li></ul></header>',
    '<aside class="sidebar"><h2>Related</h2><ul><li><a href="/x">One more</a></li><li><a href="/y">And another one</a></li></ul></aside>',
    '<div class="cookie-notice"><p>We use cookies to improve this site. By going on you agree to it.</p><button>OK</button></div>',
    '<form action="/s"><label>Mail</label><input name="m"><button>Subscribe</button></form>',
    '<section id="comments"><h2>Comments</h2><div class="comment"><p>I read this twice, and I do not agree, but it is well put.</p></div></section>',
    '<div class="advert"><p>Buy now, while it lasts.</p></div>',
    '<ul class="menu"><li><a href="/a">About</a></li><li><a href="/b">Contact</a></li></ul>',
)


@cache
def _set_in() -> frozenset[str]:
    return frozenset(t for c in SET_IN for _, t in parse(c)[1])


def with_clutter(page: str, rng: random.Random) -> str:
    for tag in ("<article>", "</article>", "</p>", "</p>", "</article>"):
        at = page.find(tag)
        if at >= 0 and rng.random() < 0.6:
            at += len(tag) * (tag == "</p>" or rng.random() < 0.5)
            page = page[:at] + rng.choice(SET_IN) + page[at:]
    return page


class Trees:
    """Gradient-boosted trees of a fixed depth for log loss, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        self.bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(len(y), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            score += self._value(tree, b)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1).astype(np.int16)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        inner = (1 << DEPTH) - 1
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(1 << DEPTH)
        at = np.zeros(len(b), np.int64)
        for level in range(DEPTH):
            first = (1 << level) - 1
            for node in range(first, 2 * first + 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 10:
                    continue
                best = 1e-3
                gs, hs = g[rows].sum(), h[rows].sum()
                for f in range(b.shape[1]):
                    v = b[rows, f]
                    gl, hl = np.cumsum(np.bincount(v, g[rows], BINS))[:-1], np.cumsum(np.bincount(v, h[rows], BINS))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, k
            at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
        at -= inner
        leaf = -RATE * np.bincount(at, g, 1 << DEPTH) / (np.bincount(at, h, 1 << DEPTH) + 1)
        return feature, cut, leaf

    @staticmethod
    def _value(tree, b: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        at = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return leaf[at - ((1 << DEPTH) - 1)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.bias + sum(self._value(t, b) for t in self.trees)


def fit(pages: list[str | None], seed: int = 0) -> Trees:
    rng = random.Random(seed)
    x: list[list[float]] = []
    y: list[int] = []
    parsed = [parse(p) for p in pages]
    times = Counter(t for _, blocks in parsed for t in {t for _, t in blocks})
    returning = {t for t, n in times.items() if n >= max(3, 0.02 * len(pages))}
    for page, own in zip(pages, parsed, strict=True):
        for nodes, blocks in (own, parse(with_clutter(page or "", rng))):
            labels = label(nodes, blocks, returning)
            if labels is None:
                continue
            for version in (nodes, nodes, disguise(nodes, rng), disguise(nodes, rng)):
                x += features(version)
                y += labels
    if not x:
        nodes, blocks = parse("<html><body><nav><a>a</a></nav><article><p>Some words of prose, and more of them.</p></article></body></html>")
        x, y = features(nodes), label(nodes, blocks, set())
    return Trees(np.array(x), np.array(y, float))


def decode(nodes: list[Node], weight: list[float]) -> list[bool]:
    """Which nodes are in the main text. States: before it, in it, out of it; a child of `in` is in or out, of `out` is out."""
    n = len(nodes)
    inside = [0.0] * n  # best sum of a subtree whose root is in
    before = [0.0] * n  # ... whose root is not, but may have roots of main text below
    for k in range(n - 1, -1, -1):
        inside[k] += weight[k]
        if k:
            inside[nodes[k].parent] += max(inside[k], 0.0)
            before[nodes[k].parent] += max(inside[k], before[k])
    state = [0] * n
    for k in range(n):
        up = state[nodes[k].parent] if k else 0
        if up == 0:
            state[k] = 1 if inside[k] > before[k] else 0
        elif up == 1:
            state[k] = 1 if inside[k] > 0 else 2
        else:
            state[k] = 2
    return [s == 1 for s in state]


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 200):
                b = batch.slice(lo, 200)
                parsed = [parse(x.as_py()) for x in b.column(2)]
                odds = np.clip(trees.log_odds(np.array([f for nodes, _ in parsed for f in features(nodes)])), -6, 6).tolist()
                texts, at = [], 0
                for nodes, blocks in parsed:
                    keep = decode(nodes, odds[at : at + len(nodes)])
                    at += len(nodes)
                    texts.append(" ".join(t for k, t in blocks if keep[k]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def sample_of(pages: DataFrame, sample: int) -> list[str]:
    """The html of the sample: its keys are found first, so that pages that aren't in it stay where they are."""
    order = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    keyed = pages.select(order.alias("place"), F.xxhash64("page_id", "html").alias("key"), "html").filter(F.length("html").between(1, LONGEST))
    keys = keyed.select("place", "key").distinct().orderBy("place", "key").limit(sample).collect()
    if not keys:
        return []
    found = keyed.filter(F.col("key").isin([r["key"] for r in keys])).select("key", "html").dropDuplicates(["key"]).collect()
    html = {r["key"]: r["html"] for r in found}
    return [html[r["key"]] for r in keys]


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars. One pass over pages, after those that find the sample."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(sample_of(pages, sample)))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(_extract(shared), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
