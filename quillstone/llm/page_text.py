"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A block is a run of text between the bounds of block elements. Its features are the tags and the words of class, id, role
and itemprop of all elements around it, and shape of its text: length, links, punctuation, digits. Labels are main and
other; transitions depend on whether two blocks have one parent. Weights maximise the likelihood of labelled pages and
blocks are decoded by Viterbi.

Tables of pages have no labels. Labelled pages are those of the given ones that mark their article themselves (article,
main, role or itemprop). As they share few templates, each is also taken in several layouts: its blocks are put
into containers with common names, among menus, notices, adverts, sidebars, forms and comments with texts of the page
itself, so that the weights rest on names and shapes and not on one template.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import map_arrow

BITS = 13
#: Pages that weights are learnt from, layouts of each, and blocks beyond which a page is not learnt from.
LEARN_PAGES, LAYOUTS, LEARN_BLOCKS = 500, 6, 400
STEPS, RATE, PRIOR = 90, 0.15, 2e-5
#: Elements of HTML, fixed values: without content; within a line; never shown or not text of a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
UNSEEN = set("script style title noscript template svg math iframe object canvas audio video textarea select button datalist".split())
#: An element of the left kind ends an open one of the right kinds, up to the nearest of the last.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Names that pages give to their parts, for layouts.
NAMES = {
    "main": (("article", "main", "div", "section", "div", "td"), "article content main post entry story body text article-body post-content entry-content page-content story-body main-content prose hentry"),
    "menu": (("nav", "nav", "div", "ul", "td"), "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs links tabs pagination pager toc skip"),
    "header": (("header", "header", "div"), "header masthead site-header page-header top topbar branding logo tagline hero"),
    "footer": (("footer", "footer", "div"), "footer site-footer bottom colophon copyright legal imprint credits"),
    "sidebar": (("aside", "aside", "div", "section", "td"), "sidebar side aside widget widget-area related related-posts rail recommended popular trending most-read see-also"),
    "notice": (("div", "section", "div", "dialog"), "notice cookie cookies cookie-banner consent gdpr alert popup modal overlay warning privacy newsletter subscribe paywall announcement"),
    "advert": (("div", "aside", "section", "ins"), "ad ads advert advertisement ad-slot adsbygoogle promo promotion sponsor sponsored banner"),
    "form": (("form", "form", "div"), "form login signup search search-form contact-form register subscribe-form"),
    "comments": (("section", "div", "ol", "div"), "comments comment comment-list responses replies reply discussion disqus thread feedback reader-comments user-comments"),
    "share": (("div", "ul"), "share social sharing share-buttons tags byline meta author-box"),
}
WRAPS = "container wrapper row col page layout inner grid site outer box".split()
WITHIN = set("nav aside footer form".split())
MARKS = {"itemprop:articlebody", "role:main"}
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_bins: dict[str, int] = {}


def _bin(name: str) -> int:
    at = _bins.get(name)
    if at is None:
        if len(_bins) > 100_000:
            _bins.clear()
        at = _bins[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) >> (32 - BITS)
    return at


@dataclass
class Element:
    """An open element: what it and those around it say, as feature numbers, and the text in it so far."""

    tag: str
    words: frozenset[str] = frozenset()
    parent: Element | None = None
    marks: frozenset[str] = frozenset()
    around: tuple[int, ...] = field(init=False)

    def __post_init__(self) -> None:
        own = [] if self.tag in ("html", "body") else [f"a {self.tag}", *(f"w {w}" for w in self.words)]
        above = self.parent.around if self.parent else ()
        self.around = tuple({*above, *map(_bin, own)})


def words_of(value: str) -> frozenset[str]:
    """Words of a class or id, in lower case and without the s of a plural."""
    found = _NAME.findall(_CAMEL.sub("-", value).lower())
    return frozenset(w[:-1] if len(w) > 3 and w[-1] == "s" else w for w in found)


@dataclass
class Block:
    text: str
    parent: Element
    linked: int

    def features(self) -> list[int]:
        return [*self.parent.around, *map(_bin, self.shape())]

    def shape(self) -> list[str]:
        t, words = self.text, self.text.count(" ") + 1
        size = sum(words > n for n in (1, 2, 4, 8, 15, 30, 60))
        links = 0 if not self.linked else 1 + sum(self.linked > k * len(t) for k in (0.3, 0.7))
        end = "." if t[-1] in ".!?\"')”»" else ":" if t[-1] in ":;," else "-"
        digits = sum(map(str.isdigit, t[:200])) * 3 > min(len(t), 200)
        out = [f"own {self.parent.tag}", f"size {size}", f"links {links}", f"end {end}", f"size {size} links {links} end {end}", f"own {self.parent.tag} links {links}"]
        return out + ["digits"] * digits + ["rights"] * ("©" in t) + ["bars"] * (" | " in t or " · " in t)


class Leaves(HTMLParser):
    """The blocks of a page in order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.top = Element("html")
        self.open: list[Element] = [self.top]
        self.parts: list[str] = []
        self.unseen = self.links = self.linked = 0
        self.feed(html)
        self.close()
        self.flush()

    def container(self) -> Element:
        return next(e for e in reversed(self.open) if e.tag not in INLINE)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.container(), self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            ends, bound = CLOSES.get(tag, ({"p"}, {"table", "td", "th", "button", "object"}))
            for e in reversed(self.open):
                if e.tag in ends:
                    self.shut(e)
                    break
                if e.tag in bound:
                    break
        named = [(k, v) for k, v in attrs if v and k in ("class", "id", "role", "itemprop")]
        words = frozenset().union(*(words_of(v) for _, v in named)) if named else frozenset()
        self.open.append(Element(tag, words, self.open[-1], frozenset(f"{k}:{v.lower()}" for k, v in named)))
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for e in reversed(self.open[1:]):
            if e.tag == tag:
                if tag not in INLINE:
                    self.flush()
                self.shut(e)
                return
            if tag in INLINE and e.tag not in INLINE:
                return

    def shut(self, element: Element) -> None:
        while True:
            e = self.open.pop()
            self.unseen -= e.tag in UNSEEN
            self.links -= e.tag == "a"
            if e is element:
                return

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks_of(html: str | None) -> list[Block]:
    return Leaves(html).blocks if html else []


def _chain(e: Element | None) -> Iterator[Element]:
    while e:
        yield e
        e = e.parent


def own_labels(blocks: list[Block]) -> list[int] | None:
    """Labels from a page that marks its article itself: 1 within it; None where it does not, or holds nothing else."""
    out = []
    for b in blocks:
        chain = list(_chain(b.parent))
        inside = next((k for k, e in enumerate(chain) if e.tag in ("article", "main") or e.marks & MARKS), None)
        out.append(int(inside is not None and not any(e.tag in WITHIN or e.words & {"comment", "ad", "advert"} for e in chain[:inside])))
    return out if 0 < sum(out) < len(out) else None


def layout(main: list[Block], other: list[Block], draw: random.Random) -> tuple[list[Block], list[int]]:
    """The blocks of a page in invented containers, with labels: main ones in order, others around and among them."""
    body = Element("body", parent=Element("html"))

    def box(kind: str, above: Element, plain: float = 0.15) -> Element:
        tags, names = NAMES[kind]
        tag = draw.choice(tags)
        named = draw.random() > (0.35 if tag not in ("div", "section", "td", "ul", "ol") else plain if kind == "main" else 0.0)
        return Element(tag, words_of(draw.choice(names.split())) if named else frozenset(), above)

    def wrap(above: Element) -> Element:
        for _ in range(draw.choice((0, 0, 1, 1, 2))):
            above = Element("div", words_of(draw.choice(WRAPS)) if draw.random() < 0.7 else frozenset(), above)
        return above

    blocks, labels = [], []

    def put(text: str, tag: str, above: Element, label: int, linked: bool = False) -> None:
        blocks.append(Block(text, Element(tag, parent=above), len(text) if linked else 0))
        labels.append(label)

    prose = [b.text for b in main] or ["-"]
    short = [b.text for b in other] or prose

    def part(kind: str, above: Element) -> None:
        at = box(kind, above)
        if draw.random() < 0.4:
            at = Element(draw.choice(("div", "ul", "section")), parent=at)
        if kind not in ("menu", "share", "header") and draw.random() < 0.4:
            put(" ".join(draw.choice(short).split()[:3]), draw.choice(("h2", "h3", "h4", "strong", "p")), at, 0)
        for _ in range(draw.randint(1, 7 if kind in ("menu", "comments") else 3)):
            within = at
            if kind == "comments":
                within = Element(draw.choice(("article", "div", "li")), words_of(draw.choice(("comment", "comment-body", "reply", "", ""))), at)
            if kind in ("menu", "share"):
                put(" ".join(draw.choice(short).split()[:3]), draw.choice(("li", "li", "a", "span", "div")).replace("a", "li"), within, 0, True)
            else:
                text = draw.choice(prose) if draw.random() < 0.6 else draw.choice(short)
                if kind in ("header", "footer", "form") or draw.random() < 0.3:
                    text = " ".join(text.split()[: draw.randint(1, 12)])
                put(text, draw.choice(("p", "p", "div", "li", "label", "h3") if kind != "comments" else ("p", "p", "div")).replace("label", "div"), within, 0, draw.random() < 0.2)

    outer = wrap(body)
    for kind in draw.sample(("notice", "header", "menu", "advert", "form", "share"), draw.randint(1, 4)):
        part(kind, draw.choice((body, outer)))
    holder = wrap(outer)
    if draw.random() < 0.3:
        part("sidebar", holder)
    at = box("main", holder)
    if draw.random() < 0.4:
        at = box("main", at, 0.5)
    if draw.random() < 0.15:
        head = Element("header", parent=at)
    else:
        head = at
    if draw.random() < 0.1:
        main = main[: draw.randint(1, 2)]
    for k, b in enumerate(main):
        tag = b.parent.tag if b.parent.tag in ("h1", "h2", "h3", "p", "li", "td", "pre", "blockquote") else "p"
        if k and draw.random() < 0.12:
            put(" ".join(b.text.split()[: draw.randint(1, 6)]), draw.choice(("h2", "h2", "h3", "h4")), at, 1)
        if k and draw.random() < 0.12:
            items = Element(draw.choice(("ul", "ol", "dl", "table")), parent=at)
            for _ in range(draw.randint(2, 6)):
                put(" ".join(draw.choice(prose).split()[: draw.randint(1, 15)]), {"dl": "dd", "table": "td"}.get(items.tag, "li"), items, 1, draw.random() < 0.1)
        if k and draw.random() < 0.1:
            tag = draw.choice(("blockquote", "div", "pre", "figcaption", "p"))
        text = b.text if draw.random() > 0.12 else " ".join(b.text.split()[: draw.randint(1, 5)])
        put(text, tag, head if tag == "h1" else at, 1)
        if draw.random() < 0.06 and k:
            part(draw.choice(("advert", "sidebar", "notice", "share")), at)
    for kind in draw.sample(("comments", "sidebar", "advert", "form", "share", "footer", "menu", "comments"), draw.randint(1, 5)):
        part(kind, draw.choice((at, holder, outer, body)) if kind != "footer" else draw.choice((outer, body)))
    return blocks, labels


def same_parent(blocks: list[Block]) -> list[int]:
    """For each block but the first: 1 if it and the one before have one parent, or parents that are children of one."""
    near = lambda a, b: a is b or (a.parent is b.parent and a.tag == b.tag)
    return [int(near(a.parent, b.parent)) for a, b in zip(blocks, blocks[1:], strict=False)]


@dataclass
class Model:
    """weights of features for the label main; turns[near][a][b] of transitions."""

    weights: np.ndarray
    turns: np.ndarray

    def emissions(self, features: list[list[int]]) -> list[float]:
        w = self.weights
        return [float(w[f].sum()) for f in features]


def viterbi(scores: list[float], near: list[int], turns: list) -> list[int]:
    """Labels of the best sequence, scores being those of label 1 against 0; of equal ones label 0 is taken."""
    if not scores:
        return []
    a, b, back = 0.0, scores[0], []
    for s, k in zip(scores[1:], near, strict=True):
        (t00, t01), (t10, t11) = turns[k]
        back.append((int(b + t10 > a + t00), int(b + t11 > a + t01)))
        a, b = max(a + t00, b + t10), max(a + t01, b + t11) + s
    label, out = int(b > a), []
    for step in reversed(back):
        out.append(label)
        label = step[label]
    return [label, *reversed(out)][:1] + out[::-1]


def flattened(pages: list[tuple[list[list[int]], list[int], list[int]]]) -> tuple[np.ndarray, ...]:
    """Pages (features, near, labels) as arrays, longest first: features, their blocks, sizes and starts of pages, near and labels of blocks."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    sizes = np.array([len(p[0]) for p in pages])
    flat = np.array([f for p in pages for x in p[0] for f in x], "i8")
    of = np.repeat(np.arange(sizes.sum()), [len(x) for p in pages for x in p[0]])
    near = np.concatenate([[0, *p[1]] for p in pages]).astype("i8")
    labels = np.concatenate([p[2] for p in pages]).astype("i8")
    return flat, of, sizes, np.r_[0, np.cumsum(sizes)[:-1]], near, labels


def likelihood(weights: np.ndarray, turns: np.ndarray, flat, of, sizes, starts, near, labels) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood per block of flattened() pages and its gradients, by forward and backward sums over all pages at once."""
    n = int(sizes.sum())
    emit = np.bincount(of, weights[flat], n)
    score = np.stack([np.zeros(n), emit], 1)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[starts] = score[starts]
    for k in range(1, int(sizes[0])):
        i = starts[: np.searchsorted(-sizes, -k)] + k  # pages with more than k blocks
        ahead[i] = np.logaddexp(ahead[i - 1, :1] + turns[near[i], 0], ahead[i - 1, 1:] + turns[near[i], 1]) + score[i]
    for k in range(int(sizes[0]) - 2, -1, -1):
        i = starts[: np.searchsorted(-sizes, -(k + 1))] + k
        to = turns[near[i + 1]] + (score[i + 1] + behind[i + 1])[:, None, :]
        behind[i] = np.logaddexp(to[:, :, 0], to[:, :, 1])
    ends = starts + sizes - 1
    total = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    whole = np.repeat(total, sizes)
    main = np.exp(ahead[:, 1] + behind[:, 1] - whole)
    grad = np.bincount(flat, (labels - main)[of], len(weights)) / n
    later = np.ones(n, bool)
    later[starts] = False
    i = np.flatnonzero(later)
    pair = np.exp(ahead[i - 1][:, :, None] + turns[near[i]] + (score[i] + behind[i])[:, None, :] - whole[i][:, None, None])
    turn = np.zeros_like(turns)
    for kind in (0, 1):
        turn[kind] -= pair[near[i] == kind].sum(0)
    np.add.at(turn, (near[i], labels[i - 1], labels[i]), 1)
    seen = (emit * labels).sum() + turns[near[i], labels[i - 1], labels[i]].sum()
    return (seen - total.sum()) / n, grad, turn / n


def train(pages: list[tuple[list[list[int]], list[int], list[int]]]) -> Model:
    """Weights that maximise the penalised likelihood (Adam over all pages; the sum is concave)."""
    values, first, second = np.zeros((1 << BITS) + 8), 0.0, 0.0
    arrays = flattened(pages)
    for step in range(1, STEPS + 1):
        weights, turns = values[:-8], values[-8:].reshape(2, 2, 2)
        _, g, t = likelihood(weights, turns, *arrays)
        grad = np.r_[g, t.ravel()] - PRIOR * values
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        values = values + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(values[:-8], values[-8:].reshape(2, 2, 2))


def examples(html: str | None) -> list[tuple[list[list[int]], list[int], list[int]]]:
    """A page that marks its article, as it is and in LAYOUTS layouts, drawn by its own bytes; nothing for other pages."""
    blocks = blocks_of(html)
    labels = own_labels(blocks) if len(blocks) <= LEARN_BLOCKS else None
    if not labels:
        return []
    out = [(blocks, labels)]
    draw = random.Random(zlib.crc32(html.encode("utf-8", "surrogatepass")))
    main, other = ([b for b, x in zip(blocks, labels, strict=True) if x == k] for k in (1, 0))
    out += [layout(main, other, draw) for _ in range(LAYOUTS)]
    return [([b.features() for b in bs], same_parent(bs), ls) for bs, ls in out]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(at, *x) for at, html in zip(b.column("at").to_pylist(), b.column("html").to_pylist(), strict=True) for x in examples(html)]
        types = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["at", "features", "near", "labels"])


def learn(pages: DataFrame, most: int = LEARN_PAGES) -> Model | None:
    """A model from up to about most pages (by a hash) that mark their article; None where none does.

    Feature numbers, not texts, come to the driver: at most (LAYOUTS + 1) * most lists, of pages with up to LEARN_BLOCKS blocks.
    """
    n = pages.count()
    share = min(1.0, 1.5 * most / n) if n else 1.0
    at = F.xxhash64("page_id", "url")
    drawn = pages.select(at.alias("at"), "html").where(F.pmod("at", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = map_arrow(drawn, _examples, "at long, features array<array<int>>, near array<int>, labels array<int>")
    found = rows.orderBy(F.xxhash64("at", F.lit(1)), "at").limit((LAYOUTS + 1) * most).collect()
    return train([(r["features"], r["near"], r["labels"]) for r in found]) if found else None


def main_text(html: str | None, model: Model | None) -> str:
    """The blocks of a page that the model takes for its main text; without a model those outside of menus, headers, footers, sidebars and forms."""
    blocks = blocks_of(html)
    if model is None:
        keep = [not any(e.tag in WITHIN | {"header"} for e in _chain(b.parent)) for b in blocks]
    else:
        keep = viterbi(model.emissions([b.features() for b in blocks]), same_parent(blocks), model.turns.tolist())
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page, from the whole html; null or empty html gives an empty text.

    Equal pages give equal texts, wherever they stand; a page_id that occurs twice gives two rows, an empty table none.
    Other columns are not read. Without a model one is learnt from the pages themselves.
    """
    model = model or learn(pages)
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast(model)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h, held.value) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return map_arrow(pages.select("page_id", "url", "html"), texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
