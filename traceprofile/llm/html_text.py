"""Main text of web pages from shallow features of flat text blocks.

A page is cut at block-level tags into a flat list of text blocks. Each block is described
by its words and link density, those of its two neighbours, and by what it stands in:
containers of the article (``article``, ``main``) or of other matter (``nav``, ``footer``,
a class named ``sidebar`` ...). An ``article`` or ``main`` below a container that is other
matter by its name alone is the article again, unless its own name says otherwise; names
such as ``has-sidebar`` or ``entry-header`` say nothing. A decision tree decides for each block whether it is main
text. The tree is trained on the blocks of a few labelled pages (:data:`LABELLED_PAGES`);
it is fitted once per job and travels with the task, pages are handled one at a time
inside tasks and never shuffled.

Defined results: a NULL or empty page has an empty text. A page cut off in the middle
keeps the blocks up to there; a tag cut off is markup and goes. Scripts, styles, comments
and form controls never form blocks. ``<br>`` is white space. Repeated rows each get their
row; pages of any length are kept whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML elements by their role, and words by which authors name page parts.
_RAW = frozenset(
    "script style noscript template textarea title iframe svg math select button object canvas".split()
)
#: Elements that a slash at the end of their tag closes.
_FOREIGN = frozenset(("svg", "math"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 hr".split())
_OTHER_TAGS = frozenset("nav footer aside form menu dialog fieldset head".split())
_OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disqus discussion footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification pagination popup promo "
    "promoted related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
_OTHER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog menu menubar".split()
)
_MAIN_TAGS = frozenset(("article", "main"))
#: First parts of names that tell of a page what it has, and of a header that it is an article's.
_MODIFIERS = frozenset("has no with without not".split())
_ARTICLE_PARTS = frozenset("entry post article story".split())
#: Last parts of names that tell the state of a part, not what it is.
_STATES = frozenset("enabled disabled required open closed active page results".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # quotes enclose a value only right after an equals sign
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<\Z",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_LABEL = "data-main"


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    heading: bool
    item: bool
    in_main: bool
    in_other: bool
    labelled: bool


def _names_other(value: str) -> bool:
    """Whether a class or id names other matter; each of its words is taken for itself."""
    for word in value.split():
        parts = [part.lower() for part in _NAME_PARTS.findall(word)]
        said = next((i for i, part in enumerate(parts) if part in _MODIFIERS), len(parts))
        parts = parts[:said]
        if not parts or parts[-1] in _STATES:
            continue
        if any(part in _OTHER_NAMES and not (part == "header" and before in _ARTICLE_PARTS)
               for before, part in zip(["", *parts], parts)):
            return True
    return False


def _is_other(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element holds other matter than the article by tag or role, and by names."""
    if tag in _OTHER_TAGS or (tag == "header" and not in_main):
        return True, False
    if not attributes or tag in ("html", "body"):
        return False, False
    named = False
    for name, *values in _NAMES.findall(attributes):
        value = "".join(values)
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, named
        if name == "role":
            if value.lower() in _OTHER_ROLES:
                return True, named
        elif name in ("class", "id") and _names_other(value):
            named = True
    return False, named


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    found: list[Block] = []
    # tag, main, other by tag or role, other by name, labelled; after it
    open_tags: list[tuple[str, bool, bool, bool, bool]] = []
    n_open: Counter[str] = Counter()
    text: list[str] = []
    linked = 0
    paragraph = ("", False, False)  # tag, other, labelled
    in_link = False
    at = 0

    def end_block() -> None:
        nonlocal linked
        whole = html.unescape("".join(text))
        words = whole.split()
        if words:
            _, main, other, named, labelled = open_tags[-1] if open_tags else ("", *[False] * 4)
            found.append(Block(
                " ".join(words), len(words), min(1.0, linked / len(words)),
                paragraph[0][:1] == "h", any(t[0] == "li" for t in open_tags[-2:]),
                main, other or named or paragraph[1], labelled or paragraph[2],
            ))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if in_link:
            linked += len(piece.split())

    while True:
        hit = _TAG.search(page, at)
        if hit is None:
            add(page[at:])
            break
        if hit.start() > at:
            add(page[at:hit.start()])
        at = hit.end()
        close, tag, attributes = hit.group(1, 2, 3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not close
        elif tag == "br":
            text.append(" ")
        elif tag in _RAW:
            if not close and not (tag in _FOREIGN and attributes.endswith("/")):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                text.append(" ")
        elif tag in _BLOCK:
            end_block()
            in_link = False
            paragraph = ("", False, False)
            main, other, named, labelled = open_tags[-1][1:] if open_tags else [False] * 4
            if close:
                if tag not in _PARAGRAPH and n_open[tag]:
                    left = ""
                    while left != tag:
                        left = open_tags.pop()[0]
                        n_open[left] -= 1
            elif tag in _PARAGRAPH:
                paragraph = (tag, any(_is_other(tag, attributes, main)), _LABEL in attributes)
            elif tag not in _VOID:
                main_now = main or tag in _MAIN_TAGS
                other_now, named_now = _is_other(tag, attributes, main_now)
                if tag in _MAIN_TAGS:  # its name counts only in a named container
                    named = named and (named_now or main)
                else:
                    named = named or named_now
                n_open[tag] += 1
                open_tags.append((
                    tag, main_now, other or other_now, named, labelled or _LABEL in attributes,
                ))
    end_block()
    return found


def features(page: list[Block]) -> np.ndarray:
    """One row per block: own and neighbouring words and link density, and the containers."""
    own = np.array([(b.words, b.link_density) for b in page], dtype=float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own])[:-1], np.vstack([own, edge])[1:]
    flags = np.array(
        [(b.heading, b.item, b.in_main, b.in_other) for b in page], dtype=float
    ).reshape(-1, 4)
    return np.hstack([own, before, after, flags])


class DecisionTree:
    """Binary classification tree by Gini impurity. Ties take the first feature and cut."""

    def __init__(self, max_depth: int = 6) -> None:
        self.max_depth = max_depth
        self.root: object = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.root = self._grow(x, y.astype(float), self.max_depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> object:
        if depth == 0 or y.min() == y.max():
            return float(y.mean())
        best = (0.0, -1, 0.0)
        impurity = y.mean() * (1 - y.mean()) * len(y)
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, feature] <= cut
                left, right = y[low], y[~low]
                gain = impurity - sum(s.mean() * (1 - s.mean()) * len(s) for s in (left, right))
                if gain > best[0] + 1e-12:
                    best = (gain, feature, cut)
        if best[1] < 0:
            return float(y.mean())
        low = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[low], y[low], depth - 1),
                self._grow(x[~low], y[~low], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))

        def walk(node: object, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, float):
                out[rows] = node
                return
            feature, cut, low, high = node
            left = x[rows, feature] <= cut
            walk(low, rows[left])
            walk(high, rows[~left])

        walk(self.root, np.arange(len(x)))
        return out > 0.5


_LONG = "One plain sentence of an article tells what happened and why it matters to those who read. " * 3
_SHORT = "It rained."
#: The labelled table: elements with ``data-main`` hold main text, all other text is not.
LABELLED_PAGES = (
    f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News today</a></li></ul></nav>"
    f"<div class=ad>Buy our fine shoes now at half the price.</div><article data-main><h1>A title of some "
    f"words</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_LONG}</p><ul><li>First point made</li><li>Second"
    f"</li></ul><p><a href=/x>Read</a> {_SHORT}</p><p>End.</p></article><footer>&copy; a site. {_LONG}</footer>",
    f"<header><p>The Site</p><p>{_SHORT}</p></header><main><h1 data-main>Title here</h1><div data-main><p>"
    f"{_LONG}</p><p>{_SHORT}</p></div><aside><p>{_LONG}</p><p><a href=/>More of this</a></p></aside>"
    f"<div class=comments><h2>Comments</h2><p>{_LONG}</p><p>{_SHORT}</p></div></main>"
    f"<div class=sidebar><p>{_LONG}</p></div><div class=cookie-notice><p>{_LONG}</p></div>",
    f"<div><a href=/>Home</a> <a href=/a>About us</a></div><div><p data-main>{_LONG}</p><p data-main>{_LONG}"
    f"</p><p data-main>{_SHORT}</p><p data-main>{_LONG}</p><p data-main>{_LONG}{_LONG}</p></div><div><a "
    f"href=/p>Privacy</a> <a href=/t>Terms of use</a></div><div>All rights reserved</div>",
    f"<p>Menu</p><p><a href=/>One</a></p><p><a href=/>Two links here</a></p><h1 data-main>A headline stands"
    f" here</h1><p data-main>{_LONG}</p><h2 data-main>Next part</h2><p data-main>{_LONG}</p><p data-main>"
    f"Some words with <a href=/>a link</a> in them, and then more words after it.</p><p data-main>{_LONG}"
    f"</p><p><a href=/>Previous</a></p><p><a href=/>Next page</a></p><p>Site by us</p>",
    f"<article data-main><p>{_SHORT}</p></article><footer><p>{_SHORT}</p></footer>"
    f"<nav><p>{_LONG}</p></nav><form><p>{_LONG}</p></form>",
    f"<nav><a href=/>Up</a></nav><article data-main><h1>Cut off</h1><p>{_LONG}</p><p>{_SHORT}",
    f"<nav><a href=/>Up</a></nav><article data-main><p>{_LONG}</p><ul><li><a href=/>Only link</a>",
    f"<nav><a href=/>Up</a></nav><article data-main><p>{_SHORT}</p><p>{_LONG}",
    f"<article data-main><h1>Words</h1><p>{_SHORT}</p><p>The last of it is cut off here and",
    f"<article data-main><p>{_LONG}</p></article><p>Page made by us</p>",
    f"<article data-main><p>Yes.</p><p><a href=/>{_LONG}</a></p><p>No.</p></article>"
    f"<div class=related><p><a href=/>{_LONG}</a></p><p>{_LONG}</p></div>",
    f"<div class='layout sidebar-right'><article data-main><header class=entry-header><h1>Title of it</h1>"
    f"</header><p>{_LONG}</p><p>{_SHORT}</p></article><div class=widget><p>{_LONG}</p></div></div>",
    f"<div id=page class='no-comments has-sidebar'><div><a href=/>Home</a> <a href=/a>About us</a></div><div "
    f"data-main><p>{_LONG}</p><p>{_LONG}</p><p>{_SHORT}</p><p>{_LONG}</p></div><div><a href=/p>Privacy</a> "
    f"<a href=/t>Terms of use</a></div></div>",
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    pages = [blocks(page) for page in LABELLED_PAGES]
    return (np.vstack([features(p) for p in pages]),
            np.array([b.labelled for p in pages for b in p]))


def main_text(page: str | None, tree: DecisionTree) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    return "\n\n".join(b.text for b, main in zip(found, tree.predict(features(found))) if main)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    tree = DecisionTree().fit(*labelled_table())
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(
        extract, f"page_id {id_type}, url {url_type}, text string, n_chars long"
    )
