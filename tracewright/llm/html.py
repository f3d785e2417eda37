"""Main text of web pages: flat text blocks, judged by a decision tree over word counts and link densities.

A page is cut at block tags into text blocks in page order. Each has its number of words, its share of words inside
links, the same two of the blocks before and after it, and whether it stands in a part marked as page furniture (menu,
header, footer, sidebar, notice, advert, form, comments) or in the marked article. A decision tree trained on the small
labelled table below decides which blocks are main text. Scripts, styles, comments in the markup and the like hold no
blocks. Character references are decoded, white space inside a block becomes one space, and blocks are joined by one.

Null or empty pages give empty text, as do pages without main text. Unclosed tags, scripts and comments reach to the end
of their parent or the page. Repeated rows repeat their result; further columns are ignored. Pages are handled one by
one in time proportional to their length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?:svg|canvas)\b[^>]*+(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|select|iframe|canvas|title)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<[/!?a-z][^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"\b(?:class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<=\s)(hidden)(?=[\s/=]|$)", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")

#: Tags inside which text flows on; all others end a block.
INLINE = set("a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mfenced munder mover mtable mtr mtd semantics annotation".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag is often left out; they never carry a mark.
LOOSE = set("p li dt dd tr td th option thead tbody tfoot html body head".split())
FURNITURE_TAGS = set("nav footer aside form dialog menu".split())
ARTICLE_TAGS = {"article", "main"}
#: Headings and paragraphs hold text, whatever they are called.
TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table".split())
#: A name (class, id or role) marks page furniture if each of its parts is one of these words or of those below, and one
#: at least is one of these. So ``cookie-notice`` and ``site-footer`` do, ``form-of-government`` and ``related-work`` do not.
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent "
    "disclaimer discussion disqus footer form gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination "
    "popup promo promoted promotion related reply replies search share sharing sidebar signup social sponsor sponsored subscribe "
    "topbar widget".split()
)
SUPPORT_WORDS = set(
    "area article articles author bar block body bottom box button buttons col column container content count desktop fixed float floating global "
    "group header heading holder inner item items label large layout left link links list local main message mobile more outer page panel policy post posts "
    "primary right row secondary section shell site slot small sticky text thread title toggle tools top unit user wrap wrapper".split()
)


@dataclass
class Block:
    words: int
    linked: int
    furniture: bool
    article: bool
    text: str


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    #: Name of each open element, and whether it or one around it is furniture or an article.
    open_tags: list[tuple[str, bool, bool]] = field(default_factory=lambda: [("", False, False)])
    open_names: Counter = field(default_factory=Counter)
    link: bool = False

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join(entities.unescape("".join(p for p, _ in self.parts)).split())
        linked = sum(len(entities.unescape(p).split()) for p, inside in self.parts if inside)
        self.parts = []
        if text:
            words = text.count(" ") + 1
            self.blocks.append(Block(words, min(linked, words), *self.open_tags[-1][1:], text))

    def tag(self, name: str, closing: bool, rest: str) -> None:
        if name == "a":
            self.link = not closing
        if name in INLINE:
            return
        self.end_block()
        if name in VOID or name in LOOSE:
            return
        if name not in ("a", "span"):
            self.link = False
        if closing:
            found = "" if self.open_names[name] else name
            while found != name:
                found = self.open_tags.pop()[0]
                self.open_names[found] -= 1
        elif not rest.endswith("/"):
            _, furniture, article = self.open_tags[-1]
            own = name in FURNITURE_TAGS or (name == "header" and not article) or _marked(name, rest)
            self.open_tags.append((name, furniture or own, article or name in ARTICLE_TAGS))
            self.open_names[name] += 1


def _furniture(names: str) -> bool:
    for name in names.split():
        parts = set(_PART.findall(name))
        if parts & FURNITURE_WORDS and parts <= FURNITURE_WORDS | SUPPORT_WORDS:
            return True
    return False


def _marked(name: str, rest: str) -> bool:
    if name in ("article", "main", "body", "html") and "comment" not in rest:
        return False
    named = name not in TEXT_TAGS
    for found in _NAMED.finditer(rest):
        if found[4]:
            return True
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", found[1] or found[2] or found[3] or "").lower()
        if found[0][:5].lower() == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif named and _furniture(value):
            return True
    return False


def blocks(page: str | None) -> list[Block]:
    """The text blocks of one page, in order."""
    page, reader, at = page or "", _Reader(), 0
    for found in _MARKUP.finditer(page):
        if found.start() > at:
            reader.parts.append((page[at : found.start()], reader.link))
        at = found.end()
        if found["tag"]:
            reader.tag(found["tag"].lower(), bool(found["close"]), found["rest"])
    reader.parts.append((page[at:], reader.link))
    reader.end_block()
    return reader.blocks


#: Labelled blocks: words, link density, words and link density before, words and link density after, furniture,
#: article, and whether the block is main text. A page edge counts as an empty neighbour.
LABELLED = [
    # menus and lists of links
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (2, 1.0, 1, 1.0, 9, 0.0, 1, 0, 0), (1, 1.0, 1, 1.0, 7, 0.0, 1, 0, 0),
    (3, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0), (4, 1.0, 60, 0.0, 5, 1.0, 0, 0, 0), (6, 1.0, 5, 1.0, 4, 1.0, 0, 0, 0),
    (12, 0.9, 40, 0.0, 11, 1.0, 0, 0, 0), (3, 0.7, 2, 1.0, 1, 1.0, 0, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0), (3, 1.0, 3, 1.0, 3, 1.0, 0, 1, 0),
    # adverts, notices, comments and forms, also long ones
    (9, 0.0, 1, 1.0, 5, 0.0, 1, 0, 0), (7, 0.0, 2, 1.0, 80, 0.0, 1, 0, 0), (30, 0.1, 90, 0.0, 70, 0.0, 1, 1, 0), (12, 0.0, 80, 0.0, 75, 0.0, 1, 1, 0),
    (45, 0.0, 60, 0.0, 3, 0.0, 1, 0, 0), (120, 0.0, 4, 0.0, 90, 0.0, 1, 0, 0), (5, 0.0, 110, 0.0, 0, 0.0, 1, 1, 0), (60, 0.0, 5, 0.0, 5, 0.0, 1, 1, 0),
    (2, 0.0, 3, 0.0, 2, 0.0, 1, 0, 0), (20, 0.3, 10, 0.0, 2, 1.0, 1, 0, 0),
    # footers
    (10, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0), (8, 0.0, 4, 0.0, 0, 0.0, 1, 0, 0), (14, 0.4, 90, 0.0, 0, 0.0, 1, 0, 0), (6, 0.5, 3, 1.0, 0, 0.0, 0, 0, 0),
    (5, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), (4, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0),
    # a marked article: headings, long and short paragraphs, paragraphs with links
    (5, 0.0, 9, 0.0, 90, 0.0, 0, 1, 1), (6, 0.0, 8, 0.0, 3, 0.0, 0, 1, 1), (90, 0.0, 5, 0.0, 120, 0.0, 0, 1, 1), (2, 0.0, 80, 0.0, 70, 0.0, 0, 1, 1),
    (1, 0.0, 4, 0.0, 30, 0.0, 0, 1, 1), (1, 0.0, 2, 0.0, 8, 0.0, 0, 1, 1), (40, 0.0, 100, 0.0, 7, 0.0, 0, 1, 1), (3, 0.0, 60, 0.0, 9, 0.0, 0, 1, 1),
    (70, 0.2, 80, 0.0, 50, 0.1, 0, 1, 1), (12, 0.4, 60, 0.0, 60, 0.0, 0, 1, 1), (200, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (4, 0.0, 0, 0.0, 12, 0.0, 0, 1, 1),
    (25, 0.0, 1, 1.0, 40, 0.0, 0, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (5, 1.0, 90, 0.0, 85, 0.0, 0, 1, 1), (8, 0.0, 30, 0.1, 0, 0.0, 0, 1, 1),
    # a marked article next to menus, lists of links and page ends
    (2, 0.0, 1, 1.0, 2, 0.0, 0, 1, 1), (5, 0.0, 1, 1.0, 8, 0.0, 0, 1, 1), (3, 0.0, 2, 1.0, 3, 1.0, 0, 1, 1), (1, 0.0, 3, 1.0, 1, 1.0, 0, 1, 1),
    (40, 0.0, 60, 0.0, 3, 1.0, 0, 1, 1), (2, 0.0, 30, 0.0, 1, 1.0, 0, 1, 1), (7, 0.0, 1, 1.0, 0, 0.0, 0, 1, 1), (12, 0.0, 4, 1.0, 6, 0.2, 0, 1, 1),
    # pages without marks: long text with few links, short text between long text, headings over text
    (60, 0.0, 5, 0.0, 80, 0.0, 0, 0, 1), (45, 0.1, 3, 1.0, 50, 0.0, 0, 0, 1), (90, 0.05, 70, 0.0, 4, 1.0, 0, 0, 1), (25, 0.0, 60, 0.0, 40, 0.0, 0, 0, 1),
    (6, 0.0, 70, 0.0, 65, 0.0, 0, 0, 1), (3, 0.0, 50, 0.0, 90, 0.0, 0, 0, 1), (5, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1), (150, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (30, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1), (18, 0.0, 40, 0.0, 35, 0.0, 0, 0, 1), (8, 0.0, 45, 0.0, 30, 0.0, 0, 0, 1), (20, 0.0, 4, 0.0, 0, 0.0, 0, 0, 1),
]


def features(page: list[Block]) -> np.ndarray:
    own = np.array([[b.words, b.linked / b.words] for b in page], dtype=np.float64).reshape(-1, 2)
    edge = np.zeros((1, 2))
    marks = np.array([[b.furniture, b.article] for b in page], dtype=np.float64).reshape(-1, 2)
    return np.hstack([own, np.vstack([edge, own[:-1]])[: len(own)], np.vstack([own[1:], edge])[: len(own)], marks])


class DecisionTree:
    """A binary tree grown by the largest fall of the Gini impurity; ties go to the earlier feature and lower cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.share = float(y.mean())
        self.feature = None
        best = 1e-9
        for feature in range(x.shape[1]) if depth and 0 < self.share < 1 else ():
            values = np.unique(x[:, feature])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, feature] <= cut
                if least <= low.sum() <= len(y) - least:
                    parts = (y[low], y[~low])
                    gain = self.share * (1 - self.share) - sum(len(p) / len(y) * p.mean() * (1 - p.mean()) for p in parts)
                    if gain > best + 1e-12:
                        best, self.feature, self.cut = gain, feature, float(cut)
        if self.feature is not None:
            low = x[:, self.feature] <= self.cut
            self.low, self.high = (DecisionTree(x[side], y[side], depth - 1, least) for side in (low, ~low))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.share)
        low, out = x[:, self.feature] <= self.cut, np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def train(labelled: list[tuple] = LABELLED) -> DecisionTree:
    table = np.array(labelled, dtype=np.float64)
    return DecisionTree(table[:, :-1], table[:, -1])


def main_text(page: str | None, tree: DecisionTree) -> str:
    found = blocks(page)
    if not found:
        return ""
    chosen = tree.predict(features(found)) > 0.5
    return " ".join(b.text for b, keep in zip(found, chosen, strict=True) if keep)


def extract(pages: DataFrame, labelled: list[tuple] = LABELLED) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    tree = train(labelled)
    source = pages.select("page_id", "url", "html")

    def run(source):
        for batch in source:
            texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
