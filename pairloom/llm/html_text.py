"""Main text of web pages: flat blocks classified by a small decision tree.

A page is cut into flat text blocks at block-level tags. Each block has its number of words and
link density, those of its neighbours, and where it stands (the nearest container that says
something). A decision tree, trained on the small table below, keeps or drops each block.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.llm.common import texts
from pairloom.session import ship_package

# Element names by how they are treated.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style title textarea noscript template xmp iframe noembed noframes".split())  # closed by their own end tag only
UNSEEN = frozenset("svg math select button object canvas audio video map datalist dialog".split())
CONTENT = frozenset("article main".split())
ASIDE = frozenset("nav header footer aside form menu head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id or role that tell what a container is for.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar rail widget comment comments disqus reply replies respondents share sharing social related "
    "recommended cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe signup login "
    "search form copyright legal contentinfo complementary toolbar pagination pager skip".split()
)
CONTENT_WORDS = frozenset("article content main post entry story body articlebody maincontent".split())

# Those of the aside words that an article may be about, or be called by its theme. They say little,
# so that the block itself and its neighbours decide.
DOUBTFUL_WORDS = frozenset(
    "promo promotion widget search form notice notices alert share sharing social legal copyright login signup rail toolbar banner pager skip".split()
)

# Words of containers whose articles are not the page's own.
OTHERS_WORDS = frozenset("comment comments disqus reply replies respondents related recommended sidebar teaser".split())

_MARKUP = regex.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    regex.DOTALL,
)
_HINT = regex.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", regex.IGNORECASE)
_PIECE = regex.compile(r"[a-z]+|[0-9]+")
_HIDDEN = regex.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", regex.IGNORECASE)

# DOUBTFUL: a word hints at something beside the article. OTHERS: outside, and so is any article in it.
NOWHERE, INSIDE, DOUBTFUL, OUTSIDE, OTHERS = 0, 1, -0.5, -1, -2


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    zone: float
    heading: bool

    @property
    def density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def _zone(name: str, attributes: str, outer: float) -> float | None:
    """What a container says of its contents; None if nothing."""
    said = {w for hint in _HINT.findall(attributes) for w in _PIECE.findall(" ".join(hint).lower())}
    if outer == OTHERS or said & OTHERS_WORDS or name == "aside":
        return OTHERS
    if name in CONTENT:
        return INSIDE
    if name in ASIDE:
        # A header inside an article is the article's own.
        return None if name == "header" and outer == INSIDE else OUTSIDE
    apart, content = said & ASIDE_WORDS, said & CONTENT_WORDS
    if apart and apart <= DOUBTFUL_WORDS:
        return None if outer == OUTSIDE else DOUBTFUL
    if apart:
        return None if content and apart == {"header"} else OUTSIDE
    return INSIDE if content else None


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    link_words: int = 0
    links: int = 0
    heading: bool = False
    open: list[tuple[str, float]] = field(default_factory=list)  # containers and their zones

    def text(self, raw: str) -> None:
        if raw:
            shown = html.unescape(raw)
            self.pieces.append(shown)
            if self.links:
                self.link_words += len(shown.split())

    def flush(self) -> None:
        words = "".join(self.pieces).split()
        if words:
            zone = self.open[-1][1] if self.open else NOWHERE
            self.blocks.append(Block(" ".join(words), len(words), min(self.link_words, len(words)), zone, self.heading))
        self.pieces, self.link_words = [], 0

    def tag(self, end: bool, name: str, attributes: str) -> None:
        if name == "a":
            self.links = max(0, self.links + (-1 if end else 1))
        if name in INLINE:
            if name == "br":
                self.pieces.append("\n")
            return
        self.flush()
        self.links = 0  # a block ends the links that are still open
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading = not end
        elif name == "p":
            self.heading = False
        if name in VOID or attributes.endswith("/"):
            return
        if end:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == name:
                    del self.open[i:]
                    break
        elif name not in ("p", "li", "dt", "dd", "option", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6") or _HINT.search(attributes):
            outer = self.open[-1][1] if self.open else NOWHERE
            zone = OUTSIDE if _HIDDEN.search(attributes) else _zone(name, attributes, outer)
            self.open.append((name, outer if zone is None else zone))


@lru_cache(maxsize=64)
def _closing(name: str) -> regex.Pattern:
    return regex.compile(f"</{name}", regex.IGNORECASE | regex.ASCII)


class _Ends:
    """Where elements are closed. A place that was found holds until the reader has passed it, so a page is
    searched once for each name, however often the element is opened."""

    def __init__(self, page: str):
        self.page, self.next = page, {}

    def after(self, name: str, at: int) -> int:
        """Place of the next end tag; -1 if there is none."""
        found = self.next.get(name)
        if found is None or -1 < found < at:
            hit = _closing(name).search(self.page, at)
            found = self.next[name] = hit.start() if hit else -1
        return found


def blocks_of(page: str) -> list[Block]:
    """Flat text blocks of a page, in order; contents of scripts, styles and controls are skipped."""
    reader, at, ends = _Reader(), 0, _Ends(page)
    while True:
        found = _MARKUP.search(page, at)
        if found is None:
            reader.text(page[at:])
            break
        reader.text(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            if found[0].startswith("<![CDATA["):
                reader.text(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        name, end = found[2].lower(), bool(found[1])
        if not end and (name in RAW or name in UNSEEN) and not found[3].endswith("/"):
            reader.flush() if name in RAW else None
            close = ends.after(name, at)
            if close < 0:
                at = len(page) if name in RAW else at
            else:
                at = (page.find(">", close) + 1) or len(page)
            continue
        reader.tag(end, name, found[3])
    reader.flush()
    return reader.blocks


# ---------------------------------------------------------------- the tree

FEATURES = ("zone", "words", "density", "words_before", "density_before", "words_after", "density_after", "heading")
# Labelled blocks: the features in order, then 1 for main text.
TRAINING = (
    # inside an article: long and short paragraphs, headings, list items with some links
    (1, 120, 0.00, 90, 0.00, 140, 0.00, 0, 1), (1, 3, 0.00, 120, 0.00, 80, 0.00, 0, 1), (1, 2, 0.00, 0, 0.00, 60, 0.00, 1, 1),
    (1, 11, 0.00, 3, 0.00, 95, 0.00, 1, 1), (1, 1, 0.00, 200, 0.00, 1, 0.00, 0, 1), (1, 40, 0.30, 60, 0.00, 20, 0.10, 0, 1),
    (1, 8, 1.00, 50, 0.00, 70, 0.05, 0, 1), (1, 25, 0.00, 2, 0.00, 0, 0.00, 0, 1), (1, 300, 0.02, 9, 0.00, 12, 1.00, 0, 1),
    (1, 6, 0.00, 4, 1.00, 7, 0.00, 0, 1), (1, 1, 0.00, 1, 0.00, 1, 0.00, 0, 1), (1, 60, 0.00, 5, 0.00, 20, 0.05, 0, 1),
    (1, 38, 0.00, 12, 0.00, 10, 0.00, 0, 1), (1, 52, 0.00, 4, 0.00, 9, 0.00, 0, 1), (1, 25, 0.00, 8, 0.00, 11, 0.00, 0, 1),
    (1, 90, 0.00, 30, 0.00, 10, 0.00, 0, 1), (1, 33, 0.10, 9, 0.00, 9, 0.00, 0, 1), (1, 14, 0.00, 10, 0.00, 9, 0.00, 0, 1),
    (1, 5, 0.00, 3, 0.00, 2, 0.00, 0, 1), (1, 9, 0.50, 4, 0.00, 6, 0.80, 0, 1), (1, 4, 0.00, 2, 1.00, 3, 1.00, 0, 1),
    (1, 12, 0.00, 0, 0.00, 0, 0.00, 0, 1), (1, 18, 0.00, 40, 0.00, 4, 0.90, 0, 1), (1, 7, 0.00, 6, 0.00, 8, 0.00, 1, 1),
    # in a menu, header, footer, sidebar, notice, advert, form or comment section
    (-1, 1, 1.00, 1, 1.00, 1, 1.00, 0, 0), (-1, 2, 1.00, 0, 0.00, 1, 1.00, 0, 0), (-1, 8, 0.00, 1, 1.00, 11, 0.00, 0, 0),
    (-1, 20, 0.00, 90, 0.00, 0, 0.00, 0, 0), (-1, 140, 0.00, 60, 0.00, 120, 0.00, 0, 0), (-1, 4, 0.00, 30, 0.00, 2, 0.50, 1, 0),
    (-1, 45, 0.10, 3, 0.00, 50, 0.00, 0, 0), (-1, 60, 0.00, 80, 0.00, 80, 0.00, 0, 0), (-1, 15, 0.40, 200, 0.00, 3, 1.00, 0, 0),
    (-1, 3, 0.00, 1, 0.00, 1, 0.00, 1, 0), (-1, 30, 0.00, 10, 0.00, 10, 0.00, 0, 0), (-1, 250, 0.01, 5, 0.00, 5, 0.00, 0, 0),
    (-1, 38, 0.00, 70, 0.00, 30, 0.00, 0, 0), (-1, 75, 0.00, 45, 0.00, 60, 0.00, 0, 0), (-1, 10, 0.00, 50, 0.00, 65, 0.00, 0, 0),
    (-1, 6, 0.00, 20, 0.00, 80, 0.00, 1, 0), (-1, 33, 0.00, 2, 1.00, 90, 0.00, 0, 0), (-1, 110, 0.05, 0, 0.00, 40, 0.00, 0, 0),
    # a word that may be the article's theme as well: judged by words and links
    (-0.5, 70, 0.00, 60, 0.00, 75, 0.00, 0, 1), (-0.5, 65, 0.00, 0, 0.00, 0, 0.00, 0, 1), (-0.5, 120, 0.00, 2, 1.00, 3, 1.00, 0, 1),
    (-0.5, 48, 0.05, 50, 0.00, 60, 0.00, 0, 1), (-0.5, 18, 0.00, 70, 0.00, 80, 0.00, 0, 1), (-0.5, 260, 0.01, 5, 0.00, 5, 0.00, 0, 1),
    (-0.5, 8, 0.00, 3, 1.00, 90, 0.00, 1, 1), (-0.5, 55, 0.00, 9, 0.00, 3, 1.00, 0, 1), (-0.5, 6, 0.00, 75, 0.00, 60, 0.00, 1, 1),
    (-0.5, 20, 0.00, 90, 0.00, 0, 0.00, 0, 0), (-0.5, 8, 0.00, 1, 1.00, 11, 0.00, 0, 0), (-0.5, 4, 0.00, 30, 0.00, 2, 0.50, 0, 0),
    (-0.5, 15, 0.40, 200, 0.00, 3, 1.00, 0, 0), (-0.5, 16, 0.00, 10, 0.00, 10, 0.00, 0, 0), (-0.5, 1, 1.00, 1, 1.00, 1, 1.00, 0, 0),
    (-0.5, 3, 0.00, 1, 0.00, 1, 0.00, 1, 0), (-0.5, 80, 0.85, 40, 0.90, 60, 0.80, 0, 0), (-0.5, 12, 0.00, 8, 0.00, 4, 0.00, 0, 0),
    # nothing said: judged by words and links of the block and its neighbours
    (0, 80, 0.00, 60, 0.00, 75, 0.00, 0, 1), (0, 35, 0.05, 80, 0.00, 40, 0.00, 0, 1), (0, 22, 0.00, 50, 0.00, 60, 0.10, 0, 1),
    (0, 6, 0.00, 70, 0.00, 55, 0.00, 0, 1), (0, 9, 0.00, 1, 1.00, 70, 0.00, 1, 1), (0, 5, 0.00, 40, 0.00, 45, 0.00, 1, 1),
    (0, 18, 0.10, 45, 0.05, 30, 0.00, 0, 1), (0, 120, 0.00, 2, 1.00, 3, 1.00, 0, 1), (0, 3, 0.00, 30, 0.00, 28, 0.00, 0, 1),
    (0, 45, 0.00, 60, 0.00, 5, 0.00, 0, 1), (0, 70, 0.00, 5, 0.00, 2, 1.00, 0, 1), (0, 60, 0.00, 2, 1.00, 45, 0.00, 0, 1),
    (0, 30, 0.00, 5, 0.00, 6, 0.00, 0, 1), (0, 55, 0.00, 20, 0.00, 0, 0.00, 0, 1), (0, 90, 0.02, 0, 0.00, 0, 0.00, 0, 1),
    (0, 40, 0.00, 30, 0.00, 10, 0.00, 0, 1), (0, 28, 0.00, 12, 0.00, 9, 0.00, 0, 1), (0, 50, 0.00, 10, 0.00, 11, 0.00, 0, 1),
    (0, 2, 1.00, 2, 1.00, 2, 1.00, 0, 0), (0, 1, 1.00, 0, 0.00, 3, 1.00, 0, 0), (0, 4, 0.00, 2, 1.00, 3, 1.00, 0, 0),
    (0, 7, 0.90, 60, 0.00, 5, 1.00, 0, 0), (0, 12, 0.75, 8, 0.80, 9, 1.00, 0, 0), (0, 5, 0.00, 4, 0.90, 0, 0.00, 0, 0),
    (0, 3, 0.50, 2, 0.80, 4, 0.00, 0, 0), (0, 9, 0.60, 3, 1.00, 90, 0.00, 0, 0), (0, 4, 0.00, 3, 0.00, 4, 0.00, 0, 0),
    (0, 6, 0.00, 5, 0.50, 3, 0.00, 0, 0), (0, 25, 0.60, 10, 0.90, 12, 0.90, 0, 0), (0, 40, 0.80, 60, 0.00, 70, 0.00, 0, 0),
)


def grow(rows: np.ndarray, depth: int = 6) -> float | tuple:
    """A decision tree over rows of features and label: (feature, limit, at most, above), or a leaf's share of ones.

    Splits lower the Gini impurity most; ties go to the first feature and the least limit.
    """
    labels = rows[:, -1]
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(rows.shape[1] - 1):
        values = np.unique(rows[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            low = labels[rows[:, f] <= limit]
            high = labels[rows[:, f] > limit]
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (low, high))
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(limit)
    if best is None or best[0] >= len(labels) * share * (1 - share) - 1e-12:
        return share
    below = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow(rows[below], depth - 1), grow(rows[~below], depth - 1)


def keep(tree: float | tuple, features: tuple) -> bool:
    while isinstance(tree, tuple):
        feature, limit, low, high = tree
        tree = low if features[feature] <= limit else high
    return tree >= 0.5


def main_text(page: str, tree: float | tuple) -> str:
    """Blocks that the tree keeps, in page order, with an empty line between."""
    blocks = blocks_of(page)
    none = Block("", 0, 0, NOWHERE, False)
    kept = []
    for i, b in enumerate(blocks):
        before, after = blocks[i - 1] if i else none, blocks[i + 1] if i + 1 < len(blocks) else none
        if keep(tree, (b.zone, b.words, b.density, before.words, before.density, after.words, after.density, int(b.heading))):
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """``pages`` without its source, with the main text of each whole page as ``text`` and its code points as ``n_chars``.

    Null, empty and textless pages give the empty text. Columns of these two names are replaced,
    others stay; repeated rows stay repeated.
    """
    ship_package(pages.sparkSession)
    tree = grow(np.array(TRAINING, float))
    kept = [f for f in pages.schema.fields if f.name not in (source, name, "n_chars")]
    schema = T.StructType([*kept, T.StructField(name, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py() or "", tree) for x in batch.column(source)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())],
                [*(f.name for f in kept), name, "n_chars"],
            )

    return texts(pages, *(f"`{f.name}`" for f in kept), f"`{source}`").mapInArrow(run, schema)
