"""Main text of HTML pages by a linear-chain conditional random field over the DOM's leaf blocks.

A page is cut into blocks: runs of text that no block element interrupts, each with the elements open
around it. A field with the states main and other, trained on labelled pages, scores every block by its
ancestors (their tags and the words of their class, id and role) and its text, and neighbouring blocks by
learned transitions; Viterbi finds the best sequence. The blocks in state main are the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import html_pages
from tickloom.llm.common import map_rows
from tickloom.llm.crf import slopes, viterbi

#: Elements that end a run of text, elements that hold no element, and elements whose content is no text of the page.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style".split())
SILENT_TAGS = RAW_TAGS | frozenset("template noscript textarea title iframe svg noembed noframes xmp".split())
#: What an opening tag closes if it is still open, up to the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
CLOSES_P = BLOCK_TAGS - {"option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "head", "html", "legend"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
OTHER, MAIN = 0, 1


@dataclass
class Block:
    """text: with white space made single; path: the block elements around it, outermost first, each (tag, names)."""

    text: str
    path: tuple
    linked: int


@lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, ...]:
    """The lower-case words in an element's class, id and role; camel case counts as several."""
    if "=" not in attributes:
        return ()
    found = " ".join("".join(m) for m in _NAMES.findall(attributes))
    found = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", found)
    return tuple(sorted({w.lower() for w in _PARTS.findall(found)}))


class _Scanner:
    """Finds markup in one pass: what proves to be missing behind some place is not sought again behind later ones."""

    def __init__(self, html: str):
        self.html = html
        self.dead: set[int] = set()  # quotes from which no end of a tag is reached
        self.unclosed: set[str] = set()
        self.skip = 0  # where to go on behind content that is hidden

    def markup(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """Start, end, tag ('' for comments and declarations), whether it closes, attributes."""
        html, at = self.html, 0
        while (start := html.find("<", at)) >= 0:
            at = start + 1
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(html)
                yield start, at, "", False, ""
            elif html.startswith(("<!", "<?"), start):
                end = html.find(">", start)
                if end < 0:
                    return
                at = end + 1
                yield start, at, "", False, ""
            elif found := _TAG.match(html, start):
                at = self._tag_end(found.end())
                if at < 0:
                    return  # no tag ends from here on
                yield start, at, found[2].lower(), found[1] == "/", html[found.end() : at - 1]
                at = max(at, self.skip)

    def _tag_end(self, at: int) -> int:
        """Behind the first > outside of quotes, or else behind the first; -1 if there is none."""
        html, place, opened = self.html, at, []
        while (special := _SPECIAL.search(html, place)) and special.start() not in self.dead:
            if special[0] == ">":
                return special.end()
            opened.append(special.start())
            place = html.find(special[0], special.end()) + 1
            if not place:
                break
        self.dead.update(opened)
        return html.find(">", at) + 1 or -1

    def element_end(self, tag: str, at: int) -> int:
        """Behind the end tag of the element, or -1."""
        if tag in self.unclosed:
            return -1
        found = _end_tag(tag).search(self.html, at)
        end = self.html.find(">", found.end()) if found else -1
        if end < 0:
            self.unclosed.add(tag)
        return end + 1 or -1


@cache
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page, in order, in time that grows with its length. Broken markup is read as far as it goes; null has none.

    An element whose content is no text hides it up to its end tag; without one, a script or style hides the
    rest of the page, as browsers have it, and any other hides nothing.
    """
    if not html:
        return []
    out: list[Block] = []
    path: list[tuple[str, tuple]] = []
    text: list[str] = []
    in_link = linked = 0
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal text, linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, tuple(path), min(linked, len(whole))))
            text, linked = [], 0

    scanner = _Scanner(html)
    for start, end, tag, closing, attributes in scanner.markup():
        if start > at:
            text.append(html[at:start])
            if in_link:
                linked += start - at
        at = end
        if not tag:
            continue
        if tag in SILENT_TAGS:
            if not closing and not attributes.endswith("/"):
                after = scanner.element_end(tag, at)
                at = scanner.skip = after if after > 0 else n if tag in RAW_TAGS else at
            text.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            if not closing:
                if tag in CLOSES_P:
                    _close(path, {"p"}, {"article", "section", "div", "td", "li", "body"})
                if tag in CLOSES:
                    _close(path, *CLOSES[tag])
                if tag not in VOID_TAGS:
                    path.append((tag, _names(attributes)))
            elif any(t == tag for t, _ in path):
                while path.pop()[0] != tag:
                    pass
            in_link = 0
        elif tag == "a":
            in_link = int(not closing)
        elif tag in ("br", "img", "input", "button", "label"):
            text.append(" ")
    if at < n:
        text.append(html[at:])
    flush()
    return out


def _close(path: list, tags: set, stop: set) -> None:
    """Close the innermost element of `tags`, with all in it, unless one of `stop` stands between."""
    for i in range(len(path) - 1, -1, -1):
        if path[i][0] in tags:
            del path[i:]
            return
        if path[i][0] in stop:
            return


def _bucket(n: float, *edges: float) -> int:
    return sum(n >= e for e in edges)


@lru_cache(maxsize=8192)
def _path_features(path: tuple) -> tuple[str, ...]:
    found = {f"own={path[-1][0]}" if path else "own="}
    for tag, names in path:
        found.add(f"in={tag}")
        found.update(f"name={w}" for w in names)
    if path:
        found.update(f"near={w}" for w in path[-1][1])
    if len(path) > 1:
        found.add(f"under={path[-2][0]}")
    return tuple(sorted(found))


def features(own: list[Block]) -> list[list[str]]:
    """Feature names of each block of a page: its ancestors', its text's, and where it stands."""
    out = []
    for i, b in enumerate(own):
        n = len(b.text)
        words = b.text.count(" ") + 1
        last = b.text[-1]
        out.append([
            *_path_features(b.path),
            f"words={_bucket(words, 2, 4, 7, 12, 25, 60)}",
            f"linked={_bucket(b.linked / n, 0.01, 0.3, 0.7)}",
            f"end={last if last in '.?!:' else 'x'}",
            f"stops={_bucket(b.text.count('. '), 1, 3, 6)}",
            f"mark={'©' in b.text[:40]}",
            f"digits={_bucket(sum(map(str.isdigit, b.text[:40])), 1, 6)}",
            f"place={_bucket(i / len(own), 0.001, 0.15, 0.5, 0.85)}",
            f"last={len(own) - 1 - i if len(own) - 1 - i < 2 else 'x'}",
        ])
    return out


@dataclass
class Model:
    weights: dict[str, tuple[float, float]]
    transitions: np.ndarray
    first: np.ndarray

    def states(self, own: list[Block]) -> list[int]:
        get, none = self.weights.get, (0.0, 0.0)
        score = np.array([[sum(x) for x in zip(*(get(f, none) for f in names))] for names in features(own)]).reshape(-1, 2)
        return viterbi(score, self.transitions, self.first)

    def text(self, html: str | None) -> str:
        own = blocks(html)
        return "\n".join(b.text for b, s in zip(own, self.states(own)) if s == MAIN)


def fit(labelled: list[tuple[str, list[int]]], epochs: int = 30, rate: float = 0.2, decay: float = 2e-4, batch: int = 64, dropped: float = 0.15) -> Model:
    """Train on (html, labels of its blocks) by the gradient of the conditional likelihood.

    Features are dropped at random while training, so that none is leaned on alone.
    """
    random = np.random.default_rng(5)
    sequences = []
    number: dict[str, int] = {}
    for html, labels in labelled:
        own = blocks(html)
        if len(own) != len(labels):
            raise ValueError(f"{len(own)} blocks and {len(labels)} labels")
        if own:
            sequences.append(([[number.setdefault(f, len(number)) for f in names] for names in features(own)], labels))
    weights, speed = np.zeros((len(number), 2)), np.full((len(number), 2), 1e-6)
    move, first = np.zeros((2, 2)), np.zeros(2)
    move_speed, first_speed = np.full((2, 2), 1e-6), np.full(2, 1e-6)
    for _ in range(epochs):
        order = random.permutation(len(sequences))
        for a in range(0, len(order), batch):
            chosen = [sequences[i] for i in order[a : a + batch]]
            longest = max(len(tags) for _, tags in chosen)
            there = np.array([[t < len(tags) for t in range(longest)] for _, tags in chosen])
            tags = np.array([[*tags, *[0] * (longest - len(tags))] for _, tags in chosen])
            cell, feature = np.array([(i * longest + t, f) for i, (rows, _) in enumerate(chosen) for t, names in enumerate(rows) for f in names]).T
            stay = random.random(len(cell)) >= dropped
            cell, feature = cell[stay], feature[stay]
            score = np.stack([np.bincount(cell, weights[feature, k], minlength=tags.size) for k in (0, 1)], axis=1).reshape(*tags.shape, 2)
            slope, slope_move, slope_first = slopes(score, tags, move, first, there)
            flat = slope.reshape(-1, 2)
            step = np.stack([np.bincount(feature, flat[cell, k], minlength=len(number)) for k in (0, 1)], axis=1) / len(chosen) - decay * weights
            for value, pace, turn in ((weights, speed, step), (move, move_speed, slope_move / len(chosen)), (first, first_speed, slope_first / len(chosen))):
                pace += turn**2
                value += rate * turn / np.sqrt(pace)
    return Model({f: (float(weights[i, 0]), float(weights[i, 1])) for f, i in number.items()}, move, first)


@lru_cache(maxsize=2)
def trained(n_pages: int = 500) -> Model:
    """The field trained on n_pages of the labelled pages made in html_pages; the same every time."""
    return fit(html_pages.pages(n_pages))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null or blank html gives an empty text. Rows that repeat are treated alike. An empty table gives an
    empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def of(part: pa.RecordBatch) -> dict:
        own = shared.value
        found = [own.text(h) for h in part.column("html").to_pylist()]
        return {"page_id": part.column("page_id"), "url": part.column("url"), "text": found, "n_chars": list(map(len, found))}

    return map_rows(rows, "html", of, "page_id long, url string, text string, n_chars long")


def extract_blocks(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, blocks, main (1 or 0 for each block) of every row: what the field decides, block by block."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def of(part: pa.RecordBatch) -> dict:
        cut = [blocks(h) for h in part.column("html").to_pylist()]
        return {"page_id": part.column("page_id"), "blocks": [[b.text for b in own] for own in cut], "main": [shared.value.states(own) for own in cut]}

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")), "html", of, "page_id long, blocks array<string>, main array<int>")
