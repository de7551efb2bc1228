"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text at its block-level tags. A block's features are its word count and link
density, those of the block before and after it, and whether the page marks its surroundings as boilerplate
(menus, headers, footers, notices, adverts, forms, comments, hidden parts) or as the main part. A decision tree
trained on the small labelled table below says which blocks are kept.

A class, id or role marks boilerplate only as a whole name (`sidebar`, `site-footer`, `comment-list`; not `has-sidebar`
or `content-with-ads`). A main part inside a form or inside other such names isn't marked by them, except inside
menus, asides, comments, related parts and what is hidden; nor does a form mark what it holds if that is most of the page's words.

Defined results: null and empty pages, and pages whose blocks are all boilerplate, give the empty text; markup that
breaks off is read as far as it goes; character references are decoded as in HTML; white space (also no-break
space) inside a block is one space; `br` is white space; repeated rows each get a row; other columns pass through,
and output columns replace columns of their name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import chunks, small_batches

#: Fixed values of HTML.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript".split())
UNSEEN = set("head title template textarea select option button object svg math canvas audio video map datalist".split())
ENDS_P = BLOCK - {"body", "html", "head", "title", "td", "th", "tr", "caption", "legend", "option", "optgroup"}
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "a": {"a"}}
#: Tags that mark boilerplate and main parts.
AROUND = set("nav footer aside menu dialog".split())
MAIN = set("article main".split())
#: Words that name boilerplate in a class, id or role; those of FIRM also where a main part lies inside.
FIRM = set("comment comments commentlist respond discussion disqus replies reply related recommended recommendations nav navbar navigation menu menubar breadcrumb breadcrumbs footer hidden".split())
AROUND_WORDS = FIRM | set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner sidebar widget widgets masthead toolbar share sharing social newsletter subscribe "
    "subscription signup login cookie cookies consent gdpr notice notices notification popup modal overlay alert disclaimer copyright pagination pager skip search searchbox contentinfo complementary".split()
)
HEAD_WORDS = {"header", "topbar", "siteheader"}
#: Words that may stand before and after them in a name.
BEFORE = set("site page global top bottom left right main post article entry block section mobile sticky".split())
AFTER = set("wrapper wrap container box block section area list item items inner outer left right top bottom bar panel unit slot group holder module content text links link icons icon buttons button form posts articles stories thread".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "around", "main")
#: The labelled table: features as above, then 1 for main text.
LABELLED = [
    # blocks of the main part: headings, paragraphs long and short, with some links, first and last ones beside menus
    (10, 0.0, 6, 0.0, 60, 0.0, 0, 1, 1), (3, 0.0, 6, 1.0, 40, 0.0, 0, 1, 1), (80, 0.0, 10, 0.0, 70, 0.0, 0, 1, 1), (120, 0.05, 80, 0.0, 90, 0.0, 0, 1, 1),
    (5, 0.0, 90, 0.0, 60, 0.0, 0, 1, 1), (2, 0.0, 70, 0.0, 14, 0.0, 0, 1, 1), (40, 0.3, 50, 0.0, 2, 0.0, 0, 1, 1), (1, 0.0, 30, 0.0, 12, 0.1, 0, 1, 1),
    (9, 0.0, 3, 1.0, 5, 0.0, 0, 1, 1), (25, 0.6, 60, 0.0, 60, 0.0, 0, 1, 1), (6, 1.0, 60, 0.0, 60, 0.0, 0, 1, 1), (300, 0.0, 4, 0.0, 11, 0.0, 0, 1, 1),
    (4, 0.0, 4, 0.0, 4, 0.0, 0, 1, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1), (7, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (15, 0.0, 8, 0.0, 9, 0.3, 0, 1, 1),
    (200, 0.0, 60, 0.0, 2, 1.0, 0, 1, 1), (50, 0.0, 60, 0.0, 3, 1.0, 0, 1, 1), (12, 0.0, 60, 0.0, 1, 1.0, 0, 1, 1), (3, 0.0, 40, 0.0, 1, 1.0, 0, 1, 1),
    (90, 0.0, 2, 1.0, 3, 1.0, 0, 1, 1), (5, 0.0, 1, 1.0, 4, 1.0, 0, 1, 1), (1, 0.0, 2, 1.0, 2, 1.0, 0, 1, 1), (30, 0.4, 2, 1.0, 2, 1.0, 0, 1, 1),
    (8, 1.0, 50, 0.0, 2, 0.0, 0, 1, 1), (2, 1.0, 30, 0.1, 40, 0.0, 0, 1, 1), (14, 0.8, 20, 0.0, 30, 0.0, 0, 1, 1), (35, 0.9, 70, 0.0, 90, 0.0, 0, 1, 1),
    # lists of links, also in the main part
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0), (4, 1.0, 3, 1.0, 5, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (6, 1.0, 60, 0.0, 4, 1.0, 0, 1, 0),
    (3, 1.0, 4, 1.0, 50, 0.0, 0, 1, 0), (12, 0.9, 9, 1.0, 11, 1.0, 0, 1, 0), (5, 0.9, 8, 0.9, 2, 0.0, 0, 1, 0), (2, 1.0, 0, 0.0, 3, 1.0, 0, 1, 0),
    # marked surroundings, whatever their text
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), (6, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0), (12, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0),
    (60, 0.0, 12, 0.0, 10, 0.0, 1, 0, 0), (150, 0.0, 80, 0.0, 20, 0.0, 1, 0, 0), (30, 0.1, 5, 0.0, 40, 0.0, 1, 1, 0), (8, 0.0, 50, 0.0, 30, 0.0, 1, 1, 0),
    (45, 0.0, 120, 0.0, 0, 0.0, 1, 1, 0), (3, 0.0, 3, 0.0, 3, 0.0, 1, 0, 0), (20, 0.5, 2, 0.0, 6, 1.0, 1, 0, 0), (90, 0.0, 90, 0.0, 90, 0.0, 1, 1, 0),
    (250, 0.0, 60, 0.0, 80, 0.0, 1, 1, 0), (25, 0.0, 20, 0.0, 60, 0.0, 1, 0, 0), (18, 0.0, 70, 0.0, 60, 0.0, 1, 1, 0), (5, 0.0, 60, 0.0, 70, 0.0, 1, 1, 0),
    # pages that mark nothing: long texts with few links whatever stands beside them, headings before them
    (60, 0.0, 3, 1.0, 70, 0.0, 0, 0, 1), (35, 0.0, 5, 0.0, 40, 0.0, 0, 0, 1), (110, 0.1, 60, 0.0, 3, 0.0, 0, 0, 1), (25, 0.05, 40, 0.0, 60, 0.0, 0, 0, 1),
    (18, 0.0, 30, 0.0, 30, 0.0, 0, 0, 1), (8, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1), (5, 0.0, 50, 0.0, 45, 0.0, 0, 0, 1), (9, 0.0, 80, 0.0, 35, 0.0, 0, 0, 1),
    (3, 0.0, 40, 0.1, 60, 0.0, 0, 0, 1), (22, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (12, 0.0, 4, 0.0, 90, 0.0, 0, 0, 1), (50, 0.2, 2, 0.0, 4, 0.0, 0, 0, 1),
    (51, 0.0, 60, 0.0, 6, 1.0, 0, 0, 1), (200, 0.0, 80, 0.0, 2, 1.0, 0, 0, 1), (24, 0.0, 30, 0.0, 1, 1.0, 0, 0, 1), (45, 0.3, 3, 1.0, 3, 1.0, 0, 0, 1),
    (30, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1), (17, 0.1, 60, 0.0, 2, 1.0, 0, 0, 1), (4, 0.0, 0, 0.0, 30, 0.0, 0, 0, 1), (20, 0.0, 60, 0.0, 4, 0.0, 0, 0, 1),
    # and what stands between them
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0), (3, 0.0, 2, 1.0, 4, 0.0, 0, 0, 0), (5, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0), (7, 0.0, 70, 0.0, 3, 0.0, 0, 0, 0),
    (9, 0.4, 50, 0.0, 0, 0.0, 0, 0, 0), (30, 0.9, 5, 1.0, 20, 0.9, 0, 0, 0), (15, 0.7, 60, 0.0, 10, 1.0, 0, 0, 0), (4, 1.0, 60, 0.0, 5, 1.0, 0, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (10, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0), (6, 0.0, 8, 0.0, 0, 0.0, 0, 0, 0), (40, 0.8, 3, 0.0, 3, 1.0, 0, 0, 0),
    (5, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0), (2, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0), (3, 1.0, 3, 1.0, 60, 0.0, 0, 0, 0), (8, 0.8, 2, 1.0, 80, 0.0, 0, 0, 0),
    (60, 0.9, 30, 0.0, 40, 0.0, 0, 0, 0), (4, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), (12, 0.6, 6, 1.0, 5, 0.0, 0, 0, 0), (2, 1.0, 70, 0.0, 60, 0.0, 0, 0, 0),
]


@dataclass
class Block:
    """around and main: what marks it; form: the number of the form that holds it, 0 for none."""

    text: str
    words: int
    links: float
    around: bool
    main: bool
    form: int = 0


def _named(names: str) -> set[str]:
    """The boilerplate words of the names in a class, id or role: of each name that consists of such words, and words that go with them."""
    out: set[str] = set()
    for name in names.split():
        parts = [x.lower() for x in CAMEL.findall(name)]
        if parts and (parts[0] in AROUND_WORDS or parts[0] in HEAD_WORDS or parts[0] in BEFORE) and all(x in AROUND_WORDS or x in HEAD_WORDS or x in AFTER or x.isdigit() for x in parts[1:]):
            out.update(parts)
    return out & (AROUND_WORDS | HEAD_WORDS)


#: How an element marks what it holds: not, until a main part begins, or in any case.
FREE, LOOSE, FIRMLY = range(3)


def _marks(tag: str, attributes: str, in_main: bool) -> tuple[int, bool]:
    """Whether an element is boilerplate, and whether it is a main part."""
    around, main = FIRMLY if tag in AROUND or (tag == "form" and in_main) else LOOSE if tag == "header" and not in_main else FREE, tag in MAIN
    if "=" in attributes or "hidden" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                around = FIRMLY
            elif name in ("class", "id", "role"):
                found = _named(value)
                if found & FIRM or (found & AROUND_WORDS and in_main):
                    around = FIRMLY
                elif found & AROUND_WORDS or (found and not in_main and tag not in ("h1", "h2", "h3")):
                    around = max(around, LOOSE)
                if name == "role" and value.lower() in ("main", "article"):
                    main = True
    return FREE if tag in ("html", "body") else around, main


def cut(page: str) -> list[Block]:
    """The flat text blocks of a page, in its order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, int, bool, bool, int]] = []  # tag, around, main, unseen, form: each with what holds it
    around, main, unseen, form, forms = FREE, False, False, 0, 0
    links = 0

    def end() -> None:
        nonlocal parts, linked
        if parts:
            words = "".join(parts).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), around > FREE, main, form))
            parts, linked = [], 0

    def text(s: str) -> None:
        nonlocal linked
        if s and not unseen:
            s = entities.unescape(s)
            parts.append(s)
            if links:
                linked += len(s.split())

    def settle() -> None:
        nonlocal around, main, unseen, form, links
        _, around, main, unseen, form = stack[-1] if stack else ("", FREE, False, False, 0)
        links = sum(t[0] == "a" for t in stack)

    def close(tags: set[str], stop: set[str]) -> None:
        """Take the innermost of tags and what it holds from the stack, looking no further out than stop."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                if any(t[0] in BLOCK for t in stack[i:]):
                    end()
                del stack[i:]
                settle()
                return
            if stack[i][0] in stop:
                return

    at = 0
    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                end()
            close({tag}, {"table"} if tag not in ("table", "article", "main", "body", "html") else set())
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(page, at)
            at = stop.start() if stop else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            end()
        if tag in ENDS_P:
            close({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            close(CLOSES[tag], {"ul", "ol", "dl", "table", "select", "menu"} if tag != "a" else BLOCK)
        if tag in VOID or m[3].endswith("/>"):
            continue
        a, b = _marks(tag, m[3], main)
        if a > around and tag not in BLOCK:
            end()
        if b and around < FIRMLY:
            around, form = FREE, 0
        if tag == "form" and not form and not main:
            forms += 1
            form = forms
        around, main, unseen = max(around, a), main or b, unseen or tag in UNSEEN
        stack.append((tag, around, main, unseen, form))
        links += tag == "a"
    text(page[at:] if "<" not in page[at:] or not re.match(r"<[/!?a-zA-Z]", page[at:]) else "")
    end()
    # a form marks what it holds, unless that is most of what nothing else marks
    held = [0] * (forms + 1)
    for x in out:
        held[x.form] += x.words * (not x.around)
    for x in out:
        x.around = x.around or (x.form > 0 and 2 * held[x.form] <= sum(held))
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block of a page."""
    own = np.array([[b.words, b.links] for b in blocks], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    flags = np.array([[b.around, b.main] for b in blocks], float).reshape(-1, 2)
    return np.hstack([own, np.vstack([none, own[:-1]]) if len(own) else own, np.vstack([own[1:], none]) if len(own) else own, flags])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple | int:
    """A decision tree by Gini impurity: (feature, threshold, low branch, high branch), or a class."""
    if not depth or y.min() == y.max():
        return int(2 * y.sum() > len(y))
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = y[x[:, f] < t]
            high = y[x[:, f] >= t]
            impurity = sum(2 * len(p) * p.mean() * (1 - p.mean()) for p in (low, high))
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(t))
    if best[0] == np.inf:
        return int(2 * y.sum() > len(y))
    _, f, t = best
    side = x[:, f] < t
    return f, t, grow(x[side], y[side], depth - 1), grow(x[~side], y[~side], depth - 1)


def classify(tree: tuple | int, x: np.ndarray) -> np.ndarray:
    """The class of each row."""
    if isinstance(tree, int):
        return np.full(len(x), tree)
    f, t, low, high = tree
    side = x[:, f] < t
    out = np.empty(len(x), int)
    out[side], out[~side] = classify(low, x[side]), classify(high, x[~side])
    return out


def train(labelled: list[tuple] = LABELLED) -> tuple | int:
    """The tree of a labelled table (FEATURES, then the class)."""
    rows = np.array(labelled, float)
    return grow(rows[:, :-1], rows[:, -1])


def main_text(tree: tuple | int, page: str | None) -> str:
    """The kept blocks of a page, joined by an empty line."""
    blocks = cut(page or "")
    if not blocks:
        return ""
    keep = classify(tree, features(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(df: DataFrame, html: str = "html", text: str = "text", keep_html: bool = False, batch_bytes: int = 4 << 20) -> DataFrame:
    """df with the column text: each page's main text."""
    small_batches(df.sparkSession)
    tree = train()
    kept = [c for c in df.columns if c != text and (keep_html or c != html)]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(text, T.StringType())])
    # the page goes first under a name of its own, so that it may be left out and may have the output's name
    page = "_page"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, page, batch_bytes):
            for b in table.to_batches():
                made = pa.array([main_text(tree, x) for x in b.column(page).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], made], schema.names)

    return df.select(F.col(html).alias(page), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
