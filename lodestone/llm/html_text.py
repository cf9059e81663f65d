"""Operator 9: main text of web pages as the maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?[A-Za-z][^\s/>]*(?:\s*(?:[^\s=>\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?|[\"']|/))*\s*>|[^<]+|<", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
MARK = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
# What elements are.
RAW = frozenset("script style textarea title noscript template iframe svg math object select option button head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option".split())  # may stay open
ROOTS = frozenset("article main".split())
FRAMES = frozenset("nav footer aside form dialog menu header".split())
TAGS = frozenset("article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption header br hr a b i em strong span code img".split())
CONTEXTS = ("plain", "link", "item", "heading", "cell")
# Words of class, id and role that name what surrounds an article, before any page is seen, and words that say nothing.
AROUND = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice popup modal newsletter subscribe signup share sharing social related recommended comment comments replies reply respond disqus pagination pager login search toolbar complementary contentinfo".split())
EMPTY = frozenset("list item items box block wrap wrapper container section area inner outer holder row col column left right top bottom bar buttons button links link post posts form group panel text body title site page global primary secondary main".split())

SAMPLE = 20_000  #: labelled pages that weights are learned from, about
LEAST_PAGES = 5  #: pages that must have a class word for it to count
MOST_WORDS = 5_000  #: class words that are learned, those on most pages
SURE = 2.5  #: log odds from which an element is taken for a part of the article, or for what surrounds it
OUTSIDE = 4.0  #: what a word inside such an element costs at least


@dataclass
class Segment:
    """Words of one block and the tags before them, with where they stand."""

    text: str
    tags: list[str]
    context: str
    new_block: bool
    labelled: bool
    outside: float  #: log odds of the element around it that least looks like an article's, 0 if none is below
    marks: tuple[str, ...]  #: elements and class words around it
    root: int  #: innermost article or main element, -1 for none


@dataclass
class Root:
    """An article or main element: the one around it, its first segment and the one after its last."""

    above: int
    first: int
    last: int = -1


def names(marks: str) -> list[str]:
    """The names in class, id and role attributes, each as its parts: words that say nothing are left out."""
    return [x for x in ("-".join(w for w in re.split(r"[\W_\d]+", name.lower()) if w and w not in EMPTY) for name in marks.split()) if x]


def odds(name: str, weight: dict[str, float]) -> float:
    """Log odds that an element of this class name belongs to an article: of the whole name if learned, else the mean of its words where that is sure."""
    whole = weight.get(f"mark {name}")
    if whole is not None:
        return whole
    parts = name.split("-")
    mean = sum(weight.get(f"mark {w}", -OUTSIDE if w in AROUND else 0.0) for w in parts) / len(parts)
    return mean if mean <= -SURE else 0.0


def closings(page: str) -> tuple[list[re.Match], set[int]]:
    """The page's tokens, and which of its start tags have an end tag of their own."""
    tokens, closed, stack, open_ = [], set(), [], defaultdict(list)
    at, n = 0, len(page)
    for token in TOKEN.finditer(page):
        if token.start() < at:
            continue
        tokens.append(token)
        found = NAME.match(token[0]) if token[0][0] == "<" else None
        if not found:
            continue
        name = found[1].lower()
        if token[0][1] == "/":
            if open_[name]:
                closed.add(stack[open_[name][-1]][1])
                while True:
                    last, _ = stack.pop()
                    open_[last].pop()
                    if last == name:
                        break
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, token.end())
            at = end.end() if end else (n if name in ("script", "style") else token.end())
        elif name not in VOID and not token[0].endswith("/>"):
            open_[name].append(len(stack))
            stack.append((name, token.start()))
    return tokens, closed


def parse(page: str, weight: dict[str, float]) -> tuple[list[Segment], list[Root]]:
    """Segments in page order, with what is around each."""
    tokens, closed = closings(page)
    out: list[Segment] = []
    roots: list[Root] = []
    tags: list[str] = []
    stack: list[tuple[str, float, tuple[str, ...], int, bool]] = []  # name, odds, marks, root above, whether it closes
    open_: dict[str, list[int]] = defaultdict(list)
    outside: list[float] = []
    root, block, labelled = -1, True, 0
    link = item = heading = cell = 0

    def pop() -> None:
        nonlocal root, labelled
        name, own, _, above, _ = stack.pop()
        open_[name].pop()
        if own < 0:
            outside.pop()
        if name in ROOTS:
            roots[root].last = len(out)
            root = above
            labelled -= 1

    def add(text: str, context: str, around: tuple[str, ...]) -> None:
        nonlocal tags, block
        out.append(Segment(text, tags, context, block, labelled > 0, min(outside, default=0.0), around, root))
        tags, block = [], False

    def around() -> tuple[str, ...]:
        return tuple(m for x in stack for m in x[2])

    for token in tokens:
        piece = token[0]
        if piece[0] != "<" or piece == "<":
            add(piece, "link" if link else "heading" if heading else "item" if item else "cell" if cell else "plain", around())
            continue
        found = NAME.match(piece)
        if not found:
            if piece.startswith("<![CDATA["):
                add(html.escape(piece[9:-3]), "plain", around())
            continue
        name, close = found[1].lower(), piece[1] == "/"
        if name in RAW:
            block = block or name not in INLINE
            continue
        if close:
            if open_[name]:
                while len(stack) > open_[name][-1] + 1:
                    pop()
                pop()
        elif name not in VOID and not piece.endswith("/>"):
            if name in ROOTS:
                # What surrounds an article and never closes ends where the article begins.
                while any(x[1] <= -SURE and not x[4] for x in stack):
                    pop()
            marks = names(" ".join(x.strip("\"'") for x in MARK.findall(piece))) if "=" in piece and name not in ("body", "html") else []
            worst = min((odds(x, weight) for x in marks), default=0.0)
            if worst > -SURE:
                worst = min(worst, 0.0 if name == "header" and root >= 0 else weight.get(f"element {name}", OUTSIDE * ((name in ROOTS) - (name in FRAMES))))
            if marks or name not in LOOSE and name not in INLINE:
                own = tuple(f"mark {x}" for x in marks) if marks else (f"element {name}",) if name in ROOTS | FRAMES else ()
                open_[name].append(len(stack))
                stack.append((name, worst, own, root, token.start() in closed))
                if worst < 0:
                    outside.append(worst)
                if name in ROOTS:
                    roots.append(Root(root, len(out)))
                    root = len(roots) - 1
                    labelled += 1
        step = -1 if close else 1
        if name == "a":
            link = max(0, min(1, link + step))
        elif name == "li":
            item = 0 if close else 1
        elif name in ("td", "th"):
            cell = 0 if close else 1
        elif len(name) == 2 and name[0] == "h" and name[1].isdigit():
            heading = 0 if close else 1
        if name == "br":
            add(" ", "plain", ())
        elif name not in INLINE:
            block = True
        tags.append(name if name in TAGS else "other")
    while stack:
        pop()
    return out, roots


#: Weights where no labelled page has a say: of a word by its context, of a tag by its name.
DEFAULT = {"word plain": 1.0, "word heading": 1.0, "word item": 0.4, "word cell": 0.4, "word link": -0.3} | {f"tag {t}": -0.2 for t in TAGS | {"other"}}


def count(page: str) -> Counter:
    """Words by context, tags, and pages by element and class word, within and outside of the article that a page marks."""
    segments, roots = parse(page, {})
    out: Counter = Counter()
    if roots:
        seen = set()
        for s in segments:
            inside = s.labelled and s.outside > -SURE
            side = "in" if inside else "out"
            words = len(s.text.split())
            out[f"word {s.context}", side] += words
            for t in s.tags:
                out[f"tag {t}", side] += 1
            if words:
                seen |= {(m, side) for m in s.marks}
                seen |= {(f"mark {w}", side) for m in s.marks if m.startswith("mark ") and "-" in m for w in m[5:].split("-")}
        # An element around the whole article is no part of it.
        out.update(x for x in seen if x[1] == "out" or (x[0], "out") not in seen)
    return out


def weights(rows: list[tuple[str, int, int]]) -> dict[str, float]:
    """Log odds of the inside: of words within [-2, 2] and of tags below 0, against a default of 20 words; of elements and class words against 5 pages of what they are known for."""
    out = dict(DEFAULT)
    for feature, inside, outside in rows:
        kind, _, name = feature.partition(" ")
        if kind in ("mark", "element"):
            prior = (5.0, 0.1) if name in ROOTS else (0.1, 5.0) if name in AROUND or name in FRAMES else (5.0, 5.0)
            out[feature] = math.log((inside + prior[0]) / (outside + prior[1]))
            continue
        ratio = math.log((inside + 20 * (DEFAULT.get(feature, 0) > 0) + 1) / (outside + 1))
        out[feature] = max(-2.0, min(2.0, ratio)) if kind == "word" else max(-3.0, min(-0.05, -0.2 + ratio / 20 if ratio > 0 else -0.2 + ratio / 2))
    return out


def best_run(segments: list[Segment], weight: dict[str, float]) -> tuple[int, int]:
    """First and one after the last segment of the run with the largest sum (the first of ties); (0, 0) if none is positive."""
    best = now = 0.0
    first = start = last = 0
    for i, s in enumerate(segments):
        cost = sum(weight[f"tag {t}"] for t in s.tags)
        if now + cost <= 0:
            now, start = 0.0, i
        else:
            now += cost
        each = weight[f"word {s.context}"]
        now += (each + s.outside if s.outside > -SURE else min(each, 0.0) + s.outside) * len(s.text.split())
        if now > best:
            best, first, last = now, start, i + 1
    return first, last


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The best run, out to the ends of the article or main element that holds all of it.

    Words in elements that are surely no article's are left out of it. Blocks are joined by one
    space, white space inside a block is one space.
    """
    if not page:
        return ""
    segments, roots = parse(page, weight)
    first, last = best_run(segments, weight)
    root = segments[first].root if last else -1
    while root >= 0 and roots[root].last < last:
        root = roots[root].above
    if root >= 0:
        first, last = roots[root].first, roots[root].last
    blocks: list[list[str]] = []
    fresh = True
    for s in segments[first:last]:
        if s.outside <= -SURE:
            fresh = True
            continue
        if s.new_block or fresh:
            blocks.append([])
        blocks[-1].append(s.text)
        fresh = False
    joined = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return " ".join(x for x in joined if x)


def learn(pages: DataFrame, page: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from pages that mark their article (``article`` or ``main``): all of up to ``sample``, else a share by hash that gives about as many.

    The driver gets counts of a few fixed features and of at most ``MOST_WORDS`` elements and class words.
    """
    marked = pages.select(page).filter(F.col(page).rlike("(?i)<(article|main)[\\s>]"))
    n = marked.count()
    if n > sample:
        marked = marked.filter(F.pmod(F.xxhash64(page), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                total.update(count(x.as_py() or ""))
        seen = sorted({f for f, _ in total})
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([total[f, "in"] for f in seen], pa.int64()), pa.array([total[f, "out"] for f in seen], pa.int64())], names=["feature", "inside", "outside"])

    rows = marked.mapInArrow(counted, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    fixed = F.col("feature").startswith("word ") | F.col("feature").startswith("tag ")
    seen = F.col("inside") + F.col("outside")
    rows = rows.filter(fixed | (seen >= LEAST_PAGES)).orderBy(F.when(fixed, 0).otherwise(1), seen.desc(), "feature").limit(MOST_WORDS)
    return weights([tuple(r) for r in rows.collect()])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", weight: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Words score positive and tags negative, and words in elements that look like what surrounds an
    article (menus, footers, sidebars, notices, adverts, forms, comments; by element, class, id and
    role, learned from pages that mark their article) score less, and below zero if that is sure. One scan finds the run with
    the largest sum (ties: the first). Scripts and styles are no words. Character references are
    decoded, white space inside a block is one space.

    A null or empty page, or one without words, has an empty text. Tags that never close are read
    as far as they make sense; what surrounds an article and never closes ends where the article
    begins. Equal pages give equal texts; an empty table gives no rows; extra columns are ignored.
    """
    known = learn(pages, page) if weight is None else weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = [extract(x.as_py(), known) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kinds = [rows.schema[i].dataType.simpleString() for i in (0, 1)]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
