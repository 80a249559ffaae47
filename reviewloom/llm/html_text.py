"""Main text of web pages by the ratios of their tag paths.

Text is gathered per path of tags from the root to the text. Each path has a text ratio
(characters outside links per text node) and a punctuation ratio (marks per text node).
Both are smoothed over neighbouring nodes of the page, multiplied, and held against a
threshold from their spread. The nodes above it are the content, and the lowest container
with half of their text is where the article is. Its other blocks (headings, short lines)
belong to it too, but for those of a kind that is never part of an article. The container
is widened to the <article> or <main> around it, or else to what stands beside it below
the level of the page's own frame.

A page is read once from start to end, whatever its markup: no step looks back or ahead
over more than it uses up.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*)>")
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is no markup and no text of the page.
RAW = frozenset("script style noscript template textarea iframe svg".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}

#: Elements without a closing tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line; all others begin and end a block.
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that never hold article text.
OUTSIDE = frozenset("head title nav header footer aside form button select option dialog menu".split())
#: Elements of the page's own frame: what holds them is more than the article.
FRAME = frozenset("nav header footer aside".split())
#: Whole names in class, id or role of elements outside the article.
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " header masthead footer sidebar aside widget widgets comment comments reply replies disqus cookie cookies consent gdpr notice notices alert popup modal"
    " newsletter subscribe subscription signup login social share sharing related recommended form search pagination pager copyright skip toolbar complementary contentinfo"
    " legal disclaimer imprint respond".split()
)
#: Of these, the ones that lead outside in a name of several words too, if each other word
#: is in NEUTRAL: a comment-list and a cookie-banner, but no comment-open.
STRONG = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets comment comments reply"
    " replies disqus cookie cookies consent gdpr newsletter subscribe subscription signup login social share sharing related recommended pagination pager copyright".split()
)
NEUTRAL = OUTSIDE_WORDS | frozenset(
    "area articles author avatar bar block body bottom box button buttons card cards container content count entry footer form group head holder icon icons inner item"
    " items left link links list main message meta news outer overlay page panel post posts primary right row secondary section site slot stories story text thread title"
    " tools top unit user wrap wrapper".split()
)
COMMENTS = frozenset("comment comments reply replies".split())
#: Elements that are not outside for their names alone: themes and slugs of headings are among these.
ALWAYS = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: Elements that name the article.
ARTICLE = frozenset(["article", "main"])
#: Elements that are parts of an article, so its other parts stand beside them.
PARTS = frozenset(
    "p li ul ol dl dt dd table caption thead tbody tfoot tr td th blockquote pre section figure figcaption details summary h1 h2 h3 h4 h5 h6".split()
)
#: The whole page, as far as containers go.
PAGE = frozenset(["", "html", "body"])
#: An opening tag of these closes an open <p>.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An opening tag of these closes an open one of its kind, within the nearest of LISTS.
ITEMS = frozenset("li td th tr dt dd option".split())
LISTS = ("ul", "ol", "table", "dl", "select")
_MARKS = re.compile(r"[.,;:!?…。，、！？；：]")
_WORD = re.compile(r"[a-z]+")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_HUGE = re.compile(r"&#[0-9]{8,};?")


def _outside_name(name: str) -> bool:
    """Whether a name of several words stands for something outside the article."""
    words = _WORD.findall(name)
    return len(words) > 1 and not STRONG.isdisjoint(words) and NEUTRAL.issuperset(words)


def _label(tag: str, rest: str, nested: bool) -> tuple[str, bool]:
    """A step of a path, and whether it leads outside the article.

    An <article> is outside for any such name within another one or <main>, where it is a
    comment or a teaser, and elsewhere only if it is called a comment. The id of a <section> may be made from its heading: it counts if it is
    "comments" or made of several words, and its class always.
    """
    if not rest or rest.isspace():
        return tag, tag in OUTSIDE
    words: set[str] = set()
    outside = tag in OUTSIDE
    judged = tag not in ALWAYS
    names = COMMENTS if tag == "article" and not nested else OUTSIDE_WORDS
    for kind, *values in _NAMES.findall(rest):
        value = "".join(values).lower()
        words.update(_WORD.findall(value))
        if judged and not outside:
            slug = tag == "section" and kind.lower() == "id"
            for name in value.split():
                if name == "comments" or name in names and not slug or _outside_name(name):
                    outside = True
    return (f"{tag}.{'.'.join(sorted(words))}" if words else tag), outside


def _decoded(text: str) -> str:
    """Character references decoded, white space as single spaces."""
    if "&" in text:
        if "&#" in text:
            text = _HUGE.sub("\ufffd", _ZEROS.sub("&#", text))
        text = html.unescape(text)
    return " ".join(text.split())


class Page:
    """Elements and text blocks of a page in their order.

    Elements (only those that are no part of a line): ``parent``, ``tag``, ``path`` (a
    number for each path of labels), ``frame`` (of the page's frame). Number 0 is the page
    itself; parents come before their children. Blocks: (element, outside, characters in
    links, characters of source, text).
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.frame = [0], [""], [0], [False]
        self.blocks: list[tuple[int, bool, int, int, str]] = []
        self._paths: dict = {}
        self._held: list[str] = []
        self._links = 0
        self._where = (0, False)
        # open elements: (tag, element or None, outside); their places by tag
        self._stack: list[tuple[str, int | None, bool]] = []
        self._open: dict[str, list[int]] = defaultdict(list)
        self._solid: list[int] = []
        self._outside = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        last = {mark: source.rfind(mark) for mark in "\"'>"}
        loose = False  # the last quote is never closed before a ">"
        while at < size:
            begin = source.find("<", at)
            if begin < 0:
                break
            if begin > at:
                self._hear(source[at:begin])
            found = _TAG.match(source, begin)
            if found:
                close, tag, rest = found.groups()
                at = found.end()
            elif source.startswith("<!--", begin):
                end = source.find("-->", begin + 4)
                at = size if end < 0 else end + 3
                continue
            elif source.startswith(("<!", "<?"), begin):
                end = source.find(">", begin)
                at = size if end < 0 else end + 1
                continue
            else:
                found = _OPEN.match(source, begin)
                if not found or last[">"] < begin:
                    self._hear("<")
                    at = begin + 1
                    if last[">"] < begin:  # no tag can end any more
                        self._hear(source[at:])
                        at = size
                    continue
                close, tag = found.groups()
                end = None if loose else self._end(source, found.end(), last)
                if end is None:
                    loose = True
                    end = source.find(">", begin)
                rest = source[found.end() : end]
                at = end + 1
            tag = tag.lower()
            if close:
                self._close(tag)
            elif tag in RAW:
                if self._held:
                    self._held.append(" ")
                ended = _RAW_END[tag].search(source, at)
                at = ended.end() if ended else size
            else:
                self._start(tag, rest)
        if at < size:
            self._hear(source[at:])
        self._flush()

    @staticmethod
    def _end(source: str, at: int, last: dict) -> int | None:
        """Place of the ">" that ends a tag: the first one outside quotes."""
        while True:
            found = _STOP.search(source, at)
            if found is None:
                return None
            mark, at = found[0], found.end()
            if mark == ">":
                return found.start()
            if last[mark] >= at:
                at = source.find(mark, at) + 1

    def _hear(self, text: str) -> None:
        if not self._held:
            if text.isspace():
                return
            self._where = (self._stack[self._solid[-1]][1] if self._solid else 0, self._outside > 0)
        self._held.append(text)
        if self._open["a"]:
            self._links += len(text)

    def _flush(self) -> None:
        if self._held:
            source = "".join(self._held)
            text = _decoded(source)
            if text:
                self.blocks.append((*self._where, self._links, len(source), text))
            self._held.clear()
            self._links = 0

    def _cut(self, place: int) -> None:
        """Close the open elements from a place on."""
        while len(self._stack) > place:
            tag, element, outside = self._stack.pop()
            self._open[tag].pop()
            self._outside -= outside
            if element is not None:
                self._solid.pop()

    def _close(self, tag: str) -> None:
        places = self._open.get(tag)
        if not places:
            if tag not in INLINE:
                self._flush()
            return
        place = places[-1]
        if tag in INLINE:
            # the end of a part of a line does not close the blocks in it
            if self._solid and self._solid[-1] > place:
                return
            if any(entry[2] for entry in self._stack[place:]):
                self._flush()
        else:
            self._flush()
        self._cut(place)

    def _start(self, tag: str, rest: str) -> None:
        label, outside = _label(tag, rest, bool(self._open["article"] or self._open["main"]))
        if tag not in INLINE or outside:
            self._flush()
        if tag in VOID or rest.endswith("/") and tag not in CLOSES_P:
            return
        if tag in CLOSES_P:
            if self._solid and self._stack[self._solid[-1]][0] == "p":
                self._cut(self._solid[-1])
        elif tag in ITEMS and self._open[tag]:
            place = self._open[tag][-1]
            if all(not self._open[name] or self._open[name][-1] < place for name in LISTS):
                self._cut(place)
        element = None
        if tag not in INLINE:
            above = self._stack[self._solid[-1]][1] if self._solid else 0
            element = len(self.tag)
            self.parent.append(above)
            self.tag.append(tag)
            self.path.append(self._paths.setdefault((self.path[above], label), len(self._paths) + 1))
            self.frame.append(tag in FRAME)
            self._solid.append(len(self._stack))
        self._open[tag].append(len(self._stack))
        self._stack.append((tag, element, outside))
        self._outside += outside


def ratios(parts: list[tuple[int, int, int]]) -> list[float]:
    """Smoothed and fused path ratios of blocks (path, characters, marks)."""
    sums: dict = {}
    for path, size, marks in parts:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += 1
        s[1] += size
        s[2] += marks
    raw = [(s[1] / s[0], s[2] / s[0]) for s in (sums[p[0]] for p in parts)]
    weights = [math.exp(-(d * d) / 2) for d in (-2, -1, 0, 1, 2)]
    fused = []
    for i in range(len(raw)):
        total, length, marks = 0.0, 0.0, 0.0
        for d, w in zip((-2, -1, 0, 1, 2), weights):
            if 0 <= i + d < len(raw):
                total += w
                length += w * raw[i + d][0]
                marks += w * raw[i + d][1]
        fused.append((length / total) * (1 + marks / total))
    return fused


def main_text(source: str | None) -> str:
    """The article of a page: its blocks joined by one space; empty if there is none."""
    page = Page(source or "")
    inside = [b for b in page.blocks if not b[1]]
    if not inside:
        return ""
    parent, tag, n = page.parent, page.tag, len(page.tag)
    plain = [len(text) * (1 - links / size) for _, _, links, size, text in inside]
    fused = ratios([(page.path[b[0]], p, len(_MARKS.findall(b[4]))) for b, p in zip(inside, plain)])
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    if not any(plain):
        plain = [float(len(b[4])) for b in inside]
    content, frames = [0.0] * n, [int(f) for f in page.frame]
    for block, x, size in zip(inside, fused, plain):
        if x >= min(spread, mean):
            content[block[0]] += size
    named = [False] * n
    in_named = 0.0
    for i in range(n):
        named[i] = tag[i] in ARTICLE or named[parent[i]]
        in_named += content[i] * named[i]
    for i in range(n - 1, 0, -1):
        content[parent[i]] += content[i]
        frames[parent[i]] += frames[i]
    # the lowest container with half of the content; parts of a text are no container
    best = max(i for i in range(n) if tag[i] not in PARTS and 2 * content[i] >= content[0])
    while tag[best] not in PAGE and not named[best]:
        wider = parent[best]
        while tag[wider] in PARTS:
            wider = parent[wider]
        if tag[wider] in PAGE or frames[wider] > frames[best]:
            break
        best = wider
    if named[best]:
        # the outermost <article> around it, or <main> where there is none
        at, main = best, 0
        article = 0
        while named[at]:
            if tag[at] == "article":
                article = at
            elif tag[at] == "main":
                main = at
            at = parent[at]
        best = article or main
    # within the whole page, containers without content are left out, and all that is
    # beside <article> and <main> if they have half of the content
    whole = tag[best] in PAGE
    only_named = whole and 2 * in_named >= content[0] > 0
    within, top = [False] * n, [0] * n
    for i in range(n):
        within[i] = i == best or i > 0 and within[parent[i]]
        if i and within[i] and i != best:
            top[i] = top[parent[i]] or (0 if tag[i] in PARTS or tag[i] in PAGE else i)
    found = []
    for element, _, _, _, text in inside:
        if within[element] and not (whole and top[element] and not content[top[element]]) and (named[element] or not only_named):
            found.append((element, text))
    if not whole and not any(tag[e] == "h1" for e, _ in found):
        # the title may stand ahead of the container
        titles = [b[4] for b in inside if tag[b[0]] == "h1" and b[0] < best]
        found[:0] = [(0, title) for title in titles[-1:]]
    return " ".join(text for _, text in found)


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Rows (key, url, text, n_chars): the main text of each page, from its whole source.

    Null or empty html gives an empty text. Repeated rows stay; other columns are left
    out. Pages are independent, nothing is shuffled.
    """
    prepared(df.sparkSession)
    named = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").alias("u"), F.col(f"`{page}`").alias("h"))
    kinds = dict(named.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["h"]]
            yield pd.DataFrame({"k": batch["k"], "u": batch["u"], "t": texts, "n": [len(t) for t in texts]})

    out = named.mapInPandas(work, f"k {kinds['k']}, u {kinds['u']}, t string, n long")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), F.col("t").alias("text"), F.col("n").alias("n_chars"))
