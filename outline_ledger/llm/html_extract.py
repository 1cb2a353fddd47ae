"""HTML extraction by tag-path ratios.

A page is read as blocks of text; a block's tag path is the list of block elements (with
class names) from the root to it.  Per path the text length, the punctuation and the linked
characters of all its blocks are summed over the whole body; the length and the punctuation per
block are smoothed over the paths in page order and fused with the share of text outside links
into one weight for each path.  Paths whose weight reaches a share of the mean are content.

The content nodes: the innermost container that holds ``MASS`` of the weighted text of the
content paths (text in an article or main element counts ``PRIOR`` times), widened to the
article or main element around it.  All its blocks are the text, except that links at
its two ends go unless it is an article.  Outside of article and main, blocks of paths
of at least the mean weight, and headings right before the container, belong to it too.

Elements that never hold main text (navigation, headers, footers, asides, forms, scripts, styles)
and parts of a page by role, class name or id (adverts, notices, comments) count in the
statistics but are never text.  Inside an article only adverts, comments and sidebars go by
name.  Where nothing is left of a page without article and main, it is searched again
without the rule of names.

Text: character references decoded, white space inside a block turned into one space,
trimmed, blocks in page order joined by one space.  Defined cases: null or empty html, or a
page without content: empty text; unclosed and crossed tags: closed where HTML implies
it; an unclosed script, style, textarea or title takes the rest of the page, as in a browser, any
other unclosed element without text of its own takes nothing; texts and depths of any size whole;
repeated rows each; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements and names by their role on a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp "
                   "small span strike strong sub sup time tt u var img wbr".split())
LEFT_OUT = frozenset("nav header footer aside form script style noscript template iframe svg math object button select "
                     "input textarea menu dialog head title figure-controls".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                      "toolbar".split())
NAMES_OUT = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies "
                      "consent gdpr notice alert popup modal overlay newsletter subscribe subscription sidebar aside menu "
                      "nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus "
                      "respond reply replies discussion share sharing social related recommended recommendations widget "
                      "toolbar pagination pager login signup search skip copyright".split())
KEPT_ALWAYS = frozenset("html body main".split())
# inside an article: names that begin with such a word, and whole names
NAMED_IN_ARTICLE = frozenset("ad ads advert adverts advertisement sponsored comment comments disqus".split())
WHOLE_IN_ARTICLE = frozenset("sidebar navbar breadcrumb breadcrumbs cookie-notice cookie-banner newsletter share-buttons "
                             "social-share".split())
CONTAINERS = frozenset("html body main article section div td center".split())
# without an end tag these hold the rest of the page
TAKES_REST = frozenset("script style textarea title".split())
# a class with such a word tells of a part that the element has or lacks, not what it is
STATES = frozenset("has no not with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an opening tag of the second set ends an open element of the first
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                            "header hr main menu nav ol p pre section table ul".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
             "option": frozenset(["option"])}
BARRIERS = frozenset("html body article main section div table ul ol dl blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PUNCT = re.compile(r"[,.;:!?…،。、！？；：]")
_COMMENT = re.compile(r"comment|repl|discuss|respond", re.I)
_NAME = re.compile(r"[a-z]+")
# the path of text in a left-out inline element
_MUTE = -1
SHARE, SMOOTH, MASS, PRIOR = 0.2, 1.0, 0.7, 4.0


def _left_out(tag: str, attrs: str, inside: bool = False, by_name: bool = True, article: bool = False) -> bool:
    if tag in LEFT_OUT:
        return True
    if not attrs or tag in KEPT_ALWAYS:
        return False
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)}
    if found.get("aria-hidden") == "true" or "hidden" in found:
        return True
    if found.get("role") in ROLES_OUT and not (article and found["role"] == "alert"):
        return True
    if not by_name:
        return False
    names: set = set()
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = _NAME.findall(token)
        if article:
            if token in WHOLE_IN_ARTICLE or parts and parts[0] in NAMED_IN_ARTICLE:
                return True
        elif STATES.isdisjoint(parts):
            names.update(parts)
    if inside:
        names.discard("header")  # the header of the main part holds its headings
    if tag == "article" or tag in HEADINGS:
        return not names.isdisjoint({"comment", "comments", "reply", "ad", "advert", "sponsored"})
    return not names.isdisjoint(NAMES_OUT)


class Page:
    """The blocks of a page and the elements that hold them.

    ``blocks``: (path, text, linked characters, left out, in article or main).  A path is a number: ``paths``
    has its parent path and its last step once, however deep the page is.  ``elements``: [tag, index of
    the parent element, first block, block after the last].
    """

    def __init__(self, page: str, by_name: bool = True):
        self.blocks: list = []
        self.paths: dict = {}
        self.elements: list = [["", -1, 0, 0]]
        self.marked = False  # has an article or a main element
        self._stack: list = []  # (tag, path, left out, inside, below comments, element, in an article)
        self._words: list = []
        self._linked = 0
        self._open: dict = {}
        self._read(page, by_name)
        self._flush()
        self._pop(0)
        self.elements[0][3] = len(self.blocks)

    def _top(self) -> tuple:
        return self._stack[-1] if self._stack else ("", 0, False, False, False, 0, False)

    def _flush(self) -> None:
        if self._words:
            text = " ".join(_html.unescape("".join(self._words)).split())
            if text:
                _, path, out, inside, *_ = self._top()
                self.blocks.append((path, text, min(self._linked, len(text)), out, inside))
            self._words = []
        self._linked = 0

    def _pop(self, i: int) -> None:
        """Close the open elements from the i-th on."""
        for tag, *_, element, _ in self._stack[i:]:
            self._open[tag] -= 1
            if tag not in INLINE:
                self.elements[element][3] = len(self.blocks)
        del self._stack[i:]

    def _close(self, tag: str) -> None:
        if not self._open.get(tag):
            if tag in ("br", "p"):
                self._flush()
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                if any(x[0] not in INLINE for x in self._stack[i:]):
                    self._flush()
                self._pop(i)
                return
            if self._stack[i][0] in BARRIERS and tag not in BARRIERS and tag not in LEFT_OUT:
                return

    def _read(self, page: str, by_name: bool) -> None:
        stack, links, pos, size = self._stack, 0, 0, len(page)
        endless: set = set()
        while pos < size:
            m = _TOKEN.search(page, pos)
            chunk = page[pos:m.start()] if m else page[pos:]
            if chunk and self._top()[1] != _MUTE:
                self._words.append(chunk)
                if links:
                    self._linked += len(chunk)
            if not m:
                break
            pos = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "a":
                    links = max(0, links - 1)
                self._close(tag)
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    self._flush()
                continue
            _, _, out, _, comment, *_ = self._top()
            if tag in ("article", "main"):
                self.marked = self.marked or not comment
                if out and not comment:
                    # a left-out container that was never closed ends where the article begins
                    self._flush()
                    i = len(stack)
                    while i and stack[i - 1][2]:
                        i -= 1
                    self._pop(i)
            if tag not in INLINE:
                self._flush()
                if any(self._open.get(t) for t in CLOSED_BY):
                    for i in range(len(stack) - 1, -1, -1):
                        if tag in CLOSED_BY.get(stack[i][0], ()):
                            self._pop(i)
                            break
                        if stack[i][0] in BARRIERS:
                            break
                links = 0
            elif tag == "a":
                links += 1
            if tag in RAW:
                end = None
                if tag not in endless:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                if end:
                    pos = end.end()
                elif tag in TAKES_REST:
                    pos = size
                else:
                    endless.add(tag)
                continue
            attrs = m[3]
            _, path, out, inside, comment, element, article = self._top()
            skip = _left_out(tag, attrs, inside, by_name, article and tag != "article")
            if skip and tag == "header" and inside:
                skip = False  # an article's own header holds its headings
            if tag not in INLINE:
                path = self.paths.setdefault((path, tag + _class(attrs)), len(self.paths) + 1)
                self.elements.append([tag, element, len(self.blocks), 0])
                element = len(self.elements) - 1
            elif skip:
                path = _MUTE
            comment = comment or skip and bool(_COMMENT.search(attrs or ""))
            stack.append((tag, path, out or skip, inside or tag in ("article", "main"), comment, element,
                          article or tag == "article"))
            self._open[tag] = self._open.get(tag, 0) + 1


def page_blocks(page: str, by_name: bool = True) -> list:
    """(path, text, linked characters, inside an article or main element) of the blocks that are not left out."""
    return [(b[0], b[1], b[2], b[4]) for b in Page(page, by_name).blocks if not b[3]]


def _class(attrs: str) -> str:
    if not attrs or "class" not in attrs:
        return ""
    m = next((m for m in _ATTR.finditer(attrs) if m[1].lower() == "class"), None)
    value = (m[2] or m[3] or m[4] or "").split() if m else []
    return "." + value[0] if value else ""


def path_weights(blocks: list, smooth: float = SMOOTH) -> tuple[dict, float]:
    """The fused ratios of each path, and their mean over the text."""
    stats: dict = {}
    for path, text, linked, *_ in blocks:
        s = stats.setdefault(path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(_PUNCT.findall(text))
        s[2] += 1
        s[3] += min(linked, len(text))
    paths = list(stats)
    length = [stats[p][0] / stats[p][2] for p in paths]
    marks = [stats[p][1] / stats[p][2] for p in paths]
    near = [math.exp(-(d * d) / (2 * smooth * smooth)) for d in range(3)]

    def smoothed(v):
        out = []
        for i in range(len(v)):
            w = [(near[abs(i - j)], v[j]) for j in range(max(0, i - 2), min(len(v), i + 3))]
            out.append((3 * v[i] + sum(a * b for a, b in w)) / (3 + sum(a for a, _ in w)))
        return out

    fused = [math.sqrt(a) * (1 + b) * (1 - stats[p][3] / max(1, stats[p][0]))
             for a, b, p in zip(smoothed(length), smoothed(marks), paths)]
    total = sum(f * stats[p][0] for f, p in zip(fused, paths))
    return dict(zip(paths, fused)), total / max(1, sum(s[0] for s in stats.values()))


def content_paths(blocks: list, share: float = SHARE, smooth: float = SMOOTH) -> set:
    """Paths whose smoothed and fused ratios reach ``share`` of the mean."""
    weight, mean = path_weights(blocks, smooth)
    return {p for p, f in weight.items() if f >= share * mean and f > 0} or set(weight)


def _linked_block(block: tuple) -> bool:
    return block[2] > 0.5 * len(block[1])


def _container(page: Page, weight: dict, chosen: set) -> int:
    """The innermost container of ``MASS`` of the content paths' weighted text, or the article or main around it."""
    sums = [0.0]
    for path, text, _, out, inside in page.blocks:
        sums.append(sums[-1] + (0 if out or path not in chosen else max(weight[path], 1e-9) * len(text) * (PRIOR if inside else 1)))
    found = 0
    for i, (tag, _, lo, hi) in enumerate(page.elements):
        if tag in CONTAINERS and sums[hi] - sums[lo] >= MASS * sums[-1]:
            found = i
    for mark in ("article", "main"):
        up = found
        while up > 0 and page.elements[up][0] != mark:
            up = page.elements[up][1]
        if up > 0:
            return up
    return found


def _article(page: Page) -> str:
    blocks = page.blocks
    if all(b[3] for b in blocks):
        return ""
    weight, mean = path_weights(blocks)
    # a path of left-out blocks counts in the mean, but is no content
    live = {b[0] for b in blocks if not b[3]}
    chosen = content_paths(blocks) & live or live
    tag, _, lo, hi = page.elements[_container(page, weight, chosen)]
    take = [i for i in range(lo, hi) if not blocks[i][3]]
    if tag != "article":
        ends = [i for i in take if blocks[i][0] in chosen or not _linked_block(blocks[i])]
        take = [i for i in take if ends[0] <= i <= ends[-1]] if ends else take
    if tag not in ("article", "main"):
        steps = {number: step for (_, step), number in page.paths.items()}
        first = lo
        for i in range(lo - 1, -1, -1):
            if blocks[i][3] or _linked_block(blocks[i]):
                break
            if steps.get(blocks[i][0], "").partition(".")[0] in ("h1", "h2"):
                first = i
        more = [i for i, b in enumerate(blocks) if not lo <= i < hi and not b[3]
                and (first <= i < lo or b[0] in chosen and weight[b[0]] >= mean)]
        take = sorted(take + more)
    return " ".join(blocks[i][1] for i in take)


def main_text(page: str | None) -> str:
    """The main text of a page."""
    read = Page(page or "")
    if read.marked or not all(b[3] for b in read.blocks):
        return _article(read)
    return _article(Page(page or "", by_name=False))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {id_type}, url string, text string, n_chars bigint")
