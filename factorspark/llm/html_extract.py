"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block element. A line weighs as many characters as it
has outside links, if these are most of it; lines of menus, headers, footers, sidebars,
notices, adverts, forms and comments weigh nothing. The threshold follows from the page: half
the length of the line that a character of the page is in on average, at most `surge`. Text
surges at a line that reaches the threshold by itself, so that a short line does not ride on
the long one behind it, and goes on while the sum over the next `window` lines holds another
such line; it dives at the last of them, or where the paragraphs beside it in the same element
end. The lines between are kept, without those that belong to a menu or the like. Elements add
a bounded bonus: a heading weighs `surge` characters more; a line in an <article> or <main> that
number times the share of the page's text that such elements hold, and a line outside as much
less, so that short lines at the ends of an article stay, those of a mere card do not, and long
text counts wherever it stands.

Defined results: null or empty html gives an empty text; tags that are never closed end with
their parent; equal pages give equal texts; extra columns are ignored; an empty table gives
no rows. No text is cut, whatever its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 40

# Names of elements and words in class, id or role that mark what is no article text.
_SILENT = frozenset("script style noscript template svg math iframe object select textarea button head title canvas audio video map datalist".split())
_APART = frozenset("nav footer aside form dialog menu".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay paywall newsletter subscribe subscription signup login sidebar side rail widget widgets menu "
    "nav navbar navigation breadcrumb breadcrumbs toolbar footer foot header masthead share sharing social related recommended "
    "comment comments reply replies respond disqus pagination pager skip copyright disclaimer contentinfo complementary search "
    "form toc tags".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TITLING = frozenset(("header", "masthead"))
_HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""")
_NAMED = re.compile(r"""(?i)(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: A comment, a declaration, or a tag with its attributes. Whatever else holds a `<` is text.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title iframe noscript template".split())
#: An opening tag ends an open element of the second kind.
_ENDS = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}


def _marked(attributes: str, inside: bool) -> bool:
    """Whether class, id or role hold a word of what stands apart, or the element is hidden.

    The header of a marked article is part of it."""
    if not attributes or attributes.isspace():
        return False
    if _HIDDEN.search(attributes):
        return True
    for match in _NAMED.finditer(attributes):
        value = match[2] or match[3] or match[4] or ""
        words = {word.lower() for word in _WORD.findall(value)} & _WORDS
        if words - _TITLING if inside else words:
            return True
    return False


class _Lines:
    """Lines of a page: text, characters in links, whether apart, whether in a marked article, whether a heading."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool, bool, bool, int]] = []
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.stack: list[tuple[str, bool, bool]] = []  # name, apart, in article
        self.numbers: list[int] = []  # of the elements on the stack, and more behind them
        self.opened = 0

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def text(self, piece: str) -> None:
        self.pieces.append(piece)
        if any(name == "a" for name, _, _ in reversed(self.stack)):
            self.linked.append(piece)

    def end_line(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                in_links = len(" ".join(html.unescape(" ".join(self.linked)).split())) if self.linked else 0
                self.lines.append((text, in_links, *self.state(), any(name in _HEADINGS for name, _, _ in self.stack), self._family()))
            self.pieces, self.linked = [], []

    def _family(self) -> int:
        """A number that the paragraphs of one element share; 0 for other lines."""
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] == "p":
                return self.numbers[at - 1]
            if self.stack[at][0] in _BLOCKS:
                break
        return 0

    def open(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name in _BLOCKS:
            self.end_line()
            self._close_before(name)
        if name in _VOID or attributes.endswith("/") and name not in _BLOCKS:
            return
        marked = name not in ("html", "body") and _marked(attributes, self.state()[1])
        article = name in ("article", "main") and not marked
        if article:  # an advert that is never closed does not swallow the article
            while self.stack and self.stack[-1][1] and self.stack[-1][0] not in ("article", "main"):
                self.stack.pop()
        apart, inside = self.state()
        apart = apart or name in _SILENT or name in _APART or marked or (name == "header" and not inside)
        self.opened += 1
        self.numbers[len(self.stack):] = [self.opened]
        self.stack.append((name, apart, inside or article))

    def _close_before(self, name: str) -> None:
        """An open paragraph ends at a block, an item at the next one."""
        top = len(self.stack) - 1
        while top >= 0 and self.stack[top][0] not in _BLOCKS:
            top -= 1
        if top >= 0 and (self.stack[top][0] == "p" or name in _ENDS and self.stack[top][0] in (name, _ENDS[name])):
            del self.stack[top:]

    def close(self, name: str) -> None:
        if name in _BLOCKS:
            self.end_line()
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == name:
                del self.stack[at:]
                return
            if name not in _BLOCKS and self.stack[at][0] in _BLOCKS:
                return  # a stray closing tag of an inline element


def page_lines(page: str) -> list[tuple[str, int, bool, bool, bool, int]]:
    """The lines of a page, see _Lines."""
    out, at = _Lines(), 0
    lower = None
    while True:
        match = _TOKEN.search(page, at)
        if match is None:
            out.text(page[at:])
            break
        if match.start() > at:
            out.text(page[at: match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            continue
        name = name.lower()
        if match[1]:
            out.close(name)
            continue
        if name in _RAW:
            lower = page.lower() if lower is None and page.isascii() else lower
            if lower is not None:
                end = lower.find(f"</{name}", at)
            else:
                closing = re.compile(f"</{name}", re.I).search(page, at)
                end = closing.start() if closing else -1
            if end < 0:  # never closed: all that follows belongs to it
                break
            at = end
            closing = page.find(">", at)
            at = closing + 1 if closing >= 0 else len(page)
            continue
        out.open(name, match[3] or "")
    out.end_line()
    return out.lines


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The kept lines of a page, joined by newlines."""
    if not page:
        return ""
    lines = page_lines(page)
    lengths = [0 if apart or 2 * linked >= len(text) else len(text) - linked for text, linked, apart, *_ in lines]
    if not any(lengths):
        return ""
    level = min(surge, sum(n * n for n in lengths) / sum(lengths) / 2)
    share = sum(n for n, line in zip(lengths, lines) if line[3]) / sum(lengths)
    bonus = lambda inside, heading: surge * (1 if heading and (inside or not share) else share if inside else -share)
    weights = [max(0, n + bonus(*line[3:5])) if n else 0 for n, line in zip(lengths, lines)]
    kept: list[int] = []
    beside = lambda at, last: lines[at][5] and lines[at][5] == lines[last][5] and weights[at]
    for at, weight in enumerate(weights):
        if weight >= level:  # a surge, or text that goes on
            first = at
            if kept and at - kept[-1] <= window:
                first = kept[-1] + 1
            while first > 0 and (not kept or kept[-1] < first - 1) and beside(first - 1, first):
                first -= 1
            kept += range(first, at + 1)
        elif kept and kept[-1] == at - 1 and beside(at, at - 1):
            kept.append(at)
    return "\n".join(lines[at][0] for at in kept if not lines[at][2])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    source = pages.select(id_col, url_col, html_col)
    types = dict(source.dtypes)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                ["id", "url", "text", "n_chars"])

    done = source.mapInArrow(texts, f"id {types[id_col]}, url {types[url_col]}, text string, n_chars long")
    return done.withColumnsRenamed({"id": id_col, "url": url_col})
