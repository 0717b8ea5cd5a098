"""Main text of web pages by line-block distribution.

Markup is stripped first: what stands in scripts, styles, menus, page headers, footers, sidebars,
notices, adverts, forms and comments is taken out with it, and every block element becomes a line. Then
text lengths, without link text, are summed over sliding windows of lines. The article starts where the
sums surge and ends where they dive to nothing; the text between is kept, in page order. Where the page
marks its article, or its main part, the windows slide over its lines only, and any text there is a surge.

What would be taken out stays where it holds the longest article or main part, or most of the unlinked text of
a page whose article is no surge without it; what is hidden never does. A name of a class, id or role marks as a whole:
has-sidebar or comments-open do not.

Defined results: null or empty html, and pages without text, give an empty text; p, li, dd, dt, tr, td and the like
end at the start tags that HTML ends them at, other unclosed elements where their parent ends; stray end tags are skipped; character references are decoded; white space inside a line
becomes one space, ``br`` counts as white space; lines are joined by two line feeds. Repeated rows give the
same text each; an empty table gives no rows; other columns stay out of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Lines in a window, and the sum of text from which a window is a surge.
WINDOW = 3
SURGE = 86

# Elements by how they are treated.
RAW = frozenset("script style noscript template iframe object svg math textarea title noembed noframes xmp".split())
DROPPED = frozenset(
    "nav aside form button select option datalist fieldset dialog menu canvas audio video map input".split()
)
GONE = frozenset(("head",))
OUTER = frozenset("header footer".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
# Words of a class, an id or a role that mark what is not the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "notice notices alert comment comments reply replies respond disqus sidebar sidebars aside nav navbar navigation "
    "menu menus breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter "
    "subscribe subscription signup login popup modal overlay widget widgets pagination pager toolbar skip search "
    "complementary contentinfo dialog".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
# What may stand before or after a marking word in a name of several words. Other names
# with such a word, like has-sidebar or comments-open, tell of the page around it.
BEFORE = frozenset(
    "site page main primary secondary top bottom left right global social cookie post article blog entry user "
    "google text display the js block inline sticky floating email".split()
) | MARKED
AFTER = frozenset(
    "box bar block list area section container wrapper wrap inner outer panel links link buttons button icons icon "
    "form item items slot unit top bottom left right main primary secondary text title header body "
    "message overlay popup".split()
) | MARKED
# Words of a layout or a state; a name that holds one marks nothing.
STATE = frozenset(
    "has no with without is not open closed enabled disabled layout content result results page template".split()
)

# Elements that a start tag ends where they are open, and the elements beyond which it does not look.
_BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section search summary table ul li dd dt".split()
)
_CLOSES = {tag: ("p",) for tag in _BLOCKS} | {
    "body": ("head",),
    "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"),
    "tr": ("tr", "td", "th", "caption", "colgroup"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "rt": ("rt", "rp"), "rp": ("rt", "rp"),
}
_CLOSES["tbody"] = _CLOSES["tfoot"] = _CLOSES["thead"]
# Elements beyond which a start tag does not look: those of the scope of p, or these.
_SCOPE = frozenset("table td th caption button object html body".split())
_ITEMS = (_BLOCKS - frozenset("address div p li dd dt".split())) | _SCOPE
_STOPS = {"li": _ITEMS, "dd": _ITEMS, "dt": _ITEMS, "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr"))} | {
    tag: frozenset(("table",)) for tag in ("tr", "thead", "tbody", "tfoot")
}


def _marks(name: str) -> bool:
    """Whether a whole name of a class, an id or a role marks what is not the article."""
    words = _WORD.findall(name)
    if not MARKED.intersection(words) or STATE.intersection(words):
        return False
    first = next(i for i, w in enumerate(words) if w in MARKED)
    last = len(words) - 1 - next(i for i, w in enumerate(reversed(words)) if w in MARKED)
    return BEFORE.issuperset(words[:first]) and AFTER.issuperset(words[last + 1 :])


def _marked(attributes: str) -> bool:
    """Whether a class, an id or a role marks it."""
    return any(_marks(name) for groups in _ATTRIBUTE.findall(attributes) for name in "".join(groups).lower().split())


class _Lines:
    """Lines of a page: pieces (text, in a link, number of the article around it, doubtful element around it).

    A doubtful element is one that is dropped unless it turns out to hold the page's article. Number 0 is the page.
    """

    def __init__(self) -> None:
        self.done: list[list[tuple[str, bool, int, int]]] = []
        self.parts: list[tuple[str, bool, int, int]] = []
        # Doubtful element around each doubtful one, and around each article.
        self.around: list[int] = [0]
        self.articles: list[int] = [0]

    def text(self, piece: str, linked: bool, article: int, doubt: int) -> None:
        if piece:
            self.parts.append((piece, linked, article, doubt))

    def end(self) -> None:
        if self.parts:
            self.done.append(self.parts)
            self.parts = []

    def stays(self) -> list[bool]:
        """Which doubtful elements stay: those that hold the longest article, or most unlinked text of the page.

        Text alone does not count below half a surge, or where an article outside of them is a surge by itself.
        """
        plain, marked, alone = [0] * len(self.around), [0] * len(self.articles), 0
        for line in self.done:
            for piece, linked, article, doubt in line:
                if not linked:
                    letters = len("".join(piece.split()))
                    plain[doubt] += letters
                    marked[article] += letters if article else 0
                    alone += letters if article and not doubt else 0
        holds = [False] * len(self.around)
        if max(marked):
            holds[self.articles[marked.index(max(marked))]] = True
        for i in range(len(self.around) - 1, 0, -1):
            plain[self.around[i]] += plain[i]
            holds[self.around[i]] |= holds[i]
        stays = [True]
        for i in range(1, len(self.around)):
            most = 2 * plain[i] > max(plain[0], SURGE) and alone < SURGE
            stays.append(stays[self.around[i]] and (holds[i] or most))
        return stays

    def kept(self) -> list[tuple[str, int, int]]:
        """Lines as (text, letters outside of links, number of the article around it)."""
        stays, out = self.stays(), []
        for line in self.done:
            parts = [part for part in line if stays[part[3]]]
            text = " ".join(unescape("".join(part[0] for part in parts)).split())
            if text:
                plain = sum(len(piece) for piece, linked, _, _ in parts if not linked)
                out.append((text, min(plain, len(text)), parts[-1][2]))
        return out


def _ended(stack: list[tuple], tag: str) -> int:
    """From which place on the stack a start tag ends what is open."""
    targets, place = _CLOSES[tag], len(stack)
    for i in range(len(stack) - 1, 0, -1):
        name = stack[i][0]
        if name in targets:
            place = i
        elif name in _STOPS.get(tag, _SCOPE):
            break
    return place


def _lines(html: str) -> list[tuple[str, int, int]]:
    """Strip the markup. The stack holds (element, dropped, number of its article, in a link, doubtful element)."""
    lines, stack, at, opened = _Lines(), [("", False, 0, False, 0)], 0, Counter()
    position = 0

    def cut(place: int) -> None:
        opened.subtract(entry[0] for entry in stack[place:])
        del stack[place:]

    while True:
        found = _TOKEN.search(html, position)
        _, dropped, article, linked, doubt = stack[-1]
        piece = html[at : found.start() if found else len(html)]
        if not dropped:
            lines.text(piece, linked, article, doubt)
        if not found:
            break
        at = position = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            if html.startswith("<![CDATA[", found.start()) and not dropped:
                lines.text(html[found.start() + 9 : found.end() - 3], linked, article, doubt)
            continue
        tag = tag.lower()
        if tag not in INLINE:
            lines.end()
        elif tag == "br" and not dropped:
            lines.text(" ", True, article, doubt)
        if closing:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    cut(i)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = position = end.end() if end else len(html)
            continue
        if any(opened[name] for name in _CLOSES.get(tag, ())):
            cut(_ended(stack, tag))
            _, dropped, article, linked, doubt = stack[-1]
        if tag in VOID or attributes.endswith("/"):
            continue
        if not dropped and tag not in ("html", "body") and (tag in GONE or attributes and _HIDDEN.search(attributes)):
            dropped = True
        if not dropped:
            if tag in DROPPED or tag in OUTER and not (tag == "header" and article) or (
                tag not in ("html", "body") and _marked(attributes)
            ):
                lines.around.append(doubt)
                doubt = len(lines.around) - 1
            if tag in ("article", "main"):
                lines.articles.append(doubt)
                article = len(lines.articles) - 1
        stack.append((tag, dropped, article, linked or tag == "a", doubt))
        opened[tag] += 1
    lines.end()
    return lines.kept()


def _between(sizes: list[int], surge: int) -> list[bool]:
    """Lines from every surge of the window sums to the dive after it."""
    n = len(sizes)
    sums = [sum(sizes[max(0, i - WINDOW + 1) : i + 1]) for i in range(n)]
    kept, i = [False] * n, 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        stop = i
        while stop < n and sums[stop]:
            stop += 1
        if max(sums[i:stop]) >= surge:
            last = max(j for j in range(i, stop) if sizes[j])
            kept[i : last + 1] = [True] * (last + 1 - i)
        i = stop
    return kept


def main_text(html: str | None) -> str:
    lines = _lines(html or "")
    article = [line for line in lines if line[2]]
    if article:
        kept = _between([len(text) for text, _, _ in article], 1)
    else:
        kept = _between([size for _, size, _ in lines], SURGE)
    return "\n\n".join(line[0] for line, stays in zip(article or lines, kept) if stays)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per page."""
    rows = pages.selectExpr("cast(page_id as long) AS page_id", "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
