"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; each block of a page becomes a line with its text, its tags
and the elements it stands in. The lines' ratios of unlinked text to tags are smoothed with a Gaussian and split by a threshold
into content and rest; lines that are links only are rest whatever stands around them. The text is the region of the content lines:
the articles (or mains) that hold most of them, else the innermost element that holds all of them, with the title before it and the
sentences after it. Tags and whole words of class, id and role are evidence next to that: parts that they mark as something else are left out,
unless they hold the text itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import read_table

#: Width of the Gaussian in lines, and the share of the mean ratio's deviation that a content line must exceed.
SIGMA, THRESHOLD = 1.0, 0.5
#: Articles or mains are taken if they hold this share of the content lines' characters; a marked wrapper of this share of the text is no other part,
#: and neither is one of WRAPPED that holds the only articles.
SHARE, WRAPPED = 0.8, 0.5

SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas select textarea button datalist audio video map".split())
UNWANTED = frozenset("nav footer aside form menu dialog fieldset".split())
HOLDERS = frozenset("html body main article section div header blockquote table tbody tr td ul ol dl figure details nav footer aside form menu dialog fieldset center".split())
BLOCKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre br hr caption th thead tfoot address summary figcaption hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words of class, id and role that mark parts other than the article: a name is a mark if it has one of them and besides only words of PLAIN.
MARKS = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promotions banner banners nav navbar navigation menu menus
    breadcrumb breadcrumbs sidebar sidebars side aside footer foot masthead cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus widget widgets toolbar pager pagination search searchbox
    complementary contentinfo skip skiplink""".split())
PLAIN = frozenset("""box bar bars block blocks container wrapper wrap inner outer list lists item items area section panel pane column col row group strip slot unit zone link links button buttons
    icon icons form field site page global main primary secondary top bottom left right header head content text title post posts article articles story stories more news user users reader readers
    count thread js module component region sticky fixed float small large big mini desktop mobile wide inline in body to""".split())
HEADERS = frozenset("header head topbar siteheader pageheader top".split())
#: Names of comments that are names of an article's sections, too: marks of a plain container, or outside an article.
TALK = frozenset("discussion discussions conversation conversations responses feedback".split())
SECTIONS = frozenset("section article main".split())
#: Words that tell how a page is laid out: has-sidebar, no-sidebar, layout-with-menu.
LAYOUT = frozenset("has no with without".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Lines that end a page, and how long one may be.
CLOSING_CHARS = 300
CLOSING = re.compile(r"©|\(c\)\s*\d{4}|\b(?:copyright|all rights reserved)\b", re.I)
SENTENCE_END = tuple(".!?…:;\"'”’»)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks in which a line of links only is part of a list or table, which is judged as a whole.
LISTED = frozenset("li dt dd td th tr ul ol dl table tbody caption figcaption".split())
#: A tag that the page's end cuts off is no text.
CUT_OFF = re.compile(r"<[/!?A-Za-z][^<>]*\Z")


#: What a part is by its tag and attributes; names are only a hint.
WANTED, MARKED, OUT = 0, 1, 2


class Line:
    __slots__ = ("text", "tags", "linked", "holder", "marked", "ratio", "block")

    def __init__(self, text: str, tags: int, linked: int, holder: int, marked: bool, block: str):
        self.text, self.tags, self.linked, self.holder, self.marked, self.block = text, tags, linked, holder, marked, block
        self.ratio = 0.0

    def only_links(self) -> bool:
        return self.linked >= len(self.text.replace(" ", ""))

    def ends_page(self) -> bool:
        """A short line with a copyright, or one of links for the most part."""
        return 2 * self.linked > len(self.text) or len(self.text) < CLOSING_CHARS and CLOSING.search(self.text) is not None


def is_mark(name: str, tag: str, inside: bool) -> bool:
    """Whether one name of class, id or role marks a part other than the article; ``inside`` one, headers and sections are its own."""
    words = {x.lower() for x in WORDS.findall(name)} - {x for x in WORDS.findall(name) if x.isdigit()}
    if words & LAYOUT:
        return False
    if words & TALK and words <= TALK | PLAIN | MARKS:
        return not (inside and tag in SECTIONS)
    if words & MARKS:
        return words <= MARKS | PLAIN
    return not inside and bool(words & HEADERS) and words <= HEADERS | PLAIN


class Lines(HTMLParser):
    """Collects the lines of a page; tolerates tags that are not closed, not opened or cut off."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, bool]] = []  # holder, number, in an article
        self.names, self.parents = [""], [0]  # by number; 0 is the page
        self.wants = [WANTED]
        self.within = [False]  # in an article around
        self.tags = self.linked = 0
        self.link = False  # in a link whose text is still in the block in which it began
        self.crossed: tuple[int, int] | None = None  # lines and open holders when a link began that blocks have followed: linked only if it is closed
        self.skip: list[str] = []
        self.inline: list[str] = []  # marked elements that hold no blocks
        self.parts: list[str] = []
        self.block = ""  # the latest block that opened
        self.began = (0, 0)

    def _wants(self, tag: str, attrs: list) -> int:
        inside = bool(self.open) and self.open[-1][2]
        if tag in UNWANTED or tag == "header" and not inside:
            return OUT
        if tag in ("html", "body", "main", "article"):
            return WANTED
        out = WANTED
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value.lower()):
                return OUT
            if value and name in ("class", "id", "role") and any(is_mark(x, tag, inside) for x in value.split()):
                out = MARKED
        return out

    def cut(self) -> None:
        """End the line; its white space becomes single spaces."""
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.open[-1][1] if self.open else 0, bool(self.inline), self.block))
            self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        if tag in SKIPPED:
            if tag != "head" and tag not in VOID:
                self.skip.append(tag)
            return
        if tag == "a":  # ends one that is left open
            self.link, self.crossed, self.began = True, None, (len(self.lines), len(self.open))
        if tag in BLOCKS:
            self.cut()
            self._cross()
            if tag not in VOID:
                self.block = tag
        if tag in HOLDERS:
            before = self.open[-1] if self.open else ("", 0, False)
            self.names.append(tag)
            self.parents.append(before[1])
            self.wants.append(self._wants(tag, attrs))
            self.within.append(before[2])
            self.open.append((tag, len(self.names) - 1, before[2] or tag in ("article", "main")))
        elif tag not in VOID and self._wants(tag, attrs) != WANTED:
            self.cut()
            self.inline.append(tag)

    def _cross(self) -> None:
        """A block begins or ends in a link: what follows is linked only if the link is closed later."""
        if self.link:
            self.link, self.crossed = False, self.began

    def _close_link(self) -> None:
        if self.crossed:
            for line in self.lines[self.crossed[0] :]:
                line.linked = len(line.text.replace(" ", ""))
            self.linked = len("".join("".join(self.parts).split()))
        self.link, self.crossed = False, None

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            elif tag in ("body", "html"):
                self.skip.clear()
            return
        if tag == "a":
            self._close_link()
        if tag in BLOCKS:
            self.cut()
            self._cross()
            self.block = ""
        if tag in HOLDERS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    self.inline.clear()
                    if self.crossed and self.crossed[1] > k:  # the link was left open in what ends here
                        self.crossed = None
                    break
        elif self.inline and tag == self.inline[-1]:
            self.cut()
            self.inline.pop()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)
            if self.link:
                self.linked += len("".join(data.split()))


def smoothed(values: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total = sum(kernel)
    n = len(values)
    return [sum(kernel[k + reach] * values[min(max(i + k, 0), n - 1)] for k in range(-reach, reach + 1)) / total for i in range(n)]


def content_lines(lines: list[Line], sigma: float, threshold: float) -> list[Line]:
    """Lines whose smoothed ratio of unlinked text to tags lies above the threshold."""
    raw = [max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines]
    ratios = smoothed(raw, sigma)
    mean = sum(ratios) / len(ratios)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    limit = min(threshold * deviation, mean)
    for line, ratio in zip(lines, ratios, strict=True):
        line.ratio = ratio
    return [x for x in lines if x.ratio >= limit]


def sums_of(parser: Lines, lines: list[Line]) -> list[int]:
    """Characters of the lines in each holder and in all that it holds."""
    out = [0] * len(parser.names)
    for x in lines:
        out[x.holder] += len(x.text)
    for holder in range(len(out) - 1, 0, -1):  # numbers grow inwards
        out[parser.parents[holder]] += out[holder]
    return out


def downwards(parser: Lines, own: list[bool]) -> list[bool]:
    """Holders that are, or stand in, one of ``own``."""
    out = list(own)
    for holder in range(1, len(out)):
        out[holder] = out[holder] or out[parser.parents[holder]]
    return out


def wanted_lines(parser: Lines, share: float) -> list[Line]:
    """Lines outside unwanted parts. A comment's article or a marked part stays what the part around it is.

    Where no article or main has a line free of marks, a marked part that holds most of the page's text is its wrapper.
    """
    n = range(len(parser.names))
    out = downwards(parser, [w == OUT for w in parser.wants])
    under = downwards(parser, [w != WANTED for w in parser.wants])
    articles = [parser.names[h] in ("article", "main") and not out[h] for h in n]
    free = sums_of(parser, [x for x in parser.lines if not under[x.holder] and not x.marked])
    if not any(articles[h] and free[h] for h in n):
        sums = sums_of(parser, [x for x in parser.lines if not out[x.holder] and not x.marked])
        holds = list(articles)
        for h in reversed(n):
            holds[parser.parents[h]] = holds[parser.parents[h]] or holds[h]
        wraps = [parser.wants[h] == MARKED and sums[h] > 0 and (not parser.within[h] or sums[0] == sums[h]) and sums[h] >= (WRAPPED if holds[h] else share) * sums[0] for h in n]
        under = downwards(parser, [w != WANTED and not wraps[h] for h, w in enumerate(parser.wants)])
    lines = [x for x in parser.lines if not under[x.holder] and not x.marked]
    return without_link_lines(parser, lines)


def without_link_lines(parser: Lines, lines: list[Line]) -> list[Line]:
    """Lines but for those of links only: single ones in no list and no heading, and lists and tables all of whose lines are such."""
    lists = [0] * len(parser.names)  # the nearest list or table around a holder's lines
    for h in range(1, len(lists)):
        lists[h] = h if parser.names[h] in ("ul", "ol", "dl", "table") else lists[parser.parents[h]]
    linked, whole = [0] * len(parser.names), [0] * len(parser.names)
    for x in lines:
        whole[lists[x.holder]] += 1
        linked[lists[x.holder]] += x.only_links()
    out = []
    for x in lines:
        h = lists[x.holder]
        menu = linked[h] == whole[h] if h else x.block not in HEADINGS | LISTED
        if not (x.only_links() and menu):
            out.append(x)
    return out


def region(parser: Lines, wanted: list[Line], content: list[Line], share: float) -> list[bool]:
    """The holders that the content lines vote for, with all that stands in them."""
    votes = sums_of(parser, content)
    for name in ("article", "main"):  # all parts of an article that is given in parts
        inside = downwards(parser, [parser.names[h] == name and votes[h] > 0 for h in range(len(votes))])
        if sum(len(x.text) for x in content if inside[x.holder]) >= share * votes[0]:
            return inside
    # the innermost element of all content lines; a list, table or quotation is part of an article and not one
    whole = [h for h, v in enumerate(votes) if v == votes[0] and parser.names[h] in ("body", "main", "article", "section", "div", "center", "html")]
    innermost = max(whole, default=0)
    return downwards(parser, [h == innermost for h in range(len(votes))]) if whole else [True] * len(votes)


def extended(parser: Lines, wanted: list[Line], inside: list[bool]) -> list[Line]:
    """The region's lines, with those before it from the page's title on, and the sentences and headings right after it."""
    own = [k for k, x in enumerate(wanted) if inside[x.holder]]
    first, last = own[0], own[-1]
    in_article = any(inside[h] and parser.names[h] in ("article", "main") for h in range(len(inside)))
    if in_article:
        return [wanted[k] for k in own]
    if not any(wanted[k].block == "h1" for k in own):
        title = next((k for k in range(first - 1, -1, -1) if wanted[k].block == "h1"), None)
        first = first if title is None else title
    while last + 1 < len(wanted):
        x = wanted[last + 1]
        if x.ends_page() or not (x.text.endswith(SENTENCE_END) or x.block in HEADINGS):
            break
        last += 1
    # where the region is the whole page, what closes it is no part of it
    while last > first and wanted[last].ends_page():
        last -= 1
    while last > own[-1] and wanted[last].block in HEADINGS:  # a heading of something else
        last -= 1
    return wanted[first : last + 1]


def main_text(html: str, sigma: float = SIGMA, threshold: float = THRESHOLD, share: float = SHARE) -> str:
    parser = Lines()
    parser.feed(CUT_OFF.sub("", html))
    parser.close()
    parser.cut()
    wanted = wanted_lines(parser, share)
    if not wanted:
        return ""
    content = [x for x in content_lines(wanted, sigma, threshold) if not x.ends_page()] or wanted
    return "\n".join(x.text for x in extended(parser, wanted, region(parser, wanted, content, share)))


def extract(sigma: float, threshold: float, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(h, sigma, threshold, share) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def html_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = SIGMA, threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: the article's blocks in page order, one to a line.

    Character references are decoded, white space in a block is one space; nothing of the article is dropped or cut. Null
    and empty pages, and pages with markup only, give an empty text. Tags that are left open or cut off are tolerated; a link that is left open ends with its block. Pages are
    taken one by one: repeated rows give repeated rows, ids and urls may be null, other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extract(sigma, threshold, share), "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(read_table(spark, sf_dir, "pages"))
