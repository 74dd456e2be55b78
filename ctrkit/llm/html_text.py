"""Operator 8: main text of web pages by two passes of block rules.

The markup is read in one go into blocks: text between block-level tags, with its length, its
share of link text, its stop-word density and the containers around it.

Pass 1, each block alone: blocks in containers that name themselves menus, headers, footers,
sidebars, notices, adverts, forms or reader comments are boilerplate, as are blocks that are
mostly links and, outside an article element, long blocks with few stop words; long blocks with
many stop words are text. What is left is ambiguous: short, or of middling density.

Pass 2, in context: an ambiguous block inherits the label of the nearest decided neighbours. The
edges of an article element count as text that is decided, and the edges of the page as
boilerplate, so an article keeps its short lines whatever surrounds it.

An article element is a prior and no switch: blocks outside it are decided as on a page without
one; inside, middling density is text, low density is ambiguous, and neighbours that disagree give
text. Names that prose may have too ("related work") count inside an article only for a container
without a long block of text. Stop words are those listed and the short words that many pages hold, in
whatever language; scripts that write no blanks are told by their sentence signs.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrkit.llm.common import in_slices, texts_of

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))|[^>=]+|=)*)(>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")

# Names of HTML elements.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
             "span strike strong sub sup time tt u var wbr img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = {"article", "main"}
PAGE = {"html", "body"}
BOILERPLATE = set("nav footer aside form head script style noscript template textarea select option button title "
                  "iframe object svg menu dialog datalist optgroup fieldset canvas audio video map math".split())
# Words of class names, ids and roles that tell what a container is for.
BOILERPLATE_NAMES = set(
    "nav navbar navigation menu menus submenu topbar breadcrumb breadcrumbs header masthead banner footer foot colophon "
    "sidebar aside rail widget widgets ad ads advert adverts advertisement adsense sponsor sponsored promo promotion "
    "notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login form search "
    "searchform comment comments commentlist disqus replies reply respond social share sharing related recommended "
    "pagination pager skip toolbar copyright disclaimer complementary contentinfo dialog alert".split())
# Names that are boilerplate on a page but belong to the article inside one.
PAGE_ONLY = {"header", "masthead", "banner"}
# Names that prose inside an article may have too: there a long block of text overrules them.
WEAK_NAMES = set("related recommended search form notice notices alert widget widgets social share sharing promo promotion "
                 "rail dialog disclaimer copyright response respond replies reply".split())
# Scripts that write words without blanks, and the signs that end or divide their sentences.
NO_BLANKS = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
SENTENCE_SIGNS = re.compile("[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f]")
# Stop words of the languages at hand.
STOP_WORDS = set(
    "the of and to in a is that it for on was with as be by at from or an this are not but which he his they have "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des et un une du en que qui dans pour pas au sur ne se ce il est par plus avec son sont aux ou "
    "el los las y del se por con una su para como más al lo fue sus pero le ya o este sí porque esta entre".split())

#: Most letters of a short word, how many of them join the stop words, and the share of the pages, two at least,
#: that must hold each.
SHORT_WORD, FREQUENT_WORDS, FREQUENT_SHARE = 4, 300, 0.05

SHORT_CHARS = 70
LONG_CHARS = 200
LOW_DENSITY, HIGH_DENSITY = 0.15, 0.30
LINK_SHARE = 0.5
#: Characters of prose in a script without blanks to one sentence sign, at most.
SIGN_EVERY = 60
TEXT, BAD, UNSURE = 1, 0, None


class Block:
    """``doubt`` is the number of the weakly named container around, or 0."""
    __slots__ = ("text", "links", "article", "boilerplate", "doubt", "label")

    def __init__(self, text: str, links: int, article: int, boilerplate: bool, doubt: int = 0):
        self.text, self.links, self.article, self.boilerplate, self.doubt = text, links, article, boilerplate, doubt
        self.label = UNSURE


def names_boilerplate(attributes: str, in_article: bool) -> bool | None:
    """Whether the attributes say that the element is hidden or holds no main text; None if only weakly."""
    doubt = False
    for m in ATTRIBUTE.finditer(attributes):
        name, raw = m[1].lower(), m[2] or m[3] or m[4] or ""
        value = raw.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role"):
            words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", raw).lower()))
            named = words & BOILERPLATE_NAMES - (PAGE_ONLY if in_article else set())
            if in_article and named and named <= WEAK_NAMES:
                doubt = True
            elif named:
                return True
    return None if doubt else False


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page, in order; character references decoded, white space single."""
    blocks: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    # Open containers: (name, number of the article around, boilerplate, number of the doubtful container).
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
    articles = doubts = link_depth = 0

    def close_block() -> None:
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, len(" ".join("".join(links).split())), *stack[-1][1:]))
        parts.clear()
        links.clear()

    def add(raw: str) -> None:
        text = unescape(raw)
        parts.append(text)
        if link_depth:
            links.append(text)

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                link_depth = max(0, link_depth - 1)
            if name not in INLINE:
                close_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if name in INLINE:
                        close_block()
                    del stack[i:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>|$(?![\r\n])", re.IGNORECASE).search(html, at)
            at = end.end()
            continue
        if name == "a":
            link_depth = 1
        _, article, bad, doubt = stack[-1]
        hidden = name not in VOID | ARTICLE | PAGE and names_boilerplate(m[3], article > 0)
        if name in INLINE and not hidden and hidden is not None:
            continue
        close_block()
        if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
            continue
        if name == "p" and stack[-1][0] == "p":
            stack.pop()
            _, article, bad, doubt = stack[-1]
        if name in ARTICLE and not article:
            articles += 1
            article = articles
        if hidden is None and not doubt:
            doubts += 1
            doubt = doubts
        bad = bool(bad or hidden or name in BOILERPLATE or name == "header" and not article)
        stack.append((name, article, bad, doubt))
    close_block()
    return blocks


def words_of(text: str) -> list[str]:
    return [w.strip(".,;:!?") for w in text.lower().split()]


def measured(text: str, stop_words: set[str]) -> tuple[int, float]:
    """(length, stop-word density). Scripts without blanks have no words to count: a character counts
    for two, and prose is told by its sentence signs."""
    dense = len(NO_BLANKS.findall(text))
    if 2 * dense >= len(text):
        prose = len(SENTENCE_SIGNS.findall(text)) * SIGN_EVERY >= len(text)
        return len(text) + dense, HIGH_DENSITY if prose else 0.0
    words = words_of(text)
    return len(text), sum(w in stop_words for w in words) / len(words)


def decide(block: Block, stop_words: set[str] = STOP_WORDS) -> int | None:
    """Pass 1: the label of a block by itself, or none."""
    if block.boilerplate or block.links > LINK_SHARE * len(block.text):
        return BAD
    size, density = measured(block.text, stop_words)
    if size >= LONG_CHARS and density >= HIGH_DENSITY:
        return TEXT
    if block.article:
        return TEXT if size >= SHORT_CHARS and density >= LOW_DENSITY else UNSURE
    if size >= SHORT_CHARS:
        return BAD if density < LOW_DENSITY else TEXT if density >= HIGH_DENSITY else UNSURE
    return UNSURE


def classify(blocks: list[Block], stop_words: set[str] = STOP_WORDS) -> None:
    """Both passes."""
    for b in blocks:
        b.label = decide(b, stop_words)
    prose = {b.doubt for b in blocks if b.label == TEXT and measured(b.text, stop_words)[0] >= LONG_CHARS}
    for b in blocks:
        if b.doubt and b.doubt not in prose:
            b.label = BAD
    decided = [b.label for b in blocks]
    # Nearest decided label on either side; an article's edges are text, the page's are not.
    def nearest(order):
        found, last, article = {}, BAD, 0
        for i in order:
            b = blocks[i]
            if b.article != article:
                article, last = b.article, TEXT if b.article else BAD
            if decided[i] is not UNSURE:
                last = decided[i]
            found[i] = last
        return found

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    for i, b in enumerate(blocks):
        if b.label is UNSURE:
            both = before[i] + after[i]
            b.label = TEXT if both == 2 or both == 1 and (b.article or len(b.text) >= SHORT_CHARS) else BAD


def main_text(html: str, stop_words: set[str] = STOP_WORDS) -> str:
    blocks = blocks_of(html)
    classify(blocks, stop_words)
    return " ".join(b.text for b in blocks if b.label == TEXT)


def stop_words_of(pages: DataFrame, html_col: str = "html") -> set[str]:
    """``STOP_WORDS`` and the short words that many pages hold outside boilerplate containers and links."""
    def count(batches):
        for batch in in_slices(batches, "html"):
            held: Counter[str] = Counter()
            for html in texts_of(batch, "html").to_pylist():
                held.update({w for b in blocks_of(html) if not b.boilerplate and b.links <= LINK_SHARE * len(b.text)
                             for w in words_of(b.text) if len(w) <= SHORT_WORD and w.isalpha()})
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    counts = pages.select(F.col(html_col).alias("html")).mapInArrow(count, "word string, n long")
    least = max(2, FREQUENT_SHARE * pages.count())
    best = (counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            .orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).collect())
    return STOP_WORDS | {r.word for r in best}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per page.

    A null page is empty; a page without main text has the empty text; repeated rows and null ids
    are kept; markup that ends in the middle of a tag ends there; an empty table gives no rows;
    other columns are ignored.
    """
    stop_words = stop_words_of(pages, html_col)

    def read(batches):
        for batch in in_slices(batches, "html"):
            texts = [main_text(h, stop_words) for h in texts_of(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
