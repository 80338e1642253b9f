"""Main text of web pages by two passes of block rules.

A page's markup is read once into blocks: text between block-level tags, with the share of it
that is in links and where the block stands. The first pass decides from a block alone:

- markup: blocks of menus, page headers, footers, sidebars, notices, adverts, forms and comments
  are boilerplate;
- links: blocks that are mostly links are boilerplate, or, short ones in a sentence of an article,
  undecided;
- density: long blocks with many stop words are content, blocks with few are boilerplate, what is
  too short or between is undecided.

The bounds of the last rule depend on the place: lower within an article element, where blocks
without stop words (another language, a table) stay undecided at worst, and higher beside one. The
second pass gives an undecided block the label of its nearest decided neighbours in the same
place; without any, the place decides. Time is linear in the page's length.

Cases: null and empty pages have an empty text; broken or cut markup is read as far as it goes;
repeated rows each get a row; an empty table gives no rows. Blocks are kept whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could do for from had has have he her his if in into is it its"
    " more no not of on one or our out she so some than that the their them there they this to was we were what when which who"
    " will with would you your"
    " aber als am auch auf aus bei bin bis das dass dem den der des die dich du ein eine einem einen einer er es für hat ich ihr"
    " im ist ja kein man mich mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir zu zum zur"
    " au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même mes moi mon ne nos notre"
    " nous on ont ou où par pas pour qu que qui sa sans se ses son sur ta te tu un une vous y été"
    " al como con cuando del desde donde el ella en entre era esta este fue ha hasta hay la las lo los más mi muy nada ni o para"
    " pero por porque que quien se ser si sin sobre su sus también te tiene toda todo una uno unos ya".split()
)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form frame h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section"
    " select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes xmp".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button select head noscript template svg canvas object label fieldset".split())
ARTICLE_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id attributes, and roles, of what isn't the article.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar comment"
    " comments respond reply replies discussion disqus widget toolbar disclaimer copyright search skip".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: By place: characters from which a block is long enough to tell, and to be content; shares of
#: stop words below which it is boilerplate, and from which it is content.
BOUNDS = {"article": (40, 60, 0.0, 0.1), "beside": (70, 280, 0.25, 0.4), "page": (70, 140, 0.15, 0.25)}
LINKS_HIGH = 0.5
#: What a page's undecided blocks are where none of their place is decided.
ALONE = {"article": "content", "beside": "boilerplate", "page": "content"}

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
#: After the last ">".
CUT = re.compile(r"<!--.*|<[!?/a-zA-Z].*", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass
class Block:
    text: str
    link_chars: int
    boilerplate: bool
    in_article: bool
    heading: bool
    #: content, boilerplate or short (undecided), and the rule that said so
    label: str = ""
    rule: str = ""


@dataclass
class _Open:
    tag: str
    boilerplate: bool
    article: bool


class _Stack:
    """Open elements, with counts of what a block stands in and the places of each tag."""

    def __init__(self):
        self.open: list[_Open] = []
        self.at: dict[str, list[int]] = {}
        self.boilerplate = self.articles = 0

    def count(self, *tags: str) -> int:
        return sum(len(self.at.get(t, ())) for t in tags)

    def push(self, o: _Open) -> None:
        self.at.setdefault(o.tag, []).append(len(self.open))
        self.open.append(o)
        self.boilerplate += o.boilerplate
        self.articles += o.article

    def _leave(self, o: _Open) -> None:
        self.boilerplate -= o.boilerplate
        self.articles -= o.article
        o.boilerplate = o.article = False

    def pop(self) -> None:
        o = self.open.pop()
        self._leave(o)
        if o.tag:
            self.at[o.tag].pop()

    def close(self, tag: str) -> None:
        """The innermost element of a tag ends, and all in it."""
        if self.at.get(tag):
            end = self.at[tag][-1]
            while len(self.open) > end:
                self.pop()

    def forget(self, tag: str) -> None:
        """Nothing stands in elements of a tag from here on."""
        for i in self.at.pop(tag, ()):
            self._leave(self.open[i])
            self.open[i].tag = ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _named_boilerplate(raw: str) -> bool:
    if not raw or "=" not in raw and "hidden" not in raw:
        return False
    a = _attributes(raw)
    if a.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    return not BOILERPLATE_NAMES.isdisjoint(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{a.get('class', '')} {a.get('id', '')}").lower()))


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    stack = _Stack()
    in_link, link_parts, breaks, at, n = 0, [], 0, 0, len(page)
    last_end = page.rfind(">")

    def close() -> None:
        nonlocal breaks
        breaks = 0
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            links = len(" ".join(html.unescape(" ".join(link_parts)).split()))
            in_article, heading = stack.articles > 0, stack.count(*HEADINGS) > 0
            # a header of the article may hold its title
            out.append(Block(text, links, stack.boilerplate > 0 or stack.count("header") > 0 and not (in_article and heading), in_article, heading))
        parts.clear()
        link_parts.clear()

    while at < n:
        m = MARKUP.search(page, at) if at <= last_end else CUT.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            if not text.isspace():
                breaks = 0
            parts.append(text)
            if in_link:
                link_parts.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower() if m.re is MARKUP else ""
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            parts.append("\n")
            if breaks > 1:
                close()
            continue
        if tag in BLOCK_TAGS:
            close()
        if tag == "a":
            in_link = 0 if m[1] else 1
        if m[1]:
            stack.close(tag)
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 or n if end else n
            continue
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        if stack.open and (tag in BLOCK_TAGS and stack.open[-1].tag == "p" or tag == "li" and stack.open[-1].tag == "li"):
            stack.pop()
        if tag == "body" or tag in ARTICLE_TAGS:  # neither stands in a head or an open menu
            stack.forget("head")
            stack.forget("nav")
        stack.push(_Open(tag, tag in BOILERPLATE_TAGS or tag not in ("html", "body") and _named_boilerplate(m[3]), tag in ARTICLE_TAGS or 'role="main"' in m[3]))
    close()
    return out


def stop_density(text: str) -> float:
    words = [w.strip(".,;:!?\"'()[]#*$%&|<>-").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def places(blocks: list[Block]) -> list[str]:
    """article, beside (an article), or page (without one), of each block."""
    has_article = any(b.in_article and not b.boilerplate for b in blocks)
    return ["article" if b.in_article else "beside" if has_article else "page" for b in blocks]


def decide(blocks: list[Block]) -> None:
    """First pass: content, boilerplate, or short (undecided)."""
    for b, place in zip(blocks, places(blocks), strict=True):
        short, long, low, high = BOUNDS[place]
        size = len(b.text)
        if b.boilerplate:
            b.label, b.rule = "boilerplate", "markup"
        elif b.link_chars > LINKS_HIGH * size:
            # a short run of links between paragraphs may be part of a sentence
            b.label, b.rule = "short" if place == "article" and size < BOUNDS["page"][0] and not b.heading else "boilerplate", "links"
        elif size < short:
            b.label, b.rule = "short", "length"
        else:
            stop = stop_density(b.text)
            b.label, b.rule = "content" if stop >= high and size >= long else "short" if stop >= low else "boilerplate", "density"


def settle(blocks: list[Block]) -> None:
    """Second pass: undecided blocks take the label of the nearest block of their place that the
    first pass decided, the one before where both are as near; a heading looks ahead only. Where
    there is none, ALONE. What markup decides within an article is no neighbour: an advert between
    paragraphs says nothing of them."""
    where = places(blocks)
    before, after = [None] * len(blocks), [None] * len(blocks)
    for found, order in ((before, range(len(blocks))), (after, range(len(blocks) - 1, -1, -1))):
        last: dict[str, int] = {}
        for i in order:
            found[i] = last.get(where[i])
            if blocks[i].label != "short" and (blocks[i].rule != "markup" or where[i] != "article"):
                last[where[i]] = i
    new = {}
    for i, b in enumerate(blocks):
        if b.label == "short":
            x, y = before[i] if not b.heading else None, after[i]
            near = y if x is None else x if y is None or i - x <= y - i else y
            new[i] = (ALONE[where[i]], "place") if near is None else (blocks[near].label, "neighbour")
    for i, (label, rule) in new.items():
        blocks[i].label, blocks[i].rule = label, rule


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    decide(blocks)
    settle(blocks)
    return "\n".join(b.text for b in blocks if b.label == "content")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
