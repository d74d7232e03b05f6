"""Operator 2: main text of web pages from flat text blocks and a decision tree.

Method: a page is cut into a flat list of text blocks at block-level tags. A block has its number of words, its
link density (words inside <a>), the same of the blocks before and after it, and what the open elements around it
say: whether one is an article, a page part such as nav or footer, a form, or is named like boilerplate (ad,
comment, sidebar, cookie notice). A decision tree, grown when the module is first used, says which blocks are main
text. It learns from the small labelled table LAYOUTS: pages of many kinds whose blocks are marked by hand. Where
elements say nothing, as in pages of plain divs or tables, words and link densities of a block and its neighbours
decide. Of a page of which it takes nothing, blocks stay that no element, name or link speaks against.

Null html counts as empty and gives an empty text. Scripts, styles, markup comments, templates and the head are
skipped; a tag or comment that is cut off by the end of the page ends it. A tag whose quotes never close ends at the
next angle bracket, and so do the tags after it. Every character is read a bounded number of times, so time grows with
the length of a page. Character references are decoded, white space inside a block becomes one space, blocks are
joined by one newline in page order. Nothing else is dropped or capped. Rows are independent: ties, repeated rows and
nulls in other columns change nothing. Carried columns named text or n_chars give way to the results.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
SKIPPED = frozenset("script style template head noframes iframe object svg math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PAGE_PARTS = frozenset("nav footer header aside menu dialog".split())
FORM_PARTS = frozenset("form button select option textarea fieldset label legend".split())
ARTICLES = frozenset("article main".split())
#: Tags that end one of their own kind right before them.
ITEMS = frozenset("li td tr th dt dd option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_NAMES = re.compile(r"articles?|main|contents?|posts?|story|entry|body|text|articlebody", re.I)
#: Words that a boilerplate name is or, as commentlist and adsbygoogle do, begins with; networks and consent tools by their names.
BOILERPLATE_NAMES = re.compile(r"(ads?|ads(?:by|lot|ense)\w*|ad(?:unit|box|slot|space|zone|banner|container)s?|advert\w*|banners?|promo\w*|sponsor\w*|comment(?!ar)\w*|replies|reply|respond|sidebar\w*|side|rail|widgets?|menus?|nav\w*|breadcrumb\w*|toolbar|footer|foot|header|masthead|cookie\w*|consent\w*|gdpr|notice|alert|popup\w*|modal|overlay|newsletter\w*|subscri\w*|signup|login|share|sharing|social\w*|related\w*|recommend\w*|teasers?|trending|morelinks|tags?|pagination|pager|copyright|legal|disclaimer|search|skip\w*|disqus\w*|outbrain\w*|taboola\w*|mgid|cybot\w*|onetrust\w*|didomi\w*)\d*", re.I)
#: Parts of names that tell nothing.
PLAIN = re.compile(r"site|page|global|list|items?|box|block|links?|bar|buttons?|icons?|area|section|inner|slot|unit|title|form|top|bottom|dialog|root|\d+", re.I)
#: Where a capital begins a word of a name, as in articleBody.
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: A tag whose quotes close, a tag up to the next angle bracket, what else begins with an angle bracket, and text.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>?")
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
ATTRIBUTES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop|style)\b(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
ENDS_OF = {t: re.compile(rf"</{t}\b[^>]*+(?:>|\Z)|\Z", re.I) for t in SKIPPED - {"head"}}
END_OF_HEAD = re.compile(r"</head\b[^>]*+(?:>|\Z)|<body\b", re.I)

#: What the tree sees of a block, in this order.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_article", "in_page_part", "in_form", "boilerplate_name", "heading")
# The labelled table. {n} stands for a block or a link of n words, {+n} for one that is main text.
LAYOUTS = [
    # an article among page parts
    '<header><a>{2}</a></header><nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav><article><h1>{+8}</h1><p>{+40}</p><p>{+12}</p><h2>{+3}</h2><p>{+60}</p><ul><li>{+4}</li><li>{+9}</li></ul><blockquote>{+15}</blockquote><p><a>{+6}</a></p></article><aside><h3>{2}</h3><p><a>{5}</a></p></aside><footer><p>{12}</p></footer>',
    '<nav><a>{1}</a></nav><div class="ad">{10}</div><article><h1>{+7}</h1><p>{+1}</p><p>{+90}</p><p>{+2}</p></article><footer>{14}</footer>',
    '<div class="ad">{25}</div><article><p>{+3}</p></article><footer>{6}</footer>',
    '<article><header><h1>{+6}</h1><p>{+5}</p></header><p>{+50}</p><footer><a>{1}</a> <a>{2}</a></footer></article>',
    '<article><h2>{+5}</h2><p>{+30}</p><div class="ad">{12}</div><p>{+35}</p><div class="share"><a>{1}</a></div><div class="related"><h3>{2}</h3><a>{8}</a><a>{7}</a></div></article>',
    '<article><p>{+70}</p><section class="comments"><h3>{2}</h3><p>{30}</p><p>{55}</p><form><label>{1}</label><button>{2}</button></form></section></article>',
    '<main><table><tr><td>{+1}</td><td>{+2}</td></tr><tr><td>{+4}</td><td><a>{+1}</a></td></tr></table><p>{+25}</p></main><div class="newsletter"><p>{18}</p><form><label>{2}</label><button>{1}</button></form></div>',
    '<main><ol><li><a>{+3}</a></li><li><a>{+5}</a></li></ol><dl><dt>{+1}</dt><dd>{+14}</dd></dl><pre>{+30}</pre></main>',
    '<main><h1>{+4}</h1><p>{+20}</p><aside><p>{22}</p></aside><p>{+28}</p><nav><a>{1}</a><a>{1}</a></nav></main>',
    '<div id="cookie-notice"><p>{38}</p><button>{1}</button></div><article><p>{+45}</p><p>{+65}</p></article>',
    '<article><p>{+50}</p><p>{+4}</p></article>', '<article><p>{+20}</p><p><a>{+5}</a></p></article>', '<main><h1>{+1}</h1><p>{+5}</p></main>', '<article><p><a>{+2}</a></p></article>', '<article><p>{+90}</p><ul><li><a>{+1}</a></li><li><a>{+9}</a></li></ul></article>',
    '<article><p>{+1}</p><p>{+2}</p><p>{+3}</p><p>{+4}</p><p>{+5}</p></article>', '<main><p><a>{+20}</a></p><p>{+4}</p><p><a>{+3}</a></p><p>{+2}</p></main>', '<article><h1>{+3}</h1><p>{+100}</p><p><a>{+1}</a></p><p>{+5}</p></article>', '<nav><a>{1}</a><a>{2}</a></nav><article><p><a>{+4}</a></p></article>',
    '<article><nav><a>{3}</a></nav><p>{+5}</p><aside>{4}</aside><p>{+6}</p><footer>{5}</footer></article>', '<article><form><p>{4}</p></form><p>{+3}</p><form><p>{40}</p><a>{5}</a></form></article>', '<nav>{4}</nav><p>{+80}</p><footer>{5}</footer>', '<header>{1}</header><aside>{50}</aside><footer>{1}</footer>', '<footer>{40}</footer>', '<form><p>{30}</p></form>', '<form>{2}</form>',
    '<article><p>{+100}</p><p><a>{+4}</a></p><p>{+300}</p><ul><li><a>{+1}</a></li></ul></article>', '<article><p>{+60}</p><h2><a>{+3}</a></h2><p>{+100}</p><h3><a>{+8}</a></h3><p>{+40}</p><ul><li><a>{+1}</a></li></ul></article>', '<main><div><p>{+60}</p><p>{+50}</p></div><ul><li><a>{+1}</a></li></ul></main>', '<article><p>{+3}</p><h2><a>{+50}</a></h2><p>{+300}</p></article>',
    '<article><p>{+1}</p><p><a>{+5}</a></p><p>{+50}</p><p><a>{+1}</a></p><p>{+50}</p></article>', '<article><p>{+20}</p><h2><a>{+1}</a></h2><p>{+500}</p><h2><a>{+9}</a></h2><p>{+2}</p></article>',
    # articles in wrappers that mention page parts
    '<div class="site no-sidebar"><article><h1>{+5}</h1><p>{+44}</p><p>{+3}</p></article></div>',
    '<div class="layout with-sidebar"><div class="entry has-comments"><h1>{+6}</h1><p>{+52}</p><p>{+18}</p><p>{+75}</p></div></div>',
    '<div id="main-content" class="left-side"><h2>{+3}</h2><p>{+33}</p><ul><li>{+6}</li><li>{+7}</li></ul><p>{+41}</p></div>',
    '<div class="legal"><article><p>{+80}</p><p>{+4}</p></article></div>',
    '<div class="page header-fixed"><h1>{+5}</h1><p>{+36}</p><p>{+58}</p></div>',
    '<div class="tag-news"><h1>{+7}</h1><p>{+47}</p><p>{+62}</p><div class="news-tags"><a>{1}</a> <a>{1}</a> <a>{2}</a></div></div>',
    '<div class="with-widgets"><a>{2}</a><a>{1}</a></div><div class="has-sidebar"><p>{+66}</p><p>{+49}</p></div>',
    '<div class="post tag-sport"><div><p>{+60}</p><p>{+50}</p></div><ul><li><a>{1}</a></li></ul></div>', '<div class="entry has-widgets"><p>{+30}</p><p><a>{1}</a> <a>{2}</a></p><p>{+44}</p><p>{+2}</p></div>',
    '<div class="entry has-menu"><ul><li><a>{1}</a></li><li><a>{2}</a></li></ul><p>{+60}</p></div>', '<div class="story no-widgets"><a>{5}</a><p>{+50}</p><a>{1}</a><p>{+100}</p><h3><a>{4}</a></h3><p>{+400}</p></div>',
    # named content, no article element
    '<div id="header"><a>{2}</a></div><div id="nav"><a>{1}</a><a>{1}</a></div><div id="content"><h1>{+6}</h1><p>{+50}</p><p>{+1}</p><p>{+80}</p></div><div id="sidebar"><h3>{2}</h3><p>{20}</p></div><div id="footer"><p>{11}</p></div>',
    '<div class="post-body"><p>{+22}</p><p>{+90}</p><ul><li><a>{+2}</a></li></ul></div><div class="post-comments"><p>{40}</p><p>{28}</p></div>',
    '<div role="main"><h1>{+3}</h1><p>{+16}</p><p>{+4}</p></div><div role="search"><form><label>{1}</label></form></div>',
    '<div class="entry-content"><p>{+120}</p><h3>{+2}</h3><p>{+9}</p></div><div class="entry-footer"><p>{9}</p></div>',
    # plain divs: shapes decide
    '<div><a>{1}</a> <a>{2}</a> <a>{1}</a></div><div><h1>{+6}</h1><p>{+50}</p><p>{+80}</p><p>{+20}</p></div><div>{4}</div>',
    '<div><ul><li><a>{1}</a></li><li><a>{2}</a></li><li><a>{1}</a></li></ul></div><div><p>{+34}</p><p>{+55}</p></div><div><ul><li><a>{4}</a></li><li><a>{6}</a></li></ul></div><div>{5}</div>',
    '<table><tr><td><a>{1}</a><br><a>{2}</a></td><td><p>{+45}</p><p>{+70}</p><p>{+31}</p></td></tr><tr><td>{3}</td></tr></table>',
    '<div><div>{2}</div><div><a>{1}</a></div></div><h2>{+5}</h2><p>{+26}</p><p>{+11}</p><p>{+48}</p><div><a>{7}</a></div><div><a>{9}</a></div>',
    '<div><a>{2}</a></div><p>{+100}</p><p>{+13}</p><p>{+140}</p><div>{2}</div><div><a>{1}</a> {1} <a>{1}</a></div>',
    '<div>{3}</div><div><a>{2}</a></div><div>{2}</div><div><p>{+64}</p></div><div><a>{12}</a></div>',
    '<div><h3>{2}</h3><a>{9}</a></div><div><h3>{2}</h3><a>{11}</a></div><div><h3>{2}</h3><a>{8}</a></div><div><p>{+85}</p><p>{+60}</p></div>',
    '<p>{+55} <a>{+3}</a> {+20}</p><p>{+28}</p><p><a>{5}</a> {2} <a>{6}</a></p><p>{3}</p>',
    '<div>{1}</div><div>{2}</div><div>{1}</div><div><a>{1}</a></div><div>{+38}</div><div>{+44}</div><div>{3}</div><div><a>{2}</a></div>',
    '<div><p>{+50}</p><p>{+30}</p></div><div>{4}</div>', '<div><p>{+60}</p></div><div>{5}</div>', '<p>{+70}</p><p>{+8}</p>', '<div>{4}</div><p>{+40}</p>', '<p>{+90}</p><div>{4}</div><p>{+20}</p><div>{5}</div>', '<div><a>{1}</a></div><div>{5}</div><div><a>{2}</a></div><p>{+30}</p>',
    # pages of little text, and pages of links
    '<p>{+1}</p>', '<p>{+6}</p>', '<div>{+12}</div>', '<h1>{+3}</h1><p>{+8}</p>', '<p>{+150}</p>', '<h1>{+2}</h1>',
    '<h1>{+4}</h1><p>{+9}</p><p>{+15}</p>',
    '<a>{1}</a>', '<ul><li><a>{2}</a></li><li><a>{3}</a></li></ul>', '<div><a>{12}</a></div><div><a>{14}</a></div><div><a>{10}</a></div>',
    # headings and long texts in page parts, forms and boilerplate
    '<header><h1>{3}</h1><h2>{9}</h2></header><p>{+40}</p><p>{+25}</p><footer><h3>{1}</h3><p>{30}</p><h4>{6}</h4></footer>', '<aside><h2>{5}</h2><p>{60}</p></aside><div><h2>{+4}</h2><p>{+40}</p></div>', '<nav><h3>{8}</h3><a>{2}</a></nav><footer><h2>{2}</h2></footer>',
    '<form><h2>{4}</h2><p>{40}</p><h3>{8}</h3><label>{1}</label></form><h2>{+4}</h2><p>{+35}</p>', '<form><h1>{1}</h1><p>{90}</p></form><form><h3>{3}</h3></form>', '<p>{+50}</p><form><p>{25}</p><h2>{6}</h2></form><p>{+60}</p>', '<form><p>{18}</p><p>{60}</p></form><p>{+20}</p><p>{+45}</p>',
    '<div class="sidebar"><h2>{4}</h2><p>{50}</p></div><div class="comments"><h3>{1}</h3><p>{70}</p><h4>{9}</h4></div><h2>{+5}</h2><p>{+60}</p>', '<div class="widget"><h3>{8}</h3></div><div class="popup"><h1>{3}</h1><p>{20}</p></div>',
    '<div class="ad">{2}</div>', '<div class="ad">{1}</div>', '<footer>{3}</footer>', '<nav>{1}</nav>', '<form><h2>{3}</h2><p>{40}</p></form>', '<form><h2>{3}</h2></form>', '<div class="menu"><h3>{3}</h3><p>{30}</p></div>', '<div class="menu"><h3>{3}</h3></div>', '<aside><h3>{3}</h3><p>{9}</p></aside>', '<p class="notice">{3}</p>',
    '<div class="ad"><h3>{1}</h3><p>{4}</p></div>', '<div class="ad"><h3><a>{2}</a></h3><p>{20}</p></div>', '<nav><h2>{1}</h2><p>{4}</p></nav>', '<footer><h2>{3}</h2><p>{20}</p></footer>', '<form><h2>{1}</h2><p>{4}</p></form>', '<form><h4>{2}</h4><p><a>{4}</a></p></form>', '<h1>{+1}</h1><p>{+4}</p>', '<h1>{+3}</h1><p>{+20}</p>', '<h2>{+2}</h2><p>{+60}</p>',
    # forms, notices and hidden elements
    '<form><fieldset><legend>{2}</legend><label>{1}</label><label>{3}</label><button>{1}</button></fieldset></form><div><p>{+40}</p><p>{+30}</p></div>',
    '<main><form><label>{2}</label><p>{30}</p><textarea>{20}</textarea></form><p>{+44}</p></main>',
    '<div class="alert">{24}</div><div class="popup"><p>{35}</p><button>{2}</button></div><div><p>{+57}</p><p>{+39}</p></div><div class="copyright">{10}</div>',
    '<article><p>{+42}</p><p hidden>{30}</p><p>{+5}</p></article><div aria-hidden="true"><p>{60}</p></div>',
    '<div class="banner"><p>{45}</p></div><div class="social"><a>{1}</a></div><p>{+61}</p><p>{+33}</p><div class="disclaimer"><p>{70}</p></div>',
]
#: Every layout is read with its blocks at these multiples of their words.
LENGTHS = (1, 3)


def filled(layout: str, times: int) -> str:
    return re.sub(r"\{(\+?)(\d+)\}", lambda m: " ".join([f"m{m[1]}"] * (int(m[2]) * (times if int(m[2]) > 5 else 1))), layout)


@lru_cache(1)
def labelled() -> list[tuple]:
    """FEATURES of the blocks of all layouts, and 1 for main text."""
    return [(*block, int("m+" in text)) for layout in LAYOUTS for k in LENGTHS for text, block in blocks_of(filled(layout, k))]


def grow(rows: list[tuple], depth: int = 12):
    """A decision tree by Gini impurity: (feature, threshold, left, right), or the share of main text at a leaf."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            sides = [r[-1] for r in rows if r[f] <= cut], [r[-1] for r in rows if r[f] > cut]
            impurity = sum(len(s) * (p := sum(s) / len(s)) * (1 - p) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best is None:
        return share
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[f] <= cut], depth - 1), grow([r for r in rows if r[f] > cut], depth - 1)


@lru_cache(1)
def tree():
    return grow(labelled())


def is_main(block: tuple, node=None) -> bool:
    node = tree() if node is None else node
    while isinstance(node, tuple):
        node = node[2] if block[node[0]] <= node[1] else node[3]
    return node >= 0.5


@lru_cache(1 << 12)
def naming(token: str) -> tuple[int, bool]:
    """Of a token of class, id or role: 2 if it names boilerplate, alone or beside parts that tell nothing or what it
    belongs to (site-footer, post-comments), 1 if it mentions such a name among other words, as wrappers of whole pages
    do (with-sidebar, tag-news); and whether it names an article (main, entry-content)."""
    parts = [x for x in re.split("[_-]+", HUMP.sub("-", re.sub("more-links", "morelinks", token, flags=re.I))) if x]
    bad = [bool(BOILERPLATE_NAMES.fullmatch(x)) for x in parts]
    good = [bool(ARTICLE_NAMES.fullmatch(x)) for x in parts]
    plain = all(b or g or PLAIN.fullmatch(x) for x, b, g in zip(parts, bad, good, strict=True))
    return (0 if not any(bad) else 2 if plain else 1), plain and any(good) and not any(bad)


#: The degree of a name, until the whole page is read, of an article in a wrapper that is named like boilerplate.
IN_WRAPPER = 3
#: Of an open element: its tag and, for what is in it: article, page part, form, boilerplate name, heading.
NOTHING = ("", 0, 0, 0, 0, 0)


class Blocks:
    """The flat text blocks of a page."""

    def __init__(self, page: str):
        #: (text, words, words in links, in article, in page part, in form, boilerplate name, heading)
        self.found: list[tuple] = []
        self.open: list[tuple[str, int, int, int, int, int]] = []
        #: How often block tags are open, and inline tags in each open block.
        self.blocks: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]
        self.held: list[str] = []
        self.linked: list[str] = []
        self.in_link = 0
        self._read(page)
        self._flush()
        teasers = 2 if any(b[3] and not b[4] and b[6] < 2 for b in self.found) else 0
        self.found = [(*b[:6], teasers if b[6] == IN_WRAPPER else b[6], *b[7:]) for b in self.found]

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.held)).split())
        if text:
            words = text.count(" ") + 1
            links = len(entities.unescape(" ".join(self.linked)).split())
            self.found.append((text, words, min(links, words), *self._around()[1:]))
        self.held.clear()
        self.linked.clear()

    def _around(self) -> tuple[str, int, int, int, int, int]:
        return self.open[-1] if self.open else NOTHING

    def _begin(self, tag: str, raw: str) -> None:
        if tag in BLOCK_TAGS:
            self._flush()
            if self.blocks["p"]:
                self._end("p")
        if tag in ITEMS and self._around()[0] == tag:
            self._end(tag)
        if tag == "br":
            self.held.append(" ")
        if tag in VOID or raw.rstrip().endswith("/"):
            return
        _, article, part, form, named, heading = self._around()
        own, hidden, called = 0, False, False
        for m in ATTRIBUTES.finditer(raw):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id", "role", "itemprop"):
                for token in value.split():
                    bad, good = naming(token)
                    own, called = max(own, bad), called or good
            elif name == "hidden" or (name == "aria-hidden" and "true" in value) or "display:none" in value.replace(" ", ""):
                hidden = True
        outer = article
        if tag in ARTICLES or called:
            article = 1
        if (tag in PAGE_PARTS and not (tag == "header" and outer)) or (hidden and tag not in ("html", "body", "article", "main")):
            part = 1
        if tag in FORM_PARTS:
            form = 1
        if tag in ARTICLES:
            # a wrapper's name says nothing of an article in it, but one among comments is a comment if it says so, and
            # one that is wrapped so beside articles that are not (IN_WRAPPER) is a teaser
            named = 2 if named == own == 2 else IN_WRAPPER if tag == "article" and named in (2, IN_WRAPPER) else 0
        elif tag not in ("html", "body"):
            named = 2 if own == 2 else max(named, own)
        if tag in HEADINGS:
            heading = 1
        self.open.append((tag, article, part, form, named, heading))
        if tag in BLOCK_TAGS:
            self.blocks[tag] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        if tag == "a":
            self.in_link += 1

    def _end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self._flush()
        # an inline end tag closes nothing beyond its block
        if not (self.blocks if tag in BLOCK_TAGS else self.inline[-1])[tag]:
            return
        while True:
            last = self.open.pop()[0]
            if last in BLOCK_TAGS:
                self.blocks[last] -= 1
                self.inline.pop()
            else:
                self.inline[-1][last] -= 1
            self.in_link -= last == "a"
            if last == tag:
                return

    def _read(self, page: str) -> None:
        at, tag_at = 0, TAG
        while at < len(page):
            if page[at] != "<":
                end = page.find("<", at)
                self._say(page[at : end if end >= 0 else len(page)])
                at = end if end >= 0 else len(page)
                continue
            m = tag_at.match(page, at)
            if m is None and tag_at is TAG and LOOSE_TAG.match(page, at):
                tag_at = LOOSE_TAG  # no quote or tag closes any more: looking for one again and again would take long
                m = tag_at.match(page, at)
            if m is None:
                other = OTHER.match(page, at)
                if other is None:
                    self._say("<")
                at = other.end() if other else at + 1
                continue
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in ENDS_OF and not m[3].rstrip().endswith("/"):
                at = ENDS_OF[tag].search(page, at).end()
            elif tag == "head":
                close = END_OF_HEAD.search(page, at)
                at = (close.end() if close[0].startswith("</") else close.start()) if close else len(page)
            else:
                self._begin(tag, m[3])

    def _say(self, text: str) -> None:
        self.held.append(text)
        if self.in_link:
            self.linked.append(text)


def blocks_of(page: str) -> Iterator[tuple[str, tuple]]:
    """The text and the FEATURES of every block."""
    blocks = Blocks(page).found
    edge = ("", 0, 0)
    for k, b in enumerate(blocks):
        before, after = blocks[k - 1] if k else edge, blocks[k + 1] if k + 1 < len(blocks) else edge
        density = [x[2] / x[1] if x[1] else 0.0 for x in (b, before, after)]
        # an article whose names mention boilerplate is one of a lower degree
        article = b[3] * (1 if b[6] else 2)
        yield b[0], (b[1], density[0], before[1], density[1], after[1], density[2], article, *b[4:])


def main_text(page: str) -> str:
    """The blocks that the tree takes for main text; where it takes none, those that nothing speaks against: in no page
    part or form, not named like boilerplate, and no more than half links."""
    blocks = list(blocks_of(page))
    chosen = [text for text, block in blocks if is_main(block)]
    return "\n".join(chosen or [text for text, b in blocks if not (b[7] or b[8] or b[9]) and b[1] <= 0.5])


def extract(df: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """What is carried, text and n_chars of every page."""

    @F.arrow_udf("string")
    def run(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in pages:
            yield pa.array((main_text(t.as_py()) for t in b), pa.string())

    texts = df.select(*(c for c in carry if c not in ("text", "n_chars")), run(F.coalesce(F.col(column), F.lit(""))).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
