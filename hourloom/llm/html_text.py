"""Main text of web pages by two passes of block rules.

A page is read tag by tag into blocks, the text between block-level tags, each with its length, its share of characters in links and
its share of stop words. Blocks in elements that say what they are (navigation, forms, asides, adverts, comments, ...) are boilerplate.
Pass 1 decides the others by themselves: mostly links is boilerplate, long enough with enough stop words is text, the rest
is ambiguous (short, or of words we cannot judge). Pass 2 gives ambiguous blocks the label of the nearest decided
block, the text's if both are as near. If a page names its article (<article>, <main>), the blocks outside are boilerplate, and
ambiguous blocks in an article without any block decided as text are text; elsewhere they are dropped then.

Words in class and id count name by name. A name that only says how things are (has-sidebar, comments-open) says nothing. A name of
such words and of PLAIN_WORDS alone (comment-list) drops the element, any other with such a word in it (content-sidebar-wrap) does
unless the elements of that name hold most of the page's long text with few links. <main>, an <article> other than of a comment, and, if
all articles are inside named elements, those around the page's article are never dropped by a name.

The stop words are of four languages. If most of a page's long blocks with few links have hardly any of them (FOREIGN), the page is in
another language, and there length and links decide alone: long blocks with few links are text.

Output: the blocks in page order, white space inside a block as one space, trimmed, joined by two newlines; nothing is cut off.

Defined cases: null and empty pages and pages without text give an empty text; broken markup is read as far as it makes sense (a
tag left open ends with the element around it); repeated rows give repeated results; other columns are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LINKS_BAD, LINKS_FEW, STOP_GOOD, SHORT = 0.5, 0.2, 0.1, 70
# Text of the four languages has a stop word in KNOWN of its words at least; a page is foreign if less than FOREIGN of its long text has.
KNOWN, FOREIGN = 0.2, 0.25

# Element names by role, words in class and id that mark boilerplate, stop words of four languages.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot
    th thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
SPACE_TAGS = frozenset("br img wbr input".split())
DROPPED_TAGS = frozenset(
    """applet aside audio button canvas datalist dialog footer form frameset head iframe input label map menu nav noframes noscript object
    option script search select style svg template textarea title video""".split()
)
ARTICLE_TAGS = frozenset("article main".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_WORDS = frozenset(
    """ad ads adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent
    cookie cookies copyright disclaimer discussion disqus dropdown feedback footer gdpr login masthead menu menus modal nav navbar navigation
    newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies
    reply respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar
    widget widgets""".split()
)
# Words that say no more about a dropped one, and words that make a name say how the element or the page is.
PLAIN_WORDS = frozenset(
    """area author bar block body bottom box button buttons card center first fixed form global header heading item
    items label last left link links list lower meta mobile native nested new old post primary right secondary site slot small
    sticky sub tab text thread title top upper unit""".split()
)
STATE_WORDS = frozenset("closed disabled enabled has is no not off on open status with without".split())
COMMENT_WORDS = frozenset("comment comments replies reply respond response responses".split())
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was we were
    which will with you au aux ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son
    sur un une vous aber als auch auf aus bei das dass dem den der die ein eine einem einen einer er es für hat ich im ist mit nach nicht sich sie
    sind und von vor war wie wird zu zum zur al como con del el ella esta este ha la las lo los más muy no o para pero por se sin su sus una y ya""".split()
)
_NAME_PARTS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_LETTERS = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_boilerplate(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    if tag in DROPPED_TAGS or (tag == "header" and not in_article):
        return True
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and _HIDDEN.search(value)):
            return True
        if name == "role" and value and value.strip().lower() in DROPPED_ROLES:
            return True
    return False


class Mark:
    """An element that a name says is boilerplate. `names` are those that say it only in part; none if one says it wholly."""

    __slots__ = ("names", "kept", "around", "first_said", "weight", "drops")

    def __init__(self, names: frozenset[str]):
        self.names, self.kept = names, False
        self.around: Mark | None = None  # the next mark outwards
        self.first_said: list[str] = []  # names that no mark around says
        self.weight, self.drops = 0, False


def _mark(tag: str, attrs: list[tuple[str, str | None]], in_article: bool, is_first: bool) -> Mark | None:
    if tag in ("html", "body", "main"):
        return None
    in_part = set()
    for name, value in attrs:
        if name not in ("class", "id") or not value:
            continue
        for said in value.split():
            parts = _NAME_PARTS.findall(_CAMEL.sub(" ", said).lower())
            dropped = [x for x in parts if x in DROPPED_WORDS or (x == "header" and not in_article)]
            if not dropped or not STATE_WORDS.isdisjoint(parts):
                continue
            wholly = all(x in dropped or x in PLAIN_WORDS or x.isdigit() for x in parts)
            if tag in ARTICLE_TAGS:
                if wholly and not is_first and not COMMENT_WORDS.isdisjoint(dropped):
                    return Mark(frozenset())
            elif wholly:
                return Mark(frozenset())
            else:
                in_part.add(said)
    return Mark(frozenset(in_part)) if in_part else None


class Block:
    __slots__ = ("text", "linked", "dropped", "article", "mark", "size", "weight", "_stops")

    def __init__(self, text: str, linked: int, dropped: bool, article: bool, mark: Mark | None = None):
        self.text, self.linked, self.dropped, self.article, self.mark = text, linked, dropped, article, mark
        self.size, self.weight, self._stops = len(text) - text.count(" "), weight(text), None

    def stops(self) -> float:
        if self._stops is None:
            self._stops = stop_share(self.text)
        return self._stops


class BlockReader(HTMLParser):
    """Collects the blocks of one page. The stack holds open elements with what they say about their text.

    Open elements are counted by tag, and marks know the one around them, so the work grows with the page however deep it is nested.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, bool, bool, Mark | None]] = []  # tag, dropped, in article, innermost mark
        self.articles: list[tuple[str, Mark | None]] = []  # tag and the innermost mark around it
        self.marks: list[Mark] = []  # outer ones first
        self.open: Counter[str] = Counter()  # open elements by tag
        self.open_names: Counter[str] = Counter()  # names that marks of open elements say
        self.said: list[str] = []
        self.linked = self.links = 0

    def _state(self) -> tuple[bool, bool, Mark | None]:
        return self.stack[-1][1:] if self.stack else (False, False, None)

    def end_block(self) -> None:
        if self.said:
            text = " ".join("".join(self.said).split())
            if text:
                self.blocks.append(Block(text, self.linked, *self._state()))
            self.said, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS or tag in DROPPED_TAGS:
            self.end_block()
            if tag in BLOCK_TAGS:
                self._close("p")
        elif tag in SPACE_TAGS:
            self.said.append(" ")
        if tag in VOID_TAGS:
            return
        dropped, article, around = self._state()
        if not dropped and (attrs or tag in DROPPED_TAGS or tag == "header"):
            dropped = _is_boilerplate(tag, attrs, article)
            mark = None if dropped else _mark(tag, attrs, article, not self.articles)
            if dropped or mark:
                self.end_block_before(tag)
            if mark:
                mark.around, around = around, mark
                mark.first_said = [n for n in mark.names if not self.open_names[n]]
                self.open_names.update(mark.names)
                self.marks.append(mark)
        if tag in ARTICLE_TAGS and not dropped:
            self.articles.append((tag, around))
        self.stack.append((tag, dropped, article or tag in ARTICLE_TAGS, around))
        self.open[tag] += 1
        self.links += tag == "a"

    def end_block_before(self, tag: str) -> None:
        """An inline element that is boilerplate begins a block of its own; the stack still says what came before."""
        if tag not in BLOCK_TAGS:
            self.end_block()

    def handle_startendtag(self, tag, attrs):
        if tag in VOID_TAGS:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID_TAGS:
            if tag == "br":
                self.said.append(" ")
            return
        if tag in BLOCK_TAGS or tag in DROPPED_TAGS or self._leaves_boilerplate(tag):
            self.end_block()
        self._close(tag)

    def _leaves_boilerplate(self, tag: str) -> bool:
        if not self.stack or self.stack[-1][0] != tag:
            return False
        _, dropped, _, mark = self.stack[-1]
        before = self.stack[-2] if len(self.stack) > 1 else (None, False, False, None)
        return (dropped and not before[1]) or mark is not before[3]

    def _close(self, tag: str) -> None:
        """Closes the innermost element of a tag with all inside it; nothing if none is open."""
        if not self.open[tag]:
            return
        closed = None
        while closed != tag:
            closed, _, _, mark = self.stack.pop()
            self.open[closed] -= 1
            self.links -= closed == "a"
            if mark is not self._state()[2]:
                self.open_names.subtract(mark.names)

    def handle_data(self, data):
        self.said.append(data)
        if self.links:
            self.linked += len("".join(data.split()))


def stop_share(text: str) -> float:
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def weight(text: str) -> int:
    """Length, where a character of a script that needs fewer of them counts twice."""
    return len(text) if text.isascii() else len(text) + sum(unicodedata.east_asian_width(c) in "WF" for c in text)


def few_links(block: Block, most: float = LINKS_FEW) -> bool:
    return block.linked <= most * block.size


def is_foreign(blocks: list[Block]) -> bool:
    """Whether the long blocks with few links are hardly in a language whose stop words we have."""
    long = known = 0
    for block in blocks:
        if (w := block.weight) >= SHORT and few_links(block):
            long += w
            known += w * (block.stops() >= KNOWN)
    return known < FOREIGN * long


def drop_marked(blocks: list[Block], articles: list[tuple[str, Mark | None]], marks: list[Mark]) -> None:
    """Drops the blocks in elements that their names mark, but for those that hold the page's article or most of its long text."""
    if articles and all(mark for _, mark in articles):
        mark = next((mark for tag, mark in articles if tag == "main"), articles[0][1])
        while mark:
            mark.kept, mark = True, mark.around
    long, of_name = 0, Counter()
    for block in blocks:
        if not block.dropped and (w := block.weight) >= SHORT and few_links(block):
            long += w
            if block.mark:
                block.mark.weight += w
    for mark in reversed(marks):  # inner ones first
        if mark.around:
            mark.around.weight += mark.weight
        of_name.update(dict.fromkeys(mark.first_said, mark.weight))
    most = {name for name, w in of_name.items() if 2 * w > long}
    for mark in marks:  # outer ones first
        own = not mark.kept and not (mark.names and mark.names <= most)
        mark.drops = own or (mark.around is not None and mark.around.drops)
    for block in blocks:
        if block.mark and block.mark.drops:
            block.dropped = True


def classify(block: Block, only_articles: bool, foreign: bool = False) -> bool | None:
    """Pass 1: True for text, False for boilerplate, None if the block alone does not say."""
    if block.dropped or (only_articles and not block.article):
        return False
    if not few_links(block, LINKS_BAD):
        return False
    if len(block.text) >= SHORT and block.stops() >= STOP_GOOD:
        return True
    if foreign and block.weight >= SHORT and few_links(block):
        return True
    return None


def inherit(labels: list[bool | None], candidates: list[bool], otherwise: bool) -> list[bool]:
    """Pass 2: ambiguous blocks take the label of the nearest decided one; only candidates (blocks not dropped by markup) count."""
    places = [i for i, c in enumerate(candidates) if c]
    before: dict[int, tuple[int, bool]] = {}
    after: dict[int, tuple[int, bool]] = {}
    for order, found in ((enumerate(places), before), (((len(places) - 1 - n, i) for n, i in enumerate(reversed(places))), after)):
        last = None
        for at, i in order:
            if labels[i] is not None:
                last = (at, labels[i])
            elif last is not None:
                found[i] = (abs(at - last[0]), last[1])
    made = [bool(x) for x in labels]
    for i in places:
        if labels[i] is None:
            near = [x for x in (before.get(i), after.get(i)) if x]
            made[i] = min(near, key=lambda x: (x[0], not x[1]))[1] if near else otherwise
    return made


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = BlockReader()
    reader.feed(html)
    reader.close()
    reader.end_block()
    blocks = reader.blocks
    drop_marked(blocks, reader.articles, reader.marks)
    only_articles = any(b.article and not b.dropped for b in blocks)
    candidates = [not b.dropped and (b.article or not only_articles) for b in blocks]
    foreign = is_foreign([b for b, c in zip(blocks, candidates) if c])
    labels = [classify(b, only_articles, foreign) for b in blocks]
    if only_articles and True not in labels:
        kept = [label is None for label in labels]
    else:
        kept = inherit(labels, candidates, only_articles)
    return "\n\n".join(b.text for b, k, c in zip(blocks, kept, candidates) if k and c)


def extract(pages: DataFrame, html_column: str = "html", name: str = "text", keep_html: bool = False) -> DataFrame:
    """The columns of pages (html only on request) and the main text; a column of that name is replaced."""
    fields = [f for f in pages.schema.fields if f.name != name and (keep_html or f.name != html_column)]
    schema = T.StructType([*fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(batch.schema.get_field_index(html_column))
            texts = pa.array((main_text(h.as_py()) for h in html), pa.string())
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, texts], [*(f.name for f in fields), name])

    return pages.mapInArrow(run, schema)
