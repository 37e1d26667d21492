"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block tags. The first pass decides each block by itself: by where it stands (menus, headers,
footers, sidebars, notices, adverts, forms and comments are out), by the share of its letters inside links, its length, and
the density of stop words. Short blocks, and longer ones of middling density, stay open. On a page whose long blocks together
hold few of the known stop words, long blocks are text whatever their density. In the second pass an open block
takes the label of the nearest decided blocks around it. Inside a declared article less density is enough, no block is out
for its density alone, and an open block is text unless the decided blocks of the article on all its sides are not.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import short_batches

# Letters in links, of all letters, above which a block is no text.
LINKS = 0.5
# Letters below which a block is short.
SHORT = 70
# Share of a page's dense text above which a form or what is named like no text holds the page, and what a longer name only
# hints at ("content-sidebar-wrap").
WHOLE, MOST = 0.9, 0.5
# Stop words, of all words, from which a block is text, and from which it may be.
DENSE, MIDDLING = 0.3, 0.15
# Letters of scripts without spaces, which say as much as two others.
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")

# Frequent words of the languages that are met.
STOP_WORDS = frozenset(
    """
    a about after all an and are as at be been but by can for from had has have he her his i if in into is it its more my no not
    of on one or our out she so than that the their them then there these they this to up was we were what when which who will
    with would you your
    au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais me même mes moi mon ne nos nous on ou par
    pas pour qu que qui sa se ses son sur ta te tes tu un une vos vous à été
    als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer eines er es für hat
    ich ihr im ist mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wir zu zum zur
    al algo ante como con contra cual cuando del desde donde el ella ellos en entre era es esa ese eso esta este esto fue ha
    han hasta la las le lo los más mi muy no nos o para pero por porque que se si sin sobre su sus también una uno y ya yo
    """.split()
)

# Tags by what they do.
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead title tr ul
    """.split()
)
# Their content is no text of the page.
RAW_TAGS = ("script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "textarea", "select", "title", "xmp")
OUT_TAGS = frozenset("nav footer aside menu dialog button".split())
IN_TAGS = frozenset(("article", "main"))
# Elements that hold others and are closed by name.
HOLDERS = frozenset(
    """
    article aside blockquote body button center details dialog dir div dl fieldset figure footer form header main menu nav ol section
    span table ul
    """.split()
)
OUT_NAMES = frozenset(
    """
    ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies
    disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination
    popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe
    teaser toolbar topbar widget widgets
    """.split()
)
# Those of them that are words of an article, too ("share-price", "article-header"): beside other words they say little there.
ORDINARY_NAMES = frozenset("banner disclaimer header menu notice notices overlay promotion related share sharing social teaser".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
# Attributes one after another, so that a name inside a value is none.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME_PART = re.compile(r"[a-z0-9]+")
# Without an end, the rest of the page is theirs; the start of any other is ignored then.
_TO_THE_END = ("script", "style")
# One that begins within one of the same kind shows that the first has no end.
_NOT_NESTED = ("select", "audio", "video", "canvas", "noscript")
_RAW_START = {tag: re.compile(rf"<{tag}(?=[\s/>])", re.IGNORECASE) for tag in _NOT_NESTED}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW_TAGS}


@dataclass
class Block:
    text: str
    linked: int
    out: bool
    inside: bool
    heading: bool
    # The innermost element around it that may be out.
    doubt: int = -1
    label: str = ""


@dataclass
class Doubt:
    """An element that is out by its names or as a form, unless it holds the text of the page; a weak one unless it holds any."""

    around: int
    hint: bool
    depth: int
    weak: bool = False
    articles: int = 0
    mains: int = 0
    dense: int = 0


@dataclass
class _Page:
    """What the walk over a page's tags has gathered."""

    blocks: list[Block] = field(default_factory=list)
    # Open elements: name, whether they or those around them are out of the text, or in a declared article, and the doubt on them.
    holders: list[tuple[str, bool, bool, int]] = field(default_factory=list)
    opened: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    tag: str = ""
    tag_out: bool = False
    doubts: list[Doubt] = field(default_factory=list)
    # Declared articles that are not out: the doubt they stand in, and whether they are a main.
    articles: list[tuple[int, bool]] = field(default_factory=list)

    def around(self) -> tuple[bool, bool, int]:
        return self.holders[-1][1:] if self.holders else (False, False, -1)

    def hold(self, name: str, rest: str) -> None:
        """Open an element that holds others."""
        out, inside, doubt = self.around()
        why = "" if out else _why_out(name, rest, inside)
        if why:
            self.close()
            if why == "tag":
                out = True
            else:
                self.doubts.append(Doubt(doubt, why == "hint", self.doubts[doubt].depth + 1 if doubt >= 0 else 1, why == "weak"))
                doubt = len(self.doubts) - 1
        if name in IN_TAGS and not out:
            self.articles.append((doubt, name == "main"))
        self.opened[name] += 1
        self.holders.append((name, out, inside or name in IN_TAGS, doubt))

    def release(self, name: str) -> None:
        """Close the last open element of a name and those in it; an end without a beginning is ignored."""
        if not self.opened[name]:
            return
        was = self.around()
        at = len(self.holders) - 1
        while self.holders[at][0] != name:
            at -= 1
        left = self.holders[at - 1] if at else ("", False, False, -1)
        if was[0] and not left[1] or was[2] != left[3]:
            self.close()
        for other, *_ in self.holders[at:]:
            self.opened[other] -= 1
        del self.holders[at:]

    def text(self, raw: str) -> None:
        if raw:
            decoded = html.unescape(raw) if "&" in raw else raw
            self.pieces.append(decoded)
            if self.links:
                self.linked += len("".join(decoded.split()))

    def close(self) -> None:
        """End the block that is open."""
        text = " ".join("".join(self.pieces).split())
        if text:
            out, inside, doubt = self.around()
            self.blocks.append(Block(text, self.linked, out or self.tag_out, inside, self.tag[:1] == "h" and self.tag[1:].isdigit(), doubt))
        self.pieces, self.linked = [], 0


def _why_out(name: str, rest: str, inside: bool) -> str:
    """Why an element is none of the page's text: ``tag`` for its tag, role or style; ``name`` for a form, or a class or an id of
    words that say so; ``hint`` for one with other words beside them; ``weak`` for a hint by ordinary words, or a group of fields, inside a
    declared article. Empty if it may be text."""
    if name in OUT_TAGS or name == "header" and not inside or name == "fieldset" and not inside:
        return "tag"
    why = "name" if name == "form" else "weak" if name == "fieldset" else ""
    if name in ("html", "body", "article", "main") or not rest or "=" not in rest and "hidden" not in rest:
        return why
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
            return "tag"
        if key == "role" and value in OUT_ROLES:
            return "tag"
        if key in ("class", "id") and why != "name":
            for parts in map(_NAME_PART.findall, value.split()):
                names = OUT_NAMES.intersection(parts)
                if names and (why == "name" or OUT_NAMES.issuperset(parts)):
                    why = "name"
                elif names:
                    why = "weak" if inside and why != "hint" and names <= ORDINARY_NAMES else "hint"
    return why


def _dense_letters(block: Block) -> int:
    """Letters of a block whose length and links are those of text."""
    letters = len(block.text) - block.text.count(" ")
    return letters if _length(block.text) >= SHORT and block.linked <= LINKS * letters else 0


def settle_doubts(page: _Page) -> None:
    """Put blocks out that stand in an element that is out.

    An element in doubt is text, to be decided by its blocks, if it holds the page: the outermost main; the outermost articles,
    when they are in it for more than a part of its name or hold most of the dense text; or, where no declared article stands
    outside such elements, nearly all dense text (most of it, if its name only hints).
    """
    if not page.doubts:
        return
    doubts, total = page.doubts, 0
    for block in page.blocks:
        if not block.out:
            dense = _dense_letters(block)
            total += dense
            if block.doubt >= 0:
                doubts[block.doubt].dense += dense
    depth = lambda doubt: doubts[doubt].depth if doubt >= 0 else 0
    nearest = min((depth(d) for d, _ in page.articles), default=-1)
    nearest_main = min((depth(d) for d, main in page.articles if main), default=-1)
    for doubt, main in page.articles:
        if doubt >= 0:
            doubts[doubt].articles += depth(doubt) == nearest
            doubts[doubt].mains += main and depth(doubt) == nearest_main
    for doubt in reversed(doubts):
        if doubt.around >= 0:
            up = doubts[doubt.around]
            up.articles, up.mains, up.dense = up.articles + doubt.articles, up.mains + doubt.mains, up.dense + doubt.dense
    stays = []
    for doubt in doubts:
        text = doubt.mains > 0 or doubt.articles > 0 and (doubt.hint or doubt.dense > MOST * total or not total)
        text = text or doubt.weak and doubt.dense > 0
        text = text or nearest != 0 and doubt.dense > (MOST if doubt.hint else WHOLE) * total
        stays.append(text and (doubt.around < 0 or stays[doubt.around]))
    for block in page.blocks:
        block.out = block.out or block.doubt >= 0 and not stays[block.doubt]


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. Broken tags, missing ends and nested paragraphs are read as browsers read them."""
    state, at, ends = _Page(), 0, {}
    for match in iter(lambda: _TAG.search(page, at), None):
        state.text(page[at : match.start()])
        at = match.end()
        name = match["name"] or match["name2"]
        if name is None:
            continue
        name, rest = name.lower(), match["rest"] if match["name"] else match["rest2"]
        end = match["end"] or match["end2"]
        if not end and name in _RAW_END and not rest.endswith("/"):
            state.text(" ")
            if name not in ends or ends[name] and ends[name].start() < at:
                ends[name] = _RAW_END[name].search(page, at)
            closing = ends[name]
            if closing and name in _RAW_START and _RAW_START[name].search(page, at, closing.start()):
                closing = None
            if closing or name in _TO_THE_END:
                at = closing.end() if closing else len(page)
            continue
        if name in BLOCK_TAGS:
            state.close()
            state.tag, state.tag_out, state.links = ("", False, 0) if end else (name, False, 0)
        elif name in ("br", "img", "wbr", "input"):
            state.text(" ")
        elif name == "a":
            state.links = 0 if end else 1
        if name in HOLDERS and end:
            state.release(name)
        elif name in HOLDERS and not rest.endswith("/"):
            state.hold(name, rest)
        elif name in BLOCK_TAGS and not end:
            state.tag_out = _why_out(name, rest, state.around()[1]) not in ("", "weak")
    state.text(page[at:])
    state.close()
    settle_doubts(state)
    return state.blocks


def _length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + len(_WIDE.findall(text))


def _stop_words(text: str) -> tuple[int, int]:
    """Stop words, and words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()[]«»“”¿¡") in STOP_WORDS for w in words), len(words)


def known_language(found: list[Block]) -> bool:
    """Whether the long blocks of a page that are neither out nor links hold enough of the known stop words together."""
    known = words = 0
    for block in found:
        if not block.out and not block.heading and _length(block.text) >= SHORT and block.linked <= LINKS * (len(block.text) - block.text.count(" ")):
            some, of = _stop_words(block.text)
            known, words = known + some, words + of
    return known >= MIDDLING * words


def first_pass(block: Block, known: bool = True) -> str:
    """``good``, ``bad``, or an open label: ``near`` for middling blocks, ``short``. In a language that is not ``known``, density
    decides nothing."""
    letters = len(block.text) - block.text.count(" ")
    if block.out:
        return "bad"
    if block.linked > LINKS * letters:
        # A linked title of an article stays open.
        return "short" if block.inside and block.heading else "bad"
    if _length(block.text) < SHORT or block.heading:
        return "short"
    if not known:
        return "good"
    some, of = _stop_words(block.text)
    density = some / of
    if block.inside:
        return "good" if density >= MIDDLING else "near"
    return "good" if density >= DENSE else "near" if density >= MIDDLING else "bad"


def settle_articles(found: list[Block]) -> None:
    """Open blocks inside a declared article are good, unless those decided by their own text before and after them are bad."""
    own = [b for b in found if b.inside and not b.out]
    labels = [b.label for b in own]
    before, last = [], ""
    for x in labels:
        last = x if x in ("good", "bad") else last
        before.append(last)
    following = ""
    for i in range(len(own) - 1, -1, -1):
        following = labels[i] if labels[i] in ("good", "bad") else following
        if labels[i] not in ("good", "bad"):
            own[i].label = "bad" if {before[i], following} - {""} == {"bad"} else "good"


def second_pass(found: list[Block]) -> None:
    """Open blocks inside a declared article are settled first. The others take the label of the nearest decided ones: of both if they agree, else of the nearer one; at equal
    distances a middling block is good and a short one is bad, but a heading goes with what follows. Without any decided
    block in the page, open blocks are good."""
    settle_articles(found)
    labels = [b.label for b in found]
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    if not decided:
        for block in found:
            block.label = "good"
        return
    before, last = [], -1
    for i, x in enumerate(labels):
        last = i if x in ("good", "bad") else last
        before.append(last)
    after, following = [0] * len(labels), -1
    for i in range(len(labels) - 1, -1, -1):
        following = i if labels[i] in ("good", "bad") else following
        after[i] = following
    for i, block in enumerate(found):
        if labels[i] in ("good", "bad"):
            continue
        left, right = before[i], after[i]
        if left < 0 or right < 0:
            block.label = labels[max(left, right)]
        elif labels[left] == labels[right] or block.heading:
            block.label = labels[right]
        elif i - left != right - i:
            block.label = labels[left if i - left < right - i else right]
        else:
            block.label = "good" if labels[i] == "near" else "bad"


def main_text(page: str | None) -> str:
    """The good blocks, one per line. A null or empty page has none."""
    found = blocks(page or "")
    known = known_language(found)
    for block in found:
        block.label = first_pass(block, known)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == "good")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points). Null pages give an empty text; repeated rows are read
    alike; an empty table gives no rows. Other columns are not read."""
    short_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    rows = rows.mapInArrow(_extract, "page_id long, url string, text string")
    return rows.withColumn("n_chars", F.length("text").cast("long"))
