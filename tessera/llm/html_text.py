"""Main text of web pages by two passes over their blocks.

Pass one classifies each block by stop-word density, length and link density. Where it stands decides first only for what
prose can't show: navigation, forms, notices, adverts, comments are boilerplate whatever they say. Names alone don't decide
about wrappers: an article or main element inside a form or an element with a boilerplate name is the page's article unless
the page has text in one that stands free. Short blocks without a decision are ambiguous. Pass two gives an ambiguous
block the label of its nearest decided neighbour. Outside articles text wins a tie only for a heading that it follows.
Inside, boilerplate (a list of links, say) passes its label on to a block that stands between two of them, or that has links itself
and is nearer to it than to text. Stop words count only where the page is in a language with a list; else length and links decide. An article
element whose name says that it is a reader's or an advert is boilerplate.

Defined cases: null or empty html gives an empty text; broken markup (unclosed, misnested or cut tags) is read as browsers
do for the tags that matter here; a null page_id or url stays null; repeated rows give repeated rows; an empty table gives
an empty result; further columns are ignored. A page is handled whole, whatever its length, in time linear in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts

#: Fixed values. Tags whose content is never text.
RAW = ("script", "style", "title", "noscript", "template", "iframe", "svg", "canvas", "select", "textarea", "button", "video", "audio", "datalist")
#: Those that swallow the page if nothing closes them; the others end at the next block or at another of their kind.
SWALLOWING = frozenset("script style title textarea".split())
#: Tags that end a block.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are boilerplate as such, and roles that say the same.
AWAY = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split())
#: Words in class or id that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar rail widget widgets nav navbar navigation menu breadcrumb breadcrumbs masthead footer comment comments commentlist disqus reply replies respond responses related recommended recommendations share sharing social pagination pager login search form hidden toolbar skip".split()
)
#: Marks that also name a topic: joined to a word that is not a part of pages ("related-work"), they mark nothing.
TOPICS = frozenset("related recommended share sharing social promotion promo reply replies respond responses search hidden nav navigation menu banner alert form login sidebar rail widget widgets".split())
PAGE_WORDS = frozenset("posts post articles article links link list box container wrapper wrap section block area inner outer content item items text title body message msg top bottom left right main site page global primary secondary mobile desktop bar stories story news more group panel module icons buttons button header icon row col column".split())
#: Marks that make even an article element one of readers or of sellers, alone or joined to words for parts of pages.
SELLERS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond responses".split())
#: Words that say what a wrapper has or lacks, not what it is.
STATES = frozenset("has no with without is not".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param keygen".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STOP_WORDS = frozenset(
    (
        "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over "
        "der die und das in den von zu ist mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
        "la le de et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ont aux cette son mais nous ou leur sa comme été si fait même elle "
        "el los las y que del se por con una su para es al lo como más pero sus le ha me sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede"
    ).split()
)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
UNQUOTED = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[a-z]+")
#: Pass one: least characters of a long block, stop-word shares, greatest share of characters in links.
LONG, MANY_STOPS, SOME_STOPS, LINKS = 140, 0.30, 0.12, 0.5
TEXT, AWAY_LABEL, OPEN = 1, 0, -1
#: A page with a smaller share of stop words among its prose is in a language without a list; there length and links decide alone.
KNOWN_LANGUAGE = 0.05
#: Characters of scripts that write a word with a few characters and put no spaces between words; each counts as so many.
DENSE, DENSE_WEIGHT = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\u0e00-\u0e7f]"), 3
#: The end of each raw element, or another of the kind; the next block.
END = {tag: re.compile(rf"</{tag}(?:\s[^>]*)?>" + ("" if tag in SWALLOWING else rf"|<{tag}[\s/>]"), re.I) for tag in RAW}
AFTER = re.compile(r"</?(?:" + "|".join(sorted(BLOCK - {"option"})) + r")[\s/>]", re.I)


@dataclass
class Tag:
    start: int
    end: int
    name: str  # empty for comments and declarations
    closing: bool
    raw: str  # the attributes


class Tags:
    """The page's tags from front to back, each character looked at a bounded number of times.

    What is looked for in vain once (a quote, a bracket, a comment's end) is not looked for again further on. A tag whose quote is never
    closed ends at its next bracket; without any bracket left what follows is text, but for a tag that the page's end cuts.
    """

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end_of(self, at: int) -> int:
        """Of the tag whose attributes begin at `at`: the place of its bracket, -1 if there is none."""
        while True:
            at = UNQUOTED.match(self.page, at).end()
            if at >= len(self.page):
                self.missing.add(">")
                return -1
            if self.page[at] == ">":
                return at
            quote = self.find(self.page[at], at + 1)
            if quote < 0:
                return self.find(">", at)
            at = quote + 1

    def next(self, at: int) -> Tag | None:
        page = self.page
        while ">" not in self.missing:
            at = page.find("<", at)
            if at < 0:
                return None
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                return Tag(at, end + 3 if end >= 0 else len(page), "", False, "")
            after = page[at + 1 : at + 2]
            if after and after in "!?":
                end = self.find(">", at)
                if end < 0:
                    return None
                return Tag(at, end + 1, "", False, "")
            closing = after == "/"
            name = NAME.match(page, at + 1 + closing)
            if name:
                end = self.end_of(name.end())
                if end < 0:
                    return None
                return Tag(at, end + 1, name[0].lower(), closing, page[name.end() : end])
            at += 1
        return None


@dataclass
class Block:
    text: str
    linked: int
    zone: int  # 0 boilerplate, 1 article, 2 neither, 3 an article inside boilerplate
    heading: bool


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw else {}


def marked(tag: str, raw: str, inside_article: bool) -> bool:
    """Is the element boilerplate, by its tag, role, marks or being hidden?"""
    if tag in AWAY or (tag == "header" and not inside_article):
        return True
    if not raw.strip(" /"):
        return False
    own = attributes(raw)
    if own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return True
    if tag in ("article", "main"):
        return any(map(others_article, (own.get("class", "") + " " + own.get("id", "")).split()))
    if tag in ("html", "body"):
        return False
    return any(map(name_marks, (own.get("class", "") + " " + own.get("id", "")).split()))


def closed_for_good(tag: str, raw: str) -> bool:
    """Can no article inside this boilerplate element be the page's? Forms and named wrappers may hold it."""
    if tag in AWAY - {"form"} or tag == "article":
        return True
    own = attributes(raw)
    names = PARTS.findall((own.get("class", "") + " " + own.get("id", "")).lower())
    hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "style" in own and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own["style"], re.I)
    return bool(hidden) or own.get("role", "").lower() in ROLES - {"form"} or not READERS.isdisjoint(names)


def parts_of(name: str) -> list[str]:
    return PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())


def others_article(name: str) -> bool:
    """Does the name say that an article is a reader's or an advert: by such a word, alone or with words for parts of pages?"""
    parts = parts_of(name)
    return any(p in READERS or p in SELLERS for p in parts) and all(p in READERS or p in SELLERS or p in PAGE_WORDS for p in parts)


def name_marks(name: str) -> bool:
    parts = parts_of(name)
    held = [p for p in parts if p in MARKS]
    if not held or parts[0] in STATES:
        return False
    return not TOPICS.issuperset(held) or all(p in MARKS or p in PAGE_WORDS or len(p) < 3 for p in parts)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with their characters in links and their zone."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open elements that are not inline, with the zone they stand for
    pieces: list[str] = []
    linked, in_link, zone, heading, at = 0, False, 2, False, 0
    shut = 0  # depth of the outermost open element in which no article can be the page's

    def close_block() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), zone, heading))
        pieces, linked = [], 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            pieces.append(piece)
            if in_link:
                linked += len(" ".join(html.unescape(piece).split()))

    def back_to(tag: str) -> None:
        """Closes the open elements down to the last of this name."""
        nonlocal zone
        while stack:
            name, zone = stack.pop()
            held[name] -= 1
            if name == tag:
                break

    def opened(tag: str) -> None:
        stack.append((tag, zone))
        held[tag] += 1

    held: Counter = Counter()  # open elements by name
    tags, length = Tags(page), len(page)
    while at < length:
        found = tags.next(at)
        if found is None:
            last = page.rfind("<", at)
            cut = last >= 0 and page.find(">", last) < 0 and re.match(r"[a-zA-Z/!]", page[last + 1 : last + 2])  # a tag that the page's end cuts
            add(page[at : last if cut else length])
            break
        add(page[at : found.start])
        at = found.end
        tag, closing, raw = found.name, found.closing, found.raw
        if not tag:
            continue
        if tag in RAW and not closing:
            if raw.endswith("/"):
                continue
            end = END[tag].search(page, at)
            if tag not in SWALLOWING and (end is None or end[0][1] != "/"):  # not closed
                end = AFTER.search(page, at)
                at = end.start() if end else length
            elif end is None:
                break
            else:
                at = end.end()
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag not in BLOCK:
            if not closing and tag not in VOID and marked(tag, raw, zone == 1):
                close_block()
                opened(tag)
                zone = 0
            elif closing and held[tag]:
                close_block()
                back_to(tag)
            continue
        close_block()
        heading = tag in HEADINGS and not closing
        if tag in VOID:
            continue
        if closing:
            if held[tag]:
                back_to(tag)
        else:
            if tag in ("p", "li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                back_to(tag)
            opened(tag)
            main = tag in ("article", "main") or attributes(raw).get("role", "").lower() == "main"
            if marked(tag, raw, zone in (1, 3)):
                zone, in_link, shut = 0, False, (shut or len(stack)) if closed_for_good(tag, raw) else shut
            elif main:
                zone = 1 if zone in (1, 2) else 3 if not shut else zone
        if shut > len(stack):
            shut = 0
    close_block()
    known = in_known_language(out)
    free = any(b.zone == 1 and first_pass(b, known) == TEXT for b in out)
    for block in out:
        if block.zone == 3:
            block.zone = 0 if free else 1
    return out


def stop_words(text: str) -> tuple[int, int]:
    """Stop words among the words of a text."""
    words = [w.strip("*#$%&!?.,;:|\"'()") for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words), len(words)


def in_known_language(blocks: list[Block]) -> bool:
    """Do stop words say anything on this page? They do unless its prose (what is not boilerplate by place nor links) has next to none."""
    counts = [stop_words(b.text) for b in blocks if b.zone and b.linked <= LINKS * len(b.text)]
    return sum(n for n, _ in counts) >= KNOWN_LANGUAGE * sum(n for _, n in counts)


def first_pass(block: Block, known: bool = True) -> int:
    """TEXT, AWAY_LABEL or OPEN by zone, link density, length and, in a known language, stop-word density."""
    if block.zone == 0 or block.linked > LINKS * len(block.text):
        return AWAY_LABEL
    length = len(block.text) + (DENSE_WEIGHT - 1) * len(DENSE.findall(block.text))
    if not known:
        return TEXT if length >= LONG else OPEN
    stops, words = stop_words(block.text)
    if block.zone == 1:
        return TEXT if length >= LONG or stops >= SOME_STOPS * words else OPEN
    if length < LONG:
        return TEXT if stops >= MANY_STOPS * words and words >= 8 else OPEN
    return TEXT if stops >= SOME_STOPS * words else AWAY_LABEL


def second_pass(blocks: list[Block], labels: list[int]) -> list[int]:
    """Open blocks take the label of the nearest decided one; an article's blocks look at the article's only."""
    count, out = len(blocks), list(labels)
    has_article = any(b.zone == 1 for b in blocks)

    def nearest(order: range, article: bool) -> list[tuple[int, int] | None]:
        found, last, seen = [None] * count, None, 0
        for seen, i in enumerate(order):
            if labels[i] != OPEN and (not article or blocks[i].zone == 1):
                last = (seen, labels[i])
            found[i] = (seen - last[0], last[1]) if last else None
        return found

    sides = {a: (nearest(range(count), a), nearest(range(count - 1, -1, -1), a)) for a in (True, False)}
    for i, label in enumerate(labels):
        if label != OPEN:
            continue
        within = blocks[i].zone == 1
        before, after = sides[within][0][i], sides[within][1][i]
        if within:
            known = [x for x in (before, after) if x]
            texts, others = [d for d, x in known if x == TEXT], [d for d, x in known if x != TEXT]
            away = len(others) == 2 or (blocks[i].linked > 0 and others and min(others) < min(texts, default=count + 1))
            out[i] = AWAY_LABEL if away else TEXT
            continue
        # outside, the page's ends count as boilerplate, and so does the edge of an article for what stands outside it
        before, after = before or (i + 1, AWAY_LABEL), after or (count - i, AWAY_LABEL)
        if has_article:
            out[i] = AWAY_LABEL
        elif before[0] == after[0]:
            out[i] = after[1] if blocks[i].heading else min(before[1], after[1])
        else:
            out[i] = min(before, after, key=lambda x: x[0])[1]
    return out


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    known = in_known_language(blocks)
    labels = second_pass(blocks, [first_pass(b, known) for b in blocks])
    return "\n".join(b.text for b, label in zip(blocks, labels, strict=True) if label == TEXT)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def per_page(packed: str) -> tuple:
        known, _, rest = packed.partition("\x01")
        url, page = (rest[: int(known)], rest[int(known) :]) if known else (None, rest)
        text = main_text(page)
        return url, text, len(text)

    url = F.col("url").cast("string")
    # url and html travel as one string: the length of the url, or nothing for a null one, stands in front
    packed = F.concat(F.coalesce(F.length(url).cast("string"), F.lit("")), F.lit("\x01"), F.coalesce(url, F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit("")))
    return map_texts(pages.select("page_id", packed.alias("html")), per_page, "page_id bigint, url string, text string, n_chars bigint")
