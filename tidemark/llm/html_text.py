"""Main text of web pages by two passes over their blocks.

First pass: every block is judged by the density of stop words, its length, the share of its characters in
links and the elements around it. Long running text is main text; lists of links and everything inside
menus, page headers and footers, sidebars, adverts, notices, forms or reader comments is not; a short block
without links is undecided. Second pass: an undecided block takes the label of its nearest decided
neighbours in its region of the page; where these differ or there are none, the region decides (inside an
article: main text).
"""

from __future__ import annotations

import dataclasses
import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent words of the languages at hand.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could do for from had has have he her his how i
    if in into is it its just like more my no not of on one only or other our out she so some than that the their
    them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer
    er es für haben hat ich ihr im in ist ja kann man mehr mich mir mit nach nicht noch nur oder schon sein sich sie
    sind so über um und uns vom von vor war was wenn wer wie wir wird zu zum zur
    ai au aux avec ce ces cette comme dans de des du elle en est et eux fait il ils je la le les leur lui mais me
    même mon ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur ta te tu un une vous y
    al algo así como con cuando de del desde donde el ella en era es esa ese esta este están fue ha hay la las lo los
    más me mi muy ni no nos o para pero por porque que quien se ser si sin sobre son su sus también te tiene todo
    tu un una uno y ya""".split()
)
#: Elements that end a block, that hold no text, and that are left out with all they hold.
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table
    tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = "script style noscript template textarea select svg iframe object canvas audio video math button".split()
NEVER = frozenset("nav aside footer form menu dialog".split())
#: Words in class, id or role that mark what is not main text, anywhere or outside an article.
HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar
    navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent notice gdpr popup modal overlay
    comment comments commentlist disqus replies reply respond share sharing social related recommended newsletter
    subscribe subscription signup login search pagination pager widget complementary contentinfo toolbar skip
    disclaimer copyright alert form""".split()
)
HEADER_HINTS = frozenset("header masthead banner topbar".split())
#: Bounds of the first pass.
LONG = 70
STOP_LOW = 0.1
LINKS = 0.33

ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
#: Elements that only a body holds.
BODY = "body article main div p h[1-6] section nav header footer ul ol table form".replace(" ", "|")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # a head, which ends at the body where it is not closed; foreign elements that close themselves
    rf"|<head\b{ATTRIBUTES}>(?:.*?</head\s*>|.*?(?=<(?:{BODY})\b)|.*)"
    rf"|<(?:svg|math)\b{ATTRIBUTES}(?<=/)>"
    rf"|<(?P<skip>{'|'.join(SKIPPED)})\b{ATTRIBUTES}>.*?(?:</(?P=skip)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>{ATTRIBUTES})>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclasses.dataclass
class Block:
    text: str
    linked: int
    region: int  # 0: page, else the number of the article or main element
    barred: bool
    label: bool | None = None


def blocks_of(page: str, lenient: bool = False) -> list[Block]:
    """Blocks with text in page order; unclosed and stray tags are put up with.

    When ``lenient``, an article or main element is not barred by a form or a hint further up, as where one
    wraps the whole page.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = [("", False, 0)]  # element, barred inside, region
    regions = 0
    parts: list[str] = []
    linked: list[str] = []
    in_link = False

    def end_block():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            link = " ".join(html.unescape("".join(linked)).split())
            out.append(Block(text, len(link), stack[-1][2], stack[-1][1]))
        parts, linked = [], []

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked.append(parts[-1])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = not m["close"]
            continue
        if tag not in BLOCKS:
            # an inline element ends no block, but one that is barred must not leak into it
            if tag in VOID or m["close"] or not _hinted(tag, m["rest"], True):
                if m["close"] and stack[-1][0] == tag:
                    end_block()
                    stack.pop()
                continue
        end_block()
        in_link = False
        if m["close"]:
            names = [x[0] for x in stack]
            if tag in names[1:]:
                del stack[len(names) - 1 - names[::-1].index(tag) :]
            continue
        if stack[-1][0] == "p" or (tag == "li" and stack[-1][0] == "li"):
            stack.pop()
        if tag in VOID or m["rest"].endswith("/"):
            continue
        _, barred, region = stack[-1]
        if lenient and tag in ("article", "main") and not any(x[0] in NEVER - {"form"} for x in stack):
            barred = False
        if tag in ("article", "main") and not barred:
            regions += 1
            region = regions
        barred = barred or tag in NEVER or (tag == "header" and not region) or _hinted(tag, m["rest"], bool(region))
        stack.append((tag, barred, region))
    parts.append(page[at:])
    end_block()
    return out


def _hinted(tag: str, rest: str, inside: bool) -> bool:
    if not rest or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(rest):
        if name.lower() == "hidden":
            return True
        words = set(NAME_PARTS.findall(CAMEL.sub(" ", "".join(values)).lower()))
        if words & HINTS or (not inside and words & HEADER_HINTS):
            return True
    return False


def first_pass(block: Block) -> bool | None:
    """True for main text, False for what is not, None for undecided."""
    n = len(block.text)
    if block.barred or block.linked > LINKS * n:
        return False
    if n < LONG:
        return None
    if block.region:
        return True
    words = block.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words)
    return stops >= STOP_LOW * len(words) if words else None


def second_pass(blocks: list[Block]) -> None:
    """Labels for undecided blocks from their nearest decided neighbours of the same region."""
    before: list[Block | None] = []
    last: dict[int, tuple[int, Block]] = {}
    for k, b in enumerate(blocks):
        before.append(last.get(b.region))
        if b.label is not None and not b.barred:
            last[b.region] = (k, b)
    decided = any(b.label for b in blocks)
    last = {}
    found: list[bool | None] = [b.label for b in blocks]
    for k in range(len(blocks) - 1, -1, -1):
        b = blocks[k]
        if b.label is None:
            near = [x for x in (before[k], last.get(b.region)) if x]
            labels = {x[1].label for x in near}
            # a region speaks for its undecided blocks; a page does so only if nothing in it is decided
            found[k] = labels.pop() if len(labels) == 1 else bool(b.region) or not decided
            if b.region and found[k] is False and not any(x[1].label for x in near):
                found[k] = not all(x[1].linked for x in near)
        elif not b.barred:
            last[b.region] = (k, b)
    for b, label in zip(blocks, found):
        b.label = label


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks, each on one line; empty if there is none.

    A page on which nothing is left is read once more, its articles free of what surrounds them.
    """
    for lenient in (False, True):
        blocks = blocks_of(page or "", lenient)
        for b in blocks:
            b.label = first_pass(b)
        second_pass(blocks)
        text = "\n".join(b.text for b in blocks if b.label)
        if text:
            return text
    return ""


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of the whole page in ``column``.

    Every row and column is kept, repeated pages too; a column named ``text`` is replaced. Null and empty
    pages give the empty text, pages of any length are read whole, an empty table stays empty.
    """

    @F.pandas_udf("string")
    def extract(page: pd.Series) -> pd.Series:
        return page.map(main_text, na_action=None).astype(object)

    return pages.withColumn("text", extract(F.col(column)))
