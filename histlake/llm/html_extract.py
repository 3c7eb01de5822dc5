"""Main text of HTML by a maximum-scoring subsequence (operator 3).

A page is one sequence of words and tags. Tags score what labelled pages say of tags at and across the edges of
content (always below zero); words score by the box they stand in: what its tag, class, id or role says it is, whether
it holds most of the page's words, and whether they are linked. All weights are log-ratios learned from
labelled_pages. One linear scan finds the contiguous stretch of the highest sum, which is the content region; words
that score below zero there (an advert or a form inside the article) are left out of the text.

Defined results: null and empty html have an empty text; broken markup, unclosed tags and pages without words give
what their tokens score; a < that no > follows is text; a script or style ends at its own end tag alone, else with the
page; of equal sums the first and shortest stretch wins; rows are independent, so repeated rows and ties of ids each
keep a row. Pages of any length take time in proportion to it. Other columns than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from histlake.llm.common import table
from histlake.llm.labelled_pages import pages as labelled

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag, quoted values whole. Possessive, so what does not end is given up once.
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
HINTS = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements by kind, as HTML defines them.
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object select option".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: An open element of these ends when one of the same row starts.
CLOSES = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Names that classes and ids of surroundings go by, and what they stand for.
KINDS = {
    "menu": "nav menu menubar navbar navigation breadcrumb breadcrumbs toolbar tabs pagination pager toc",
    "head": "header masthead topbar banner hero",
    "foot": "footer copyright colophon legal",
    "side": "sidebar side aside widget rail related recommended recommendations more popular trending",
    "note": "notice cookie cookies consent gdpr alert popup modal overlay disclaimer message paywall",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted",
    "form": "form search login signup subscribe subscription newsletter share sharing social",
    "talk": "comment comments disqus replies reply discussion respond reviews",
}
KIND_OF = {name: kind for kind, names in KINDS.items() for name in names.split()}
TAG_KIND = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "button": "form", "label": "form", "fieldset": "form", "dialog": "note"}
#: Words before a name that tell what an element has, not what it is.
STATES = frozenset("has have with without no not is show hide hidden hides".split())
#: Elements that begin content; and words from which a box may be content without one.
MAIN, MANY = frozenset("h1 article main".split()), 100
SMOOTH = 0.5


def kind(tag: str, attrs: str) -> str:
    """What a box is by its tag, class, id or role; empty if nothing says so. Of a compound the last word names the
    box: site-footer is a footer, has-sidebar and sidebar-wrap are no sidebars."""
    if tag in TAG_KIND and tag != "header":
        return TAG_KIND[tag]
    for m in HINTS.finditer(attrs):
        for name in next(filter(None, m.groups()), "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            if words and words[-1] in KIND_OF and not STATES & set(words):
                return KIND_OF[words[-1]]
    return TAG_KIND.get(tag, "")


def end_tag(source: str, tag: str, at: int) -> tuple[int, int]:
    """Where the end tag of a raw element begins and ends, from at on; the end of the page if there is none."""
    m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
    return m.span() if m else (len(source), len(source))


def pieces(source: str) -> Iterator[tuple[int, str, str, str]]:
    """(place, text, tag, attributes) in order: stretches of text, or tags with a / before the name of end tags. What no
    reader sees (comments, scripts, styles) is none. Each character is looked at a bounded number of times."""
    at, text, quotes = 0, 0, True
    while (at := source.find("<", at)) >= 0:
        # A declaration or comment ends at its sign, a tag at a > outside quotes.
        if source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            inner = source[at + 9 : end if end >= 0 else len(source)]
            yield text, source[text:at], "", ""
            yield at, inner.replace("&", "&amp;"), "", ""
            at = text = end + 3 if end >= 0 else len(source)
            continue
        close = source.startswith("</", at)
        m = NAME.match(source, at + 1 + close)
        if m is None and not source.startswith(("<!", "<?"), at):
            at += 1
            continue
        if m is None:
            comment = source.startswith("<!--", at)
            end = source.find("-->" if comment else ">", at)
            if end < 0 and not comment:
                break  # no tag can end any more
            yield text, source[text:at], "", ""
            at = text = len(source) if end < 0 else end + (3 if comment else 1)
            continue
        rest = REST.match(source, m.end()) if quotes else None
        if rest is None:
            # A quote stays open to the end of the page: from here on quotes mean nothing.
            quotes = False
        end = rest.end() if rest else source.find(">", m.end()) + 1
        if not end:
            break
        yield text, source[text:at], "", ""
        tag, attrs = m.group().lower(), source[m.end() : end - 1]
        start, at = at, end
        if not close and tag in RAW and not attrs.endswith("/"):
            at = end_tag(source, tag, end)[1]
            if tag in BLOCKS:
                yield start, "", "/" + tag, ""
        else:
            yield start, "", "/" * close + tag, attrs
        text = at
    yield text, source[text:], "", ""


class Page:
    """Tokens of a page: (feature, text, words, block, place), where the feature is what weights are learned for; a
    stretch of text is one token of so many words."""

    def __init__(self, source: str):
        self.block, self.open = 0, Counter()
        self.boxes: list[list] = [[-1, "", 0, 0]]  # outer box, kind, words, and elements that begin content
        stack: list[tuple[str, int]] = []  # (tag, box)
        found: list[tuple[str, str, int, int, int, bool]] = []
        for place, text, tag, attrs in pieces(source):
            if not tag:
                if text:
                    text = html.unescape(text) if "&" in text else text
                    n, box = len(text.split()), stack[-1][1] if stack else 0
                    self.boxes[box][2] += n
                    found.append(("", text, n, self.block, place, box, self.open["a"] > 0))
                continue
            self.block += tag.lstrip("/") in BLOCKS
            if tag[0] == "/":
                if self.open[tag[1:]]:
                    while self.pop(stack) != tag[1:]:
                        pass
            elif tag not in VOID:
                # An open paragraph ends here, and with it what it left open.
                while tag in BLOCKS and self.open["p"] and stack[-1][0] not in BLOCKS - {"p"}:
                    self.pop(stack)
                while stack and tag in CLOSES.get(stack[-1][0], ()):
                    self.pop(stack)
                outer = stack[-1][1] if stack else 0
                # A header inside an article holds its title.
                inside = tag == "header" and self.open["article"] + self.open["main"]
                if own := "" if inside else kind(tag, attrs):
                    self.boxes.append([outer, own, 0, 0])
                    outer = len(self.boxes) - 1
                self.boxes[outer][3] += tag in MAIN
                stack.append((tag, outer))
                self.open[tag] += 1
            found.append(("<" + tag, "", 1, self.block, place, 0, False))
        names = self.names()
        self.tokens = [(f or names[box] + " link" * linked, text, n, block, place) for f, text, n, block, place, box, linked in found]

    def pop(self, stack: list[tuple[str, int]]) -> str:
        tag = stack.pop()[0]
        self.open[tag] -= 1
        return tag

    def names(self) -> list[str]:
        """What words in each box are called. A box with over half of all words, and with what begins content or with
        many words, is wide; inside of another that is not, a box is what the outer one is."""
        total = sum(n for _, _, n, _ in self.boxes)
        for outer, _, n, begins in reversed(self.boxes[1:]):
            self.boxes[outer][2] += n
            self.boxes[outer][3] += begins
        out = ["word plain"]
        for outer, own, n, begins in self.boxes[1:]:
            over, wide = out[outer], 2 * n > total and (begins or n >= MANY)
            out.append(over if over != "word plain" and "wide" not in over else f"word {'wide ' * wide}{own}")
        return out


@lru_cache(1)
def weights() -> dict[str, float]:
    """Log-ratios of how often labelled pages have a feature inside and outside of content. Words keep theirs; a tag's
    is moved below zero, and one that labelled pages have at the edges of content or outside counts in full."""
    counts = {True: Counter(), False: Counter()}
    for parts in labelled():
        ends, at = [], 0
        for inside, markup in parts:
            at += len(markup)
            ends.append((at, inside))
        for feature, _, n, _, place in Page("".join(markup for _, markup in parts)).tokens:
            counts[next(inside for end, inside in ends if place < end or end == at)][feature] += n
    total = {k: sum(c.values()) for k, c in counts.items()}
    out = {}
    for f in set(counts[True]) | set(counts[False]):
        ratio = math.log((counts[True][f] + SMOOTH) / (total[True] + 1)) - math.log((counts[False][f] + SMOOTH) / (total[False] + 1))
        out[f] = ratio if f.startswith("word") else min(-0.1, ratio - 1)
    return out


def weight(feature: str, known: dict[str, float]) -> float:
    """Unseen words score like plain ones in a wide box, below zero in others; unseen tags little."""
    if feature in known:
        return known[feature]
    if feature.startswith("word"):
        return known["word plain"] if "wide" in feature else -1.0
    return -0.3


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Half-open range of the contiguous stretch of the highest sum, by one scan; (0, 0) if none is above zero."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i + 1)
    return where


def main_text(source: str | None) -> str:
    if not source:
        return ""
    known, tokens = weights(), Page(source).tokens
    score = {f: weight(f, known) for f in {t[0] for t in tokens}}
    # Whether a stretch's words are left out is a matter of their box; a link in an article is part of it.
    kept = {f for f in score if weight(f.removesuffix(" link"), known) > 0}
    a, b = best_stretch([score[f] * n for f, _, n, _, _ in tokens])
    blocks: dict[int, list[str]] = {}
    for feature, text, _, block, _ in tokens[a:b]:
        if text:
            blocks.setdefault(block, []).append(text if feature in kept or text.isspace() else " ")
    return " ".join(t for parts in blocks.values() if (t := " ".join("".join(parts).split())))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row. One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["text"] = [main_text(x) for x in pdf["html"]]
            yield pdf[["page_id", "url", "text"]]

    nobody = F.lit(-(1 << 63))
    out = pages.select(F.coalesce("page_id", nobody).alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string")
    return out.select(F.nullif("page_id", nobody).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
