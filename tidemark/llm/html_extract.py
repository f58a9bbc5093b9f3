"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by link
density, length and stop-word density. Where a block stands moves these limits: menus,
footers, forms and the like, by tag or by name, are bad; in what is marked as the article
only lists of links are bad. A name counts as a whole (``entry-header`` is part of an entry,
``has-sidebar`` says something about the layout), never on html and body, and an article
inside a wrapper with a wrong name is still one. Stop words are listed for four languages;
short words that the page's long blocks repeat count too, and scripts without spaces need
none. Short blocks that this leaves open are ambiguous. In the second pass each takes the
label of the nearest decided blocks: theirs if both sides agree, else that of the closer
one, and bad where they tie or none is decided.

Places are not trusted blindly. If what they rule out holds more than ``DOUBT`` times the
text of all that is found, of blocks that are dense enough to be good, the names and tags are
about the whole page (``comments-open`` on its wrapper, a form around everything, a menu
without an end). The page is then judged again, with names and forms having no say and articles
standing wherever they are. If no block is good even so (short paragraphs only, a table, a
language without listed words), the longest run of blocks that are not links is the text.

Defined cases: a null page or one without text gives the empty string; unclosed and crossed
tags close at the next tag that ends them; a head without an end tag ends at the first
block; an unclosed comment or script runs to the end of the page; a tag without an end is
text; repeated rows keep a row each; other columns are carried through, and one with the
name of the result is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import give_back

#: Attributes: quotes count after an equals sign only, and what is taken is not given back, so that a page is read in linear time.
_REST = r"(?>[^<>=]|=\s*+(?>\"[^\"]*+\"|'[^']*+'|))*+"
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<svg\b" + _REST + r"(?<=/)>|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title)\b" + _REST + r">(?:.*?</(?P=raw)\s*>|.*)"
    r"|<![^<>]*>|<\?[^<>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>" + _REST + r")>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_HINT = re.compile(r"(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
#: Tags that end a block.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OUTSIDE = frozenset("head nav footer aside form menu button fieldset dialog".split())
INSIDE = frozenset("article main".split())
#: Words in class, id or role that name what is not the article.
OUTSIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget footer header masthead cookie cookies consent notice notification alert popup modal newsletter subscribe signup login search share sharing social related recommended comment comments reply replies disqus pagination pager toolbar copyright legal disclaimer form complementary contentinfo responses cta teaser teasers stories recommendations".split())
INSIDE_WORDS = frozenset("article content post story entry main body text".split())
#: Words that turn a name into a statement about the layout around it (``has-sidebar``).
LAYOUT = frozenset("has with without no not show hide is".split())
#: Outside words that are part of an article where a name says so (``entry-header``).
PARTS = frozenset("header masthead legal".split())
#: Tags that may stand in a head; any other block ends a head without an end tag.
HEAD = frozenset("base link meta".split())
#: Letters of scripts that are written without spaces.
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0e7f]")
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("the of and to in a is that it for on was be with as by this are from at or an der die das und ist von zu den mit sich des auf für im dem nicht ein eine als auch de la le et les des un une est pour que dans qui sur au par el los las en y del se por con su para al lo como más".split())
SHORT, LONG = 70, 140
LINKS, LINKS_INSIDE, STOPS = 0.5, 0.9, 0.2
#: Text that places rule out for each of the text found, from which on they are doubted.
DOUBT = 4


class _Block:
    __slots__ = ("chars", "label", "links", "parts")

    def __init__(self, label: str) -> None:
        self.parts: list[str] = []
        self.chars = self.links = 0
        self.label = label


def _hints(rest: str) -> tuple[bool, bool]:
    """Whether names in class, id or role speak for the article, and against it."""
    inside = outside = False
    for value in _HINT.findall(rest):
        for name in value.strip("\"'").lower().split():
            words = _WORD.findall(name)
            if not words or words[0] in LAYOUT:
                continue
            inside |= not INSIDE_WORDS.isdisjoint(words)
            against = OUTSIDE_WORDS.intersection(words)
            outside |= bool(against - PARTS if INSIDE_WORDS.intersection(words) else against)
    return inside, outside


def _place(tag: str, rest: str, outer: str, trust: bool = True) -> str:
    """Where a tag puts its content: ``out`` by its tag, ``-`` by its names only, ``in``, or ``?`` (undecided).

    Without ``trust`` names and forms say nothing, and an article is one wherever it stands.
    """
    if not trust:
        if tag in INSIDE:
            return "in"
        if outer == "out" or tag in OUTSIDE and tag != "form" or tag == "header" and outer != "in":
            return "out"
        return outer
    if outer == "out" or tag in OUTSIDE or (tag == "header" and outer != "in"):
        return "out"
    if tag in ("html", "body"):
        return outer
    inside, outside = _hints(rest)
    # An element that names the article may also name its surroundings, and an article inside a wrapper with a wrong name is one.
    if tag in INSIDE and (inside or not outside):
        return "in"
    if outer == "-" or outside:
        return "-"
    if inside and outer != "in" and tag in ("div", "section"):
        return "in"
    return outer


def blocks(page: str, trust: bool = True) -> list[_Block]:
    found: list[_Block] = []
    stack: list[tuple[str, str]] = [("", "?")]
    open_: Counter[str] = Counter()
    now = _Block("?")
    anchors = 0

    def push(tag: str, place: str) -> None:
        stack.append((tag, place))
        open_[tag] += 1

    def pop() -> str:
        tag = stack.pop()[0]
        open_[tag] -= 1
        return tag

    def cut() -> None:
        nonlocal now
        if now.chars:
            found.append(now)
        now = _Block(stack[-1][1])

    for token in _TOKEN.finditer(page):
        text, tag = token["text"], token["tag"]
        if text is not None:
            now.parts.append(text)
            size = len(text) - text.count(" ")
            now.chars += 0 if text.isspace() else size
            now.links += size if anchors else 0
            continue
        if tag is None:
            now.parts.append("")
            continue
        tag = tag.lower()
        if tag == "a":
            anchors = 0 if token["end"] else 1
            continue
        if not token["end"] and stack[-1][0] == "head" and tag in BLOCK:
            pop()  # a head without an end tag
        if tag not in BLOCK:
            now_at = stack[-1][1]
            hidden = not token["end"] and tag not in VOID and now_at not in ("out", "-") and _place(tag, token["rest"], now_at, trust) in ("out", "-")
            if hidden or token["end"] and any(t == tag for t, _ in stack[-4:]):
                cut()
                if hidden:
                    push(tag, "out")
                elif stack[-1][0] == tag:
                    pop()
                now.label = stack[-1][1]
            continue
        if token["end"]:
            if open_[tag]:
                while pop() != tag:
                    pass
        else:
            # A paragraph, item or cell ends where the next block starts.
            while stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                pop()
            if tag not in VOID:
                push(tag, _place(tag, token["rest"], stack[-1][1], trust))
        cut()
    cut()
    return found


def _density(text: str, common: frozenset[str]) -> float:
    """Share of function words: of the listed ones and those that the page repeats; full for scripts without spaces."""
    words = text.lower().split()
    if len(_DENSE.findall(text)) > 0.3 * len(text):
        return 1.0
    return sum(w in STOP_WORDS or w in common for w in words) / len(words)


def _first_pass(block: _Block, text: str, common: frozenset[str]) -> str:
    links = block.links / max(block.chars, 1)
    if block.label == "out":
        return "bad"
    if block.label == "in":
        # Inside an article, only a list of links is none of its text.
        return "bad" if links > LINKS_INSIDE and len(text) >= SHORT else "good"
    if links > LINKS or block.label == "-":
        return "bad"
    stops = _density(text, common)
    if len(text) < SHORT and not (stops == 1.0 and len(text) >= SHORT // 3):
        return "bad" if links > 0.2 else "?"
    if stops >= STOPS:
        return "good" if len(text) >= LONG or stops == 1.0 else "?"
    return "?" if stops > STOPS / 2 else "bad"


def _common(texts: list[str]) -> frozenset[str]:
    """Short words that make up much of the page's long blocks, as function words do in any language."""
    words = [w for t in texts if len(t) >= LONG for w in t.lower().split()]
    counts = Counter(w for w in words if len(w) <= 4 and w.isalpha())
    return frozenset(w for w, n in counts.most_common(40) if n >= 2 and n >= 0.008 * len(words))


def _second_pass(labels: list[str]) -> list[str]:
    n = len(labels)
    before, after, last = [-1] * n, [n] * n, -1
    for k in range(n):
        before[k] = last = k if labels[k] != "?" else last
    last = n
    for k in range(n - 1, -1, -1):
        after[k] = last = k if labels[k] != "?" else last
    out = []
    for k, label in enumerate(labels):
        left = labels[before[k]] if before[k] >= 0 else None
        right = labels[after[k]] if after[k] < n else None
        if label != "?":
            out.append(label)
        elif left and right and left != right:
            gap = (k - before[k]) - (after[k] - k)
            out.append(left if gap < 0 else right if gap > 0 else "bad")
        else:
            out.append(left or right or "bad")
    return out


def _texts(page: str, trust: bool) -> list[tuple[_Block, str]]:
    found = [(b, " ".join(html.unescape("".join(b.parts)).split())) for b in blocks(page, trust)]
    return [(b, t) for b, t in found if t]


def _good(found: list[tuple[_Block, str]]) -> tuple[list[str], int]:
    """The good blocks' texts, and the size of those that a place rules out but their density does not."""
    common = _common([t for b, t in found if b.label == "?"])
    labels = _second_pass([_first_pass(b, t, common) for b, t in found])
    ruled_out = 0
    for (b, t), label in zip(found, labels, strict=True):
        if label == "bad" and b.label in ("out", "-") and len(t) >= LONG and b.links <= 0.2 * b.chars and _density(t, common) >= STOPS:
            ruled_out += len(t)
    return [t for (_, t), label in zip(found, labels, strict=True) if label == "good"], ruled_out


def _longest_run(found: list[tuple[_Block, str]]) -> list[str]:
    best: list[str] = []
    now: list[str] = []
    for b, t in [*found, (_Block("out"), "")]:
        if b.label != "out" and b.links <= 0.2 * b.chars:
            now.append(t)
        else:
            best = max(best, now, key=lambda run: sum(map(len, run)))
            now = []
    return best


def main_text(page: str | None) -> str:
    """The article's text: white space folded inside a block, blocks joined by one space."""
    texts, ruled_out = _good(_texts(page or "", True))
    if not texts or ruled_out > DOUBT * sum(map(len, texts)):
        again = _texts(page or "", False)
        more, _ = _good(again)
        texts = max(texts, more or _longest_run(again), key=lambda x: sum(map(len, x)))
    return " ".join(texts)


def extracted(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([main_text(page) for page in column], dtype=object)
        give_back()

    return pages.withColumn(text_col, extract(F.col(html_col)))
