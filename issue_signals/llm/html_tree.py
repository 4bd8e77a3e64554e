"""A page as a tree of block elements and text blocks, and the features of its nodes."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from math import log1p

import numpy as np

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FRAME = frozenset(["html", "head", "body"])
UNSEEN = frozenset("script style template title".split())
#: Elements inside a paragraph that hold what is shown in place of something else; the trees judge them.
EMBEDDED = frozenset("noscript iframe object canvas select textarea".split())
_WITHOUT_BLOCKS = EMBEDDED - {"noscript", "object"}
_NODES = BLOCKS | EMBEDDED
#: What a start tag closes, and the element at which the search for it ends.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset("tbody thead tfoot".split()), frozenset(["table"])),
}
_KEEP_P = frozenset(["button", "td", "th", "table"])
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_SENTENCE = re.compile(r"[.!?…](?:\s|$)")
_GAP = re.compile(r"\s+")
_ENDS = re.compile(f"</({'|'.join(sorted(EMBEDDED))})", re.I)


class _Builder(HTMLParser):
    """tags, parents, tokens and texts of the nodes in page order; node 0 is the page. A node whose tag is
    "#text" is a run of text between two block boundaries; links holds its characters inside links.

    Embedded elements are nodes too. One without an end tag marks nothing, so what follows it stays where it is."""

    CDATA_CONTENT_ELEMENTS, RCDATA_CONTENT_ELEMENTS = ("script", "style"), ()  # the same in all versions of the parser

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.tokens, self.texts, self.links = ["#page"], [-1], [frozenset()], [None], [0]
        self.open: list[tuple[str, int]] = [("#page", 0)]  # inline elements have their block's node
        self.run, self.in_link, self.unseen = -1, 0, ""
        self.ends = Counter(tag.lower() for tag in _ENDS.findall(html))  # end tags that are still to come
        self.feed(html)
        self.close()

    def _node(self, tag: str, tokens: frozenset[str], text: list[str] | None) -> int:
        self.tags.append(tag)
        self.parents.append(self.open[-1][1])
        self.tokens.append(tokens)
        self.texts.append(text)
        self.links.append(0)
        return len(self.tags) - 1

    def _close(self, tags: frozenset[str], until: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k][0]
            if tag in tags:
                self.in_link -= sum(t == "a" for t, _ in self.open[k:])
                del self.open[k:]
                return
            if tag in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.unseen and not (self.unseen == "title" and (tag in BLOCKS or tag == "body")):
            return
        self.unseen = ""
        if tag in FRAME:
            self.run = -1
            return
        if tag in UNSEEN:
            self.unseen = tag
            return
        words = {w.lower() for name, value in attrs if name in ("class", "id", "role") and value for w in _TOKEN.findall(value)}
        words |= {name for name, value in attrs if name in ("hidden", "contenteditable") or (name, value) == ("aria-hidden", "true")}
        if any(name == "style" and value and re.search(r"display:\s*none", value) for name, value in attrs):
            words.add("hidden")
        if tag in EMBEDDED:
            if self.ends[tag] > 0:
                self.run = -1
                self.open.append((tag, self._node(tag, frozenset(words), None)))
            return
        if tag in BLOCKS:
            self.run = -1
            self._close(_WITHOUT_BLOCKS, _NODES)
            if tag in CLOSES:
                self._close(*CLOSES[tag])
            else:
                self._close(frozenset(["p"]), _KEEP_P)
            if tag not in VOID:
                self.open.append((tag, self._node(tag, frozenset(words), None)))
            return
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        self.open.append((tag, self.open[-1][1]))
        self.in_link += tag == "a"
        if words and self.run >= 0:
            self.tokens[self.run] |= words

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in EMBEDDED:
            return
        self.handle_starttag(tag, attrs)
        if tag in UNSEEN:
            self.unseen = ""

    def handle_endtag(self, tag: str) -> None:
        self.ends[tag] -= tag in EMBEDDED
        if self.unseen:
            self.unseen = "" if tag == self.unseen else self.unseen
            return
        if tag in _NODES or tag in FRAME:
            self.run = -1
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self.in_link -= sum(t == "a" for t, _ in self.open[k:])
                del self.open[k:]
                return
            if tag not in _NODES and self.open[k][0] in _NODES:
                return  # the end of an inline element doesn't close a block

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        if self.run < 0:
            if data.isspace():
                return
            self.run = self._node("#text", frozenset(), [])
        self.texts[self.run].append(data)
        if self.in_link:
            self.links[self.run] += len(data)

    def unknown_decl(self, data: str) -> None:
        pass


class Page:
    """The nodes of a page; text of a text block with white space as one space, trimmed."""

    def __init__(self, html: str | None) -> None:
        try:
            built = _Builder(html or "")
        except AssertionError:  # a declaration that the parser doesn't know
            built = _Builder((html or "").replace("<![", "&lt;!["))
        self.tags, self.parents, self.tokens, self.links = built.tags, built.parents, built.tokens, built.links
        self.texts = [None if t is None else _GAP.sub(" ", "".join(t)).strip() for t in built.texts]


FEATURES = (
    "own tag, own lowest token, own highest token, tokens, lowest above, highest above, depth, is text, characters, words, link share,"
    " sentences per word, word length, children, place among siblings, siblings, siblings of same tag, sibling characters, parent characters,"
    " parent link share, share of page, share of page before, parent's share, grandparent's share, blocks, block characters, signs,"
    " digits, nearest token above"
).split(", ")


def features(page: Page, tag_scores: dict[str, float], token_scores: dict[str, float]) -> np.ndarray:
    """One row of FEATURES per node. Scores are the smoothed shares of content among a tag's or token's nodes."""
    n = len(page.tags)
    chars, words, links, sentences, blocks, signs, digits = ([0] * n for _ in range(7))
    kids: list[list[int]] = [[] for _ in range(n)]
    before, seen = [0] * n, 0
    for v in range(n):
        if v:
            kids[page.parents[v]].append(v)
        before[v] = seen
        text = page.texts[v]
        if text is not None:
            seen += len(text)
            chars[v], words[v], links[v], blocks[v] = len(text), text.count(" ") + 1, min(page.links[v], len(text)), 1
            sentences[v] = len(_SENTENCE.findall(text))
            signs[v] = sum(map(text.count, "©|»›·•"))
            digits[v] = sum(map(text.count, "0123456789"))
    for v in range(n - 1, 0, -1):
        p = page.parents[v]
        for sums in (chars, words, links, sentences, blocks, signs, digits):
            sums[p] += sums[v]
    low, high, nearest, depth = [0.5] * n, [0.5] * n, [0.5] * n, [0] * n
    rows = []
    alike: dict[int, Counter[str]] = {}
    total = max(1, seen)
    for v in range(n):
        tag = tag_scores.get(page.tags[v], 0.5)
        own = [token_scores[t] for t in page.tokens[v] if t in token_scores]
        own_low, own_high = min(own, default=0.5), max(own, default=0.5)
        p = page.parents[v]
        around: list[int] = [v]
        if v:
            depth[v] = depth[p] + 1
            around = kids[p]
        above_low, above_high, above_near = (low[p], high[p], nearest[p]) if v else (0.5, 0.5, 0.5)
        low[v], high[v] = min(above_low, own_low, tag), max(above_high, own_high, tag)
        nearest[v] = own_low if own and abs(own_low - 0.5) >= abs(own_high - 0.5) else own_high if own else above_near
        if p not in alike:
            alike[p] = Counter(page.tags[w] for w in around)
        same = alike[p][page.tags[v]]
        place = (around[0] != v) * (v - around[0]) / max(1, around[-1] - around[0])
        up = max(p, 0)
        upper = max(page.parents[up], 0)
        rows.append((
            tag, own_low, own_high, len(page.tokens[v]), above_low, above_high, depth[v], page.tags[v] == "#text", log1p(chars[v]), log1p(words[v]),
            links[v] / max(1, chars[v]), sentences[v] / max(1, words[v]), chars[v] / max(1, words[v]), log1p(len(kids[v])), place, log1p(len(around)),
            same / len(around), log1p((chars[up] - chars[v]) / max(1, len(around) - 1)), log1p(chars[up]), links[up] / max(1, chars[up]),
            chars[v] / total, before[v] / total, chars[up] / total, chars[upper] / total, log1p(blocks[v]), log1p(chars[v] / max(1, blocks[v])),
            signs[v] / max(1, words[v]), digits[v] / max(1, chars[v]), above_near,
        ))
    return np.array(rows, float)


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The likeliest choice of nodes in which a node is chosen only if its parent is: log odds are summed
    bottom up over what is best below, and the choice is read off top down."""
    gain = odds.astype(float).tolist()
    gain[0] = 0.0
    best = [0.0] * len(gain)
    for v in range(len(gain) - 1, 0, -1):
        best[v] += gain[v]
        if best[v] > 0:
            best[page.parents[v]] += best[v]
    chosen = [True] * len(gain)
    for v in range(1, len(gain)):
        chosen[v] = chosen[page.parents[v]] and best[v] > 0
    return chosen


def text_of(page: Page, chosen: list[bool]) -> str:
    return " ".join(t for t, keep in zip(page.texts, chosen) if keep and t)
