"""Main text of HTML pages as the maximum-scoring run of their tokens.

A page is a sequence of words and tags. Words score positive and tags negative, words of links and of lists of links less than those of running
text and of lists of text; how much, is counted over labelled pages: the logarithm of how much more often a kind stands in the main text than outside, among
what the parts that go leave over. Of what tags would weigh by that, the share counts that keeps most of the labelled pages' text and least else. One
linear scan finds the run of tokens with the highest sum, the content region.

Parts that are no article (menus, adverts, notices, comments, ...) may stand in the region or between its halves. Each element is
judged by a logistic model learnt from the same pages: its name, the parts of its classes, ids and roles, its share of the page's words, its size,
its share of links, its punctuation, its place, and some of its words. No feature decides alone: an element that holds most of
the page's words that are no links (ALWAYS of them) stays whatever it is called, unless it is named as readers' comments and leaves other text. A part that
goes gives no text and weighs nothing in the scan.

What is not shown as text (scripts, styles, templates, controls) is left out by its element. All steps take time in
proportion to the page.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .htmlpages import IN, OUT, pages
from .shared import of_bytes, text_of

SLICE = 2 << 20
#: Labelled pages that are learnt from, and parts that a word has to stand in to tell them.
LABELLED, TELLING = 900, 12
#: Share of a page's words outside links from which an element is never a part.
ALWAYS = 0.75
#: How much dearer it is to lose an element of the article than to keep another part, and the decay of features' weights.
DEAR, DECAY = 4.0, 5e-7
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is not markup: all up to their end tag belongs to them.
RAW = frozenset("script style template noscript textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that show no text of an article, whatever they hold.
UNSHOWN = frozenset("head script style template noscript textarea title iframe noembed noframes button select option datalist svg canvas object applet audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th"))
LISTS = ("ul", "ol", "dl", "menu")
#: Names by which an element is told as readers' comments.
COMMENTS = frozenset("comment comments commentlist respond replies disqus discussion reactions".split())
#: Elements whose own name tells, and features of names and place.
TELLTALE, NAMES = frozenset("nav aside footer form header".split()), ("tag=", "part=", "role=", "hidden", "in_article", "titled")
QUALIFIERS, STATES = frozenset("no has with without".split()), frozenset("open closed on off enabled disabled link count".split())
#: Shares of tags' weights that are tried, and labelled pages that they are tried on.
SHARES, TRIED = (1.0, 0.5, 0.25, 0.1, 0.05, 0.02), 200
#: Elements of running text. Without attributes they are parts of their own only where a telling word stands in them, and never in an article element.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th blockquote pre figcaption figure caption center hr address".split())
#: An open p ends where a block begins, unless one of these is more inner; and each of the keys ends the open one of its own kind.
P_SCOPE = ("article", "aside", "blockquote", "button", "div", "footer", "form", "header", "li", "main", "nav", "section", "table", "td", "th", "body")
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_LEXICAL = re.compile(r"©|[^\W\d_]+")
_STOPS = re.compile(r"[.,;:!?](?:\s|$)")


@dataclass
class Element:
    name: str
    attributes: str
    parent: int
    begin: int  # its first token
    end: int = 0  # one past its last


@dataclass
class Page:
    """Tokens in order: texts, and tags with the name "" for a text. of: the element that a token lies in (for a start tag the element itself)."""

    texts: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    of: list[int] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)
    listed: list[int] = field(default_factory=list)  # the outermost list around a token, 0 for none
    elements: list[Element] = field(default_factory=lambda: [Element("", "", -1, 0)])


def parse(page: str) -> Page:
    """Broken markup is read as far as it goes: what is left open ends with the page, an end tag without a start is a tag alone."""
    out = Page()
    stack, open_at, elements = [0], {}, out.elements
    at, size, quotes = 0, len(page), True  # quotes: whether attributes may hold ">" in quotes; after one that never ends they may not
    lower = None

    def add(text: str, name: str, of: int) -> None:
        out.texts.append(text)
        out.names.append(name)
        out.of.append(of)
        out.linked.append(bool(open_at.get("a")))
        out.listed.append(min((stack[open_at[x][0]] for x in LISTS if open_at.get(x)), default=0))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            e = elements[stack.pop()]
            e.end = len(out.texts)
            open_at[e.name].pop()

    def close(name: str, within: tuple[str, ...] = ()) -> bool:
        """Closes the innermost open element of the name, and what is open in it, unless one of `within` is more inner."""
        mine = open_at.get(name)
        if not mine or any(open_at.get(w) and open_at[w][-1] > mine[-1] for w in within):
            return False
        pop_to(mine[-1])
        return True

    while at < size:
        less = page.find("<", at)
        if less < 0:
            less = size
        if less > at:
            add(page[at:less], "", stack[-1])
            at = less
            continue
        follows = page[at + 1 : at + 2]
        if follows == "!":
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                at = size if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at) and (end := page.find("]]>", at)) >= 0:
                add(entities.escape(page[at + 9 : end]), "", stack[-1])
                at = end + 3
            elif page.startswith("<![CDATA[", at):  # it takes all that is left
                add(entities.escape(page[at + 9 :]), "", stack[-1])
                at = size
            else:
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            continue
        closing = follows == "/"
        found = _NAME.match(page, at + 1 + closing)
        if not found:
            if follows in ("?", "/") and (end := page.find(">", at)) >= 0:
                at = end + 1
            else:
                add("<", "", stack[-1])
                at += 1
            continue
        name = found[0].lower()
        begin = found.end()
        end = _ATTRIBUTES.match(page, begin).end() if quotes else page.find(">", begin)
        if quotes and end < size and page[end] != ">":  # a quote that never ends
            quotes, end = False, page.find(">", begin)
        end = size if end < 0 else end
        attributes = page[begin:end]
        at = end + 1
        if closing:
            if name in open_at and open_at[name]:
                e = stack[open_at[name][-1]]
                add("", name, e)
                close(name)
            else:
                add("", name, stack[-1])
            continue
        if name in BLOCKS and name != "br":
            close("p", P_SCOPE)
        if name in SELF_CLOSING:
            close(name, SELF_CLOSING[name])
        if name in VOID or attributes.endswith("/"):
            add(attributes if name == "input" else "", name, stack[-1])
            continue
        elements.append(Element(name, attributes, stack[-1], len(out.texts)))
        add("", name, len(elements) - 1)
        open_at.setdefault(name, []).append(len(stack))
        stack.append(len(elements) - 1)
        if name in RAW:
            lower = lower or page.lower()
            if len(lower) != size:  # some letters have another number of characters in lower case
                lower = page
            stop = lower.find(f"</{name}", at)
            if stop < 0:
                at = size
            else:
                end = page.find(">", stop)
                at = size if end < 0 else end + 1
            pop_to(len(stack) - 1)
    pop_to(1)
    elements[0].end = len(out.texts)
    return out


def _bin(x: float, *edges: float) -> int:
    return sum(x > e for e in edges)


def _labels(name: str, attributes: str) -> list[str]:
    """Features of an element's own tag."""
    out = [f"tag={name}"]
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                parts = [p.lower() for p in _PART.findall(value)]
                # what a name says that there is or is not, it is not itself
                out += {f"part={before}-{p}" if before in QUALIFIERS else f"part={p}-{after}" if after in STATES else f"part={p}" for before, p, after in zip(["", *parts], parts, [*parts[1:], ""])}
            elif key == "role":
                out.append(f"role={value.lower()}")
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                out.append("hidden")
    return out


def named_comments(e: Element) -> bool:
    """Whether an element's name says that it holds readers' comments."""
    return bool(e.attributes) and any(f.removeprefix("part=") in COMMENTS for f in _labels(e.name, e.attributes))


class Judged:
    """Counts over a page's tokens, from which an element's features follow by differences."""

    def __init__(self, page: Page, lexicon: frozenset[str] | None, comments: bool = False):
        """lexicon: the words that count as features; None: all. comments: whether elements named as readers' comments count; they do where they have all the
        words outside links, and else are taken as not shown, so shares are those of the rest."""
        self.page = page
        titles = np.cumsum([0, *(x == "h1" for x in page.names)]).tolist()
        unshown = np.zeros(len(page.elements), dtype=bool)
        for i, e in enumerate(page.elements):
            unshown[i] = e.name in UNSHOWN or (e.parent >= 0 and unshown[e.parent]) or (not comments and titles[e.begin] == titles[e.end] and named_comments(e))
        if not comments and not any(not unshown[o] and not n and not k and t.strip() for o, n, k, t in zip(page.of, page.names, page.linked, page.texts, strict=True)):
            return self.__init__(page, lexicon, comments=True)
        self.unshown, self.titles = unshown, titles
        self.in_article = [False] * len(page.elements)
        for i, e in enumerate(page.elements[1:], 1):
            self.in_article[i] = self.in_article[e.parent] or page.elements[e.parent].name in ("article", "main")
        n = len(page.texts)
        self.words, self.link_words, stops, controls = (np.zeros(n + 1, dtype=np.int64) for _ in range(4))
        self.said: dict[str, list[int]] = {}
        self.links_said: dict[str, list[int]] = {}
        for i, (text, name, of) in enumerate(zip(page.texts, page.names, page.of, strict=True)):
            if name:
                controls[i + 1] = name in ("input", "button", "select", "textarea")
            elif not unshown[of]:
                k = len(text.split())
                self.words[i + 1] = k
                if page.linked[i]:
                    self.link_words[i + 1] = k
                if k:
                    stops[i + 1] = len(_STOPS.findall(text))
                    if k <= 40:  # texts that are longer are prose
                        held = self.links_said if page.linked[i] else self.said
                        for w in _LEXICAL.findall(entities.unescape(text).lower() if "&" in text else text.lower()):
                            if lexicon is None or w in lexicon:
                                held.setdefault(w, []).append(i)
        links = [(i, t.strip().lower()) for i, (t, link) in enumerate(zip(page.texts, page.linked, strict=True)) if link and t.strip() and not unshown[page.of[i]]]
        often = max(Counter(t for _, t in links).items(), key=lambda x: (x[1], x[0]), default=("", 0))[0]
        self.links, self.repeated = [i for i, _ in links], [i for i, t in links if t == often]
        self.all_words = self.words
        self.words, self.link_words, self.stops, self.controls = (np.cumsum(x).tolist() for x in (self.words, self.link_words, stops, controls))

    def candidates(self) -> Iterator[int]:
        """Elements that may be parts: blocks, cells, and inline elements with attributes, if they have words and are shown."""
        for i, e in enumerate(self.page.elements[1:], 1):
            if e.name in ("html", "body", "tbody", "br") or self.unshown[i] or self.words[e.end] == self.words[e.begin]:
                continue
            if e.name in BLOCKS or e.name in CELLS or (e.attributes and e.name != "a"):
                yield i

    def share(self, i: int) -> float:
        """Of the page's words outside links."""
        e = self.page.elements[i]
        return (self.words[e.end] - self.link_words[e.end] - self.words[e.begin] + self.link_words[e.begin]) / max(self.words[-1] - self.link_words[-1], 1)

    def features(self, i: int) -> list[str]:
        e = self.page.elements[i]
        n = self.words[e.end] - self.words[e.begin]
        linked = self.link_words[e.end] - self.link_words[e.begin]
        plain, every = n - linked, max(self.words[-1] - self.link_words[-1], 1)
        before = (self.words[e.begin] - self.link_words[e.begin]) / every
        after = 1 - (self.words[e.end] - self.link_words[e.end]) / every
        stops = self.stops[e.end] - self.stops[e.begin]
        out = _labels(e.name, e.attributes)
        out += [f"links={_bin(linked / n, 0, 0.2, 0.5, 0.8)}", f"share={_bin(plain / every, 0.02, 0.1, 0.25, 0.5, 0.75)}", f"size={_bin(n, 5, 15, 40, 120)}", f"stops={_bin(stops / n, 0, 0.04)}"]
        out += [f"before={_bin(before, 0.001, 0.05, 0.5, 0.95)}", f"after={_bin(after, 0.001, 0.05, 0.5, 0.95)}"]
        if plain <= 0.25 * every and e.name not in TEXTUAL:
            out.append(f"small={e.name}")
        if self.controls[e.end] > self.controls[e.begin]:
            out.append("controls")
        if self.in_article[i]:
            out.append("in_article")
        if self.titles[e.end] > self.titles[e.begin]:
            out.append("titled")
        same, links = (bisect_left(x, e.end) - bisect_left(x, e.begin) for x in (self.repeated, self.links))
        if same > 1 and same > 0.6 * links:  # the page's most frequent link, as under each comment
            out.append("repeated_link")
        within = lambda held: [w for w, at in held.items() if (k := bisect_left(at, e.begin)) < len(at) and at[k] < e.end]
        out += [f"linkword={w}" for w in within(self.links_said)]
        first = bisect_left(self.words, self.words[e.begin] + 1, e.begin, e.end + 1)  # its first text with a word
        lead = self.words[e.begin] + 6
        for w, at in self.said.items():
            k = bisect_left(at, e.begin)
            if k < len(at) and at[k] < e.end and (n <= 40 or (at[k] >= first - 1 and self.words[at[k]] < lead)):
                out.append(f"word={w}")
        return out


@dataclass
class Weights:
    features: dict[str, float]
    tokens: dict[str, float]
    lexicon: frozenset[str]


def _link_lists(judged: Judged) -> set[int]:
    """Lists most of whose words are links."""
    e = judged.page.elements
    return {i for i in set(judged.page.listed) if i and 2 * (judged.link_words[e[i].end] - judged.link_words[e[i].begin]) > judged.words[e[i].end] - judged.words[e[i].begin]}


def _kind(page: Page, i: int, link_lists: set[int]) -> str:
    """The kind of a token, which its score follows from."""
    listed = ":links" if page.listed[i] in link_lists else ":text"
    if name := page.names[i]:
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return "tag:heading"
        if name in ("ul", "ol", "li", "dl", "dt", "dd", "menu"):
            return f"tag:list{listed}"
        if name in ("table", "tr", "td", "th", "tbody", "thead", "tfoot"):
            return "tag:table"
        return f"tag:{name}" if name in ("a", "p", "br", "blockquote") else "tag:block" if name in BLOCKS else "tag:inline"
    return "word:link" if page.linked[i] else f"word:list{listed}" if page.listed[i] else "word:text"


def learn(labelled: list[str], rounds: int = 800, least: int = 4) -> Weights:
    """Weights from pages with their main text between IN and OUT: of tokens, by counting; of features, by logistic regression. A feature of fewer than `least`
    elements does not count, nor a word of fewer than TELLING parts, or of which one in twenty elements is no part."""
    rows, marks, read = [], [], []
    for text in labelled:
        marked = parse(text)
        main, within = [], False
        for i, t in enumerate(marked.texts):
            kept = []
            for part in re.split(f"([{IN}{OUT}])", t):
                if part in (IN, OUT):
                    within = part == IN
                else:
                    kept.append(part)
            main.append(within or IN in t)
            marked.texts[i] = "".join(kept)
        judged = Judged(marked, None)
        read.append((judged, main))
        words = np.diff(judged.words)
        good = np.concatenate([[0], np.cumsum(words * np.array(main, dtype=bool))])
        for i in judged.candidates():
            e = marked.elements[i]
            fs = judged.features(i)
            rows.append(fs)
            marks.append(good[e.end] == good[e.begin])
            if e.attributes or e.name in TELLTALE:  # twice more by its name alone, which then tells where no word and no link does
                rows += [[f for f in fs if f.startswith(NAMES)]] * 2
                marks += [marks[-1]] * 2
    seen = Counter(f for r in rows for f in r)
    parts = Counter(f for r, mark in zip(rows, marks, strict=True) if mark for f in r)
    told = lambda f, n: n >= least if not f.startswith(("word=", "linkword=")) else n >= TELLING and parts[f] >= 0.95 * n
    listed = sorted(f for f, n in seen.items() if told(f, n))
    number = {f: k for k, f in enumerate(listed)}
    x = np.zeros((len(rows), len(listed) + 1))
    x[:, -1] = 1
    for r, fs in enumerate(rows):
        x[r, [number[f] for f in fs if f in number]] = 1
    y, w = np.array(marks, dtype=float), np.zeros(len(listed) + 1)
    cost = np.where(y > 0, 1.0, DEAR)
    cost /= cost.sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = x.T @ (cost * (1 / (1 + np.exp(-(x @ w))) - y)) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    lexicon = frozenset(f.split("=", 1)[1] for f in listed if f.startswith(("word=", "linkword=")))
    known = Weights({f: float(w[k]) for f, k in number.items()} | {"": float(w[-1])}, {}, lexicon)
    inside, out = Counter(), Counter()
    gones = [left_out(judged, known) for judged, _ in read]
    for (judged, main), gone in zip(read, gones, strict=True):
        page, links = judged.page, _link_lists(judged)
        for i, of in enumerate(page.of):
            if not gone[of]:
                (inside if main[i] else out)[_kind(page, i, links)] += 1 if page.names[i] else len(page.texts[i].split())
    kinds = inside.keys() | out.keys()
    total_in, total_out = sum(inside.values()) + len(kinds) / 2, sum(out.values()) + len(kinds) / 2
    raw = {k: math.log((inside[k] + 0.5) / total_in) - math.log((out[k] + 0.5) / total_out) for k in kinds}

    def scored(share: float) -> Weights:
        return Weights(known.features, {k: max(x, 0.05) if k in ("word:text", "word:list:text") else x if k.startswith("word") else min(share * x, -0.01) for k, x in raw.items()}, lexicon)

    def right(share: float) -> float:
        """Twice the words that are rightly kept, by the words that are kept and those that should be."""
        both = every = 0
        for (judged, main), gone in zip(read[:TRIED], gones[:TRIED], strict=True):
            gone, begin, end = region(judged, scored(share), gone)
            words = np.diff(judged.words)
            kept = np.array([begin <= i < end and not g for i, g in enumerate(gone)])
            both += int(words[kept & np.array(main)].sum())
            every += int(words[kept].sum() + words[np.array(main)].sum())
        return 2 * both / max(every, 1)

    return scored(max(SHARES, key=right))


@cache
def weights() -> Weights:
    return learn([p for pair in zip(pages(LABELLED // 2), pages(LABELLED // 2, seed=1, names=False), strict=True) for p in pair])


def best_run(scores: list[float]) -> tuple[int, int]:
    """[begin, end) of the run with the highest sum; the longest of equal ones that begin first; (0, 0) if no score is positive."""
    best, begin, end, run, run_begin = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if run < 0:
            run, run_begin = 0.0, i
        run += score
        if run > best or (run == best and begin == run_begin and end):
            best, begin, end = run, run_begin, i + 1
    return begin, end


def left_out(judged: Judged, known: Weights, sure: bool = True) -> list[bool]:
    """Of each element, whether it or one around it is a part that is no article, or not shown. Where that leaves no text, elements named article or main are
    no parts (not `sure`)."""
    page = judged.page
    gone = judged.unshown.tolist()
    bias, of = known.features[""], known.features.get
    judge = set(judged.candidates())
    for i, e in enumerate(page.elements[1:], 1):
        if gone[e.parent]:
            gone[i] = True
        elif i in judge:
            if judged.share(i) > ALWAYS or (not sure and e.name in ("article", "main")):
                continue
            fs = judged.features(i)
            if e.name not in TEXTUAL or e.attributes or (not judged.in_article[i] and any(f in known.features for f in fs if f.startswith(("word=", "linkword=")))):
                gone[i] = bias + sum(of(f, 0.0) for f in fs) > 0
    if sure and not any(not gone[o] and not n and not k and t.strip() for o, n, k, t in zip(page.of, page.names, page.linked, page.texts, strict=True)):
        return left_out(judged, known, sure=False)
    return gone


def region(judged: Judged, known: Weights, gone: list[bool] | None = None) -> tuple[list[bool], int, int]:
    """(of each token, whether it is left out; first and one past the last token of the content region). gone: what left_out says, if it is known."""
    page, gone, links = judged.page, gone or left_out(judged, known), _link_lists(judged)
    out = [gone[of] for of in page.of]
    words = judged.all_words[1:].tolist()
    scores = [0.0 if o else known.tokens.get(_kind(page, i, links), -0.05) * (1 if page.names[i] else words[i]) for i, o in enumerate(out)]
    return out, *best_run(scores)


def main_text(text: str | None, known: Weights | None = None) -> str:
    """The blocks of the content region, white space inside a block as one space, joined by line ends."""
    if not text:
        return ""
    page, known = parse(text), known or weights()
    out, begin, end = region(Judged(page, known.lexicon), known)
    blocks, now = [], []
    for i in range(begin, end):
        name = page.names[i]
        if not name:
            if not out[i]:
                now.append(page.texts[i])
        elif name in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif name in CELLS and not out[i]:
            now.append(" ")
    blocks.append("".join(now))
    clean = (" ".join(entities.unescape(x).split()) for x in blocks)
    return "\n".join(x for x in clean if x)


def extract(table: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row for each row of a table of pages. A null or empty page, or one without words outside of menus and the like, has the text "".

    Whole pages are read; other columns are not. The weights are learnt once, on the driver, from LABELLED pages, whatever the table."""
    known = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of_bytes(batches, "html", SLICE):
            texts = [main_text(x, known) for x in text_of(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return table.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
