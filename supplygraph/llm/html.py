"""Main text of web pages: a chain CRF over the leaf blocks of the DOM.

A page is read once, from left to right, as a stream of tags and texts. A block
is a stretch of text that no block-level tag interrupts; it knows the open
element it stands in, and through it its ancestors (tag names and the words of
their class, id and role). Features are what the block is (paragraph, heading,
list item, ...), its text (length, link share, punctuation), its place, names of
its ancestors that common layouts use, and how its container compares with the
others: how much prose it holds, how much of it is links, and whether the block
is in, before or after the container with most prose. Viterbi decoding labels
the blocks of a page as main text or not. The field is trained on labelled pages
that are laid out by rule below: each template states which of its parts are
main text, and in many neither main nor side parts have a name that tells.

Scripts, styles, templates, comments, buttons and the head are markup, not
blocks; so is what an attribute hides (``hidden``, ``aria-hidden="true"``, a
style with ``display: none``). Text of formulas and drawings is text of the block
around it. Missing end tags close where HTML closes them: a paragraph at the next
block, a list item at the next item, everything at the end of the page. Time and
memory grow with the page's length, however odd its markup: a tag without its
end is text, a quote without its end is a character.

Defined results: a null or empty page has the empty text; a page without main
text as well; pages of equal id each get a row; null ids and urls stay null; an
empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplygraph.llm import common as C
from supplygraph.llm.crf import ChainCrf

RAW = frozenset("script style template noscript textarea iframe select title xmp noembed noframes".split())
#: Elements with markup of their own, of which only the text is read, and what is no text in them.
FOREIGN = frozenset(("svg", "math"))
UNSEEN = frozenset(("script", "style", "title", "desc", "metadata", "annotation", "annotation-xml"))
#: Elements whose content is never text of the page.
CONTROLS = frozenset(("button",))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math q s samp small span strike strong sub sup svg time tt u var wbr".split())
#: An open tag of the first kind ends where one of the second begins in the same parent.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
}
#: Tags that end formulas and drawings left open.
BREAKS = CLOSED_BY["p"] | {"body", "li", "dd", "dt", "td", "th", "tr", "tbody", "br", "img"}
NAME = re.compile(r"[^\s/>]+")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
TELLING = re.compile("class|id|role|hidden|none", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Element:
    """An open element; ``block`` is the nearest one that is not a formatting one."""

    __slots__ = ("tag", "names", "parent", "block", "hidden", "links", "foreign", "depth")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None, hidden: bool):
        self.tag, self.names, self.parent = tag, names, parent
        self.depth = parent.depth + 1 if parent else 0
        self.hidden = hidden or parent is not None and parent.hidden
        self.links = (parent.links if parent else 0) + (tag == "a")
        self.foreign = tag if tag in FOREIGN else parent.foreign if parent else ""
        self.block = parent.block if parent and (tag in INLINE or self.foreign) else self

    def path(self) -> tuple[str, ...]:
        """Names of all ancestors and of the element, outermost first."""
        out, at = [], self
        while at.parent is not None:
            out.append(at.names)
            at = at.parent
        return tuple(n for names in reversed(out) for n in names)


@dataclass
class Block:
    text: str
    element: Element
    linked: int  # characters within links

    @property
    def path(self) -> tuple[str, ...]:
        return self.element.path()


@dataclass
class _Reader:
    top: Element = field(default_factory=lambda: Element("", (), None, False))
    open: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    owner: Element | None = None
    linked: int = 0

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.blocks.append(Block(text, self.owner, self.linked))
            self.parts = []
        self.linked = 0

    def text(self, raw: str) -> None:
        if not raw or self.top.hidden or not self.parts and raw.isspace():
            return
        if not self.parts:
            self.owner = self.top
        self.parts.append(raw)
        if self.top.links:
            self.linked += len(raw)

    def push(self, tag: str, names: tuple[str, ...], hidden: bool) -> None:
        self.top = Element(tag, names, self.top, hidden)
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop_to(self, element: Element) -> None:
        """Closes ``element`` and all that is open in it."""
        end = element.parent
        while self.top is not end:
            self.open[self.top.tag] -= 1
            self.top = self.top.parent

    def close(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        at = self.top
        while at.parent is not None:
            if at.tag == tag:
                self.pop_to(at)
                return
            # a formatting end tag does not reach over a block
            if tag in INLINE and at.tag not in INLINE and not at.foreign:
                return
            at = at.parent


def described(tag: str, attributes: str) -> tuple[tuple[str, ...], bool]:
    """A tag's names (itself, the words of its class, id and role) and whether its attributes hide what is in it."""
    if TELLING.search(attributes) is None:
        return (tag,), False
    words, hidden = set(), False
    for a in ATTRIBUTE.finditer(attributes):
        name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if name in ("class", "id", "role"):
            words.update(WORD.findall(HUMP.sub(" ", value).lower()))
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and NO_DISPLAY.search(value):
            hidden = True
    return (tag, *(f".{w}" for w in sorted(words))), hidden


class _Scanner:
    """Ends of tags and raw elements; what is known to be missing is not looked for again."""

    def __init__(self, page: str):
        self.page, self.lower = page, page.lower() if page.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), page)
        self.quotes, self.ends = True, True

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, -1 if there is none."""
        if not self.ends:
            return -1
        if self.quotes:
            place = at
            while m := STOP.search(self.page, place):
                if m[0] == ">":
                    return m.start()
                place = self.page.find(m[0], m.end()) + 1
                if not place:
                    self.quotes = False  # a quote without its end: quotes no longer count
                    break
            else:
                if self.page.find(">", at) >= 0:
                    self.quotes = False
        found = self.page.find(">", at)
        self.ends = found >= 0
        return found


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in page order."""
    r, s, at, n = _Reader(), _Scanner(page), 0, len(page)
    begin = 0  # of the text not yet read
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        after = page[at + 1: at + 2]
        if after == "!" or after == "?":
            r.text(page[begin:at])
            if page.startswith("<!--", at):
                ends = page.find("-->", at + 2)
                begin = at = ends + 3 if ends >= 0 else n
            elif page.startswith("<![CDATA[", at):
                ends = page.find("]]>", at)
                begin = at = ends + 3 if ends >= 0 else n
            else:
                ends = page.find(">", at)
                begin = at = ends + 1 if ends >= 0 else n
            continue
        closing = after == "/"
        first = page[at + 2: at + 3] if closing else after
        if not (first.isascii() and first.isalpha()):
            at += 1
            continue
        name = NAME.match(page, at + 1 + closing)
        ends = s.tag_end(name.end())
        if ends < 0:
            break
        r.text(page[begin:at])
        tag, rest = name[0].lower(), page[name.end(): ends]
        begin = at = ends + 1
        if r.top.foreign and not closing and tag in BREAKS:
            while r.top.foreign:
                r.pop_to(r.top)
        if r.top.foreign or tag in FOREIGN:
            if r.top.foreign != "math" and tag != "math" and r.parts:
                r.parts.append(" ")
            if closing:
                r.close(tag)
            elif not rest.endswith("/"):
                names, hidden = described(tag, rest)
                r.push(tag, names, hidden or tag in UNSEEN)
            continue
        if tag == "br":
            if r.parts:
                r.parts.append(" ")
            continue
        if closing:
            if tag not in INLINE:
                r.flush()
            r.close(tag)
            continue
        if tag in RAW:
            ends = s.lower.find(f"</{tag}", at)
            while ends >= 0 and s.lower[ends + 2 + len(tag): ends + 3 + len(tag)] not in ("", ">", "/", " ", "\n", "\t", "\r", "\f"):
                ends = s.lower.find(f"</{tag}", ends + 1)
            stop = page.find(">", ends) if ends >= 0 else -1
            begin = at = stop + 1 if stop >= 0 else n
            continue
        if tag not in INLINE:
            r.flush()
            near = r.top.block
            if tag in CLOSED_BY.get(near.tag, ()) and (near is r.top or tag in CLOSED_BY["p"]):
                r.pop_to(near)
        if tag in VOID:
            continue
        names, hidden = described(tag, rest)
        r.push(tag, names, hidden or tag in CONTROLS)
    r.text(page[begin:])
    r.flush()
    return r.blocks


#: Ancestors, and class, id or role words on them, that are features of their own; fixed names of HTML and of common page layouts.
MAIN_NAMES = ("article", "main", ".article", ".main", ".content", ".post", ".entry", ".story", ".body", ".text")
SIDE_NAMES = (
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "table", "figure", "blockquote", "pre",
    ".nav", ".navigation", ".menu", ".header", ".footer", ".sidebar", ".aside", ".widget", ".ad", ".ads", ".advert", ".advertisement", ".banner", ".promo",
    ".sponsor", ".sponsored", ".cookie", ".cookies", ".notice", ".consent", ".alert", ".popup", ".modal", ".newsletter", ".subscribe", ".signup", ".login",
    ".share", ".social", ".related", ".recommended", ".breadcrumb", ".breadcrumbs", ".pagination", ".pager", ".tags", ".comment", ".comments", ".reply", ".replies",
    ".discussion", ".respond", ".form", ".search", ".copyright", ".legal", ".disclaimer", ".toolbar", ".complementary", ".contentinfo",
)
NEUTRAL = frozenset(("table", "figure", "blockquote", "pre", "menu"))
LEAVES = ("p", "h1", "h2", "h3", "h4", "li", "td", "dd", "dt", "div", "section", "pre", "blockquote", "figcaption", "label", "body")
#: Elements that hold blocks together; lists, cells of a table's row and paragraphs do not.
CONTAINERS = frozenset("div section article main aside header footer nav form body td center fieldset details dialog".split())
LENGTHS = (20, 60, 150, 400)
PROSE = 80
NAMES = {n: i for i, n in enumerate((*MAIN_NAMES, *SIDE_NAMES))}
LEAF = {n: i for i, n in enumerate(LEAVES)}
#: Figures of a block's text, place and container.
PLAIN = (
    "linked", "some links", "sentence", "sentences", "clauses", "copyright", "first", "last", "bias", "inner main", "inner side", "any main", "no name", "title in main",
    "prose", "in best", "holds best", "before best", "after best", "much prose", "most prose", "linked part", "prose next", "prose before",
)
#: Pairs of the above whose conjunction counts.
PAIRS = (
    ("no name", "in best"), ("no name", "holds best"), ("no name", "before best"), ("no name", "after best"), ("no name", "prose"), ("no name", "linked part"), ("no name", "linked"),
    ("no name", "most prose"), ("inner main", "linked part"), ("inner main", "in best"), ("inner side", "in best"), ("in best", "linked"), ("in best", "linked part"), ("in best", "inner side"),
    ("no name", "prose next"), ("no name", "prose before"),
)
_LEAF0 = len(NAMES)
_TEXT0 = _LEAF0 + len(LEAVES)
_PLAIN0 = _TEXT0 + len(LENGTHS) + 1
_PAIR0 = _PLAIN0 + len(PLAIN)
N_FEATURES = _PAIR0 + len(PAIRS)
_PLACE = {name: k for k, name in enumerate(PLAIN)}


class _Described:
    """What a path says: known names on it, the innermost kind, the leaf and its container; made once for each element."""

    __slots__ = ("known", "kinds", "leaf", "container")

    def __init__(self, element: Element, above: _Described | None):
        self.known, self.kinds = (above.known, above.kinds) if above else (frozenset(), "")
        for name in element.names:
            i = NAMES.get(name)
            if i is None:
                continue
            if name == "header" and "M" in self.kinds:
                self.kinds += "H"  # the head of an article is no head of a page
                continue
            self.known |= {i}
            if name not in NEUTRAL:
                self.kinds += "M" if i < len(MAIN_NAMES) else "S"
        # how a path goes on is told by its last kind and whether there was a main one
        self.kinds = ("M" if "M" in self.kinds else "") + self.kinds[-1:]
        self.leaf = element.tag if element.tag in LEAF else above.leaf if above else "body"
        self.container = element if above is None or element.tag in CONTAINERS else above.container


def features(blocks: list[Block]) -> np.ndarray:
    """Blocks x ``N_FEATURES``."""
    n = len(blocks)
    out = np.zeros((n, N_FEATURES), np.float32)
    if not n:
        return out
    seen: dict[int, _Described] = {}

    def described_(element: Element) -> _Described:
        todo = []
        while element is not None and id(element) not in seen:
            todo.append(element)
            element = element.parent
        for e in reversed(todo):
            seen[id(e)] = _Described(e, seen[id(e.parent)] if e.parent is not None else None)
        return seen[id(todo[0])] if todo else seen[id(element)]

    about = [described_(b.element) for b in blocks]
    size = np.array([len(b.text) for b in blocks])
    linked = np.array([b.linked for b in blocks]) / np.maximum(size, 1)
    side = np.array([d.kinds[-1:] == "S" for d in about])
    prose = (size >= PROSE) & (linked < 0.3)
    container = [id(d.container) for d in about]
    held: dict[int, int] = {}
    chars: dict[int, float] = {}
    links: dict[int, float] = {}
    for k, c in enumerate(container):
        held[c] = held.get(c, 0) + (int(size[k]) if prose[k] and not side[k] else 0)
        chars[c] = chars.get(c, 0) + size[k]
        links[c] = links.get(c, 0) + size[k] * linked[k]
    most = max(held.values())
    best = next(c for c in container if held[c] == most) if most else None
    inside, above = np.zeros(n, bool), set()
    if best is not None:
        # blocks whose element lies in the best container, and what holds that container
        at = next(d.container for d, c in zip(about, container, strict=True) if c == best)
        within: dict[int, bool] = {}
        e = at.parent
        while e is not None:
            above.add(id(e))
            e = e.parent
        for k, b in enumerate(blocks):
            e, todo = b.element, []
            while e is not None and id(e) not in within and e is not at:
                todo.append(id(e))
                e = e.parent
            found = e is at or e is not None and within[id(e)]
            within.update((i, found) for i in todo)
            inside[k] = found
    where = np.flatnonzero(inside)
    plain = out[:, _PLAIN0: _PAIR0]
    put = lambda name, values: plain.__setitem__((slice(None), _PLACE[name]), values)
    known = [(k, i) for k, d in enumerate(about) for i in d.known]
    if known:
        out[tuple(np.array(known).T)] = 1
    every = np.arange(n)
    out[every, _LEAF0 + np.array([LEAF[d.leaf] for d in about])] = 1
    out[every, _TEXT0 + np.searchsorted(LENGTHS, size, "right")] = 1
    text = [b.text for b in blocks]
    put("linked", linked > 0.5)
    put("some links", linked > 0.1)
    put("sentence", [t[-1:] in ".!?…。" for t in text])
    put("sentences", [t.count(". ") + t.count("? ") + t.count("! ") + t.count("。") >= 2 for t in text])
    put("clauses", [t.count(",") + t.count("、") >= 2 for t in text])
    put("copyright", ["©" in t for t in text])
    plain[0, _PLACE["first"]] = plain[-1, _PLACE["last"]] = 1
    put("bias", 1)
    kinds = [d.kinds for d in about]
    put("inner main", [k[-1:] == "M" for k in kinds])
    put("inner side", side)
    put("any main", ["M" in k for k in kinds])
    put("no name", [k == "" for k in kinds])
    put("title in main", [k[-1:] == "H" and d.leaf in ("h1", "h2") for k, d in zip(kinds, about, strict=True)])
    put("prose", prose)
    put("in best", inside)
    put("holds best", [c in above for c in container])
    put("before best", np.arange(n) < (where[0] if len(where) else 0))
    put("after best", np.arange(n) > (where[-1] if len(where) else n))
    own = np.array([held[c] for c in container])
    put("much prose", own >= 300)
    put("most prose", own >= max(0.5 * most, 1))
    put("linked part", [links[c] > 0.4 * chars[c] for c in container])
    same = np.array([a == b for a, b in zip(container[:-1], container[1:], strict=True)], bool)
    plain[:-1, _PLACE["prose next"]] = same & prose[1:]
    plain[1:, _PLACE["prose before"]] = same & prose[:-1]
    for k, (a, b) in enumerate(PAIRS):
        out[:, _PAIR0 + k] = plain[:, _PLACE[a]] * plain[:, _PLACE[b]]
    return out


SYLLABLES = ("ba", "ce", "di", "fo", "gu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "zu")


class Layouts:
    """Pages by rule, each with the texts of its main blocks, which no other block has.

    A page is a main part among side parts; texts are of varying length and of
    one language-free syllable, so that nothing is learnt from words. Names of
    parts are known ones, or syllables that say nothing.
    """

    def __init__(self, seed: int):
        self.rng, self.serial = np.random.default_rng(seed), 0

    def draw(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def word(self) -> str:
        return "".join(self.draw(*SYLLABLES) for _ in range(int(self.rng.integers(2, 4))))

    def prose(self, least: int, most: int) -> str:
        words = ["lorem"[: int(n)] for n in self.rng.integers(2, 6, int(self.rng.integers(least, most)))]
        return "".join(w + (". " if i % 11 == 10 else ", " if i % 7 == 6 else " ") for i, w in enumerate(words)).rstrip(" ,.") + "."

    def named(self, name: str, inner: str) -> str:
        if name[0] == "?":
            tag = self.draw("div", "div", "div", "section")
            mark = self.draw("", f' class="{self.word()}"', f' id="{self.word()}"', f' class="{self.word()}-{self.word()} {self.word()}"')
            return f"<{tag}{mark}>{inner}</{tag}>"
        return f'<div class="{name[1:]}">{inner}</div>' if name[0] == "." else f"<{name}>{inner}</{name}>"

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.prose(1, 5)[:-1]}</a>' for _ in range(int(self.rng.integers(2, 8)))]
        return self.draw("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(f"<p>{i}</p>" for i in items))

    def side(self, name: str) -> str:
        if name[0] == "?":
            inner = self.draw(self.links(), self.links(), self.prose(2, 9), f"<h3>{self.prose(1, 4)[:-1]}</h3>{self.links()}", f"<p>{self.prose(3, 14)}</p><p><a href='/x'>{self.prose(1, 4)}</a></p>")
        else:
            inner = self.draw(self.links(), f"<p>{self.prose(4, 60)}</p>" * int(self.rng.integers(1, 3)), self.prose(2, 30), f"<h3>{self.prose(1, 5)}</h3><p>{self.prose(5, 40)}</p>")
        return self.named(name, inner)

    def body(self, least: int, long: bool) -> tuple[list[str], list[str]]:
        """Main blocks as markup, and their texts."""
        parts, texts = [], []
        for j in range(int(self.rng.integers(least, 9))):
            kind = "h1" if j == 0 and self.rng.integers(3) else self.draw("p", "p", "p", "p", "h2", "li", "blockquote", "td", "pre", "div") if not long or j % 2 else "p"
            short = kind in ("h1", "h2", "li", "td")
            self.serial += 1
            text = f"{(self.prose(1, 9) if short else self.prose(25, 90) if long else self.prose(1, 90))[:-1]} m{self.serial}{self.draw('.', '.', '')}"
            texts.append(text)
            words = text.split(" ")
            if not short and len(words) > 3 and not self.rng.integers(4):
                last = min(len(words) - 2, int(self.rng.integers(1, 4)))
                words[1] = f'<a href="/{self.word()}">{words[1]}'
                words[last] += "</a>"
            open_, close = {"li": ("<ul><li>", "</li></ul>"), "td": ("<table><tr><td>", "</td></tr></table>")}.get(kind, (f"<{kind}>", f"</{kind}>"))
            parts.append(open_ + " ".join(words) + close)
        return parts, texts

    def page(self, k: int) -> tuple[str, set[str]]:
        sides = [n for n in SIDE_NAMES if n not in NEUTRAL]
        plain = k % 2 == 1  # no name tells the main part
        main = self.draw("?", "?", "?", "td", "bare") if plain else self.draw("article", "article", "main", ".article", ".post", ".entry", ".story", ".content")
        parts, texts = self.body(3 if plain else 1, plain)
        if not plain and k % 10 < 4:  # a short article
            at = int(self.rng.integers(len(parts)))
            parts, texts = parts[at: at + 1], texts[at: at + 1]
        elif not plain and k % 7 == 0:
            self.serial += 1
            texts.insert(0, f"{self.prose(1, 8)[:-1]} m{self.serial}.")
            parts.insert(0, f"<header><h1>{texts[0]}</h1></header>")
        inner = [self.side(sides[k // 2 % len(sides)])] if k % 3 == 0 else []
        for part in inner:
            parts.insert(int(self.rng.integers(0, len(parts) + 1)), part)
        whole = "".join(parts)
        if main == "td":
            whole = f"<table><tr><td{self.draw('', ' class=' + self.word())}>{whole}</td></tr></table>"
        elif main != "bare":
            whole = self.named(main, whole)
            for _ in range(int(self.rng.integers(0, 3)) if plain else 0):
                whole = self.named("?", whole)
        kind = lambda: self.draw("?", "?", *[sides[int(i)] for i in self.rng.integers(0, len(sides), 2)])
        before, after = [self.side(kind()) for _ in range(int(self.rng.integers(0, 4)))], [self.side(kind()) for _ in range(int(self.rng.integers(0, 4)))]
        head = self.draw("", self.side("nav"), f"<header>{self.side('nav')}</header>", f"<header><h1>{self.prose(1, 4)}</h1></header>")
        foot = self.draw("", self.side("footer"), "<footer>&copy; " + self.prose(1, 6) + "</footer>", self.named("?", "&copy; " + self.prose(1, 6)))
        if k % 10 in (0, 5) and main != "bare":
            head, foot, before, after = "", "", [], []
        return f"<html><body>{head}{''.join(before)}{whole}{''.join(after)}{foot}</body></html>", set(texts)


def labelled_pages(pages: int = 600, seed: int = 20240301) -> Iterator[tuple[str, set[str]]]:
    layouts = Layouts(seed)
    for k in range(pages):
        yield layouts.page(k)


_FIELD: list[ChainCrf] = []


def trained() -> ChainCrf:
    """The field learnt from ``labelled_pages``."""
    if not _FIELD:
        parts, truth, lengths = [], [], []
        for page, texts in labelled_pages():
            blocks = blocks_of(page)
            labels = [int(b.text in texts) for b in blocks]
            parts.append(features(blocks))
            truth += labels
            lengths.append(len(blocks))
        _FIELD.append(ChainCrf(N_FEATURES).fit(np.concatenate(parts).astype(float), np.array(truth), np.array(lengths), rounds=120))
    return _FIELD[0]


def _extract(batches: Iterator[pa.RecordBatch], model: ChainCrf) -> Iterator[pa.RecordBatch]:
    for batch in (s for whole in batches for s in C.slices([whole], "html")):
        pages = [blocks_of(p or "") for p in batch.column("html").to_pylist()]
        lengths = np.array([len(p) for p in pages])
        flat = [b for p in pages for b in p]
        labels = model.viterbi(np.concatenate([features(p) for p in pages]) if flat else np.zeros((0, N_FEATURES)), lengths)
        texts, at = [], 0
        for p in pages:
            texts.append(" ".join(b.text for b, y in zip(p, labels[at: at + len(p)], strict=True) if y))
            at += len(p)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame, model: ChainCrf | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    model = model or trained()
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(lambda batches: _extract(batches, model), "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(C.table(spark, sf_dir, "pages"))
