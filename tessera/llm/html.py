"""HTML to text as a page would be laid out.

A tokenizer and a tree builder with implied tags (omitted end tags, table and list parts, stray
end tags) make a tree; visibility rules drop what a browser doesn't show; a renderer emits all
visible text and keeps block spacing, nested lists, preformatted text and aligned table cells.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from html import unescape
from itertools import accumulate
from string import ascii_letters

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.css import Styles, screen

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg math datalist title meta link base param source track area map dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table caption thead tbody tfoot tr td th ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre xmp table figure hr fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul xmp dd dt li".split())
#: What a start tag ends, and how far up that reaches.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: End tags don't reach across these.
SCOPE = frozenset("table td th caption template html".split())
DEEPEST = 200  # as in browsers, deeper elements become siblings

_LETTERS = frozenset(ascii_letters)
_OPENING = _LETTERS | {"/", "!", "?"}
_BLANK = " \t\n\r\f"
_BLANKS = re.compile("[ \t\n\r\f]+")
_SKIP = re.compile(r"[\s/]*+")
_NAME = re.compile(r"[^\s/>][^\s/>=]*+")
_TAG_NAME = re.compile(r"[^\s/>]++")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_NUMBER = re.compile(r"&#(?:([0-9]{8,}+)|[xX]([0-9a-fA-F]{8,}+));?")


def text_of(s: str) -> str:
    """Character references replaced; those of numbers beyond all characters by the replacement character."""
    if "&" not in s:
        return s

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{'' if m[1] else 'x'}{digits};"

    return unescape(_NUMBER.sub(short, s) if "&#" in s else s)


class Node:
    """An element: its place in the tree is known by parent, element before, and number among its siblings."""

    __slots__ = ("tag", "attributes", "children", "parent", "before", "index", "classes")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []
        self.parent: Node | None = None
        self.before: Node | None = None
        self.index, self.classes = 0, frozenset(self.attributes.get("class", "").split())


def append(parent: Node, node: Node, last: dict[int, Node]) -> None:
    """Adds an element; `last` has the last element of each parent by its identity."""
    node.parent, node.before = parent, last.get(id(parent))
    node.index = node.before.index + 1 if node.before else 1
    last[id(parent)] = node
    parent.children.append(node)


class Source:
    """A page read forward only: no character is looked at more than a few times, whatever stands there."""

    def __init__(self, html: str):
        self.html, self.n, self.ahead = html, len(html), {}

    def find(self, what: str, at: int) -> int:
        """Where `what` stands next, or the end; remembered, so that searches add up to one pass."""
        known = self.ahead.get(what, -1)
        if known < at:
            known = self.html.find(what, at)
            self.ahead[what] = known = self.n if known < 0 else known
        return known

    def after(self, what: str, at: int) -> int:
        return min(self.n, self.find(what, at) + len(what))

    def tag(self, at: int) -> tuple[str, dict[str, str], bool, int] | None:
        """The name, attributes and closing slash of the tag whose name begins here, and where it ends; None
        if the page ends within it, which drops it."""
        html, n = self.html, self.n
        m = _TAG_NAME.match(html, at)
        name, at, attributes = m[0].lower(), m.end(), {}
        while True:
            first, at = at, _SKIP.match(html, at).end()
            if at >= n:
                return None
            if html[at] == ">":
                return name, attributes, html[first:at].endswith("/"), at + 1
            m = _NAME.match(html, at)
            key, at, value = m[0].lower(), m.end(), ""
            if m := _EQUALS.match(html, at):
                at = m.end()
                if at < n and html[at] in "\"'":
                    end = self.find(html[at], at + 1)
                    if end >= n:
                        return None
                    value, at = html[at + 1 : end], end + 1
                else:
                    m = _BARE.match(html, at)
                    value, at = m[0], m.end()
            attributes.setdefault(key, text_of(value))

    def raw_end(self, name: str, at: int) -> tuple[int, int]:
        """Where the text of a raw element ends, and where what follows its end tag begins."""
        m = _raw_end(name).search(self.html, at)
        if not m:
            return self.n, self.n
        end = self.tag(m.start() + 2)
        return m.start(), end[3] if end else self.n


@lru_cache(None)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>])", re.I)


def parse(html: str) -> tuple[Node, list[str]]:
    """The tree of a page, and the style sheets that a screen uses."""
    source, root = Source(html), Node("html")
    stack, styles, at, n = [root], [], 0, len(html)
    last: dict[int, Node] = {}

    def add_text(s: str) -> None:
        if not s:
            return
        top = stack[-1]
        if top.tag in ("table", "thead", "tbody", "tfoot", "tr") and not s.strip(" \t\n\r\f"):
            return
        if top.tag == "head" and s.strip():
            del stack[1:]
            top = root
        top.children.append(s)

    def pop_to(names, limit, outermost: bool = False) -> None:
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                found = i
                if not outermost:
                    break
            elif stack[i].tag in limit:
                break
        if found:
            del stack[found:]

    while at < n:
        begin = source.find("<", at)
        mark = html[begin + 1 : begin + 2]
        closing = mark == "/"
        letter = html[begin + 2 : begin + 3] if closing else mark
        if begin < n and letter not in _LETTERS and not (closing and letter) and mark not in ("!", "?"):
            begin += 1  # an angle bracket that opens nothing is text
            while begin < n and (begin := source.find("<", begin)) < n and html[begin + 1 : begin + 2] not in _OPENING:
                begin += 1
            add_text(text_of(html[at:begin]))
            at = begin
            continue
        add_text(text_of(html[at:begin]))
        if begin >= n:
            break
        if letter not in _LETTERS:  # comments and the like
            if html.startswith("<!--", begin):
                short = html.startswith((">", "->"), begin + 4)
                at = source.after(">", begin + 4) if short else min(source.after("-->", begin + 4), source.after("--!>", begin + 4))
            elif html.startswith("<![CDATA[", begin):
                end = source.find("]]>", begin + 9)
                add_text(html[begin + 9 : end])
                at = min(n, end + 3)
            else:
                at = source.after(">", begin + 2)
            continue
        found = source.tag(begin + 1 + closing)
        if found is None:
            break
        name, attributes, slash, at = found
        if closing:
            if name == "p" and not any(x.tag == "p" for x in stack):
                append(stack[-1], Node("p"), last)
            elif name == "br":
                append(stack[-1], Node("br"), last)
            elif name in ("body", "html"):
                continue  # what follows still belongs to the body
            elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
                pop_to({"h1", "h2", "h3", "h4", "h5", "h6"}, SCOPE)
            elif name in SCOPE:
                pop_to({name}, {"table"} - {name} if name != "table" else set())
            else:
                pop_to({name}, SCOPE)
            continue
        if name == "html":
            root.attributes = attributes | root.attributes
            continue
        if name == "body" and any(x.tag == "body" for x in stack):
            continue
        if name in ENDS:
            pop_to(*ENDS[name], outermost=True)
        if name in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        elif name in CLOSES_P:
            pop_to({"p"}, SCOPE | {"button", "li", "dd", "dt"} | (BLOCK - {"p"}))
        if stack[-1].tag == "head" and name not in ("title", "meta", "link", "base", "script", "style", "noscript", "template"):
            stack.pop()
        if name in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            _push(stack, Node("tr"), last)
        node = Node(name, attributes)
        if name in VOID or (slash and name in ("svg", "math", "path")):
            append(stack[-1], node, last)
            continue
        if name in RAW:
            end, after = source.raw_end(name, at) if name != "plaintext" else (n, n)
            body, at = html[at:end], after
            if name == "style":
                if screen(attributes.get("media", "")):
                    styles.append(body)
            elif name in ("textarea", "title", "xmp", "plaintext"):
                node.children.append(text_of(body) if name in ("textarea", "title") else body)
            append(stack[-1], node, last)
            continue
        _push(stack, node, last)
    return root, styles


def _push(stack: list[Node], node: Node, last: dict[int, Node]) -> None:
    if len(stack) >= DEEPEST:
        stack.pop()
    append(stack[-1], node, last)
    stack.append(node)


class Flow:
    """Lines of a block under construction; margins between blocks collapse."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *more = s.split("\n")
            self.inline.append(first)
            for line in more:
                self.flush(force=True)
                self.inline.append(line)
        elif s := _BLANKS.sub(" ", s):
            before = self.inline[-1] if self.inline else " "
            self.inline.append(s[1:] if s[0] == " " and before.endswith(" ") else s)
            if not self.inline[-1]:
                self.inline.pop()

    def flush(self, force: bool = False) -> None:
        line = "".join(self.inline)
        self.inline = []
        line = line.rstrip(" ")
        if line or force:
            self._margin()
            self.lines.append(line)

    def _margin(self) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0

    def block(self, lines: list[str], margin: int) -> None:
        self.flush()
        if lines:
            self.gap = max(self.gap, margin)
            self._margin()
            self.lines += lines
            self.gap = margin

    def space(self, margin: int) -> None:
        self.flush()
        self.gap = max(self.gap, margin)


class Page:
    def __init__(self, html: str):
        self.root, styles = parse(html)
        self.styles = Styles(styles)

    def visible(self, node: Node, seen: bool) -> tuple[bool, bool]:
        """Whether an element takes part in the layout, and whether its own text is seen (`seen`: whether
        its parent's is)."""
        if node.tag in UNSEEN:
            return node.tag == "dialog" and "open" in node.attributes, seen
        if node.tag == "input" and node.attributes.get("type", "").lower() == "hidden":
            return False, seen
        display, visibility = self.styles.of(node)
        shown = display != "none" if display else "hidden" not in node.attributes
        if visibility in ("hidden", "collapse"):
            seen = False
        elif visibility in ("visible", "initial"):
            seen = True
        return shown, seen

    def render(self) -> str:
        shown, seen = self.visible(self.root, True)
        return "\n".join(self.lines(self.root, False, seen)) if shown else ""

    def lines(self, node: Node, keep: bool, seen: bool) -> list[str]:
        flow = Flow()
        self.fill(flow, node, keep, seen)
        flow.flush()
        return flow.lines

    def fill(self, flow: Flow, node: Node, keep: bool, seen: bool) -> None:
        closed = node.tag == "details" and "open" not in node.attributes
        for child in node.children:
            if isinstance(child, str):
                if seen and not closed:
                    flow.text(child, keep)
                continue
            if closed and child.tag != "summary":
                continue
            shown, own = self.visible(child, seen)
            if not shown:
                continue
            tag = child.tag
            if tag == "br":
                flow.flush(force=True)
            elif tag == "hr":
                flow.space(1)
            elif tag == "input":
                if own and child.attributes.get("type", "text").lower() not in ("checkbox", "radio", "file", "image", "password"):
                    flow.text(child.attributes.get("value", ""), keep)
            elif tag == "table":
                flow.block(self.table(child, own), 1)
            elif tag in ("ul", "ol", "menu", "dir"):
                flow.block(self.items(child, keep, own), 0 if node.tag == "li" else 1)
            elif tag in ("pre", "xmp", "textarea"):
                lines = self.lines(child, True, own)
                flow.block(lines[1:] if lines and not lines[0] else lines, 1)
            elif tag in ("blockquote", "dd"):
                flow.block(["    " + x if x else x for x in self.lines(child, keep, own)], tag == "blockquote")
            elif tag in BLOCK:
                flow.space(tag in SPACED)
                self.fill(flow, child, keep, own)
                flow.space(tag in SPACED)
            else:
                self.fill(flow, child, keep, own)

    def items(self, node: Node, keep: bool, seen: bool) -> list[str]:
        """Lines of a list: items numbered by `start`, `reversed`, `type` and their `value`, all in page order."""
        out: list[str] = []
        ordered, backwards = node.tag == "ol", "reversed" in node.attributes
        kids = [(c, *self.visible(c, seen)) for c in node.children if isinstance(c, Node) and c.tag == "li"]
        number = _integer(node.attributes.get("start"), sum(shown for _, shown, _ in kids) if backwards else 1)
        state = {id(c): (shown, own) for c, shown, own in kids}
        held = Node("div")
        for child in [*node.children, None]:
            item = isinstance(child, Node) and child.tag == "li"
            if child is not None and not item:
                held.children.append(child)
                continue
            if held.children:
                out += ["  " + x if x else x for x in self.lines(held, keep, seen)]
                held = Node("div")
            if item and state[id(child)][0]:
                number = _integer(child.attributes.get("value"), number)
                mark = _number(number, node.attributes.get("type", "1")) + ". " if ordered else "* "
                number += -1 if backwards else 1
                lines = self.lines(child, keep, state[id(child)][1])
                out += [mark + lines[0]] if lines else []
                out += [" " * len(mark) + x if x else x for x in lines[1:]]
        return out

    def table(self, node: Node, seen: bool) -> list[str]:
        """Rows of cells, each column as wide as its widest cell. Cells stand in the columns that spans of
        earlier cells and rows leave free."""
        rows: list[list[tuple[int, int, list[str]]]] = []  # (first column, column after the last, lines)
        before: list[str] = []
        taken: list[tuple[int, int, float]] = []  # columns that a cell above still spans, and for how many rows
        parts: list = [(c, seen) for c in node.children[::-1]]

        def stray(child, own: bool) -> None:
            held = Node("div")
            held.children.append(child)
            before.extend(self.lines(held, False, own))

        while parts:
            child, own = parts.pop()
            if child is None:
                taken = []  # a group of rows ends
                continue
            if isinstance(child, str) or (child.tag not in ("thead", "tbody", "tfoot", "tr", "caption") and child.tag not in UNSEEN | {"col", "colgroup"}):
                stray(child, own)
                continue
            shown, own = self.visible(child, own)
            if not shown:
                continue
            if child.tag == "caption":
                before += self.lines(child, False, own)
            elif child.tag == "tr":
                cells, spans, at, passed = [], [], 0, 0
                for c in child.children:
                    if isinstance(c, Node) and c.tag in ("td", "th"):
                        shown, inner = self.visible(c, own)
                        if not shown:
                            continue
                        while passed < len(taken) and taken[passed][0] <= at:
                            at, passed = max(at, taken[passed][1]), passed + 1
                        across = max(1, min(_integer(c.attributes.get("colspan"), 1), 1000))  # the standard's limits
                        down = max(0, min(_integer(c.attributes.get("rowspan"), 1), 65534))
                        cells.append((at, at + across, self.lines(c, False, inner)))
                        if down != 1:
                            spans.append((at, at + across, down or float("inf")))
                        at += across
                    elif isinstance(c, str) and c.strip(_BLANK) or isinstance(c, Node):
                        stray(c, own)
                taken = sorted((a, b, n - 1) for a, b, n in taken + spans if n > 1)
                rows.append(cells)
            else:
                parts += [(None, own), *((c, own) for c in child.children[::-1])]
        starts = sorted({a for cells in rows for a, _, _ in cells})  # columns that no cell begins in have no width
        place = [[(bisect_left(starts, a), bisect_left(starts, b), lines) for a, b, lines in cells] for cells in rows]
        sizes = [0] * len(starts)
        for cells in place:
            for a, b, lines in cells:
                if b == a + 1:
                    sizes[a] = max(sizes[a], max(map(len, lines), default=0))
        for a, b, lines in sorted((x for cells in place for x in cells if x[1] > x[0] + 1), key=lambda x: x[1] - x[0]):
            sizes[b - 1] += max(0, max(map(len, lines), default=0) - sum(sizes[a:b]) - 2 * (b - a - 1))
        at = [0, *accumulate(x + 2 for x in sizes)]
        out = before
        for cells in place:
            for i in range(max((len(lines) for _, _, lines in cells), default=0)):
                line = ""
                for a, _, lines in cells:
                    if i < len(lines) and lines[i]:
                        line = line.ljust(at[a]) if len(line) <= at[a] else line + "  "
                        line += lines[i]
                if line.rstrip(" "):
                    out.append(line.rstrip(" "))
        return out


def _integer(s: str | None, otherwise: int) -> int:
    return int(m[0]) if s is not None and (m := re.match(r"\s*[+-]?\d{1,9}(?!\d)", s)) else otherwise


def _number(n: int, kind: str) -> str:
    """A list item's number in the style that `type` names."""
    if kind in ("a", "A") and n > 0:
        letters = ""
        while n:
            n, digit = divmod(n - 1, 26)
            letters = chr(ord(kind) + digit) + letters
        return letters
    if kind in ("i", "I") and 0 < n < 4000:
        roman = "M" * (n // 1000)
        for unit, (one, five, ten) in ((100, "CDM"), (10, "XLC"), (1, "IVX")):
            digit = n // unit % 10
            roman += one + ten if digit == 9 else one + five if digit == 4 else five * (digit >= 5) + one * (digit % 5)
        return roman if kind == "I" else roman.lower()
    return str(n)


def extract(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Adds the visible text of each page to all columns. A null page gives null, an empty one ''.

    Whole pages are rendered, however long. A column named `out_col` is replaced; rows stay.
    """

    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: None if x is None else Page(x).render(), na_action=None)

    return df.withColumn(out_col, F.pandas_udf(run, "string")(html_col))
