"""As much of style sheets as decides what a page shows: display and visibility, by the cascade.

A sheet is read forward once. Selectors have types, ids, classes, attributes, :root, :first-child,
:last-child, :not() of one compound, and all four combinators; rules of others never apply, nor do
selectors of more parts than elements nest. Of several values the important one wins, then the inline one, the more specific, the later.
"""

from __future__ import annotations

import re
from typing import NamedTuple

SCREEN_WIDTH = 1280  # pixels, for min-width and max-width
MOST_PARTS = 200  # of a selector
_VALUE = re.compile(r"[a-z-]+(?: +[a-z-]+)*")
_WIDTH = re.compile(r"\((min|max)-width\s*:\s*(\d+(?:\.\d+)?)(px|em|rem)\)")
_PART = re.compile(
    r"(?P<tag>\*|[a-zA-Z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]"
    r"|:(?P<pseudo>root|first-child|last-child)(?![\w(-])|:not\((?P<no>[^()]*)\)"
)
_STEP = re.compile(r"[\[(]|[\])]|\s*+([>+~])\s*+|\s++|,")


def steps(s: str, commas: bool) -> list[tuple[str, str]]:
    """What stands between commas, or between combinators, outside brackets; each with what follows it."""
    out, depth, at = [], 0, 0
    for m in _STEP.finditer(s):
        if m[0] in "[(":
            depth += 1
        elif m[0] in "])":
            depth -= 1
        elif depth <= 0 and (m[0] == ",") == commas:
            out.append((s[at : m.start()], m[1] or " "))
            at = m.end()
    return [*out, (s[at:], "")]


class Compound(NamedTuple):
    """What one element must be."""

    tag: str
    ids: tuple[str, ...]
    classes: frozenset[str]
    tests: tuple
    nots: tuple

    def fits(self, node) -> bool:
        a = node.attributes
        if self.tag and node.tag != self.tag or any(a.get("id") != x for x in self.ids) or not self.classes <= node.classes:
            return False
        return all(t(node) for t in self.tests) and not any(x.fits(node) for x in self.nots)


class Rule(NamedTuple):
    """A selector as (combinator before, compound) from right to left, and what it sets: for each property
    whether it is important, the number of the rule that it comes from, and the value."""

    parts: tuple[tuple[str, Compound], ...]
    weight: tuple[int, int, int]
    order: int
    values: dict[str, tuple[bool, int, str]]


def screen(media: str) -> bool:
    """Whether a media query list applies to a screen of SCREEN_WIDTH. Other features are taken as
    true, preferences as false."""
    media = media.strip().lower()
    return not media or any(_query(q.strip()) for q in media.split(","))


def _query(query: str) -> bool:
    negated = query.startswith("not ")
    words = query.removeprefix("not ").removeprefix("only ").split("(", 1)[0].split()
    fits = not words or words[0] in ("all", "screen", "and")
    for side, size, unit in _WIDTH.findall(query):
        pixels = float(size) * (1 if unit == "px" else 16)
        fits &= SCREEN_WIDTH >= pixels if side == "min" else SCREEN_WIDTH <= pixels
    return (fits and "(prefers-" not in query) != negated


def declarations(block: str) -> dict[str, tuple[bool, str]]:
    """display and visibility as (important, value); of several valid ones the last, important ones first."""
    out: dict[str, tuple[bool, str]] = {}
    for part in block.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if colon and name in ("display", "visibility"):
            important = value.endswith("!important") or value.endswith("! important")
            value = value.partition("!")[0].strip()
            if _VALUE.fullmatch(value) and (important or not out.get(name, (False,))[0]):
                out[name] = (important, value)
    return out


def without_comments(s: str) -> str:
    out, at = [], 0
    while (begin := s.find("/*", at)) >= 0:
        out.append(s[at:begin])
        end = s.find("*/", begin + 2)
        at = len(s) if end < 0 else end + 2
    return " ".join([*out, s[at:]])


def rules(sheet: str) -> list[tuple[str, dict[str, tuple[bool, str]]]]:
    """(selectors, values) of each rule that applies to a screen and sets one of the two."""
    sheet = without_comments(sheet)
    out: list[tuple[str, dict]] = []
    applies = [True]  # of each open block
    at, mark = 0, re.compile("[{};]")
    while m := mark.search(sheet, at):
        head, at = sheet[at : m.start()].strip(), m.end()
        if m[0] == "}":
            if len(applies) > 1:
                applies.pop()
        elif m[0] == "{":
            if head.startswith("@"):
                name, _, rest = head[1:].partition(" ")
                if "(" in name:
                    name, rest = name[: name.index("(")], name[name.index("(") :] + " " + rest
                inside = screen(rest) if name == "media" else name in ("supports", "layer", "container", "scope")
                applies.append(applies[-1] and inside)
                continue
            end, depth = at, 1
            while depth and (b := re.compile("[{}]").search(sheet, end)):
                depth += 1 if b[0] == "{" else -1
                end = b.end()
            body = sheet[at : end - 1 if not depth else len(sheet)]
            at = end if not depth else len(sheet)
            if applies[-1] and (values := declarations(body)):
                out.append((head, values))
    return out


def compound(s: str) -> tuple[Compound, tuple[int, int, int]] | None:
    """A compound selector and its weight; None if it isn't understood."""
    tag, ids, classes, tests, nots, at = "", [], set(), [], [], 0
    while at < len(s):
        m = _PART.match(s, at)
        if not m or (m["tag"] and at):
            return None
        at = m.end()
        if m["tag"]:
            tag = "" if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            ids.append(m["id"])
        elif m["cls"]:
            classes.add(m["cls"])
        elif m["attr"]:
            tests.append(_attribute(m["attr"].lower(), m["op"], m["dq"] if m["dq"] is not None else m["sq"] if m["sq"] is not None else m["bare"]))
        elif m["pseudo"]:
            tests.append(_PSEUDO[m["pseudo"]])
        else:
            inner = compound(m["no"].strip())
            if inner is None:
                return None
            nots.append(inner[0])
    if not s:
        return None
    return Compound(tag, tuple(ids), frozenset(classes), tuple(tests), tuple(nots)), (len(ids), len(classes) + len(tests) + len(nots), int(bool(tag)))


_PSEUDO = {
    "root": lambda node: node.parent is None,
    "first-child": lambda node: node.parent is not None and node.before is None,
    "last-child": lambda node: node.parent is not None and next((c is node for c in reversed(node.parent.children) if not isinstance(c, str)), False),
}


def _attribute(name: str, op: str | None, value: str | None):
    if op is None:
        return lambda node: name in node.attributes
    how = {
        "=": lambda v: v == value,
        "~=": lambda v: value in v.split(),
        "^=": lambda v: bool(value) and v.startswith(value),
        "$=": lambda v: bool(value) and v.endswith(value),
        "*=": lambda v: bool(value) and value in v,
        "|=": lambda v: v == value or v.startswith(value + "-"),
    }[op]
    return lambda node: name in node.attributes and how(node.attributes[name])


def selector(s: str) -> tuple[tuple[tuple[str, Compound], ...], tuple[int, int, int]] | None:
    """The parts of a selector from right to left, each with the combinator on its left, and the weight."""
    parts, weight, combinator = [], (0, 0, 0), ""
    found = steps(s.strip(), False)
    if len(found) > MOST_PARTS:
        return None
    for text, after in found:
        piece = compound(text)
        if piece is None:
            return None
        parts.append((combinator, piece[0]))
        weight, combinator = tuple(a + b for a, b in zip(weight, piece[1])), after
    return tuple(reversed(parts)), weight


class Styles:
    """The rules of a page by what their last compound names, and the values that an element gets."""

    def __init__(self, sheets: list[str]):
        self.by: dict[tuple[str, str], list[Rule]] = {}
        self.known: dict[tuple[int, int, int], bool] = {}
        self.first: dict[tuple[int, int, int], int] = {}
        same: dict[tuple, Rule] = {}  # rules of one selector are one
        n = 0
        for sheet in sheets:
            for selectors, values in rules(sheet):
                for s, _ in steps(selectors, True):
                    if found := selector(s):
                        parts, weight = found
                        last = parts[0][1]
                        key = ("#", last.ids[0]) if last.ids else (".", min(last.classes)) if last.classes else ("", last.tag)
                        if parts not in same:
                            same[parts] = Rule(parts, weight, n, {})
                            self.by.setdefault(key, []).append(same[parts])
                        for name, (important, value) in values.items():
                            held = same[parts].values
                            held[name] = max(held.get(name, (False, -1, "")), (important, n, value))
                        n += 1

    def of(self, node) -> tuple[str, str]:
        """display and visibility, '' where nothing sets them."""
        style = node.attributes.get("style")
        if not self.by and not style:
            return "", ""
        best: dict[str, tuple] = {}
        keys = [("", ""), ("", node.tag), ("#", node.attributes.get("id", "")), *((".", c) for c in node.classes)] if self.by else []
        for key in keys:
            for rule in self.by.get(key, ()):
                if self.matches(rule, 0, node):
                    for name, (important, order, value) in rule.values.items():
                        best[name] = max(best.get(name, ((-1,), "")), ((important, False, rule.weight, order), value))
        for name, (important, value) in declarations(style).items() if style else ():
            best[name] = max(best.get(name, ((-1,), "")), ((important, True, (0, 0, 0), 0), value))
        return tuple(best[name][1] if name in best else "" for name in ("display", "visibility"))

    def matches(self, rule: Rule, k: int, node) -> bool:
        """Whether the parts of a rule from the k-th on fit an element and those around it; each question
        is answered once."""
        if not rule.parts[k][1].fits(node):
            return False
        if k + 1 == len(rule.parts):
            return True
        key = (rule.order, k, id(node))
        if key not in self.known:
            combinator = rule.parts[k][0]
            if combinator == "~":
                found = self.sibling_before(rule, k + 1, node)
            elif combinator == "+":
                found = node.before is not None and self.matches(rule, k + 1, node.before)
            elif combinator == ">":
                found = node.parent is not None and self.matches(rule, k + 1, node.parent)
            else:
                up, found = node.parent, False
                while up is not None and not found:
                    found, up = self.matches(rule, k + 1, up), up.parent
            self.known[key] = found
        return self.known[key]

    def sibling_before(self, rule: Rule, k: int, node) -> bool:
        """Whether an earlier sibling fits: siblings are looked at once for all that ask."""
        if node.before is None:
            return False
        key = (rule.order, k, id(node.parent))
        if key not in self.first:
            self.first[key] = next((c.index for c in node.parent.children if not isinstance(c, str) and self.matches(rule, k, c)), 1 << 60)
        return self.first[key] < node.index
