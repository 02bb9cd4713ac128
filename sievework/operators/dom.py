"""A small document tree and CSS selectors, for extraction that patterns can't do.

The tree is built by the standard library's parser. Unclosed elements end with
their parent; an end tag without a start is ignored. Texts are kept as they stand in the
source; ``text_of`` decodes character references if asked to, those that end with a semicolon.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

# Elements without content, and those that end an open element of the same group.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    at: int = 0  # among the parent's elements
    parts: list[Node | list[str]] = field(default_factory=list)  # elements and texts
    elements: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """All elements below, in order of the document."""
        todo = list(reversed(self.elements))
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.elements)


class _Builder(HTMLParser):
    """``mark`` stands for the ampersand: the parser doesn't say how a reference ended, and gives up at a broken one."""

    def __init__(self, mark: str) -> None:
        super().__init__(convert_charrefs=False)
        self.mark = mark
        self.root = self.now = Node("", {}, None)
        self.open: dict[str, int] = {}

    def _close(self, tag: str) -> None:
        if self.open.get(tag):
            while True:
                done = self.now
                self.open[done.tag] -= 1
                self.now = done.parent
                if done.tag == tag:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.now.tag in ENDED_BY.get(tag, ()):
            self._close(self.now.tag)
        node = Node(tag, {k: html_lib.unescape((v or "").replace(self.mark, "&")) for k, v in attrs}, self.now, len(self.now.elements))
        self.now.parts.append(node)
        self.now.elements.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        data, parts = data.replace(self.mark, "&"), self.now.parts
        if parts and isinstance(parts[-1], list):
            parts[-1].append(data)
        else:
            parts.append([data])  # text comes in pieces, between declarations


def parse(html: str | None) -> Node:
    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in (html or ""))  # a character of private use, as a rule the first
    marked = (html or "").replace("&", mark)
    builder = _Builder(mark)
    try:
        builder.feed(marked)
        builder.close()
    except AssertionError:  # the parser's answer to broken declarations
        builder = _Builder(mark)
        builder.feed(re.sub(r"<!\[[^>]*>?", "", marked))
        builder.close()
    return builder.root


_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")


def decoded(text: str) -> str:
    """Character references that end with a semicolon, once; what isn't one stays as it is."""
    return _REFERENCE.sub(lambda m: html5.get(f"{m[1]};", m[0]) if m[1] else html_lib.unescape(m[0]), text)


def text_of(node: Node, *, decode: bool = True, skip: frozenset[str] = frozenset(), separator: str = "") -> str:
    """All text below a node, white space collapsed."""
    out: list[str] = []
    todo: list[Node | list[str]] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            out.append("".join(x))
        elif x.tag not in skip:
            todo += reversed(x.parts)
    text = " ".join(separator.join(out).split())
    return decoded(text) if decode else text


# ---- selectors

_COMPOUND = re.compile(r"""(?P<kind>[.#]?)(?P<name>[\w-]+|\*)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\]\s]+))\s*)?\]|:(?P<pseudo>first-child|last-child)""")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


class SelectorError(ValueError):
    pass


def _compound(text: str, at: int) -> tuple[list[tuple[str, ...]], int]:
    tests: list[tuple[str, ...]] = []
    while m := _COMPOUND.match(text, at):
        if m["name"]:
            if m["name"] != "*":
                tests.append((m["kind"] or "tag", m["name"] if m["kind"] else m["name"].lower()))
            elif not m["kind"]:
                tests.append(("any",))
        elif m["attr"]:
            value = next((m[g] for g in "abc" if m[g] is not None), "")
            tests.append(("attr", m["attr"].lower(), m["op"] or "", value))
        else:
            tests.append(("pseudo", m["pseudo"]))
        at = m.end()
    if not tests:
        raise SelectorError(f"no selector at {text[at:]!r}")
    return tests, at


def compiled(selector: str) -> list[list[tuple[str, list[tuple[str, ...]]]]]:
    """Alternatives; each a list of (combinator to what stands before, tests)."""
    out = []
    for text in selector.split(","):
        text, at, steps, combinator = text.strip(), 0, [], ""
        while True:
            tests, at = _compound(text, at)
            steps.append((combinator, tests))
            if at == len(text):
                break
            m = _COMBINATOR.match(text, at)
            if not m:
                raise SelectorError(f"no selector at {text[at:]!r}")
            combinator, at = m[1] or " ", m.end()
        out.append(steps)
    return out


def _passes(node: Node, tests: list[tuple[str, ...]]) -> bool:
    for kind, *rest in tests:
        if kind == "tag":
            ok = node.tag == rest[0]
        elif kind == ".":
            ok = rest[0] in node.attrs.get("class", "").split()
        elif kind == "#":
            ok = node.attrs.get("id") == rest[0]
        elif kind == "attr":
            name, op, value = rest
            have = node.attrs.get(name)
            ok = have is not None and {
                "": True, "=": have == value, "~=": value in (have or "").split(), "|=": have == value or (have or "").startswith(value + "-"),
                "^=": bool(value) and (have or "").startswith(value), "$=": bool(value) and (have or "").endswith(value), "*=": bool(value) and value in (have or ""),
            }[op]
        elif kind == "pseudo":
            ok = node.parent is not None and node.at == (0 if rest[0] == "first-child" else len(node.parent.elements) - 1)
        else:
            ok = True
        if not ok:
            return False
    return True


def matches(node: Node, steps: list[tuple[str, list[tuple[str, ...]]]]) -> bool:
    combinator, tests = steps[-1]
    if not node.tag or not _passes(node, tests):
        return False
    if len(steps) == 1:
        return True
    before = steps[:-1]
    if combinator == ">":
        return node.parent is not None and matches(node.parent, before)
    if combinator == " ":
        up = node.parent
        while up is not None:
            if matches(up, before):
                return True
            up = up.parent
        return False
    sides = node.parent.elements[: node.at] if node.parent else []
    return any(matches(x, before) for x in (sides[-1:] if combinator == "+" else sides))


def select(node: Node, selector: str) -> Iterator[Node]:
    """Elements below that one of the selectors matches, in order of the document.

    Tags, ``#id``, ``.class``, attribute tests, ``:first-child``, ``:last-child``, all four combinators, lists by commas.
    """
    alternatives = compiled(selector)
    return (x for x in node.walk() if any(matches(x, steps) for steps in alternatives))


def closest(node: Node, selector: str) -> Node | None:
    """The innermost element around (or the node itself) that matches."""
    alternatives = compiled(selector)
    while node is not None and not any(matches(node, steps) for steps in alternatives):
        node = node.parent
    return node
