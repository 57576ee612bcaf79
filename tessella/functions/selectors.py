"""CSS selectors over one parsed page: what a task needs to find elements in it."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

from tessella.functions.htmltree import ELEMENT, TEXT, Tree, markdown, serialize

# Elements that can be disabled, that link, and states that no captured page is in.
CONTROLS = frozenset("button fieldset input optgroup option select textarea".split())
LINKS = frozenset("a area link".split())
NEVER = frozenset("hover active focus visited".split())

_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_TOKEN = re.compile(
    rf"(?P<comb>\s*[>+~]\s*|\s+)|#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|:(?P<pseudo>[\w-]+)(?P<args>\()?|(?:\*\|)?(?P<tag>\*|{_NAME})"
    rf"|\[\s*(?:\*?\|)?(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|{_NAME})\s*(?P<case>[iI]\b|[sS]\b)?\s*)?\]"
)
_NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n(?:\s*(?P<sign>[+-])\s*(?P<b>\d+))?|(?P<only>[+-]?\d+))\s*", re.I)
Test = Callable[["Page", int], bool]


class Page:
    """A parsed page: its nodes by number in document order, elements of templates left out."""

    def __init__(self, html: str | None, context: str | None = None) -> None:
        tree = Tree(html) if context is None else Tree.fragment(html, context)
        self.rows, self.quirks = tree.rows(), tree.quirks
        self.parent, self.end = [r[1] for r in self.rows], [r[2] for r in self.rows]
        self.kind, self.tag, self.said = tree.kind, tree.tag, tree.text
        self.elements = [r[0] for r in self.rows if r[6] == ELEMENT and not r[10]]
        self.attrs: list[dict] = [dict(a or ()) for a in tree.attrs]
        self.place, self.siblings, self.alike = [r[5] for r in self.rows], defaultdict(list), defaultdict(int)
        self.type_place, self.firsts = [0] * len(self.rows), {}
        for r in self.rows:
            if r[6] == ELEMENT:
                self.siblings[r[1]].append(r[0])
                self.type_place[r[0]] = self.alike[r[1], r[7]]
                self.alike[r[1], r[7]] += 1

    def text(self, at: int = 0, drop: tuple[str, ...] = ()) -> str:
        """The text in a node, without that in templates and in dropped elements."""
        out, i = [], at
        while i <= self.end[at]:
            if i != at and (self.tag[i] == "template" or self.tag[i] in drop):
                i = self.end[i]
            elif self.kind[i] == TEXT:
                out.append(self.said[i])
            i += 1
        return "".join(out)

    def part(self, at: int, inner: bool = False) -> list[tuple]:
        return [(r[3], *r[6:10]) for r in self.rows[at + inner : self.end[at] + 1]]

    def html(self, at: int, inner: bool = False) -> str:
        return serialize(self.part(at, inner))

    def markdown(self, at: int) -> str:
        return markdown(self.part(at))

    def find(self, chosen: Selector, within: int = 0) -> Iterator[int]:
        """Elements in a node, itself not, that a selector chooses."""
        for k in range(bisect_right(self.elements, within), bisect_right(self.elements, self.end[within])):
            if chosen(self, self.elements[k]):
                yield self.elements[k]


def _unescape(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _nth(text: str) -> Callable[[int], bool]:
    """Whether a place from 1 is one of an+b."""
    m = _NTH.fullmatch(text)
    if not m:
        raise ValueError(f"not a place: {text!r}")
    if m["word"]:
        a, b = 2, int(m["word"].lower() == "odd")
    elif m["only"]:
        a, b = 0, int(m["only"])
    else:
        a, b = {"": 1, "+": 1, "-": -1}.get(m["a"]) or int(m["a"]), int((m["sign"] or "") + (m["b"] or "0"))
    return lambda k: k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    name, value = name.lower(), value.lower() if fold else value
    compare = {
        "=": lambda a: a == value, "~=": lambda a: value != "" and value in a.split(), "|=": lambda a: a == value or a.startswith(value + "-"),
        "^=": lambda a: value != "" and a.startswith(value), "$=": lambda a: value != "" and a.endswith(value), "*=": lambda a: value != "" and value in a,
    }.get(op, lambda a: True)

    def test(page: Page, i: int) -> bool:
        a = page.attrs[i].get(name)
        return a is not None and compare(a.lower() if fold else a)

    return test


def _named(attr: str, name: str) -> Test:
    """A class or id; without case in quirks pages."""
    low = name.lower()

    def test(page: Page, i: int) -> bool:
        have = page.attrs[i].get(attr, "")
        have = have.split() if attr == "class" else [have]
        return name in have or (page.quirks and any(x.lower() == low for x in have))

    return test


def _placed(name: str, args: str | None) -> Test:
    """Tests of an element's place among its siblings, all or of its type, from either end."""
    of_type, last = name.endswith("of-type"), "last" in name
    wanted = _nth(args) if args is not None else (lambda k: k == 1)

    def test(page: Page, i: int) -> bool:
        if page.parent[i] is None:
            return False
        up = page.parent[i]
        n, at = (page.alike[up, page.tag[i]], page.type_place[i]) if of_type else (len(page.siblings[up]), page.place[i])
        return n == 1 if name.startswith("only") else wanted(n - at if last else at + 1)

    return test


def _pseudo(name: str, args: str | None) -> Test:
    if name in ("first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type") and args is None:
        return _placed(name, None)
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type") and args is not None:
        return _placed(name, args)
    if name in ("not", "is", "where") and args is not None:
        inner = Selector(args)
        return (lambda page, i: not inner(page, i)) if name == "not" else inner
    plain = {
        "root": lambda page, i: page.parent[i] == 0, "empty": lambda page, i: all(page.kind[k] not in (ELEMENT, TEXT) for k in range(i + 1, page.end[i] + 1)),
        "link": lambda page, i: page.tag[i] in LINKS and "href" in page.attrs[i], "any-link": lambda page, i: page.tag[i] in LINKS and "href" in page.attrs[i],
        "disabled": lambda page, i: page.tag[i] in CONTROLS and "disabled" in page.attrs[i], "enabled": lambda page, i: page.tag[i] in CONTROLS and "disabled" not in page.attrs[i],
        "checked": lambda page, i: "checked" in page.attrs[i] or "selected" in page.attrs[i], **{n: lambda page, i: False for n in NEVER},
    }
    if name not in plain or args is not None:
        raise ValueError(f"unknown pseudo-class: {name}")
    return plain[name]


def _split(text: str) -> list[str]:
    """A comma list's members; commas in brackets and quotes stay."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


class Selector:
    """A selector list; call it with a page and an element's number. Raises ValueError for what is no selector."""

    def __init__(self, text: str) -> None:
        self.chains = [self._chain(x.strip()) for x in _split(text)]

    @staticmethod
    def _chain(text: str) -> list[tuple[str, list[Test]]]:
        """Compound selectors from left to right, each with what joins it to the one before."""
        chain: list[tuple[str, list[Test]]] = [("", [])]
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not a selector: {text!r}")
            at = m.end()
            tests = chain[-1][1]
            if m["comb"]:
                if not tests:
                    raise ValueError(f"nothing before a combinator: {text!r}")
                chain.append((m["comb"].strip() or " ", []))
            elif m["id"] or m["cls"]:
                tests.append(_named("id" if m["id"] else "class", _unescape(m["id"] or m["cls"])))
            elif m["attr"]:
                value = m["value"] or ""
                tests.append(_attribute(_unescape(m["attr"]), m["op"], value[1:-1] if value[:1] in ("'", '"') else _unescape(value), (m["case"] or "").lower() == "i"))
            elif m["pseudo"]:
                args = None
                if m["args"]:
                    close = _close(text, at)
                    args, at = text[at:close], close + 1
                tests.append(_pseudo(m["pseudo"].lower(), args))
            elif tests:
                raise ValueError(f"a type after other tests: {text!r}")
            elif m["tag"] == "*":
                tests.append(lambda page, i: True)
            else:
                tests.append(lambda page, i, tag=_unescape(m["tag"]).lower(): page.tag[i] == tag)
        if not chain[-1][1]:
            raise ValueError(f"an empty selector: {text!r}")
        return chain

    def __call__(self, page: Page, i: int) -> bool:
        return any(self._ends(page, i, chain, len(chain) - 1) for chain in self.chains)

    def _ends(self, page: Page, i: int, chain: list, k: int) -> bool:
        """Whether the first k + 1 compounds of a chain end at an element."""
        joined, tests = chain[k]
        if not all(t(page, i) for t in tests):
            return False
        if k == 0:
            return True
        if joined in "+~":
            row, at = page.siblings[page.parent[i]], page.place[i]
            if joined == "+":
                return at > 0 and self._ends(page, row[at - 1], chain, k - 1)
            return self._first(page, row, chain, k - 1) < at
        up = page.parent[i]
        while up is not None and page.kind[up] == ELEMENT:
            if self._ends(page, up, chain, k - 1):
                return True
            if joined == ">":
                return False
            up = page.parent[up]
        return False


    def _first(self, page: Page, row: list[int], chain: list, k: int) -> int:
        """The place of the first of some siblings at which a chain's first k + 1 compounds end; found once for each row."""
        key = (id(chain), k, row[0])
        if key not in page.firsts:
            page.firsts[key] = next((at for at, j in enumerate(row) if self._ends(page, j, chain, k)), len(row))
        return page.firsts[key]


def _close(text: str, at: int) -> int:
    depth, quote = 1, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
    raise ValueError(f"no closing bracket: {text!r}")


def closest(page: Page, at: int, chosen: Selector) -> int | None:
    """The element itself or its nearest ancestor that a selector chooses."""
    up: int | None = at
    while up is not None and page.kind[up] == ELEMENT:
        if chosen(page, up):
            return up
        up = page.parent[up]
    return None


#: What can be asked of a page: kind -> (its type, how it is made from the page, the elements found and an argument).
KINDS: dict[str, tuple[str, Callable]] = {
    "count": ("bigint", lambda page, found, arg: sum(1 for _ in found)),
    "text": ("string", lambda page, found, arg: next((page.text(i, arg or ()) for i in found), None)),
    "texts": ("array<string>", lambda page, found, arg: [page.text(i, arg or ()) for i in found]),
    "attr": ("string", lambda page, found, arg: next((page.attrs[i].get(arg) for i in found), None)),
    "attrs": ("array<string>", lambda page, found, arg: [page.attrs[i].get(arg) for i in found]),
    "html": ("string", lambda page, found, arg: next((page.html(i) for i in found), None)),
    "htmls": ("array<string>", lambda page, found, arg: [page.html(i) for i in found]),
    "inner": ("string", lambda page, found, arg: next((page.html(i, inner=True) for i in found), None)),
    "markdown": ("string", lambda page, found, arg: next((page.markdown(i) for i in found), None)),
    "nodes": ("array<struct<node_id:int,tag:string,attrs:map<string,string>,text:string>>", lambda page, found, arg: [{"node_id": i, "tag": page.tag[i], "attrs": list(page.attrs[i].items()), "text": page.text(i)} for i in found]),
    "closest": ("string", lambda page, found, arg: next((page.html(k) for i in found if (k := closest(page, i, arg)) is not None), None)),
}
