"""A small tree builder for one page's HTML: what a task needs to make the node rows of a document."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
HEAD = frozenset("base link meta noscript script style template title".split())
SCOPES = frozenset("applet caption html table td th marquee object template button".split())
TABLE = frozenset("caption table tbody td tfoot th thead tr".split())
#: A part of a table -> where it may open; what a table may hold besides parts; where other content is misplaced.
CONTEXTS = {
    **dict.fromkeys(("td", "th"), frozenset("tr tbody thead tfoot table".split())), "tr": frozenset("tbody thead tfoot table".split()),
    **dict.fromkeys("tbody thead tfoot caption colgroup".split(), frozenset(["table"])), "col": frozenset(["colgroup", "table"]),
}
IN_TABLE = frozenset("script style template form table".split())
TABLE_TOPS = frozenset("table tbody thead tfoot tr".split())
TABLE_SCOPES = frozenset("html table template".split())
# What must be open around an element that can't stand in a body by itself.
AROUND = {"tr": "<table><tbody><tr>", "td": "<table><tr><td>", "th": "<table><tr><th>", **dict.fromkeys(("tbody", "thead", "tfoot"), "<table><{}>"), "caption": "<table><caption>", "option": "<select><option>"}
#: An element -> those that its start closes, and where the search for them ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
}
# Elements whose content is text whatever it looks like; of the first two, character references are read.
REFERENCES = ("title", "textarea")
PLAIN = (*REFERENCES, "script", "style", "xmp", "iframe", "noembed", "noframes")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FOREIGN = frozenset(("svg", "math"))
DOCUMENT, ELEMENT, TEXT, COMMENT, DOCTYPE = 9, 1, 3, 8, 10


class Tree(HTMLParser):
    """Nodes in document order: type, parent, tag, attributes and text of each, by lists.

    Implied html, head and body are made, p, li, dd, option and table parts close as HTML says, and formatting elements
    that a block cuts off are opened again in the next one. Tables get a tbody and rows; what is misplaced in a table goes
    before it. Content of a template stays in it wherever it stands.
    """

    CDATA_CONTENT_ELEMENTS = PLAIN

    def __init__(self, html: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.kind, self.parent, self.tag, self.attrs, self.text = [DOCUMENT], [-1], [None], [None], [None]
        self.open: list[int] = [0]
        self.again: list[tuple[str, list]] = []
        self.root = self.head = self.body = None
        self.quirks = True
        self.before: dict[int, int] = {}
        self.feed(html or "")
        self.close()
        if html:
            self._need_body()
        if self.before:
            self._renumber()

    def _add(self, kind: int, tag: str | None = None, attrs: list | None = None, text: str | None = None, under: int | None = None) -> int:
        self.kind.append(kind)
        self.parent.append(self.open[-1] if under is None else under)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        return len(self.kind) - 1

    def _push(self, tag: str, attrs: list) -> None:
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        self.open.append(self._add(ELEMENT, tag, list(seen.items())))

    def _renumber(self) -> None:
        """Document order again, with what was misplaced before its table."""
        kids: list[list[int]] = [[] for _ in self.kind]
        for i in range(1, len(self.kind)):
            row = kids[self.parent[i]]
            row.insert(row.index(self.before[i]) if i in self.before else len(row), i)
        order, todo = [], [0]
        while todo:
            order.append(todo.pop())
            todo += reversed(kids[order[-1]])
        new = {old: k for k, old in enumerate(order)}
        self.parent = [new.get(self.parent[i], -1) for i in order]
        self.kind, self.tag, self.attrs, self.text = ([x[i] for i in order] for x in (self.kind, self.tag, self.attrs, self.text))

    def _table(self) -> int | None:
        """The depth of the table whose parts are open now, none within a cell."""
        for depth in range(len(self.open) - 1, 1, -1):
            tag = self.tag[self.open[depth]]
            if tag == "table":
                return depth
            if tag in ("td", "th", "caption", "template", "html"):
                return None
        return None

    def _in_template(self) -> bool:
        return any(self.tag[i] == "template" for i in self.open[1:])

    def _need_root(self) -> None:
        if self.root is None:
            self._push("html", [])
            self.root = self.open[-1]

    def _need_head(self) -> None:
        self._need_root()
        if self.head is None:
            self._push("head", [])
            self.head = self.open[-1]

    def _need_body(self) -> None:
        self._need_head()
        if self.body is None:
            del self.open[2:]
            self._push("body", [])
            self.body = self.open[-1]

    def _in_head(self) -> bool:
        return self.body is None and self.head is not None and self.head in self.open

    def _pop_to(self, wanted: set, stop: set | frozenset) -> bool:
        """Closes up to the nearest wanted element below a stop; formatting elements inside are kept for later."""
        for depth in range(len(self.open) - 1, 2, -1):
            tag = self.tag[self.open[depth]]
            if tag in wanted:
                cut = [(self.tag[i], self.attrs[i]) for i in self.open[depth + 1 :] if self.tag[i] in FORMATTING]
                self.again = [] if tag in TABLE else self._recent(cut + self.again)
                del self.open[depth:]
                return True
            if tag in stop:
                return False
        return False

    @staticmethod
    def _recent(kept: list[tuple[str, list]]) -> list[tuple[str, list]]:
        """Of formatting elements alike in tag and attributes, the last three."""
        return [x for i, x in enumerate(kept) if sum(y == x for y in kept[i + 1 :]) < 3]

    def _reopen(self) -> None:
        if self.again:
            todo, self.again = self.again, []
            for tag, attrs in todo:
                self._push(tag, attrs)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        inside = self._in_template()
        if tag in ("html", "head", "body") and inside:
            return
        if tag in ("html", "head", "body"):
            if tag == "html" and self.root is None:
                self._push(tag, attrs)
                self.root = self.open[-1]
            elif tag == "head" and self.head is None:
                self._need_root()
                self._push(tag, attrs)
                self.head = self.open[-1]
            elif tag == "body" and self.body is None:
                self._need_head()
                del self.open[2:]
                self._push(tag, attrs)
                self.body = self.open[-1]
            else:
                at = {"html": self.root, "head": None, "body": self.body}[tag]
                if at is not None:
                    have = dict(self.attrs[at] or [])
                    self.attrs[at] = [*have.items(), *((k, v or "") for k, v in attrs if k not in have)]
            return
        if inside:
            pass
        elif self.body is None and tag in HEAD:
            self._need_head()
            if self.head not in self.open:
                self._need_body()
        else:
            self._need_body()
        if tag == "form" and not inside and any(self.tag[i] == "form" for i in self.open):
            return
        if tag in CLOSES_P:
            self._pop_to({"p"}, SCOPES)
        if tag in HEADINGS and self.tag[self.open[-1]] in HEADINGS:
            self.open.pop()
        if tag == "button":
            self._pop_to({"button"}, SCOPES - {"button"})
        if tag in CONTEXTS and not inside:
            self._pop_to({"caption"}, TABLE_SCOPES)
        if tag in CLOSES:
            wanted, stop = CLOSES[tag]
            while self._pop_to(wanted, stop):
                pass
        depth = self._table()
        misplaced = False
        if tag in CONTEXTS and not inside and not any(self.tag[i] == "table" for i in self.open):
            return
        if depth is not None and tag in CONTEXTS:
            while self.tag[self.open[-1]] not in CONTEXTS[tag]:
                self.open.pop()
            if tag in ("tr", "td", "th") and self.tag[self.open[-1]] == "table":
                self._push("tbody", [])
            if tag in ("td", "th") and self.tag[self.open[-1]] != "tr":
                self._push("tr", [])
        elif depth is not None and self.tag[self.open[-1]] in TABLE_TOPS and tag not in IN_TABLE:
            misplaced = tag != "input" or dict(attrs).get("type", "").lower() != "hidden"
        if tag == "a":
            self._pop_to({"a"}, SCOPES)
            self.again = [x for x in self.again if x[0] != "a"]
        if tag not in CLOSES_P and tag not in CLOSES and tag not in HEAD:
            self._reopen()
        self._push(tag, attrs)
        if misplaced:
            self._misplace(self.open[-1], self.open[depth])
        if tag in VOID:
            self.open.pop()

    def _misplace(self, node: int, table: int) -> None:
        self.parent[node], self.before[node] = self.parent[table], table

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """A slash closes an element of a drawing or formula; elsewhere it means nothing."""
        foreign = any(self.tag[i] in FOREIGN for i in self.open) or tag in FOREIGN
        before = len(self.kind)
        self.handle_starttag(tag, attrs)
        if foreign and len(self.kind) > before and self.tag[self.open[-1]] == tag and tag not in VOID:
            self.open.pop()
        elif not foreign and tag in PLAIN:
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head" and self._in_head():
            del self.open[self.open.index(self.head) :]
        elif tag in ("html", "body", "head") or tag in VOID:
            return
        elif tag in FORMATTING and not any(self.tag[i] == tag for i in self.open):
            self.again = [x for x in self.again if x[0] != tag] if any(x[0] == tag for x in self.again) else self.again
        elif tag == "p" and not any(self.tag[i] == "p" for i in self.open[3:]):
            self._need_body()
            self._push("p", [])
            self.open.pop()
        elif self._in_head() and not self._in_template():
            if self.tag[self.open[-1]] == tag:
                self.open.pop()
        else:
            self._pop_to({tag}, (TABLE_SCOPES if tag in TABLE else SCOPES) - {tag})

    def handle_data(self, data: str) -> None:
        if self.cdata_elem in REFERENCES:
            data = unescape(data)
            if self.cdata_elem == "textarea" and len(self.kind) - 1 == self.open[-1]:
                data = data.removeprefix("\n")
            if not data:
                return
        if self._in_template():
            self._text(data)
            return
        if not data.strip(" \t\n\f\r") and self.body is None and not (self._in_head() and self.open[-1] != self.head):
            if self._in_head():
                self._text(data)
            return
        if self.body is None and not (self._in_head() and self.open[-1] != self.head):
            self._need_body()
        if self.body is not None and self.tag[self.open[-1]] not in ("table", "tbody", "tr", "ul", "ol", "select"):
            self._reopen()
        self._text(data)

    def _text(self, data: str) -> None:
        last = len(self.kind) - 1
        depth = self._table() if data.strip() and self.tag[self.open[-1]] in TABLE_TOPS else None
        if depth is not None:
            table = self.open[depth]
            if self.kind[last] == TEXT and self.before.get(last) == table:
                self.text[last] += data
            else:
                self._misplace(self._add(TEXT, text=data), table)
        elif self.kind[last] == TEXT and self.parent[last] == self.open[-1]:
            self.text[last] += data
        else:
            self._add(TEXT, text=data)

    def handle_comment(self, data: str) -> None:
        self._add(COMMENT, text=data, under=0 if self.root is None else None)

    def handle_decl(self, decl: str) -> None:
        if decl.lower().startswith("doctype") and self.root is None:
            self.quirks = decl[7:].strip().lower().split()[:1] != ["html"] or "-//" in decl.lower() and "html 3" in decl.lower()
            self._add(DOCTYPE, tag=(decl[7:].split() or [""])[0].lower())

    @classmethod
    def fragment(cls, html: str | None, context: str = "body") -> Tree:
        """A fragment as it is read inside an element of a tag: a document whose html element, its root, holds the nodes.

        Content that only stands in its proper place, such as a row's cells, stays; an html context keeps its head and body."""
        context = context.lower()
        if context == "html":
            tree = cls(html)
            tree._need_body()
            return tree
        opened = "<!doctype html><body>" + ("" if context == "body" else AROUND.get(context, "<{}>").format(context))
        tree = cls(opened + (html or ""))
        last = {"body": tree.body}.get(context)
        if last is None:
            last = next((i for i in range(len(tree.tag)) if tree.tag[i] == context and i > tree.body), tree.body)
        inside, under = [], {last}
        for i in range(last + 1, len(tree.kind)):
            if tree.parent[i] in under:
                under.add(i)
                inside.append(i)
        new = {last: 1} | {i: k + 2 for k, i in enumerate(inside)}
        tree.parent = [-1, 0, *(new[tree.parent[i]] for i in inside)]
        tree.kind, tree.tag = [DOCUMENT, ELEMENT, *(tree.kind[i] for i in inside)], [None, "html", *(tree.tag[i] for i in inside)]
        tree.attrs, tree.text = [None, [], *(tree.attrs[i] for i in inside)], [None, None, *(tree.text[i] for i in inside)]
        return tree

    def rows(self) -> list[tuple]:
        """(node_id, parent_id, subtree_end, depth, sibling_idx, elem_idx, node_type, tag, attrs, text, in_template, quirks)."""
        n = len(self.kind)
        end, depth, inside = list(range(n)), [0] * n, [False] * n
        children, elements, made = [0] * n, [0] * n, []
        for i in range(1, n):
            p = self.parent[i]
            depth[i], inside[i] = depth[p] + 1, inside[p] or self.tag[p] == "template"
            sibling, element = children[p], elements[p] if self.kind[i] == ELEMENT else None
            children[p] += 1
            elements[p] += self.kind[i] == ELEMENT
            made.append((sibling, element))
        for i in range(n - 1, 0, -1):
            end[self.parent[i]] = max(end[self.parent[i]], end[i])
        made = [(0, None), *made]
        return [(i, self.parent[i] if i else None, end[i], depth[i], made[i][0], made[i][1], self.kind[i], self.tag[i], self.attrs[i], self.text[i], inside[i], self.quirks) for i in range(n)]


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def serialize(rows: list[tuple]) -> str:
    """HTML of nodes in document order, each (depth, node_type, tag, attrs, text)."""
    out: list[str] = []
    ends: list[tuple[int, str]] = []
    for depth, kind, tag, attrs, text in rows:
        while ends and ends[-1][0] >= depth:
            out.append(ends.pop()[1])
        if kind == ELEMENT:
            out.append("<" + tag + "".join(' {}="{}"'.format(k, v.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")) for k, v in attrs or []) + ">")
            if tag not in VOID:
                ends.append((depth, f"</{tag}>"))
        elif kind == TEXT:
            raw = ends and ends[-1][1] in ("</script>", "</style>")
            out.append(text if raw else escape_text(text))
        elif kind == COMMENT:
            out.append("<!--" + text.replace(">", "&gt;") + "-->")
        elif kind == DOCTYPE:
            out.append(f"<!DOCTYPE {tag}>")
    out += [e for _, e in reversed(ends)]
    return "".join(out)


# What markdown puts before and after an element's text, and whether the text's ends are stripped.
FORMS = {
    **{f"h{k}": ("\n" + "#" * k + " ", "\n\n", True) for k in range(1, 7)}, "p": ("\n", "\n\n", True), "strong": ("**", "**", False), "b": ("**", "**", False), "em": ("*", "*", False), "i": ("*", "*", False),
    "code": ("`", "`", False), "pre": ("\n```\n", "\n```\n\n", False), "ul": ("\n", "\n", False), "ol": ("\n", "\n", False), "table": ("\n", "\n", False),
    **{t: ("\n", "", False) for t in "div section article main header footer nav aside".split()},
}
DROPPED = frozenset("script style noscript link meta".split())
#: What counts as blank at the ends of a text.
BLANK = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _collapsed(text: str) -> str:
    return re.sub("\n{3,}", "\n\n", text)


def _closed(tag: str, attrs: list | None, parts: list[str], cells: list[str], parent: str | None) -> str:
    """An element's markdown from that of its children."""
    said, have = _collapsed("".join(parts)), dict(attrs or [])
    bare = said.strip(BLANK)
    if tag in FORMS:
        before, after, strip = FORMS[tag]
        return before + (bare if strip else said) + after
    if tag == "br":
        return "\n"
    if tag == "hr":
        return "\n---\n\n"
    if tag == "blockquote":
        return "\n> " + bare.replace("\n", "\n> ") + "\n\n"
    if tag == "a":
        return f"[{bare}]({have['href']})" if have.get("href") and bare else said
    if tag == "img":
        return f"![{have.get('alt', '')}]({have.get('src', '')})"
    if tag == "li":
        return ("1. " if parent == "ol" else "- ") + bare + "\n"
    if tag == "tr":
        return "| " + " | ".join(c.strip(BLANK) for c in cells) + " |\n"
    return "" if tag in DROPPED else said


def markdown(rows: list[tuple]) -> str:
    """Markdown of one element's nodes in document order, each (depth, node_type, tag, attrs, text); elements are made as they close."""
    open_: list[tuple[int, str, list | None, list[str], list[str]]] = [(-1, "", None, [], [])]

    def close() -> None:
        _, tag, attrs, parts, cells = open_.pop()
        made = _closed(tag, attrs, parts, cells, open_[-1][1])
        open_[-1][3].append(made)
        open_[-1][4].append(made)

    skip = None
    for depth, kind, tag, attrs, text in rows:
        if skip is not None and depth > skip:
            continue
        skip = None
        while open_[-1][0] >= depth:
            close()
        if kind == TEXT:
            open_[-1][3].append(text)
        elif kind == ELEMENT:
            open_.append((depth, tag, attrs, [], []))
            skip = depth if tag == "template" else None
    while len(open_) > 1:
        close()
    return _collapsed("".join(open_[0][3])).strip(BLANK)
