"""Documents as a table of nodes, and queries over it.

A node's descendants are those of its document with node_id above its own up to its subtree_end. Nodes numbered in document
order nest like brackets, so relations between sets of nodes need no join with a range: both sets are sorted by document and
number once and walked in one pass with a running bound, or with a stack where pairs are asked for.

What asks only for nodes of one page at a time needs no joins: project() and records() parse a page once, find elements
by selectors in the same task and shuffle nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions.htmltree import Tree
from tessella.functions.selectors import KINDS, Page, Selector
from tessella.functions.tables import NODES

_KINDS = [pa.int32()] * 7 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.bool_(), pa.bool_()]


def parse_dom(pages: DataFrame, id_col: str, html_col: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """A row for each node of each page, in document order; node 0 is the document. Of its columns only those named are made, if any are."""
    fields = pages.sparkSession.createDataFrame([], NODES).schema
    chosen = [k for k, f in enumerate(fields) if not columns or f.name in columns]
    fields, kinds = [fields[k] for k in chosen], [_KINDS[k] for k in chosen]
    held = pages.select(F.col(id_col), F.col(html_col).cast("string").alias("__html"))
    schema = T.StructType([held.schema[id_col], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                made = [Tree(html).rows() for html in part.column(1).to_pylist()]
                at = pa.array([k for k, rows in enumerate(made) for _ in rows], pa.int32())
                values = [pa.array([r[k] for rows in made for r in rows], kind) for k, kind in zip(chosen, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *values], [id_col, *(f.name for f in fields)])

    return held.mapInArrow(run, schema)


#: What to ask of a page: a kind of selectors.KINDS, a selector ("" is the row itself in records()) and the kind's argument.
Ask = tuple


def _compile(ask: Ask) -> tuple:
    kind, selector, arg = (*ask, None)[:3]
    return KINDS[kind][1], Selector(selector) if selector else None, Selector(arg) if kind == "closest" else arg


def _answer(page: Page, ask: tuple, at: int):
    make, chosen, arg = ask
    return make(page, [at] if chosen is None else page.find(chosen, at), arg)


def _over_pages(pages: DataFrame, id_col: str, html_col: str, keep: list[str], made: T.StructType, ask, context: str | None = None) -> DataFrame:
    """The kept columns and those of `made`, which ask(page) gives as a dict, for each page, or fragment inside a context."""
    kept = [id_col, *(c for c in keep if c != id_col)]
    held = pages.select(*kept, F.col(html_col).cast("string").alias("__html"))
    arrow = {f.name: to_arrow_type(f.dataType) for f in made}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [ask(Page(html, context)) for html in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array([r[c] for r in rows], kind) for c, kind in arrow.items())], [*kept, *arrow])

    return held.mapInArrow(run, T.StructType([*held.schema[: len(kept)], *made]))


def project(pages: DataFrame, id_col: str, html_col: str, asks: dict[str, Ask], keep: list[str] | None = None) -> DataFrame:
    """A row for each page with an answer for each name; pages are parsed once and nothing is shuffled.

    A selector that is none raises ValueError. A null page is an empty one."""
    ready = {name: _compile(a) for name, a in asks.items()}
    made = T.StructType().fromDDL(", ".join(f"`{n}` {KINDS[a[0]][0]}" for n, a in asks.items()))
    return _over_pages(pages, id_col, html_col, keep or [], made, lambda page: {n: _answer(page, a, 0) for n, a in ready.items()})


def select(pages: DataFrame, id_col: str, html_col: str, selector: str, keep: list[str] | None = None) -> DataFrame:
    """(id, idx, node_id, tag, attrs, text) of each element that a selector chooses, in document order."""
    found = project(pages, id_col, html_col, {"__nodes": ("nodes", selector)}, keep)
    return found.select(id_col, *(keep or []), F.posexplode("__nodes").alias("idx", "n")).select(id_col, *(keep or []), "idx", "n.*")


def fragments(pages: DataFrame, id_col: str, html_col: str, context: str = "body") -> DataFrame:
    """(id, html): each fragment as it is parsed inside an element of the context's tag."""
    return _over_pages(pages, id_col, html_col, [], T.StructType().fromDDL("html string"), lambda page: {"html": page.html(1, inner=True)}, context)


def records(pages: DataFrame, id_col: str, html_col: str, rows: list[tuple[str, dict[str, list[Ask]]]], name: str = "rows") -> DataFrame:
    """(id, rows): for each page the elements of each row selector in turn, with the first answer that isn't blank for each field.

    rows is an array of structs: kind (which row selector), pos (the place among all rows) and the fields, null if blank.
    """
    types: dict[str, str] = {}
    ready = []
    for selector, fields in rows:
        ready.append((Selector(selector), {f: [_compile(a) for a in asks] for f, asks in fields.items()}))
        types |= {f: KINDS[asks[0][0]][0] for f, asks in fields.items()}
    made = T.StructType().fromDDL(f"{name} array<struct<kind:int,pos:int,{','.join(f'{n}:{t}' for n, t in types.items())}>>")

    def ask(page: Page) -> dict:
        out = []
        for kind, (chosen, fields) in enumerate(ready):
            for at in page.find(chosen):
                row = dict.fromkeys(types) | {"kind": kind, "pos": len(out)}
                for f, asks in fields.items():
                    answers = (_answer(page, a, at) for a in asks)
                    row[f] = next((x for x in answers if (x.strip() if isinstance(x, str) else x)), None)
                out.append(row)
        return {name: out}

    return _over_pages(pages, id_col, html_col, [], made, ask)


# Conditions on a node, for where().
def element(tag: str | None = None) -> Column:
    """An element outside templates, of a tag if given."""
    ok = (F.col("node_type") == 1) & ~F.col("in_template")
    return ok if tag is None else ok & (F.col("tag") == tag.lower())


def attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def attr_is(name: str, op: str = "", value: str = "") -> Column:
    """An attribute test: present, or = ~= |= ^= $= *= as in CSS; the last three match nothing for an empty value."""
    a = attribute(name)
    test = {
        "": lambda: a.isNotNull(), "=": lambda: a == value, "~=": lambda: F.array_contains(F.split(a, r"[ \t\n\f\r]+"), value) & F.lit(value != ""),
        "|=": lambda: (a == value) | F.startswith(a, F.lit(value + "-")), "^=": lambda: F.startswith(a, F.lit(value)) & F.lit(value != ""),
        "$=": lambda: F.endswith(a, F.lit(value)) & F.lit(value != ""), "*=": lambda: F.contains(a, F.lit(value)) & F.lit(value != ""),
    }[op]()
    return F.coalesce(test, F.lit(False))


def has_class(name: str) -> Column:
    """Class names are compared without case in quirks documents."""
    have = F.split(F.coalesce(attribute("class"), F.lit("")), r"[ \t\n\f\r]+")
    return F.array_contains(have, name) | (F.col("quirks") & F.array_contains(F.transform(have, lambda x: F.lower(x)), name.lower()))


def has_id(name: str) -> Column:
    have = F.coalesce(attribute("id"), F.lit(""))
    return (have == name) | (F.col("quirks") & (F.lower(have) == name.lower()))


CONTROLS = ("button", "fieldset", "input", "optgroup", "option", "select", "textarea")


def disabled() -> Column:
    return F.col("tag").isin(*CONTROLS) & attr_is("disabled")


def enabled() -> Column:
    return F.col("tag").isin(*CONTROLS) & ~attr_is("disabled")


def checked() -> Column:
    return attr_is("checked") | attr_is("selected")


# Relations between sets of nodes; each returns nodes of the first.
def _bounded(nodes: DataFrame, marks: DataFrame, doc: str, bound: str, marks_first: bool, backwards: bool = False) -> DataFrame:
    """(__row, __bound, __seen) for nodes: the running bound over marks before each in document order, or behind it if backwards."""
    mine = nodes.select(F.col(doc).alias("__doc"), F.col("node_id").alias("__at"), F.struct(*(F.col(f"`{c}`") for c in nodes.columns)).alias("__row"), F.lit(None).cast("int").alias("__mark"))
    theirs = marks.select(F.col(doc).alias("__doc"), F.col("node_id").alias("__at"), F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), F.col(bound).alias("__mark"))
    turn = F.col("__row").isNull() if not marks_first else F.col("__row").isNotNull()
    w = Window.partitionBy("__doc").orderBy(F.desc("__at") if backwards else F.asc("__at"), turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return mine.unionByName(theirs).withColumn("__bound", (F.min if backwards else F.max)("__mark").over(w)).where("__row IS NOT NULL")


def within(nodes: DataFrame, outer: DataFrame, doc: str) -> DataFrame:
    """Descendants of nodes in outer: those that the furthest subtree begun before them reaches. One sort, one pass."""
    return _bounded(nodes, outer, doc, "subtree_end", marks_first=False).where("__bound >= __at").select("__row.*")


def around(nodes: DataFrame, inner: DataFrame, doc: str) -> DataFrame:
    """Ancestors of nodes in inner: those whose subtree holds the next of them. One sort, one pass."""
    return _bounded(nodes, inner, doc, "node_id", marks_first=False, backwards=True).where("__bound <= __row.subtree_end").select("__row.*")


def nested(inner: DataFrame, outer: DataFrame, doc: str, nearest: bool = False, most: int = 10_000) -> DataFrame:
    """(doc, node_id, outer_id, rank): each node of inner with the nodes of outer that hold it, the nearest first, from 0.

    A stack-tree merge: each document's nodes pass in order by a stack of the outer subtrees that are open, so the work is that
    of the sort and of the pairs that come out; nearest gives at most one of them. A task holds one stack and `most` pairs.
    """
    ends = [x.select(F.col(doc).alias("__doc"), F.col("node_id").alias("at"), F.col("subtree_end").alias("stop"), F.lit(k).alias("turn")) for k, x in enumerate((inner, outer))]
    return _stacked(ends[0].unionByName(ends[1]), doc, [], nearest, most)


def nested_among(nodes: DataFrame, inner: Column, outer: Column, doc: str, keep: tuple[str, ...] = (), nearest: bool = False, most: int = 10_000) -> DataFrame:
    """nested() of nodes chosen by two conditions, with the kept columns of the outer ones: nodes are read once, and nothing is
    joined to tell what the outer ones are."""
    turns = F.array_compact(F.array(F.when(inner, 0), F.when(outer, 1)))
    return _stacked(nodes.select(F.col(doc).alias("__doc"), F.col("node_id").alias("at"), F.col("subtree_end").alias("stop"), F.explode(turns).alias("turn"), *keep), doc, list(keep), nearest, most)


def _stacked(ends: DataFrame, doc: str, keep: list[str], nearest: bool, most: int) -> DataFrame:
    """Pairs of (__doc, at, stop, turn, kept columns): nodes of turn 0 with those of turn 1 that hold them."""
    rows = ends.repartition("__doc").sortWithinPartitions("__doc", "at", "turn")
    schema = T.StructType([rows.schema["__doc"], *T.StructType().fromDDL("node_id int, outer_id int, rank int"), *(rows.schema[c] for c in keep)])
    names, kinds = schema.names, [pa.int32()] * 3 + [to_arrow_type(rows.schema[c].dataType) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(column: pa.Array, out: tuple) -> pa.RecordBatch:
            kept = zip(*out[4], strict=True) if out[4] else [()] * len(keep)
            return pa.RecordBatch.from_arrays([column.take(pa.array(out[0], pa.int32())), *(pa.array(list(c), t) for c, t in zip((*out[1:4], *kept), kinds, strict=True))], names)

        now, ids, stops, held = object(), [], [], []
        for batch in batches:
            column, out = batch.column(0), ([], [], [], [], [])
            for k, (name, at, stop, turn, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if name != now:
                    now, ids, stops, held = name, [], [], []
                while stops and stops[-1] < at:
                    ids.pop()
                    stops.pop()
                    held.pop()
                if turn:
                    ids.append(at)
                    stops.append(stop)
                    held.append(row)
                    continue
                around = slice(None, -2 if nearest else None, -1)
                found, rows_of = ids[around], held[around]
                for a in range(0, len(found), most):
                    part = found[a : a + most]
                    for c, made in zip(out, ([k] * len(part), [at] * len(part), part, range(a, a + len(part)), rows_of[a : a + most] if keep else ()), strict=True):
                        c.extend(made)
                    if len(out[0]) >= most:
                        yield pairs(column, out)
                        out = ([], [], [], [], [])
            yield pairs(column, out)

    return rows.mapInArrow(run, schema).withColumnRenamed("__doc", doc)


def compare_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: whether a node comes before, is or comes behind another of its document, by their numbers."""
    return F.signum((a - b).cast("double")).cast("int")


def children_of(nodes: DataFrame, parents: DataFrame, doc: str) -> DataFrame:
    p = parents.select(F.col(doc).alias("__doc"), F.col("node_id").alias("__parent"))
    return nodes.join(p, (F.col(doc) == F.col("__doc")) & (F.col("parent_id") == F.col("__parent")), "left_semi")


def after(nodes: DataFrame, earlier: DataFrame, doc: str, next_only: bool = False) -> DataFrame:
    """Elements with one of earlier before them among their siblings, or right before them."""
    e = earlier.select(F.col(doc).alias("__doc"), F.col("parent_id").alias("__parent"), F.col("elem_idx").alias("__idx"))
    place = (F.col("elem_idx") == F.col("__idx") + 1) if next_only else (F.col("elem_idx") > F.col("__idx"))
    return nodes.join(e, (F.col(doc) == F.col("__doc")) & (F.col("parent_id") == F.col("__parent")) & place, "left_semi")


def nth_child(a: int, b: int) -> Column:
    """:nth-child(an+b)."""
    k = F.col("elem_idx") + 1 - b
    return (k == 0) if a == 0 else ((k % a) == 0) & (k * (1 if a > 0 else -1) >= 0)


def with_type_rank(nodes: DataFrame, doc: str) -> DataFrame:
    """nodes with type_idx, an element's place among siblings of its tag, and n_elements, that of all its siblings."""
    of = Window.partitionBy(doc, "parent_id")
    return nodes.withColumn("type_idx", F.row_number().over(Window.partitionBy(doc, "parent_id", "node_type", "tag").orderBy("node_id")) - 1).withColumn("n_elements", F.count(F.when(F.col("node_type") == 1, 1)).over(of))


def first_of(nodes: DataFrame, doc: str) -> DataFrame:
    """The first of the nodes in each document."""
    return nodes.groupBy(doc).agg(F.min_by(F.struct(*(c for c in nodes.columns if c != doc)), "node_id").alias("n")).select(doc, "n.*")


def id_index(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, id, node_id, n_elements): the first element of each id in document order, templates aside; one partial aggregate."""
    named = nodes.where(element() & (F.coalesce(attribute("id"), F.lit("")) != "")).select(doc, attribute("id").alias("id"), "node_id")
    return named.groupBy(doc, "id").agg(F.min("node_id").alias("node_id"), F.count("*").alias("n_elements"))


def page_texts(nodes: DataFrame, doc: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """(doc, page_text, spans): each document's text once, without that in templates and in dropped tags, and where in it
    the text of each node starts and stops, by number. nodes: all nodes of the documents.

    One pass in document order adds up the lengths, so a document's row is as long as the document, however deep it is.
    """
    w = Window.partitionBy(doc).orderBy("node_id")
    gone = F.max(F.when(F.col("tag").isin(*drop), F.col("subtree_end"))).over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("node_id") if drop else F.lit(False)
    said = nodes.select(doc, "node_id", "subtree_end", F.when((F.col("node_type") == 3) & ~F.col("in_template") & ~F.coalesce(gone, F.lit(False)), F.col("text")).alias("__said"))
    upto = said.withColumn("__upto", F.sum(F.coalesce(F.char_length("__said"), F.lit(0))).over(w))
    rows = upto.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("node_id", "subtree_end", "__upto", "__said"))).alias("n"))
    text = F.array_join(F.transform("n", lambda x: x["__said"]), "")
    spans = F.transform("n", lambda x: F.struct(x["__upto"].cast("int").alias("start"), F.element_at("n", x["subtree_end"] + 1)["__upto"].cast("int").alias("stop")))
    return rows.select(doc, text.alias("page_text"), spans.alias("spans"))


def text_of(nodes: DataFrame, wanted: DataFrame, doc: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """(doc, node_id, text_content) of wanted nodes: their text nodes joined in order, without those in dropped tags.

    nodes: all nodes of the documents. Every wanted node is a substring of its document's text, which is made once."""
    texts = page_texts(nodes, doc, drop).withColumnRenamed(doc, "__doc")
    held = wanted.select(doc, "node_id").join(texts, F.col(doc) == F.col("__doc"), "left")
    span = F.get("spans", F.col("node_id"))
    return held.select(doc, "node_id", F.coalesce(F.substring("page_text", span["start"] + 1, span["stop"] - span["start"]), F.lit("")).alias("text_content"))


def steps(nodes: DataFrame, doc: str) -> DataFrame:
    """nodes with next_id and previous_id in document order and after_id, the first node behind a node's subtree; null at the ends."""
    w = Window.partitionBy(doc).orderBy("node_id")
    last = F.max("node_id").over(Window.partitionBy(doc))
    behind = F.col("subtree_end") + 1
    return nodes.withColumns({"next_id": F.lead("node_id").over(w), "previous_id": F.lag("node_id").over(w), "after_id": F.when(behind <= last, behind)})


def walk(nodes: DataFrame, doc: str, shown: Column, rejected: Column | None = None) -> DataFrame:
    """The nodes that a tree walker shows in document order, numbered; what it rejects takes its subtree with it."""
    left = nodes if rejected is None else drop_subtrees(nodes, nodes.where(rejected), doc)
    return left.where(shown).withColumn("step", F.row_number().over(Window.partitionBy(doc).orderBy("node_id")) - 1)


def with_attribute(nodes: DataFrame, where: Column, name: str, value: Column | None) -> DataFrame:
    """nodes with an attribute set where a condition holds; a null value removes it."""
    kept = F.map_filter("attrs", lambda k, v: k != name)
    new = kept if value is None else F.map_concat(kept, F.create_map(F.lit(name), value))
    return nodes.withColumn("attrs", F.when(where & (F.col("node_type") == 1), new).otherwise(F.col("attrs")))


def drop_subtrees(nodes: DataFrame, roots: DataFrame, doc: str) -> DataFrame:
    """nodes without the given ones and what is in them."""
    return _bounded(nodes, roots, doc, "subtree_end", marks_first=True).where("__bound IS NULL OR __bound < __at").select("__row.*")


#: Elements that a visitor can use.
INTERACTIVE = "a, button, input, select, textarea, [role=button], [role=link], [onclick], [tabindex]"


def resolve(href: Column, base: Column) -> Column:
    """A link resolved against its page; null for one that is no URL."""

    def one(link: str | None, page: str | None) -> str | None:
        try:
            return None if link is None else urljoin(page or "", link)
        except ValueError:
            return None

    @pandas_udf("string")
    def join(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(h, b, strict=True)], dtype=object)

    return join(href, base)


def resolve_module(specifier: Column, referrer: Column, base: Column) -> Column:
    """A module's address: an absolute URL as it is, one that starts with /, ./ or ../ against the script that asks for it, or
    against the page where that has no address of its own; null for a bare name."""
    no_address = F.coalesce(referrer, F.lit("")).isin("", ".", "about:blank") | F.startswith(referrer, F.lit("<"))
    from_ = F.when(no_address, base).otherwise(referrer)
    near = specifier.rlike(r"^(/|\./|\.\./)")
    absolute = specifier.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(near, resolve(specifier, from_)).when(absolute, specifier)


# The attributes a page's state names.
STATE_ATTRS = ("id", "class", "href", "type", "name", "value", "placeholder", "aria-label", "title", "src", "alt", "role")


def page_state(pages: DataFrame, doc: str, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(doc, state): a page's URL, title and numbered interactive elements as text; attributes in order of name."""
    read = project(pages, doc, html_col, {"__title": ("text", "title"), "__nodes": ("nodes", INTERACTIVE)}, [url_col])

    def line(n: Column, k: Column) -> Column:
        parts = []
        for name in sorted(STATE_ATTRS):
            a = F.try_element_at(n["attrs"], F.lit(name))
            shown = F.when(F.char_length(a) > 50, F.concat(F.substring(a, 1, 50), F.lit("…"))).otherwise(a) if name == "class" else a
            parts.append(F.when(a.isNotNull(), F.concat(F.lit(f' {name}="'), shown, F.lit('"'))).otherwise(""))
        text = F.substring(F.trim(F.regexp_replace(n["text"], r"^\s+|\s+$", "")), 1, 100)
        text = F.when(F.char_length(text) > 80, F.concat(F.substring(text, 1, 80), F.lit("…"))).otherwise(text)
        head = F.concat(F.lit("["), k, F.lit("] <"), n["tag"], *parts)
        return F.when(text == "", F.concat(head, F.lit(" />\n"))).otherwise(F.concat(head, F.lit(">"), text, F.lit("</"), n["tag"], F.lit(">\n")))

    none = lambda c: F.coalesce(c, F.lit(""))
    lines = F.array_join(F.transform("__nodes", line), "")
    return read.select(doc, F.concat(F.lit("url="), none(F.col(url_col)), F.lit("\ntitle="), none(F.trim("__title")), F.lit("\n\n"), lines).alias("state"))


# Where a rendered page's title stands, and the signs of a challenge page.
TITLES = "#activity-name, h1, .article-title"
CHALLENGES = ("Just a moment", "Attention Required")


def rendered_titles(pages: DataFrame, doc: str, html_col: str = "html") -> DataFrame:
    """(doc, rendered_title): an article title element's text, else the document's title, else og:title; null if all are blank."""
    read = project(pages, doc, html_col, {"__a": ("text", TITLES), "__b": ("text", "title"), "__c": ("attr", 'meta[property="og:title"]', "content")})
    trimmed = lambda c: F.nullif(F.regexp_replace(c, r"^[\s\xa0]+|[\s\xa0]+$", ""), F.lit(""))
    return read.select(doc, F.coalesce(trimmed("__a"), trimmed(F.regexp_replace("__b", r"[ \t\n\f\r]+", " ")), F.nullif("__c", F.lit(""))).alias("rendered_title"))


def challenge_pages(pages: DataFrame, doc: str, html_col: str = "html") -> DataFrame:
    """(doc, challenge): whether a page is a Cloudflare challenge, by its title or its frame."""
    read = project(pages, doc, html_col, {"__title": ("text", "title"), "__frames": ("count", 'iframe[src*="challenges.cloudflare.com"]')})
    said = F.coalesce("__title", F.lit(""))
    return read.select(doc, ((F.col("__frames") > 0) | F.contains(said, F.lit(CHALLENGES[0])) | F.contains(said, F.lit(CHALLENGES[1]))).alias("challenge"))


def scrape_record(pages: DataFrame, doc: str, html_col: str = "html", url_col: str = "url", selector: str = "", error_col: str | None = None, spelled: bool = False) -> DataFrame:
    """(doc, markdown, html, title, source_url, description, status_code): what a scrape returns for each page.

    With an error column, which holds why a fetch failed, there are success and error too: a failed row has status 500, its
    URL and its error, and nothing else. spelled: a selected part keeps its references as the source spells them, closed ones alone."""
    from tessella.functions.text import as_read, as_spelled, description, page_title, with_spelling

    keep = [url_col, html_col, *([error_col] if error_col else [])]
    asked = pages.withColumn("__marked", with_spelling(F.col(html_col)) if spelled else F.col(html_col))
    read = project(asked, doc, "__marked", {"markdown": ("markdown", selector or "body"), **({"__part": ("html", selector)} if selector else {})}, keep)
    if spelled:
        read = read.withColumns({"markdown": as_read(F.col("markdown")), **({"__part": as_spelled(F.col("__part"))} if selector else {})})
    html = F.col("__part") if selector else F.col(html_col)
    made = {"markdown": F.col("markdown"), "html": html, "title": page_title(F.col(html_col)), "description": description(F.col(html_col))}
    if not error_col:
        return read.select(doc, made["markdown"], html.alias("html"), made["title"].alias("title"), F.col(url_col).alias("source_url"), made["description"].alias("description"), F.lit(200).alias("status_code"))
    ok = F.col(error_col).isNull()
    return read.select(doc, ok.alias("success"), *(F.when(ok, c).alias(n) for n, c in made.items()), F.col(url_col).alias("source_url"), F.when(ok, 200).otherwise(500).alias("status_code"), F.col(error_col).alias("error"))


def tier_one(pages: DataFrame, doc: str, selector: str, html_col: str = "html", spelled: bool = False) -> DataFrame:
    """(doc, content): the first element that a selector chooses in a page without its head, scripts and styles, as HTML.

    A selector that is none gives the whole page without those, one that finds nothing empty text. spelled: as in scrape_record()."""
    from tessella.functions.text import as_spelled, strip_non_content, with_spelling

    bare = pages.select(doc, strip_non_content(F.col(html_col)).alias("__bare"))
    try:
        Selector(selector)
    except ValueError:
        return bare.select(doc, F.col("__bare").alias("content"))
    found = project(bare.withColumn("__bare", with_spelling(F.col("__bare"))) if spelled else bare, doc, "__bare", {"__found": ("html", selector)})
    return found.select(doc, F.coalesce(as_spelled(F.col("__found")) if spelled else "__found", F.lit("")).alias("content"))


def apply_to_pages(pages: DataFrame, make, out: str, doc: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(doc, columns of out): what a function of a page's URL and HTML returns, a dict or None, over Arrow batches."""
    made = T.StructType().fromDDL(out)
    held = pages.select(doc, F.col(url_col).alias("__url"), F.col(html_col).cast("string").alias("__html"))
    arrow = {f.name: to_arrow_type(f.dataType) for f in made}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [make(u, h) or {} for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r.get(c) for r in rows], kind) for c, kind in arrow.items())], [doc, *arrow])

    return held.mapInArrow(run, T.StructType([held.schema[doc], *made]))


def form_query(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, form, action, query): what submitting each form without a pressed button would send.

    Named fields that are not disabled, in document order; boxes only if checked; buttons, files and resets never. A
    select sends its selected option, else its first.
    """
    forms = nodes.where(element("form")).select(doc, F.col("node_id").alias("form"), F.col("subtree_end").alias("form_end"), attribute("action").alias("action"))
    kind = F.lower(F.coalesce(attribute("type"), F.lit("")))
    sends = element() & F.col("tag").isin("input", "select", "textarea") & (F.coalesce(attribute("name"), F.lit("")) != "") & ~attr_is("disabled") & ~kind.isin("file", "reset", "button", "submit") & (~kind.isin("checkbox", "radio") | checked())
    fields = nodes.where(sends)
    said = text_of(nodes, fields.where("tag = 'textarea'"), doc)
    chosen = nodes.where(element("option")).select(F.col(doc).alias("__doc"), F.col("node_id").alias("__at"), F.col("subtree_end").alias("__end"), attr_is("selected").alias("__selected"), attribute("value").alias("__value"))
    picks = fields.where("tag = 'select'").select(doc, "node_id", "subtree_end").join(chosen, (F.col(doc) == F.col("__doc")) & (F.col("__at") > F.col("node_id")) & (F.col("__at") <= F.col("subtree_end")))
    picks = picks.groupBy(doc, "node_id").agg(F.min_by(F.struct("__at", "__end", "__value"), F.struct(~F.col("__selected"), "__at")).alias("o")).select(doc, "node_id", "o.*")
    option = text_of(nodes, picks.select(doc, F.col("__at").alias("node_id"), F.col("__end").alias("subtree_end")), doc).toDF(doc, "__at", "__said")
    picks = picks.join(option, [doc, "__at"], "left").select(doc, "node_id", F.coalesce("__value", "__said", F.lit("")).alias("picked"))
    rows = fields.join(said, [doc, "node_id"], "left").join(picks, [doc, "node_id"], "left")
    box = F.when(kind.isin("checkbox", "radio"), F.coalesce(attribute("value"), F.lit("on"))).otherwise(F.coalesce(attribute("value"), F.lit("")))
    value = F.when(F.col("tag") == "select", F.coalesce("picked", F.lit(""))).when(F.col("tag") == "textarea", F.coalesce("text_content", F.lit(""))).otherwise(box)
    coded = lambda c: F.url_encode(c)
    pairs = rows.select(F.col(doc).alias("__doc"), F.col("node_id").alias("__at"), F.concat(coded(attribute("name")), F.lit("="), coded(value)).alias("__pair"))
    held = forms.join(pairs, (F.col(doc) == F.col("__doc")) & (F.col("__at") > F.col("form")) & (F.col("__at") <= F.col("form_end")), "left")
    order = F.array_sort(F.collect_list(F.when(F.col("__at").isNotNull(), F.struct("__at", "__pair"))))
    return held.groupBy(doc, "form", "action").agg(F.array_join(F.transform(order, lambda x: x["__pair"]), "&").alias("query"))
