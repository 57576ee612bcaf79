"""Relations, text offsets and fragments on deep and wide pages, and the tree builder's odd cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessella.functions import tables
from tessella.functions.htmltree import Tree, serialize
from tessella.functions.selectors import Page, Selector
from tessella.operators import dom

NODE = "doc long, node_id int, subtree_end int, tag string, extra map<string,string>"


def html_of(tree):
    return serialize([(r[3], r[6], r[7], r[8], r[9]) for r in tree.rows() if r[6] != 9])


@pytest.mark.parametrize(("source", "body"), [
    ("<title><b>t</b> &amp; u</title>x", "x"), ("<textarea><b>x</b>&lt;</textarea>", "<textarea>&lt;b&gt;x&lt;/b&gt;&lt;</textarea>"), ("<textarea>\n\na</textarea>", "<textarea>\na</textarea>"),
    ("<h1>a<h2>b</h2>", "<h1>a</h1><h2>b</h2>"), ("<button>a<button>b</button>", "<button>a</button><button>b</button>"), ("<form id=1><form id=2>x</form>y", '<form id="1">x</form>y'),
    ("<table><caption>c<td>d</table>", "<table><caption>c</caption><tbody><tr><td>d</td></tr></tbody></table>"), ("<svg><path/><g/>t</svg>", "<svg><path></path><g></g>t</svg>"), ("<div/>x", "<div>x</div>"),
    ("<h1><b>a</b></h1><h2>c</h2>", "<h1><b>a</b></h1><h2>c</h2>"),
])
def test_tree_builder(source, body):
    assert html_of(Tree(source)).split("<body>")[1].removesuffix("</body></html>") == body


def test_title_is_text():
    page = Page("<title><b>t</b> &amp; u</title><p>x")
    assert page.text(next(page.find(Selector("title")))) == "<b>t</b> & u" and page.text(next(page.find(Selector("body")))) == "x"


@pytest.mark.parametrize(("context", "source", "want"), [
    ("body", "<p>a<p>b", "<p>a</p><p>b</p>"), ("body", "<tr><td>x", "x"), ("tbody", "<tr><td>x<td>y", "<tr><td>x</td><td>y</td></tr>"), ("tr", "<td>x<td>y", "<td>x</td><td>y</td>"), ("TD", "x<b>y", "x<b>y</b>"),
    ("select", "<option>1<option>2", "<option>1</option><option>2</option>"), ("html", "<title>t</title>x", "<head><title>t</title></head><body>x</body>"), ("div", "", ""), ("div", None, ""),
])
def test_fragments(spark, context, source, want):
    rows = Tree.fragment(source, context).rows()
    assert [r[7] for r in rows[:2]] == [None, "html"] and [r[0] for r in rows] == list(range(len(rows)))
    out = dom.fragments(spark.createDataFrame([(1, source)], "id long, html string"), "id", "html", context)
    assert out.collect()[0].html == want


def test_table_function(spark):
    tables.register(spark)
    pages = spark.createDataFrame([(1, "<p class=a>x<p>y"), (2, None), (3, "")], "id long, html string")
    by_sql = spark.sql("SELECT p.id, d.* FROM {pages} p, LATERAL parse_dom(p.html, NULL) d", pages=pages)
    as_frame = dom.parse_dom(pages, "id", "html")
    assert by_sql.columns == as_frame.columns
    key = lambda r: (r.id, r.node_id)
    assert sorted(by_sql.collect(), key=key) == sorted(as_frame.collect(), key=key)
    cells = spark.sql("SELECT d.tag FROM LATERAL parse_dom('<td>a<td>b', 'tr') d WHERE d.tag = 'td'")
    assert cells.count() == 2


def forest(rng, docs):
    """Random nested intervals: (doc, node_id, subtree_end, tag, extra)."""
    rows = []
    for doc in range(docs):
        n = rng.randint(1, 60)
        parent = [None] + [rng.randrange(max(0, i - 4), i) for i in range(1, n)]
        for i in range(1, n):  # document order: a node's parent is open when it comes
            while parent[i] != i - 1 and parent[i] not in _ups(parent, i - 1):
                parent[i] -= 1
        end = list(range(n))
        for i in range(n - 1, 0, -1):
            end[parent[i]] = max(end[parent[i]], end[i])
        rows += [(doc, i, end[i], rng.choice("abc"), {"k": str(i)}) for i in range(n)]
    return rows


def _ups(parent, i):
    out = []
    while i is not None:
        out.append(i)
        i = parent[i]
    return out


def test_relations(spark):
    rows = forest(random.Random(4), 25)
    nodes = spark.createDataFrame(rows, NODE).repartition(3)
    some, others = nodes.where("tag = 'a'"), nodes.where("tag <> 'b'")
    holds = lambda o, i: o[0] == i[0] and o[1] < i[1] <= o[2]
    outer = [r for r in rows if r[3] == "a"]
    got = lambda df: sorted((r.doc, r.node_id, r.extra["k"]) for r in df.collect())
    want = lambda test, of: sorted((r[0], r[1], r[4]["k"]) for r in of if test(r))
    mine = [r for r in rows if r[3] != "b"]
    assert got(dom.within(others, some, "doc")) == want(lambda r: any(holds(o, r) for o in outer), mine)
    assert got(dom.around(others, some, "doc")) == want(lambda r: any(holds(r, i) for i in outer), mine)
    assert got(dom.drop_subtrees(others, some, "doc")) == want(lambda r: not any(holds(o, r) or o[:2] == r[:2] for o in outer), mine)
    assert dom.within(others, some, "doc").columns == nodes.columns
    pairs = {(r.doc, r.node_id, r.outer_id, r.rank) for r in dom.nested(others, some, "doc", most=7).collect()}
    wanted = set()
    for r in mine:
        ups = sorted((o[1] for o in outer if holds(o, r)), reverse=True)
        wanted |= {(r[0], r[1], o, k) for k, o in enumerate(ups)}
    assert pairs == wanted
    assert {(r.doc, r.node_id, r.outer_id) for r in dom.nested(others, some, "doc", nearest=True).collect()} == {p[:3] for p in wanted if p[3] == 0}
    assert [r.c for r in spark.range(1).select(dom.compare_order(F.lit(3), F.lit(5)).alias("c")).collect()] == [-1]


def test_relations_of_nothing(spark):
    none, some = spark.createDataFrame([], NODE), spark.createDataFrame([(1, 0, 0, "a", None)], NODE)
    assert dom.within(none, some, "doc").count() == dom.within(some, none, "doc").count() == dom.around(some, none, "doc").count() == dom.nested(some, none, "doc").count() == 0
    assert dom.drop_subtrees(some, none, "doc").count() == 1


def test_a_page_20000_deep(spark):
    n = 20_000
    deep = spark.range(n).select(F.lit(1).cast("long").alias("doc"), F.col("id").cast("int").alias("node_id"), F.lit(n - 1).alias("subtree_end"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("tag"),
        F.when(F.col("id") == n - 1, 3).otherwise(1).alias("node_type"), F.when(F.col("id") == n - 1, "deep").alias("text"), F.lit(False).alias("in_template")).repartition(4)
    began = time.perf_counter()
    assert dom.around(deep, deep, "doc").count() == dom.within(deep, deep, "doc").count() == n - 1
    assert dom.nested(deep, deep, "doc", nearest=True).where("outer_id = node_id - 1").count() == n - 1
    texts = dom.text_of(deep, deep.where("node_type = 1"), "doc")
    assert texts.where("text_content = 'deep'").count() == n - 1
    assert time.perf_counter() - began < 60


def test_texts_of_nested_nodes(spark):
    pages = spark.createDataFrame([(1, "<div>a<p>b<i>c</i></p>é<script>no</script><template>t</template>d</div>"), (2, None)], "id long, html string")
    nodes = dom.parse_dom(pages, "id", "html")
    got = {r.tag: r.text_content for r in dom.text_of(nodes, nodes, "id", ("script",)).join(nodes.select("id", "node_id", "tag"), ["id", "node_id"]).where("id = 1 AND tag IS NOT NULL").collect()}
    assert got == {"html": "abcéd", "head": "", "body": "abcéd", "div": "abcéd", "p": "bc", "i": "c", "script": "", "template": ""}
    assert dom.text_of(nodes, nodes.where("id = 2"), "id").collect()[0].text_content == ""


def test_wide_pages_take_linear_time(spark):
    rows = "".join(f"<li class=r><a href=/{k}>t{k}</a><i>x</i><b>y</b></li>" for k in range(12_000))
    page = Page(f"<ul>{rows}</ul>")
    began = time.perf_counter()
    assert sum(1 for _ in page.find(Selector("li ~ li:nth-last-of-type(2n+1) a"))) == 6_000
    link = Selector("a")
    found = [next(page.find(link, at)) for at in page.find(Selector("li.r"))]
    assert len(found) == 12_000
    assert time.perf_counter() - began < 30


def test_links_with_what_is_around_them_need_no_join(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["nested_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan  # a broadcast node table outgrew the driver
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("most", [1, 3, 10_000])
@pytest.mark.parametrize("nearest", [False, True])
def test_nested_among_is_nested_with_names(spark, most, nearest):
    pages = spark.createDataFrame([(k, "<ul><li>a<ul><li><a href=x>b</a><li><i><a>c</a></i></ul><li><a>d</a></ul>" * k) for k in range(1, 6)] + [(9, None)], "id long, html string").repartition(3)
    nodes = dom.parse_dom(pages, "id", "html").where(dom.element()).localCheckpoint()
    inner, outer = F.col("tag").isin("a", "li"), F.col("tag") != "body"
    got = dom.nested_among(nodes, inner, outer, "id", ("tag", "attrs"), nearest, most)
    named = nodes.select("id", F.col("node_id").alias("outer_id"), "tag", F.to_json("attrs").alias("attrs"))
    want = dom.nested(nodes.where(inner), nodes.where(outer), "id", nearest).join(named, ["id", "outer_id"])
    columns = ["id", "node_id", "outer_id", "rank", "tag", "attrs"]
    assert sorted(map(str, got.withColumn("attrs", F.to_json("attrs")).select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.count() > 50


def test_nodes_with_chosen_columns(spark):
    pages = spark.createDataFrame([(1, "<p id=x>a<b>c</b>")], "id long, html string")
    whole = dom.parse_dom(pages, "id", "html")
    assert dom.parse_dom(pages, "id", "html", ("tag", "node_id")).collect() == whole.select("id", "node_id", "tag").collect()
