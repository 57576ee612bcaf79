import pytest

from tessella.functions.htmltree import Tree, serialize
from tessella.functions.selectors import Page, Selector
from tessella.operators import dom


def html_of(source):
    return serialize([(r[3], r[6], r[7], r[8], r[9]) for r in Tree(source).rows() if r[6] != 9])


@pytest.mark.parametrize(("source", "body"), [
    ("<p>one<p>two", "<p>one</p><p>two</p>"), ("<p><b>x<br><p>y</p>", "<p><b>x<br></b></p><p><b>y</b></p>"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"), ("a &amp; b &lt; c", "a &amp; b &lt; c"),
    ('<div id="x" ID="y" title=\'"q"&amp;\'>t</div>', '<div id="x" title="&quot;q&quot;&amp;">t</div>'), ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"), ("x</p>y", "x<p></p>y"),
    ("<table><td>c</table>", "<table><tbody><tr><td>c</td></tr></tbody></table>"), ("<table>x<tr><b>y</b><td>1</table>z", "x<b>y</b><table><tbody><tr><td>1</td></tr></tbody></table>z"), ("<table><p>a<tr><td>b<p>c</table>", "<p>a</p><table><tbody><tr><td>b<p>c</p></td></tr></tbody></table>"),
    ("<table><input type=hidden><caption>k</caption><td><table><td>in</table></table>", '<table><input type="hidden"><caption>k</caption><tbody><tr><td><table><tbody><tr><td>in</td></tr></tbody></table></td></tr></tbody></table>'), ("<p>" + "<b>" * 5 + "x<p>y", "<p>" + "<b>" * 5 + "x" + "</b>" * 5 + "</p><p><b><b><b>y</b></b></b></p>"),
    ("<select><option>1<option>2</select>", "<select><option>1</option><option>2</option></select>"), ("<!-- a > b -->", None), ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
])
def test_tree_construction(source, body):
    if body is not None:
        assert html_of(source) == f"<html><head></head><body>{body}</body></html>"


def test_implied_parts_and_scripts():
    assert html_of("<!DOCTYPE html><title>T</title><script>var t='</p>';</script>x") == "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body>x</body></html>"
    assert Tree("<p>x").rows()[0][11] and not Tree("<!doctype html><p>x").rows()[0][11]
    assert html_of("<html lang=en><html lang=de class=c><body a=1><body a=2 b=3>x") == '<html lang="en" class="c"><head></head><body a="1" b="3">x</body></html>'
    assert [r[6] for r in Tree(None).rows()] == [9]


def test_deep_nesting_and_intervals():
    rows = Tree("<div>" * 20_000 + "x").rows()
    assert max(r[3] for r in rows) == 20_003
    for r in rows[:50]:
        assert r[2] == len(rows) - 1 or r[7] == "head"


@pytest.mark.parametrize(("source", "want"), [
    ("<h1> A </h1>x", "# A\n\nx"), ("<h6>A</h6>", "###### A"), ("<p> a </p><p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("a<hr>b", "a\n---\n\nb"), ("<b> x </b><strong>y</strong>", "** x ****y**"), ("<i>x</i><em>y</em>", "*x**y*"), ("<code>c</code>", "`c`"),
    ("<pre>p\n q</pre>z", "```\np\n q\n```\n\nz"), ("<blockquote>a<br>b</blockquote>c", "> a\n> b\n\nc"), ("<a>x</a>", "x"), ("<a href=/y> x </a>", "[x](/y)"), ("<a href=/y> </a>z", "z"), ("<img src=s alt=t>", "![t](s)"), ("<img>", "![]()"),
    ("<ul><li> a<li>b</ul>", "- a\n- b"), ("<ol><li>z</ol>", "1. z"), ("<li>lone", "- lone"), ("<table><tr><th> h <td>d</table>", "| h | d |"), ("<table><tr> <td><b>x</b> </table>y", "| **x** |\n\ny"), ("<div>a</div><section>b</section>", "a\nb"),
    ("a<script>s</script><style>t</style><noscript>n</noscript>b", "ab"), ("<span>s</span><u>u</u>", "su"), ("<div><div><div><div>deep", "deep"), ("<template><p>no</p></template>x", "x"), ("", ""), (None, ""),
])
def test_markdown(source, want):
    page = Page(source)
    assert page.markdown(next(page.find(Selector("body")), 0)) == want


def found(source, selector, within=0):
    page = Page(source)
    return [page.html(i) for i in page.find(Selector(selector), within)]


LIST = '<ul class="list"><li class="item active">1</li><li class="item">2</li><li class="item active" lang=en-GB>3</li></ul>'


@pytest.mark.parametrize(("source", "selector", "n"), [
    ("<h1>T</h1><p>x", "h1", 1), ('<div class="foo bar">c</div><div class=baz>o</div>', ".foo", 1), ("<div id=main>c</div>", "#main", 1), (LIST, "li", 3), ("<div id=outer><div id=inner><span>t</span></div></div>", "#outer span", 1),
    ("<input type=text><input type=password>", 'input[type="password"]', 1), ("<div>h</div>", "span", 0), (LIST, ".list .item.active", 2), (LIST, "li:first-child, li:last-child", 2), (LIST, "LI:nth-child(odd)", 2), (LIST, "li:nth-child( 2n + 1 )", 2),
    (LIST, "li:nth-child(-n+2)", 2), (LIST, "li:nth-last-child(1)", 1), (LIST, "li:not(.active)", 1), (LIST, "li:not(.active, [lang])", 1), (LIST, "li ~ li", 2), (LIST, "li + li", 2), (LIST, "ul>li", 3), (LIST, "[lang|=en]", 1), (LIST, "[class~=active]", 2),
    (LIST, "[lang='EN-gb' i]", 1), (LIST, "[lang='EN-gb']", 0), (LIST, "[class^='']", 0), (":root", ":root", 1), (LIST, ":root > body > *", 1), ("<p></p><p> </p><p><!-- c --></p>", "p:empty", 2), ("<p>1<b>2</b><p>3", "p:only-child", 0), ("<p>1<b>2</b><p>3", "b:only-of-type", 1),
    ("<p>1<div>2</div><p>3", "p:last-of-type", 1), (LIST, ":is(ul, li.active)", 3), (LIST, "li:hover", 0), ("<a href=x>1</a><a>2</a>", "a:link", 1), ("<template><p>x</p></template>", "p", 0), ("<p id='a.b'>x", r"#a\.b", 1),
    ("<form><input name=a><input disabled><input type=checkbox checked><button>g</button><select><option selected>x<option>y</select></form>", "input:enabled", 2),
    ("<form><input name=a><input disabled><input type=checkbox checked><button>g</button><select><option selected>x<option>y</select></form>", ":checked", 2), ("<div>plain</div>", "div:enabled", 0),
])
def test_selector_strings(source, selector, n):
    assert len(found(source, selector)) == n


def test_selectors_keep_to_a_subtree_and_to_case():
    page = Page('<div id=a class=x><span class=x>in a</span></div><div id=b><span class=x>in b</span></div>')
    a = next(page.find(Selector("#a")))
    assert [page.text(i) for i in page.find(Selector(".x"), a)] == ["in a"]
    assert len(found("<div class=Foo id=Main>x</div>", ".foo")) == len(found("<div class=Foo id=Main>x</div>", "#main")) == 1
    assert not found("<!DOCTYPE html><div class=Foo id=Main>x</div>", ".foo, #main")
    for bad in ("p:nonsense", "p >", "> p", "[a", "p::before", "", "a,,b", ":nth-child(x)", "p*", ":not(", "p:has(a)"):
        with pytest.raises(ValueError):
            Selector(bad)


def test_pages_answer_in_one_pass(spark):
    source = "<title> T&amp;x </title><nav><p>1<p class=a title=t>2<em>e</em></nav><table><td>c</table>"
    pages = spark.createDataFrame([(1, "u1", source), (2, "u2", None), (None, None, "<p>n")], "page_id long, count string, html string")
    asks = {"n": ("count", "p"), "t": ("text", "nav", ("em",)), "all": ("texts", "p"), "at": ("attr", "p.a", "title"), "h": ("html", "em"), "i": ("inner", "nav p.a"), "m": ("markdown", "table"), "c": ("closest", "em", "p")}
    got = {r.page_id: r for r in dom.project(pages, "page_id", "html", asks, ["count"]).collect()}
    r = got[1]
    assert (r["count"], r.n, r.t, r.all, r.at, r.h, r.i, r.m, r.c) == ("u1", 2, "12", ["1", "2e"], "t", "<em>e</em>", "2<em>e</em>", "| c |", '<p class="a" title="t">2<em>e</em></p>')
    assert (got[2].n, got[2].t, got[2].all, got[None].n) == (0, None, [], 1)
    assert [(x.page_id, x.idx, x.tag, x.text) for x in dom.select(pages, "page_id", "html", "p").where("page_id = 1").collect()] == [(1, 0, "p", "1"), (1, 1, "p", "2e")]
    assert dom.project(pages.limit(0), "page_id", "html", asks).count() == 0
    assert [r.rendered_title for r in dom.rendered_titles(pages, "page_id").orderBy("page_id").collect()] == [None, "T&x", None]
    og = spark.createDataFrame([(1, "<meta property='og:title' content=O>"), (2, "<title>D</title><h1> </h1>"), (3, "<title>D</title><p id=activity-name> A </p>")], "page_id long, html string")
    assert [r.rendered_title for r in dom.rendered_titles(og, "page_id").orderBy("page_id").collect()] == ["O", "D", "A"]
    assert [r.challenge for r in dom.challenge_pages(og.withColumn("html", dom.F.concat(dom.F.lit("<iframe src='//challenges.cloudflare.com'></iframe>"), "html")), "page_id").collect()] == [True] * 3


def test_fragments(spark):
    parts = spark.createDataFrame([(1, "<td>1<td>2"), (2, "x<p>y"), (3, None)], "i int, h string")
    get = lambda context: {r.i: r.html for r in dom.fragments(parts, "i", "h", context).collect()}
    assert get("tr")[1] == "<td>1</td><td>2</td>"
    assert (get("div")[2], get("body")[2], get("div")[3]) == ("x<p>y</p>", "x<p>y</p>", "")
    assert get("div")[1] == "12"


def test_selectors(spark):
    source = '<div id="outer"><span class="foo Bar">a</span><p>1</p><p class="item active" data-x="ab-c">2<em>e</em></p><input type="password" disabled><template><p>no</p></template></div><p>out</p>'
    pages = spark.createDataFrame([(1, "<!doctype html>" + source), (2, source), (3, None), (None, "<p>n</p>")], "page_id long, html string")
    nodes = dom.parse_dom(pages, "page_id", "html").cache()
    count = lambda rows: {r.page_id: r["count"] for r in rows.groupBy("page_id").count().collect()}
    assert count(nodes.where(dom.element("p"))) == {1: 3, 2: 3, None: 1}
    assert count(nodes.where(dom.has_class("bar"))) == {2: 1}
    assert count(nodes.where(dom.has_id("OUTER"))) == {2: 1}
    outer = nodes.where(dom.has_id("outer"))
    assert count(dom.within(nodes.where(dom.element("p")), outer, "page_id")) == {1: 2, 2: 2}
    assert count(dom.children_of(nodes.where(dom.element()), outer, "page_id")) == {1: 5, 2: 5}
    assert count(dom.around(nodes.where(dom.element()), nodes.where(dom.element("em")), "page_id")) == {1: 4, 2: 4}
    span = nodes.where(dom.element("span"))
    assert count(dom.after(nodes.where(dom.element("p")), span, "page_id")) == {1: 2, 2: 2}
    assert count(dom.after(nodes.where(dom.element("p")), span, "page_id", next_only=True)) == {1: 1, 2: 1}
    for op, value, n in (("=", "ab-c", 1), ("|=", "ab", 1), ("^=", "ab", 1), ("$=", "-c", 1), ("*=", "b-", 1), ("^=", "", 0), ("~=", "ab", 0), ("", "", 1)):
        assert nodes.where(dom.attr_is("data-x", op, value)).where("page_id = 1").count() == n, (op, value)
    assert nodes.where(dom.disabled() & (dom.F.col("page_id") == 1)).count() == 1
    assert nodes.where(dom.enabled()).count() == 0
    said = dom.text_of(nodes, outer, "page_id", drop=("em",)).where("page_id = 1").first()
    assert said.text_content == "a12"
    assert dom.drop_subtrees(nodes, outer, "page_id").where("page_id = 1 AND node_type = 3").count() == 1
    assert dom.first_of(nodes.where(dom.element("p")), "page_id").where("page_id = 1").count() == 1
    ranked = dom.with_type_rank(nodes, "page_id").where("page_id = 1 AND tag = 'p' AND NOT in_template").orderBy("node_id").collect()
    assert [(r.type_idx, r.n_elements) for r in ranked] == [(0, 5), (1, 5), (0, 2)]


def test_resources(spark):
    from tessella.operators import resources as res

    source = "<head><base href='/dir/'><link rel=StyleSheet href=a.css><link rel='x stylesheet' href=b.css><link rel=stylesheet href='file:///c.css'></head><img src=i.png><img src=i.png><img src='data:x'><script>run()</script><script type=text/template>no</script><script src=s.js defer></script><script> </script><a href=x>l</a>"
    pages = spark.createDataFrame([(1, "https://e.com/p", source), (2, "https://e.com/q", "<p>x")], "page_id long, url string, html string")
    chunks = spark.createDataFrame([(1, 1, source[50:]), (1, 0, source[:50]), (2, 0, "<p>x")], "page_id long, n int, part string")
    assert {r.page_id: r.html for r in res.join_chunks(chunks, "page_id", "n", "part").collect()} == {1: source, 2: "<p>x"}
    assert {r.page_id: r.base_url for r in res.base_urls(pages, "page_id").collect()} == {1: "https://e.com/dir/", 2: "https://e.com/q"}
    assert [(r["rank"], r.resource_url) for r in res.sub_resources(pages, "page_id").orderBy("rank").collect()] == [(1, "https://e.com/dir/i.png"), (2, "https://e.com/dir/b.css")]
    assert [r.resource_url for r in res.stylesheets(pages, "page_id").collect()] == ["https://e.com/dir/a.css"]
    assert sorted((r.phase, r.src, r.body) for r in res.scripts(pages, "page_id").collect()) == [(0, None, "run()"), (1, "s.js", "")]
    assert res.links(dom.parse_dom(pages, "page_id", "html")).count() == 1


def test_state_and_forms(spark):
    source = "<title> T </title><form action=/go><input name=a value='x y'><input type=radio name=r value=1><input type=radio name=r value=2 checked><select name=s><option>o1<option value=v2 selected>o2</select><textarea name=t>m&amp;n</textarea><button name=b>B</button></form><a class='" + "c" * 60 + "' href=/h>" + "w" * 90 + "</a>"
    pages = spark.createDataFrame([(1, "http://u", source)], "page_id long, url string, html string")
    nodes = dom.parse_dom(pages, "page_id", "html")
    assert [(r.action, r.query) for r in dom.form_query(nodes, "page_id").collect()] == [("/go", "a=x+y&r=2&s=v2&t=m%26n")]
    lines = dom.page_state(pages, "page_id").first().state.split("\n")
    assert lines[:4] == ["url=http://u", "title=T", "", '[0] <input name="a" value="x y" />']
    assert lines[-2] == f'[6] <a class="{"c" * 50}…" href="/h">{"w" * 80}…</a>'
