"""Each query with SQL gives the same rows as DuckDB over the smallest tables."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(value):
    return round(value, 9) if isinstance(value, float) else int(value) if isinstance(value, bool) else value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_match(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = Counter(tuple(map(plain, r)) for r in want.select(*(f'"{n}"' for n in names)).fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.select(*names).collect()) == rows
    assert rows


def test_entry(spark):
    assert entry.entry(spark).count() == 50


#: Queries whose SQL decodes closed references alone, on pages cut off within one.
CUT = "css_first_match dom_text_content outer_html page_state rendered_text scrape_failures serp_bing_parse serp_google_parse serp_sogou_parse serp_wechat_parse text_coalescing text_offsets tier_one_selectors to_markdown".split()


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    """Pages twice under other keys, so that each URL has two captures, their titles and headings cut off within a reference."""
    folder, c = tmp_path_factory.mktemp("cut"), duckdb.connect()
    ends = "['a&amp;&amp', 'b&am', '&amp;c&', '&quot', '&#39;&#3', '&lt&quot;', '&amp;amp&a']"
    c.sql(f"""CREATE TABLE pages AS SELECT page_id + 1000 * k AS page_id, url, regexp_replace(regexp_replace(html, '</title>', {ends}[1 + (page_id + k) % 7] || '</title>'), '</h1>', {ends}[1 + (page_id + k + 2) % 7] || '</h1>') AS html
    FROM read_parquet('{SF}/pages.parquet'), (VALUES (0), (1)) v(k)""")
    c.sql(f"COPY pages TO '{folder}/pages.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", [*CUT, "search_fetch_top_enrich"])
def test_rows_match_on_cut_and_repeated_pages(spark, cut, name):
    folder, c = cut
    got, want = entry.queries()[name](spark, folder), c.sql(entry.oracle_sql()[name])
    names = sorted(got.columns)
    rows = Counter(tuple(map(plain, r)) for r in want.select(*(f'"{n}"' for n in names)).fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.select(*names).collect()) == rows
    assert rows


def test_operators_read_open_references_as_html_does(spark):
    from tessella.operators import dom

    page = spark.createDataFrame([(1, "<h1>a &amp&quot b &am</h1>")], "id long, html string")
    got = dom.project(page, "id", "html", {"said": ("text", "h1"), "html": ("html", "h1")}).first()
    assert (got.said, got.html) == ('a &" b &am', '<h1>a &amp;" b &amp;am</h1>')


def test_references_keep_their_spelling(spark):
    from tessella.functions import text
    from tessella.operators import dom

    html = '<p title="a &amp; b&amp;c &quot; &x">&#60;i&gt; &amp &am &amp;amp; &copy; &NotEqualTilde; &nbsp;<!-- & --></p>'
    page = spark.createDataFrame([(1, html)], "id long, html string").withColumn("html", text.with_spelling(F.col("html")))
    got = dom.project(page, "id", "html", {"said": ("text", "p"), "html": ("html", "p")}).select(text.as_read(F.col("said")), text.as_spelled(F.col("html"))).first()
    assert tuple(got) == ("<i> &amp &am &amp; © \u2242\u0338 \xa0", html)
