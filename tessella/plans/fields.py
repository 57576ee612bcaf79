"""Queries over character sets, parameters, keys, scrape results and a caller's own functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import charset, policy, urls
from tessella.operators import cookies, dom, search, serp
from tessella.plans.documents import _H1, _decoded
from tessella.plans.lookups import _ASK, _SET, cookie_sql
from tessella.plans.web import _ORIGIN, C, _events, _no_content, _pages, _since_epoch, _split, query

_ID = "page_id"
_LABELS = sorted(charset.LABELS.items())
_LABEL_VALUES = ", ".join(f"({i}, '{name}')" for i, (_, name) in enumerate(_LABELS))


@query(f"SELECT page_id, CASE WHEN page_id % 9 = 8 THEN NULL ELSE name END AS encoding FROM pages JOIN (VALUES {_LABEL_VALUES}) v(i, name) ON i = length(html) % {len(_LABELS)}")
def charset_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of the web, in either case, with white space around some and a letter too many in others, looked up by a join."""
    label = F.element_at(F.array(*(F.lit(x) for x, _ in _LABELS)), (F.length("html") % len(_LABELS) + 1).cast("int"))
    said = F.when(C(_ID) % 9 == 8, F.concat(label, F.lit("x"))).when(C(_ID) % 3 == 0, F.upper(label)).when(C(_ID) % 3 == 1, F.concat(F.lit(" \t"), label, F.lit("\n"))).otherwise(label)
    return charset.with_encoding(_pages(spark, sf_dir).select(_ID, said.alias("label")), "label").select(_ID, "encoding")


@query("SELECT page_id, CASE length(html) % 6 WHEN 2 THEN NULL WHEN 3 THEN html || chr(65533) WHEN 4 THEN chr(65279) || html ELSE html END AS text FROM pages")
def decode_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with and without byte order marks and with a wrong byte, under labels that are right, wrong or overruled."""
    h, mark, plain = F.length("html") % 6, F.lit(b"\xef\xbb\xbf"), F.to_binary("html", F.lit("utf-8"))
    body = F.when(h == 1, F.concat(F.lit(b"\xff\xfe"), F.encode("html", "UTF-16LE"))).when(h == 5, F.encode("html", "UTF-16BE")).when(h.isin(2, 3), F.concat(plain, F.lit(b"\xff"))).otherwise(F.concat(mark, plain))
    label = F.when(h == 0, "Windows-1252").when(h == 5, "unicodeFFFE").otherwise("utf8")
    rows = _pages(spark, sf_dir)
    return charset.with_text(rows.select(_ID, body.alias("body"), label.alias("label"), h.alias("h")), C("body"), C("label"), C("h") == 2, C("h") == 4).select(_ID, "text")


_ASKED = "concat('?n=', cast(page_id AS VARCHAR(20)), '&k=', cast(length(html) % 10 AS VARCHAR(9)), '&n=a+b%26&bad=%zz&=none&flag&', regexp_extract(url, '[?]([^#]*)', 1))"


@query(r"""WITH t AS (SELECT page_id, 'n=' || page_id AS n, 'k=' || length(html) % 10 AS k, regexp_extract(url, '[?]([^#]*)', 1) AS own FROM pages), u AS (SELECT *, CASE WHEN own = '' THEN '' ELSE '&' || own END AS more FROM t)
SELECT page_id, page_id::VARCHAR AS first_n, page_id || '|a b&' AS all_n, n || '&' || k || '&n=a+b%26&bad=%25zz&=none&flag=' || more AS whole, 'n=x+y&' || k || '&bad=%25zz&=none&flag=' || more AS changed, k || '&bad=%25zz&=none&flag=' || more || '&new=1' AS without_n,
array_to_string(list_transform(list_sort(['=none', 'bad=%25zz', 'flag=', k, n || '&n=a+b%26'] || CASE WHEN own = '' THEN [] ELSE string_split(own, '&') END), lambda x: x), '&') AS sorted FROM u""")
def search_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters with repeats, odd escapes and the URL's own: read, set, taken out, sorted and written again."""
    pairs = urls.query_pairs(F.expr(_ASKED))
    read = _pages(spark, sf_dir).select(_ID, pairs.alias("p"))
    say = lambda c, name: urls.form_encoded(c).alias(name)
    without = urls.params_append(urls.params_delete(C("p"), "n"), "new", F.lit("1"))
    return read.select(
        _ID, urls.params_get(C("p"), "n").alias("first_n"), F.array_join(urls.params_get_all(C("p"), "n"), "|").alias("all_n"), say(C("p"), "whole"), say(urls.params_set(C("p"), "n", F.lit("x y")), "changed"), say(without, "without_n"), say(urls.params_sort(C("p")), "sorted"),
    )


@query()
def web_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's digest by one of the web's algorithms; tests hold them against the standard library."""
    names = ("sha-1", "SHA-256", "Sha-384", "SHA-512", "SHA-512/224", "SHA-512/256", "md5")
    name = F.element_at(F.array(*map(F.lit, names)), (F.length("html") % len(names) + 1).cast("int"))
    return _pages(spark, sf_dir).select(_ID, name.alias("algorithm"), F.lower(F.hex(policy.digest(name, F.to_binary("html", F.lit("utf-8"))))).alias("digest"))


_FAILED = "CASE WHEN length(html) % 7 = 0 THEN concat('timeout: ', url) END"
_TITLE = "nullif(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '')"


@query(f"""SELECT page_id, error IS NULL AS success, CASE WHEN error IS NULL THEN '# ' || trim({_decoded(_H1)}) END AS markdown, CASE WHEN error IS NULL THEN '<h1>' || {_H1} || '</h1>' END AS html, CASE WHEN error IS NULL THEN {_TITLE} END AS title, NULL::VARCHAR AS description, url AS source_url,
CASE WHEN error IS NULL THEN 200 ELSE 500 END AS status_code, error FROM (SELECT *, {_FAILED} AS error FROM pages)""")
def scrape_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrape results of the pages' headings where every seventh or so could not be fetched."""
    rows = _pages(spark, sf_dir).selectExpr(_ID, "url", "html", f"{_FAILED} AS error")
    return dom.scrape_record(rows, _ID, selector="h1", error_col="error", spelled=True)


@query(f"""SELECT page_id, '<h1>' || {_H1} || '</h1>' AS heading, '' AS title, CASE WHEN contains(html, '<li>') THEN regexp_extract(html, '(?s)<li>.*?</li>') ELSE '' END AS item, {_no_content('html')} AS whole FROM pages""")
def tier_one_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What selectors find in pages without their heads: a heading, no title, the first item; one that is none leaves the page."""
    pages = _pages(spark, sf_dir)
    out = dom.tier_one(pages, _ID, "article > h1", spelled=True).withColumnRenamed("content", "heading")
    for name, selector in (("title", "title"), ("item", "li"), ("whole", "h1[")):
        out = out.join(dom.tier_one(pages, _ID, selector, spelled=True).withColumnRenamed("content", name), _ID)
    return out


@query(cookie_sql("CASE WHEN event_id % 2 = 0 THEN false ELSE event_id % 5 = 2 END", "AND NOT http_only"))
def script_cookies_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's script sees when each request is made; every second cookie was set by a script and so is never hidden."""
    events = _events(spark, sf_dir).withColumn("now", _since_epoch("SECOND"))
    log = events.where("event_id % 3 <> 0").selectExpr("event_id", f"{_SET} AS header", f"{_ORIGIN} AS origin", "'/' AS at", "now")
    parsed = cookies.parse_set_cookie(log, "header", C("origin"), "at", "now")
    both = cookies.set_by_script(parsed.where("event_id % 2 = 0")).unionByName(parsed.where("event_id % 2 = 1"))
    return cookies.headers_as_of(events.where("event_id % 3 = 0").selectExpr(*_split(_ASK), "now"), both, "event_id", "event_id", "now", script=True).select("event_id", "header")


_KEYS = sorted(policy.KEYS)
_KEY_VALUES = ", ".join(f"({i}, '{k}', '{policy.KEYS[k][0]}', {policy.KEYS[k][1]})" for i, k in enumerate(_KEYS))


@query(f"SELECT event_id, coalesce(code, lower(event_type) || user_id) AS code, coalesce(number, 0) AS key_code FROM events LEFT JOIN (VALUES {_KEY_VALUES}) v(i, k, code, number) ON i = user_id % {len(_KEYS) + 2}")
def key_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by users, in either case; some keys have no number."""
    name = F.element_at(F.array(*map(F.lit, _KEYS)), F.least(C("user_id") % (len(_KEYS) + 2) + 1, F.lit(len(_KEYS))).cast("int"))
    said = F.when(C("user_id") % (len(_KEYS) + 2) >= len(_KEYS), F.concat(F.upper("event_type"), C("user_id").cast("string"))).when(C("event_id") % 2 == 0, F.upper(name)).otherwise(name)
    return _events(spark, sf_dir).select("event_id", policy.key_code(said).alias("k")).select("event_id", "k.*")


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links, split_part(url, '/', 3) AS host FROM pages")
def own_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's function of each page's URL and HTML."""
    return dom.apply_to_pages(_pages(spark, sf_dir), lambda url, html: {"links": html.count("<a href="), "host": url.split("/")[2]}, "links bigint, host string", _ID)


_OWN = "regexp_extract(url, '^[a-z]+://[^/?#]+', 0)"
_SPECIFIER = "CASE length(html) % 6 WHEN 0 THEN concat('/m/', cast(page_id AS VARCHAR(20)), '.js') WHEN 1 THEN './m.js' WHEN 2 THEN '../up.js' WHEN 3 THEN 'react' WHEN 4 THEN concat(url, '&m') ELSE '//cdn.example/x.js' END"


@query(f"""SELECT page_id, CASE length(html) % 6 WHEN 0 THEN o || '/m/' || page_id || '.js' WHEN 1 THEN o || CASE WHEN length(url) % 2 = 0 THEN '/a/b/m.js' ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', '') || 'm.js' END
WHEN 2 THEN o || CASE WHEN length(url) % 2 = 0 THEN '/a/up.js' ELSE regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', '') || 'up.js' END WHEN 4 THEN url || '&m' WHEN 5 THEN regexp_extract(url, '^[a-z]+:') || '//cdn.example/x.js' END AS module FROM (SELECT *, {_OWN.replace(", 0)", ")")} AS o FROM pages)""")
def module_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules asked for by a script in a folder or by the page itself, bare names among them."""
    rows = _pages(spark, sf_dir).selectExpr(_ID, "url", f"{_SPECIFIER} AS m", f"CASE WHEN length(url) % 2 = 0 THEN concat({_OWN}, '/a/b/main.js') ELSE '<inline>' END AS script")
    return rows.select(_ID, dom.resolve_module(C("m"), C("script"), C("url")).alias("module"))


_ENGINES = ", ".join(f"('{n}', '{c}')" for n, (_, cs) in serp.ENGINES.items() for c in cs)
_WANTED = "CASE length(html) % 4 WHEN 0 THEN 'images' WHEN 1 THEN ' news , images' WHEN 2 THEN 'general' ELSE 'music' END"


@query(f"SELECT DISTINCT page_id, name FROM (SELECT page_id, unnest(string_split({_WANTED}, ',')) AS c FROM pages) JOIN (VALUES {_ENGINES}) v(name, category) ON trim(c) = category")
def engine_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engines that each page's search would go to, by its categories."""
    return search.eligible_for(_pages(spark, sf_dir).selectExpr(_ID, f"{_WANTED} AS wanted"), _ID, "wanted", serp.engines_frame(spark)).select(_ID, "name")
