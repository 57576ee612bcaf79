"""Result pages as rows: what each engine's page says of a result, found in one pass over the page.

A parser takes (id, html) and gives id, engine, pos, score, title, url, snippet. It is a function of a DataFrame, so
a new engine is a new entry in ENGINES.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import html_unescape, strip
from tessella.functions.urls import unwrap_bing, unwrap_google
from tessella.operators import dom
from tessella.sources.captures import result_json


def _results(read: DataFrame, doc: str, engine: str, rows: Column, by_place: bool = False) -> DataFrame:
    """Results of an array of (pos, title, url, snippet); scores count down from the number of results, or with by_place of all rows."""
    out = read.select(doc, F.size("rows").alias("all"), F.filter(rows, lambda r: (r["title"] != "") & (r["url"] != "")).alias("good"))
    out = out.select(doc, "all", F.size("good").alias("n"), F.posexplode("good").alias("at", "r"))
    pos, n = (F.col("r.pos"), F.col("all")) if by_place else (F.col("at"), F.col("n"))
    return out.select(doc, F.lit(engine).alias("engine"), pos.alias("pos"), (n - pos).cast("double").alias("score"), "r.title", "r.url", "r.snippet")


def _row(r: Column, title: Column, url: Column, snippet: Column) -> Column:
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(r["pos"].alias("pos"), none(title).alias("title"), none(url).alias("url"), none(snippet).alias("snippet"))


def bing(pages: DataFrame, doc: str) -> DataFrame:
    fields = {"title": [("text", "h2 a")], "href": [("attr", "h2 a", "href")], "snippet": [("text", "p")]}
    read = dom.records(pages, doc, "html", [("ol#b_results li.b_algo", fields)])
    return _results(read, doc, "bing", F.transform("rows", lambda r: _row(r, r["title"], unwrap_bing(r["href"]), strip(r["snippet"]))), by_place=True)


# Where a result page's snippets stand.
GOOGLE_SNIPPETS = ("div.VwiC3b", "span.aCOSRe", "div.IsZvec", "div[data-sncf]")
SOGOU_SNIPPETS = ("div.attribute-centent", "div.fz-mid.space-txt", "div.str-text-info", "p")
WECHAT_SNIPPETS = ("p.txt-info", 'p[class^="txt-info"]', "div.txt-box p")


def google(pages: DataFrame, doc: str) -> DataFrame:
    """Links with data-ved and no class that hold a styled title or an h3; div.g blocks only where a page has no such link."""
    snippet = [("text", s) for s in GOOGLE_SNIPPETS]
    links = ("a[data-ved]:not([class])", {"title": [("text", "div[style]"), ("text", "h3")], "hrefs": [("attrs", "", "href")], "snippet": snippet})
    blocks = ("div.g", {"title": [("text", "h3")], "hrefs": [("attrs", "a[href]", "href")], "snippet": snippet})
    read = dom.records(pages, doc, "html", [links, blocks])
    url = lambda h: F.when(F.startswith(h, F.lit("/url?q=")), unwrap_google(h)).when(F.startswith(h, F.lit("http")), h)
    own = lambda u: u.isNull() | F.startswith(u, F.lit("https://www.google.com/")) | F.startswith(u, F.lit("/search?"))
    first = lambda r: F.try_element_at(F.filter(F.transform(r["hrefs"], url), lambda u: ~own(u) & (u != "")), F.lit(1))
    made = lambda kind: F.filter(F.transform(F.filter("rows", lambda r: r["kind"] == kind), lambda r: _row(r, strip(r["title"]), first(r), strip(r["snippet"]))), lambda r: (r["title"] != "") & (r["url"] != ""))
    return _results(read, doc, "google", F.when(F.size(made(0)) > 0, made(0)).otherwise(made(1)))


def sogou(pages: DataFrame, doc: str) -> DataFrame:
    """All plain results, then all rich ones; a redirect is replaced by the address that the result holds, if it does."""
    real = [("attr", "", "data-url"), ("attr", "[data-url]", "data-url")]
    plain = ("div.rb", {"title": [("text", "h3.pt a")], "href": [("attr", "h3.pt a", "href")], "real": real, "snippet": [("text", "div.ft")]})
    rich = ("div.vrwrap", {"title": [("text", "h3.vr-title a")], "href": [("attr", "h3.vr-title a", "href")], "real": real, "snippet": [("text", s) for s in SOGOU_SNIPPETS]})
    read = dom.records(pages, doc, "html", [plain, rich])
    whole = lambda r: F.when(~F.startswith(r["href"], F.lit("/link?url=")), r["href"]).when(F.startswith(r["real"], F.lit("http")), r["real"]).otherwise(F.concat(F.lit("https://www.sogou.com"), r["href"]))
    return _results(read, doc, "sogou", F.transform("rows", lambda r: _row(r, r["title"], whole(r), F.when(r["kind"] == 1, strip(r["snippet"])).otherwise(r["snippet"]))))


def sogou_wechat(pages: DataFrame, doc: str) -> DataFrame:
    fields = {"title": [("text", "h3 a")], "href": [("attr", "h3 a", "href")], "snippet": [("text", s) for s in WECHAT_SNIPPETS]}
    read = dom.records(pages, doc, "html", [('li[id^="sogou_vr_"]', fields)])
    whole = lambda h: F.when(F.startswith(h, F.lit("/link?url=")), F.concat(F.lit("https://weixin.sogou.com"), h)).otherwise(h)
    return _results(read, doc, "sogou_wechat", F.transform("rows", lambda r: _row(r, strip(r["title"]), whole(r["href"]), strip(r["snippet"]))), by_place=True)


def wechat_url(html: Column) -> Column:
    """The article address in a redirect page: script pieces joined, a refresh, a location, or any that is written out; else null."""
    quoted = F.regexp_extract_all(html, F.lit(r"(?m)^[^\S\n]*url(?: \+=|=)[^\S\n]*('[^'\n]*'|\"[^\"\n]*\")"), F.lit(1))
    pieces = F.array_join(F.transform(quoted, lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2)), "")
    refresh = F.regexp_extract(html, r"url=([^\"'; ]*)", 1)
    location = F.regexp_extract(html, r"location(?:\.href)?=[\"']([^\"']*mp\.weixin\.qq\.com[^\"']*)", 1)
    written = F.regexp_extract(html, r"(http(?:(?!http)[^\"'<\s\\])*weixin\.qq[^\"'<\s\\]*)", 1)
    is_article = lambda c: F.contains(c, F.lit("mp.weixin.qq.com"))
    return F.when(F.contains(pieces, F.lit("weixin.qq")), pieces).when(is_article(refresh), refresh).when(is_article(location), location).otherwise(F.nullif(written, F.lit("")))


def baidu(pages: DataFrame, doc: str) -> DataFrame:
    """Results in JSON: feed.entry with title, url and abs; two escapes that JSON lacks are mended first."""
    mended = pages.withColumn("html", F.replace(F.replace("html", F.lit("\\/"), F.lit("/")), F.lit("\\'"), F.lit("'")))
    out = result_json(mended.select(doc, "html"), "html", "feed.entry", {"title": "title", "url": "url", "snippet": "abs"}, "baidu")
    return out.where("url <> ''").withColumn("title", html_unescape(F.col("title"))).withColumn("snippet", html_unescape(F.coalesce("snippet", F.lit(""))))


def bing_images(pages: DataFrame, doc: str) -> DataFrame:
    """Images in the JSON of a.iusc[m]; sizes of 0 are null."""
    read = dom.project(pages, doc, "html", {"__m": ("attrs", "a.iusc[m]", "m")})
    rows = read.select(doc, F.size("__m").alias("n"), F.posexplode("__m").alias("pos", "m"))
    at = lambda key: F.get_json_object("m", f"$.{key}")
    size = lambda key: F.nullif(at(key).try_cast("int"), F.lit(0))
    return rows.select(doc, F.lit("bing_images").alias("engine"), "pos", (F.col("n") - F.col("pos")).cast("double").alias("score"), at("t").alias("title"), at("purl").alias("url"), at("murl").alias("image_url"), size("mw").alias("width"), size("mh").alias("height")).where("image_url <> ''")


def baidu_images(pages: DataFrame, doc: str) -> DataFrame:
    """Images of data[]: the first of four fields that holds an http URL."""
    names = ("objURL", "middleURL", "thumbURL", "hoverURL")
    out = result_json(pages.select(doc, "html"), "html", "data", {**{n: n for n in names}, "url": "fromURL", "title": "fromPageTitle", "coded": "fromPageTitleEnc", "width": "width", "height": "height"}, "baidu_images")
    image = F.coalesce(*(F.when(F.startswith(F.col(n), F.lit("http")), F.col(n)) for n in names))
    out = out.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "coded"))
    return out.withColumn("image_url", image).where("image_url IS NOT NULL").drop(*names, "coded")


ENGINES: dict[str, tuple[Callable[[DataFrame, str], DataFrame], tuple[str, ...]]] = {
    "bing": (bing, ("general",)), "baidu": (baidu, ("general",)), "google": (google, ("general",)), "sogou": (sogou, ("general",)), "sogou_wechat": (sogou_wechat, ("general", "news")),
    "bing_images": (bing_images, ("images",)), "baidu_images": (baidu_images, ("images",)),
}


def engines_frame(spark) -> DataFrame:
    """(name, categories) of the engines, for search.eligible()."""
    return spark.createDataFrame([(k, list(c)) for k, (_, c) in ENGINES.items()], "name string, categories array<string>")


def embedded_json(pages: DataFrame, doc: str, element_id: str, path: str) -> DataFrame:
    """(doc, value) at a JSON path of the script element with an id."""
    read = dom.project(pages, doc, "html", {"__json": ("text", f"script#{element_id}")})
    return read.where("__json IS NOT NULL").select(doc, F.get_json_object("__json", path).alias("value"))


# The engines' addresses. {query} is the escaped query, {page} counts from 1, {ten} and {first} are results before
# it in tens and the first result of 35, {language} is a tag, {short} its first part, {upper} that in capitals.
TEMPLATES = {
    "baidu": "https://www.baidu.com/s?wd={query}&tn=json&rn=10&pn={ten}&ie=utf-8",
    "baidu_images": "https://image.baidu.com/search/acjson?tn=resultjson_com&ipn=rj&fp=result&queryWord={query}&cl=2&lm=-1&ie=utf-8&oe=utf-8&word={query}&pn={ten}&rn=10&st=-1&face=0&istype=2&nc=1",
    "bing": "https://cn.bing.com/search?q={query}&count=10&offset={ten}&setlang={language}",
    "bing_images": "https://cn.bing.com/images/async?q={query}&first={first}&count=35&mmre=1&setlang={language}",
    "google": "https://www.google.com/search?q={query}&num=10&start={ten}&hl={short}-US&lr=lang_{short}&cr=country{upper}&ie=utf8&oe=utf8&filter=0",
    "sogou": "https://www.sogou.com/web?query={query}&page={page}&ie=utf8",
    "sogou_wechat": "https://weixin.sogou.com/weixin?type=2&query={query}&page={page}&ie=utf8",
}


def search_url(engine: str, query: Column, page: Column, language: Column) -> Column:
    """The address of an engine's result page."""
    escaped = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    before = F.greatest(page - 1, F.lit(0))
    short = F.substring_index(language, "-", 1)
    values = {"query": escaped(query), "page": page, "ten": before * 10, "first": before * 35 + 1, "language": escaped(language), "short": short, "upper": F.upper(short)}
    parts = re.split(r"\{(\w+)\}", TEMPLATES[engine])
    return F.concat(*(values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts) if x))
