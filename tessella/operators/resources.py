"""What a page refers to: base, images, style sheets, scripts, links; and pages that arrive in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.policy import subresource_allowed
from tessella.functions.urls import scheme
from tessella.operators import dom

# Script types that run.
RUNS = ("", "text/javascript", "application/javascript", "module")


def join_chunks(chunks: DataFrame, doc: str, seq: str, chunk: str) -> DataFrame:
    """(doc, html): the pieces of each document in order, as one text for the parser."""
    parts = F.array_sort(F.collect_list(F.struct(seq, chunk)))
    return chunks.groupBy(doc).agg(F.array_join(F.transform(parts, lambda x: x[chunk]), "").alias("html"))


def _read(pages: DataFrame, doc: str, url: str, html: str, asks: dict) -> DataFrame:
    """Answers beside base_url: the first base element's href against the page's URL, else that URL; one pass over the pages."""
    read = dom.project(pages, doc, html, {"__base": ("attr", "base[href]", "href"), **asks}, [url])
    base = F.when(F.col("__base").isNull(), F.col(url)).otherwise(dom.resolve(F.col("__base"), F.col(url)))
    return read.withColumn("base_url", base)


def base_urls(pages: DataFrame, doc: str, url: str = "url", html: str = "html") -> DataFrame:
    """(doc, base_url)."""
    return _read(pages, doc, url, html, {}).select(doc, "base_url")


def sub_resources(pages: DataFrame, doc: str, url: str = "url", html: str = "html", most: int = 32) -> DataFrame:
    """(doc, rank, resource_url): images, then style sheets, over http, each once, the first `most` of a page; only addresses are shuffled."""
    read = _read(pages, doc, url, html, {"__img": ("attrs", "img[src]", "src"), "__css": ("attrs", "link[rel~=stylesheet][href]", "href")})
    rows = read.select(doc, "base_url", F.posexplode(F.concat("__img", "__css")).alias("at", "href"))
    rows = rows.withColumn("resource_url", dom.resolve(F.col("href"), F.col("base_url"))).where(scheme(F.col("resource_url")) != "")
    once = rows.groupBy(doc, "resource_url").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("at"))
    return once.select(doc, rank.alias("rank"), "resource_url").where(F.col("rank") <= most)


def stylesheets(pages: DataFrame, doc: str, url: str = "url", html: str = "html") -> DataFrame:
    """(doc, at, resource_url) of links whose rel is stylesheet and that the page may load."""
    kind = lambda c: F.lower(F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    read = _read(pages, doc, url, html, {"__css": ("attrs", "link[rel=stylesheet i][href]", "href")})
    rows = read.select(doc, "base_url", F.posexplode("__css").alias("at", "href")).withColumn("resource_url", dom.resolve(F.col("href"), F.col("base_url")))
    return rows.where(subresource_allowed(kind(F.col("resource_url")), kind(F.col("base_url")))).select(doc, "at", "resource_url")


def scripts(pages: DataFrame, doc: str, html: str = "html") -> DataFrame:
    """(doc, node_id, src, body, phase) of scripts that run: regular, then deferred, async and module ones."""
    found = dom.select(pages, doc, html, "script")
    kind = F.lower(F.trim(F.coalesce(dom.attribute("type"), F.lit(""))))
    phase = F.when(kind == "module", 3).when(dom.attr_is("src") & dom.attr_is("async"), 2).when(dom.attr_is("src") & dom.attr_is("defer"), 1).otherwise(0)
    out = found.where(kind.isin(*RUNS)).select(doc, "node_id", dom.attribute("src").alias("src"), F.col("text").alias("body"), phase.alias("phase"))
    return out.where(F.col("src").isNotNull() | (F.trim("body") != ""))


def links(nodes: DataFrame) -> DataFrame:
    return nodes.where((dom.element("a") | dom.element("area")) & dom.attr_is("href"))


def network_log(pages: DataFrame, doc: str, redirects: str, url: str) -> DataFrame:
    """(doc, step, hop_url): a capture's redirect chain as rows, the final URL last."""
    chain = F.concat(F.coalesce(F.col(redirects), F.array().cast("array<string>")), F.array(F.col(url)))
    return pages.select(doc, F.posexplode(chain).alias("step", "hop_url"))
