"""Character sets, parameters, digests, keys and a caller's functions against the standard library and plain rules."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.functions import charset, policy, urls
from tessella.operators import dom, serp


def test_labels():
    assert len(charset.LABELS) > 200 and set(charset.LABELS.values()) >= {"utf-8", "windows-1252", "gbk", "iso-8859-8-i", "utf-16le", "replacement"}
    for label, name in {"l1": "windows-1252", " UTF8\n": "utf-8", "ISO8859-2": "iso-8859-2", "iso885915": "iso-8859-15", "iso_8859-9": "windows-1254", "x-cp1251": "windows-1251", "unicode": "utf-16le", "csISO2022JP": "iso-2022-jp"}.items():
        assert charset.canonical(label) == name
    for label in (None, "", "utf_8", "rot13", "hex", "latin-1", "cp037", "iso8859-16", "idna"):  # Python knows these, the web doesn't
        assert charset.canonical(label) is None
    assert all(charset.decoded(b"a", label) == ("�" if name == "replacement" else "a") or name.startswith("utf-16") for label, name in charset.LABELS.items())


@pytest.mark.parametrize(("body", "label", "fatal", "ignore", "want"), [
    (b"\xef\xbb\xbfa", "latin1", False, False, "a"), (b"\xff\xfea\x00", "utf-8", True, False, "a"), (b"\xfe\xff\x00a", "utf-8", False, False, "a"), (b"\xef\xbb\xbfa", "utf-8", False, True, "﻿a"),
    (b"\xff", "utf-8", False, False, "�"), (b"a\xff", "utf-8", True, False, None), (b"\x80\x81", "ascii", True, False, "€\x81"), (b"\xaa\x81", "windows-1253", False, False, "�\x81"), (b"\xaa", "windows-1253", True, False, None),
    (b"a\xff", "x-user-defined", True, False, "a"), (b"abc", "iso-2022-kr", False, False, "�"), (b"abc", "iso-2022-kr", True, False, None), (b"", "hz-gb-2312", True, False, ""), (b"\x81\x30\x81\x30", "gb2312", True, False, "\x80"),
    (b"a", "nonsense", False, False, None),
])
def test_decoded(body, label, fatal, ignore, want):
    assert charset.decoded(body, label, fatal, ignore) == want


def test_bodies_that_are_no_html(spark):
    body = F.lit(b"<meta charset=gbk>")
    rows = spark.range(1).select(charset.detect(F.lit("text/css"), body, html=False).alias("a"), charset.detect(F.lit("text/css"), body).alias("b"), charset.detect(F.lit("text/css; charset=koi8"), body, html=False).alias("c")).collect()[0]
    assert [tuple(x) for x in rows] == [("utf-8", "default"), ("gbk", "meta"), ("koi8-r", "header")]


def test_params(spark):
    rng = random.Random(4)
    cases = [[(rng.choice("aäb&= +%"), "".join(rng.choices("xé&=+% ?#/*-._~", k=rng.randint(0, 6)))) for _ in range(rng.randint(0, 6))] for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(cases)), "id long, p array<struct<key:string,value:string>>")
    out = rows.withColumn("q", urls.form_encoded(F.col("p"))).select("id", "q", urls.query_pairs(F.col("q")).alias("back"), urls.params_sort(F.col("p")).alias("s"), urls.params_set(F.col("p"), "a", F.lit("new")).alias("t")).collect()
    for r in out:
        p = cases[r.id]
        assert [tuple(x) for x in r.back] == p and all(c.isascii() and c not in " #\"<>" for c in r.q)
        assert [tuple(x) for x in r.s] == sorted(p, key=lambda x: x[0])
        first = next((i for i, x in enumerate(p) if x[0] == "a"), None)
        want = [*p, ("a", "new")] if first is None else [("a", "new") if i == first else x for i, x in enumerate(p) if x[0] != "a" or i == first]
        assert [tuple(x) for x in r.t] == want
    odd = spark.range(1).select(urls.query_pairs(F.lit("?a=%zz%41&%C3%A9=1+2&&x&=y&a==")).alias("p")).collect()[0].p
    assert [tuple(x) for x in odd] == [("a", "%zzA"), ("é", "1 2"), ("x", ""), ("", "y"), ("a", "=")]


def test_digests(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = entry.queries()["web_digests"](spark, sf).collect()
    lib = {"SHA-1": "sha1", "SHA-256": "sha256", "SHA-384": "sha384", "SHA-512": "sha512", "SHA-512/224": "sha512_224", "SHA-512/256": "sha512_256"}
    for r in rows:
        name = lib.get(r.algorithm.upper())
        assert r.digest == (hashlib.new(name, pages[r.page_id].encode()).hexdigest() if name else "")
    assert len({r.algorithm for r in rows}) == 7 and len(rows) == len(pages)


def test_keys(spark):
    rows = spark.createDataFrame([("ENTER",), ("esc",), ("Q",), ("",), (None,)], "k string").select(policy.key_code(F.col("k")).alias("c")).collect()
    assert [None if r.c is None else tuple(r.c) for r in rows] == [("Enter", 13), ("Escape", 27), ("q", 0), ("", 0), None]


@pytest.mark.parametrize(("page", "want"), [
    ("url += 'https://mp.weixin.qq.com/a\"b';\n  url += \"c'd\";", "https://mp.weixin.qq.com/a\"bc'd"), ("url= 'https://mp.weixin.qq.com/x'", "https://mp.weixin.qq.com/x"), ("url = 'https://mp.weixin.qq.com/x'", "https://mp.weixin.qq.com/x"),
    ("url+='weixin.qq';\nurl+='/y'", None), ("url +='http://weixin.qq/'\nurl += 'open", "http://weixin.qq/"), ("nothing", None),
])
def test_wechat_pieces(spark, page, want):
    assert spark.createDataFrame([(page,)], "h string").select(serp.wechat_url(F.col("h")).alias("u")).collect()[0].u == want


def test_tier_one_and_own_functions(spark):
    pages = spark.createDataFrame([(1, "u", "<head><title>t</title></head><p>a<p>b"), (2, None, None)], "id long, url string, html string")
    got = lambda s: {r.id: r.content for r in dom.tier_one(pages, "id", s).collect()}
    assert got("p") == {1: "<p>a</p>", 2: ""} and got("title") == {1: "", 2: ""} and got("p[") == {1: "<p>a<p>b", 2: None}
    made = dom.apply_to_pages(pages, lambda url, html: None if html is None else {"n": len(html), "tags": ["a"]}, "n int, tags array<string>, other string", "id")
    assert sorted(tuple(r) for r in made.collect()) == [(1, 37, ["a"], None), (2, None, None, None)]
    failed = spark.createDataFrame([(1, "u", "<p>x", None), (2, "v", None, "no route")], "id long, url string, html string, why string")
    rows = {r.id: (r.success, r.markdown, r.status_code, r.error, r.source_url) for r in dom.scrape_record(failed, "id", selector="p", error_col="why").collect()}
    assert rows == {1: (True, "x", 200, None, "u"), 2: (False, None, 500, "no route", "v")}


def test_selectors_of_any_namespace():
    from tessella.functions.selectors import Page, Selector

    page = Page("<div lang=en-GB x=1><svg><path d=1></path></svg></div>")
    tags = lambda s: [page.tag[i] for i in page.find(Selector(s))]
    assert tags("*|div") == ["div"] and tags("svg *|path, *|b") == ["path"] and tags("[*|x], [|d]") == ["div", "path"] and tags("[lang|=en]") == ["div"] and len(tags("*|*")) == len(tags("*"))
    with pytest.raises(ValueError):
        Selector("svg|path")
