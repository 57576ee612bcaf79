import json

from pyspark.sql import functions as F

from tessella.functions import charset
from tessella.operators import search, serp


def rows(spark, parser, html):
    return [tuple(r[1:]) for r in parser(spark.createDataFrame([(1, html), (2, "<p>nothing</p>"), (3, None)], "id int, html string"), "id").orderBy("pos").collect()]


def test_pages_of_rows(spark):
    page = '<ol id="b_results"><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9leGFtcGxlLmNvbS8">One &amp; only</a></h2><p> said </p></li><li class="b_algo"><p>no link</p></li><li class="b_algo"><h2><a href="https://x.example/">Two</a></h2></li></ol>'
    assert rows(spark, serp.bing, page) == [("bing", 0, 3.0, "One & only", "https://example.com/", "said"), ("bing", 2, 1.0, "Two", "https://x.example/", "")]
    page = '<li class="b_algo"><h2><a href="/x">outside</a></h2></li><ol id="b_results"><li class="b_algo"><a href="/icon">i</a><h2><a href="https://y.example/">Y</a></h2></li></ol>'
    assert rows(spark, serp.bing, page) == [("bing", 0, 1.0, "Y", "https://y.example/", "")]
    rich = '<div class="vrwrap"><p>skipped</p></div><div class="vrwrap"><a href="/i">i</a><h3 class="vr-title"><a href="/link?url=x">T</a></h3><div class="ft">no</div><p> S </p></div>'
    page = rich + '<div class="rb"><h3 class="pt"><a href="/link?url=y">P</a></h3><i data-url="https://real.example/"></i><div class="ft"> f </div></div>'
    assert rows(spark, serp.sogou, page) == [("sogou", 0, 2.0, "P", "https://real.example/", " f "), ("sogou", 1, 1.0, "T", "https://www.sogou.com/link?url=x", "S")]
    block = '<div class="g"><a href="https://www.google.com/own">o</a><a href="/url?q=https://e.com/&amp;sa=U"><h3>G</h3></a><span class="aCOSRe">sn</span></div>'
    assert rows(spark, serp.google, block) == [("google", 0, 1.0, "G", "https://e.com/", "sn")]
    links = '<a data-ved=1 class=c href="https://n.example/"><h3>n</h3></a><a data-ved=2 href="/url?q=https://f.com/a%3Fb&amp;sa=U"><div style=x> D </div><div class=VwiC3b>s</div></a><a data-ved=3 href=/search?q=x><h3>x</h3></a><a data-ved=4 href=https://h.com/><h3>H</h3></a>'
    assert rows(spark, serp.google, links + block) == [("google", 0, 2.0, "D", "https://f.com/a?b", "s"), ("google", 1, 1.0, "H", "https://h.com/", "")]
    page = '<ul><li id="sogou_vr_1"><a href="/icon">i</a><h3><a href="/link?url=z"> W </a></h3><p class="txt-info">i</p></li></ul>'
    assert rows(spark, serp.sogou_wechat, page) == [("sogou_wechat", 0, 1.0, "W", "https://weixin.sogou.com/link?url=z", "i")]


def test_addresses_of_articles_and_searches(spark):
    cases = [
        ("x\n url += 'https://mp.weixin.';\n  url += \"qq.com/s\";\n", "https://mp.weixin.qq.com/s"), ('<meta content="0;url=https://mp.weixin.qq.com/r; x">', "https://mp.weixin.qq.com/r"),
        ("<script>location.href='https://mp.weixin.qq.com/l'</script>", "https://mp.weixin.qq.com/l"), ('http://a.example "http://weixin.qq.com/w<', "http://weixin.qq.com/w"), ("nothing", None), (None, None),
    ]
    frame = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, h string").coalesce(1)
    assert [r[0] for r in frame.orderBy("i").select(serp.wechat_url(F.col("h"))).collect()] == [w for _, w in cases]
    got = spark.range(1).select(*(serp.search_url(e, F.lit("a b*é"), F.lit(2), F.lit("en-GB")).alias(e) for e in serp.ENGINES)).first()
    assert got.google == "https://www.google.com/search?q=a%20b%2A%C3%A9&num=10&start=10&hl=en-US&lr=lang_en&cr=countryEN&ie=utf8&oe=utf8&filter=0"
    assert "first=36&" in got.bing_images and "page=2&" in got.sogou and "pn=10&" in got.baidu


def test_pages_of_json(spark):
    body = '{"feed": {"entry": [{"title": "A &lt;b&gt;", "url": "http:\\/\\/a", "abs": "it\\\'s"}, {"title": "none"}, {"title": "C", "url": "http://c"}]}}'
    assert rows(spark, serp.baidu, body) == [("baidu", 0, 3.0, "A <b>", "http://a", "it's"), ("baidu", 2, 1.0, "C", "http://c", "")]
    image = json.dumps({"murl": "http://i/1.png", "purl": "http://p", "t": "T", "mw": 0, "mh": 5})
    assert rows(spark, serp.bing_images, f"<a class='iusc' m='{image}'>x</a>") == [("bing_images", 0, 1.0, "T", "http://p", "http://i/1.png", None, 5)]
    data = json.dumps({"data": [{"objURL": "x", "thumbURL": "http://t", "fromURL": "http://f", "fromPageTitle": "P", "width": 3, "height": 4}, {}]})
    got = serp.baidu_images(spark.createDataFrame([(1, data)], "id int, html string"), "id").collect()
    assert [(r.image_url, r.url, r.title, r.width) for r in got] == [("http://t", "http://f", "P", "3")]
    state = spark.createDataFrame([(1, "<script id=js-initialData>{\"a\": {\"b\": 7}}</script>")], "id int, html string")
    assert serp.embedded_json(state, "id", "js-initialData", "$.a.b").first().value == "7"


def test_engines_are_chosen_by_category(spark):
    names = lambda *a: {r.name for r in search.eligible(serp.engines_frame(spark), *a).collect()}
    assert names("news") == {"sogou_wechat"}
    assert names("images, news") == {"sogou_wechat", "bing_images", "baidu_images"}
    assert names("general", ["bing"]) == {"bing"}


def test_charsets(spark):
    cases = [
        ("text/html; charset=gbk", b"<meta charset=utf-8>", ("gbk", "header")), (None, b'<html><meta charset="Shift_JIS">', ("shift_jis", "meta")), ("text/html", b"<meta charset=big5>", ("big5", "meta")),
        (None, b'<meta http-equiv="Content-Type" content="text/html; charset=EUC-KR">', ("euc-kr", "meta")), (None, b" " * 1100 + b"<meta charset=gbk>", ("utf-8", "default")), (None, None, ("utf-8", "default")),
        ("text/html; charset=nonsense", b"<meta charset=latin1>", ("windows-1252", "meta")), (None, b"<!-- <meta charset=gbk> -->", ("utf-8", "default")), (None, b"<meta charset=utf-16le>", ("utf-8", "meta")),
    ]
    frame = spark.createDataFrame([(i, h, None if b is None else bytearray(b)) for i, (h, b, _) in enumerate(cases)], "i int, h string, b binary").coalesce(1)
    got = frame.select("i", charset.detect(F.col("h"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [tuple(r.d) for r in got] == [c for _, _, c in cases]
    text = spark.createDataFrame([(bytearray.fromhex("C4E3BAC3"), "gbk"), (bytearray(b"\xef\xbb\xbfx\xff"), "utf-8"), (None, "utf-8")], "b binary, e string")
    assert [r[0] for r in text.select(charset.decode("b", "e")).collect()] == ["你好", "x�", None]
    asked = spark.createDataFrame([("脈", "euc-jp", True), ("㐂", "shift_jis", True), ("一", "big5", True), ("a b", "utf-8", True)], "q string, e string, s boolean")
    assert [r[0] for r in asked.select(charset.encode_query("q", "e", "s")).collect()] == ["%CC%AE", "%26%2313314%3B", "%A4%40", "a%20b"]


def test_texts_are_made_some_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    rows = [(k, None if k % 7 == 0 else f"é{k}".encode("utf-16-le" if k % 3 == 0 else "utf-8"), None if k % 5 == 0 else "utf-16le" if k % 3 == 0 else "utf8", k % 2 == 0) for k in range(300)]
    frame = spark.createDataFrame(rows, "k int, b binary, e string, f boolean").coalesce(1)
    want = {k: None if b is None else charset.decoded(b, e or "utf-8", f) for k, b, e, f in rows}
    got = charset.with_text(frame, F.col("b"), F.col("e"), F.col("f"))
    assert got.columns == ["k", "b", "e", "f", "text"]
    assert {r.k: r.text for r in got.collect()} == want
    assert {r.k: r.t for r in frame.select("k", charset.decode(F.col("b"), F.col("e"), F.col("f")).alias("t")).collect()} == want
    sizes, texts = [], charset._texts
    monkeypatch.setattr(charset, "_texts", lambda columns: sizes.append(len(columns[0])) or texts(columns))
    made = charset._decode.func(pa.array([b for _, b, _, _ in rows]), pa.array([e for _, _, e, _ in rows]), pa.array([f for *_, f in rows]), pa.array([False] * 300))
    assert made.to_pylist() == list(want.values())
    assert max(sizes) == charset.AT_A_TIME
