from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessella.functions import classify, policy, text, urls
from tessella.operators import cookies, robots, search, state
from tessella.sources import captures
from tessella.streaming import state as streams


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return frame.select(column).first()[0]


@pytest.mark.parametrize(("url", "want"), [
    ("https://WWW.Example.com/path", "https://example.com/path"), ("https://example.com:8080/p", "https://example.com:8080/p"), ("https://example.com/path/", "https://example.com/path"),
    ("https://example.com/", "https://example.com/"), ("https://example.com", "https://example.com/"), ("https://example.com/a?utm_source=x&q=hello&utm_medium=y", "https://example.com/a?q=hello"),
    ("NOT A URL", "not a url"), ("https://u:p@example.com:443/a?b=2&a=1&a=0#f", "https://example.com/a?a=1&a=0&b=2"), ("http://example.com:80/A//?q=a+b", "http://example.com/a?q=a%20b"), (None, None),
])
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url(F.col("u").cast("string")), u=url) == want


@pytest.mark.parametrize(("html", "want"), [
    ('<html><body><div id="app"></div></body></html>', False), ("<p>" + "word " * 30 + "</p>", True), ("<p>ok</p>", False), ('<div id="root"></div>' + "x" * 250, True),
    ("<noscript>Please ENABLE JavaScript</noscript>" + "word " * 100, False), ("你好" * 12, True), ("你好" * 10, False),
])
def test_content_sufficient(spark, html, want):
    assert one(spark, classify.content_sufficient(F.col("h")), h=html) is want


def test_text(spark):
    assert one(spark, text.visible_text(F.col("h")), h="<head><title>x</title></head><header>gone</header><p>a 　b</p><STYLE>s</STYLE>c > d <unclosed") == "a bc d"
    assert one(spark, text.page_title(F.col("h")), h="<TITLE lang=x>  Hi &amp; ho </Title>") == "Hi &amp; ho"
    assert one(spark, text.page_title(F.col("h")), h="<title> </title>") is None
    assert one(spark, text.html_unescape(F.col("h")), h="&amp;lt; &quot;x&quot; &#39;") == "< \"x\" '"
    assert one(spark, text.collapse_lines(F.col("h")), h=" a \r\n\n\t\n b　") == "a\nb"


def test_redirects_and_referrers(spark):
    assert one(spark, urls.unwrap_bing(F.col("u")), u="https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9leGFtcGxlLmNvbS8&ntb=1") == "https://example.com/"
    assert one(spark, urls.unwrap_bing(F.col("u")), u="https://www.bing.com/ck/a?u=a1!!") == "https://www.bing.com/ck/a?u=a1!!"
    assert one(spark, urls.unwrap_google(F.col("u")), u="/url?q=https://e.com/a%2Bb+c&sa=U") == "https://e.com/a+b+c"
    for source, target, want in (("https://a.example/x#f", "http://a.example/", ""), ("https://a.example/x#f", "https://a.example/y", "https://a.example/x"), ("https://a.example/x", "https://b.example/", "https://a.example/")):
        assert one(spark, urls.referrer(F.col("s"), F.col("t")), s=source, t=target) == want


def test_robots(spark):
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /admin\nAllow: /admin/public"), ("b", "User-agent: Tess\nDisallow: /\n\nUser-agent: *\nDisallow: /x$"), ("c", None), ("d", "User-agent: z\nDisallow: /")], "domain string, body string")
    rules = robots.parse_robots(files, "tessella")
    asked = spark.createDataFrame([("a", "/admin/x"), ("a", "/admin/public/1"), ("b", "/y"), ("c", "/"), ("d", "/q"), ("unknown", "/")], "domain string, path string")
    assert {(r.domain, r.path): r.is_allowed for r in robots.check_robots(asked, rules).collect()} == {("a", "/admin/x"): False, ("a", "/admin/public/1"): True, ("b", "/y"): False, ("c", "/"): True, ("d", "/q"): True, ("unknown", "/"): True}


def test_policies(spark):
    for url, pattern, want in (("http://x/ads/1", "*ads*", True), ("http://x/a.js", "*.js", True), ("http://x/", "http://x*", True), ("http://x/ads", "ads", True), ("http://x", "*", True), ("http://x", "y", False)):
        assert one(spark, policy.pattern_blocks(F.col("u"), F.col("p")), u=url, p=pattern) is want
    for url, want in (("http://127.0.0.1/", True), ("http://8.8.8.8/", False), ("http://localhost:80/", True), ("ftp://x/", True), ("https://example.com", False), ("http://192.168.1.1/", True), ("file:///x", False)):
        assert one(spark, policy.url_forbidden(F.col("u")), u=url) is want
    assert one(spark, policy.cors_allows(F.lit(True), F.lit("https://a"), F.lit("*"), F.lit("true"))) is False
    version, platform = policy.client_hints(F.lit("Mozilla/5.0 (iPhone; CPU iPhone OS like Mac OS X) Chrome/131.0.1"))
    assert (one(spark, version), one(spark, platform)) == ("131", "macOS")


def test_more_policies(spark):
    rows = spark.createDataFrame([("::1",), ("::",), ("fe80::1",), ("fd00::2",), ("::ffff:10.0.0.1",), ("2606:4700::1111",), ("x",)], "a string").coalesce(1)
    assert [r[0] for r in rows.select(policy.forbidden_ipv6("a")).collect()] == [True, True, True, True, True, False, None]
    assert one(spark, policy.redirected_method(F.col("s"), F.lit("POST")), s=303) == "GET"
    assert one(spark, policy.redirected_method(F.col("s"), F.lit("POST")), s=307) == "POST"
    assert one(spark, policy.cross_scheme_to_file(F.lit("https://x"), F.col("t")), t="FILE:///etc") is True
    assert one(spark, policy.redirects_blocked(F.array(F.lit("https://x/"), F.col("u"))), u="https://y/antispider") is True
    assert one(spark, policy.cache_key(F.lit(None), F.col("a")), a="") != one(spark, policy.cache_key(F.lit(""), F.col("a").cast("int")), a=None)


def test_merge_sums_scores_and_takes_the_longest_title(spark):
    raw = spark.createDataFrame([(1, 0, "bing", "Foo", "https://example.com/a", "s", 5.0), (1, 1, "baidu", "Foo Bar", "https://www.example.com/a/", "s", 3.0), (1, 2, "baidu", "", "https://x.example/", "", 1.0)], "q int, seq long, engine string, title string, url string, snippet string, score double")
    rows = search.merge_results(raw, ["q"]).orderBy("rank").collect()
    assert [(r.title, r.url, r.score, r.engines) for r in rows] == [("Foo Bar", "https://www.example.com/a/", 8.0, ["bing", "baidu"]), ("", "", 1.0, ["baidu"])]


def test_cookies(spark):
    log = [
        (1, "sid=1; Path=/; HttpOnly", "app.example.com", "/x/y"), (2, "sid=2; Path=/", "app.example.com", "/"), (3, "t=1; Domain=example.com; Secure", "app.example.com", "/login/form"),
        (4, "u=1; Domain=victim.example", "attacker.example", "/"), (5, "gone=1", "app.example.com", "/"), (6, "gone=; Max-Age=0", "app.example.com", "/"), (7, "novalue", "app.example.com", "/"),
        (8, "old=1; Expires=Wed, 21-Oct-2015 07:28:00 GMT", "app.example.com", "/"), (9, "p=1; Path=/admin", "app.example.com", "/"),
    ]
    rows = spark.createDataFrame(log, "seq long, header string, host string, path_of string").withColumn("now", F.lit(1_700_000_000).cast("long"))
    jar = cookies.jar_state(cookies.parse_set_cookie(rows, "header", F.col("host"), "path_of", "now"), "seq", "now")
    assert {(r.domain, r.name, r.path, r.value, r.host_only) for r in jar.collect()} == {("app.example.com", "sid", "/", "2", True), ("example.com", "t", "/login", "1", False), ("attacker.example", "u", "/", "1", True), ("app.example.com", "p", "/admin", "1", True)}
    asked = spark.createDataFrame([(1, "https", "App.Example.com", "/login/x"), (2, "http", "app.example.com", "/login"), (3, "https", "sub.app.example.com", "/login"), (4, "http", "app.example.com", "/administrator"), (5, "http", "app.example.com", "/admin/x")], "id int, scheme string, host string, path string")
    got = {r.id: r.header for r in cookies.cookie_headers(asked, jar, "id", F.lit(0)).collect()}
    assert got == {1: "sid=2; t=1", 2: "sid=2", 3: "t=1", 4: "sid=2", 5: "p=1; sid=2"}


def test_back_off_and_cache(spark):
    seconds = [0, 10, 300, 500, 1100, 5000, 5400]
    rows = spark.createDataFrame([("e", t, t != 1100) for t in seconds], "k string, s long, bad boolean")
    got = state.suspensions(rows, "k", "s", "bad", ["s"]).orderBy("s").collect()
    assert [r.outcome for r in got] == ["captcha", "suspended", "captcha", "suspended", "ok", "captcha", "captcha"]
    assert [state.backoff(n, 300) for n in range(6)] == [300, 300, 600, 1800, 3600, 3600]
    hits = state.cache_hits(spark.createDataFrame([("a", t) for t in (0, 599, 600, 1199, 1300)] + [("b", 5)], "k string, s long"), "k", "s", ["s"]).collect()
    assert sorted((r.k, r.s, r.hit) for r in hits) == [("a", 0, False), ("a", 599, True), ("a", 600, False), ("a", 1199, True), ("a", 1300, False), ("b", 5, False)]


def test_sources(spark, tmp_path):
    kind, body = captures.data_uri(F.col("u"))
    rows = spark.createDataFrame([("data:text/html;base64,PGI+ aGk=",), ("data:,a%20b+c",), ("http://x",)], "u string").select(kind, body.cast("string")).collect()
    assert [tuple(r) for r in rows] == [("text/html", "<b>hi"), ("text/plain", "a b+c"), (None, None)]
    (tmp_path / "x.HTML").write_text("hi")
    assert captures.read_files(spark, str(tmp_path)).first()["content_type"] == "text/html"
    jar = spark.createDataFrame([("d", "n", "/", "v", True, False, False, None, "Lax"), ("d", "o", "/", "v", True, False, False, 5, "Lax")], "domain string, name string, path string, value string, host_only boolean, secure boolean, http_only boolean, expires bigint, same_site string")
    captures.write_cookies(jar, f"{tmp_path}/jar", F.lit(10))
    assert [r.name for r in captures.read_cookies(spark, f"{tmp_path}/jar").collect()] == ["n"]


def test_streams_match_batch(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(u, base + timedelta(seconds=s), s, s % 3 == 0) for u in ("a", "b") for s in (0, 100, 579, 1100, 1500, 9000)]
    spark.createDataFrame(rows, "k string, ts timestamp, s long, bad boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")

    def rows_of(frame, name, mode="append"):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    closed = {(r.k, r.started) for r in rows_of(streams.session_stream(stream(), "k", "ts"), "sessions")}
    every = {(r.k, r.started) for r in state.sessions(batch, "k", "ts").collect()}
    assert closed <= every and len(every - closed) == 2
    got = {(r.k, r.s, r.outcome, r.captcha_count) for r in rows_of(streams.suspension_stream(stream(), "k", "s", "bad"), "suspended")}
    assert got == {(r.k, r.s, r.outcome, r.captcha_count) for r in state.suspensions(batch, "k", "s", "bad", ["s"]).collect()}
    assert len(rows_of(streams.first_within(stream(), ["k"], "ts"), "firsts")) == 2


def test_urls_come_apart_and_together(spark):
    from tessella.functions import urls

    rows = spark.createDataFrame([("HTTP://U:s@Ex.com:8080/a/b?q=1#f",), ("https://ex.com:443",), ("ftp://x",), ("https://[::1]:81/x",)], "u string").coalesce(1)
    got = [r.c for r in rows.select(urls.components(F.col("u")).alias("c")).collect()]
    assert tuple(got[0]) == ("http://U:s@ex.com:8080/a/b?q=1#f", "http:", "U", "s", "ex.com:8080", "ex.com", "8080", "/a/b", "?q=1", "#f", "http://ex.com:8080")
    assert tuple(got[1]) == ("https://ex.com/", "https:", "", "", "ex.com", "ex.com", "", "/", "", "", "https://ex.com")
    assert got[2] is None and (got[3].hostname, got[3].port) == ("[::1]", "81")
    put = lambda url, name, value: spark.range(1).select(urls.with_component(F.lit(url), name, F.lit(value))).first()[0]
    url = "http://u@ex.com:8080/a?q=1#f"
    want = {("protocol", "https"): "https://u@ex.com:8080/a?q=1#f", ("port", "80"): "http://u@ex.com/a?q=1#f", ("port", ""): "http://u@ex.com/a?q=1#f", ("hash", ""): "http://u@ex.com:8080/a?q=1", ("search", "?z"): "http://u@ex.com:8080/a?z#f",
            ("pathname", "n"): "http://u@ex.com:8080/n?q=1#f", ("hostname", "y.z"): "http://u@y.z:8080/a?q=1#f", ("host", "y:9"): "http://u@y:9/a?q=1#f", ("username", ""): "http://ex.com:8080/a?q=1#f", ("href", "https://new/"): "https://new/", ("href", "no"): url, ("protocol", "ftp"): url}
    assert {k: put(url, *k) for k in want} == want


def test_local_addresses_in_urls(spark):
    urls_ = ["http://[::1]/", "http://[fe80::1]/", "http://[::ffff:7f00:1]/", "http://[::ffff:192.0.2.1]:8/", "http://[2001:db8::1]/", "http://[::]/", "http://[0:0:0:0:0:0:0:1]/", "http://[fd00::2]/x", "http://[::ffff:8.8.8.8]/", "http://10.0.0.1/", "http://ex.com/"]
    rows = spark.createDataFrame([(u,) for u in urls_], "u string").coalesce(1)
    assert [r[0] for r in rows.select(policy.url_forbidden(F.col("u"))).collect()] == [True, True, True, True, False, True, True, True, False, True, False]


def test_jar_operations(spark):
    log = spark.createDataFrame([(1, "a=1; HttpOnly", "ex.com", "/", 100), (2, "b=2; Domain=ex.com; Path=/p", "www.ex.com", "/", 100)], "seq long, h string, host string, path string, now long")
    parsed = cookies.set_by_script(cookies.parse_set_cookie(log, "h", F.col("host"), "path", "now"))
    jar = cookies.jar_state(parsed, "seq", "now")
    assert {(r.name, r.http_only) for r in jar.collect()} == {("a", False), ("b", False)}
    loaded = spark.createDataFrame([(1, "ex.com", "a", "9", "/", True, True, "", 0), (2, "ex.com", "c", "3", "/", False, False, "None", 50)], "seq long, domain string, name string, value string, path string, secure boolean, http_only boolean, same_site string, expires long")
    after = cookies.bulk_load(jar, loaded, "seq")
    assert {(r.name, r.value, r.same_site, r.expires, r.host_only) for r in after.collect()} == {("a", "9", "Lax", None, False), ("b", "2", "Lax", None, False), ("c", "3", "None", 50, False)}
    names = lambda d: {r.name for r in d.collect()}
    assert names(cookies.delete_cookies(after, "a")) == {"b", "c"} and names(cookies.delete_cookies(after, "b", ".ex.com")) == {"a", "c"}
    assert names(cookies.delete_cookies(after, "b", "ex.com", "/")) == {"a", "b", "c"} and names(cookies.delete_cookies(after, "b", "other.com")) == {"a", "b", "c"}
    scoped = spark.range(1).select(cookies.scoped(F.lit("a=1"), F.lit("h")), cookies.scoped(F.lit("a=1; Domain=x"), F.lit("h"))).first()
    assert tuple(scoped) == ("a=1; Domain=h; Path=/", "a=1; Domain=x")


def test_merge_keeps_the_first_of_optional_fields(spark):
    raw = spark.createDataFrame([("q", 3, "b", "t", "http://u/", "s", 1.0, "i3"), ("q", 1, "z", "t", "http://u/", "s", 1.0, ""), ("q", 2, "z", "longer", "http://u", "", 1.0, "i2")], "q string, seq long, engine string, title string, url string, snippet string, score double, image string")
    r = search.merge_results(raw, ["q"]).first()
    assert (r.engines, r.image, r.title, r.url, r.snippet, r.score, r.n_results) == (["z", "b"], "i2", "longer", "http://u", "s", 3.0, 3)


def test_bounded_cache_matches_a_plain_walk(spark):
    import random

    rng, most, ttl = random.Random(7), 5, 40
    rows = [(i, f"c{i % 2}", f"k{rng.randrange(12)}", i * rng.choice([1, 1, 2])) for i in range(400)]
    rows = [(i, c, k, max(s for _, _, _, s in rows[: i + 1])) for i, c, k, _ in rows]
    want, caches = {}, {}
    for i, c, k, s in rows:
        held = caches.setdefault(c, {})
        want[i] = k in held and s - held[k] < ttl
        if not want[i]:
            held.pop(k, None)
            if len(held) >= most:
                held = caches[c] = {x: at for x, at in held.items() if s - at < ttl}
                if len(held) >= most:
                    del held[min(held, key=lambda x: held[x])]
            held[k] = s
    frame = spark.createDataFrame(rows, "i long, c string, k string, s long")
    got = {r.i: r.hit for r in state.bounded_cache(frame, "c", "k", "s", ["i"], ttl, most).collect()}
    assert got == want and any(want.values())


def test_steps_and_walks(spark):
    from tessella.operators import dom

    nodes = dom.parse_dom(spark.createDataFrame([(1, "<div><p>a</p><p>b</p></div><i>c</i>")], "d int, h string"), "d", "h").cache()
    at = {r.node_id: r for r in dom.steps(nodes, "d").collect()}
    div = next(r for r in at.values() if r.tag == "div")
    assert (at[div.next_id].tag, at[div.previous_id].tag, at[div.after_id].tag) == ("p", "body", "i")
    assert at[0].after_id is None and at[max(at)].next_id is None
    shown = dom.walk(nodes, "d", dom.element(), dom.element("div")).orderBy("step").collect()
    assert [r.tag for r in shown] == ["html", "head", "body", "i"]


def _plain_cache(rows, most, ttl):
    held, out = {}, {}
    for i, k, s in rows:
        out[i] = k in held and s - held[k] < ttl
        if not out[i]:
            held.pop(k, None)
            if len(held) >= most:
                held = {x: at for x, at in held.items() if s - at < ttl}
                if len(held) >= most:
                    del held[min(held, key=lambda x: held[x])]
            held[k] = s
    return out


def test_bounded_cache_with_seconds_that_fall(spark):
    import random

    rng = random.Random(11)
    rows = [(i, f"k{rng.randrange(14)}", rng.randrange(200) if i % 50 > 30 else i) for i in range(600)]
    frame = spark.createDataFrame([(i, "c", k, s) for i, k, s in rows], "i long, c string, k string, s long")
    assert {r.i: r.hit for r in state.bounded_cache(frame, "c", "k", "s", ["i"], ttl=30, most=6).collect()} == _plain_cache(rows, 6, 30)


def test_bounded_cache_does_not_scan_what_it_holds(spark):
    import time

    frame = spark.range(60_000).selectExpr("id AS i", "'c' AS c", "cast(id % 50000 AS string) AS k", "id AS s")
    began = time.perf_counter()
    hits = state.bounded_cache(frame, "c", "k", "s", ["i"], ttl=10**9, most=20_000).where("hit").count()
    assert hits == 0
    assert time.perf_counter() - began < 20  # a scan of all keys for each of 40,000 evictions took minutes
