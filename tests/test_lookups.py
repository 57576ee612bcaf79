"""Redirects, as-of joins and joins to unique keys against plain walks over lists."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tessella.operators import cookies, joins, redirects

CAPTURES = "url string, status int, location string"


def walk(url, captures, most=20):
    """(final URL, status, hops, method of a POST, outcome, every URL on the way) by one hop at a time."""
    if url is None or url.startswith("http://10."):
        return url, None, 0, None, "forbidden", [url]
    method, way = "POST", [url]
    for n in range(most):
        if way[-1] not in captures:
            return way[-1], None, n, None, "not_captured", way
        status, location = captures[way[-1]]
        if not (300 <= (status or 0) < 400 and location is not None):
            return way[-1], status, n, method, "ok", way
        if location.startswith("http://["):
            return way[-1], None, n, None, "bad_location", way
        way.append(urljoin(way[-1], location))
        if way[-1].startswith("http://10."):
            return way[-1], None, n + 1, None, "forbidden", way
        method = "GET" if status in (301, 302, 303) else method
    return way[-1], None, most, None, "too_many_redirects", way


@pytest.mark.parametrize("seed", range(2))
def test_redirects(spark, monkeypatch, seed):
    monkeypatch.setattr(joins, "TOGETHER", 30)  # the hub's rows are dealt out
    rng = random.Random(seed)
    u = lambda i: f"https://s{i % 3}.example/p/{i}"
    rows = []
    for i in range(300):
        to = rng.choice([u(7), u(i + 1), u(rng.randrange(300)), f"/p/{i + 3}", None, "http://10.1.2.3/", "http://[x", f"//s{(i + 5) % 3}.example/p/{i + 5}"])
        rows.append((u(i), rng.choice([200, 301, 302, 303, 307, 308, None]) if i > 60 else 302, to if i > 60 else u(i + 1)))
    rows += [("https://loop.example/a", 302, "b"), ("https://loop.example/b", 307, "a"), ("https://loop.example/s", 308, ""), (None, 301, u(1)), (rows[70][0], 999, None)]
    held = {}
    for url, status, location in rows:
        if url is not None:
            held[url] = min(held.get(url, (status, location)), (status, location), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    asked = [(k, url, "POST") for k, url in enumerate([*(r[0] for r in rows), "https://nowhere.example/", "http://10.0.0.9/", None])]
    captures, requests = spark.createDataFrame(rows, CAPTURES), spark.createDataFrame(asked, "id long, url string, method string")
    got = {r.id: tuple(r)[1:] for r in redirects.resolve_redirects(requests, captures, "id").collect()}
    want = {k: walk(url, held) for k, url, _ in asked}
    assert got == {k: w[:5] for k, w in want.items()}
    assert {w[4] for w in want.values()} == {"ok", "not_captured", "too_many_redirects", "forbidden", "bad_location"}
    hops = sorted(tuple(r) for r in redirects.redirect_hops(requests, captures, "id").collect())
    assert hops == sorted((k, i, x) for k, w in want.items() if w[0] is not None for i, x in enumerate(w[5]))


def test_no_requests(spark):
    none = spark.createDataFrame([], "id long, url string, method string")
    assert redirects.resolve_redirects(none, spark.createDataFrame([], CAPTURES), "id").collect() == []


def test_join_unique_deals_out_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "TOGETHER", 20)
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("k4", 2), ("k7", 3)], "k string, v int")
    out = joins.join_unique(left, right, "k", F.col("id"))
    assert out.columns == ["id", "k", "v"]
    assert {(r.id, r.v) for r in out.collect()} == {(i, 1 if i % 3 == 0 else {4: 2, 7: 3}.get(i)) for i in range(1000)} and out.count() == 1000
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    parts = joins.join_unique(left, right, "k", F.col("id")).where("v = 1").groupBy(F.spark_partition_id()).count().collect()
    for k, v in was.items():
        spark.conf.set(k, v)
    assert len(parts) == 4 and max(r["count"] for r in parts) < 200


@pytest.mark.parametrize("ranges", [1, 4, 9])
def test_as_of(spark, ranges):
    rng = random.Random(ranges)
    log = [(rng.choice("aaab") if rng.random() < 0.95 else None, rng.choice([None, *range(60)]), rng.choice([None, "x", "y", "z"]), i) for i in range(150)]
    asks = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-2, 63)]), i) for i in range(120)]
    got = joins.as_of(spark.createDataFrame(asks, "k string, at int, id int"), spark.createDataFrame(log, "k string, at int, v string, n int"), ["k"], "at", ["v", "n"], ranges)
    assert got.columns == ["k", "at", "id", "v", "n"]

    def last(k, at):
        rows = [] if at is None else [(t, v is not None, v or "", n, v) for kk, t, v, n in log if kk == k and t is not None and t <= at]
        return (max(rows)[4], max(rows)[3]) if rows else (None, None)

    assert sorted(map(tuple, got.collect()), key=str) == sorted(((k, at, i, *last(k, at)) for k, at, i in asks), key=str)


def test_as_of_without_log(spark):
    asks = spark.createDataFrame([("a", 1)], "k string, at int")
    got = joins.as_of(asks, spark.createDataFrame([], "k string, at int, v string"), ["k"], "at", ["v"])
    assert [tuple(r) for r in got.collect()] == [("a", 1, None)]


def test_cookies_as_of_each_request(spark):
    log = [(1, "a=1"), (3, "a=2; HttpOnly"), (5, "b=1; Path=/x"), (6, "a=; Max-Age=0"), (8, "c=1; Max-Age=5"), (9, "d=1; Domain=example.org; Secure")]
    parsed = cookies.parse_set_cookie(spark.createDataFrame([(i, h, "/", 100 + i) for i, h in log], "n long, header string, at string, now long"), "header", F.lit("www.example.org"), "at", "now")
    asks = [(i, "https" if i != 12 else "http", "WWW.example.org" if i != 11 else "other.example.org", "/x/y" if i % 2 else "/", i, 100 + i) for i in range(20)]
    requests = spark.createDataFrame(asks, "id long, scheme string, host string, path string, n long, now long")
    got = {r.id: r.header for r in cookies.headers_as_of(requests, parsed, "id", "n", "now").collect()}
    want = {1: "a=1", 2: "a=1", 3: "a=2", 4: "a=2", 5: "a=2; b=1", 7: "b=1", 8: "c=1", 9: "b=1; c=1; d=1", 10: "c=1; d=1", 11: "d=1", 12: "c=1", 13: "b=1; d=1", 14: "d=1"}
    want |= {i: "b=1; d=1" if i % 2 else "d=1" for i in range(15, 20)}
    assert got == want
    seen = {r.id: r.header for r in cookies.headers_as_of(requests, parsed, "id", "n", "now", script=True).collect()}
    assert 3 not in seen and seen[1] == "a=1"


def test_pattern_sets(spark, monkeypatch):
    from tessella.functions.policy import pattern_blocks
    from tessella.operators import patterns

    monkeypatch.setattr(joins, "TOGETHER", 100)
    rng = random.Random(3)
    hosts = [f"h{rng.randrange(99999)}.{rng.choice(['example.com', 'test.org', 'x.net'])}" for _ in range(400)]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice('abc')}/{rng.randrange(10**6)}?q={rng.randrange(99)}" for _ in range(300)] + ["", "é*x", "a"]
    shapes = [lambda x: f"*{x}*", lambda x: f"*{x}", lambda x: f"{x}*", lambda x: x]

    def one():
        u = rng.choice(urls)
        a = rng.randrange(max(1, len(u)))
        return rng.choice(shapes)(u[a : a + rng.choice([1, 3, 5, 8, 30])])

    held = [*(rng.choice(hosts) + str(k) for k in range(9000)), *(one() for _ in range(1000)), "*", "**", "", "***", "*.com*", "https*", "é"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[0], None])], "id long, url string")
    asked = spark.createDataFrame([(p,) for p in [*held, None, held[0]]], "pattern string")

    def blocks(u, p, whole):
        if p == "*":
            return True
        if p.startswith("*") and p.endswith("*"):
            return p[1:-1] in u
        if p.startswith("*"):
            return u.endswith(p[1:])
        if p.endswith("*"):
            return u.startswith(p[:-1])
        return u == p if whole else p in u

    for whole in (False, True):
        want = {(u, p) for u in set(urls) for p in set(held) if blocks(u, p, whole)}
        got = [tuple(r) for r in patterns.pattern_matches(rows, "url", asked, bare_is_whole=whole).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    some = spark.createDataFrame([("*.com*",), ("zzz",), ("é*",)], "pattern string")
    got = {r.id: r.blocked for r in patterns.blocked_by(rows, "url", some).collect()}
    assert got == {i: u is not None and (".com" in u or u.startswith("é")) for i, u in enumerate([*urls, urls[0], None])}
    plain = rows.where("url IS NOT NULL").crossJoin(some).where(pattern_blocks(F.col("url"), F.col("pattern"))).select("id").distinct().count()
    assert plain == sum(got.values())
    assert patterns.pattern_matches(rows, "url", asked.where("false")).count() == 0


def test_domain_filter(spark, monkeypatch):
    from tessella.operators import search

    rng = random.Random(9)
    listed = [f"d{k}.example" for k in range(500)] + ["deep.listed.org", "Com.example"]
    hosts = [rng.choice([f"a.{rng.choice(listed)}", f"free{k}.test", rng.choice(listed).upper(), "x.deep.listed.org", "listed.org"]) for k in range(300)] + [None, ""]
    rows = spark.createDataFrame([(k, h, {"a": "b"}) for k, h in enumerate(hosts)], "id long, h string, m map<string,string>")
    domains = spark.createDataFrame([(d,) for d in [*listed, None]], "domain string")
    inside = {k for k, h in enumerate(hosts) if h and any(h.lower() == d.lower() or h.lower().endswith("." + d.lower()) for d in listed)}
    ids = lambda keep: sorted(r.id for r in search.in_domains(rows, "h", domains, keep).collect())
    assert ids(True) == sorted(inside) and ids(False) == sorted(set(range(len(hosts))) - inside)
    words, size = search.domain_filter(domains)
    probes = spark.createDataFrame([(f"no{k}.example",) for k in range(2000)] + [(d.lower(),) for d in listed], "t string").join(words)
    said = probes.groupBy(F.startswith("t", F.lit("no")).alias("absent")).agg(F.sum(search.may_be_in(F.col("t"), F.col("__filter"), size).cast("int")).alias("n")).collect()
    assert {r.absent: r.n for r in said}[False] == len(listed) and {r.absent: r.n for r in said}[True] < 100
    free = search.in_domains(rows.where("h LIKE 'free%'"), "h", domains, False)
    assert free.count() == sum(1 for h in hosts if h and h.startswith("free"))
    monkeypatch.setattr(search, "MOST_BITS", 100)  # too long a list for a filter
    assert search.domain_filter(domains)[0] is None
    assert ids(True) == sorted(inside) and ids(False) == sorted(set(range(len(hosts))) - inside)


def test_one_page_a_result(spark):
    from tessella.operators import search

    ranked = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3"), (4, "u1")], "rank int, url string")
    pages = spark.createDataFrame([("u1", "short"), ("u1", "longer"), ("u1", None), ("u3", None), (None, "x")], "url string, text string")
    got = {r.rank: (r.content, r.content_truncated, r.fetch_error) for r in search.fetch_top(ranked, pages, 3, 5).collect()}
    assert got == {1: ("longe", True, None), 2: (None, False, "not captured"), 3: (None, False, None), 4: (None, False, None)}


def test_cookies_of_each_hop(spark):
    u = lambda x: f"https://{x}"
    rows = [(u("a.example/1"), 302, u("b.example/2"), ["x=1", "y=1; Path=/z"]), (u("b.example/2"), 307, u("a.example/3"), ["b=1"]), (u("a.example/3"), 302, u("a.example/4"), ["x=2; Max-Age=9", "w=1; Secure"]),
            (u("a.example/4"), 302, "http://a.example/z/5", ["x=; Max-Age=0"]), ("http://a.example/z/5", 200, None, ["n=1"]), ("http://a.example/z/5", 204, None, ["other=1"])]
    captures = spark.createDataFrame(rows, "url string, status int, location string, set_cookie array<string>")
    requests = spark.createDataFrame([(1, rows[0][0], "GET"), (2, rows[2][0], "GET"), (None, u("none.example/"), "GET")], "id long, url string, method string")
    got = {(r.id, r.step): r.header for r in redirects.redirect_cookies(requests, captures, "id", F.lit(50).cast("long")).collect()}
    assert got == {(1, 2): "x=1", (1, 3): "w=1; x=2", (1, 4): "y=1", (2, 1): "w=1; x=2"}


@pytest.mark.parametrize("ranges", [1, 7])
def test_cookies_as_of_by_a_plain_walk(spark, ranges):
    rng = random.Random(5)
    pick = rng.choice
    log = [(pick([None, "x", "y"]), pick([None, *range(60)]), pick(["a.b.c", "b.c", "local"]), pick("pq"), pick(["/", "/d", "/d/", ""]), pick([None, "1", "2"]), rng.random() < 0.5, rng.random() < 0.3, rng.random() < 0.3, pick([None, 0, 30, 60])) for _ in range(400)]
    asks = [(k, pick([None, "x", "y"]), pick([None, *range(60)]), pick([None, "http", "HTTPS"]), pick([None, "A.b.c", "b.c", "z.b.c", "local", "c"]), pick([None, "/", "/d", "/d/e", "/de"]), pick([None, 10, 40])) for k in range(300)]
    parsed = spark.createDataFrame(log, "jar string, n int, domain string, name string, path string, value string, host_only boolean, secure boolean, http_only boolean, expires long")
    requests = spark.createDataFrame(asks, "id int, jar string, n int, scheme string, host string, path string, now long")
    for script in (False, True):
        made = cookies.headers_as_of(requests, parsed, "id", "n", "now", script, ("jar",), ranges)
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "StartsWith" not in plan  # requests were joined with every name and path of their domains
        want = {}
        for key, jar, at, scheme, host, path, now in asks:
            held, host = {}, (host or "").lower()
            for row in sorted((r for r in log if r[0] == jar and None not in (r[1], at) and r[1] <= at), key=lambda r: (r[1], *((x is not None, x or 0) for x in (int(r[5]) if r[5] else None, *r[6:])))):
                held[row[2:5]] = row[5:]
            said = []
            for (domain, name, of), (value, host_only, secure, http_only, expires) in held.items():
                near = domain == host or (host.endswith("." + domain) and not host_only)
                below = path is not None and (path == of or (path.startswith(of) and (of.endswith("/") or path[len(of) : len(of) + 1] == "/")))
                alive = value is not None and (expires is None or (now is not None and expires > now))
                if near and below and alive and (not secure or (scheme or "").lower() == "https") and not (script and http_only):
                    said.append(f"{name}={value}")
            if said:
                want[key] = "; ".join(sorted(said))
        assert {r.id: r.header for r in made.collect()} == want
        assert len(want) > 40
