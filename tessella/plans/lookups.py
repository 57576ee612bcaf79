"""Queries that look things up across rows: redirects, cookies as of a request, pattern sets, domain lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cookies, patterns, redirects, search
from tessella.plans.web import _ORIGIN, C, _events, _pages, _since_epoch, _split, query

# Captures derived from the pages: where each leads depends on its length; every third leads to one hub, some to each other,
# some far along a chain, some to a private address, some out of the table.
_URL = "concat('https://s', cast({0} % 7 AS VARCHAR(2)), '.example/p/', cast({0} AS VARCHAR(20)))"
_CAPTURE = f"""page_id, {_URL.format('page_id')} AS url, length(html) AS h,
CASE WHEN page_id BETWEEN 100 AND 130 THEN {_URL.format('(page_id + 1)')} WHEN page_id % 20 = 4 THEN {_URL.format('(page_id + 1)')} WHEN page_id % 20 = 5 THEN {_URL.format('(page_id - 1)')}
WHEN page_id % 3 = 0 THEN {_URL.format('1')} WHEN length(html) % 4 = 0 THEN NULL WHEN length(html) % 11 = 1 THEN 'http://10.0.0.1/x'
WHEN page_id % 7 = (page_id + 7) % 7 AND length(html) % 5 = 2 THEN concat('/p/', cast(page_id + 7 AS VARCHAR(20))) ELSE {_URL.format('(page_id + 1 + length(html) % 3)')} END AS location"""
_STATUS = "CASE WHEN location IS NULL THEN 200 + 204 * (h % 2) ELSE CASE h % 5 WHEN 0 THEN 301 WHEN 1 THEN 302 WHEN 2 THEN 303 WHEN 3 THEN 307 ELSE 308 END END"
_WALK = f"""c AS (SELECT page_id, url, {_STATUS} AS status, CASE WHEN starts_with(location, '/') THEN regexp_extract(url, '^https://[^/]+') || location ELSE location END AS location FROM (SELECT {_CAPTURE} FROM pages)),
w AS (SELECT page_id, url AS spot, 0 AS step, false AS got FROM c UNION ALL SELECT w.page_id, c.location, step + 1, got OR c.status < 304 FROM w JOIN c ON w.spot = c.url WHERE c.location IS NOT NULL AND step < 20 AND NOT starts_with(spot, 'http://10.'))"""


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).selectExpr(*_split(_CAPTURE))
    return rows.withColumn("status", F.expr(_STATUS))


@query(f"""WITH RECURSIVE {_WALK} SELECT w.page_id, spot AS final_url, CASE WHEN outcome = 'ok' THEN c.status END AS status, step AS n_hops, CASE WHEN outcome = 'ok' THEN CASE WHEN got THEN 'GET' ELSE 'POST' END END AS method, outcome
FROM (SELECT w.*, CASE WHEN starts_with(spot, 'http://10.') THEN 'forbidden' WHEN step = 20 THEN 'too_many_redirects' WHEN c.url IS NULL THEN 'not_captured' ELSE 'ok' END AS outcome
FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY step DESC) = 1) w LEFT JOIN c ON c.url = spot) w LEFT JOIN c ON c.url = spot""")
def redirects_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capture's URL asked for by POST and followed over the captures."""
    held = _captures(spark, sf_dir)
    return redirects.resolve_redirects(held.select("page_id", "url", F.lit("POST").alias("method")), held, "page_id")


@query(f"WITH RECURSIVE {_WALK} SELECT page_id, step, spot AS hop_url FROM w")
def redirect_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the same chains."""
    held = _captures(spark, sf_dir)
    return redirects.redirect_hops(held.select("page_id", "url", F.lit("POST").alias("method")), held, "page_id")


_COOKIE = "concat('c', cast(page_id % 5 AS VARCHAR(9)), '=v', cast(page_id AS VARCHAR(20)), CASE h % 6 WHEN 0 THEN '; Max-Age=0' WHEN 1 THEN '; Path=/q' WHEN 2 THEN '; Path=/; Secure' WHEN 3 THEN '; Domain=other.example' ELSE '' END)"


@query(f"""WITH RECURSIVE {_WALK}, s AS (SELECT w.page_id, step, spot, regexp_extract(spot, '^https?://([^/]+)', 1) AS host, regexp_extract(spot, '^https?://[^/]+(.*)$', 1) AS path FROM w),
log AS (SELECT s.page_id, step, host, 'c' || p.page_id % 5 AS name, 'v' || p.page_id AS value, CASE WHEN length(html) % 6 = 1 THEN '/q' WHEN length(html) % 6 = 2 THEN '/' ELSE '/p' END AS cookie_path, length(html) % 6 = 0 AS gone FROM s JOIN c ON c.url = spot JOIN pages p ON p.page_id = c.page_id),
m AS (SELECT s.page_id, s.step, log.name, cookie_path, arg_max(value, log.step) AS value, arg_max(gone, log.step) AS gone FROM s JOIN log ON s.page_id = log.page_id AND log.step < s.step AND s.host = log.host
WHERE cookie_path = '/' OR s.path = cookie_path OR starts_with(s.path, cookie_path || '/') GROUP BY ALL)
SELECT page_id, step, string_agg(name || '=' || value, '; ' ORDER BY name || '=' || value) AS header FROM m WHERE NOT gone GROUP BY page_id, step""")
def redirect_cookies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every hop of the same chains sends of the cookies that its earlier hops set."""
    held = _captures(spark, sf_dir).withColumn("set_cookie", F.array(F.expr(_COOKIE)))
    return redirects.redirect_cookies(held.select("page_id", "url", F.lit("POST").alias("method")), held, "page_id", F.lit(1000).cast("long"))


# Events as one history: two of three set a cookie, the others ask; both by event_id.
_SET = "concat('c', cast(event_id % 4 AS VARCHAR(9)), '=v', cast(event_id AS VARCHAR(20)), CASE event_id % 5 WHEN 0 THEN '; Max-Age=0' WHEN 1 THEN '; Path=/a; Secure' WHEN 2 THEN concat('; Domain=.site.example; HttpOnly; Max-Age=', cast(3600 * (event_id % 50) AS VARCHAR(9))) WHEN 3 THEN '; Max-Age=86400' ELSE '' END)"
_ASK = "event_id, CASE WHEN user_id % 2 = 0 THEN 'HTTPS' ELSE 'http' END AS scheme, concat('U', cast(user_id % 50 AS VARCHAR(9)), '.Site.example') AS host, CASE event_id % 4 WHEN 0 THEN '/a/b' WHEN 1 THEN '/' ELSE '/ab' END AS path"


def cookie_sql(hidden: str, more: str = "") -> str:
    """What each request sends; hidden says which cookies scripts don't see, more what else must hold."""
    return f"""WITH log AS (SELECT event_id AS at, CASE WHEN event_id % 5 = 2 THEN 'site.example' ELSE {_ORIGIN} END AS domain, 'c' || event_id % 4 AS name, 'v' || event_id AS value, CASE WHEN event_id % 5 = 1 THEN '/a' ELSE '/' END AS cookie_path, event_id % 5 <> 2 AS host_only, event_id % 5 = 1 AS secure, {hidden} AS http_only,
CASE event_id % 5 WHEN 0 THEN 0 WHEN 2 THEN CASE WHEN event_id % 50 = 0 THEN 0 ELSE floor(epoch(ts))::BIGINT + 3600 * (event_id % 50) END WHEN 3 THEN floor(epoch(ts))::BIGINT + 86400 END AS expires FROM events WHERE event_id % 3 <> 0),
q AS (SELECT {_ASK}, floor(epoch(ts))::BIGINT AS now FROM events WHERE event_id % 3 = 0), k AS (SELECT DISTINCT domain, name, cookie_path FROM log),
a AS (SELECT q.*, k.* FROM q JOIN k ON (lower(host) = domain OR ends_with(lower(host), '.' || domain)) WHERE cookie_path = '/' OR path = cookie_path OR starts_with(path, cookie_path || '/')),
r AS (SELECT a.event_id, now, scheme, host, a.domain, a.name, value, host_only, secure, http_only, expires FROM a ASOF JOIN log ON a.domain = log.domain AND a.name = log.name AND a.cookie_path = log.cookie_path AND a.event_id >= log.at)
SELECT event_id, string_agg(name || '=' || value, '; ' ORDER BY name || '=' || value) AS header FROM r WHERE (expires IS NULL OR expires > now) AND (lower(host) = domain OR NOT host_only) AND (NOT secure OR lower(scheme) = 'https') {more} GROUP BY event_id"""


@query(cookie_sql("event_id % 5 = 2"))
def cookie_header_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request sends of the cookies set before it."""
    events = _events(spark, sf_dir).withColumn("now", _since_epoch("SECOND"))
    log = events.where("event_id % 3 <> 0").selectExpr("event_id", f"{_SET} AS header", f"{_ORIGIN} AS origin", "'/' AS at", "now")
    parsed = cookies.parse_set_cookie(log, "header", C("origin"), "at", "now")
    asked = events.where("event_id % 3 = 0").selectExpr(*_split(_ASK), "now")
    return cookies.headers_as_of(asked, parsed, "event_id", "event_id", "now").select("event_id", "header")


# A pattern from each page, in every form; some are very common, some alone.
_PATTERN = """CASE page_id % 8 WHEN 0 THEN concat('*', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '*') WHEN 1 THEN concat(regexp_extract(url, '^([a-z]+://[^/?#]+/[a-z]*)', 1), '*') WHEN 2 THEN concat('*', right(url, 6))
WHEN 3 THEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) WHEN 4 THEN url WHEN 5 THEN concat('*', regexp_extract(url, '([.][a-z]+)[/?#]', 1), '/', left(html, page_id % 3), '*') WHEN 6 THEN right(url, 2) ELSE concat('*', regexp_extract(url, '([0-9]+)', 1)) END"""
_MATCHES = "pattern = '*' OR CASE WHEN starts_with(pattern, '*') AND ends_with(pattern, '*') THEN contains(url, pattern[2:-2]) WHEN starts_with(pattern, '*') THEN ends_with(url, pattern[2:]) WHEN ends_with(pattern, '*') THEN starts_with(url, pattern[:-2]) ELSE contains(url, pattern) END"


@query(f"WITH s AS (SELECT DISTINCT {_PATTERN} AS pattern FROM pages) SELECT page_id, count(pattern) AS n_patterns FROM pages LEFT JOIN s ON {_MATCHES} GROUP BY page_id")
def url_pattern_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the patterns made of all pages' URLs match each page's own."""
    pages = _pages(spark, sf_dir)
    found = patterns.pattern_matches(pages, "url", pages.selectExpr(f"{_PATTERN} AS pattern"))
    counts = found.groupBy(C("url").alias("__url")).agg(F.count("*").alias("n"))
    return pages.select("page_id", "url").join(counts, C("url") == C("__url"), "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_patterns"))


# A long list of domains: every third page's host and the parents of some, with ones that no page has.
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"
_LISTED = f"CASE page_id % 6 WHEN 0 THEN {_HOST} WHEN 3 THEN concat('x', cast(page_id AS VARCHAR(9)), '.', {_HOST}) ELSE concat('none', cast(page_id AS VARCHAR(9)), '.example') END"


@query(f"""WITH d AS (SELECT DISTINCT {_LISTED} AS domain FROM pages WHERE length(html) % 3 = 0) SELECT page_id, host FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'A.' ELSE '' END || {_HOST} AS host FROM pages) p
WHERE NOT EXISTS (SELECT 1 FROM d WHERE lower(host) = domain OR ends_with(lower(host), '.' || domain))""")
def long_domain_list_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose host is in no domain of a list as long as the table."""
    pages = _pages(spark, sf_dir)
    rows = pages.selectExpr("page_id", f"concat(CASE WHEN page_id % 2 = 0 THEN 'A.' ELSE '' END, {_HOST}) AS host")
    return search.in_domains(rows, "host", pages.where("length(html) % 3 = 0").selectExpr(f"{_LISTED} AS domain"), keep=False)
