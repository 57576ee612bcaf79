"""A cookie jar as a log of Set-Cookie headers, its state, and what a request gets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions.urls import suffixes
from tessella.operators.joins import time_ranges
from tessella.sources.staging import materialize

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def http_date(text: Column) -> Column:
    """Epoch seconds of a cookie date, its zone ignored; null if it isn't one."""
    words = F.split(F.trim(F.regexp_replace(F.replace(text, F.lit("-"), F.lit(" ")), r"\s+", " ")), " ")
    at = lambda k: F.try_element_at(words, F.lit(k))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(at(3), 1, 3)))
    clock = F.split(at(5), ":")
    num = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)).try_cast("int"), F.lit(0))
    days = F.datediff(F.try_make_timestamp(at(4).try_cast("int"), F.nullif(month, F.lit(0)).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date"), F.lit("1970-01-01").cast("date")) + at(2).try_cast("int") - 1
    return F.when(F.size(words) >= 5, days.cast("long") * 86400 + num(clock, 1) * 3600 + num(clock, 2) * 60 + num(clock, 3))


def default_path(path: Column) -> Column:
    up = F.regexp_extract(path, r"^(/.*)/[^/]*$", 1)
    return F.when(up == "", "/").otherwise(up)


def parse_set_cookie(log: DataFrame, header: str, origin_host: str, origin_path: str, now: str) -> DataFrame:
    """log with domain, name, value, path, host_only, secure, http_only, same_site and expires (epoch, 0 deletes).

    Rows without = before the first ; are dropped. now holds epoch seconds. Of Max-Age and Expires the last counts. A
    Domain that is no parent of the origin leaves the cookie to the origin alone.
    """
    pair = F.substring_index(F.col(header), ";", 1)
    parts = F.transform(F.slice(F.split(F.col(header), ";"), F.lit(2), F.size(F.split(F.col(header), ";"))), lambda x: F.trim(x))
    items = F.transform(parts, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=?", "")).alias("v"), F.contains(x, F.lit("=")).alias("pair")))
    last = lambda key: F.try_element_at(F.filter(F.col("__items"), lambda x: (x["k"] == key) & x["pair"]), F.lit(-1))["v"]
    flag = lambda key: F.exists("__items", lambda x: (x["k"] == key) & ~x["pair"])
    ages = F.filter(F.col("__items"), lambda x: x["pair"] & (((x["k"] == "max-age") & x["v"].try_cast("long").isNotNull()) | ((x["k"] == "expires") & http_date(x["v"]).isNotNull())))
    age = F.try_element_at(ages, F.lit(-1))
    until = F.when(age["k"] == "max-age", F.when(age["v"].try_cast("long") <= 0, 0).otherwise(F.col(now) + age["v"].try_cast("long"))).otherwise(http_date(age["v"]))
    host = F.regexp_replace(F.lower(F.trim(origin_host)), r"^\.+", "")
    asked = F.regexp_replace(F.lower(F.trim(last("domain"))), r"^\.+", "")
    parent = F.coalesce(F.contains(asked, F.lit(".")) & F.endswith(host, F.concat(F.lit("."), asked)), F.lit(False))
    rows = log.where(F.contains(pair, F.lit("=")) & (host != "")).withColumn("__items", items)
    site = F.lower(F.coalesce(last("samesite"), F.lit("")))
    return rows.withColumns({
        "domain": F.when(parent, asked).otherwise(host), "host_only": ~parent,
        "name": F.trim(F.substring_index(pair, "=", 1)), "value": F.trim(F.regexp_replace(pair, "^[^=]*=", "")),
        "path": F.coalesce(last("path"), default_path(F.col(origin_path))), "secure": flag("secure"), "http_only": flag("httponly"),
        "same_site": F.when(site == "strict", "Strict").when(site == "none", "None").otherwise("Lax"), "expires": until,
    }).drop("__items")


def set_by_script(parsed: DataFrame) -> DataFrame:
    """Parsed cookies as a script sets them: never out of scripts' sight."""
    return parsed.withColumn("http_only", F.lit(False))


def scoped(header: Column, host: Column) -> Column:
    """A cookie that a request brings, for the request's host and all paths unless it names a domain itself."""
    return F.when(F.contains(F.lower(header), F.lit("domain=")), header).otherwise(F.concat(header, F.lit("; Domain="), host, F.lit("; Path=/")))


def bulk_load(jar: DataFrame, loaded: DataFrame, seq: str) -> DataFrame:
    """A jar's state after cookies with domain, name, value, path, secure, http_only, same_site, expires come in by seq.

    A loaded cookie goes to its domain and below, without SameSite it is Lax, an expiry of 0 or less is none."""
    new = loaded.withColumns({
        "host_only": F.lit(False), "same_site": F.when(F.coalesce("same_site", F.lit("")) == "", "Lax").otherwise(F.col("same_site")), "expires": F.when(F.col("expires") > 0, F.col("expires")),
    })
    fields = [c for c in jar.columns if c not in ("domain", "name", "path")]
    every = jar.withColumn("__seq", F.lit(-1).cast("long")).unionByName(new.withColumn("__seq", F.col(seq).cast("long")).select(*jar.columns, "__seq"))
    last = every.groupBy("domain", "name", "path").agg(F.max_by(F.struct(*fields), "__seq").alias("c"))
    return last.select("domain", "name", "path", *(F.col(f"c.{f}").alias(f) for f in fields)).select(*jar.columns)


def delete_cookies(jar: DataFrame, name: str, domain: str = "", path: str | None = None) -> DataFrame:
    """The jar without a name's cookies: of all domains or one, with or without its leading dot, and of all paths or one."""
    bare = domain.lstrip(".")
    gone = F.col("name") == name
    if domain:
        gone = gone & F.col("domain").isin(domain, bare, f".{bare}")
    return jar.where(~(gone if path is None else gone & (F.col("path") == path)))


def jar_state(parsed: DataFrame, seq: str, now: str) -> DataFrame:
    """The last cookie of each (domain, name, path), unless it deletes: one shuffle with partial aggregates."""
    fields = ("value", "host_only", "secure", "http_only", "same_site", "expires")
    last = parsed.groupBy("domain", "name", "path").agg(F.max_by(F.struct(*fields, F.col(now).alias("__now")), F.col(seq)).alias("c"))
    return last.where("c.expires IS NULL OR c.expires > c.__now").select("domain", "name", "path", *(F.col(f"c.{f}").alias(f) for f in fields))


def path_matches(path: Column, cookie_path: Column) -> Column:
    after = F.substring(path, F.length(cookie_path) + 1, F.lit(1))
    return (path == cookie_path) | (F.startswith(path, cookie_path) & (F.endswith(cookie_path, F.lit("/")) | (after == "/")))


def cookie_headers(requests: DataFrame, jar: DataFrame, key: str, as_of: Column, script: bool = False) -> DataFrame:
    """(key, header) for requests(key, scheme, host, path): name=value pairs in order of name and value.

    The domain match is an equality with one of the host's suffixes; what else must hold is checked on the join's rows.
    """
    asked = requests.select(key, "scheme", F.lower("host").alias("asked_host"), F.col("path").alias("request_path"), F.explode(suffixes(F.lower("host"))).alias("suffix"))
    rows = asked.join(jar, F.col("suffix") == F.col("domain")).where("suffix = asked_host OR NOT host_only").where("NOT secure OR scheme = 'https'")
    rows = rows.where(F.col("expires").isNull() | (F.col("expires") > as_of)).where(path_matches(F.col("request_path"), F.col("path")))
    if script:
        rows = rows.where("NOT http_only")
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("="), "value"))), "; ").alias("header"))


#: What of a cookie decides whether a request gets it, in the order by which the greater of two set at one place counts.
FIELDS = ("value", "host_only", "secure", "http_only", "expires")


def _fits(cookie: tuple, cookie_path: str | None, domain: str, now: int | None, scheme: str | None, host: str, path: str | None, script: bool) -> bool:
    value, host_only, secure, http_only, expires = cookie
    if value is None or path is None or cookie_path is None or (expires is not None and (now is None or expires <= now)):
        return False
    if (host_only and domain != host) or (secure and scheme != "https") or (script and http_only):
        return False
    return path == cookie_path or (path.startswith(cookie_path) and (cookie_path.endswith("/") or path[len(cookie_path) : len(cookie_path) + 1] == "/"))


def headers_as_of(requests: DataFrame, parsed: DataFrame, key: str, at: str, now: str, script: bool = False, jar: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """(key, header) for requests(key, scheme, host, path, at, now): what the jar held when each was made.

    parsed is the log of parse_set_cookie with the same `at`, by which both are in order; of cookies set at a request's own
    place it sees them. Each request meets the last cookie of each name and path that its domains had before it, which
    counts unless it deletes, has expired by `now` or doesn't fit. Histories are cut into ranges, so a domain of any
    share of the log is many tasks' work: a range starts from what the ranges before it leave, and its rows pass once in
    order by the domain's last cookies, so a request is a row for each of its domains, whatever they hold. Requests
    without a fitting cookie have no row. jar names columns of both that say whose jar a row is about; without them there is one.
    """
    own = [f"__jar{i}" for i in range(len(jar))]
    mine = [F.col(c).alias(n) for c, n in zip(jar, own, strict=True)]
    # Written down, as its ranges, what they leave and its rows are read each by itself: headers are parsed once.
    log = materialize(parsed.where(F.col(at).isNotNull()).select(*mine, "domain", "name", "path", F.col(at).alias("__at"), *FIELDS))
    asked = requests.where(F.col(at).isNotNull()).select(
        *mine, F.explode(suffixes(F.lower("host"))).alias("domain"), F.col(at).alias("__at"), F.col(key).alias("__key"), F.col(now).alias("__now"), F.lower("scheme").alias("__scheme"), F.lower("host").alias("__host"), F.col("path").alias("__asked"),
    ).where("contains(domain, '.') OR domain = __host")
    cut = time_ranges(log, requests.select(F.col(at).alias("__at")), "__at", ranges)
    log, asked = log.withColumn("__range", cut), asked.withColumn("__range", cut)
    last = log.groupBy(*own, "domain", "name", "path", "__range").agg(F.max(F.struct("__at", F.struct(*FIELDS).alias("c"))).alias("__last"))
    # Of each name and path what it has in the ranges before: at most as many rows as a domain has names and ranges.
    spots = asked.select(*own, "domain", "__range").distinct()
    names = last.select(*(F.col(c).alias(f"{c}_of") for c in own), F.col("domain").alias("__domain"), "name", "path").distinct()
    same = F.col("domain") == F.col("__domain")
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    met = spots.join(names.hint("merge"), same).select(*own, "domain", "name", "path", "__range", F.lit(None).cast(last.schema["__last"].dataType).alias("__last"))
    every = last.select(*met.columns).unionByName(met).groupBy(*own, "domain", "name", "path", "__range").agg(F.max("__last").alias("__last"))
    ahead = F.last("__last", ignorenulls=True).over(Window.partitionBy(*own, "domain", "name", "path").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    carried = every.withColumn("__c", ahead["c"]).where("__c IS NOT NULL").select(*own, "domain", "name", "path", "__range", *(F.col(f"__c.{f}").alias(f) for f in FIELDS))
    rows = carried.withColumns({"__at": F.lit(None).cast(log.schema["__at"].dataType), "__ask": F.lit(0)}).unionByName(log.withColumn("__ask", F.lit(0))).unionByName(asked.withColumn("__ask", F.lit(1)), allowMissingColumns=True)
    spot = [*own, "domain", "__range"]
    fields = ["__ask", "name", "path", *FIELDS, "__key", "__now", "__scheme", "__host", "__asked"]
    rows = rows.select(*spot, "__at", *fields).repartition(*spot).sortWithinPartitions(*spot, F.asc_nulls_first("__at"), "__ask", *FIELDS).select(*spot, *fields)
    schema = T.StructType([T.StructField(key, requests.schema[key].dataType), T.StructField("__pairs", T.ArrayType(T.StringType()))])
    kind = to_arrow_type(schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, n = object(), {}, len(spot)
        for batch in batches:
            keys, made = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != where:
                    where, held = row[:n], {}
                if not row[n]:
                    held[row[n + 1 : n + 3]] = row[n + 3 : n + 8]
                    continue
                name, time, scheme, host, path = row[n + 8 :]
                said = [f"{k}={c[0]}" for (k, of), c in held.items() if _fits(c, of, where[-2], time, scheme, host, path, script)]
                if said:
                    keys.append(name)
                    made.append(said)
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(made, pa.list_(pa.string()))], schema.names)

    return rows.mapInArrow(run, schema).groupBy(key).agg(F.array_join(F.array_sort(F.flatten(F.collect_list("__pairs"))), "; ").alias("header"))
