"""URL algebra over http and https URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"(?is)^\s*(https?)://(?:[^/?#]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[\]]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 host, 3 port, 4 path, 5 query; empty for what is not there."""
    return F.regexp_extract(url, PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def port(url: Column) -> Column:
    """The port where it isn't the scheme's own; empty otherwise."""
    p = part(url, 3)
    return F.when(((scheme(url) == "http") & (p == "80")) | ((scheme(url) == "https") & (p == "443")), "").otherwise(p)


def path(url: Column) -> Column:
    p = part(url, 4)
    return F.when(p == "", "/").otherwise(p)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(port(url) == "", "").otherwise(F.concat(F.lit(":"), port(url))))


def suffixes(name: Column) -> Column:
    """A host and its parents, down to the top level: what membership in a list of domains joins on."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _form_decoded(x: Column) -> Column:
    """+ is a space; an escape that is none stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")), x)


def query_pairs(query: Column) -> Column:
    """Decoded (key, value) in order, repeats and all; one leading ? is left out."""
    one = lambda x: F.struct(_form_decoded(F.substring_index(x, "=", 1)).alias("key"), _form_decoded(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("value"))
    return F.transform(F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda x: x != ""), one)


def form_encoded(pairs: Column) -> Column:
    """The pairs as a query: what query_pairs() reads back as they were."""
    return F.array_join(F.transform(pairs, lambda x: F.concat(F.url_encode(x["key"]), F.lit("="), F.url_encode(x["value"]))), "&")


def params_get(pairs: Column, key: str) -> Column:
    """The first value of a key, else null."""
    return F.get(params_get_all(pairs, key), F.lit(0))


def params_get_all(pairs: Column, key: str) -> Column:
    return F.transform(F.filter(pairs, lambda x: x["key"] == key), lambda x: x["value"])


def params_delete(pairs: Column, key: str) -> Column:
    return F.filter(pairs, lambda x: x["key"] != key)


def params_append(pairs: Column, key: str, value: Column) -> Column:
    return F.concat(pairs, F.array(F.struct(F.lit(key).alias("key"), value.alias("value"))))


def params_set(pairs: Column, key: str, value: Column) -> Column:
    """The first pair of a key has the value where it stands, the others go; without one the pair comes last."""
    first = F.array_position(F.transform(pairs, lambda x: x["key"]), key)
    numbered = F.transform(pairs, lambda x, i: F.struct(F.when(i + 1 == first, value).otherwise(x["value"]).alias("value"), x["key"].alias("key"), (i + 1).alias("at")))
    kept = F.transform(F.filter(numbered, lambda x: (x["key"] != key) | (x["at"] == first)), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    return F.when(first > 0, kept).otherwise(params_append(pairs, key, value))


def params_sort(pairs: Column) -> Column:
    """The pairs by key; equal keys keep their order."""
    numbered = F.transform(pairs, lambda x, i: F.struct(x["key"].alias("key"), i.alias("at"), x["value"].alias("value")))
    return F.transform(F.array_sort(numbered), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))


def _escape(text: Column) -> Column:
    """What a query may not hold, as percent escapes."""
    for c in (" ", '"', "#", "<", ">", "'"):
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02x}"))
    wide = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.octet_length(c) > 1, F.url_encode(c)).otherwise(c)), "")
    return F.when(F.octet_length(text) > F.char_length(text), wide).otherwise(text)


def normalize_url(url: Column) -> Column:
    """The form by which results are the same: no www, default port, fragment, tracking keys or last slashes."""
    pairs = F.filter(query_pairs(part(url, 5)), lambda p: ~p["key"].isin(*TRACKING))
    order = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value"))))
    query = F.array_join(F.transform(order, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")
    bare = F.regexp_replace(part(url, 4), "/{1,2}$", "")
    where = F.concat(scheme(url), F.lit("://"), F.regexp_replace(host(url), r"^www\.", ""), F.when(port(url) == "", "").otherwise(F.concat(F.lit(":"), port(url))))
    whole = F.concat(where, F.when(bare == "", "/").otherwise(bare), F.when(query == "", "").otherwise(F.concat(F.lit("?"), _escape(query))))
    return F.lower(F.when(scheme(url) == "", url).otherwise(whole))


def unwrap_google(url: Column) -> Column:
    """The target of a result link /url?q=…&sa=…; + stays a plus."""
    inner = F.regexp_extract(url, r"/url\?q=([^&]*)", 1)
    return F.when(inner == "", url).otherwise(F.coalesce(F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B"))), inner))


def unwrap_bing(url: Column) -> Column:
    """The target in a click link's u parameter: a1, then URL-safe base64 of a URL."""
    code = F.translate(F.regexp_extract(url, r"[?&]u=a1([A-Za-z0-9_\-=]+)", 1), "-_", "+/")
    padded = F.rpad(code, (F.ceil(F.length(code) / F.lit(4)) * 4).cast("int"), "=")
    inner = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when((code != "") & F.startswith(inner, F.lit("http")), inner).otherwise(url)


def referrer(source: Column, target: Column) -> Column:
    """strict-origin-when-cross-origin: the URL within an origin, the origin across, none from https down to http."""
    same = origin(source) == origin(target)
    bare = F.regexp_replace(source, "#.*$", "")
    return F.when((scheme(source) == "https") & (scheme(target) == "http"), F.lit("")).when(same, bare).otherwise(F.concat(origin(source), F.lit("/")))


_AUTHORITY = r"(?is)^\s*https?://(?:([^/?#:@]*)(?::([^/?#@]*))?@)?"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value made once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def components(url: Column) -> Column:
    """The eleven parts that scripts see of an http or https URL; null for other text."""
    return _once(url, _components)


def _components(url: Column) -> Column:
    none_or = lambda mark, c: F.when(c == "", "").otherwise(F.concat(F.lit(mark), c))
    user, secret = F.regexp_extract(url, _AUTHORITY, 1), F.regexp_extract(url, _AUTHORITY, 2)
    query, fragment = part(url, 5), F.regexp_extract(url, r"(?s)#(.*)$", 1)
    with_port = F.concat(host(url), none_or(":", port(url)))
    login = F.when((user == "") & (secret == ""), "").otherwise(F.concat(user, none_or(":", secret), F.lit("@")))
    mark = lambda sign, c: F.when(F.contains(url, F.lit(sign)), F.concat(F.lit(sign), c)).otherwise("")
    before = F.substring_index(url, "#", 1)
    href = F.concat(scheme(url), F.lit("://"), login, with_port, path(url), F.when(F.contains(before, F.lit("?")), F.concat(F.lit("?"), query)).otherwise(""), mark("#", fragment))
    made = F.struct(
        href.alias("href"), F.concat(scheme(url), F.lit(":")).alias("protocol"), user.alias("username"), secret.alias("password"), with_port.alias("host"), host(url).alias("hostname"), port(url).alias("port"),
        path(url).alias("pathname"), none_or("?", query).alias("search"), none_or("#", fragment).alias("hash"), origin(url).alias("origin"),
    )
    return F.when(scheme(url) != "", made)


def with_component(url: Column, name: str, value: Column) -> Column:
    """The URL after a script sets one part: protocol, username, password, host, hostname, port, pathname, search, hash or href.

    What can't be set (another scheme than http and https, an empty host, a port that is no number) leaves the URL as it was."""
    return _once(components(url), lambda c: _with_component(c, name, value))


def _with_component(c: Column, name: str, value: Column) -> Column:
    now = {k: c[k] for k in ("protocol", "username", "password", "hostname", "port", "pathname", "search", "hash")}
    ok = F.lit(True)
    lead = lambda sign: F.when(value == "", "").when(F.startswith(value, F.lit(sign)), value).otherwise(F.concat(F.lit(sign), value))
    if name == "href":
        return F.coalesce(components(value)["href"], c["href"])
    if name == "protocol":
        now[name] = F.concat(F.regexp_replace(F.lower(value), ":.*$", ""), F.lit(":"))
        ok = now[name].isin("http:", "https:")
    elif name in ("host", "hostname"):
        said = F.regexp_extract(value, r"^([^/?#:@]+)", 1)
        now["hostname"], ok = F.lower(said), said != ""
        if name == "host":
            number = F.regexp_extract(value, r"^[^/?#:@]+:([0-9]{1,5})", 1)
            now["port"] = F.when(number != "", number).otherwise(now["port"])
    elif name == "port":
        now[name] = F.regexp_extract(value, r"^([0-9]{0,5})", 1)
        ok = (value == "") | (now[name] != "")
    elif name == "pathname":
        now[name] = F.when(F.startswith(value, F.lit("/")), value).otherwise(F.concat(F.lit("/"), value))
    else:
        now[name] = lead("?") if name == "search" else lead("#") if name == "hash" else value
    usual = ((now["protocol"] == "http:") & (now["port"] == "80")) | ((now["protocol"] == "https:") & (now["port"] == "443")) | (now["port"] == "")
    login = F.when((now["username"] == "") & (now["password"] == ""), "").otherwise(F.concat(now["username"], F.when(now["password"] == "", "").otherwise(F.concat(F.lit(":"), now["password"])), F.lit("@")))
    out = F.concat(now["protocol"], F.lit("//"), login, now["hostname"], F.when(usual, "").otherwise(F.concat(F.lit(":"), now["port"])), now["pathname"], now["search"], now["hash"])
    return F.when(ok, out).otherwise(c["href"])
