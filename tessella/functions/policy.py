"""Who may fetch what: robots paths, block patterns, origins, addresses, client hints."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from tessella.functions.classify import has_any, is_antispider
from tessella.functions.urls import host, origin, scheme


def robots_match(path: Column, pattern: Column) -> Column:
    """A pattern is a prefix; a last * changes nothing, a last $ asks for equality, any other * is plain."""
    bare = F.substring(pattern, F.lit(1), F.length(pattern) - 1)
    return F.when(F.endswith(pattern, F.lit("*")), F.startswith(path, bare)).when(F.endswith(pattern, F.lit("$")), path == bare).otherwise(F.startswith(path, pattern))


def robots_allowed(path: Column, allowed: Column, disallowed: Column) -> Column:
    """Any rule that allows wins over any that forbids; no rules allow."""
    ok = F.exists(F.coalesce(allowed, F.array().cast("array<string>")), lambda p: robots_match(path, p))
    return ok | ~F.exists(F.coalesce(disallowed, F.array().cast("array<string>")), lambda p: robots_match(path, p))


def pattern_blocks(url: Column, pattern: Column, bare_is_whole: bool = False) -> Column:
    """* blocks all; stars at the ends open that end; a bare pattern is contained, or the whole URL."""
    n = F.length(pattern)
    first, last = F.startswith(pattern, F.lit("*")), F.endswith(pattern, F.lit("*"))
    return (
        F.when(pattern == "*", True)
        .when(first & last, F.contains(url, F.substring(pattern, F.lit(2), n - 2)))
        .when(first, F.endswith(url, F.substring(pattern, F.lit(2), n - 1)))
        .when(last, F.startswith(url, F.substring(pattern, F.lit(1), n - 1)))
        .otherwise((url == pattern) if bare_is_whole else F.contains(url, pattern))
    )


def cors_allows(with_credentials: Column, page: Column, allow_origin: Column, allow_credentials: Column) -> Column:
    exact = F.coalesce(allow_origin == page, F.lit(False))
    return F.when(with_credentials, exact & (F.coalesce(allow_credentials, F.lit("")) == "true")).otherwise(exact | (F.coalesce(allow_origin, F.lit("")) == "*"))


def credentials_sent(mode: Column, page_url: Column, target_url: Column) -> Column:
    return F.when(mode == "omit", False).when(mode == "include", True).otherwise(origin(page_url) == origin(target_url))


def subresource_allowed(target_scheme: Column, page_scheme: Column) -> Column:
    return target_scheme.isin("http", "https", "data") | ((target_scheme == "file") & (page_scheme == "file"))


def forbidden_address(address: Column) -> Column:
    """Loopback, private, link-local, broadcast, documentation and unspecified IPv4; null for other text."""
    octets = F.transform(F.split(address, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    valid = address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & F.forall(octets, lambda x: x <= 255)
    a, b, c = (F.try_element_at(octets, F.lit(k)) for k in (1, 2, 3))
    bad = (a == 127) | (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (address == "255.255.255.255") | (address == "0.0.0.0")
    documentation = ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    return F.when(valid, bad | documentation)


def forbidden_ipv6(address: Column) -> Column:
    """Loopback, unspecified, unique local and link-local IPv6, and mapped IPv4 that is forbidden; null for other text."""
    text = F.lower(F.regexp_replace(address, r"^\[|\]$", ""))
    valid = text.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$") & F.contains(text, F.lit(":"))
    first = F.conv(F.regexp_extract(text, r"^([0-9a-f]{1,4}):", 1), 16, 10).cast("int")
    own = text.rlike(r"^[0:]+$") | text.rlike(r"^[0:]*:0{0,3}1$") | F.coalesce(first.between(0xFE80, 0xFEBF) | first.between(0xFC00, 0xFDFF), F.lit(False))
    dotted = F.regexp_extract(text, r"^[0:]*:ffff:([0-9.]+)$", 1)
    high, low = (F.conv(F.regexp_extract(text, r"^[0:]*:ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k), 16, 10).cast("int") for k in (1, 2))
    hexed = F.concat_ws(".", *(x.cast("string") for n in (high, low) for x in (F.shiftright(n, 8), n.bitwiseAND(255))))
    mapped = F.when(dotted.rlike(r"\."), forbidden_address(dotted)).when(high.isNotNull(), forbidden_address(hexed))
    return F.when(valid, own | F.coalesce(mapped, F.lit(False)))


def url_forbidden(url: Column) -> Column:
    """Not http, https or file, or a host that is local by name or address."""
    name = host(url)
    local = (name == "localhost") | F.endswith(name, F.lit(".localhost")) | F.coalesce(forbidden_address(name), F.lit(False)) | F.coalesce(forbidden_ipv6(name), F.lit(False))
    return F.when(F.startswith(F.lower(url), F.lit("file://")), False).when(scheme(url) == "", True).otherwise(local)


def client_hints(agent: Column) -> tuple[Column, Column]:
    """Chrome's major version (145 without one) and the platform."""
    version = F.regexp_extract(agent, r"Chrome/([0-9]+)", 1)
    has = lambda *marks: has_any(agent, marks)
    platform = F.when(has("Macintosh", "Mac OS X"), "macOS").when(has("Windows"), "Windows").when(has("iPhone", "Android"), "Android").otherwise("Linux")
    return F.when(version == "", "145").otherwise(version), platform


def cross_scheme_to_file(source: Column, target: Column) -> Column:
    """Whether a page that is no file opens one."""
    return F.startswith(F.lower(target), F.lit("file:")) & ~F.coalesce(F.startswith(F.lower(source), F.lit("file:")), F.lit(False))


def redirected_method(status: Column, method: Column) -> Column:
    """301, 302 and 303 turn a request into GET; others keep its method."""
    return F.when(status.isin(301, 302, 303), "GET").otherwise(method)


def redirects_blocked(redirects: Column) -> Column:
    """Whether any URL of a redirect chain is a challenge's."""
    return F.exists(F.coalesce(redirects, F.array().cast("array<string>")), is_antispider)


def cache_key(*fields: Column) -> Column:
    """A digest of a request's fields, nulls apart from empty text."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("-")) for f in fields)), 256)


# The keys that a visitor's script names, with their codes and numbers.
KEYS = {
    "enter": ("Enter", 13), "escape": ("Escape", 27), "esc": ("Escape", 27), "backspace": ("Backspace", 8), "tab": ("Tab", 9), "arrowup": ("ArrowUp", 38),
    "arrowdown": ("ArrowDown", 40), "arrowleft": ("ArrowLeft", 37), "arrowright": ("ArrowRight", 39), "space": ("Space", 32), "delete": ("Delete", 46),
}


def key_code(name: Column) -> Column:
    """(code, key_code) of a key's name in any case; another name is its own code, with number 0."""
    low = F.lower(name)
    known = F.create_map(*(x for k, (code, n) in KEYS.items() for x in (F.lit(k), F.struct(F.lit(code).alias("code"), F.lit(n).alias("key_code")))))
    return F.coalesce(F.try_element_at(known, low), F.when(low.isNotNull(), F.struct(low.alias("code"), F.lit(0).alias("key_code"))))


@pandas_udf(BinaryType())
def _short_digest(algorithm: pd.Series, data: pd.Series) -> pd.Series:
    short = {"SHA-512/224": "sha512_224", "SHA-512/256": "sha512_256"}
    return pd.Series([None if a not in short or d is None else hashlib.new(short[a], bytes(d)).digest() for a, d in zip(algorithm, data, strict=True)], dtype=object)


def digest(algorithm: Column, data: Column) -> Column:
    """The digest of binary data by its algorithm's web name, in any case; empty for an unknown one. The two shortened ones need Python."""
    name = F.upper(algorithm)
    plain = F.when(name == "SHA-1", F.unhex(F.sha1(data)))
    for bits in (256, 384, 512):
        plain = plain.when(name == f"SHA-{bits}", F.unhex(F.sha2(data, bits)))
    return plain.when(name.isin("SHA-512/224", "SHA-512/256"), _short_digest(name, data)).otherwise(F.lit(b""))
