"""Classes of captured pages: enough content, challenge pages, tiers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import strip_tags

# Marks of challenge pages and of mount points of scripts.
ANTISPIDER = ("/antispider", "wappass.baidu.com", "sorry.google.com", "challenge-platform")
MOUNTS = ('id="app"', "id='app'", 'id="root"', "id='root'")


def has_any(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(m)) for m in marks))


def content_sufficient(html: Column) -> Column:
    """Whether a page has text of its own without running scripts; sizes are in bytes."""
    low = F.lower(html)
    size = F.octet_length(strip_tags(html))
    needs_script = F.contains(low, F.lit("<noscript")) & F.contains(low, F.lit("enable javascript"))
    return ~needs_script & ~(has_any(low, MOUNTS) & (size < 200)) & (size >= 64)


def is_antispider(url: Column) -> Column:
    return has_any(url, ANTISPIDER)


def captcha_type(url: Column, html: Column) -> Column:
    """The kind of challenge, null for none; the order of rules is part of their meaning."""
    return (
        F.when(has_any(url, ("sorry.google.com", "/sorry/")), "recaptcha_v2")
        .when(has_any(url, ("/antispider", "wappass.baidu.com")), "slider_captcha")
        .when(has_any(url, ("challenge-platform", "challenges.cloudflare.com")), "cloudflare_turnstile")
        .when(has_any(html, ("g-recaptcha", "data-sitekey")), "recaptcha_v2")
        .when(has_any(html, ("h-captcha", "hcaptcha.com")), "hcaptcha")
        .when(has_any(html, ("challenges.cloudflare", "cf-turnstile")), "cloudflare_turnstile")
        .when(has_any(html, ("unusual traffic", "/sorry/")), "recaptcha_v2")
        .when(has_any(html, ("wappass", "/antispider", "用户频率限制")), "slider_captcha")
    )


def render_tier(status: Column, content_type: Column, url: Column, html: Column) -> Column:
    plain = (status == 200) & F.contains(content_type, F.lit("text/html")) & ~is_antispider(url) & content_sufficient(html)
    return F.when(plain, "http").otherwise("needs_render")
