"""URL scalars. What a column expression can say is one; joins of references need a Python UDF."""

from __future__ import annotations

from urllib.parse import parse_qsl, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hosts of social, analytics and store pages that a crawl leaves out.
IGNORED_DOMAINS = (
    "facebook.com fb.com instagram.com threads.net twitter.com x.com t.co linkedin.com youtube.com youtu.be tiktok.com reddit.com redd.it "
    "snapchat.com pinterest.com pin.it tumblr.com twitch.tv discord.com discord.gg telegram.org t.me whatsapp.com wa.me weibo.com vk.com "
    "mail.google.com gmail.com outlook.live.com outlook.com mail.yahoo.com protonmail.com proton.me zendesk.com freshdesk.com freshservice.com "
    "helpscout.net helpscoutdocs.com intercom.com intercom.io statuspage.io atlassian.net google-analytics.com googletagmanager.com "
    "doubleclick.net facebook.net hotjar.com clarity.ms apps.apple.com play.google.com addthis.com sharethis.com disqus.com"
).split()


def website_url(raw: str) -> str:
    """L1: an absolute http or https URL, or an error."""
    text = raw.strip()
    if text.startswith("//"):
        text = "https:" + text
    elif "://" not in text:
        text = "https://" + text
    parts = urlsplit(text)
    if parts.scheme.lower() not in ("http", "https") or not parts.hostname:
        raise ValueError(f"no website: {raw!r}")
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path or "/", parts.query, parts.fragment))


def resolve(href: str, base: str) -> str | None:
    """L2: absolute, http or https, without fragment; None for what is no page."""
    try:
        parts = urlsplit(urljoin(base, href.strip()))
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return None
    return urlunsplit((parts.scheme, parts.netloc.lower(), parts.path or "/", parts.query, ""))


def canonical(url: str) -> str:
    """L3."""
    return url.partition("#")[0].rstrip("/")


def origin(url: str) -> str:
    """L4."""
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}/"


def sitemap_seeds(start: str) -> list[str]:
    """The two usual names at the origin and in the start's folder."""
    top = origin(start)
    folder = urljoin(start, ".")
    return list(dict.fromkeys(base + name for base in (top, folder if folder.startswith("http") else top) for name in ("sitemap.xml", "sitemap_index.xml")))


def robots_sitemaps(body: str, base: str) -> list[str]:
    """L6."""
    out = []
    for line in body.splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        if colon and key.strip().lower() == "sitemap" and value.strip():
            out.append(urljoin(base, value.strip()))
    return out


def document_base(requested: str, final: str) -> str:
    """A redirect that only drops the last slash doesn't count."""
    return requested if requested.endswith("/") and requested.rstrip("/") == final else final


def in_scope(url: str, start: str) -> bool:
    """Host and port are the same, and the path is that of the start or below it."""
    try:
        a, b = urlsplit(url), urlsplit(start)
        ports = [p.port or {"http": 80, "https": 443}.get(p.scheme) for p in (a, b)]
    except ValueError:
        return False
    if (a.hostname or "").lower() != (b.hostname or "").lower() or ports[0] != ports[1]:
        return False
    top = b.path.rstrip("/")
    return not top or a.path.rstrip("/") == top or a.path.startswith(top + "/")


def ignored(host: str | None) -> bool:
    """D12."""
    h = (host or "").lower()
    return any(h == d or h.endswith("." + d) for d in IGNORED_DOMAINS)


def server_id(query: str) -> str | None:
    """The first one that isn't empty."""
    return next((v for k, v in parse_qsl(query) if k == "server_id" and v), None)


def host_column(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_column(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical_column(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def origin_column(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"))


def ignored_column(host: Column) -> Column:
    return F.exists(F.array(*map(F.lit, IGNORED_DOMAINS)), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))


def scope_column(url: Column, start: str) -> Column:
    """in_scope() for one start and URLs with the usual ports."""
    parts = urlsplit(start)
    top = parts.path.rstrip("/")
    path = path_column(url)
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*:?([0-9]*)", 1)
    own = F.when(port != "", port).when(url.startswith("https:"), "443").otherwise("80")
    same = (host_column(url) == (parts.hostname or "").lower()) & (own == str(parts.port or (443 if parts.scheme == "https" else 80)))
    return same & (F.lit(not top) | (F.regexp_replace(path, "/+$", "") == top) | path.startswith(top + "/"))


def depth_column(url: Column) -> Column:
    """Parts of the path."""
    return F.size(F.filter(F.split(path_column(url), "/"), lambda x: x != ""))


def website_key(url: Column, group: Column, time: Column) -> Column:
    """Compact JSON list."""
    return F.to_json(F.array(url, group, time))


@F.pandas_udf(T.StringType())
def resolve_udf(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or b is None else resolve(h, b) for h, b in zip(href, base, strict=True)], dtype=object)
