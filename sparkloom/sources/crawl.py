"""Sitemap discovery and breadth-first crawl over a table of pages (A16-A18, M8, M9, Q11, Q12): each level is a join and an anti-join."""

from __future__ import annotations

import gzip
import re
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import urls
from sparkloom.operators.chunk import arrow_lists
from sparkloom.sources import html as hx

MAX_PAGES, MAX_SITEMAPS, MAX_LISTED, MAX_SITEMAP_BYTES = 1000, 512, 250_000, 50 << 20


class Cancelled(RuntimeError):
    """The crawl was told to stop."""


def sitemap_body(data: bytes) -> str:
    """Plain or gzip, of a bounded size."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if len(data) > MAX_SITEMAP_BYTES:
        raise ValueError("the sitemap is too large")
    return data.decode("utf-8", "replace")


def discover_sitemaps(fetch: Callable[[str], bytes | None], start: str, body: str | None = None) -> list[str]:
    """URLs that a site's sitemaps list, sorted, each once; a worklist with a bound on sitemaps and URLs."""
    todo = urls.sitemap_seeds(start)
    if robots := fetch(urls.origin(start) + "robots.txt"):
        todo += urls.robots_sitemaps(robots.decode("utf-8", "replace"), urls.origin(start))
    if body:
        todo += hx.head_sitemaps(body, start)
    seen, found = set(), set()
    while todo and len(seen) < MAX_SITEMAPS and len(found) < MAX_LISTED:
        at = todo.pop(0)
        if urls.canonical(at) in seen:
            continue
        seen.add(urls.canonical(at))
        data = fetch(at)
        if data is None:
            continue
        text = sitemap_body(data)
        parsed = hx.parse_sitemap(text)
        if parsed and parsed[0]:
            todo += [x for u in parsed[1] if (x := urls.resolve(u, at))]
        else:
            found |= {x for u in (parsed[1] if parsed else hx.text_sitemap(text)) if (x := urls.resolve(u, at)) and urls.in_scope(x, start)}
    return sorted(found)[:MAX_LISTED]


def _checkpoints(spark: SparkSession) -> str:
    """The session's folder for checkpoints; without one, a folder of this machine for local masters."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="sparkloom-crawl-")


def crawl(spark: SparkSession, pages: DataFrame, start: str, depth: int, listed: list[str] = (), max_pages: int = MAX_PAGES, cancelled: Callable[[], bool] = lambda: False) -> DataFrame:
    """M9: (url, depth, pos) in order of discovery, of pages (url, html).

    URLs of sitemaps are listed first and fetched last. A page at a depth below the limit is expanded: its links are listed, fetched
    or not. `max_pages` bounds the fetches, 0 doesn't. Every level joins the frontier with the pages and takes away what was seen.
    """
    start = urls.website_url(start)
    site = pages.withColumn("key", urls.canonical_column(F.col("url"))).dropDuplicates(["key"]).select("key", "html")
    schema = "url string, key string, depth int, pos bigint"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_checkpoints(spark))
    seeds = list(dict.fromkeys([*listed, start]))
    seen = spark.createDataFrame([(u, urls.canonical(u), 0, i) for i, u in enumerate(seeds)], schema).dropDuplicates(["key"])
    out, frontier, fetched = seen, seen, 0

    links = arrow_lists(lambda html, url: hx.page_links(html, url, start) if html else [], "array<string>")
    for level in range(depth):
        if cancelled():
            raise Cancelled("website crawl cancelled")
        work = frontier.orderBy("pos")
        if max_pages:
            work = work.limit(max(0, max_pages - fetched))
        got = work.join(site, "key").select("pos", F.posexplode(links("html", "url")).alias("i", "url"))
        new = got.withColumn("key", urls.canonical_column(F.col("url"))).groupBy("key").agg(F.min_by("url", F.struct("pos", "i")).alias("url"), F.min(F.struct("pos", "i")).alias("at")).join(out.select("key"), "key", "left_anti")
        fetched += work.count()
        base = out.count()
        place = F.row_number().over(W.orderBy("at"))  # one level of one site
        frontier = new.select("url", "key", F.lit(level + 1).alias("depth"), (F.lit(base) + place - 1).cast("bigint").alias("pos")).checkpoint()
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return out.select("url", "depth", "pos")


def site_fetcher(pages: pd.DataFrame) -> Callable[[str], bytes | None]:
    """Fetches from a small table (url, body) instead of the network."""
    by_key = {urls.canonical(u): b for u, b in zip(pages["url"], pages["body"], strict=True)}
    return lambda u: by_key.get(urls.canonical(u))


def http_fetch(url: str, timeout: float = 3.0, user_agent: str = "Mozilla/5.0 (X11; Linux x86_64)") -> bytes | None:
    """The body of a page that answers with success, else None."""
    from urllib.error import URLError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": user_agent}), timeout=timeout) as r:  # noqa: S310
            return r.read() if 200 <= r.status < 300 else None
    except (URLError, TimeoutError, ValueError):
        return None


def fetch_pages(wanted: DataFrame, fetch: Callable[[str], bytes | None] = http_fetch) -> DataFrame:
    """Q12: (pos, url, body) of a table (pos, url), many at a time by partitions; `fetch` may render pages."""

    def run(batches):
        for batch in batches:
            yield batch.assign(body=[fetch(u) for u in batch["url"]])[["pos", "url", "body"]]

    return wanted.select("pos", "url").mapInPandas(run, "pos bigint, url string, body binary").orderBy("pos")
