"""Chunking: text, code and markdown splitters by tokens, merging, byte windows, chunks of web pages."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import urls
from sparkloom.functions.text import MAX_CHUNK_CHARS, content_hash, hard_split
from sparkloom.schema import struct
from sparkloom.sources import html as hx

TEXT_TOKENS, TEXT_OVERLAP = 768, 50
CODE_TOKENS, CODE_OVERLAP = 768, 64
MERGE_TOKENS = 100
_LEVELS = [r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?]) +(?=\S)", r"(?<=\s)(?=\S)"]
_MARKDOWN = r"(?m)^(?=#{1,6}\s)"


def approximate_tokens(text: str) -> int:
    """A pluggable counter's default: a token is four bytes."""
    return -(-len(text.encode()) // 4)


def _split_at(pattern: str, text: str) -> list[str]:
    cuts = [0, *(m.start() if m.start() == m.end() else m.end() for m in re.finditer(pattern, text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def _fenced(text: str) -> list[str]:
    """Markdown in blocks: headings start one, fences are kept whole."""
    blocks, inside = [""], False
    for line in text.splitlines(keepends=True):
        fence = line.lstrip().startswith(("```", "~~~"))
        if not inside and (fence or re.match(r"#{1,6}\s", line)) and blocks[-1]:
            blocks.append("")
        blocks[-1] += line
        if fence:
            inside = not inside
            if not inside:
                blocks.append("")
    return [b for b in blocks if b]


def split_text(text: str, size: int = TEXT_TOKENS, overlap: int = TEXT_OVERLAP, count: Callable[[str], int] = approximate_tokens, markdown: bool = False) -> list[str]:
    """Pieces of at most `size` tokens, cut at the highest level that fits: paragraph, line, sentence, word, character.

    Pieces are as long as they can be. A piece starts with up to `overlap` tokens of the words before it; nothing else repeats,
    nothing but the ends' white space is lost, and a heading's line is never cut where a line fits.
    """

    def atoms(part: str, level: int) -> list[str]:
        if count(part) <= size - overlap or len(part) < 2:
            return [part]
        while level < len(_LEVELS):
            parts = _split_at(_LEVELS[level], part)
            if len(parts) > 1:
                return [x for p in parts for x in atoms(p, level + 1)]
            level += 1
        half = len(part) // 2
        return atoms(part[:half], level) + atoms(part[half:], level)

    out, held, tail = [], "", ""
    for atom in [a for b in (_fenced(text) if markdown else [text]) for a in atoms(b, 0)]:
        starts_block = markdown and re.match(r"#{1,6}\s", atom)
        if held and (count(tail + held + atom) > size or starts_block and count(held) > size // 2):
            out.append(tail + held)
            words = re.findall(r"\s*\S+\s*\Z|\s*\S+", held)
            tail = ""
            while words and count(words[-1] + tail) <= overlap:
                tail = words.pop() + tail
            if tail == held or count(tail + atom) > size:
                tail = ""
            held = ""
        held += atom
    return [x for x in (p.strip() for p in [*out, tail + held]) if x]


def merge_small(chunks: list[str], tokens: int) -> list[str]:
    """Chunks joined until they have four bytes a token; the rest is a chunk of its own."""
    out, held = [], None
    for c in chunks:
        held = c if held is None else held + "\n" + c
        if len(held.encode()) >= 4 * tokens:
            out.append(held)
            held = None
    return out if held is None else [*out, held]


def merge_small_column(chunks: Column, tokens: int) -> Column:
    """N7 as a fold inside the engine."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def add(s: Column, c: Column) -> Column:
        held = F.when(s["held"].isNull(), c).otherwise(F.concat(s["held"], F.lit("\n"), c))
        full = F.octet_length(held) >= 4 * tokens
        return F.struct(F.when(full, F.concat(s["done"], F.array(held))).otherwise(s["done"]).alias("done"), F.when(~full, held).alias("held"))

    return F.aggregate(chunks, start, add, lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["held"]))))


def byte_windows(text: str, size: int) -> list[str]:
    """Windows of at most 4 x size bytes that end before white space where there is some; joined, they are the text."""
    data, most = text.encode(), 4 * size
    if size == 0 or len(data) <= most:
        return [text]
    out, start = [], 0
    while start < len(data):
        end = min(start + most, len(data))
        while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == start:
            end += 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        cut = end
        while start < cut < len(data) and data[cut] not in b" \t\n\r\x0c":
            cut -= 1
        cut = end if cut == start else cut
        out.append(data[start:cut].decode())
        start = cut
    return out


def arrow_lists(f: Callable, kind: str):
    """A column function of lists from one of Python rows, over batches of pandas series."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*(c.where(c.notna(), None) for c in columns), strict=True)], dtype=object)

    return run


def chunk_documents(docs: DataFrame, size: int = TEXT_TOKENS, overlap: int = TEXT_OVERLAP, count: Callable[[str], int] = approximate_tokens) -> DataFrame:
    """Of (file_name, doc_type, source_idx, page, content): pieces of at most 6000 characters, indexed over all parts of a file.

    Other columns, such as a part's metadata, are inherited by its pieces.
    """
    pieces = arrow_lists(lambda content, doc_type: split_text(content or "", size, overlap, count, doc_type in ("md", "mdx")) or [content or ""], "array<string>")
    own = [c for c in docs.columns if c not in ("file_name", "doc_type", "page", "source_idx", "content")]
    split = docs.withColumn("pieces", F.flatten(F.transform(pieces("content", "doc_type"), lambda p: hard_split(p, MAX_CHUNK_CHARS))))
    rows = split.select("file_name", "doc_type", "page", "source_idx", *own, F.posexplode("pieces").alias("piece_idx", "content"))
    place = W.partitionBy("file_name").orderBy("source_idx", "piece_idx")
    return rows.withColumn("chunk_index", (F.row_number().over(place) - 1).cast("bigint")).drop("piece_idx", "source_idx")


def running_offsets(rows: DataFrame, file: str, order: str, n: str, block: int = 4096) -> DataFrame:
    """Rows with `offset`, the sum of n over all rows before them in their file, by a numeric order.

    Blocks of consecutive orders have totals; those are summed along a file, a row per block, and rows inside their block: a file in
    a third of all rows is many tasks' work.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block))
    totals = blocked.groupBy(file, "_block").agg(F.sum(n).alias("_total"))
    along = W.partitionBy(file).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(file, "_block", F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_before"))
    inside = W.partitionBy(file, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    found = blocked.join(before, (blocked[file].eqNullSafe(before[file])) & (blocked["_block"] == before["_block"])).select(blocked["*"], "_before")
    return found.withColumn("offset", F.col("_before") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("_block", "_before")


def neighbours(chunks: DataFrame, page: str = "page_id", order: str = "chunk_index", id_col: str = "id") -> DataFrame:
    """Ids of the chunks before and after within a page, how many there are, and their hashes."""
    w = W.partitionBy(page).orderBy(order)
    return chunks.withColumns({
        "prev_chunk_id": F.lag(id_col).over(w), "next_chunk_id": F.lead(id_col).over(w), "total_chunks": F.count(F.lit(1)).over(W.partitionBy(page)), "chunk_hash": content_hash(F.col("content")),
    })


def first_links(links: DataFrame) -> DataFrame:
    """Of links (page_id, pos, href, anchor_text) with the same text the first."""
    w = W.partitionBy("page_id", "anchor_text").orderBy("pos")
    return links.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def matched_links(chunks: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose text a chunk of the same page contains, by text (the join is on the page, never across pages)."""
    both = chunks.join(first_links(links), "page_id", "left").withColumn("hit", F.coalesce(F.col("content").contains(F.col("anchor_text")), F.lit(False)))
    grouped = both.groupBy("page_id", "chunk_index").agg(F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("anchor_text", "href")))).alias("links"))
    return chunks.join(grouped, ["page_id", "chunk_index"], "left")


WEB_CHUNK = (
    "id string, url string, page_id string, page_title string, chunk_index bigint, content string, content_type string, language string, heading_path string, embedded_at string, website_key string, "
    "chunk_hash string, total_chunks bigint, prev_chunk_id string, next_chunk_id string, links array<struct<anchor_text string, href string>>, navigation_links array<struct<href string, anchor_text string>>"
)


def web_chunks(url: str, html: str, group: str, at: str, size: int = TEXT_TOKENS, split: Callable[[str], list[str]] | None = None) -> list[dict]:
    """Prose chunks of a page, then its code blocks, with everything a point's payload has."""
    title, found = hx.sections(html, url)
    if not found:
        return []
    nav = hx.navigation_links(html, url)
    by_text: dict[str, str] = {}
    for link in [*(x for s in found for x in s["links"]), *nav]:
        by_text.setdefault(link["anchor_text"], link["href"])
    full = "\n".join("\n".join(filter(None, (" > ".join(s["heading_path"]), s["content"]))) if s["heading_path"] else s["content"] for s in found)
    prose = split(full) if split else byte_windows(full, size)
    if len(prose) > 1:
        prose = merge_small(prose, MERGE_TOKENS)
    rows = [(c, "prose", None, title) for c in prose]
    rows += [(b["raw"], "code", b["language"] or None, " > ".join(s["heading_path"])) for s in found for b in s["code_blocks"]]
    page = str(uuid.uuid5(uuid.NAMESPACE_URL, url))
    ids = [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {at} {i}")) for i in range(len(rows))]
    key = json.dumps([url, group or "default", at], separators=(",", ":"), ensure_ascii=False)
    return [
        {
            "id": ids[i], "url": url, "page_id": page, "page_title": title, "chunk_index": i, "content": c, "content_type": kind, "language": lang, "heading_path": path, "embedded_at": at, "website_key": key,
            "chunk_hash": hashlib.sha256(c.encode()).hexdigest()[:16], "total_chunks": len(rows), "prev_chunk_id": ids[i - 1] if i else None, "next_chunk_id": ids[i + 1] if i + 1 < len(rows) else None,
            "links": [{"anchor_text": a, "href": h} for a, h in sorted(by_text.items()) if a in c], "navigation_links": nav,
        }
        for i, (c, kind, lang, path) in enumerate(rows)
    ]


def chunk_pages(pages: DataFrame, group: str, at: str, size: int = TEXT_TOKENS) -> DataFrame:
    """N9 over a table of pages (url, html); a page that can't be read is left out."""
    spec = f"array<struct<{WEB_CHUNK.replace(' string', ': string').replace(' bigint', ': bigint').replace(' array<', ': array<')}>>"

    def of_page(url, html):
        try:
            return web_chunks(urls.website_url(url), html or "", group, at, size)
        except (ValueError, AttributeError):  # no address, or none of a website
            return []

    chunks = arrow_lists(of_page, spec)
    return pages.select(F.explode(chunks("url", "html")).alias("c")).select("c.*")


def embedding_text(file_name: Column, doc_type: Column, page: Column, content: Column) -> Column:
    """C10."""
    return F.concat_ws("\n", F.concat(F.lit("File_name: "), file_name), F.concat(F.lit("Type: "), doc_type), F.concat(F.lit("Page: "), page.cast("string")), F.concat(F.lit("Content:\n"), content))


def merged_metadata(*maps: Column) -> Column:
    """Maps of strings, later ones win."""
    entries = F.concat(*(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))) for m in maps))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def storage_id(id_col: Column) -> Column:
    """An id that is a UUID stays, others get a new one."""
    return F.when(F.lower(id_col).rlike(r"^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"), id_col).otherwise(F.uuid())


def empty_chunks(spark) -> DataFrame:
    return spark.createDataFrame([], struct(WEB_CHUNK))
