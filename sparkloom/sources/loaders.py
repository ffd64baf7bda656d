"""Files to document chunks: one loader per format, chosen by extension (A1-A15), over the binary file source."""

from __future__ import annotations

import csv
import io
import json
import re
import shutil
import subprocess
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.paths import IMAGES, is_skipped
from sparkloom.sources import html as hx
from sparkloom.sources.workbooks import xls_sheets, xlsb_sheets

LOADED = "file_name string, doc_type string, source_idx int, page bigint, content string, metadata map<string,string>, error string"
Chunk = tuple[str, int | None, dict[str, str]]  # content, page, metadata


def decode_source(data: bytes) -> str:
    """By byte order mark, or by zero bytes at the second and fourth place; else UTF-8 with replacements."""
    if data[:2] == b"\xff\xfe":
        return data[2:].decode("utf-16-le", "replace")
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    if len(data) > 3 and data[1] == 0 == data[3]:
        return data.decode("utf-16-le", "replace")
    return data.decode("utf-8", "replace")


def text_chunks(data: bytes) -> list[Chunk]:
    """A2."""
    text = data.decode("utf-8", "replace")
    return [(text, None, {})] if text.strip() else []


def csv_chunks(data: bytes, name: str = "") -> list[Chunk]:
    """A3: a chunk per record; cells beyond the header are dropped."""
    rows = csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""))
    header = next(rows, None)
    out = []
    for n, row in enumerate((r for r in rows if r), 1) if header else ():
        lines = [f"{i}: {h}: {v}" for i, (h, v) in enumerate(zip(header, row, strict=False))]
        out.append((f"row {n}: \n" + "\n".join(lines), None, {"source": name, "row": str(n)}))
    return out


def json_chunks(data: bytes) -> list[Chunk]:
    """A4: pretty-printed with sorted keys; what is no JSON is one JSON string."""
    text = data.decode("utf-8", "replace")
    try:
        value = json.loads(text)
    except ValueError:
        value = text
    return [(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False), None, {})]


def _one(text: str) -> list[Chunk]:
    return [(text, None, {})] if text.strip() else []


def odt_chunks(data: bytes) -> list[Chunk]:
    """A7."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _one(hx.xml_text(z.read("content.xml")))


def docx_chunks(data: bytes) -> list[Chunk]:
    """A line per paragraph."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    parts = {f"{w}t": lambda e: e.text or "", f"{w}tab": lambda e: "\t", f"{w}br": lambda e: "\n"}
    return _one("\n".join("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts) for p in root.iter(f"{w}p")))


def _sheet(name: str, rows: list[list[str]]) -> list[Chunk]:
    body = "\n".join("\t".join(r) for r in rows)
    return [(f"Sheet: {name}\n{body}", None, {"sheet_name": name})] if body.strip() else []


def xlsx_chunks(data: bytes) -> list[Chunk]:
    """A8, of zip-and-XML workbooks: a chunk per sheet, cells parted by tabs."""
    m, r = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{m}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"):
            target = targets[sheet.get(f"{r}id")]
            rows = []
            for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{m}row"):
                cells: list[str] = []
                for c in row.iter(f"{m}c"):
                    letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                    at = len(cells)
                    if letters:
                        at = 0
                        for x in letters:
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    cells += [""] * (at - len(cells))
                    value = c.find(f"{m}v")
                    text = "" if value is None else value.text or ""
                    if c.get("t") == "s":
                        text = shared[int(text)]
                    elif c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{m}t"))
                    elif c.get("t") == "b":
                        text = "TRUE" if text == "1" else "FALSE"
                    cells.append(text)
                rows.append(cells)
            out += _sheet(sheet.get("name", ""), rows)
    return out


def _workbook(sheets: list[tuple[str, list[list[str]]]]) -> list[Chunk]:
    return [c for name, rows in sheets for c in _sheet(name, rows)]


def ods_chunks(data: bytes) -> list[Chunk]:
    """A8, of open document spreadsheets."""
    t, x = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    out = []
    for sheet in root.iter(f"{t}table"):
        rows = []
        for row in sheet.iter(f"{t}table-row"):
            cells = []
            for c in row.iter(f"{t}table-cell"):
                text = "\n".join("".join(p.itertext()) for p in c.iter(f"{x}p"))
                cells += [text] * (int(c.get(f"{t}number-columns-repeated", "1")) if text else 1)
            while cells and not cells[-1]:
                cells.pop()
            rows.append(cells)
        out += _sheet(sheet.get(f"{t}name", ""), rows)
    return out


_PDF_TEXT = re.compile(rb"\((?:\\.|[^\\()])*\)|\[|\]|(?<![A-Za-z])(?:Tj|TJ|Td|TD|T\*|ET|'|\")(?![A-Za-z])|-?\d+(?:\.\d+)?")


def _pdf_string(raw: bytes) -> str:
    out = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}.get(m[1], m[1]), raw[1:-1])
    return out.decode("utf-16-be", "replace")[1:] if out[:2] == b"\xfe\xff" else out.decode("latin-1")


def _pdf_content(stream: bytes) -> str:
    out: list[str] = []
    for m in _PDF_TEXT.finditer(stream):
        token = m[0]
        if token[:1] == b"(":
            out.append(_pdf_string(token))
        elif token in (b"Td", b"TD", b"T*", b"ET", b"'", b'"'):
            out.append("\n")
        elif token[:1] in b"-" and float(token) < -200:  # a wide gap between pieces of a line
            out.append(" ")
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


def pdf_pages(data: bytes) -> list[str]:
    """A10: the text of simply encoded pages, without a library; a page that can't be read is empty."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data)}

    def stream(n: int) -> bytes:
        body = objects.get(n, b"")
        m = re.search(rb"(?s)stream\r?\n(.*?)\r?\n?endstream", body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in body[: m.start()] else m[1]

    pages = []
    for _, body in sorted((n, b) for n, b in objects.items() if re.search(rb"/Type\s*/Page(?![A-Za-z])", b)):
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        try:
            pages.append(_pdf_content(b"\n".join(stream(int(n)) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1]))) if m else "")
        except zlib.error:
            pages.append("")
    return pages


def pdf_chunks(data: bytes) -> list[Chunk]:
    """A chunk per page with text; pages count from 0, blank ones too. pdftotext does it where it is installed."""
    pages: list[str] = []
    if tool := shutil.which("pdftotext"):
        got = subprocess.run([tool, "-layout", "-enc", "UTF-8", "-", "-"], input=data, capture_output=True, timeout=120)
        pages = got.stdout.decode("utf-8", "replace").split("\f") if got.returncode == 0 else []
    if not any(p.strip() for p in pages):
        pages = pdf_pages(data)
    out = [(p, i, {}) for i, p in enumerate(pages) if p.strip()]
    if not out:
        raise ValueError("no text in this PDF")
    return out


LOADERS = {
    "csv": csv_chunks, "json": json_chunks, "xml": lambda d: _one(hx.xml_text(d)), "html": lambda d: _one(hx.loader_text(d.decode("utf-8", "replace"))), "htm": lambda d: _one(hx.loader_text(d.decode("utf-8", "replace"))),
    "odt": odt_chunks, "xlsx": xlsx_chunks, "ods": ods_chunks, "xls": lambda d: _workbook(xls_sheets(d)), "xlsb": lambda d: _workbook(xlsb_sheets(d)), "pdf": pdf_chunks, "docx": docx_chunks, "doc": docx_chunks,
}
def load(name: str, data: bytes) -> tuple[str, list[Chunk]]:
    """A1: (document type, chunks) of one file. Unknown extensions are text; images give nothing."""
    base = name.replace("\\", "/").rpartition("/")[2]
    ext = base.rpartition(".")[2].lower() if "." in base else "txt"
    if ext in IMAGES:
        return ext, []
    if ext == "csv":
        return ext, csv_chunks(data, name)
    return "docx" if ext == "doc" else ext, LOADERS.get(ext, text_chunks)(data)


def unzip(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Members by name; absolute names and those that leave the folder are skipped, as are files that are never taken in."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            name = info.filename.replace("\\", "/")
            if info.is_dir() or name.startswith("/") or re.match(r"[A-Za-z]:", name) or ".." in name.split("/") or is_skipped(name):
                continue
            yield name, z.read(info)


def _loaded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, data in zip(batch["path"], batch["content"], strict=True):
            try:
                kind, chunks = load(path, bytes(data))
                rows += [(path, kind, i, page, text, meta, None) for i, (text, page, meta) in enumerate(chunks)]
            except Exception as e:  # noqa: BLE001  one bad file is reported, the others go on (Q8)
                rows.append((path, None, 0, None, None, {}, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["file_name", "doc_type", "source_idx", "page", "content", "metadata", "error"]).astype({"page": "Int64"})


def load_files(files: DataFrame) -> DataFrame:
    """Of (path, content) rows: a row per chunk, or one with an error for a file that can't be read."""
    return files.select("path", "content").mapInPandas(_loaded, LOADED)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder that are taken in, as (path, content)."""
    from sparkloom.functions.paths import skipped

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(~skipped(F.col("path"))).select("path", "content")


def read_zips(zips: DataFrame) -> DataFrame:
    """Of (path, content) rows of archives, their members as (zip, path, content)."""

    def members(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                for name, body in unzip(bytes(data)):
                    yield pd.DataFrame([(path, name, body)], columns=["zip", "path", "content"])

    return zips.select("path", "content").mapInPandas(members, "zip string, path string, content binary")
