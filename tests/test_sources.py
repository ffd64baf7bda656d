"""Loaders, HTML, crawl, code chunkers."""

import io
import zipfile

import pandas as pd
import pytest

from sparkloom.operators.chunk import web_chunks
from sparkloom.sources import crawl, html, loaders
from sparkloom.sources.code.dispatch import chunk_code, code_chunks, embedding_text, metadata
from sparkloom.sources.code.sql import strip_sql_comments

PAGE = """<html><head><title> Guide </title></head><body><nav><a href="/home">Home page</a></nav><h1>Guide</h1><p>Hello <a href="intro">Introduction</a></p>
<h2>Intro</h2><ul><li>one</li><li>two <p>inner</p></li></ul><pre class="language-py">x = 1</pre><script>no()</script><h2>Empty</h2></body></html>"""


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_sections():
    title, found = html.sections(PAGE, "https://h/docs/")
    assert title == "Guide" and [s["heading_path"] for s in found] == [["Guide"], ["Guide", "Intro"]]
    assert found[0]["content"] == "Hello Introduction" and found[0]["links"] == [{"href": "https://h/docs/intro", "anchor_text": "Introduction"}]
    assert found[1]["content"] == "one\ninner" and found[1]["code_blocks"] == [{"raw": "x = 1", "language": "py"}]
    assert html.navigation_links(PAGE, "https://h/") == [{"href": "https://h/home", "anchor_text": "Home page"}]
    assert html.loader_text(PAGE) == "Guide Hello Introduction Intro one two inner inner x = 1 Empty"
    chunks = web_chunks("https://h/docs/", PAGE, "g", "t")
    assert [c["content_type"] for c in chunks] == ["prose", "code"] and chunks[0]["next_chunk_id"] == chunks[1]["id"] and chunks[1]["prev_chunk_id"] == chunks[0]["id"] and chunks[0]["prev_chunk_id"] is None
    assert chunks[0]["links"] == [{"anchor_text": "Introduction", "href": "https://h/docs/intro"}] and chunks[0]["website_key"] == '["https://h/docs/","g","t"]'


def test_sitemaps():
    assert html.parse_sitemap('<urlset><url><loc>https://h/a?x=1&amp;y</loc><image:image xmlns:image="i"><image:loc>https://h/i.png</image:loc></image:image></url></urlset>') == (False, ["https://h/a?x=1&y"])
    assert html.parse_sitemap("<sitemapindex><sitemap><loc>s.xml</loc></sitemap></sitemapindex>") == (True, ["s.xml"])
    assert html.parse_sitemap("<urlset><url>") is None and html.parse_sitemap("<urlset></urlset>") is None
    site = pd.DataFrame({"url": ["https://h/robots.txt", "https://h/i.xml", "https://h/u.xml"], "body": [b"Sitemap: https://h/i.xml", b"<sitemapindex><sitemap><loc>https://h/u.xml</loc></sitemap></sitemapindex>", b"<urlset><url><loc>https://h/docs/a</loc></url><url><loc>https://h/other</loc></url></urlset>"]})
    assert crawl.discover_sitemaps(crawl.site_fetcher(site), "https://h/docs") == ["https://h/docs/a"]


def test_crawl(spark):
    link = lambda *xs: "".join(f'<a href="{x}">x</a>' for x in xs)
    site = spark.createDataFrame([("https://h/d/", link("a", "b", "https://x.com/", "/out")), ("https://h/d/a", link("c", "/d/")), ("https://h/d/b", link("c", "e")), ("https://h/d/c", link("f"))], "url string, html string")
    got = [(r.url, r.depth) for r in crawl.crawl(spark, site, "https://h/d/", 2).orderBy("pos").collect()]
    assert got == [("https://h/d/", 0), ("https://h/d/a", 1), ("https://h/d/b", 1), ("https://h/d/c", 2), ("https://h/d/e", 2)]
    assert crawl.crawl(spark, site, "https://h/d/", 2, max_pages=1).count() == 3
    with pytest.raises(crawl.Cancelled):
        crawl.crawl(spark, site, "https://h/d/", 2, cancelled=lambda: True)


def test_loaders(spark):
    xlsx = zipped(**{"xl__workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl___rels__workbook.xml.rels".replace("___", "__"): "", "xl__sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>a</t></si></sst>', "xl__worksheets__s.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(xlsx)) as old, zipfile.ZipFile(out, "w") as new:
        for n in old.namelist():
            if not n.endswith(".rels"):
                new.writestr(n, old.read(n))
        new.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
    docx = zipped(word__document_xml="x")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = zipped(**{"word__document.xml": f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:document>'})
    odt = zipped(**{"content.xml": "<a><b> p1 </b><b>p2</b></a>"})
    pdf = b"1 0 obj <</Type /Page /Contents 2 0 R>> endobj 2 0 obj <<>> stream\nBT (Hi \\(x\\)) Tj ET\nendstream endobj 3 0 obj <</Type /Page>> endobj"
    files = [
        ("a.txt", b"hello"), ("b.txt", b"  "), ("c.csv", b"n,a\nx,1,9\n\ny\n"), ("d.json", b'{"b":1,"a":[2]}'), ("e.json", b"{oops"), ("f.xml", b"<r><t> a </t><t>b</t><bad"), ("g.html", PAGE.encode()),
        ("h.odt", odt), ("i.xlsx", out.getvalue()), ("j.docx", docx), ("k.png", b"x"), ("l.xls", b"x"), ("m.docx", b"broken"), ("n.pdf", pdf), ("README", b"r"),
    ]
    rows = loaders.load_files(spark.createDataFrame(files, "path string, content binary")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.file_name, []).append(r)
    text = {k: [r.content for r in v] for k, v in by.items()}
    assert text["a.txt"] == ["hello"] and "b.txt" not in by and "k.png" not in by and text["README"] == ["r"]
    assert text["c.csv"] == ["row 1: \n0: n: x\n1: a: 1", "row 2: \n0: n: y"] and by["c.csv"][1].metadata == {"source": "c.csv", "row": "2"}
    assert text["d.json"] == ['{\n  "a": [\n    2\n  ],\n  "b": 1\n}'] and text["e.json"] == ['"{oops"'] and text["f.xml"] == ["a b"]
    assert text["h.odt"] == ["p1 p2"] and text["i.xlsx"] == ["Sheet: S\na\t\t3"] and text["j.docx"] == ["one\ntwo"] and by["j.docx"][0].doc_type == "docx"
    assert by["l.xls"][0].error and by["m.docx"][0].error and by["n.pdf"][0].page == 0 and "Hi (x)" in text["n.pdf"][0]


def test_zip_and_encodings():
    z = zipped(**{"src__a.py": "x", "..__evil.py": "y", "node_modules__b.js": "z"})
    assert [n for n, _ in loaders.unzip(z)] == ["src/a.py"]
    for data in ("é".encode("utf-16"), b"\xfe\xff" + "é".encode("utf-16-be"), b"\xef\xbb\xbf" + "é".encode(), "é".encode()):
        assert loaders.decode_source(data) == "é"
    assert loaders.decode_source("abc".encode("utf-16-le")) == "abc"


SOURCES = {
    "a.c": ("#include <x.h>\n#include \"y.h\"\nstruct S { int a; };\n/* no { */\nstatic int add(int a, char *b) { if (a) { return 1; } return 0; }\n", {("C", "function", "add"), ("Generic", "remainder", None)}),
    "a.cpp": ("namespace N {\nclass A {\npublic:\n  int f(int x) { return x; }\n};\nint A::g() const { return 2; }\n}\n", {("Cpp", "class", None), ("Cpp", "function", "f"), ("Cpp", "function", "g"), ("Generic", "remainder", None)}),
    "a.cs": ("using System;\nnamespace N;\npublic interface I { void M(); }\npublic class C {\n  public int P { get; set; }\n  public async Task<int> F(int a) { return a; }\n}\npublic record R(int X);\n", {("CSharp", "interface", None), ("CSharp", "class", None), ("CSharp", "method", "F"), ("CSharp", "record", None)}),
    "A.java": ("package p.q;\nimport java.util.List;\npublic class A {\n  A() { }\n  @Override\n  public List<String> f(final int x) throws E { return null; }\n  enum K { X }\n}\n", {("Java", "class", None), ("Java", "constructor", "A"), ("Java", "method", "f"), ("Java", "enum", None), ("Generic", "remainder", None)}),
    "a.js": ("import x from 'mod';\nconst y = require('other');\nasync function f(a, b = 1) { return `{${a}}`; }\nconst g = async (x) => { return x; };\nclass K { *m() { yield 1; } }\n", {("JavaScript", "function", "f"), ("JavaScript", "function", "g"), ("JavaScript", "method", "m"), ("Generic", "remainder", None)}),
    "a.ts": ("export interface I { a: string }\nexport type T = 'a' | 'b';\nenum E { A }\nexport function f(a: string, b?: number): Promise<void> { return null; }\n", {("TypeScript", "interface", None), ("TypeScript", "type", None), ("TypeScript", "enum", None), ("TypeScript", "function", "f")}),
    "a.tsx": ("import { useState } from 'react';\nexport function Card({ title, n = 1 }) {\n  const [x, setX] = useState(0);\n  function click() { setX(1); }\n  return (<div onClick={click}>{title}</div>);\n}\nconst useThing = () => { return useState(1); };\nfunction helper() { return 1; }\n", {("React", "component", None), ("React", "inner_function", None), ("React", "hook", None), ("Generic", "remainder", None)}),
    "a.rs": ("use std::fmt;\npub struct W<T>(pub T);\nenum E { A }\ntrait T { fn t(&self) { } }\nimpl<T> fmt::Display for W<T> {\n  fn fmt<'a>(&self, f: &'a mut F) -> fmt::Result { Ok(()) }\n}\nconst X: i32 = 1;\n", {("Rust", "struct", None), ("Rust", "enum", None), ("Rust", "trait", None), ("Rust", "function", "t"), ("Rust", "function", "fmt"), ("Generic", "remainder", None)}),
    "a.py": ("import os\nfrom . import y\n@deco\nclass C(Base):\n    x: int = 1\n    def f(self, a: int, *b) -> str:\n        yield a\nsq = lambda v: v\ntype T = int\nprint(1)\n", {("Python", "class", None), ("Python", "method", "f"), ("Python", "lambda", "sq"), ("Python", "type_alias", None), ("Python", "remainder", None)}),
    "a.sql": ("USE db\nGO\n-- c\nCREATE TABLE [s].[t] (a INT);\nALTER TABLE s.t ADD b INT;\nSET x = 1;\nCREATE FUNCTION f() RETURNS INT AS $$ BEGIN; RETURN 1; END; $$ LANGUAGE plpgsql;\nalter table S.T drop c;\nGRANT SELECT ON s.t TO u;\n", {("Sql", "CREATE TABLE", None), ("Sql", "CREATE FUNCTION", None), ("Sql", "ALTER TABLE", None), ("Sql", "GRANT", None)}),
}


@pytest.mark.parametrize("name", SOURCES)
def test_code(name):
    text, want = SOURCES[name]
    rows = code_chunks(name, text.encode(), "repo", "t")
    assert {(r["kind"], r["type"], r["function_name"]) for r in rows} == want
    for r in rows:
        assert r["id"].startswith(f"{name}-") and metadata(r)["repo_name"] == "repo" and "Code:\n" in embedding_text(r)


def test_code_details():
    by = {r["function_name"]: r for n in ("a.c", "a.cpp", "a.cs", "A.java", "a.ts", "a.rs", "a.py") for r in code_chunks(n, SOURCES[n][0].encode()) if r["function_name"]}
    assert by["add"]["parameters"] == [{"name": "a", "type": "int"}, {"name": "b", "type": "char *"}] and by["add"]["dependencies"] == ["x.h", "y.h"]
    assert by["g"]["class_name"] == "A" and by["g"]["namespace"] == "N" and by["F"]["class_name"] == "C" and by["F"]["return_type"] == "Task<int>"
    assert by["fmt"]["class_name"] == "W<T>" and by["fmt"]["return_type"] == "fmt::Result"
    merged = [r for r in code_chunks("a.sql", SOURCES["a.sql"][0].encode()) if r["type"] == "ALTER TABLE"]
    assert len(merged) == 1 and merged[0]["code"].count("\n\n") == 1 and merged[0]["database_name"] == "db"
    react = {r["component_name"]: r for r in code_chunks("a.tsx", SOURCES["a.tsx"][0].encode()) if r["component_name"]}
    assert react["Card"]["hooks_used"] == ["useState"] and react["Card"]["props"] == ["title", "n"] and react["click"]["parent_component"] == "Card"
    assert strip_sql_comments("a -- x\n'--' /* /* */ */ $$--$$") == "a \n'--'   $$--$$"
    assert code_chunks("a.py", b"") == [] and code_chunks("x.bin", b"a\0b") == [] and [r["kind"] for r in code_chunks("bad.py", b"def (")] == ["Generic"]


def test_code_table(spark):
    files = spark.createDataFrame([(n, t.encode()) for n, (t, _) in SOURCES.items()] + [("node_modules/x.js", b"function f() { }")], "path string, content binary")
    got = chunk_code(files, "r", "t").collect()
    assert {r.file_name for r in got} == set(SOURCES) and all(r.repo_name == "r" for r in got)


def test_sql_statements_take_linear_time():
    import time

    from sparkloom.sources.code.sql import object_name, sql

    body = "CREATE PROCEDURE p AS\nBEGIN\n" + "  UPDATE t SET a = a + 1 WHERE b = 'x; y';\n" * 24_000 + "END;\nCREATE TABLE z (a int);\n"
    began = time.process_time()
    assert [r["object_name"] for r in sql("x.sql", body)] == ["p", "z"]
    assert time.process_time() - began < 2
    assert object_name("CREATE OR REPLACE PUBLIC SYNONYM s.t FOR u;") == ("s", "t")
    assert object_name("grant select, insert on [dbo].[Orders] to x") == ("dbo", "Orders")
    assert object_name("DROP POLICY IF EXISTS p1 ON t;") == (None, "p1")
    assert object_name("ALTER TABLE t ADD c int") == (None, "t")
    assert object_name("CREATE TEMPORARY TABLE t (a int)") == (None, None)
