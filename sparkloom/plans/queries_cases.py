"""Operators that read structure (pages, files, source code, names) over tables of inline cases.

A case is a label, arguments and the values that the operator's definition gives for them, in order. The query runs the operator
over the arguments, as a table through Arrow; the SQL twin lists the values.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkloom.functions import limits, paths, stem, urls
from sparkloom.functions import text as tx
from sparkloom.operators import bm25, catalog, chunk, collection, dense, fusion, ingest, jobs, views
from sparkloom.plans.common import t
from sparkloom.plans.predicate import FilterError, filtered
from sparkloom.plans.search import Engine, Request, formatted, rows_of_batches, scope_requests
from sparkloom.schema import JOB_EVENT, migrated
from sparkloom.sources import crawl, html, loaders
from sparkloom.sources.code import common, dispatch, sql
from sparkloom.streaming import tracker

Case = tuple[str, list, list]


def text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def outcome(f: Callable) -> Callable:
    """Errors are values too."""

    def run(*args):
        try:
            return f(*args)
        except ValueError:
            return ["error"]

    return run


def one(f: Callable) -> Callable:
    return lambda *args: [f(*args)]


def zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def loaded(name: str, body: str) -> list:
    return [[c, page, meta] if meta or page is not None else c for c, page, meta in loaders.load(name, body.encode("latin-1"))[1]]


def names(path: str, code: str) -> list:
    """Of each chunk: type, class, function or object."""
    return [" ".join(filter(None, (r["type"], r["class_name"], r["interface_name"], r["function_name"] or r["component_name"] or r["object_name"] or r["alias_name"]))) for r in dispatch.code_chunks(path, code.encode())]


def field_of(path: str, code: str, *keys: str) -> list:
    return [text({k: r[k] for k in keys}) for r in dispatch.code_chunks(path, code.encode()) if r["kind"] != "Generic"]


def registry_runs(name: str | None, params: str | None) -> list:
    """Events and end of a job under a registry with a task that works, one that fails and one that reports out of range."""
    seen: list = []
    r = jobs.Registry()
    r.register("echo", lambda p, progress: (progress(250, "all"), str(p.get("x")))[1])
    r.register("boom", lambda p, progress: 1 // 0)
    end = r.run({"job_id": "j", "task_name": name, "task_params": params}, seen.append)
    return [f"{e['event']} {e.get('percentage')}" for e in seen] + [f"{end['status']} {end['result']} {end['error']}"]


def anchors(*hrefs: str) -> str:
    return "".join(f'<a href="{h}">{h}</a>' for h in hrefs)


PAGE = """<html><head><title> Guide </title></head><body><nav><a href="/home">Home page</a><a href="/home">Home page</a></nav><p>Before <b>all</b></p><h1>Guide</h1><p>Hello <a href="intro">Introduction</a> <a href="#">nowhere</a> <a href="x">abc</a></p>
<h2>Intro</h2><ul><li>one</li><li>two <p>inner</p></li></ul><pre class="language-py">x = 1</pre><pre><code class="a language-rs">fn</code></pre><script>no()</script><footer><p>foot</p></footer><h2>Empty</h2><h1>Last</h1><p>end</p></body></html>"""

C_CODE = '#include <x.h>\n#include "y.h"\n#include <x.h>\nstruct S { int a; };\nstatic int add(int a, char *b, ...) { if (a) { return 1; } return 0; }\nvoid *none(void) { return 0; }\n'
CPP_CODE = "namespace N {\nclass A {\npublic:\n  int f(int x) { return x; }\n};\nint A::g() const { return 2; }\n}\n"
CS_CODE = "using System;\nusing X = System.Text;\nnamespace N;\npublic interface I { void M(); }\npublic class C {\n  public int P { get; set; }\n  public async Task<int> F(int a) { return a; }\n}\npublic record R(int X);\npublic enum E { A }\n"
JAVA_CODE = "package p.q;\nimport java.util.List;\nimport static a.B.c;\npublic class A {\n  A() { }\n  public List<String> f(final int x) throws E { return null; }\n  enum K { X }\n}\ninterface J { void m(); }\n"
JS_CODE = "import x from 'mod';\nconst y = require('other');\nasync function f(a, b = 1) { return 1; }\nconst g = async (x) => { return x; };\nclass K { *m() { yield 1; } }\n"
TS_CODE = "export interface I { a: string }\nexport type T = 'a' | 'b';\nenum E { A }\nexport function f(a: string, b?: number): Promise<void> { return null; }\n"
TSX_CODE = "import { useState } from 'react';\nexport function Card({ title, n = 1 }) {\n  const [x, setX] = useState(0);\n  function click() { setX(1); }\n  return (<div onClick={click}>{title}</div>);\n}\nconst useThing = () => { return useState(1); };\nfunction helper() { return 1; }\n"
RS_CODE = "use std::fmt;\npub struct W<T>(pub T);\nenum E { A }\ntrait T { fn t(&self) { } }\nmod inner {\n  pub fn deep() { }\n}\nimpl<T> fmt::Display for W<T> {\n  fn fmt<'a>(&self, f: &'a mut F) -> fmt::Result { Ok(()) }\n}\n"
PY_CODE = "import os\nfrom . import y\nimport os\n@deco\nclass C(Base):\n    x: int = 1\n    def f(self, a: int, *b) -> str:\n        yield a\nasync def g():\n    pass\nsq = lambda v: v\ntype T = int\nprint(1)\n"
SQL_CODE = "USE db\nGO\n-- c\nCREATE TABLE [s].[t] (a INT);\nALTER TABLE s.t ADD b INT;\nSET x = 1;\nCREATE FUNCTION f() RETURNS INT AS $$ BEGIN; RETURN 1; END; $$ LANGUAGE plpgsql;\nalter table S.T drop c;\nGRANT SELECT ON s.t TO u;\nDELETE FROM s.t;\n"

CASES: dict[str, tuple[Callable, list[Case]]] = {
    # --- files ---
    "a1_by_extension": (outcome(lambda n, b: [loaders.load(n, b.encode())[0]]), [("txt", ["a.TXT", "x"], ["txt"]), ("none", ["dir/README", "x"], ["txt"]), ("unknown", ["a.zzz", "x"], ["zzz"]), ("no workbook", ["a.xls", "x"], ["error"])]),
    "a2_text": (loaded, [("text", ["a.txt", "hello\n"], ["hello\n"]), ("blank", ["a.md", " \n\t"], []), ("bad bytes", ["a.mdx", "a\xff"], ["a�"])]),
    "a3_csv": (loaded, [("ragged", ["c.csv", "n,a\nx,1,9\n\ny\n"], [["row 1: \n0: n: x\n1: a: 1", None, {"source": "c.csv", "row": "1"}], ["row 2: \n0: n: y", None, {"source": "c.csv", "row": "2"}]]), ("header only", ["d.csv", "n,a\n"], [])]),
    "a4_json": (loaded, [("object", ["d.json", '{"b":1,"a":[2]}'], ['{\n  "a": [\n    2\n  ],\n  "b": 1\n}']), ("broken", ["e.json", "{oops"], ['"{oops"']), ("scalar", ["f.json", "3"], ["3"])]),
    "a5_xml": (loaded, [("well formed", ["f.xml", "<r><t> a </t><t>b &amp; c</t></r>"], ["a b & c"]), ("cut short", ["g.xml", "<r><t> a </t><t>b</t><bad"], ["a b"])]),
    "a6_html": (loaded, [("noise and nested leaves", ["g.html", "<body><nav><p>menu</p></nav><h1>T</h1><ul><li>two <p>inner</p></li></ul><script>x</script><pre>c</pre></body>"], ["T two inner inner c"])]),
    "a7_odt": (lambda m: [c for c, _, _ in loaders.load("h.odt", zipped(m))[1]], [("two paragraphs", [{"content.xml": "<a><b> p1 </b><b>p2</b></a>", "meta.xml": "<x>no</x>"}], ["p1 p2"])]),
    "a11_docx": (lambda m: [[loaders.load("j.doc", zipped(m))[0], *(c for c, _, _ in loaders.load("j.doc", zipped(m))[1])]], [("two paragraphs", [{"word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:document>'}], [["docx", "one\ntwo"]])]),
    "a12_images": (loaded, [("png", ["k.png", "x"], []), ("jpeg", ["K.JPEG", "x"], []), ("jpg", ["k.jpg", "x"], []), ("gif is text", ["k.gif", "x"], ["x"])]),
    "a13_encodings": (one(lambda b: loaders.decode_source(bytes.fromhex(b))), [("utf-16 le", ["fffee900"], ["é"]), ("utf-16 be", ["feff00e9"], ["é"]), ("utf-8 mark", ["efbbbfc3a9"], ["é"]), ("zeros", ["61006200"], ["ab"]), ("plain", ["c3a9"], ["é"]), ("bad", ["61ff"], ["a�"])]),
    "a14_unzip": (lambda m: [[n, b.decode()] for n, b in loaders.unzip(zipped(m))], [("unsafe and skipped names", [{"src/b.py": "y", "src/a.py": "x", "../evil.py": "z", "/abs.py": "z", "node_modules/b.js": "z", "d/": ""}], [["src/a.py", "x"], ["src/b.py", "y"]])]),
    "q8_isolation": (lambda fs: pd.concat(loaders._loaded(iter([pd.DataFrame([(n, b.encode()) for n, b in fs], columns=["path", "content"])])))[["file_name", "error"]].apply(lambda r: f"{r.file_name} {'failed' if r.error else 'loaded'}", axis=1).tolist(), [("a bad file among good ones", [[["a.txt", "x"], ["b.docx", "broken"], ["c.txt", "y"]]], ["a.txt loaded", "b.docx failed", "c.txt loaded"])]),
    # --- pages ---
    "l1_website_url": (outcome(one(urls.website_url)), [("bare", ["  example.com/a "], ["https://example.com/a"]), ("no scheme", ["//h.com"], ["https://h.com/"]), ("http", ["http://H.com/X"], ["http://h.com/X"]), ("ftp", ["ftp://x"], ["error"]), ("no host", ["https://"], ["error"])]),
    "l2_resolve": (one(urls.resolve), [("relative", ["b", "https://h/a/"], ["https://h/a/b"]), ("fragment", ["#x", "https://h/a"], ["https://h/a"]), ("mail", ["mailto:x@y", "https://h/"], [None]), ("absolute path", ["/root?q=1#f", "https://h/a/b"], ["https://h/root?q=1"]), ("other host", ["//o.com/x", "https://h/"], ["https://o.com/x"]), ("up", ["../c", "https://h/a/b/d"], ["https://h/a/c"])]),
    "l5_sitemap_seeds": (urls.sitemap_seeds, [("folder", ["https://h/docs/guide"], ["https://h/sitemap.xml", "https://h/sitemap_index.xml", "https://h/docs/sitemap.xml", "https://h/docs/sitemap_index.xml"]), ("top", ["https://h/"], ["https://h/sitemap.xml", "https://h/sitemap_index.xml"])]),
    "l6_robots": (urls.robots_sitemaps, [("keys and comments", ["User-agent: *\nSITEMAP: /s.xml # c\n# Sitemap: /no.xml\nSitemap: https://o/x.xml\nsitemap:", "https://h/robots.txt"], ["https://h/s.xml", "https://o/x.xml"])]),
    "l7_head_sitemaps": (html.head_sitemaps, [("rel is a list", ['<link rel="alternate SITEMAP" href="/s.xml"><link rel="icon" href="i">', "https://h/a"], ["https://h/s.xml"])]),
    "l8_document_base": (one(urls.document_base), [("lost slash", ["https://h/docs/", "https://h/docs"], ["https://h/docs/"]), ("moved", ["https://h/a", "https://h/b/"], ["https://h/b/"])]),
    "l9_base_element": (one(lambda h, u: html.page_base(html.parse(h), u)), [("base", ['<base href="/x/">', "https://h/a"], ["https://h/x/"]), ("none", ["<p>x</p>", "https://h/a"], ["https://h/a"])]),
    "l11_server_id": (one(urls.server_id), [("first that isn't empty", ["a=1&server_id=&server_id=s%201+x"], ["s 1 x"]), ("none", ["a=1"], [None])]),
    "m1_sections_of_a_page": (lambda h: [[s["heading_path"], s["content"]] for s in html.sections(h, "https://h/docs/")[1]], [("guide", [PAGE], [[["Guide"], "Before all"], [["Guide"], "Hello Introduction nowhere abc"], [["Guide", "Intro"], "one\ninner"], [["Last"], "end"]])]),
    "m2_code_language": (lambda h: [[b["language"], b["raw"]] for s in html.sections(h)[1] for b in s["code_blocks"]], [("of pre and of code", [PAGE + "<pre>none</pre>"], [["py", "x = 1"], ["rs", "fn"], ["", "none"]])]),
    "m3_section_links": (lambda h: [[x["href"], x["anchor_text"]] for s in html.sections(h, "https://h/docs/")[1] for x in s["links"]], [("short and empty ones go", [PAGE], [["https://h/docs/intro", "Introduction"]])]),
    "m4_navigation_links": (lambda h: [[x["href"], x["anchor_text"]] for x in html.navigation_links(h, "https://h/")], [("nav, aside, role, data-nav", [PAGE + '<div role="navigation"><a href="b">Bbbb</a></div><aside><a href="c">Cccc</a></aside><div data-nav=""><a href="d">Dddd</a></div><div><a href="e">Eeee</a></div>'], [["https://h/home", "Home page"], ["https://h/b", "Bbbb"], ["https://h/c", "Cccc"], ["https://h/d", "Dddd"]])]),
    "m5_links_of_a_page": (html.page_links, [("scope, ignored hosts, other elements", ['<a href="a">x</a><area href="/docs/b"><link rel="next" href="c"><div data-href="d" data-url="/docs/e"></div><a href="/out">x</a><a href="https://x.com/">x</a><a href="a#f">x</a>', "https://h/docs/", "https://h/docs/"], ["https://h/docs/a", "https://h/docs/b", "https://h/docs/c", "https://h/docs/d", "https://h/docs/e"])]),
    "m6_sitemap": (one(html.parse_sitemap), [("urlset", ['<urlset><url><loc>https://h/a?x=1&amp;y</loc><image:image xmlns:image="i"><image:loc>https://h/i.png</image:loc></image:image></url></urlset>'], [[False, ["https://h/a?x=1&y"]]]), ("index", ["<sitemapindex><sitemap><loc>s.xml</loc></sitemap></sitemapindex>"], [[True, ["s.xml"]]]), ("feed", ["<rss><channel><item><link>https://h/p</link></item></channel></rss>"], [[False, ["https://h/p"]]]), ("malformed", ["<urlset><url>"], [None]), ("empty", ["<urlset></urlset>"], [None])]),
    "m7_text_sitemap": (html.text_sitemap, [("lines", [" https://h/a \nnot a url\nhttp://h/b"], ["https://h/a", "http://h/b"])]),
    "m8_discovery": (lambda site, start: crawl.discover_sitemaps(crawl.site_fetcher(pd.DataFrame([(u, b.encode()) for u, b in site], columns=["url", "body"])), start), [("robots, index, scope", [[["https://h/robots.txt", "Sitemap: https://h/i.xml"], ["https://h/i.xml", "<sitemapindex><sitemap><loc>https://h/u.xml</loc></sitemap><sitemap><loc>https://h/i.xml</loc></sitemap></sitemapindex>"], ["https://h/u.xml", "<urlset><url><loc>https://h/docs/b</loc></url><url><loc>https://h/docs/a</loc></url><url><loc>https://h/other</loc></url><url><loc>https://h/docs/a</loc></url></urlset>"]], "https://h/docs"], ["https://h/docs/a", "https://h/docs/b"])]),
    "d14_noise": (lambda h: [html.collapsed(n.text()) for n in html.parse(h).walk() if n.tag == "p" and not html.in_noise(n)], [("ancestors", ["<aside><div><p>a</p></div></aside><p>b</p><header><p>c</p></header><main><p>d</p></main>"], ["b", "d"])]),
    "d15_nested_leaves": (lambda h: [s["content"] for s in html.sections(h)[1]], [("an item with a paragraph", ["<ul><li>outer <p>inner</p></li><li>plain</li></ul>"], ["inner\nplain"])]),
    "d19_anchors": (lambda h: [x["anchor_text"] for s in html.sections(h)[1] for x in s["links"]], [("bytes, not characters", ['<p><a href="a">abc</a><a href="b">éé</a><a href="#">long enough</a><a href="">long enough</a><a href="c">four</a></p>'], ["éé", "four"])]),
    "n9_page_chunks": (lambda h: [[c["chunk_index"], c["content_type"], c["language"], c["heading_path"], c["content"], c["total_chunks"]] for c in chunk.web_chunks("https://h/docs/", h, "g", "t")], [("prose, then code", ["<title>T</title><h1>A</h1><p>text</p><pre class='language-c'>x</pre>"], [[0, "prose", None, "T", "A\ntext", 2], [1, "code", "c", "A", "x", 2]])]),
    "n8_byte_windows": (chunk.byte_windows, [("back to white space", ["aaa bbb ccc ddd", 2], ["aaa bbb", " ccc ddd"]), ("code points", ["éééééé", 1], ["éé", "éé", "éé"]), ("short", ["ab", 5], ["ab"])]),
    # --- splitting ---
    "n1_token_splitter": (lambda t, size, overlap: chunk.split_text(t, size, overlap, lambda x: len(x.split())), [("paragraphs", ["one two. Three four.\n\nFive six.", 4, 0], ["one two. Three four.", "Five six."]), ("sentences", ["A b c. D e f. G h.", 3, 0], ["A b c.", "D e f.", "G h."]), ("words", ["a b c d e", 2, 0], ["a b", "c d", "e"]), ("fits", ["a b", 9, 3], ["a b"]), ("overlap", ["a b c d e f", 4, 1], ["a b c d", "d e f"])]),
    "n3_markdown": (lambda t, size: chunk.split_text(t, size, 0, lambda x: len(x.split()), markdown=True), [("headings and fences stay whole", ["# A b\none two three\n## C d\n```\nx y\n\nz\n```\n", 9], ["# A b\none two three", "## C d\n```\nx y\n\nz\n```"])]),
    "n5_oversized_code": (lambda n: [[len(r["code"].strip()) <= 6000, r["kind"]] for r in dispatch.sized([common.chunk("a.py", "Python", "function", "x = 1\n" * n, [])])], [("kept", [3], [[True, "Python"]])]),
    "n6_hard_cap": (lambda n: [str(max(len(r["code"]) for r in dispatch.sized([common.chunk("a.js", "Generic", "generic", "y" * n, [])])) <= 6001)], [("one long line", [900_000], ["True"])]),
    "n10_generic_code": (lambda p, c: [[r["kind"], r["code"]] for r in dispatch.code_chunks(p, c.encode())], [("no grammar", ["x.go", "package x"], [["Generic", "package x"]]), ("broken", ["x.py", "def ("], [["Generic", "def ("]]), ("empty", ["x.go", ""], [])]),
    "d20_zero_bytes": (lambda c: [r["kind"] for r in dispatch.generic("x.bin", c)], [("zero", ["a\0b"], []), ("empty", [""], []), ("text", ["ab"], ["Generic"])]),
    # --- source code ---
    "o1_c": (names, [("functions and the rest", ["a.c", C_CODE], ["function add", "function none", "remainder"])]),
    "o1_c_fields": (lambda c: field_of("a.c", c, "function_name", "parameters", "return_type", "dependencies"), [("parameters", [C_CODE], ['{"function_name":"add","parameters":[{"name":"a","type":"int"},{"name":"b","type":"char *"},{"name":"...","type":""}],"return_type":"static int","dependencies":["x.h","y.h"]}', '{"function_name":"none","parameters":[],"return_type":"void *","dependencies":["x.h","y.h"]}'])]),
    "o2_cpp": (lambda c: field_of("a.cpp", c, "type", "class_name", "function_name", "namespace"), [("members", [CPP_CODE], ['{"type":"class","class_name":"A","function_name":null,"namespace":"N"}', '{"type":"function","class_name":"A","function_name":"f","namespace":"N"}', '{"type":"function","class_name":"A","function_name":"g","namespace":"N"}'])]),
    "o3_csharp": (names, [("no remainder", ["a.cs", CS_CODE], ["interface I", "class C", "method C F", "record R", "enum E"])]),
    "o4_java": (names, [("members", ["A.java", JAVA_CODE], ["class A", "constructor A A", "method A f", "enum K", "interface J", "remainder"])]),
    "o5_javascript": (lambda c: field_of("a.js", c, "type", "function_name", "is_method", "is_async", "is_generator"), [("flags", [JS_CODE], ['{"type":"function","function_name":"f","is_method":false,"is_async":true,"is_generator":false}', '{"type":"function","function_name":"g","is_method":false,"is_async":true,"is_generator":false}', '{"type":"method","function_name":"m","is_method":true,"is_async":false,"is_generator":true}'])]),
    "o6_typescript": (names, [("types too", ["a.ts", TS_CODE], ["interface I", "type T", "enum E", "function f"])]),
    "o7_react": (lambda c: field_of("a.tsx", c, "type", "component_name", "hooks_used", "parent_component"), [("components, hooks, inner functions", [TSX_CODE], ['{"type":"component","component_name":"Card","hooks_used":["useState"],"parent_component":null}', '{"type":"inner_function","component_name":"click","hooks_used":[],"parent_component":"Card"}', '{"type":"hook","component_name":"useThing","hooks_used":["useState"],"parent_component":null}'])]),
    "o8_rust": (lambda c: field_of("a.rs", c, "type", "class_name", "function_name", "namespace"), [("owners and modules", [RS_CODE], ['{"type":"struct","class_name":"W","function_name":null,"namespace":null}', '{"type":"enum","class_name":"E","function_name":null,"namespace":null}', '{"type":"trait","class_name":"T","function_name":null,"namespace":null}', '{"type":"function","class_name":"T","function_name":"t","namespace":null}', '{"type":"function","class_name":null,"function_name":"deep","namespace":"inner"}', '{"type":"function","class_name":"W<T>","function_name":"fmt","namespace":null}'])]),
    "o9_python": (lambda c: field_of("a.py", c, "type", "class_name", "function_name", "alias_name", "is_async", "is_generator", "decorators", "bases"), [("all kinds", [PY_CODE], [
        '{"type":"class","class_name":"C","function_name":null,"alias_name":null,"is_async":null,"is_generator":null,"decorators":["deco"],"bases":["Base"]}', '{"type":"method","class_name":"C","function_name":"f","alias_name":null,"is_async":false,"is_generator":true,"decorators":[],"bases":null}',
        '{"type":"function","class_name":null,"function_name":"g","alias_name":null,"is_async":true,"is_generator":false,"decorators":[],"bases":null}', '{"type":"lambda","class_name":null,"function_name":"sq","alias_name":null,"is_async":false,"is_generator":false,"decorators":null,"bases":null}',
        '{"type":"type_alias","class_name":null,"function_name":null,"alias_name":"T","is_async":null,"is_generator":null,"decorators":null,"bases":null}', '{"type":"remainder","class_name":null,"function_name":null,"alias_name":null,"is_async":null,"is_generator":null,"decorators":null,"bases":null}',
    ])]),
    "o10_sql": (lambda c: field_of("a.sql", c, "type", "schema_name", "object_name", "database_name"), [("kinds, names, merged alterations", [SQL_CODE], ['{"type":"CREATE TABLE","schema_name":"s","object_name":"t","database_name":"db"}', '{"type":"CREATE FUNCTION","schema_name":null,"object_name":"f","database_name":"db"}', '{"type":"GRANT","schema_name":"s","object_name":"t","database_name":"db"}', '{"type":"DELETE","schema_name":null,"object_name":null,"database_name":"db"}', '{"type":"ALTER TABLE","schema_name":"s","object_name":"t","database_name":"db"}'])]),
    "o11_languages": (one(paths.language), [(p, [p], [k]) for p, k in (("a.h", "C"), ("a.hh", "Cpp"), ("a.cs", "CSharp"), ("A.JAVA", "Java"), ("a.mjs", "JavaScript"), ("a.ts", "TypeScript"), ("a.jsx", "React"), ("a.rs", "Rust"), ("a.pyi", "Python"), ("a.sql", "Sql"), ("a.go", None))]),
    "o12_remainder": (one(common.remainder), [("spans out", ["aa\nbb\ncc\n", [[3, 6]]], ["aa\ncc"]), ("nothing left", ["aa\n", [[0, 3]]], [""]), ("touching spans", ["abcdef", [[1, 3], [3, 4]]], ["aef"])]),
    "o13_tree_walk": (lambda h: [n.tag for n in html.parse(h).walk()], [("before its children, left to right", ["<a><b><c></c></b><d></d></a><e></e>"], ["a", "b", "c", "d", "e"])]),
    "d17_kinds_kept": (lambda c: [r["type"] for r in sql.sql("x.sql", c)], [("settings go", ["SET x = 1;\nBEGIN;\nSELECT 1;\nCOMMIT;\nDROP TABLE t;\n"], ["SELECT", "DROP TABLE"])]),
    "f11_alterations": (lambda c: [[r["object_name"], r["code"].count("\n\n") + 1] for r in sql.sql("x.sql", c)], [("one chunk a table, last", ["ALTER TABLE B ADD x INT;\nCREATE TABLE c (i INT);\nALTER TABLE a ADD x INT;\nalter table b drop y;\n"], [["c", 1], ["B", 2], ["a", 1]])]),
    "f12_spans": (lambda s: [list(x) for x in common.merged_spans([tuple(x) for x in s])], [("overlapping and touching", [[[5, 9], [1, 3], [3, 4], [8, 12], [20, 20]]], [[1, 4], [5, 12]])]),
    "f13_dependencies": (lambda p, c: dispatch.code_chunks(p, c.encode())[0]["dependencies"], [("c, first appearance", ["a.c", C_CODE], ["x.h", "y.h"])]),
    "k8_clean_code": (one(common.clean_code), [("tabs, margin, blanks", ["\n\tif x {\n\t\ty  \n\n\n\t}\n"], ["if x {\n    y\n\n}"]), ("accessors", ["int A { get; set; }"], ["int A {get;set;}"]), ("empty braces", ["void f() {\n}"], ["void f(){}"])]),
    "k9_tabs_and_margins": (lambda t: [common.expand_tabs(t), common.dedent(t)], [("columns", ["a\tb"], ["a   b", "a\tb"]), ("margin", ["  x\n\n    y"], ["  x\n\n    y", "x\n\n  y"])]),
    "k13_strip_comments": (one(common.strip_comments), [("line kinds", ["a // b\nc # d\ne -- f"], ["a \nc \ne "]), ("nested blocks", ["a /* x /* y */ z */ b"], ["a \n b"]), ("quoted", ["s = '// no'"], ["s = '// no'"]), ("blank runs", ["a\n/* x */\n(* y *)\nb"], ["a\n\nb"])]),
    "k14_sql_comments": (one(sql.strip_sql_comments), [("all", ["a -- x\n'--' /* /* */ */ $$--$$"], ["a \n'--'   $$--$$"]), ("unclosed dollar quote", ["x $a$ -- y"], ["x $a$ -- y"])]),
    "k15_boilerplate": (lambda t: list(sql.strip_boilerplate(t)), [("batches, settings, brackets", ["USE [Db];\nGO\nset ansi_nulls  on\nSELECT [a] FROM [dbo].[My t]\n/"], ["SELECT a FROM dbo.My t", "Db"])]),
    "k22_imports": (lambda p, c: next((r["dependencies"] for r in dispatch.code_chunks(p, c.encode())), []), [("c", ["a.c", C_CODE], ["x.h", "y.h"]), ("java", ["A.java", JAVA_CODE], ["java.util.List", "a.B.c"]), ("js", ["a.js", JS_CODE], ["mod", "other"]), ("rust", ["a.rs", RS_CODE], ["std::fmt"])]),
    "k23_statement_types": (one(sql.statement_type), [(t, [t], [k]) for t, k in (("create  table t", "CREATE TABLE"), ("CREATE OR REPLACE PACKAGE BODY p", "CREATE OR REPLACE PACKAGE BODY"), ("create unique index i", "CREATE UNIQUE INDEX"), ("DROP TABLE IF EXISTS t", "DROP TABLE"), ("insert into t", "INSERT"), ("VACUUM FULL t", "VACUUM FULL"), ("", "UNKNOWN"))]),
    "k24_object_names": (lambda c: list(sql.object_name(c)), [(t, [t], v) for t, v in (("CREATE TABLE a.b(x int)", ["a", "b"]), ("DROP VIEW IF EXISTS v;", [None, "v"]), ("GRANT ALL ON s.t TO u", ["s", "t"]), ("ALTER POLICY p ON t", [None, "p"]), ("SELECT 1", [None, None]))]),
    "k25_dollar_spans": (lambda t: [list(x) for x in sql.dollar_spans(t)], [("tags", ["a $$b$$ $x$ c $$ $x$ d"], [[2, 7], [8, 20]]), ("quoted", ["'$$' $$x"], [[5, 8]])]),
    "c6_code_metadata": (lambda p, c: [sorted(dispatch.metadata(r)) for r in dispatch.code_chunks(p, c.encode(), "r", "t")][:1], [("c", ["a.c", C_CODE], [["code", "created_at", "dependencies", "file_name", "function_name", "namespace", "parameters", "repo_name", "return_type", "type"]])]),
    "c8_code_embedding_text": (lambda p, c: [dispatch.embedding_text(r) for r in dispatch.code_chunks(p, c.encode(), "r", "t")], [("generic", ["x.go", "package x"], ["Repo Name: r\nFile Name: x.go\nCode:\npackage x"])]),
    "c9_flags": (lambda p, c: [x for x in dispatch.embedding_text(dispatch.code_chunks(p, c.encode(), "r")[0]).split("\n") if x.split(":")[0] in ("Method", "Async", "Generator")], [("scripts always", ["a.js", "function f() { }\n"], ["Method: False", "Async: False", "Generator: False"]), ("python when true", ["a.py", "async def f():\n    pass\n"], ["Async: True"])]),
    "c13_document_chunks": (lambda p, c: [[d["doc_type"], d["chunk_index"], d["content"]] for i, r in enumerate(dispatch.code_chunks(p, c.encode())) for d in [dispatch.document_chunk(r, i)]], [("extension", ["x.GO", "package x"], [["go", 0, "package x"]]), ("none", ["Makefile", "all:"], [["txt", 0, "all:"]])]),
    "c14_stamp": (lambda p, c: [[r["repo_name"], r["file_name"], r["code"], r["created_at"]] for r in dispatch.code_chunks(p, c.encode(), "repo", "now")], [("stamped and cleaned", ["x.go", "\tpackage x  \n"], [["repo", "x.go", "package x", "now"]])]),
    "p7_readable_ids": (lambda p, n: [common.chunk_id(p, n, "x").rpartition("-")[0], str(len(common.chunk_id(p, n, "x").rpartition("-")[2]))], [("base name", ["src\\d/a.py", "f"], ["a.py-f", "8"])]),
    # --- words ---
    "k4_stems": (one(stem.stem), [(w, [w], [s]) for w, s in (("consign", "consign"), ("consigned", "consign"), ("consigning", "consign"), ("consignment", "consign"), ("consist", "consist"), ("consistency", "consist"), ("consistently", "consist"), ("consolation", "consol"), ("consolidate", "consolid"), ("knack", "knack"), ("knackeries", "knackeri"), ("knights", "knight"), ("knocking", "knock"), ("skies", "sky"), ("dying", "die"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("happy", "happi"), ("by", "by"), ("say", "say"), ("rate", "rate"))]),
    "k5_term_ids": (one(lambda w: stem.term_of(w)[1]), [("rust", ["rust"], [326552902])]),
    "f9_mean_pooling": (lambda v, m: [round(float(x), 4) for x in dense.mean_pool(np.array(v, np.float32), np.array(m))[0]], [("masked", [[[[1, 2], [3, 4], [9, 9]]], [[1, 1, 0]]], [2.0, 3.0]), ("nothing", [[[[1, 2]]], [[0]]], [0.0, 0.0])]),
    "f17_padded_length": (one(dense.padded_length), [("cut", [[3, 900, 17]], [512]), ("longest", [[3, 17]], [17]), ("none", [[]], [1])]),
    "j15_providers": (dense.providers, [("gpu first", [["CUDAExecutionProvider", "CPUExecutionProvider"], "auto"], ["CUDAExecutionProvider", "CPUExecutionProvider"]), ("asked for, not there", [["CPUExecutionProvider"], "cuda"], ["CPUExecutionProvider"]), ("cpu", [["CUDAExecutionProvider", "CPUExecutionProvider"], "cpu"], ["CPUExecutionProvider"])]),
    "q14_progress_marks": (lambda n: [list(x) for x in ingest.progress_marks(n)], [("250", [250], [[100, 40], [200, 80], [250, 100]]), ("few", [7], [[7, 100]]), ("none", [0], [])]),
    "h6_chunk_limits": (one(limits.max_chunk_limit), [(str(n), [n], [v]) for n, v in ((None, 5), (0, 1), (7, 7), (99, 50), (-3, 1))]),
    "p6_uuid5": (one(lambda u: chunk.web_chunks(u, "<p>text</p>", "g", "t")[0]["page_id"]), [("of the address", ["https://example.com/"], ["dd2c1780-811a-5296-81c5-178a0ef488bc"])]),
    # --- catalog, tools, jobs ---
    "d21_server_names": (outcome(one(catalog.valid_server_name)), [("trimmed", [" ok_1 "], ["ok_1"]), ("space", ["a b"], ["error"]), ("empty", [" "], ["error"]), ("accent", ["é"], ["error"])]),
    "b1_allowed_collections": (outcome(one(collection.checked_name)), [("code", ["codebase"], ["codebase"]), ("documents", ["general"], ["general"]), ("other", ["x"], ["error"])]),
    "b9_index_types": (outcome(one(lambda k: collection.check_index("k", k) and "ok")), [(k, [k], [v]) for k, v in (("keyword", "ok"), ("integer", "ok"), ("float", "ok"), ("text", "ok"), ("datetime", "ok"), ("bool", "ok"), ("uuid", "ok"), ("geo", "ok"), ("blob", "error"))]),
    "b5_replacement": (lambda c, z, r: [collection.replacement_clause(c, zip_name=z, repo=r)], [("code", ["codebase", "a.zip", "r"], [{"repo_name": "r"}]), ("documents", ["general", "a.zip", "r"], [{"zip_filename": "a.zip"}])]),
    "j13_scopes": (lambda code, docs: [[r.collection, r.where] for r in scope_requests([tuple(x) for x in code], [tuple(x) for x in docs])], [("none", [[], []], [["codebase", {}]]), ("code first", [[["codebase", ["a"]], ["", []]], [["general", ["x", "y"]]]], [["codebase", {"repo_name": "a"}], ["codebase", {}], ["general", {"$or": [{"group": "x"}, {"group": "y"}]}]])]),
    "t14_connection": (lambda s, port: [f"{k}={text(v)}" for k, v in sorted(catalog.connection_info(s, port).items())], [("address and snippets", ["docs", 9000], [
        'config_snippets={"claude_desktop":{"mcpServers":{"docs":{"url":"http://127.0.0.1:9000/mcp?server_id=docs"}}},"opencode":{"mcp":{"docs":{"type":"remote","url":"http://127.0.0.1:9000/mcp?server_id=docs"}}},"vscode":{"servers":{"docs":{"type":"http","url":"http://127.0.0.1:9000/mcp?server_id=docs"}}}}',
        "full_url=http://127.0.0.1:9000/mcp?server_id=docs", "mcp_url=http://127.0.0.1:9000/mcp", "server_id=docs", "server_name=docs",
    ])]),
    "s5_query_payload": (lambda q, sel: [views.query_payload(q, "general", "group", sel)["query"], views.query_payload(q, "general", "group", sel)["where"]], [("two", [" a ", ["x", "y"]], ["a", {"$or": [{"group": "x"}, {"group": "y"}]}]), ("none", ["b", []], ["b", {}])]),
    "s6_tool_forms": (lambda r, g, w: [views.tool_scopes(r, g, w), views.tool_form(views.tool_scopes(r, g, w), set(w))], [("there and back", [["r"], ["g"], ["w"]], [[{"collection": "codebase", "repo_names": ["r"]}, {"collection": "general", "group_ids": ["g", "w"]}], {"repos": ["r"], "groups": ["g"], "websites": ["w"]}])]),
    "s8_added_paths": (jobs.added_paths, [("room for three", [["a"], ["b", "a", "b", "c", "d"], 3], ["a", "b", "c"])]),
    "s9_one_kind": (jobs.one_kind, [("archives", [["a.zip", "b.pdf", "C.ZIP"]], ["a.zip", "C.ZIP"]), ("files", [["b.pdf", "a.zip"]], ["b.pdf"])]),
    "q1_enqueue": (lambda ps: [[j["status"], f["status"], j["task_name"], f["file_type"]] for j, f in zip(*jobs.upload_rows([tuple(p) for p in ps], "general", "t", {}, "now")[:2], strict=True)] + jobs.upload_rows([tuple(p) for p in ps], "general", "t", {}, "now")[2], [("an error among them", [[["d/a.pdf", 1], ["d/", 2]]], [["PENDING", "pending", "t", "pdf"], "d/: no file name"])]),
    "q6_run_job": (registry_runs, [("ends", ["echo", '{"x": 5}'], ["job_progress 100", "job_finished 100", "FINISHED 5 None"]), ("unknown", ["zzz", None], ["job_failed None", "FAILED None unknown task: zzz"]), ("missing", [None, None], ["job_failed None", "FAILED None no task"])]),
    "q7_isolation": (registry_runs, [("an exception is the job's", ["boom", "{}"], ["job_failed None", "FAILED None integer division or modulo by zero"])]),
}


def _query(name: str):
    f, cases = CASES[name]

    def run(spark, sf):
        def batches(it):
            for batch in it:
                rows = [(label, i, text(v)) for label, args in zip(batch["item"], batch["args"], strict=True) for i, v in enumerate(f(*json.loads(args)))]
                yield pd.DataFrame(rows, columns=["item", "pos", "value"])

        asked = spark.createDataFrame([(label, json.dumps(args)) for label, args, _ in cases], "item string, args string")
        return asked.mapInPandas(batches, "item string, pos int, value string")

    run.__name__ = name
    return run


def values_sql(rows: list[tuple], columns: str) -> str:
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({columns})"


# --- queries over inline tables, with operators on DataFrames ---------------------------------------------------------------------

AT = "2024-01-01T00:00:00Z"
FILES = [("docs/a.txt", b"hello world"), ("docs/b.csv", b"n,a\nx,1\ny,2\n"), ("docs/c.docx", b"broken"), ("docs/d.md", b"# T\n\ntext"), ("src/e.py", b"def f():\n    return 1\n"), ("pic.png", b"x"), ("empty.txt", b" ")]
RESULTS = [(1, 1, "c", '{"repo_name":"r"}', 0.25), (0, 1, "a", '{"source":"s.txt"}', 0.5), (0, 2, "b", "{}", 1.0)]


def n4_ingested_documents(spark, sf):
    """Files to points: chunked, indexed, embedded both ways, with their payload."""
    rows, _ = ingest.document_rows(spark.createDataFrame(FILES[:4] + FILES[5:], "path string, content binary"), AT, "g")
    points = ingest.points_of(rows, lambda: dense.HashEncoder(8))
    return points.select("file_name", "doc_type", "chunk_index", "group", "document", F.size("dense").alias("dim"), F.size("sparse.indices").alias("terms"), F.length("id").alias("id_length"))


def q8_failed_files(spark, sf):
    _, errors = ingest.document_rows(spark.createDataFrame(FILES, "path string, content binary"), AT, "g")
    return errors.select("file_name")


def c11_payload(spark, sf):
    """Base metadata, a row's own, then what the user gave; later ones win."""
    rows, _ = ingest.document_rows(spark.createDataFrame([FILES[1]], "path string, content binary"), AT, "g", doc_type="table")
    return rows.select("chunk_index", *(F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("file_name", "doc_type", "row", "source")), F.get_json_object("metadata", "$.group").alias("grp"))


def o11_ingested_code(spark, sf):
    rows = ingest.code_rows(spark.createDataFrame(FILES[4:5] + [("node_modules/x.js", b"function f() { }")], "path string, content binary"), AT, "repo")
    return ingest.points_of(rows, lambda: dense.HashEncoder(8)).select("file_name", "doc_type", "repo_name", "chunk_index", "document", F.get_json_object("metadata", "$.function_name").alias("function_name"), F.size("dense").alias("dim"))


def t15_ingested_pages(spark, sf):
    rows = ingest.page_rows(spark.createDataFrame([("https://h/a", "<title>T</title><h1>A</h1><p>text</p><pre class='language-c'>x</pre>"), ("ftp://no", "<p>x</p>"), (None, None)], "url string, html string"), "g", AT)
    return ingest.points_of(rows, lambda: dense.HashEncoder(8)).select("url", "chunk_index", "document", "group", "website_key", F.get_json_object("metadata", "$.content_type").alias("content_type"))


def a14_archive_members(spark, sf):
    z = zipped({"src/a.py": "x = 1", "../evil.py": "y", "readme.md": "# R", "node_modules/b.js": "z"})
    return loaders.read_zips(spark.createDataFrame([("up/r.zip", z)], "path string, content binary")).select("zip", "path", F.decode("content", "utf-8").alias("text"))


def b6_upsert_last_wins(spark, sf):
    """A batch that repeats an id: its last row stays; rows with other ids stay as they are."""
    old = spark.createDataFrame([("1", "a", 0), ("2", "b", 0)], "id string, document string, at int")
    new = spark.createDataFrame([("2", "x", 1), ("3", "c", 2), ("2", "y", 3)], "id string, document string, at int")
    return collection.upserted(old, new, "at").select("id", "document")


def c3_result_rows(spark, sf):
    batch = spark.createDataFrame([(["a", "b"], ["x"], None, [0.5, 0.1])], "ids array<string>, documents array<string>, metadatas array<string>, distances array<double>")
    return rows_of_batches(batch.withColumn("metadatas", F.coalesce("metadatas", F.array().cast("array<string>"))))


def k12_text_of_results(spark, sf):
    """The first two of three results in order of request and rank; the header counts all."""
    return formatted(spark.createDataFrame(RESULTS, "request_idx int, rank int, id string, metadata string, score double"), "q", 2)


def k12_text_without_results(spark, sf):
    return formatted(spark.createDataFrame([], "request_idx int, rank int, id string, metadata string, score double"), "q", 2)


def c15_storage_ids(spark, sf):
    ids = spark.createDataFrame([("0123abcd-0123-4567-89ab-0123456789AB",), ("a.py-f-12345678",)], "id string")
    new = ids.select("id", chunk.storage_id(F.col("id")).alias("stored"))
    return new.select("id", (F.col("id") == F.col("stored")).alias("kept"), F.col("stored").rlike("^[0-9a-fA-F-]{36}$").alias("is_uuid"))


def d6_filter_errors(spark, sf):
    """What the compiler refuses, and what it takes."""
    points = spark.createDataFrame([("1", "r", 1)], "id string, repo_name string, n int")
    rows = []
    for where in ({"n": None}, {"n": [1]}, {"n": {"a": 1}}, [1], {"$and": {}}, {"$or": [1]}, {"n": 1}, {}):
        try:
            rows.append((json.dumps(where), str(filtered(points, where).count())))
        except FilterError:
            rows.append((json.dumps(where), "error"))
    return spark.createDataFrame(rows, "clause string, found string")


def j14_no_requests(spark, sf):
    try:
        return Engine(spark, {}).run([])
    except ValueError as e:
        return spark.createDataFrame([(str(e),)], "error string")


def t9_job_status(spark, sf):
    rows = spark.createDataFrame([("j1", "RUNNING")], "job_id string, status string")
    out = []
    for j in ("j1", "j2"):
        try:
            out.append((j, jobs.job_status(rows, j)["status"]))
        except ValueError as e:
            out.append((j, str(e)))
    return spark.createDataFrame(out, "job_id string, status string")


def t12_tools(spark, sf):
    """An update replaces the row with its name trimmed and its limit clamped; a new row is added; one is switched off."""
    tools = spark.createDataFrame([(1, "t", True, 5), (2, "u", True, 7)], "id long, name string, active boolean, max_chunk_limit int")
    changed = catalog.with_tool(catalog.with_tool(tools, {"id": 1, "name": " v ", "active": True, "max_chunk_limit": 999}), {"id": 3, "name": "w", "active": True, "max_chunk_limit": None})
    return catalog.toggled(changed, 2)


def b14_migration(spark, sf):
    return migrated(spark.createDataFrame([(1, "t")], "id long, name string"), "tools")


def b2_indexes(spark, sf):
    """Missing keys are listed; a key of another type is an error."""
    rows = []
    for schema in ("repo_name string, file_name string", "repo_name string, file_name int", "repo_name string, file_name string, created_at string"):
        try:
            rows.append((schema, ",".join(collection.check_indexes("codebase", spark.createDataFrame([], schema)))))
        except ValueError:
            rows.append((schema, "error"))
    return spark.createDataFrame(rows, "columns string, missing string")


def a21_collections(spark, sf):
    """A collection is created once; what exists is listed."""
    import tempfile

    store = collection.Store(spark, spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp())
    created = [store.ensure("general", "id string, document string"), store.ensure("general", "id string, document string")]
    return spark.createDataFrame([(n, *created) for n in store.list_collections()], "name string, first boolean, second boolean")


def m9_crawled_site(spark, sf):
    """Listed links come before they are fetched, each page once, within the start's scope, to depth two."""
    site = [("https://h/d/", anchors("a", "b", "https://x.com/", "/out")), ("https://h/d/a", anchors("c", "/d/")), ("https://h/d/b", anchors("c", "e")), ("https://h/d/c", anchors("f"))]
    return crawl.crawl(spark, spark.createDataFrame(site, "url string, html string"), "https://h/d/", 2)


def h12_page_cap(spark, sf):
    """One fetch: the start and its links."""
    site = [("https://h/d/", anchors("a", "b")), ("https://h/d/a", anchors("c"))]
    return crawl.crawl(spark, spark.createDataFrame(site, "url string, html string"), "https://h/d/", 2, max_pages=1)


def h10_sitemaps_first(spark, sf):
    site = [("https://h/d/", anchors("a")), ("https://h/d/z", anchors("q"))]
    return crawl.crawl(spark, spark.createDataFrame(site, "url string, html string"), "https://h/d/", 1, listed=["https://h/d/z"])


def q9_progress_events(spark, sf):
    """A registry's events, folded into the job's state."""
    seen: list = []
    r = jobs.Registry()
    r.register("t", lambda p, progress: (progress(-5, "begin"), progress(40, "half"), "done")[-1])
    r.run({"job_id": "j", "task_name": "t", "task_params": "{}"}, seen.append)
    rows = [(i, e["job_id"], e["event"], e.get("percentage"), e.get("message"), None, e.get("status"), e.get("result"), e.get("error")) for i, e in enumerate(seen)]
    return tracker.fold(spark.createDataFrame(rows, JOB_EVENT)).select("job_id", "percentage", "status", "result", "completed", "events")


def f1_count(spark, sf):
    return spark.createDataFrame([(collection.count_items(t(spark, sf, "documents")),)], "items long")


def f18_total_bytes(spark, sf):
    return ingest.total_bytes(spark.createDataFrame(FILES, "path string, content binary"))


def q13_status_changes(spark, sf):
    """The last status wins, and only a change is an event."""
    rows = [(1, "b", "backend", None, None, None, "starting", None, None), (2, "b", "backend", None, None, None, "starting", None, None), (3, "b", "backend", None, None, None, "ready", None, None), (4, "b", "backend", None, None, None, "ready", None, None)]
    return tracker.changes(spark.createDataFrame(rows, JOB_EVENT)).select("seq", "status")


def q2_poll_loop(spark, sf):
    """Two rounds of at most two jobs: the oldest pending first, an unknown task fails, what is stale fails."""
    schema = "id long, job_id string, status string, created_at string, updated_at string, result string, error_message string, progress_percentage int, task_name string, task_params string"
    rows = [(i, f"j{i}", st, f"2024-01-01T00:0{i}:00Z", f"2024-01-01T00:0{i}:00Z", None, None, 0, task, "{}") for i, st, task in ((1, "PENDING", "t"), (2, "PENDING", "zzz"), (3, "PENDING", "t"), (4, "RUNNING", "t"), (5, "PENDING", "t"))]
    held, rounds = [rows], []
    registry = jobs.Registry({"t": lambda p, progress: "ok"})
    jobs.poll_loop(lambda: spark.createDataFrame(held[-1], schema), lambda df: held.append([tuple(r) for r in df.orderBy("id").collect()]), registry, rounds.append, lambda: ("2024-01-01T01:00:00Z", "2024-01-01T00:45:00Z"), lambda: len(held) > 2, 0)
    return spark.createDataFrame(held[-1], schema).select("job_id", "status")


def c4_hidden_documents(spark, sf):
    """Requests in their order, each reranked; the last one hides the documents of all."""
    texts = ["rust is a systems programming language", "the cat sat on a mat", "python is a programming language for data", "gardens need water"]
    encoder = dense.HashEncoder(8)
    points = spark.createDataFrame([(str(i), x, encoder.encode_query(x), "r" if i % 2 else "s", i) for i, x in enumerate(texts)], "id string, document string, dense array<float>, repo_name string, n int")
    engine = Engine(spark, {"codebase": points}, encode_query=encoder.encode_query)
    return engine.run([Request("codebase", "language", 2), Request("codebase", "cats", 1, False, {"repo_name": "r"})]).select("request_idx", "rank", "id", "document", "metadata")


def q12_ordered_scrape(spark, sf):
    """Pages in the order that they were asked for; one that isn't there has no body."""
    wanted = spark.createDataFrame([(2, "https://h/c"), (0, "https://h/a"), (1, "https://h/b")], "pos bigint, url string").repartition(3)
    return crawl.fetch_pages(wanted, lambda u: None if u.endswith("b") else u[-1].encode()).select("pos", "url", F.decode("body", "utf-8").alias("body"))


def p8_json_pointers(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.nope").alias("nope"))


def p1_times(spark, sf):
    return t(spark, sf, "events").select("event_id", tx.iso_seconds(F.col("ts")).alias("seconds"), tx.iso_micros(F.col("ts")).alias("micros"))


def j4_posted_vectors(spark, sf):
    """Of a sentence, identifiers ascending, equal weights for single terms; nothing of stop words."""
    d = spark.createDataFrame([(1, "rust"), (2, "the quick brown fox jumps over the lazy dog"), (3, "the the and or"), (4, None)], "doc_id long, text string")
    v = bm25.sparse_vectors(d)
    return v.select("id", F.posexplode_outer(F.arrays_zip("indices", "values")).alias("pos", "x")).select("id", "pos", F.col("x.indices").alias("term"), F.round(F.col("x.values").cast("double"), 4).alias("weight"))


def j10_reranked(spark, sf):
    """Batches of pairs, best first, ties in the candidates' order, the limit last."""
    c = spark.createDataFrame([("a", "x y", 3.0), ("b", "y", 2.0), ("c", "x", 2.0), ("d", "z", 1.0)], "id string, document string, score double")
    return fusion.rerank(c, "x", 3, lambda q, ds: [float(q in d.split()) for d in ds], by_list=True).select("id", "score", "candidate_rank")


_TABLES = {
    n4_ingested_documents: ([("docs/a.txt", "txt", 0, "g", "hello world", 8, 7, 36), ("docs/b.csv", "csv", 0, "g", "row 1: \n0: n: x\n1: a: 1", 8, 11, 36), ("docs/b.csv", "csv", 1, "g", "row 2: \n0: n: y\n1: a: 2", 8, 11, 36), ("docs/d.md", "md", 0, "g", "# T\n\ntext", 8, 6, 36)], "file_name, doc_type, chunk_index, \"group\", document, dim, terms, id_length"),
    q8_failed_files: ([("docs/c.docx",)], "file_name"),
    c11_payload: ([(0, "docs/b.csv", "table", "1", "docs/b.csv", "g"), (1, "docs/b.csv", "table", "2", "docs/b.csv", "g")], 'chunk_index, file_name, doc_type, "row", source, grp'),
    o11_ingested_code: ([("src/e.py", "py", "repo", 0, "def f():\n    return 1", "f", 8)], "file_name, doc_type, repo_name, chunk_index, document, function_name, dim"),
    t15_ingested_pages: ([("https://h/a", 0, "A\ntext", "g", f'["https://h/a","g","{AT}"]', "prose"), ("https://h/a", 1, "x", "g", f'["https://h/a","g","{AT}"]', "code")], 'url, chunk_index, document, "group", website_key, content_type'),
    a14_archive_members: ([("up/r.zip", "readme.md", "# R"), ("up/r.zip", "src/a.py", "x = 1")], "zip, path, text"),
    b6_upsert_last_wins: ([("1", "a"), ("2", "y"), ("3", "c")], "id, document"),
    c3_result_rows: ([(0, "a", "x", "{}", 0.5), (1, "b", "", "{}", 0.1)], "pos, id, document, metadata, score"),
    k12_text_of_results: ([("Found 3 results for 'q'\n\nResult 1 [s.txt] (score: 0.500):\nMetadata: {\"source\":\"s.txt\"}\n---\nResult 2 (score: 1.000):\nMetadata: {}",)], "text"),
    k12_text_without_results: ([("No results found for query: 'q'",)], "text"),
    c15_storage_ids: ([("0123abcd-0123-4567-89ab-0123456789AB", True, True), ("a.py-f-12345678", False, True)], "id, kept, is_uuid"),
    d6_filter_errors: ([('{"n": null}', "error"), ('{"n": [1]}', "error"), ('{"n": {"a": 1}}', "error"), ("[1]", "error"), ('{"$and": {}}', "error"), ('{"$or": [1]}', "error"), ('{"n": 1}', "1"), ("{}", "1")], "clause, found"),
    j14_no_requests: ([("no requests",)], "error"),
    t9_job_status: ([("j1", "RUNNING"), ("j2", "no such job: j2")], "job_id, status"),
    t12_tools: ([(1, "v", True, 50), (2, "u", False, 7), (3, "w", True, 5)], "id, name, active, max_chunk_limit"),
    b14_migration: ([(1, "t", 5)], "id, name, max_chunk_limit"),
    b2_indexes: ([("repo_name string, file_name string", "created_at"), ("repo_name string, file_name int", "error"), ("repo_name string, file_name string, created_at string", "")], "columns, missing"),
    a21_collections: ([("general", True, False)], "name, first, second"),
    m9_crawled_site: ([("https://h/d/", 0, 0), ("https://h/d/a", 1, 1), ("https://h/d/b", 1, 2), ("https://h/d/c", 2, 3), ("https://h/d/e", 2, 4)], "url, depth, pos"),
    h12_page_cap: ([("https://h/d/", 0, 0), ("https://h/d/a", 1, 1), ("https://h/d/b", 1, 2)], "url, depth, pos"),
    h10_sitemaps_first: ([("https://h/d/z", 0, 0), ("https://h/d/", 0, 1), ("https://h/d/q", 1, 2), ("https://h/d/a", 1, 3)], "url, depth, pos"),
    q9_progress_events: ([("j", 100, "FINISHED", "done", True, 3)], "job_id, percentage, status, result, completed, events"),
    j4_posted_vectors: ([(1, 0, 326552902, 1.6877)] + [(2, i, k, 1.6653) for i, k in enumerate((226376294, 741580288, 771291085, 1312749093, 1621867415, 1913189942))] + [(3, None, None, None), (4, None, None, None)], "id, pos, term, weight"),
    c4_hidden_documents: ([(0, 1, "2", "", '{"repo_name":"s","n":2}'), (0, 2, "0", "", '{"repo_name":"s","n":0}'), (1, 1, "1", "", '{"repo_name":"r","n":1}')], 'request_idx, "rank", id, document, metadata'),
    q12_ordered_scrape: ([(0, "https://h/a", "a"), (1, "https://h/b", None), (2, "https://h/c", "c")], "pos, url, body"),
    f18_total_bytes: ([(62,)], "bytes"),
    q13_status_changes: ([(1, "starting"), (3, "ready")], "seq, status"),
    q2_poll_loop: ([("j1", "FINISHED"), ("j2", "FAILED"), ("j3", "FINISHED"), ("j4", "FAILED"), ("j5", "FINISHED")], "job_id, status"),
    j10_reranked: ([("a", 1.0, 1), ("c", 1.0, 3), ("b", 0.0, 2)], "id, score, candidate_rank"),
}
_OF_TABLES = {
    p8_json_pointers: "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.nope') AS nope FROM events",
    f1_count: "SELECT count(*) AS items FROM documents",
    p1_times: "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS micros FROM events",
}

QUERIES = {name: _query(name) for name in CASES} | {f.__name__: f for f in (*_TABLES, *_OF_TABLES)}
ORACLE_SQL = {name: values_sql([(label, i, text(v)) for label, _, values in cases for i, v in enumerate(values)], "item, pos, value") for name, (_, cases) in CASES.items()}
ORACLE_SQL |= {f.__name__: values_sql(rows, columns) for f, (rows, columns) in _TABLES.items()} | {f.__name__: q for f, q in _OF_TABLES.items()}
