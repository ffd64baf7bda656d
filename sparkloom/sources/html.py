"""HTML and XML structure: sections, code blocks, links, sitemaps."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.parsers import expat

from sparkloom.functions import urls

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAVES = frozenset("p li h3 h4 h5 h6 td th blockquote figcaption dd dt caption summary".split())
LOADER_LEAVES = LEAVES | {"h1", "h2", "pre", "code"}
WALKED = LEAVES | {"h1", "h2", "pre"}
NOISE = frozenset("script style nav footer header aside".split())
#: An opening tag of the key ends an open element of the values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {
    t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
}
SCOPES = frozenset("table ul ol dl td th body html".split())
MIN_ANCHOR_BYTES = 4


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self):
        """Elements below, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def ancestors(self):
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {})

    def handle_starttag(self, tag, attrs):
        ended = ENDS.get(tag)
        node = self.open
        while ended and node.tag and node.tag not in SCOPES - ended:
            if node.tag in ended:
                self.open = node.parent
                break
            node = node.parent
        child = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(child)
        if tag not in VOID:
            self.open = child

    def handle_endtag(self, tag):
        if tag in ("body", "html"):  # what follows is still the body's
            return
        for node in self.open.ancestors():
            if node.tag == tag and node.parent is not None:
                self.open = node.parent
                return

    def handle_data(self, data):
        self.open.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _first(root: Node, *tags: str) -> Node | None:
    return next((n for n in root.walk() if n.tag in tags), None)


def container(root: Node) -> Node:
    """The body of a parsed page, which comes before any main or article; pages without one are all body."""
    return _first(root, "body") or root


def in_noise(node: Node) -> bool:
    """D14."""
    return any(a.tag in NOISE for a in node.ancestors())


def collapsed(text: str) -> str:
    return " ".join(text.split())


def loader_text(html: str) -> str:
    """The text of leaf elements joined by spaces; nested leaves come twice."""
    body = container(parse(html))
    return " ".join(t for n in body.walk() if n.tag in LOADER_LEAVES and not in_noise(n) and (t := collapsed(n.text())))


def _language(node: Node) -> str:
    return next((c[9:] for c in node.attrs.get("class", "").split() if c.startswith("language-")), "")


def code_language(pre: Node) -> str:
    """M2."""
    inner = next((n for n in pre.walk() if n.tag == "code"), None)
    return _language(pre) or (_language(inner) if inner else "")


def _anchor(node: Node) -> str | None:
    """The text of a link, if it has 4 bytes at least."""
    text = node.text().strip()
    return text if len(text.encode()) >= MIN_ANCHOR_BYTES else None


def sections(html: str, base: str | None = None) -> tuple[str, list[dict]]:
    """M1-M3: (title, sections), each with heading_path, content, code_blocks, links. A leaf that holds another walked element is skipped."""
    root = parse(html)
    found = _first(root, "title")
    title = found.text().strip() if found else ""
    h1 = h2 = ""
    out: list[dict] = []

    def start() -> None:
        out.append({"h": [x for x in (h1, h2) if x], "content": [], "code_blocks": [], "links": []})

    for node in container(root).walk():
        if node.tag not in WALKED or in_noise(node) or any(n.tag in WALKED for n in node.walk()):
            continue
        if node.tag in ("h1", "h2"):
            if node.tag == "h1":
                h1, h2 = node.text().strip(), ""
            else:
                h2 = node.text().strip()
            start()
            continue
        if not out:
            start()
        if node.tag == "pre":
            out[-1]["code_blocks"].append({"raw": node.text(), "language": code_language(node)})
            continue
        if text := collapsed(node.text()):
            out[-1]["content"].append(text)
        for a in node.walk():
            href = a.attrs.get("href", "").strip() if a.tag == "a" else ""
            if href and href != "#" and (anchor := _anchor(a)):
                out[-1]["links"].append({"href": (urls.resolve(href, base) if base else None) or href, "anchor_text": anchor})
    kept = []
    for s in out:
        content = "\n".join(s["content"]).strip()
        if content or s["code_blocks"]:
            kept.append({"heading_path": s["h"] or ([title] if title else []), "content": content, "code_blocks": s["code_blocks"], "links": s["links"]})
    return title, kept


def navigation_links(html: str, base: str) -> list[dict]:
    """Distinct links inside navigation."""
    out: dict[tuple[str, str], None] = {}
    for a in parse(html).walk():
        if a.tag == "a" and "href" in a.attrs and any(n.tag in ("nav", "aside") or n.attrs.get("role") == "navigation" or "data-nav" in n.attrs for n in a.parent.ancestors()):
            if (anchor := _anchor(a)) and (href := urls.resolve(a.attrs["href"], base)):
                out[href, anchor] = None
    return [{"href": h, "anchor_text": a} for h, a in out]


def page_base(root: Node, url: str) -> str:
    """A base element's reference, if the page has one."""
    node = next((n for n in root.walk() if n.tag == "base" and n.attrs.get("href")), None)
    return (urls.resolve(node.attrs["href"], url) or url) if node else url


def page_links(html: str, url: str, start: str | None = None) -> list[str]:
    """M5: pages that a page leads to, in order, each once; with a start those in its scope only."""
    root = parse(html)
    base, out = page_base(root, url), {}
    for n in root.walk():
        refs = [n.attrs.get("href")] if n.tag in ("a", "area") or n.tag == "link" and "next" in n.attrs.get("rel", "").split() else []
        for ref in [*refs, n.attrs.get("data-href"), n.attrs.get("data-url")]:
            found = urls.resolve(ref, base) if ref else None
            if found and not urls.ignored(urls.urlsplit(found).hostname) and (start is None or urls.in_scope(found, start)):
                out[found] = None
    return list(out)


def head_sitemaps(html: str, url: str) -> list[str]:
    """L7."""
    return [x for n in parse(html).walk() if n.tag == "link" and "sitemap" in n.attrs.get("rel", "").lower().split() and (x := urls.resolve(n.attrs.get("href", ""), url))]


def parse_sitemap(xml: str) -> tuple[bool, list[str]] | None:
    """M6: (is it an index?, locations); None for what is malformed or has none."""
    stack, out, text = [], [], []
    kind: list[bool] = []
    parser = expat.ParserCreate()

    def begin(name, _attrs):
        name = name.rpartition(":")[2].lower()
        if not stack and name in ("urlset", "sitemapindex", "rss", "feed"):
            kind.append(name == "sitemapindex")
        stack.append(name)
        text.clear()

    def end(_name):
        name = stack.pop()
        wanted = name == "loc" and stack[-1:] in (["url"], ["sitemap"]) or name == "link" and stack[:1] in (["rss"], ["feed"])
        if wanted and (found := "".join(text).strip()):
            out.append(found)
        text.clear()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, text.append
    try:
        parser.Parse(xml.encode(), True)
    except expat.ExpatError:
        return None
    return (kind[0], out) if kind and out else None


def text_sitemap(body: str) -> list[str]:
    """M7."""
    return [x for line in body.splitlines() if re.match(r"https?://", x := line.strip())]


def xml_text(xml: bytes) -> str:
    """A5: the text of a document as far as it can be parsed, pieces trimmed and joined by a space."""
    out: list[str] = []
    held: list[str] = []

    def flush(*_):
        if piece := "".join(held).strip():
            out.append(piece)
        held.clear()

    parser = expat.ParserCreate()
    parser.StartElementHandler = parser.EndElementHandler = flush
    parser.CharacterDataHandler = held.append
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        pass
    flush()
    return " ".join(out)
