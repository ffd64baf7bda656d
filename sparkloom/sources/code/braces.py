"""Chunkers for languages with braces: C, C++, C#, Java, JavaScript, TypeScript, React, Rust.

A lexer blanks comments and strings out, blocks of braces are found with their headers, and a language tells from a header what a
block declares. Declarations without braces (prototypes, type aliases, delegates) are found by pattern.
"""

from __future__ import annotations

import re

from sparkloom.sources.code.common import Block, blocks, chunk, closing, masked, remainder, split_list, statement_end

CONTROL = frozenset("if for foreach while switch catch else do try return using lock fixed unsafe checked when synchronized new throw await sizeof defined finally __attribute__ __declspec alignas".split())
_FUNCTION = re.compile(r"([~\w$]+(?:\s*::\s*~?[\w$]+|\s*::\s*operator[^(]*)*|operator[^(\s]*)\s*(?:<[^<>()]*>)?\s*$")


def signature(header: str) -> tuple[str, str, str, str] | None:
    """(what stands before the name, name, parameters, what follows) of a header that is a function's, else None."""
    at = header.find("(")
    while at >= 0:
        m = _FUNCTION.search(header[:at])
        if m and m[1].rpartition("::")[2].strip() not in CONTROL and not header[: m.start()].rstrip().endswith(("=", ".", ",", "new", "return")):
            end = closing(header, at)
            if not re.match(r"\s*\(", header[end + 1 :]):  # not a macro before the real list
                return header[: m.start()].strip(), re.sub(r"\s+", "", m[1]) if "operator" not in m[1] else m[1].strip(), header[at + 1 : end], header[end + 1 :].strip()
        at = header.find("(", at + 1)
    return None


def c_parameters(text: str) -> list[dict]:
    out = []
    for p in split_list(text):
        if p == "void":
            continue
        if p == "...":
            out.append({"name": p, "type": ""})
            continue
        p = re.sub(r"\s*=.*$", "", p, flags=re.S)
        m = re.search(r"\(\s*\*\s*(\w+)\s*\)|(\w+)\s*((?:\[[^\]]*\])*)$", p)
        name = (m[1] or m[2]) if m else ""
        kind = p if not name else re.sub(r"\s+", " ", (p[: m.start()] + (m[3] or "") if not m[1] else p.replace(m[1], ""))).strip()
        out.append({"name": name if kind else "", "type": kind or p})
    return out


def _type(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\[\[.*?\]\]|__attribute__\s*\(\(.*?\)\)", "", text)).strip()


def includes(text: str) -> list[str]:
    return list(dict.fromkeys(m[1] or m[2] for m in re.finditer(r'(?m)^[ \t]*#[ \t]*include[ \t]*(?:<([^>]+)>|"([^"]+)")', text)))


def in_source_order(rows: list[tuple[int, dict]]) -> list[dict]:
    """Chunks by where they start; those that start together as they were found."""
    return [r for _, r in sorted(rows, key=lambda x: x[0])]


def c(path: str, text: str) -> list[dict]:
    """O1."""
    deps, out, spans = includes(text), [], []
    for b in blocks(masked(text)):
        if any(signature(p.header) for p in b.up()) or not (s := signature(b.header)) or "=" in s[0]:
            continue
        code = text[b.start : b.end]
        out.append(chunk(path, "C", "function", code, deps, s[1], function_name=s[1], parameters=c_parameters(s[2]), return_type=_type(s[0]) or None))
        spans.append((b.start, b.end))
    rest = remainder(text, spans)
    return out + ([chunk(path, "Generic", "remainder", rest, deps)] if rest else [])


_CPP_TYPE = re.compile(r"(?:^|[\s>])(class|struct)\s+(?:\[\[[^\]]*\]\]\s*)?(?:(?:alignas\s*\([^)]*\)|[A-Za-z_]\w*(?:\([^)]*\))?)\s+)?(?!final\b)([A-Za-z_]\w*(?:::\w+)*)\s*(?:final\s*)?(?::(?!:)[^;]*)?$")


def cpp(path: str, text: str) -> list[dict]:
    """O2."""
    deps, out, spans = includes(text), [], []
    for b in blocks(masked(text)):
        up = list(b.up())
        if any(signature(p.header) and not _CPP_TYPE.search(p.header) for p in up):
            continue
        space = next((m[1] for p in up if (m := re.search(r"\bnamespace\s+([\w:]+)\s*$", p.header))), None)
        owner = next((m[2] for p in up if (m := _CPP_TYPE.search(p.header))), None)
        code = text[b.start : b.end]
        if m := _CPP_TYPE.search(b.header):
            end = statement_end(text, b.end) if text[b.end :].lstrip()[:1] == ";" else b.end
            out.append(chunk(path, "Cpp", m[1], text[b.start : end], deps, m[2], class_name=m[2], namespace=space))
        elif (s := signature(re.sub(r"^(?:\s*(?:public|private|protected)\s*:)+", "", b.header))) and not re.search(r"(?<![=!<>])=(?!=)", s[0]):
            name = s[1]
            if "::" in name and "operator" not in name:
                owner, _, name = name.rpartition("::")
            out.append(chunk(path, "Cpp", "function", code, deps, name, class_name=owner, function_name=name, parameters=c_parameters(s[2]), return_type=_type(re.sub(r"\b(?:inline|static|virtual|explicit|constexpr|friend|template\s*<[^>]*>)\s*", "", s[0])) or None, namespace=space))
            spans.append((b.start, b.end))
    rest = remainder(text, spans)
    return out + ([chunk(path, "Generic", "remainder", rest, deps)] if rest else [])


_MODIFIERS = r"\b(?:public|private|protected|internal|static|sealed|abstract|virtual|override|readonly|async|partial|extern|unsafe|new|final|native|synchronized|default|strictfp|transient|volatile|required)\b\s*"
_ATTRIBUTES = re.compile(r"^(?:\s*(?:\[[^\]]*\]|@[\w.]+(?:\([^)]*\))?))+\s*")


def _bare(header: str) -> str:
    return re.sub(_MODIFIERS, "", _ATTRIBUTES.sub("", header)).strip()


def _typed(text: str) -> list[dict]:
    out = []
    for p in split_list(text):
        p = re.sub(r"\s*=.*$", "", _ATTRIBUTES.sub("", p), flags=re.S)
        p = re.sub(r"^(?:final|this|ref|out|in|params)\s+", "", p.strip())
        kind, _, name = p.rpartition(" ")
        out.append({"name": name.strip(), "type": kind.strip()})
    return out


_CS_TYPE = re.compile(r"(?:^|\s)(class|interface|struct|record(?:\s+(?:class|struct))?|enum)\s+(\w+)")


def csharp(path: str, text: str) -> list[dict]:
    """O3. A class's chunk is its header with its properties; there is no remainder."""
    m = masked(text)
    deps = [re.sub(r"^\w+\s*=\s*", "", re.sub(r"^(?:static|unsafe)\s+", "", x.strip())) for x in re.findall(r"(?m)^\s*(?:global\s+)?using\s+([^;()]+);", m)]
    out, all_blocks = [], blocks(m)
    for b in all_blocks:
        t = _CS_TYPE.search(_bare(b.header))
        up = [x for p in b.up() if (x := _CS_TYPE.search(_bare(p.header)))]
        if any(signature(p.header) and not _CS_TYPE.search(_bare(p.header)) for p in b.up()):
            continue
        if t:
            kind = t[1].split()[0]
            props = [(text[p.start : p.end], q) for p in b.children if re.search(r"\{\s*(?:\w+\s+)*(?:get|set|init)\b", m[p.open : p.end]) and (q := re.search(r"([\w<>\[\]?,.]+)\s+(\w+)\s*$", _bare(p.header)))]
            properties = [{"name": q[2], "type": q[1]} for _, q in props]
            if kind == "record" and (s := re.search(r"\(([^)]*)\)", b.header)):
                properties = _typed(s[1]) + properties
            code = text[b.start : b.end] if kind in ("interface", "enum", "struct") else text[b.start : b.open].rstrip() + "\n{\n" + "".join(f"    {p.strip()}\n" for p, _ in props) + "}"
            out.append((b.start, chunk(path, "CSharp", kind, code, deps, t[2], class_name=None if kind == "interface" else t[2], interface_name=t[2] if kind == "interface" else None, properties=properties)))
        elif (s := signature(_bare(b.header))) and up and up[0][1] != "interface" and "=" not in s[0]:
            out.append((b.start, chunk(path, "CSharp", "method", text[b.start : b.end], deps, s[1], class_name=up[0][2], function_name=s[1], parameters=_typed(s[2]), return_type=_type(s[0]) or None)))
    inside = lambda at: next((x for b in reversed(all_blocks) if b.open < at < b.end and (x := _CS_TYPE.search(_bare(b.header)))), None)
    for x in re.finditer(r"(?m)^[ \t]*((?:[\w\[\]]+\s+)*?)delegate\s+([\w<>\[\], ?]+?)\s+(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)\s*;", m):
        out.append((x.start(), chunk(path, "CSharp", "delegate", text[x.start() : x.end()].strip(), deps, x[3], function_name=x[3], parameters=_typed(x[4]), return_type=x[2])))
    for x in re.finditer(r"(?m)^[ \t]*((?:[\w.<>\[\]?,]+\s+)+)(\w+)\s*(?:<[^>]*>)?\(([^()]*)\)\s*=>[^;]*;", m):
        owner = inside(x.start())
        if owner and owner[1] != "interface" and not set(x[1].split()) & {"return", "new", "await", "var", "case"}:
            out.append((x.start(), chunk(path, "CSharp", "method", text[x.start() : x.end()].strip(), deps, x[2], class_name=owner[2], function_name=x[2], parameters=_typed(x[3]), return_type=_type(re.sub(_MODIFIERS, "", x[1])) or None)))
    for x in re.finditer(r"(?m)^[ \t]*((?:public|internal|private|sealed|abstract|partial|readonly)\s+)*record\s+(?:struct\s+|class\s+)?(\w+)\s*(?:<[^>]*>)?\(([^)]*)\)[^;{]*;", m):
        out.append((x.start(), chunk(path, "CSharp", "record", text[x.start() : x.end()].strip(), deps, x[2], class_name=x[2], properties=_typed(x[3]))))
    return in_source_order(out)


_JAVA_TYPE = re.compile(r"(?:^|\s)(class|@?interface|enum|record)\s+(\w+)")


def java(path: str, text: str) -> list[dict]:
    """O4."""
    m = masked(text)
    deps = [re.sub(r"^static\s+", "", x.strip()) for x in re.findall(r"(?m)^\s*import\s+([^;]+);", m)]
    package = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", m)
    space, out, spans = package[1] if package else None, [], []
    for b in blocks(m):
        up = [x for p in b.up() if (x := _JAVA_TYPE.search(_bare(p.header)))]
        if any(signature(p.header) and not _JAVA_TYPE.search(_bare(p.header)) for p in b.up()):
            continue
        if t := _JAVA_TYPE.search(_bare(b.header)):
            out.append(chunk(path, "Java", t[1].lstrip("@"), text[b.start : b.end], deps, t[2], class_name=t[2], namespace=space))
        elif (s := signature(_bare(b.header))) and up and "=" not in s[0]:
            kind = "constructor" if s[1] == up[0][2] and not re.sub(r"<[^>]*>", "", s[0]).strip() else "method"
            out.append(chunk(path, "Java", kind, text[b.start : b.end], deps, s[1], class_name=up[0][2], function_name=s[1], parameters=_typed(s[2]), return_type=_type(s[0]) or None, namespace=space))
            spans.append((b.start, b.end))
    rest = remainder(text, spans)
    return out + ([chunk(path, "Generic", "remainder", rest, deps)] if rest else [])


_JS_DECL = re.compile(r"(?:^|\s)(?:export\s+(?:default\s+)?)?(async\s+)?function\s*(\*)?\s*([\w$]+)?\s*(?:<[^()]*>)?\s*\(")
_JS_BOUND = re.compile(r"(?:^|\s)(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+(?:=>[^=]+)?)?=\s*(?:(?!async\b)[\w$.]+\s*(?:<[^()]*>)?\(\s*)*(async\s+)?(?:function\s*(\*)?\s*[\w$]*\s*)?(?:<[^()]*>\s*)?\(?")
_JS_METHOD = re.compile(r"^(?:(?:public|private|protected|static|readonly|override|abstract|get|set)\s+)*(async\s+)?(\*)?\s*(#?[\w$]+|\[[^\]]*\])\s*(?:<[^()]*>)?\(")
_JS_CLASS = re.compile(r"(?:^|\s)(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+([\w$]+)")


def js_dependencies(text: str) -> list[str]:
    found = re.finditer(r"""(?m)^\s*(?:import|export)\b[^;'"]*?['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]\s*\)|\bimport\(\s*['"]([^'"]+)['"]\s*\)""", text)
    return list(dict.fromkeys(m[1] or m[2] or m[3] for m in found))


def _js_parameters(text: str) -> list[dict]:
    out = []
    for p in split_list(text):
        p = re.sub(r"^(?:public|private|protected|readonly)\s+", "", p)
        name, _, kind = (p, "", "") if p.startswith(("{", "[")) and ":" not in p[closing(p, 0, p[0] + "}]"["{[".index(p[0])]) :] else p.partition(":") if not p.startswith("{") else (p[: closing(p, 0, "{}") + 1], ":", p[closing(p, 0, "{}") + 1 :].lstrip(": "))
        out.append({"name": re.sub(r"\s*=.*$", "", name, flags=re.S).strip().rstrip("?"), "type": re.sub(r"\s*=[^>].*$", "", kind, flags=re.S).strip()})
    return out


def _js_functions(m: str) -> list[tuple[Block, dict]]:
    """Blocks that are functions, each with its name, parameters and flags; bodies without braces aren't found here."""
    out = []
    for b in blocks(m):
        h = b.header.strip()
        owner = next((x[1] for p in b.up() if (x := _JS_CLASS.search(p.header))), None)
        direct = b.parent is not None and _JS_CLASS.search(b.parent.header)
        if d := _JS_DECL.search(h):
            at = h.index("(", d.end() - 1)
            bound = _JS_BOUND.search(h)
            name = d[3] or (bound[1] if bound else None)
            if bound and not d[3] or name and not re.search(r"[=(,:]\s*(?:async\s+)?function", h):
                out.append((b, {"name": name, "args": h[at + 1 : closing(h, at)], "after": h[closing(h, at) + 1 :], "is_async": bool(d[1] or bound and bound[2]), "is_generator": bool(d[2]), "bound": bool(bound), "owner": None}))
                continue
            if bound:
                out.append((b, {"name": bound[1], "args": h[at + 1 : closing(h, at)], "after": h[closing(h, at) + 1 :], "is_async": bool(bound[2]), "is_generator": bool(d[2]), "bound": True, "owner": None}))
        elif h.endswith("=>") and (x := _JS_BOUND.search(h)):
            rest = h[x.end() - (h[x.end() - 1 : x.end()] == "(") :]
            args = rest[1 : closing(rest, 0)] if rest.startswith("(") else rest.removesuffix("=>").strip()
            out.append((b, {"name": x[1], "args": args, "after": rest[closing(rest, 0) + 1 :] if rest.startswith("(") else "", "is_async": bool(x[2]), "is_generator": False, "bound": True, "owner": None}))
        elif direct and (x := _JS_METHOD.match(h)) and x[3] not in CONTROL:
            at = x.end() - 1
            out.append((b, {"name": x[3], "args": h[at + 1 : closing(h, at)], "after": h[closing(h, at) + 1 :], "is_async": bool(x[1]), "is_generator": bool(x[2]), "bound": False, "owner": owner}))
    return out


def _whole(text: str, b: Block) -> tuple[int, int]:
    """A function's span with the end of its declaration."""
    m = re.match(r"[ \t]*\)*[ \t]*(?:,\s*\[[^\]]*\]\s*\))?;?", text[b.end :])
    return b.start, b.end + (m.end() if m and (m[0].strip()) else 0)


_SCRIPT = ("//",), (("/*", "*/"),), "\"'`"


def _script(path: str, text: str, kind: str) -> list[dict]:
    m, deps, out, spans = masked(text, *_SCRIPT), js_dependencies(text), [], []
    found = _js_functions(m)
    inside = lambda b: any(any(p is o for o, _ in found) for p in b.up())
    for b, f in found:
        if inside(b):
            continue
        span = _whole(m, b)
        after = re.match(r"\s*:\s*(.+?)\s*(?:=>)?\s*$", f["after"], re.S)
        out.append((b.start, chunk(path, kind, "method" if f["owner"] else "function", text[span[0] : span[1]], deps, f["name"], class_name=f["owner"], function_name=f["name"], parameters=_js_parameters(f["args"]), return_type=after[1] if after and kind == "TypeScript" else None, is_method=f["owner"] is not None, is_async=f["is_async"], is_generator=f["is_generator"])))
        spans.append(span)
    if kind == "TypeScript":
        for b in blocks(m):
            if x := re.search(r"(?:^|\s)(?:export\s+)?(?:declare\s+)?(?:const\s+)?(interface|enum)\s+(\w+)", b.header):
                out.append((b.start, chunk(path, kind, x[1], text[b.start : b.end], deps, x[2], class_name=x[2])))
                spans.append((b.start, b.end))
        for x in re.finditer(r"(?m)^[ \t]*(?:export\s+)?type\s+(\w+)\s*(?:<[^=]*>)?\s*=", m):
            end = x.end()
            depth = 0
            while end < len(m) and not (m[end] == ";" and depth == 0):
                depth += (m[end] in "{([") - (m[end] in "})]")
                if m[end] == "\n" and depth == 0 and not re.match(r"\s*[|&]", m[end:]) and m[x.end() : end].strip() and not m[:end].rstrip().endswith(("|", "&", "=")):
                    break
                end += 1
            out.append((x.start(), chunk(path, kind, "type", text[x.start() : end + 1].strip(), deps, x[1], class_name=x[1])))
            spans.append((x.start(), end + 1))
    rest = remainder(text, spans)
    return in_source_order(out) + ([chunk(path, "Generic", "remainder", rest, deps)] if rest else [])


def javascript(path: str, text: str) -> list[dict]:
    """O5."""
    return _script(path, text, "JavaScript")


def typescript(path: str, text: str) -> list[dict]:
    """O6."""
    return _script(path, text, "TypeScript")


def react(path: str, text: str) -> list[dict]:
    """O7."""
    m, deps, out, spans = masked(text, *_SCRIPT), js_dependencies(text), [], []
    found = _js_functions(m)
    jsx = lambda b: bool(re.search(r"(?:return\s*\(?|=>\s*\(?|[?:&(]\s*)<[A-Za-z>]", m[b.open : b.end]))
    hooks = lambda code: sorted(set(re.findall(r"\b(use[A-Z]\w*)\s*(?:<[^()]*>)?\(", code)))
    exported = lambda b, name: b.header.strip().startswith("export") or bool(re.search(rf"export\s+default\s+(?:\w+\(\s*)?{re.escape(name)}\b|export\s*\{{[^}}]*\b{re.escape(name)}\b", m))

    def kind_of(b: Block, f: dict) -> str | None:
        if re.match(r"use[A-Z]", f["name"]):
            return "hook"
        return "component" if f["name"][:1].isupper() and jsx(b) else None

    chosen = [(b, f, k) for b, f in found if not f["owner"] and (k := kind_of(b, f))]
    for b, f, k in chosen:
        parent = next((g["name"] for p in b.up() for o, g, _ in chosen if o is p), None)
        span = _whole(m, b)
        props = [x.strip().split(":")[0].split("=")[0].strip() for x in re.sub(r"[{}]", "", f["args"].partition("}")[0] if f["args"].strip().startswith("{") else f["args"].partition(":")[0]).split(",") if x.strip()]
        out.append(chunk(path, "React", k, text[span[0] : span[1]], deps, f["name"], component_name=f["name"], is_functional=True, hooks_used=hooks(m[b.open : b.end]), props=props, component_type=k, parent_component=parent, is_exported=exported(b, f["name"])))
        spans.append(span)
        for c, g in found:
            if not any(c is o for o, _, _ in chosen) and next((o for p in c.up() for o, _ in found if o is p), None) is b:
                out.append(chunk(path, "React", "inner_function", text[c.start : c.end], deps, g["name"], component_name=g["name"], is_functional=True, hooks_used=hooks(m[c.open : c.end]), props=[], component_type="inner_function", parent_component=f["name"], is_exported=False))
    for b in blocks(m):
        if (x := re.search(r"class\s+(\w+)\s+extends\s+(?:React\.)?(?:Pure)?Component", b.header)) and not list(b.up()):
            out.append(chunk(path, "React", "component", text[b.start : b.end], deps, x[1], component_name=x[1], is_functional=False, hooks_used=[], props=[], component_type="class", is_exported=exported(b, x[1])))
            spans.append((b.start, b.end))
    rest = remainder(text, spans)
    return out + ([chunk(path, "Generic", "remainder", rest, deps)] if rest else [])


_RUST_FN = re.compile(r"(?:^|\s)fn\s+(\w+)\s*(?:<)?")
_RUST_TYPE = re.compile(r"(?:^|\s)(struct|enum|trait)\s+(\w+)")
_RUST_IMPL = re.compile(r"(?:^|\s)impl\s*(?:<[^{]*?>)?\s*(?:[\w:<>, '&]+\s+for\s+)?([\w:]+(?:<[^{]*?>)?)\s*(?:where.*)?$", re.S)


def rust(path: str, text: str) -> list[dict]:
    """O8. Attributes and documentation comments right before an item belong to it."""
    m = masked(text, quotes='"\'')
    deps = [re.sub(r"\s+", " ", re.sub(r"\s+as\s+\w+$", "", x.strip())) for x in re.findall(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", m)]
    out, spans = [], []

    def owner(b: Block) -> str | None:
        for p in b.up():
            if t := re.search(r"(?:^|\s)trait\s+(\w+)", p.header):
                return t[1]
            if i := _RUST_IMPL.search(p.header.strip()):
                return re.sub(r"\s+", "", i[1])
        return None

    for b in blocks(m):
        space = next((x[1] for p in b.up() if (x := re.search(r"(?:^|\s)mod\s+(\w+)\s*$", p.header.strip()))), None)
        if any(_RUST_FN.search(p.header) for p in b.up()):
            continue
        if (f := _RUST_FN.search(b.header)) and "macro_rules" not in b.header:
            at = b.header.index("(", f.end() - 1)
            end = closing(b.header, at)
            args = [{"name": n.strip().removeprefix("mut ").strip(), "type": k.strip()} for n, _, k in (p.partition(":") for p in split_list(b.header[at + 1 : end]))]
            ret = re.match(r"\s*->\s*(.+?)\s*(?:\bwhere\b.*)?$", b.header[end + 1 :], re.S)
            out.append((b.start, chunk(path, "Rust", "function", text[b.start : b.end], deps, f[1], class_name=owner(b), function_name=f[1], parameters=args, return_type=ret[1].strip() if ret else None, namespace=space)))
        elif t := _RUST_TYPE.search(b.header):
            out.append((b.start, chunk(path, "Rust", t[1], text[b.start : b.end], deps, t[2], class_name=t[2], namespace=space)))
        else:
            continue
        spans.append((b.start, b.end))
    covered = lambda at: any(a <= at < e for a, e in spans)
    for x in re.finditer(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)\s*(?:<[^;{]*>)?\s*(?:\([^;]*\))?\s*;", m):
        if not covered(x.start()):
            out.append((x.start(), chunk(path, "Rust", "struct", text[x.start() : x.end()].strip(), deps, x[1], class_name=x[1])))
            spans.append((x.start(), x.end()))
    rest = remainder(text, spans)
    return in_source_order(out) + ([chunk(path, "Generic", "remainder", rest, deps)] if rest else [])
