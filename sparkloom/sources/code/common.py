"""What the chunkers share: masking of comments and strings, blocks of braces, spans, chunks, cleaning."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from sparkloom.schema import KIND_FIELDS, PARAMETER

KIND_NAMES = re.findall(r"(?:^|, )(\w+) (?=string|boolean|array)", KIND_FIELDS.replace(PARAMETER, ""))


def expand_tabs(text: str, width: int = 4) -> str:
    return "\n".join(line.expandtabs(width) for line in text.split("\n"))


def dedent(text: str) -> str:
    lines = text.split("\n")
    margin = min((len(x) - len(x.lstrip(" \t")) for x in lines if x.strip()), default=0)
    return "\n".join(x[margin:] if x.strip() else x.strip(" \t") for x in lines)


def normalize_code(code: str) -> str:
    """K7."""
    lines = [x.rstrip() for x in code.replace("\r\n", "\n").removesuffix("\n").split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines))
    return text if text.strip() else "\n"


def clean_code(code: str) -> str:
    """K8: tabs expanded, margin and trailing blanks gone, blank lines collapsed, empty braces closed up."""
    text = dedent(expand_tabs(code))
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in text.split("\n")))
    text = re.sub(r"\{\s*get;\s*set;\s*\}", "{get;set;}", text)
    return re.sub(r"[ \t]*\{\s*\}", "{}", text).strip()


def chunk_id(path: str, name: str, code: str) -> str:
    """Base name, identifier, eight hexadecimal digits."""
    base = path.replace("\\", "/").rpartition("/")[2]
    return f"{base}-{name}-{hashlib.sha256(f'{path}\0{name}\0{code}'.encode()).hexdigest()[:8]}"


def chunk(path: str, kind: str, type_: str, code: str, deps: list[str], name: str = "", **fields) -> dict:
    unknown = set(fields) - set(KIND_NAMES)
    if unknown:
        raise KeyError(f"no such fields: {unknown}")
    return {"id": chunk_id(path, name or type_, code), "file_name": path, "kind": kind, "type": type_, "code": normalize_code(code), "dependencies": deps, **dict.fromkeys(KIND_NAMES), **fields}


def masked(text: str, line: tuple[str, ...] = ("//",), block: tuple[tuple[str, str], ...] = (("/*", "*/"),), quotes: str = "\"'", nested: bool = False, keep_strings: bool = False) -> str:
    """The text with comments (and the insides of strings) blanked out, of the same length; newlines stay."""
    out, i, n = list(text), 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, b):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        start = next((b for b in block if text.startswith(b[0], i)), None)
        if start:
            depth, j = 1, i + len(start[0])
            while j < n and depth:
                if text.startswith(start[1], j):
                    depth, j = depth - 1, j + len(start[1])
                elif nested and text.startswith(start[0], j):
                    depth, j = depth + 1, j + len(start[0])
                else:
                    j += 1
            blank(i, j)
            i = j
        elif text.startswith(line, i):
            j = text.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
            i = j
        elif text[i] in quotes:
            q, j = text[i], i + 1
            if q == "'" and re.match(r"'[A-Za-z_]\w*(?!')", text[i : i + 40]) and "`" not in quotes:
                i += 1  # a lifetime or a label
                continue
            while j < n and text[j] != q and (q == "`" or text[j] != "\n"):
                j += 2 if text[j] == "\\" else 1
            if not keep_strings:
                blank(i + 1, min(j, n))
            i = j + 1
        else:
            i += 1
    return "".join(out)


_COMMENT = re.compile(r"""'(?:''|\\.|[^'])*'?|"(?:\\.|[^"])*"?|`(?:\\.|[^`])*`?|/\*|\(\*|(?://|--|#)[^\n]*""", re.S)
_EDGES = {"/*": re.compile(r"/\*|\*/"), "(*": re.compile(r"\(\*|\*\)")}


def strip_comments(text: str) -> str:
    """Without comments of all the usual kinds, outside quotes; a block, nested or not, leaves a newline, and at most two stay in a row."""
    out, at = [], 0
    while m := _COMMENT.search(text, at):
        out.append(text[at : m.start()])
        at, edge = m.end(), _EDGES.get(m[0])
        if edge:
            depth = 1
            while depth and (e := edge.search(text, at)):
                depth, at = depth + (1 if e[0] == m[0] else -1), e.end()
            at = len(text) if depth else at
            out.append("\n")
        elif m[0][0] in "'\"`":
            out.append(m[0])
    return re.sub(r"\n{3,}", "\n\n", "".join([*out, text[at:]]))


@dataclass
class Block:
    """A pair of braces: header and span in the text, and the blocks inside."""

    start: int
    open: int
    end: int = -1
    header: str = ""
    parent: Block | None = None
    children: list[Block] = field(default_factory=list)

    def up(self):
        node = self.parent
        while node is not None and node.header is not None:
            yield node
            node = node.parent


def blocks(text: str) -> list[Block]:
    """All blocks of masked text in order. A header starts after the last statement's end; preprocessor lines end one too."""
    top = Block(0, 0, len(text))
    here, out, boundary, parens, saved = top, [], 0, 0, []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "#" and not text[text.rfind("\n", 0, i) + 1 : i].strip() and not text.startswith("#[", i):
            while (j := text.find("\n", i)) >= 0 and text[j - 1] == "\\":
                i = j + 1
            i = n if j < 0 else j
            boundary = i + 1 if not text[boundary:i].split("\n")[0].strip() or parens == 0 else boundary
        elif c in "([":
            parens += 1
        elif c in ")]":
            parens = max(0, parens - 1)
        elif c == ";" and parens == 0:
            boundary = i + 1
        elif c == "{":
            start = boundary
            while start < i and text[start].isspace():
                start += 1
            child = Block(start, i, header=text[start:i], parent=here)
            here.children.append(child)
            out.append(child)
            saved.append((parens, boundary))
            here, boundary, parens = child, i + 1, 0
        elif c == "}" and here.parent is not None:
            here.end = i + 1
            parens, begun = saved.pop()
            here, boundary = here.parent, begun if parens else i + 1  # inside brackets the statement goes on
        i += 1
    while here.parent is not None:  # unclosed
        here.end = n
        here = here.parent
    for b in top.children:
        b.parent = None
    return out


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """overlapping and touching ones become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for s in spans if s[0] < s[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remainder(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; empty when only blanks are left."""
    parts, at = [], 0
    for a, b in merged_spans([(max(0, a), min(b, len(text))) for a, b in spans]):
        parts.append(text[at:a])
        at = b
    code = normalize_code("".join([*parts, text[at:]]))
    return code if code.strip() else ""


def split_list(text: str) -> list[str]:
    """At commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>" and text[i - 1 : i] not in ("-", "="))
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def closing(text: str, at: int, pair: str = "()") -> int:
    """Index of the bracket that closes the one at `at`; the text's length if none does."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == pair[0]) - (text[i] == pair[1])
        if depth == 0:
            return i
    return len(text)


def statement_end(text: str, at: int) -> int:
    end = text.find(";", at)
    return len(text) if end < 0 else end + 1
