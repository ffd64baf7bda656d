"""The SQL chunker: boilerplate and comments go, statements are split outside quotes and bodies, classified and named."""

from __future__ import annotations

import re

from sparkloom.sources.code.common import chunk

#: What a statement that is kept starts with.
KNOWN = (
    "CREATE TABLE", "CREATE VIRTUAL TABLE", "CREATE VIEW", "CREATE MATERIALIZED VIEW", "CREATE INDEX", "CREATE UNIQUE INDEX", "CREATE FUNCTION", "CREATE PROCEDURE", "CREATE TRIGGER", "CREATE TYPE", "CREATE TYPE BODY",
    "CREATE SEQUENCE", "CREATE SCHEMA", "CREATE DATABASE", "CREATE EXTENSION", "CREATE ROLE", "CREATE POLICY", "CREATE TABLESPACE", "CREATE SYNONYM", "CREATE PACKAGE", "CREATE PACKAGE BODY", "CREATE OR REPLACE", "ALTER TABLE",
    "ALTER VIEW", "ALTER INDEX", "ALTER SCHEMA", "DROP TABLE", "DROP VIEW", "DROP FUNCTION", "DROP PROCEDURE", "DROP INDEX", "DROP TYPE", "DROP SEQUENCE", "DROP EXTENSION", "DROP SCHEMA", "DROP TRIGGER", "INSERT", "SELECT",
    "UPDATE", "DELETE", "MERGE", "GRANT", "REVOKE",
)
#: Objects after OR REPLACE that name a type of their own.
REPLACED = ("PACKAGE BODY", "PACKAGE", "PUBLIC SYNONYM", "SYNONYM", "TYPE BODY", "TYPE", "PROCEDURE", "FUNCTION", "TRIGGER")
DML = ("INSERT", "SELECT", "UPDATE", "DELETE", "MERGE", "GRANT", "REVOKE")
#: What CREATE, ALTER and DROP can be about, as tuples of words; the longest that fits is taken.
_KINDS = sorted({tuple(k.split()[1:]) for k in KNOWN if k.split()[0] in ("CREATE", "ALTER", "DROP") and not k.endswith("REPLACE")} | {tuple(k.split()) for k in REPLACED}, key=len, reverse=True)
_ROUTINES = {("FUNCTION",), ("PROCEDURE",), ("TRIGGER",), ("PACKAGE",), ("PACKAGE", "BODY"), ("TYPE", "BODY")}
_KEYWORD = re.compile(r"\s*([A-Za-z]+)")
_NAME = re.compile(r"\s*([^\s(]+)")
_TOKEN = re.compile(r"'[^']*'?|\"[^\"]*\"?|`[^`]*`?|\$(?:[A-Za-z_]\w*)?\$|\w+|[();]")
_COMMENT = re.compile(r"'[^']*'?|\"[^\"]*\"?|`[^`]*`?|\$(?:[A-Za-z_]\w*)?\$|--[^\n]*|/\*")
_EDGE = re.compile(r"/\*|\*/")


def _keyword(text: str, at: int) -> tuple[str, int]:
    """(the word that stands there in upper case, where it ends); an empty word if there is none."""
    m = _KEYWORD.match(text, at)
    return (m[1].upper(), m.end()) if m else ("", at)


def _passed(text: str, at: int, words: tuple[str, ...]) -> int | None:
    """Where these words end, if they stand there one after another."""
    for want in words:
        word, at = _keyword(text, at)
        if word != want:
            return None
    return at


def definition(text: str, at: int = 0) -> tuple[str, tuple[str, ...], int] | None:
    """(verb, kind of object, where the kind ends) of a CREATE, ALTER or DROP that stands there."""
    verb, at = _keyword(text, at)
    if verb not in ("CREATE", "ALTER", "DROP"):
        return None
    for optional in (("OR", "REPLACE"), ("PUBLIC",), ("UNIQUE",)):
        at = _passed(text, at, optional) or at
    for kind in _KINDS:
        if end := _passed(text, at, kind):
            return verb, kind, end
    return None


def dollar_spans(text: str) -> list[tuple[int, int]]:
    """From an opening tag to the end of the equal closing one, outside single quotes; an unclosed one goes to the end."""
    out, at, found = [], 0, re.compile(r"'(?:[^']|'')*'|\$(?:[A-Za-z_]\w*)?\$").search
    while m := found(text, at):
        at = m.end()
        if m[0][0] == "$":
            at = _closed(text, m[0], at)
            out.append((m.start(), at))
    return out


def _closed(text: str, tag: str, at: int) -> int:
    end = text.find(tag, at)
    return len(text) if end < 0 else end + len(tag)


def strip_sql_comments(text: str) -> str:
    """`--` and nested `/* */`, outside quotes and dollar quotes."""
    out, at = [], 0
    while m := _COMMENT.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "/*":
            depth = 1
            while depth:
                edge = _EDGE.search(text, at)
                if edge is None:
                    at = len(text)
                    break
                depth, at = depth + (1 if edge[0] == "/*" else -1), edge.end()
            out.append(" ")
        elif not m[0].startswith("--"):
            at = _closed(text, m[0], at) if m[0][0] == "$" else at
            out.append(text[m.start() : at])
    return "".join([*out, text[at:]])


def strip_boilerplate(text: str) -> tuple[str, str | None]:
    """(text without the lines of batch separators and session settings, brackets unwrapped; the database that it uses)."""
    database, kept = None, []
    for line in text.split("\n"):
        bare = line.strip().lstrip("\ufeff")
        words = bare.upper().split()
        if use := re.fullmatch(r"(?i)use\s+\[?([^\s;\]]+)\]?\s*;?", bare):
            database = use[1]
        elif not (words in (["GO"], ["/"]) or len(words) == 3 and words[0] == "SET" and words[1] in ("ANSI_NULLS", "QUOTED_IDENTIFIER") and words[2] in ("ON", "OFF")):
            kept.append(line)
    return re.sub(r"\[([^\]]*)\]", r"\1", "\n".join(kept)), database


def statement_type(code: str) -> str:
    """K23."""
    text = " ".join(code.split()).upper()
    if m := re.match(rf"CREATE OR REPLACE ({'|'.join(REPLACED)})", text):
        return f"CREATE OR REPLACE {m[1]}"
    for known in sorted((k for k in KNOWN if " " in k and not k.endswith("REPLACE")), key=len, reverse=True):
        if text.startswith(known):
            return known
    words = text.split()
    if not words:
        return "UNKNOWN"
    return words[0] if words[0] in DML else " ".join(words[:2])


def object_name(code: str) -> tuple[str | None, str | None]:
    """(schema, object): of a definition what follows its kind, of a grant what follows ON."""
    text = code.strip()
    if found := definition(text):
        at = found[2]
        for optional in (("IF", "EXISTS"), ("IF", "NOT", "EXISTS")):
            at = _passed(text, at, optional) or at
    elif _keyword(text, 0)[0] in ("GRANT", "REVOKE"):
        at = next((m.end() for m in re.finditer(r"\w+", text) if m[0].upper() == "ON"), len(text))
    else:
        return None, None
    name = _NAME.match(text, at)
    schema, *rest = name[1].rstrip(";,").translate({ord("["): None, ord("]"): None}).split(".") if name else [""]
    return (schema, rest[-1]) if rest else (None, schema or None)


class _Statement:
    """What is known of a statement from the words read so far: enough to tell whether a semicolon or a new object ends it."""

    def __init__(self, text: str, at: int):
        at += len(text[at : at + 4096]) - len(text[at : at + 4096].lstrip())
        kind = (definition(text, at) or ("", (), 0))[1]
        if not kind and (m := re.compile(r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?DEFINER\s*=\s*\S+").match(text, at)):
            kind = next((k for k in _KINDS if _passed(text, m.end(), k)), ())
        self.routine, self.package = kind in _ROUTINES, kind[:1] == ("PACKAGE",) or kind[-1:] == ("BODY",)
        self.parens = self.blocks = self.opened = self.count = 0
        self.seen: set[str] = set()
        self.returned = -9
        self.last = ""

    def read(self, word: str, following: str) -> None:
        closes = word == "END" and following not in ("IF", "LOOP", "WHILE", "REPEAT")
        opens = word in ("BEGIN", "CASE") and self.last != "END"
        self.blocks += opens - closes
        self.opened += opens - closes
        self.seen.add(word)
        self.count += 1
        if word == "RETURN":
            self.returned = self.count
        self.last = word

    def inside(self) -> bool:
        """In a block of a routine."""
        return self.routine and self.blocks > 0

    def declaring(self) -> bool:
        """In the head of a routine whose body hasn't begun; packages until their own END."""
        if not self.routine:
            return False
        if self.package:
            return self.opened + 1 > 0
        if self.seen & {"BEGIN", "LANGUAGE", "$$"}:
            return False
        return bool(self.seen & {"IS", "DECLARE"}) or "AS" in self.seen and "SELECT" not in self.seen and self.count - self.returned >= 8


def statements(text: str) -> list[str]:
    """Split at semicolons outside quotes, dollar quotes, brackets and the bodies of routines, and where a new object begins a line.

    One pass over the words; time is linear in the text.
    """
    out, at, end, now = [], 0, 0, _Statement(text, 0)
    m = _TOKEN.search(text)
    while m:
        token, start = m[0], m.start()
        gap = text[end:start]
        end = _closed(text, token, m.end()) if token[0] == "$" else m.end()
        following = _TOKEN.search(text, end)
        if token[0] == "$":
            now.seen.add("$$")
        elif token in "()":
            now.parens = max(0, now.parens + (1 if token == "(" else -1))
        elif token == ";":
            if now.parens == 0 and not now.inside() and not now.declaring():
                out.append(text[at:end])
                at, now = end, _Statement(text, end)
        elif (token[0].isalpha() or token[0] == "_") and not gap.endswith("."):
            word = token.upper()
            may_start = word in ("CREATE", "ALTER", "DROP", "GRANT", "REVOKE") and "\n" in gap and now.parens == 0 and not now.inside()
            if may_start and text[at:start].strip() and (word in ("GRANT", "REVOKE") or definition(text, start)):
                out.append(text[at:start])
                at, now = start, _Statement(text, start)
            now.read(word, following[0].upper() if following else "")
        m = following
    return [x for x in (piece.strip() for piece in [*out, text[at:]]) if x]


def merge_alters(rows: list[dict]) -> list[dict]:
    """alterations of one table are one chunk, in order of first appearance, behind all other statements."""
    others, tables = [], {}
    for r in rows:
        if (r["statement_type"] or "").startswith("ALTER TABLE") and r["object_name"]:
            tables.setdefault(r["object_name"].lower(), []).append(r)
        else:
            others.append(r)
    return others + [same[0] | {"code": "\n\n".join(x["code"] for x in same)} for same in tables.values()]


def sql(path: str, text: str) -> list[dict]:
    """O10."""
    body, database = strip_boilerplate(text)
    rows = []
    for code in statements(strip_sql_comments(body)):
        kind = statement_type(code)
        schema, name = object_name(code)
        rows.append(chunk(path, "Sql", kind, code, [], name or kind.lower().replace(" ", "_"), statement_type=kind, object_name=name, schema_name=schema, database_name=database))
    return [r for r in merge_alters(rows) if any(r["statement_type"].startswith(k) for k in KNOWN)]
