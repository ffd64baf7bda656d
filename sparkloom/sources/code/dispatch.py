"""Files to code chunks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

from sparkloom.functions.paths import is_skipped, language
from sparkloom.functions.text import MAX_CHUNK_CHARS
from sparkloom.operators.chunk import CODE_OVERLAP, CODE_TOKENS, approximate_tokens, split_text
from sparkloom.schema import CODE_CHUNK, struct
from sparkloom.sources.code import braces
from sparkloom.sources.code.common import chunk, clean_code, normalize_code
from sparkloom.sources.code.python import python
from sparkloom.sources.code.sql import sql
from sparkloom.sources.loaders import decode_source

CHUNKERS = {"C": braces.c, "Cpp": braces.cpp, "CSharp": braces.csharp, "Java": braces.java, "JavaScript": braces.javascript, "TypeScript": braces.typescript, "React": braces.react, "Rust": braces.rust, "Python": python, "Sql": sql}
#: What a chunk's metadata has beside its base, by kind.
METADATA = {
    "C": "function_name parameters return_type namespace", "Cpp": "class_name function_name parameters return_type namespace", "CSharp": "class_name interface_name function_name parameters return_type properties",
    "Java": "class_name function_name parameters return_type namespace", "JavaScript": "class_name function_name parameters return_type is_method is_async is_generator", "TypeScript": "class_name function_name parameters return_type is_method is_async is_generator",
    "React": "component_name is_functional hooks_used props component_type parent_component", "Rust": "class_name function_name parameters return_type namespace",
    "Python": "class_name function_name alias_name alias_target parameters return_type properties decorators type_parameters bases is_method is_async is_generator is_type_alias", "Sql": "statement_type object_name schema_name database_name", "Generic": "",
}


def generic(path: str, text: str) -> list[dict]:
    """Token windows over the whole file; none for empty files and files with zero characters."""
    if not text or "\0" in text:
        return []
    return [chunk(path, "Generic", "generic", p, [], str(i)) for i, p in enumerate(split_text(text, CODE_TOKENS, CODE_OVERLAP))]


def sized(rows: list[dict]) -> list[dict]:
    """Large chunks in pieces with ids of their own, none over the hard cap; others as they are."""
    out = []
    for r in rows:
        if len(r["code"]) <= MAX_CHUNK_CHARS and approximate_tokens(r["code"]) <= CODE_TOKENS:
            out.append(r)
            continue
        for i, piece in enumerate(split_text(r["code"], CODE_TOKENS, CODE_OVERLAP)):
            for j in range(0, len(piece), MAX_CHUNK_CHARS):
                out.append(r | {"id": f"{r['id']}-{i}-{j // MAX_CHUNK_CHARS}", "code": normalize_code(piece[j : j + MAX_CHUNK_CHARS])})
    return out


def code_chunks(path: str, data: bytes, repo: str | None = None, at: str | None = None) -> list[dict]:
    text = decode_source(data)
    chunker = CHUNKERS.get(language(path) or "")
    rows = sized((chunker(path, text) if chunker and "\0" not in text else []) or generic(path, text))
    return [r | {"repo_name": repo, "created_at": at, "code": clean_code(r["code"])} for r in rows]


def _value(r: dict, key: str) -> str:
    v = r.get(key)
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if key == "parameters":
        form = (lambda p: p["type"]) if r["kind"] == "Python" else lambda p: f"{p['type']} {p['name']}".strip()
        return ", ".join(map(form, v))
    if key == "properties":
        return ", ".join(f"{p['name']}: {p['type']}" if r["kind"] == "Python" else f"{p['type']} {p['name']}".strip() for p in v)
    return ", ".join(v) if isinstance(v, list) else str(v)


def metadata(r: dict) -> dict[str, str]:
    """C6."""
    base = {"repo_name": r.get("repo_name") or "", "file_name": r["file_name"], "type": r["type"], "code": r["code"], "dependencies": ", ".join(r["dependencies"]), "created_at": r.get("created_at") or ""}
    return base | {k: _value(r, k) for k in METADATA[r["kind"]].split()}


def embedding_text(r: dict) -> str:
    """Labelled lines; empty ones are left out. Flags are printed by scripts always, by Python when they hold."""
    lines = [("Repo Name", r.get("repo_name") or ""), ("File Name", r["file_name"])]
    for key in METADATA[r["kind"]].split():
        label = key.replace("is_", "").replace("_", " ").title()
        v = _value(r, key)
        if key.startswith("is_"):
            v = ("True" if r.get(key) else "") if r["kind"] == "Python" else "True" if r.get(key) else "False"
        lines.append((label, v))
    text = [f"{k}: {v}" for k, v in lines if v]
    text.append("Code:\n" + r["code"])
    if r["dependencies"]:
        text.append("Dependencies: " + ", ".join(r["dependencies"]))
    return "\n".join(text)


def document_chunk(r: dict, position: int) -> dict:
    """C13."""
    name = r["file_name"]
    return {"id": r["id"], "file_name": name, "content": r["code"], "doc_type": name.rpartition(".")[2].lower() if "." in name else "txt", "chunk_index": position, "page": None, "metadata": json.dumps(metadata(r)), "created_at": r.get("created_at")}


def chunk_code(files: DataFrame, repo: str | None = None, at: str | None = None) -> DataFrame:
    """Code chunks of (path, content) rows; files that are never taken in give none."""
    names = struct(CODE_CHUNK).names

    def run(batches):
        for batch in batches:
            rows = [r for p, d in zip(batch["path"], batch["content"], strict=True) if not is_skipped(p) for r in code_chunks(p, bytes(d), repo, at)]
            yield pd.DataFrame([{k: r.get(k) for k in names} for r in rows], columns=names)

    return files.select("path", "content").mapInPandas(run, CODE_CHUNK)
