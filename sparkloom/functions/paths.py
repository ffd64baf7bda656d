"""Which files are taken in: skip rules and languages by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import basename, extension

IMAGES = "png jpg jpeg".split()
#: Endings, names and folders that are never taken in.
SKIP_EXTENSIONS = "map woff woff2 ttf otf eot ico svg gif webp bmp mp3 mp4 wav zip gz tar 7z rar bin exe dll so dylib pdb lock sum chm chw".split()
MINIFIED = ".min.js .min.mjs .min.cjs .bundle.js .min.css".split()
SKIP_NAMES = "package-lock.json yarn.lock pnpm-lock.yaml cargo.lock composer.lock go.sum .ds_store thumbs.db".split()
SKIP_FOLDERS = "node_modules .git dist build target .vs bin obj test tests __tests__ spec specs fixtures .github coverage .nyc_output vendor third_party third-party".split()
LANGUAGES = {
    "c": "C", "h": "C", "cpp": "Cpp", "hpp": "Cpp", "cc": "Cpp", "cxx": "Cpp", "hh": "Cpp", "cs": "CSharp", "java": "Java", "js": "JavaScript", "mjs": "JavaScript",
    "cjs": "JavaScript", "ts": "TypeScript", "tsx": "React", "jsx": "React", "rs": "Rust", "py": "Python", "pyi": "Python", "sql": "Sql",
}


def skipped(path: Column) -> Column:
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    name = basename(p)
    folders = F.split(p, "/")
    return (
        extension(p).isin(IMAGES + SKIP_EXTENSIONS)
        | F.exists(F.array(*map(F.lit, MINIFIED)), lambda e: name.endswith(e))
        | name.isin(SKIP_NAMES)
        | F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_FOLDERS)))
    )


def is_skipped(path: str) -> bool:
    p = path.lower().replace("\\", "/")
    name = p.rpartition("/")[2]
    ext = name.rpartition(".")[2] if "." in name[1:] else ""
    return ext in IMAGES + SKIP_EXTENSIONS or name.endswith(tuple(MINIFIED)) or name in SKIP_NAMES or any(x in SKIP_FOLDERS for x in p.split("/"))


def is_code(path: Column) -> Column:
    return extension(path).isin(list(LANGUAGES))


def language(path: str) -> str | None:
    return LANGUAGES.get(path.rpartition(".")[2].lower()) if "." in path else None


def language_column(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), extension(path))
