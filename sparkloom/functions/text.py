"""Text scalars as column expressions: tokens, cleaning, splitting, names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKEN = 40
CLAMP_CHARS = 4000
MAX_CHUNK_CHARS = 6000

#: English stop words.
STOP_WORDS = (
    "a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by can "
    "couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during each few for from further had hadn hadn't has hasn "
    "hasn't have haven haven't having he her here hers herself him himself his how i if in into is isn isn't it it's its itself just ll m ma me "
    "mightn mightn't more most mustn mustn't my myself needn needn't no nor not now o of off on once only or other our ours ourselves out over "
    "own re s same shan shan't she she's should should've shouldn shouldn't so some such t than that that'll the their theirs them themselves "
    "then there these they this those through to too under until up ve very was wasn wasn't we were weren weren't what when where which while "
    "who whom why will with won won't wouldn wouldn't y you you'd you'll you're you've your yours yourself yourselves"
).split()


def tokens(text: Column) -> Column:
    """K1: lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{IsAlphabetic}\p{N}_]+"), F.lit(0))


def content_tokens(text: Column) -> Column:
    """K1-K3: tokens of at most 40 characters that aren't stop words, repeats included."""
    return F.filter(tokens(text), lambda x: (F.char_length(x) <= MAX_TOKEN) & ~x.isin(STOP_WORDS))


def clamp(text: Column) -> Column:
    """K6: what encoders get."""
    return F.substring(text, 1, CLAMP_CHARS)


def normalize_code(code: Column) -> Column:
    """K7: lines without trailing white space, at most one blank line in a row, no final newline; blank code is one newline."""
    x = F.regexp_replace(code, "\r\n", "\n")
    x = F.regexp_replace(x, r"\n\z", "")
    x = F.regexp_replace(x, r"[^\S\n]+(?=\n|\z)", "")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.when(F.trim(F.regexp_replace(x, r"\s+", "")) == "", F.lit("\n")).otherwise(x)


def hard_split(text: Column, size: int = MAX_CHUNK_CHARS) -> Column:
    """Consecutive pieces of at most `size` characters; the whole if size is 0."""
    if size == 0:
        return F.array(text)
    last = F.greatest((F.char_length(text) - 1).cast("bigint"), F.lit(0).cast("bigint"))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor(last / size).cast("bigint")), lambda i: F.substring(text, (i * size + 1).cast("int"), F.lit(size)))


def collapse_space(text: Column) -> Column:
    """K21."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_job_prefix(name: Column, strict: bool = False) -> Column:
    """Without a leading job id. Ids with and without hyphens go; strict leaves those without."""
    hyphen = "-" if strict else "-?"
    return F.regexp_replace(name, f"^[0-9a-f]{{8}}{hyphen}[0-9a-f]{{4}}{hyphen}[0-9a-f]{{4}}{hyphen}[0-9a-f]{{4}}{hyphen}[0-9a-f]{{12}}_", "")


def basename(path: Column) -> Column:
    """K19."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased, empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"[^/.]\.([^./]+)\z", 1))


def strip_zip(name: Column) -> Column:
    """K18."""
    return F.regexp_replace(name, r"\.(zip|ZIP)$", "")


def repo_of_zip(name: Column) -> Column:
    """The archive's base name without its ending."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(name, r"\\", "/"), r"([^/]*)\z", 1), r"(?i)\.zip$", "")


def join_parameters(parameters: Column, form: str = "type name") -> Column:
    """`type name`, `type`, or `name: type`, joined by commas."""
    one = {"type name": lambda p: F.trim(F.concat_ws(" ", p["type"], p["name"])), "type": lambda p: p["type"], "name: type": lambda p: F.concat(p["name"], F.lit(": "), p["type"])}[form]
    return F.array_join(F.transform(parameters, one), ", ")


def size_label(size: Column) -> Column:
    """Bytes for people."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.format_string("%.1f", F.round(size / 1024.0, 1)), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", F.round(size / 1048576.0, 1)), F.lit(" MB")))
    )


def content_hash(text: Column) -> Column:
    """First 8 bytes of SHA-256, in hexadecimal."""
    return F.substring(F.sha2(text, 256), 1, 16)


def iso_seconds(time: Column) -> Column:
    """P1 (UTC session)."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_micros(time: Column) -> Column:
    """P2."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
