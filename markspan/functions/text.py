"""File-name, label, preview and document-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markspan.functions.codes import strip

# Patterns that find an answer or a written response in recognised text, in order of priority.
CHOICE_PATTERNS = (
    r"Q[uestion]*\s*(\d+)\s*[:\-\)\.]*\s*([A-E])",
    r"(\d+)\s*[:\-\)\.]\s*([A-E])",
    r"Question\s+(\d+)\s*[:\-]*\s*([A-E])",
)
RESPONSE_HEAD = r"(?:FREE\s+RESPONSE|ESSAY|SHORT\s+ANSWER)"
RESPONSE_PATTERN = rf"{RESPONSE_HEAD}\s+(?:QUESTION\s+)?(\d+)\s*[:\-]?\s*(.*?)(?={RESPONSE_HEAD}|\z)"

PREVIEW_CHARS, SHORT_PREVIEW_CHARS = 80, 50
TOKEN_CHARS = 80


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def safe_token(c: Column, max_chars: int = TOKEN_CHARS) -> Column:
    """A path-safe token: other characters become _, outer ._- are cut, empty becomes unknown."""
    token = F.btrim(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.left(F.when(token == "", F.lit("unknown")).otherwise(token), F.lit(max_chars))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def safe_name(path: Column) -> Column:
    return F.replace(base_name(path), F.lit(" "), F.lit("_"))


def stored_name(path: Column, run_id: Column, suffix: str | None = None) -> Column:
    """`<run id>_<safe name>`, with the suffix swapped when one is given; the caller supplies the unique run id."""
    name = safe_name(path)
    if suffix:
        name = F.concat(stem(name), F.lit(f".{suffix}"))
    return F.concat_ws("_", run_id, name)


def label_from_key(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def preview(c: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(c) > chars, F.concat(F.left(c, F.lit(chars)), F.lit("..."))).otherwise(c)


def dated_path(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd")


def finite_number(c: Column) -> Column:
    """A number from loose text, null when it is not a finite one. The text is evaluated once, so nesting stays cheap."""
    number = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-2]?[0-9]{1,2})?)\s*$"
    return F.regexp_extract(c, number, 1).try_cast("double")


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def json_text(payload: Column, field: str) -> Column:
    return F.get_json_object(payload, f"$.{field}")


def first_text(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])
