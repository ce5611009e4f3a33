"""Expressions over JSON text that a model returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from markspan.functions.codes import strip
from markspan.schema import FORMAT_RESPONSE, TEXT_MAP

# Code fences around a response.
FENCED = r"(?is)```(?:json)?\s*(.*?)\s*```"
FENCE_START, FENCE_END = r"```json?\s*", r"```\s*$"


def _one_object(c: Column) -> Column:
    """The text read as the only element of an array, so that anything after the object makes it unreadable."""
    return F.from_json(F.concat(F.lit("["), c, F.lit("]")), f"ARRAY<{TEXT_MAP}>", {"allowSingleQuotes": "false"})


def is_json_object(c: Column) -> Column:
    """Whether the text is one JSON object and nothing after it."""
    return F.coalesce(c.startswith("{") & (F.size(_one_object(c)) == 1), F.lit(False))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def object_text(response: Column) -> Column:
    """The first candidate text that is a JSON object: fenced block, whole text, outermost braces; else null."""

    def if_object(text: Column) -> Column:
        return _bound(text, lambda t: F.when(is_json_object(t), t))

    def pick(raw: Column) -> Column:
        start, tail = F.instr(raw, "{"), F.length(raw) - F.instr(F.reverse(raw), "}") + 1
        span = F.when((start > 0) & (tail > start) & (tail <= F.length(raw)), F.substring(raw, start, tail - start + 1))
        return F.coalesce(if_object(strip(F.regexp_extract(raw, FENCED, 1))), F.when(is_json_object(raw), raw), if_object(span))

    return _bound(strip(response), pick)


def text_map(obj: Column) -> Column:
    """An object's fields as text; of repeated names the last one counts."""

    def last_of_each(fields: Column) -> Column:
        names = F.array_distinct(F.map_keys(fields))
        last = F.transform(names, lambda n: F.element_at(F.filter(F.map_entries(fields), lambda e: e["key"] == n), -1)["value"])
        return F.when(F.size(names) == F.size(F.map_keys(fields)), fields).otherwise(F.map_from_arrays(names, last))

    return _bound(F.from_json(obj, TEXT_MAP), last_of_each)


def format_text(response: Column) -> Column:
    """A format response without its code fence."""
    raw = strip(response)
    bare = F.regexp_replace(F.regexp_replace(raw, FENCE_START, ""), FENCE_END, "")
    return strip(F.when(raw.startswith("```"), bare).otherwise(raw))


def format_struct(obj: Column) -> Column:
    return F.from_json(obj, FORMAT_RESPONSE)
