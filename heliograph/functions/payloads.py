"""JSON that models write: found in prose, repaired where it was cut off, and put in list shape."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DECODER = json.JSONDecoder()


def first_object(text: str | None) -> dict | None:
    """The first JSON object that can be read from any brace on."""
    at = (text or "").find("{")
    while at >= 0:
        try:
            value, _ = _DECODER.raw_decode(text, at)
            if isinstance(value, dict):
                return value
        except json.JSONDecodeError:
            pass
        at = text.find("{", at + 1)
    return None


def closed(text: str | None, field: str = "ocr_text", most: int = 10) -> dict | None:
    """The first object; else that of the text with its last array cut after the whole strings that it has."""
    found = first_object(text)
    if found is not None or not text:
        return found
    mark = text.find(f'"{field}"')
    start = text.find("[", mark) if mark >= 0 else -1
    if start < 0:
        return None
    items: dict[str, None] = {}
    at = start + 1
    while len(items) < most:
        rest = text[at:].lstrip(" \t\r\n,")
        at = len(text) - len(rest)
        if not rest.startswith('"'):
            break
        try:
            value, at = _DECODER.raw_decode(text, at)
        except json.JSONDecodeError:
            break
        items[value] = None
    return first_object(text[:start] + json.dumps(list(items), ensure_ascii=False) + "}")


def string_list(value) -> list[str]:
    """A field that should be a list of strings: a scalar is one of its own, nothing and blanks are none."""
    if value is None or value == "":
        return []
    return [x for x in (str(v).strip() for v in (value if isinstance(value, list) else [value])) if x]


def _udf(parse):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        found = texts.map(parse)
        return found.map(lambda v: None if v is None else json.dumps(v, ensure_ascii=False))

    return run


def extract_object(text: Column) -> Column:
    """JSON text of the first object, null without one."""
    return _udf(first_object)(text)


def repair_object(text: Column) -> Column:
    return _udf(closed)(text)


def as_list(payload: Column, name: str, most: int = 10) -> Column:
    """A field of a JSON text as strings: null -> [], an object -> k:v, a scalar -> [x]; distinct, at most ``most``."""
    raw = F.coalesce(F.get_json_object(payload, f"$.{name}"), F.get_json_object(payload, f"$._{name}"))
    empty = F.array().cast("array<string>")
    pairs = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    listed = F.array_distinct(F.from_json(raw, "array<string>"))
    shaped = F.when(raw.isNull() | (raw == ""), empty).when(raw.startswith("{"), F.coalesce(pairs, empty)).when(raw.startswith("["), F.coalesce(listed, empty)).otherwise(F.array(raw))
    return F.slice(shaped, 1, most)


def strict(text: Column) -> Column:
    """Whether the text is JSON by the strict grammar: NaN and Infinity aren't."""
    return F.try_parse_json(text).isNotNull()
