"""Cleaning and reading of JSON that a model wrote."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import snake, trimmed

# What counts as a fence and as damage.
FENCED = r"```(?:json)?\s*\n([\s\S]*?)\n\s*```"
OPENING, CLOSING = r"^```(?:json)?\s*\n?", r"\s*```\s*$"


def cleaned(response: Column) -> Column:
    """The JSON inside a reply: unfenced, without trailing commas, None as null, cut to its outer brackets."""
    fenced = F.regexp_extract(response, FENCED, 1)
    inner = F.when(response.rlike(FENCED), trimmed(fenced)).otherwise(trimmed(F.regexp_replace(F.regexp_replace(response, OPENING, ""), CLOSING, "")))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r",\s*\]", "]"), r",\s*\}", "}"), r"\bNone\b", "null")
    whole = F.regexp_extract(text, r"(?s)^[^{\[]*([{\[].*)$", 1)
    last = lambda close: F.length(whole) - F.instr(F.reverse(whole), close) + 1
    cut = lambda close: F.when(F.contains(whole, F.lit(close)), F.substring(whole, F.lit(1), last(close))).otherwise(text)
    return F.when(text.rlike(r"^[{\[]") | (whole == ""), text).when(F.startswith(whole, F.lit("{")), cut("}")).otherwise(cut("]"))


def valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def snake_map(text: Column) -> Column:
    """The top-level fields of a JSON object with snake-cased names, values as JSON text; null for anything else."""
    fields = F.from_json(text, "map<string,string>")
    return F.when(valid(text) & F.startswith(trimmed(text), F.lit("{")), F.transform_keys(fields, lambda k, v: snake(k)))


def json_object(text: Column) -> Column:
    """First { to last } of a reply, or empty."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def snake_key(key: str) -> str:
    return re.sub(r"(?<=[^A-Z_])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", key).lower()


def snake_keys(value):
    if isinstance(value, dict):
        return {snake_key(k): snake_keys(v) for k, v in value.items()}
    return [snake_keys(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def snake_json(texts: pd.Series) -> pd.Series:
    """All keys of a JSON text snake-cased at any depth; what is no JSON stays as it is."""

    def one(text):
        try:
            return None if text is None else json.dumps(snake_keys(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text

    return texts.map(one)


def clean_text(response: str) -> str:
    """The same cleaning for one reply on a worker."""
    found = re.search(FENCED, response)
    text = found[1].strip() if found else re.sub(CLOSING, "", re.sub(OPENING, "", response)).strip()
    text = re.sub(r"\bNone\b", "null", re.sub(r",\s*}", "}", re.sub(r",\s*]", "]", text)))
    opening = re.search(r"[{\[]", text)
    if opening and text[0] not in "{[" and (end := text.rfind("}" if opening[0] == "{" else "]")) > opening.start():
        text = text[opening.start() : end + 1]
    return text


def parse(response: str | None, kind: type | None = None):
    """A cleaned reply as Python with snake-cased keys; None if it is broken or not of the kind (dict or list)."""
    try:
        value = snake_keys(json.loads(clean_text(response or "")))
    except ValueError:
        return None
    return value if kind is None or isinstance(value, kind) else None


def read_strict(response: str, many: bool = False):
    """A reply that must be JSON as it stands: an object, or for many a list or {"items": list}."""
    value = json.loads(response.strip())
    if many:
        value = value.get("items") if isinstance(value, dict) else value
    if not isinstance(value, list if many else dict):
        raise ValueError("wrong shape")
    return snake_keys(value)


def schema_hint(schema: T.StructType) -> str:
    """Field names, snake-cased, to kind and description (from the field's comment)."""
    kinds = ((T.StringType, "string"), (T.NumericType, "number"), (T.BooleanType, "boolean"), (T.ArrayType, "array"), ((T.MapType, T.StructType), "object"))
    kind = lambda t: next((name for k, name in kinds if isinstance(t, k)), "string")
    return json.dumps({snake_key(f.name): kind(f.dataType) + (f" - {f.metadata['comment']}" if f.metadata.get("comment") else "") for f in schema})
