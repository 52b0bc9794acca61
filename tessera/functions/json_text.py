"""JSON that models and tools wrote: strict checks, and the first object of a longer text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


class _Refused(ValueError):
    pass


def _once(pairs: list) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise _Refused("duplicate_key")
    return dict(pairs)


def _finite(name: str):
    raise _Refused("not_finite")


def _fault(text: str | None) -> str | None:
    if text is None or not text.strip():
        return "empty"
    try:
        json.loads(text, object_pairs_hook=_once, parse_constant=_finite)
    except _Refused as e:
        return str(e)
    except (ValueError, RecursionError):
        return "not_json"
    return None


def _prefix(text: str | None) -> str | None:
    place = (text or "").find("{")
    if place < 0 or text[:place].strip():
        return None
    try:
        value, _ = json.JSONDecoder(strict=False).raw_decode(text, place)
    except (ValueError, RecursionError):
        return None
    if set(value) == {"type", "content"} and value["type"] == "json_object":
        inner = value["content"]
        if isinstance(inner, str):
            try:
                inner = json.loads(inner)
            except ValueError:
                inner = None
        value = inner if isinstance(inner, dict) else value
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def json_fault(text: Column) -> Column:
    """Why a text isn't strict JSON (``empty``, ``not_json``, ``duplicate_key`` or ``not_finite``); null for one that is."""

    @arrow_udf("string")
    def fault(texts: pa.Array) -> pa.Array:
        return pa.array(map(_fault, texts.to_pylist()), pa.string())

    return fault(text)


def json_prefix(text: Column) -> Column:
    """The object that a text begins with, in canonical form; what follows it doesn't count, and line breaks in its strings may be bare.

    An envelope of only ``type`` ``json_object`` and ``content`` gives its content.  Null where the text begins with no object.
    """

    @arrow_udf("string")
    def prefix(texts: pa.Array) -> pa.Array:
        return pa.array(map(_prefix, texts.to_pylist()), pa.string())

    return prefix(text)
