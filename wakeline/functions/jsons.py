"""JSON arguments of tool calls."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType


def pointer(arguments, path: str) -> Column:
    """Value at an RFC 6901 pointer as text; null if absent."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in path.split("/")[1:]]
    return F.get_json_object(arguments, "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps))


def first_of(arguments, keys: list[str]) -> Column:
    """The first of some top-level keys that is present."""
    return F.coalesce(*[F.get_json_object(arguments, f"$['{k}']") for k in keys])


def string_values(arguments) -> Column:
    """Top-level (key, value) pairs of an object, as structs."""
    return F.map_entries(F.from_json(arguments, "map<string,string>"))


def _number(value: Decimal) -> str:
    sign, digits, exponent = value.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    if not text:
        return "0"
    stripped = text.rstrip("0")
    exponent += len(text) - len(stripped)
    point = len(stripped) + exponent
    if 0 < point <= 21:
        body = stripped + "0" * (point - len(stripped)) if point >= len(stripped) else f"{stripped[:point]}.{stripped[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + stripped
    else:
        body = stripped[0] + ("." + stripped[1:] if len(stripped) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + body


def _write(value) -> str:
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_write(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_write, value)) + "]"
    if isinstance(value, Decimal):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def canonical_text(text: str | None) -> str | None:
    """Keys sorted by UTF-16 units, no spaces, numbers exact and in shortest form."""
    try:
        return _write(json.loads(text, parse_int=Decimal, parse_float=Decimal))
    except (ValueError, TypeError):
        return None


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text)


STRING = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?', re.S)


RANGES = ArrayType(StructType([StructField("key", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(RANGES)
def string_ranges(arguments: pd.Series) -> pd.Series:
    """Where the string values of JSON text lie: byte ranges between their quotes, escapes
    included, in order, with the nearest key before each (null for a bare string). Keys,
    empty strings and other values are left out; null if the text is not JSON."""

    def one(text):
        try:
            json.loads(text)
        except (ValueError, TypeError):
            return None
        key, found, at, seen = None, [], 0, 0
        for m in STRING.finditer(text):
            if m[2]:
                key = json.loads(f'"{m[1]}"')
            elif m[1]:
                start = seen + len(text[at : m.start(1)].encode())
                at, seen = m.end(1), start + len(m[1].encode())
                found.append({"key": key, "start": start, "end": seen})
        return found

    return arguments.map(one)
