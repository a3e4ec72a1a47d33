"""Decoding of texts hidden in other texts, a layer at a time."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEPTH = 3
LAYERS = 32
RUN = 16

# Letters of other scripts that look like Latin ones, and zero-width characters.
CONFUSABLE = "аеорсхуіјѕԁԛԝһӏɡАВЕКМНОРСТХУІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN = "aeopcxyijsdqwhlgABEKMHOPCTXYIJSaopvikABEZHIKMNOPTYX"
ZERO_WIDTH = "[\\u00AD\\u034F\\u061C\\u115F\\u1160\\u17B4\\u17B5\\u180E\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\u2066-\\u206F\\uFEFF]"


def _text(raw: Column) -> Column:
    """Text of bytes, or null where they are not strict UTF-8."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def _each(text, pattern: str, decoded) -> Column:
    """Decoded forms of every match of a pattern, those that fail left out."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.filter(F.transform(found, decoded), lambda x: x.isNotNull() & (x != ""))


def base64_layers(text, least: int = RUN) -> Column:
    """Texts under maximal base64 runs, standard or URL-safe."""

    def decoded(x: Column) -> Column:
        plain = F.rtrim(F.translate(x, "-_", "+/"), F.lit("="))
        left = F.length(plain) % 4
        whole = F.when(left == 1, F.lit(None)).otherwise(F.concat(plain, F.repeat(F.lit("="), (4 - left) % 4)))
        return _text(F.try_to_binary(whole, F.lit("base64")))

    return _each(text, f"[A-Za-z0-9+/_-]{{{least},}}={{0,2}}", decoded)


def hex_layers(text, least: int = RUN) -> Column:
    def decoded(x: Column) -> Column:
        return _text(F.when(F.length(x) % 2 == 0, F.unhex(x)))

    return _each(text, f"[0-9A-Fa-f]{{{least},}}", decoded)


def url_layers(text) -> Column:
    """Texts under white-space separated tokens that hold a percent escape."""
    return _each(text, r"\S*%[0-9A-Fa-f]{2}\S*", F.try_url_decode)


def json_layers(text, least: int = RUN) -> Column:
    """Texts under JSON string literals that hold an escape."""

    def decoded(x: Column) -> Column:
        value = F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v")
        return F.when(x.contains("\\") & (F.length(value) >= least), value)

    # Possessive, so that Java's matcher loops over a long literal and does not recurse.
    return _each(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', decoded)


def fold_unicode(text) -> Column:
    """Zero-width characters removed and look-alike letters made Latin."""
    return F.translate(F.regexp_replace(text, ZERO_WIDTH, ""), CONFUSABLE, LATIN)


@F.pandas_udf(StringType())
def compatibility(texts: pd.Series) -> pd.Series:
    """Unicode NFKC, which has no built-in function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


# One-letter escapes of a YAML double-quoted scalar.
YAML = {
    "0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b",
    " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": " ", "P": " ",
}


def _yaml_scalar(text: str) -> str | None:
    out, at = [], 0
    widths = {"x": 2, "u": 4, "U": 8}
    while at < len(text):
        if text[at] != "\\":
            # What lies between two escapes is one piece, as a list of characters is many times a text's size.
            stop = text.find("\\", at)
            stop = len(text) if stop < 0 else stop
            out.append(text[at:stop])
            at = stop
            continue
        code = text[at + 1 : at + 2]
        if code in YAML:
            out.append(YAML[code])
            at += 2
        elif code in widths:
            digits = text[at + 2 : at + 2 + widths[code]]
            try:
                out.append(chr(int(digits, 16)))
            except (ValueError, OverflowError):
                return None
            at += 2 + widths[code]
        else:
            return None
    return "".join(out)


@F.pandas_udf(StringType())
def _yaml_unescaped(scalars: pd.Series) -> pd.Series:
    return scalars.map(lambda t: None if t is None else _yaml_scalar(t))


def yaml_unescape(scalars) -> Column:
    """Content of YAML double-quoted scalars, quotes left off; null if malformed.

    Long texts: Arrow batches are kept small, so that a Python worker holds few at once.
    """
    conf = SparkSession.active().conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return _yaml_unescaped(scalars)


STRING_CODECS = ("json",)


def _steps(name: str, codec) -> Column:
    """Layers that a codec finds in `text`, with the chain that led there; a string codec
    is not used twice in a chain."""
    found = codec("text")
    if name in STRING_CODECS:
        used = F.arrays_overlap("chain", F.array(*map(F.lit, STRING_CODECS)))
        found = F.when(~used, found).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda t: F.struct(F.array_append("chain", F.lit(name)).alias("chain"), t.alias("text")))


def layers(rows: DataFrame, key: str, text: str, depth: int = DEPTH, most: int = LAYERS) -> DataFrame:
    """Breadth-first decoded layers: (key, layer, chain, text), layer 0 being the text itself.

    A chain holds at most one string codec. A text seen in an earlier layer of its row is
    not taken again. Layers are numbered by depth, then by chain and text, and cut at `most`.
    """
    codecs = {"base64": base64_layers, "hex": hex_layers, "url": url_layers, "json": json_layers}
    level = rows.select(key, F.array().cast("array<string>").alias("chain"), F.col(text).alias("text"))
    found = level
    for _ in range(depth):
        steps = F.concat(*[_steps(name, fn) for name, fn in codecs.items()])
        level = level.select(key, F.explode(steps).alias("s")).select(key, "s.chain", "s.text")
        found = found.unionByName(level)
    one = found.groupBy(key, "text").agg(F.min(F.struct(F.size("chain"), "chain")).alias("m")).select(key, "text", F.col("m.chain").alias("chain"))
    grouped = one.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.size("chain").alias("n"), "chain", "text"))), 1, most).alias("all"))
    return grouped.select(key, F.posexplode("all").alias("layer", "x")).select(key, "layer", "x.chain", "x.text")
