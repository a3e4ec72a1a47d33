"""Keyset pages, capped lists, samples and total orders."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.sources.storage import small

MOST = 500


def page(rows: DataFrame, keys: list[str], size: int, after: tuple | None = None, newest_first: bool = True) -> DataFrame:
    """The next `size` rows strictly after a key, in unique key order.

    The bound is spelled out column by column, so that the first comparison can reach the
    scan; the order and limit become one top-k.
    """
    if not 1 <= size <= MOST:
        raise ValueError(f"page size must be 1 to {MOST}")
    if after is not None:
        bound = None
        for k, v in reversed(list(zip(keys, after, strict=True))):
            c = F.col(k)
            beyond = c < F.lit(v) if newest_first else c > F.lit(v)
            bound = beyond if bound is None else beyond | ((c == F.lit(v)) & bound)
        first = F.col(keys[0]) <= F.lit(after[0]) if newest_first else F.col(keys[0]) >= F.lit(after[0])
        rows = rows.where(first & bound)
    order = [F.col(k).desc() if newest_first else F.col(k).asc() for k in keys]
    return rows.orderBy(*order).limit(size)


def cursor(key: tuple, request: dict, secret: bytes) -> str:
    """Opaque place of a page, bound to the request that it continues."""
    digest = hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()
    body = json.dumps([list(key), digest], default=str).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + body).decode()


def from_cursor(text: str, request: dict, secret: bytes) -> tuple:
    """Key under a cursor; refused if forged or made for another request."""
    raw = base64.urlsafe_b64decode(text.encode())
    seal, body = raw[:32], raw[32:]
    if not hmac.compare_digest(seal, hmac.new(secret, body, hashlib.sha256).digest()):
        raise ValueError("the cursor is not ours")
    key, digest = json.loads(body)
    if digest != hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest():
        raise ValueError("the cursor belongs to another request")
    return tuple(key)


def top(rows: DataFrame, score: str, key: str, k: int, after: tuple | None = None) -> DataFrame:
    """Best k by score, then by id, both descending; filters go before, so no refill is needed."""
    if after is not None:
        s, i = after
        rows = rows.where((F.col(score) < s) | ((F.col(score) == s) & (F.col(key) < i)))
    return rows.orderBy(F.desc(score), F.desc(key)).limit(k)


def capped(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each group, with the group's exact total."""
    by = Window.partitionBy(*keys)
    return (
        rows.withColumn("_at", F.row_number().over(by.orderBy(*order)))
        .withColumn("total", F.count("*").over(by))
        .where(F.col("_at") <= most)
        .drop("_at")
    )


def seeded_sample(rows: DataFrame, key: str, seed: str, most: int) -> DataFrame:
    """The rows with the least keyed hash, and how many rows there were in all."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))))
    total = rows.agg(F.count("*").alias("matching"))
    return hashed.orderBy("_h", key).limit(most).drop("_h").crossJoin(F.broadcast(total))


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a batch of ids, unknown ones absent."""
    return rows.join(small(ids.select(key).distinct()), key, "left_semi")


def rules_order() -> list:
    """Built-in rules first, then user rules, newest first."""
    return [F.col("builtin").desc(), F.col("rule").desc()]
