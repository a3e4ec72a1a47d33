"""Text functions over columns from built-in expressions, and gram hashes over numpy arrays."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of the start of a body shown in lists.
SNIPPET = 160


def normalize(text) -> Column:
    """Fold white-space runs to one space and lower-case; nothing is trimmed."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", " ")


def trimmed_length(text) -> Column:
    return F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def shingles(text, width: int) -> Column:
    """Every substring of `width` characters as structs (pos, gram), positions from 0.

    Finding a place in UTF-8 text means walking to it, so texts are cut into pieces and
    those into small ones first; a walk for a gram then is at most a small piece long.
    """
    c = F.col(text) if isinstance(text, str) else text

    def cut(pieces: Column, step: int, size: int) -> Column:
        """Pieces (pos, s) cut into overlapping ones of `size` characters, every `step`."""
        return F.flatten(
            F.transform(
                pieces,
                lambda p: F.transform(
                    F.sequence(F.lit(0), F.length(p["s"]) - width, F.lit(step)),
                    lambda i: F.struct((p["pos"] + i).alias("pos"), F.substring(p["s"], i + 1, F.lit(size)).alias("s")),
                ),
            )
        )

    whole = F.when(F.length(c) >= width, F.array(F.struct(F.lit(0).alias("pos"), c.alias("s"))))
    small = cut(cut(whole, 4096, 4095 + width), 64, 63 + width)
    grams = F.transform(cut(small, 1, width), lambda p: F.struct(p["pos"].alias("pos"), p["s"].alias("gram")))
    return F.coalesce(grams, F.array().cast("array<struct<pos:int,gram:string>>"))


def portable_hash(text) -> Column:
    """A 60-bit hash that any engine with MD5 can repeat."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def rolling_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 60-bit hash of every `width` consecutive code points: a polynomial modulo 2^64,
    put together from stretches whose lengths are powers of two, and mixed."""
    if len(codes) < width:
        return np.zeros(0, dtype=np.int64)
    base, part, size = np.uint64(0x9FB21C651E98DF25), codes.astype(np.uint64) + np.uint64(1), 1
    out, done = np.zeros(len(codes) - width + 1, dtype=np.uint64), 0
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                out = out * base + part[done : done + len(out)]
                done += size
            if done == width:
                break
            part, base, size = part[:-size] * base + part[size:], base * base, 2 * size
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return (out >> np.uint64(4)).astype(np.int64)


#: The sines and turns of MD5, and grams digested at once: a few arrays of them stay in a core's cache.
SINES = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
TURNS = ([7, 12, 17, 22] * 4, [5, 9, 14, 20] * 4, [4, 11, 16, 23] * 4, [6, 10, 15, 21] * 4)
PLACES = ([i for i in range(16)], [(5 * i + 1) % 16 for i in range(16)], [(3 * i + 5) % 16 for i in range(16)], [7 * i % 16 for i in range(16)])
CHUNK = 1 << 13
#: Bytes of a message that fit in one block of MD5.
ONE_BLOCK = 55


def _md5_start(words: list[np.ndarray | np.uint32]) -> np.ndarray:
    """First 60 bits of the MD5 of messages of one block, each of whose 16 words is an array over them all, or one for all."""
    size = len(words[0])
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(size, x, np.uint32) for x in first)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(64):
            turn, at = TURNS[i // 16][i % 16], PLACES[i // 16][i % 16]
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                np.bitwise_not(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            f += a
            word = words[at]
            if isinstance(word, np.ndarray):
                f += word
                f += SINES[i]
            else:
                f += SINES[i] + word
            np.right_shift(f, 32 - turn, out=t)
            np.left_shift(f, turn, out=f)
            f |= t
            f += b
            a, b, c, d, f = d, f, b, c, a
        high, low = (a + first[0]).byteswap().astype(np.uint64), (b + first[1]).byteswap().astype(np.uint64)
    return ((high << np.uint64(32) | low) >> np.uint64(4)).astype(np.int64)


def portable_hashes(text: str, places, width: int) -> np.ndarray:
    """`portable_hash` of the grams that start at the places.

    Grams of up to 55 bytes, a block of MD5, are digested many at a time; the others one by one.
    """
    places = np.asarray(places, dtype=np.int64)
    out = np.empty(len(places), dtype=np.int64)
    if not len(places):
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    # Where each character starts, by bytes.
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    begin = starts[places]
    size = starts[np.minimum(places + width, len(starts) - 1)] - begin
    padded = np.append(raw, np.zeros(64, np.uint8)).astype(np.uint32)
    four = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    zero = np.uint32(0)
    # By bytes that a word still has: what of it counts, and the mark after the message.
    kept = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)
    mark = np.array([0x80, 0x8000, 0x800000, 0x80000000, 0], dtype=np.uint32)
    short = np.flatnonzero(size <= ONE_BLOCK)
    for one in np.array_split(short, -(-len(short) // CHUNK)) if len(short) else []:
        at, n = begin[one], size[one]
        words: list[np.ndarray | np.uint32] = []
        least, most = int(n.min()), int(n.max())
        together = at[-1] - at[0] == len(at) - 1
        for j in range(14):
            if 4 * j + 4 <= least:
                words.append(four[at[0] + 4 * j : at[-1] + 4 * j + 1] if together else four[at + 4 * j])
            elif 4 * j > most:
                words.append(zero)
            else:
                left = n - 4 * j
                rest = np.clip(left, 0, 4)
                words.append(four[np.minimum(at + 4 * j, len(four) - 1)] & kept[rest] | np.where(left < 0, zero, mark[rest]))
        words += [(n * 8).astype(np.uint32), zero]
        if not isinstance(words[0], np.ndarray):
            words[0] = np.full(len(one), words[0], np.uint32)
        out[one] = _md5_start(words)
    for i in np.flatnonzero(size > ONE_BLOCK):
        digest = hashlib.md5(raw[begin[i] : begin[i] + size[i]].tobytes()).digest()
        out[i] = int.from_bytes(digest[:8], "big") >> 4
    return out


def winnow_places(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost least hash of every window, each once; fewer hashes than a
    window are one window."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    places = np.arange(len(views)) + window - 1 - views.argmin(axis=1)
    return places[np.concatenate(([True], places[1:] != places[:-1]))]


def tokens(text) -> Column:
    """Alphanumeric runs of at least four characters, or holding a digit."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(runs, lambda t: (F.length(t) >= 4) | t.rlike(r"\p{N}"))


def token_runs(text, least: int = 24, most: int = 46) -> Column:
    """Runs of whole words whose length is between the bounds: matched exactly when short.

    A run of `most` characters has one word for every two of them at most.
    """
    word = r"[\p{L}\p{N}_.-]+"
    words = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    joined = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda i: F.transform(
            F.sequence(F.lit(1), F.lit((most + 1) // 2)), lambda n: F.array_join(F.slice(words, i + 1, n), " ")
        ),
    )
    return F.array_distinct(F.filter(F.flatten(joined), lambda t: F.length(t).between(least, most)))


def lexemes(text) -> Column:
    """Distinct lower-case words of a whole body; no stemming."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def snippet(text) -> Column:
    return F.left(text, F.lit(SNIPPET))


def text_score(query: list[str], terms) -> Column:
    """Share of the query's distinct terms that the document holds."""
    wanted = sorted(set(query))
    held = F.size(F.array_intersect(terms, F.array(*[F.lit(t) for t in wanted])))
    return held / F.lit(float(len(wanted)))


def id_prefix(column, prefix: str) -> Column:
    """Prefix match of an identifier ignoring ASCII case."""
    return F.upper(column).startswith(prefix.upper())


def wiki_title(title) -> Column:
    """Spaces for underscores, folded and trimmed, the first letter upper-case."""
    clean = F.trim(F.regexp_replace(title, r"[\s_]+", " "))
    return F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30))


def folded_key(key) -> Column:
    return F.lower(F.trim(key))


def excerpt(text, start, end, around: int) -> Column:
    """Struct of the text around a UTF-8 byte range and the bytes left out on both sides.

    Cuts move outwards from the range to the nearest character boundary.
    """
    raw = F.encode(text, "utf-8")
    size = F.octet_length(text)
    low = F.greatest(F.lit(0), start - around)
    high = F.least(size, end + around)
    # Continuation bytes are 10xxxxxx: step back at the front and forward at the end over at most three.
    is_tail = lambda at: F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int").between(128, 191)
    back = F.aggregate(F.sequence(F.lit(1), F.lit(3)), low, lambda a, _: F.when((a > 0) & is_tail(a), a - 1).otherwise(a))
    on = F.aggregate(F.sequence(F.lit(1), F.lit(3)), high, lambda a, _: F.when((a < size) & is_tail(a), a + 1).otherwise(a))
    return F.struct(
        F.decode(F.substring(raw, back + 1, on - back), "utf-8").alias("text"),
        back.alias("elided_before"),
        (size - on).alias("elided_after"),
    )
