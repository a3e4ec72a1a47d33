"""Time buckets, grids, deadlines and watermarks. Times are microseconds since the epoch
or timestamps; windows are half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_POINTS = 10_000


def micros(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def align_down(us, width: int) -> Column:
    """Start of the epoch-aligned bucket."""
    c = F.col(us) if isinstance(us, str) else us
    return c - F.pmod(c, F.lit(width))


def bucket(ts, width: int) -> Column:
    return F.timestamp_micros(align_down(micros(ts), width))


def in_window(ts, start, end) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return (c >= start) & (c < end)


def check_grid(start: int, end: int, step: int, width: int) -> int:
    """Points of a series over [start, end); the window and step must fit the buckets."""
    if start >= end:
        raise ValueError("empty window")
    if start % width or end % width or step % width:
        raise ValueError("window or step is not aligned to the bucket")
    if (end - start) % step:
        raise ValueError("partial step")
    points = (end - start) // step
    if points > MAX_POINTS:
        raise ValueError("too many points")
    return points


def deadline(us, *waits: int) -> Column:
    """Time plus waits, at most the largest long."""
    c = F.col(us) if isinstance(us, str) else us
    return F.coalesce(F.try_add(c, F.lit(sum(waits)).cast("bigint")), F.lit((1 << 63) - 1))


def watermark(ticked_through, oldest_pending, settle: int, width: int) -> Column:
    """Aligned time below which buckets are final."""
    return align_down(F.least(ticked_through - settle, oldest_pending), width)


def rfc3339(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
