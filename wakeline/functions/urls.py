"""Locators: canonical URLs, paths, repositories, and patterns over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url, group: int) -> Column:
    return F.regexp_extract(url, URL, group)


def scheme(url) -> Column:
    return F.lower(_part(url, 1))


def host(url) -> Column:
    """Lower-case host without user information and default port."""
    bare = F.regexp_replace(F.lower(_part(url, 2)), "^[^@]*@", "")
    port = F.when(scheme(url) == "http", ":80").when(scheme(url) == "https", ":443").otherwise("")
    cut = F.when((port != "") & F.endswith(bare, port), F.substring(bare, F.lit(1), F.length(bare) - F.length(port)))
    return F.regexp_replace(F.coalesce(cut, bare), r":$", "")


def path(url) -> Column:
    """Path with escapes in upper case; empty becomes a slash."""
    raw = _part(url, 3)
    return F.when(raw == "", "/").otherwise(upper_escapes(raw))


def upper_escapes(text) -> Column:
    """%xx to %XX: split before every escape and upper-case two characters after each."""
    c = F.col(text) if isinstance(text, str) else text
    pieces = F.split(c, "%")
    fixed = F.transform(
        pieces,
        lambda p, i: F.when(
            (i > 0) & p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 1 << 30))
        ).otherwise(p),
    )
    return F.array_join(fixed, "%")


def query(url) -> Column:
    """Parameters in sorted order; null if there are none."""
    raw = _part(url, 4)
    return F.when(raw != "", F.array_join(F.array_sort(F.split(raw, "&")), "&"))


def canonical(url) -> Column:
    """Canonical URL text; null if there is no scheme or no host."""
    q = query(url)
    text = F.concat(scheme(url), F.lit("://"), host(url), path(url), F.when(q.isNotNull(), F.concat(F.lit("?"), q)).otherwise(""))
    return F.when((scheme(url) != "") & (host(url) != ""), text)


# File endings that make a dotted word a file name rather than a host.
FILE_ENDINGS = "md txt py rs js ts json yaml yml toml html css csv sh go java c h cpp log lock pdf png jpg"


def with_scheme(text) -> Column:
    """https:// before a bare host; file names and everything else unchanged."""
    c = F.col(text) if isinstance(text, str) else text
    ends = "|".join(FILE_ENDINGS.split())
    is_host = c.rlike(r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+(:[0-9]+)?(/.*)?$") & ~c.rlike(rf"^[^/]*\.({ends})$")
    return F.when(is_host, F.concat(F.lit("https://"), c)).otherwise(c)


def locator(text) -> Column:
    """Canonical key of a resource: its URL, else an opaque key of the folded text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(canonical(with_scheme(c)), F.concat(F.lit("opaque:"), F.lower(F.trim(c))))


def lexical_path(text) -> Column:
    """Path without `.`, with `..` resolved by name alone and doubled slashes folded."""
    c = F.col(text) if isinstance(text, str) else text
    rooted = c.startswith("/")
    kept = F.aggregate(
        F.filter(F.split(c, "/"), lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda a, s: F.when(s != "..", F.array_append(a, s))
        .when((F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1))
        .when(rooted, a)
        .otherwise(F.array_append(a, s)),
    )
    joined = F.array_join(kept, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def joined_path(base, text) -> Column:
    """`text` seen from the folder `base`."""
    c = F.col(text) if isinstance(text, str) else text
    return lexical_path(F.when(c.startswith("/"), c).otherwise(F.concat(base, F.lit("/"), c)))


def repository(text) -> Column:
    """host/owner/name of a repository address, in any of its usual spellings."""
    plain = F.regexp_replace(text, r"^git@([^:]+):", "ssh://$1/")
    m = r"^(?:https?|ssh|git)://(?:[^@/]*@)?([^/:]+)(?::[0-9]+)?/([^/]+)/([^/?#]+?)(?:\.git)?/?(?:[?#].*)?$"
    part = lambda g: F.lower(F.regexp_extract(plain, m, g))
    return F.when(part(1) != "", F.concat_ws("/", part(1), part(2), part(3)))


def prefix_of_segments(value, prefix) -> Column:
    """Prefix match on whole path segments."""
    v = F.col(value) if isinstance(value, str) else value
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (v == p) | (v.startswith(p) & (p.endswith("/") | (F.substring(v, F.length(p) + 1, F.lit(1)) == "/")))


def segment_prefixes(value) -> Column:
    """Every string that `prefix_of_segments` takes for a prefix of the value."""
    parts = F.split(value, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ends = F.transform(F.slice(heads, F.lit(1), F.size(heads) - 1), lambda h: F.concat(h, F.lit("/")))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(heads, ends)))


def matches(kind: str, pattern, url) -> Column:
    """Whether a resource pattern (exact, host, url_prefix, path_prefix) holds a URL."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return {
        "exact": lambda: canonical(url) == p,
        "host": lambda: host(url) == p,
        "url_prefix": lambda: prefix_of_segments(canonical(url), p),
        "path_prefix": lambda: prefix_of_segments(path(url), p),
    }[kind]()


def overlap(kind_a, a, kind_b, b) -> Column:
    """Whether two patterns can hold the same resource: equal, or one a segment prefix of the other."""
    same = kind_a == kind_b
    prefix = kind_a.endswith("prefix") & (prefix_of_segments(a, b) | prefix_of_segments(b, a))
    return same & ((a == b) | prefix)
