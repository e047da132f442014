"""URLs: parsing, canonical form, scope, prefixes.

Canonical form needs percent-encoding and per-scheme rules, so it runs in
Python, in Arrow batches; tests on canonical URLs are column expressions.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType

from .js import col

PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
_SAFE = "!$&'()*+,-./:;=@_~%[]|^"


def normalized(url: str, base: str | None = None) -> str | None:
    """An absolute URL: host in lower case, default port dropped, unsafe characters encoded; None if it is not one."""
    try:
        u = urlsplit(urljoin(base, url.strip()) if base else url.strip())
        if not u.scheme or (u.scheme in PORTS and not u.hostname):
            return None
        if u.scheme not in PORTS:
            return u.geturl()
        port = f":{u.port}" if u.port and u.port != PORTS[u.scheme] else ""
        user = f"{u.username}{':' + u.password if u.password else ''}@" if u.username else ""
        host = u.hostname.encode("idna").decode() if not u.hostname.isascii() else u.hostname
        return urlunsplit((u.scheme, f"{user}{host}{port}", quote(_dots(u.path) or "/", safe=_SAFE), quote(u.query, safe=_SAFE + "?/ ").replace(" ", "%20"), u.fragment))
    except (ValueError, UnicodeError):
        return None


def _dots(path: str) -> str:
    if "/." not in path:
        return path
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        if p == "..":
            if len(out) > 1:
                out.pop()
        elif p != ".":
            out.append(p)
            continue
        if i == len(parts) - 1:
            out.append("")
    return "/".join(out)


def canonical(url: str | None, base: str | None = None) -> str | None:
    """Without fragment and trailing slashes, with sorted query parameters. What is no URL stays as it is."""
    if url is None:
        return None
    full = normalized(url, base)
    if full is None:
        return url
    u = urlsplit(full)
    if u.scheme not in PORTS:
        return full
    path = u.path.rstrip("/") or "/"
    pairs = sorted(parse_qsl(u.query, keep_blank_values=True), key=lambda p: (p[0].casefold(), p[0].swapcase()))
    return urlunsplit((u.scheme, u.netloc, path, urlencode(pairs), ""))


@pandas_udf(StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    return url.map(canonical, na_action="ignore")


@pandas_udf(StringType())
def resolve_url(href: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute form of a link on a page; null if it has none."""
    return pd.Series([None if h is None or b is None else normalized(h, b) for h, b in zip(href, base, strict=True)], dtype=object)


def origin(url: str | Column) -> Column:
    """scheme://host[:port] of a normalised URL."""
    return F.lower(F.regexp_extract(col(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1))


def path(url: str | Column) -> Column:
    p = F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def search(url: str | Column) -> Column:
    return F.regexp_extract(col(url), r"^[^?#]*(\?[^#]*)?", 1)


def in_scope(root: str | Column, candidate: str | Column, scope: str) -> Column:
    """same-origin, same-site (the last two labels of the host) or any."""
    if scope == "any":
        return F.lit(True)
    if scope == "same-origin":
        return (origin(root) == origin(candidate)) & (origin(candidate) != "")

    def site(u: str | Column) -> Column:
        host = F.regexp_extract(origin(u), r"://(?:[^@]*@)?([^:]*)", 1)
        return F.substring_index(host, ".", -2)

    return (site(root) == site(candidate)) & (origin(candidate) != "")


def prefixes(url: str | Column) -> Column:
    """All URLs of the same origin and query whose path is a strict prefix at a slash, as canonical URLs, longest first."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    n = F.size(parts)
    steps = F.when(n > 0, F.reverse(F.sequence(F.lit(0), n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.concat(origin(url), F.lit("/"), F.array_join(F.slice(parts, 1, k), "/"), search(url)))


def href_kind(raw: str | Column, resolved: str | Column, page_url: str | Column) -> Column:
    """anchor, javascript, same-origin or external."""
    raw = col(raw)
    return (
        F.when(F.startswith(raw, F.lit("#")), "anchor").when(F.startswith(F.lower(raw), F.lit("javascript:")), "javascript")
        .when(origin(resolved) == origin(page_url), "same-origin").otherwise("external")
    )


def slug(name: str | Column, size: int = 32) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, size)


def fnv1a(s: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    raw, h = s.encode("utf-16-le", "surrogatepass"), 0x811C9DC5
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return h


@pandas_udf(LongType())
def fnv1a_32(s: pd.Series) -> pd.Series:
    return s.map(fnv1a, na_action="ignore").astype("Int64")


SPACE = re.compile(r"\s+")
