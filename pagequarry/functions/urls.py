"""URL normalization, address policy and glob filters."""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Query keys that only track, besides those that begin with utm_.
TRACKING_KEYS = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "_ga", "_gl")
# The longest URL, and the ports of each scheme that need not be named.
MAX_URL_CHARS = 4096
DEFAULT_PORTS = {"http": 80, "https": 443}
# Endings of hosts that are not public.
LOCAL_SUFFIXES = (".localhost", ".local", ".internal", ".home", ".lan")
# Signs that no URL may hold.
_FORBIDDEN = re.compile("[\x00-\x20\x7f\\\\]")


def _tracks(key: str) -> bool:
    key = key.lower()
    return key.startswith("utm_") or key in TRACKING_KEYS


@lru_cache(1 << 14)
def normalize(url: str | None, base: str | None = None) -> str | None:
    """The canonical form of a public HTTP URL; None where it is none.

    Host in lower case and IDNA, no default port, no credentials, tracking keys
    and fragment dropped, query keys sorted (values of one key keep their order).
    """
    if not url or len(url) > MAX_URL_CHARS or _FORBIDDEN.search(url):
        return None
    try:
        split = urlsplit(urljoin(base, url) if base else url)
        scheme, port = split.scheme.lower(), split.port
        host = (split.hostname or "").rstrip(".").encode("idna").decode("ascii").lower()
        query = parse_qsl(split.query, keep_blank_values=True)
    except ValueError:  # UnicodeError included
        return None
    usable = scheme in DEFAULT_PORTS and host and "%" not in host and "@" not in split.netloc and port in (None, *DEFAULT_PORTS.values())
    if not usable:
        return None
    place = f"[{host}]" if ":" in host else host
    if port and port != DEFAULT_PORTS[scheme]:
        place += f":{port}"
    kept = urlencode(sorted((kv for kv in query if not _tracks(kv[0])), key=lambda kv: kv[0]))
    path = split.path or "/"
    if not path.startswith("/"):
        path = "/" + path
    return f"{scheme}://{place}{path}{'?' + kept if kept else ''}"


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url).hostname if url else None
    except ValueError:
        return None


def is_public_ip(address: str | None) -> bool:
    """Whether an address is globally routable, and no tunnel or translation of another."""
    try:
        ip = ipaddress.ip_address(address or "")
    except ValueError:
        return False
    if ip.version == 6:
        if ip.ipv4_mapped is not None:
            ip = ip.ipv4_mapped
        elif ip.sixtofour or ip.teredo or ip in ipaddress.ip_network("64:ff9b::/96"):
            return False
    return ip.is_global and not ip.is_multicast and not ip.is_reserved


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """``normalize`` of a column, in Arrow batches; null where invalid."""
    if base is None:
        return F.pandas_udf(lambda u: u.map(normalize, na_action="ignore"), StringType())(url)

    def joined(u: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([normalize(x, y or None) for x, y in zip(u, b)], dtype="object")

    return F.pandas_udf(joined, StringType())(url, base)


def host(url: Column) -> Column:
    """Host of a normalized URL."""
    return F.try_parse_url(url, F.lit("HOST"))


def all_public(ips: Column) -> Column:
    """Whether there are addresses and every one is public."""

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([x is not None and len(x) > 0 and all(is_public_ip(a) for a in x) for x in batch], dtype="bool")

    return F.pandas_udf(run, BooleanType())(ips)


def is_local_host(host_name: Column) -> Column:
    return (host_name == "localhost") | host_name.rlike("(?:" + "|".join(re.escape(s) for s in LOCAL_SUFFIXES) + r")\z")


def glob_regex(pattern: str) -> str:
    """A Java regular expression that matches what the glob matches, case-sensitively; ``*`` crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + (2 if pattern[i : i + 1] == "!" else 1))
            if end < 0:
                out.append(r"\[")
                continue
            body = pattern[i:end]
            i = end + 1
            negated = body.startswith("!")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{body}]")
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def matches_patterns(url: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Some include pattern matches (or there is none), and no exclude pattern does."""
    hit = lambda patterns: [url.rlike(glob_regex(p)) for p in patterns]
    wanted = F.lit(True)
    if include:
        wanted = F.lit(False)
        for h in hit(include):
            wanted = wanted | h
    for h in hit(exclude):
        wanted = wanted & ~h
    return wanted
