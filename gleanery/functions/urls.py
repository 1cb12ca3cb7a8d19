"""Column builders on addresses."""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HOST = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@\s]*@)?([^/?#:\s]*)"


def host(url: Column) -> Column:
    """Lower-case host without port and leading ``www.``; '' for null or unreadable addresses."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))), r"^www\.", "")


def page_domain(source_url: str = "source_url_used", canonical_url: str = "canonical_url") -> Column:
    """Domain of a result: the host of the address it came from or, where that is empty or null, of the canonical one."""
    return host(F.coalesce(F.when(F.trim(source_url) != "", F.col(source_url)), F.col(canonical_url)))


def url_points(url: Column) -> Column:
    """How good an address is for fetching: secure, plain, short, and no login, social, tracking or mobile page."""
    u = F.trim(F.coalesce(url, F.lit("")))
    low = F.lower(u)
    points = F.when(low.startswith("https://"), 30.0).when(low.startswith("http://"), 18.0).otherwise(0.0)
    points = points + F.when(F.contains(low, F.lit("?")), 0.0).otherwise(10.0)
    points = points - F.when(low.rlike(r"utm_|fbclid=|gclid=|mc_cid=|mc_eid="), 14.0).otherwise(0.0)
    points = points - F.when(low.rlike(r"/login|/signin|/subscribe|facebook\.com|twitter\.com|x\.com/|instagram\.com"), 40.0).otherwise(0.0)
    points = points - F.when(low.rlike(r"/amp(?![A-Za-z0-9_])|amp\."), 4.0).otherwise(0.0)
    return points + F.greatest(F.lit(0.0), 18 - F.length(u) / 18)


def canonical(url: str | None) -> str:
    """An address in canonical form, '' if it is none: http(s) only, host in lower case and ASCII, no default port, no fragment."""
    u = (url or "").strip().strip("'\"").strip()
    if u.startswith("//"):
        u = "https:" + u
    if not re.match(r"https?://", u, re.I) and "." in u and not re.search(r"\s", u):
        u = "https://" + u
    m = re.match(r"(https?)://([^/?#\\]*)([^?#]*)(\?[^#]*)?", u, re.I)
    if not m:
        return ""
    scheme, place, path, query = m[1].lower(), m[2], m[3].replace("\\", "/"), m[4] or ""
    login, at, place = place.rpartition("@")
    name, _, port = place.partition(":") if not place.startswith("[") else (place, "", "")
    try:
        name = name.lower() if name.isascii() else name.encode("idna").decode()
    except UnicodeError:
        return ""
    if not name or re.search(r"[\s<>^|%]", name) or port and not (port.isdigit() and int(port) < 65536):
        return ""
    port = "" if not port or (scheme, int(port)) in (("http", 80), ("https", 443)) else f":{int(port)}"
    parts: list[str] = []
    for p in path.split("/")[1:]:
        if p.lower() in ("..", "%2e%2e"):
            parts[-1:] = []
        elif p.lower() not in (".", "%2e"):
            parts.append(p)
    if path.endswith(("/.", "/..")):
        parts.append("")
    return f"{scheme}://{login}{at}{name}{port}/{quote('/'.join(parts), safe=_PATH)}{quote(query, safe=_PATH + '?')}"


#: Fixed value: what a path may hold unescaped.
_PATH = "/%:@!$&'()*+,;=~-._|[]^{}"


@F.pandas_udf(StringType())
def canonical_url(s: pd.Series) -> pd.Series:
    return s.map(canonical)
