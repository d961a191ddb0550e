"""URLs: canonical forms, publishers and origins."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, quote_plus, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track, beside those that begin with utm_.
TRACKING = (
    "fbclid",
    "gclid",
    "igshid",
    "mc_cid",
    "mc_eid",
    "n_media",
    "n_query",
    "n_rank",
    "n_url",
)
_PORTS = {"http": 80, "https": 443}


def canonical(raw: str | None) -> str | None:
    """One form of a URL: videos by their id, no fragment or tracking, sorted parameters,
    no slash at the end.  What is no URL is trimmed."""
    if raw is None:
        return None
    try:
        parts = urlsplit(raw.strip())
        host, port = parts.hostname, parts.port
        if not parts.scheme or not host or re.search(r"[\s<>^|%]", host):
            return raw.strip()
    except ValueError:
        return raw.strip()
    try:
        host = host.encode("ascii").decode()
    except UnicodeEncodeError:
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return raw.strip()
    query = parse_qsl(parts.query, keep_blank_values=True)
    bare = re.sub(r"^www\.", "", host)
    video = None
    if bare == "youtu.be":
        video = next((p for p in parts.path.split("/") if p), None)
    elif bare in ("youtube.com", "m.youtube.com", "youtube-nocookie.com"):
        video = next((v for k, v in query if k == "v"), None)
        if video is None and (found := re.match(r"/(?:shorts|live|embed)/([^/?#]+)", parts.path)):
            video = found[1]
    if video:
        return f"https://www.youtube.com/watch?v={quote(video, safe="!~*'()")}"
    kept = [(k, v) for k, v in query if not k.lower().startswith("utm_") and k.lower() not in TRACKING]
    kept.sort(key=lambda kv: kv[0].encode("utf-16-be"))
    plus = lambda s: quote_plus(s, safe="*").replace("~", "%7E")
    search = "&".join(f"{plus(k)}={plus(v)}" for k, v in kept)
    user = f"{parts.username or ''}{':' + parts.password if parts.password else ''}@" if parts.username or parts.password else ""
    place = "" if port is None or port == _PORTS.get(parts.scheme) else f":{port}"
    path = quote(parts.path, safe="/:@!$&'()*+,;=~%[]|^") or "/"
    out = f"{parts.scheme}://{user}{host}{place}{path}{'?' + search if search else ''}"
    return out[:-1] if out.endswith("/") else out


@F.pandas_udf(T.StringType())
def canonical_url(s: pd.Series) -> pd.Series:
    return s.map(canonical, na_action="ignore")


def publisher(url: Column | str, fallback: str = "출처 미확인") -> Column:
    """Host in lower case without www., or the fallback."""
    host = F.lower(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST")))
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(fallback)).otherwise(bare)


def resolve(href: str | None, base: str | None) -> str | None:
    """An absolute URL on the base's own secure origin, else null."""
    try:
        url, origin = urlsplit(urljoin(base or "", (href or "").strip())), urlsplit(base or "")
        same = url.scheme == "https" and (url.hostname, url.port or 443) == (origin.hostname, origin.port or 443)
        return url.geturl() if same and origin.scheme == "https" and not url.username else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def resolve_url(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve(h, b) for h, b in zip(href, base, strict=True)], dtype=object)
