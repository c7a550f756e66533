"""Column functions over URLs and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(?i:(https?))://([^/?#@]+)(/[^?#]*)?(\?[^#]*)?(#.*)?$"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]+)", 1))


def rejection(url: Column) -> Column:
    """Why a URL cannot be crawled, or null."""
    host = F.regexp_extract(url, PARTS, 2)
    port = F.regexp_extract(host, r":(\d+)$", 1)
    name = F.lower(F.regexp_replace(host, r":\d+$", ""))
    scheme = F.lower(F.regexp_extract(url, PARTS, 1))
    standard = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return (
        F.when(url.isNull() | ~url.rlike(r"^(?i:https?)://"), "scheme")
        .when(url.rlike(r"^[A-Za-z]+://[^/?#]*@"), "credentials")
        .when(~url.rlike(PARTS) | (name == ""), "host")
        .when(~(standard | name.isin("localhost", "127.0.0.1")), "port")
    )


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, an explicit path, no fragment; null where :func:`rejection` has a reason."""
    path = F.regexp_extract(url, PARTS, 3)
    whole = F.concat(F.lower(F.regexp_extract(url, PARTS, 1)), F.lit("://"), F.lower(F.regexp_extract(url, PARTS, 2)), F.when(path == "", "/").otherwise(path), F.regexp_extract(url, PARTS, 4))
    return F.when(rejection(url).isNull(), whole)


def matches_domain(host: Column, pattern: Column) -> Column:
    """Whether a host is the pattern's domain or below it; a leading ``*.`` does not count."""
    domain = F.regexp_replace(F.lower(F.trim(pattern)), r"^\*\.", "")
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))
