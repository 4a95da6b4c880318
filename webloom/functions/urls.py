"""URLs: parts, resolution, cleaning and the rules of which links to follow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def strip(u: Column) -> Column:
    """Without parameters of the last segment, query and fragment."""
    return F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), ";[^/]*$", "")


#: An anchor up to its href: up to 50 other attributes before it, whose values may be quoted.
ANCHOR = r"""(?i)<a(?:\s+[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?){0,50}?\s+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def anchors(html: Column) -> Column:
    """The href of every anchor of a page, in order: quoted or not, the character references of markup decoded."""
    raw = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))

    def plain(v: Column) -> Column:
        v = F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            v = F.replace(v, F.lit(name), F.lit(char))
        return v

    return F.transform(raw, plain)


def resolve_root(base: Column, href: Column) -> Column:
    """Absolute, scheme-relative and root-relative references; null for any other."""
    return (
        F.when(href.rlike("^(?i)https?://"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(scheme(base), F.lit("://"), authority(base), href))
    )


def worth_following(href: Column) -> Column:
    """Not empty, no mail, script or fragment link, and no scheme but http(s)."""
    other = href.rlike("^(?i)[a-z][a-z0-9+.-]*:") & ~href.rlike("^(?i)http")
    return (href != "") & ~href.startswith("#") & ~href.rlike("^(?i)(mailto|javascript):") & ~other


#: Endings of pages that may be followed; fixed values.
PAGES = (".html", ".php", ".htm", ".asp", ".aspx")


def wanted(u: Column) -> Column:
    """http(s), and a last segment without a dot or with a page's ending in it."""
    last = F.regexp_extract(path(u), "([^/]*)$", 1)
    ending = F.lit(False)
    for e in PAGES:
        ending = ending | F.contains(last, F.lit(e))
    return scheme(u).isin("http", "https") & (~F.contains(last, F.lit(".")) | ending)


def normalize(u: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment."""
    host = F.regexp_replace(F.lower(authority(u)), F.when(scheme(u) == "https", F.lit(":443$")).otherwise(F.lit(":80$")), F.lit(""))
    return F.concat(scheme(u), F.lit("://"), host, F.regexp_extract(u, r"^[^:]*://[^/?#]*([^#]*)", 1))


@F.pandas_udf(StringType())
def url_join(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A reference resolved against a base, by RFC 3986; null where either is null or cannot be read."""
    from urllib.parse import urljoin

    def one(base: str | None, ref: str | None) -> str | None:
        try:
            return None if base is None or ref is None else urljoin(base, ref)
        except ValueError:
            return None

    for b, r in parts:
        yield pd.Series([one(x, y) for x, y in zip(b, r, strict=True)], dtype=object)
