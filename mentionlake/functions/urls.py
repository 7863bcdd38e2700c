"""URL expressions. Regular expressions rather than parse_url, which rejects
spaces and brackets that occur in landed links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mentionlake import constants as C
from mentionlake.functions.scalars import literal_strings

_ABSOLUTE = r"(?i)^[a-z][a-z0-9+.\-]*://[^/?#\s]+"


def is_absolute(url: Column) -> Column:
    return url.rlike(_ABSOLUTE)


def host(url: Column) -> Column:
    """Lower-case host without user info and port; '' when the URL does not parse."""
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def normalize_domain(value: Column) -> Column:
    """Scheme, leading www. and path removed; lower case."""
    out = F.regexp_replace(value, "(?i)^https?://", "")
    out = F.regexp_replace(out, r"(?i)^www\.", "")
    return F.lower(F.trim(F.regexp_replace(out, "(?s)/.*$", "")))


def domain_of(url: Column) -> Column:
    """Host without a leading www.; NULL when the URL does not parse."""
    return F.nullif(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def canonical_url(url: Column, params: list[str] | None = None) -> Column:
    """Tracking parameters, fragment and trailing slashes removed; text that is
    not an absolute URL is returned unchanged."""
    drop = params or C.TRACKING_PARAMS
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    raw_path = path(url)
    clean_path = F.when(raw_path.isin("", "/"), F.lit("/")).otherwise(
        F.coalesce(F.nullif(F.regexp_replace(raw_path, "/+$", ""), F.lit("")), F.lit("/"))
    )
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(literal_strings(drop), F.substring_index(p, "=", 1)))
    suffix = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(is_absolute(url), F.concat(scheme, F.lit("://"), authority, clean_path, suffix)).otherwise(url)


def host_suffixes(domain: Column) -> Column:
    """['a.b.c', 'b.c', 'c'] for 'a.b.c': every value that a host list may hold."""
    labels = F.split(domain, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def on_host_list(domain: Column, hosts: list[str]) -> Column:
    """Exact host or sub-domain of a listed host; NULL counts as not listed."""
    return F.coalesce(F.arrays_overlap(host_suffixes(domain), literal_strings(hosts)), F.lit(False))


def contains_any(value: Column, needles: list[str]) -> Column:
    """Plain substring test against a short fixed list; NULL counts as no hit."""
    hit = F.exists(literal_strings(needles), lambda n: F.contains(value, n))
    return F.coalesce(hit, F.lit(False))


def title_from_slug(url: Column) -> Column:
    """Readable title from the last path segment; the URL itself when it does not parse."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    decoded = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    plain = F.regexp_replace(decoded, r"(?i)\.(html?|php|aspx?)$", "")
    return F.when(is_absolute(url), F.trim(F.regexp_replace(plain, "[-_]+", " "))).otherwise(url)


def legacy_hash(url: Column) -> Column:
    """The 32-bit rolling hash (h*31 + code unit), absolute value, base 36.

    Collision-prone; kept because external ids already stored use it.
    """
    units = F.transform(F.split(url, ""), lambda c: F.ascii(c).cast("bigint"))

    def step(h: Column, c: Column) -> Column:
        wrapped = F.pmod(h * 31 + c, F.lit(1 << 32))
        return F.when(wrapped >= (1 << 31), wrapped - (1 << 32)).otherwise(wrapped)

    value = F.abs(F.aggregate(F.filter(units, lambda u: u > 0), F.lit(0).cast("bigint"), step))
    return F.lower(F.conv(value.cast("string"), 10, 36))
