"""URL identity, resolution and allow-list predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(url: Column, part: str) -> Column:
    """``scheme``, ``authority``, ``path``, ``query`` or ``fragment``; empty when absent."""
    group = ("scheme", "authority", "path", "query", "fragment").index(part) + 1
    return F.regexp_extract(url, _PART, group)


def host_of(url: Column) -> Column:
    """Lower-case host without user info and port."""
    bare = F.regexp_replace(url_part(url, "authority"), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def _decoded(text: Column) -> Column:
    """Form-decoded text; text with a broken escape keeps its escapes."""
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _encoded(text: Column) -> Column:
    """Form-encoded text; only letters, digits and ``_.-~`` stay."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Identity of a resource: lower scheme/host, no fragment, the query decoded, sorted by name and value
    and encoded again, so that different spellings of one query agree."""
    path = url_part(url, "path")
    named = F.transform(F.filter(F.split(url_part(url, "query"), "&"), lambda p: p != ""), lambda p: F.struct(
        _decoded(F.substring_index(p, "=", 1)).alias("name"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value")))
    query = F.array_join(F.transform(F.array_sort(named), lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&")
    return F.concat(
        F.lower(url_part(url, "scheme")), F.lit("://"), host_of(url),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def resolve_url(base: Column, link: Column) -> Column:
    """Join a link to its page: absolute, scheme-relative, rooted, query-only or relative."""
    scheme, authority = url_part(base, "scheme"), url_part(base, "authority")
    origin = F.concat(scheme, F.lit("://"), authority)
    folder = F.regexp_extract(url_part(base, "path"), r"^(.*/)?[^/]*$", 1)
    return (
        F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.startswith(link, F.lit("?")), F.concat(origin, url_part(base, "path"), link))
        .when(link.startswith("#") | (link == ""), F.concat(F.regexp_replace(base, r"#.*$", ""), link))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def allowed_url(url: Column, hosts: Sequence[str] | None = None, suffixes: Sequence[str] = (),
                schemes: Sequence[str] = ("http", "https"), path: str | None = None,
                numeric_key: str | None = None) -> Column:
    """Scheme, host, default port, no user info, no control characters or backslash;
    optionally one path pattern and exactly one numeric query value."""
    authority, host = url_part(url, "authority"), host_of(url)
    scheme = F.lower(url_part(url, "scheme"))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    known = F.lit(False)
    if hosts:
        known = known | host.isin(list(hosts))
    for suffix in suffixes:
        known = known | F.endswith(host, F.lit(suffix))
    rule = (
        scheme.isin(list(schemes)) & known & ~F.contains(authority, F.lit("@"))
        & ((port == "") | (port == F.when(scheme == "http", F.lit("80")).otherwise(F.lit("443"))))
        & ~F.rlike(url, F.lit(r"[\x00-\x1f\\]"))
    )
    if path is not None:
        rule = rule & F.rlike(url_part(url, "path"), F.lit(f"^(?:{path})$"))
    if numeric_key is not None:
        pairs = F.filter(F.split(url_part(url, "query"), "&"), lambda p: F.startswith(p, F.lit(numeric_key + "=")))
        rule = rule & (F.size(pairs) == 1) & F.rlike(F.get(pairs, F.lit(0)), F.lit(r"=\d{1,10}$"))
    return F.coalesce(rule, F.lit(False))


def opaque_id(url: Column) -> Column:
    """Pseudonym of a URL: hash of its canonical form."""
    return F.sha2(canonical_url(url), 256)


def points_to_pdf(url: Column) -> Column:
    """Path ends in .pdf, or some query value mentions it."""
    values = F.transform(F.split(url_part(url, "query"), "&"), lambda p: F.regexp_replace(p, r"^[^=]*=?", ""))
    return F.endswith(F.lower(url_part(url, "path")), F.lit(".pdf")) | F.exists(
        values, lambda v: F.contains(F.lower(v), F.lit(".pdf")))
