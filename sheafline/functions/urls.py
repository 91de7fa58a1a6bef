"""URL parts and resolution by regular expression.

``parse_url`` goes through java.net.URI and refuses many harvested addresses
(blanks, pipes); the generic-syntax expression of RFC 3986 accepts them all.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_HEAD = rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, rf"^({_SCHEME}):", 1))


def url_netloc(url: Column) -> Column:
    """Authority with its port and user part."""
    return F.regexp_extract(url, rf"^(?:{_SCHEME}:)?//([^/?#]*)", 1)


def url_host(url: Column) -> Column:
    """Authority without user part and port, lower-cased."""
    return F.lower(F.regexp_extract(url_netloc(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, rf"{_HEAD}([^?#]*)", 1)


def url_query(url: Column) -> Column:
    """Query with its question mark, or ''."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def url_tail(url: Column) -> Column:
    """Everything after the authority; '/' when there is nothing."""
    tail = F.regexp_extract(url, rf"(?s){_HEAD}(.*)$", 1)
    return F.when(tail == "", F.lit("/")).otherwise(tail)


def url_origin(url: Column) -> Column:
    """``scheme://netloc``."""
    return F.concat(url_scheme(url), F.lit("://"), url_netloc(url))


def percent_decode(text: Column) -> Column:
    """Decode %XX; text with a broken escape is left as it is. '+' stays."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(text.contains("%"), F.coalesce(decoded, text)).otherwise(text)


def _without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments."""

    def step(done: Column, segment: Column) -> Column:
        popped = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return (
            F.when(segment == ".", done)
            .when(segment == "..", popped)
            .otherwise(F.concat(done, F.array(segment)))
        )

    def resolve(segments: Column) -> Column:
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        last = F.element_at(segments, -1)
        return F.when(
            last.isin(".", ".."), F.concat(F.array_join(kept, "/"), F.lit("/"))
        ).otherwise(F.array_join(kept, "/"))

    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), let(F.split(path, "/"), resolve)).otherwise(path)


def url_join(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` found on page ``base``."""
    origin = url_origin(base)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_rest = F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    base_path = F.when(url_path(base) == "", F.lit("/")).otherwise(url_path(base))
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    return (
        F.when(ref == "", base)
        .when(ref.rlike(rf"^{_SCHEME}:"), ref)
        .when(ref.startswith("//"), F.concat(url_scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, _without_dots(ref_path), ref_rest))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), ref))
        .when(ref.startswith("?"), F.concat(origin, url_path(base), ref))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, ref_path)), ref_rest))
    )
