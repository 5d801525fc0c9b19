"""Column expressions for titles, hrefs and URLs (JVM-side).

These are the per-row rules of the link model written as Spark expressions so
they run inside whole-stage codegen over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces whose links are not article links (case-sensitive).
EXCLUDED_NAMESPACES = (
    "Wikipedia",
    "Help",
    "File",
    "Category",
    "Template",
    "Template talk",
    "Portal",
    "Special",
    "Talk",
    "User",
    "User talk",
    "Wikipedia talk",
    "MediaWiki",
    "Draft",
    "Module",
)

# Fixed value: suffix of disambiguation pages.
DISAMBIGUATION_SUFFIX = " (disambiguation)"

# Fixed value: default article path prefix and site base.
ARTICLE_PREFIX = "/wiki/"
SITE_BASE = "https://en.wikipedia.org"

# Characters a path segment keeps unescaped beyond the
# unreserved set, as (form-encoded escape, literal).
_PATH_SEGMENT_KEEP = (("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"), ("%7E", "~"))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def try_url_decode(col: Column | str) -> Column:
    return F.call_function("try_url_decode", _c(col))


def path_unescape(col: Column | str) -> Column:
    """Percent-decoding of a URL path: ``+`` stays ``+``; NULL on a malformed escape."""
    return try_url_decode(F.replace(_c(col), F.lit("+"), F.lit("%2B")))


def strip_fragment(col: Column | str) -> Column:
    """Cut at the first ``#`` (the query string is kept)."""
    return F.substring_index(_c(col), "#", 1)


def decode_title(path: Column | str) -> Column:
    """Decoded path with ``_`` -> space; a malformed escape returns the raw path."""
    p = _c(path)
    return F.coalesce(F.replace(path_unescape(p), F.lit("_"), F.lit(" ")), p)


def is_excluded_namespace(title: Column | str) -> Column:
    """Text before the first ``:`` is an excluded namespace."""
    t = _c(title)
    return F.contains(t, F.lit(":")) & F.substring_index(t, ":", 1).isin(*EXCLUDED_NAMESPACES)


def is_disambiguation(title: Column | str) -> Column:
    """Title ends with `` (disambiguation)``."""
    return F.endswith(_c(title), F.lit(DISAMBIGUATION_SUFFIX))


def is_article_title(title: Column | str) -> Column:
    """Non-empty and neither namespaced nor a disambiguation page (X2 + X4 + X5)."""
    t = _c(title)
    return (t != F.lit("")) & ~is_excluded_namespace(t) & ~is_disambiguation(t)


def href_to_title(href: Column | str, prefix: str = ARTICLE_PREFIX) -> Column:
    """Article href -> title, NULL when the href is not under ``prefix``.

    Protocol-relative hrefs (``//host``) are external and never titles.
    """
    h = _c(href)
    under = F.startswith(h, F.lit(prefix)) & ~F.startswith(h, F.lit("//"))
    path = strip_fragment(F.substr(h, F.lit(len(prefix) + 1)))
    return F.when(under, decode_title(path))


def content_hash(col: Column | str) -> Column:
    """Lower-case hex MD5 of the UTF-8 bytes."""
    return F.md5(_c(col))


def title_to_path(title: Column | str) -> Column:
    """X9 (path part): space -> ``_`` then path-segment escaping."""
    enc = F.call_function("url_encode", F.replace(_c(title), F.lit(" "), F.lit("_")))
    for escaped, literal in _PATH_SEGMENT_KEEP:
        enc = F.replace(enc, F.lit(escaped), F.lit(literal))
    return F.replace(enc, F.lit("*"), F.lit("%2A"))


def title_to_url(title: Column | str, base: str = SITE_BASE, prefix: str = ARTICLE_PREFIX) -> Column:
    """Article URL of a title."""
    return F.concat(F.lit(base + prefix), title_to_path(title))


def redirect_target(original: Column | str, final: Column | str, prefix: str = ARTICLE_PREFIX) -> Column:
    """Title a fetch was redirected to, or ``''``.

    Same URL -> ``''``; unparsable final URL or a path outside ``prefix`` ->
    ``''``.  The path is decoded twice (URL parsing, then title unescaping); a
    failing second pass keeps the once-decoded text with ``_`` intact.
    """
    o, f = _c(original), _c(final)
    raw = F.call_function("try_parse_url", f, F.lit("PATH"))
    once = path_unescape(raw)
    rest = F.substr(once, F.lit(len(prefix) + 1))
    twice = F.replace(path_unescape(rest), F.lit("_"), F.lit(" "))
    return (
        F.when(o == f, F.lit(""))
        .when(once.isNull() | ~F.startswith(once, F.lit(prefix)), F.lit(""))
        .otherwise(F.coalesce(twice, rest))
    )
