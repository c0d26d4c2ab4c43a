"""URLs, paths and IRIs as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes whose URLs need a host (WHATWG URL standard, "special" schemes but file).
SPECIAL_SCHEMES = ("http", "https", "ws", "wss", "ftp")

# Fixed value: a last segment that is a file or folder beside a package's metadata.
PLAIN_NAME = r"\w*(\.\w*)?"

_LOCAL = r"^(\\\\|.:|/|\.|file:)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_HOST = r"([^/\\?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^\x00-\x20#/:<>?@\[\\\]^|%\x7F]+)(:[0-9]*)?([/\\?#]|$)"
_SPECIAL = rf"(?i)^({'|'.join(SPECIAL_SCHEMES)}):"
_SPECIAL_WHOLE = rf"(?i)^({'|'.join(SPECIAL_SCHEMES)}):[/\\]*{_HOST}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_not_url(s: Column) -> Column:
    """True for local paths and for text that isn't an absolute URL (fragments, relative references, blank nodes)."""
    url = s.rlike(_SCHEME) & (~s.rlike(_SPECIAL) | s.rlike(_SPECIAL_WHOLE))
    return s.rlike(_LOCAL) | ~url


def is_absolute_iri(s: Column) -> Column:
    """Whether the text begins with a scheme."""
    return s.rlike(_SCHEME)


def has_relative_component(s: Column) -> Column:
    """``./``, ``../``, ``#`` or ``/`` in front, or a slash anywhere."""
    return s.rlike(r"^(\./|\.\./|#|/)") | s.contains("/")


def _folded(path: Column) -> Column:
    """A path without its dot segments, however many; ``..`` at its start stays there."""
    parts = F.split(path, "/", -1)
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))  # noqa: E731, the empty text before the leading slash stays
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def base_parts(base: Column) -> Column:
    """What resolving against a base needs of it, as a struct: plain (without its fragment), authority, folder (of its path) and depth (segments of its path)."""
    plain = F.regexp_replace(base, r"#.*$", "")
    cut = let(plain, lambda p: F.struct(p.alias("plain"), F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1).alias("authority"), F.regexp_extract(p, r"^(.*/)", 1).alias("folder")))

    def parts(c: Column) -> Column:
        path = F.substring(c["plain"], F.length(c["authority"]) + 1, F.length(c["plain"]))
        own = F.when(F.length(c["folder"]) > F.length(c["authority"]), F.substring(c["folder"], F.length(c["authority"]) + 1, F.length(c["folder"]))).otherwise("/")
        return F.struct(c["plain"].alias("plain"), c["authority"].alias("authority"), own.alias("folder"), F.size(F.filter(F.split(path, "/"), lambda x: x != "")).alias("depth"))

    return F.when(base.isNotNull(), let(cut, parts))


def with_parts(parts: Column, s: Column) -> Column:
    """Resolves a relative reference against a base's parts; null if it has more parent steps than the base's path has segments.

    A fragment replaces the base's fragment and loses a slash before it; a rooted
    path keeps scheme and authority; other paths replace what follows the last
    slash, with dot segments removed.  A base without an authority (``urn:``) is
    simply put in front.
    """
    steps = (F.length(s) - F.length(F.replace(s, F.lit("../"), F.lit("")))) / 3
    path = let(F.when(s.startswith("/"), s).otherwise(F.concat(parts["folder"], s)), lambda x: F.when(x.rlike(r"/\.\.?(/|$)"), _folded(x)).otherwise(x))
    fragment = F.concat(F.regexp_replace(parts["plain"], "/$", ""), s)
    return F.when(s.startswith("#"), fragment).when(parts["authority"] == "", F.concat(parts["plain"], s)).when(~s.contains("../") | (steps <= parts["depth"]), F.concat(parts["authority"], path))


def with_base(base: Column, s: Column) -> Column:
    """Resolves a relative reference against a base IRI, as ``with_parts`` does."""
    return let(base_parts(base), lambda parts: with_parts(parts, s))


def resolved(base: Column, s: Column) -> Column:
    """Resolves a relative reference against a base IRI as RFC 3986 has it: fragments and queries keep the base's path as it is, and steps above its root are lost.  A base without an authority is put in front."""

    def use(parts: Column) -> Column:
        steps = F.regexp_extract(s, "^[^?#]*", 0)
        path = let(F.when(s.startswith("/"), steps).otherwise(F.concat(parts["folder"], steps)), lambda x: F.when(x.rlike(r"/\.\.?(/|$)"), _folded(x)).otherwise(x))
        whole = F.concat(parts["authority"], path, F.substring(s, F.length(steps) + 1, F.length(s)))
        query = F.concat(F.regexp_replace(parts["plain"], r"\?.*$", ""), s)
        scheme = F.concat(F.substring_index(parts["plain"], ":", 1), F.lit(":"), s)
        return F.when(s == "", parts["plain"]).when(s.startswith("#"), F.concat(parts["plain"], s)).when(s.startswith("?"), query).when(s.startswith("//"), scheme).when(parts["authority"] == "", F.concat(parts["plain"], s)).otherwise(whole)

    return let(base_parts(base), use)


def guess_location(url: Column) -> Column:
    """Where a package's metadata lies, from the package's URL.

    A last segment that is one plain name (letters, digits, underscores, at most one
    dot) is a file or folder beside the metadata; below anything else it lies itself.
    """
    name = F.lit("ro-crate-metadata.json")
    last = F.substring_index(url, "/", -1)
    beside = url.contains("/") & last.rlike(rf"(?U)^{PLAIN_NAME}$")
    folder = F.substring(url, F.lit(1), F.length(url) - F.length(last))
    return F.concat(F.when(beside, folder).otherwise(F.concat(url, F.lit("/"))), name)


def expand_home(path: Column, home: str) -> Column:
    """A path that begins with ``~`` as one below ``home``."""
    return F.when((path == "~") | path.startswith("~/"), F.concat(F.lit(home.rstrip("/")), F.substring(path, 2, 1 << 20))).otherwise(path)
