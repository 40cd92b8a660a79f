"""URL resolution, safe names and page-link predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark decoration images, and suffixes of content images.
DECORATION_WORDS = ("ajax-loader", "loader", "spinner", "logo", "icon", "flag", "sprite", "bullet", "menu", "arrow")
CONTENT_SUFFIXES = ("jpg", "jpeg", "png", "webp")


def _escape(path: Column) -> Column:
    """Percent-encode what a browser would in a path; already encoded text, and so most paths, are kept whole."""
    chars = F.filter(F.split(path, ""), lambda c: c != "")
    allowed = r"[!#-;=?-_a-z|~%&\[\]\\^]"
    plain = f"^{allowed}$"
    encoded = F.array_join(
        F.transform(
            chars, lambda c: F.when(c.rlike(plain), c).otherwise(F.regexp_replace(F.url_encode(c), r"^\+$", "%20"))
        ),
        "",
    )
    return F.when(path.rlike(f"^{allowed}*$"), path).otherwise(encoded)


def _clean_path(path: Column) -> Column:
    """Fold ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    stack = F.aggregate(
        segments,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(stack, "/"), tail)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` against ``base``; NULL when there is no usable base."""
    raw = F.trim(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    folder = F.regexp_extract(F.substring(no_query, F.length(origin) + 1, 2147483647), r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    target = F.regexp_extract(raw, r"^([^?#]*)", 1)
    rest = F.substring(raw, F.length(target) + 1, 2147483647)
    from_root = F.concat(origin, _escape(_clean_path(target)), _escape(rest))
    from_folder = F.concat(origin, _escape(_clean_path(F.concat(folder, target))), _escape(rest))
    return (
        F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), raw)
        .when(origin == "", F.lit(None))
        .when(raw == "", no_fragment)
        .when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw))
        .when(raw.startswith("/"), from_root)
        .when(raw.startswith("?"), F.concat(no_query, _escape(raw)))
        .when(raw.startswith("#"), F.concat(no_fragment, _escape(raw)))
        .otherwise(from_folder)
    )


def safe_name(value: Column) -> Column:
    """A name fit for a file: reserved runs become ``_``, spaces collapse, 180 characters at most."""
    cleaned = F.regexp_replace(value, r'[\\/:*?"<>|]+', "_")
    cleaned = F.left(F.trim(F.regexp_replace(cleaned, r"\s+", " ")), F.lit(180))
    return F.when(cleaned == "", "item").otherwise(F.coalesce(cleaned, F.lit("item")))


def is_content_image(src: Column, width: Column, height: Column, min_side: int = 80) -> Column:
    """Photo-like image: no decoration word, a photo suffix, not known to be tiny on both sides."""
    low = F.lower(F.coalesce(src, F.lit("")))
    path = F.regexp_replace(low, r"[?#].*$", "")
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    tiny = ((w > 0) | (h > 0)) & (w < min_side) & (h < min_side)
    return (
        (low != "")
        & ~low.rlike("(" + "|".join(DECORATION_WORDS) + ")")
        & path.rlike(r"\.(" + "|".join(CONTENT_SUFFIXES) + r")$")
        & ~tiny
    )
