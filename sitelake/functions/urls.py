"""URL column functions. All are plain Column expressions and total: they never raise on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SOCIAL_DOMAINS = (
    "facebook.com", "instagram.com", "twitter.com", "x.com",
    "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com",
)
NON_PAGE_HREF = r"^(#|mailto:|tel:|javascript:)"
NON_NAV_SCHEME = r"^(tel:|mailto:|javascript:)"
FONT_SUFFIX = r"\.(woff|woff2|ttf|otf)$"

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PREFIX = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"
_PATH = _PREFIX + r"([^?#]*)"
_DOTTED = r"(^|/)\.\.?(/|$)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), _SCHEME, 1))


def authority(url: Column | str) -> Column:
    """Network location as written (case-sensitive, port kept)."""
    return F.regexp_extract(_col(url), _AUTHORITY, 1)


def path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), _PATH, 1)


def normalize_url(url: Column | str) -> Column:
    """Scheme, network location and path; no query, fragment or trailing slash; empty path is `/`."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    return F.concat(scheme(url), F.lit("://"), authority(url), F.when(trimmed == "", "/").otherwise(trimmed))


def same_origin(base: Column | str, candidate: Column | str) -> Column:
    return authority(base) == authority(candidate)


def _remove_dot_segments(full_path: Column) -> Column:
    parts = F.split(full_path, "/", -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part == ".", acc)
        # The leading empty segment of an absolute path is never popped.
        .when(part == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(part))),
    )
    ends_in_dots = F.element_at(parts, -1).isin(".", "..")
    joined = F.array_join(F.when(ends_in_dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(joined == "", "/").otherwise(joined)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of `href` as seen from the page at `base`."""
    base, href = _col(base), _col(href)
    origin = F.regexp_extract(base, _PREFIX, 0)
    base_path = path(base)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_extract(base_path, "^(.*/)?", 0))
    href_path = F.regexp_extract(href, "^[^?#]*", 0)
    href_rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    full_path = F.when(href.startswith("/"), href_path).otherwise(F.concat(folder, href_path))
    clean_path = F.when(full_path.rlike(_DOTTED), _remove_dot_segments(full_path)).otherwise(full_path)
    return (
        F.when(href == "", base)
        .when(href.rlike(_SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("?"), F.concat(F.regexp_extract(base, "^[^?#]*", 0), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), href))
        .otherwise(F.concat(origin, clean_path, href_rest))
    )


def is_crawlable_href(href: Column | str) -> Column:
    """Not empty, not a same-page anchor, not a mail, phone or script link."""
    trimmed = F.trim(_col(href))
    return (trimmed != "") & ~trimmed.rlike(NON_PAGE_HREF)


def social_domain(href: Column | str) -> Column:
    """First listed social domain contained in the href, else null."""
    lowered = F.lower(_col(href))
    return F.coalesce(*[F.when(lowered.contains(d), F.lit(d)) for d in SOCIAL_DOMAINS])


def is_nav_href(href: Column | str) -> Column:
    lowered = F.lower(F.trim(_col(href)))
    return (lowered != "") & ~lowered.rlike(NON_NAV_SCHEME) & social_domain(lowered).isNull()


def is_action_href(href: Column | str) -> Column:
    """Usable as a call to action: phone, mail and real anchors are fine here."""
    trimmed = F.trim(F.coalesce(_col(href), F.lit("")))
    return (trimmed != "") & (trimmed != "#") & ~F.lower(trimmed).startswith("javascript:")


def asset_file_name(url: Column | str) -> Column:
    """Stable stored name of an asset: short digest of the URL plus its last path part."""
    name = F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    return F.concat(F.substring(F.sha1(_col(url)), 1, 8), F.lit("-"), F.when(name == "", "asset").otherwise(name))


def stays_inside_root(relative: Column | str) -> Column:
    """True when a relative path, resolved step by step, never leaves its root."""
    rel = _col(relative)
    # Any step above the root counts as an escape, even when a later step would come back.
    depths = F.aggregate(
        F.split(rel, "/", -1),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda acc, part: F.struct(
            (acc["depth"] + F.when(part.isin("", "."), 0).when(part == "..", -1).otherwise(1)).alias("depth"),
            F.least(acc["lowest"], acc["depth"] + F.when(part == "..", -1).otherwise(0)).alias("lowest"),
        ),
    )
    return ~rel.startswith("/") & (depths["lowest"] >= 0)


def add_asset_token(text: Column | str, token: str, css: bool = False) -> Column:
    """Append a token parameter to relative asset references in HTML attributes or CSS `url()`."""
    param = f"preview_token={token}"
    text = _col(text)
    if css:
        skip = r"(?!https?://|//|data:)"
        with_query = rf"""url\(\s*(['"]?){skip}([^'")?]*\?[^'")]*)\1\s*\)"""
        plain = rf"""url\(\s*(['"]?){skip}([^'")?]+)\1\s*\)"""
        first = F.regexp_replace(text, with_query, f"url($1$2&{param}$1)")
        # The second pass only sees values without `?`, so nothing is tagged twice.
        return F.regexp_replace(first, plain, f"url($1$2?{param}$1)")
    skip = r"(?!https?://|//|/|#|data:|mailto:|tel:)"
    first = F.regexp_replace(text, rf'(href|src)="{skip}([^"?]*\?[^"]*)"', f'$1="$2&{param}"')
    return F.regexp_replace(first, rf'(href|src)="{skip}([^"?]+)"', f'$1="$2?{param}"')
