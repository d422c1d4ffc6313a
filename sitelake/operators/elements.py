"""Element rows of pages and the columns derived from them.

A page keeps its elements and text runs as two arrays in one row. An element owns a contiguous slice of
both: its descendants are `node_no + 1 .. end_no`, its text runs `first_text .. first_text + text_count`.
So subtree questions are slices, and nothing in page extraction shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import text as X
from sitelake.functions import urls
from sitelake.functions.html import flatten_html

# Fixed values.
STRONG_HEADER = "(?i)location-header|site-header|main-header|masthead"
STRONG_FOOTER = "(?i)location-footer|site-footer|main-footer"
WEAK_HEADER = r"(?i)\bheader\b"
WEAK_FOOTER = r"(?i)\bfooter\b"
EXTRA_FOOTER_IDS = ("colophon",)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    The optimizer folds a column that is used in one place into that place. Inside a lambda this repeats an
    expensive expression for every array element, so array pipelines pass through a one-row `inline` here.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def keep_first(df: DataFrame, columns: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """Add arrays reduced to the first element of each identity; `columns` maps name to (items, identity)."""
    raw = computed_once(df, {f"_raw_{n}": items for n, (items, _) in columns.items()})
    keyed = computed_once(raw, {f"_key_{n}": F.transform(f"_raw_{n}", identity) for n, (_, identity) in columns.items()})

    def firsts(name: str, identity: Callable[[Column], Column]) -> Column:
        return F.filter(f"_raw_{name}", lambda item, i: F.array_position(F.col(f"_key_{name}"), identity(item)) == i + 1)

    reduced = computed_once(keyed, {n: firsts(n, identity) for n, (_, identity) in columns.items()})
    return reduced.drop(*[f"{p}{n}" for n in columns for p in ("_raw_", "_key_")])


def with_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add `elements` and `texts` arrays."""
    return pages.withColumn("_flat", flatten_html(html)).select("*", "_flat.elements", "_flat.texts").drop("_flat")


def element_rows(pages: DataFrame) -> DataFrame:
    """One row per element, for those who want the flat table; `text` is the element's whole text."""
    rows = with_elements(pages).select("page_id", F.col("texts"), F.explode("elements").alias("e"))
    return rows.select("page_id", "e.*", spaced_text(F.col("e")).alias("text")).drop("first_text", "text_count", "parent_key")


def attr(element: Column, name: str) -> Column:
    """Attribute value, null when the attribute is missing."""
    return F.try_element_at(element["attrs"], F.lit(name))


def attr_or_empty(element: Column, name: str) -> Column:
    return F.coalesce(attr(element, name), F.lit(""))


def class_tokens(element: Column) -> Column:
    return F.filter(F.split(attr_or_empty(element, "class"), r"\s+"), lambda c: c != "")


def has_class(element: Column, name: str) -> Column:
    return F.array_contains(class_tokens(element), name)


def descendants(scope: Column) -> Column:
    """Elements below a scope struct; the scope may be null."""
    count = F.coalesce(scope["end_no"] - scope["node_no"], F.lit(0))
    return F.slice(F.col("elements"), F.coalesce(scope["node_no"] + 1, F.lit(1)), count)


def _runs(element: Column) -> Column:
    runs = F.slice(F.col("texts"), F.coalesce(element["first_text"], F.lit(1)), F.coalesce(element["text_count"], F.lit(0)))
    own_hidden = element["tag"].isin("script", "style", "template")
    shown = F.filter(runs, lambda t: own_hidden | t["hidden"].isNull() | (t["hidden"] == "noscript"))
    return F.transform(shown, lambda t: t["text"])


def spaced_text(element: Column) -> Column:
    """Subtree text with the runs joined by spaces."""
    return F.array_join(_runs(element), " ")


def joined_text(element: Column) -> Column:
    """Subtree text with the runs joined directly, as labels and headings are read."""
    return F.array_join(_runs(element), "")


def first_element(elements: Column, predicate) -> Column:
    return F.try_element_at(F.filter(elements, predicate), F.lit(1))


def by_tag(*tags: str):
    return lambda e: e["tag"].isin(*tags)


def _semantic_scope(tag: str, strong: str, weak: str, extra_ids: tuple[str, ...] = ()) -> Column:
    """Ladder for the real header or footer container: strong class, strong id, tag, weak class, weak id, known ids."""
    elements = F.col("elements")
    rungs = [
        lambda e: attr_or_empty(e, "class").rlike(strong),
        lambda e: attr_or_empty(e, "id").rlike(strong),
        by_tag(tag),
        lambda e: attr_or_empty(e, "class").rlike(weak),
        lambda e: attr_or_empty(e, "id").rlike(weak),
        *[lambda e, i=i: attr(e, "id") == i for i in extra_ids],
    ]
    return F.coalesce(*[first_element(elements, rung) for rung in rungs])


def with_scopes(pages: DataFrame) -> DataFrame:
    """Add the main, header, footer and navigation containers (null where a page has none)."""
    elements = F.col("elements")
    first = F.try_element_at(elements, F.lit(1))
    scoped = computed_once(pages, {
        "main_scope": F.coalesce(first_element(elements, by_tag("main")), first_element(elements, by_tag("body")), first),
        "header_scope": _semantic_scope("header", STRONG_HEADER, WEAK_HEADER),
        "footer_scope": _semantic_scope("footer", STRONG_FOOTER, WEAK_FOOTER, EXTRA_FOOTER_IDS),
        "nav_tag": first_element(elements, by_tag("nav")),
    })
    return scoped.withColumn("nav_scope", F.coalesce("nav_tag", "header_scope")).drop("nav_tag")


def page_title() -> Column:
    return joined_text(first_element(F.col("elements"), by_tag("title")))


def meta_content(key: str, name: str) -> Column:
    """Content of the first `<meta key=name>`."""
    return attr(first_element(F.col("elements"), lambda e: (e["tag"] == "meta") & (attr(e, key) == name)), "content")


def site_name_guess() -> Column:
    """Declared site name, else the first part of the title, else the first heading."""
    declared, title = meta_content("property", "og:site_name"), page_title()
    heading = joined_text(first_element(F.col("elements"), by_tag("h1", "h2", "h3")))
    return (
        F.when(F.coalesce(declared, F.lit("")) != "", F.trim(declared))
        .when(title != "", F.trim(F.element_at(F.split(title, r"[|\-–]"), 1)))
        .when(heading != "", heading)
    )


def collapsed_text() -> Column:
    """Whole-document text without scripts, styles and templates, whitespace collapsed."""
    runs = F.transform(F.filter("texts", lambda t: t["hidden"].isNull()), lambda t: t["text"])
    return X.collapse_whitespace(F.array_join(runs, " "))


def visible_text() -> Column:
    """The same with the middle of long pages clipped."""
    return X.clip_middle(collapsed_text())


def anchors(scope: Column) -> Column:
    """`(label, href)` of every anchor with an href below the scope."""
    found = F.filter(descendants(scope), lambda e: (e["tag"] == "a") & attr(e, "href").isNotNull())
    return F.transform(found, lambda e: F.struct(joined_text(e).alias("label"), attr(e, "href").alias("href")))


def navigation() -> Column:
    return F.filter(anchors(F.col("nav_scope")), lambda a: (a["label"] != "") & urls.is_nav_href(a["href"]))


def footer() -> Column:
    """Footer links, social links typed by domain, and the copyright line."""
    found = anchors(F.col("footer_scope"))
    social = F.transform(
        F.filter(found, lambda a: urls.social_domain(a["href"]).isNotNull()),
        lambda a: F.struct(F.substring_index(urls.social_domain(a["href"]), ".", 1).alias("platform"), a["href"].alias("url")),
    )
    links = F.filter(found, lambda a: (a["label"] != "") & urls.is_nav_href(a["href"]))
    return F.struct(
        links.alias("links"), social.alias("social_links"), X.copyright_line(spaced_text(F.col("footer_scope"))).alias("copyright_text")
    )


def contact_fallback_text() -> Column:
    parts = F.array(*[F.when(F.col(s).isNotNull(), spaced_text(F.col(s))) for s in ("nav_scope", "footer_scope")])
    return F.array_join(F.array_compact(parts), " ")


def has_password_field() -> Column:
    return F.exists("elements", lambda e: (e["tag"] == "input") & (attr(e, "type") == "password"))


def page_links(base: str = "url") -> Column:
    """Normalised same-origin targets of every crawlable anchor, in order, repeats kept."""
    found = F.filter("elements", lambda e: (e["tag"] == "a") & attr(e, "href").isNotNull())
    hrefs = F.filter(F.transform(found, lambda e: F.trim(attr(e, "href"))), urls.is_crawlable_href)
    absolute = F.transform(hrefs, lambda h: urls.resolve_url(F.col(base), h))
    return F.transform(F.filter(absolute, lambda u: urls.same_origin(F.col(base), u)), urls.normalize_url)


def asset_references(base: str = "url") -> Column:
    """`(url, asset_type)` of images, icons and fonts referenced by a page, images first."""

    def typed(element: Column, name: str, kind: Column) -> Column:
        return F.struct(urls.resolve_url(F.col(base), attr(element, name)).alias("url"), kind.alias("asset_type"))

    images = F.transform(
        F.filter("elements", lambda e: (e["tag"] == "img") & attr(e, "src").isNotNull()), lambda e: typed(e, "src", F.lit("image"))
    )
    links = F.transform(
        F.filter("elements", lambda e: (e["tag"] == "link") & attr(e, "href").isNotNull()), lambda e: typed(e, "href", link_kind(e, base))
    )
    return F.concat(images, F.filter(links, lambda a: a["asset_type"].isNotNull()))


def link_kind(element: Column, base: str) -> Column:
    rel = F.split(F.lower(attr_or_empty(element, "rel")), r"\s+")
    target = F.lower(urls.resolve_url(F.col(base), attr(element, "href")))
    return (
        F.when(F.array_contains(rel, "icon"), "icon")
        .when(F.array_contains(rel, "preload") & (attr(element, "as") == "font"), "font")
        .when(target.rlike(urls.FONT_SUFFIX), "font")
    )


def css_text(stylesheets: str | None = None) -> Column:
    """Style blocks, style attributes and up to five linked stylesheet bodies, one per line."""
    blocks = F.transform(F.filter("elements", by_tag("style")), spaced_text)
    inline = F.transform(F.filter("elements", lambda e: attr(e, "style").isNotNull()), lambda e: attr(e, "style"))
    parts = F.concat(blocks, inline)
    return F.array_join(F.concat(parts, F.col(stylesheets)) if stylesheets else parts, "\n")


def stylesheet_urls(base: str = "url", limit: int = 5) -> Column:
    sheets = F.filter(
        "elements",
        lambda e: (e["tag"] == "link") & attr(e, "href").isNotNull() & F.array_contains(F.split(attr_or_empty(e, "rel"), r"\s+"), "stylesheet"),
    )
    return F.slice(F.transform(sheets, lambda e: urls.resolve_url(F.col(base), attr(e, "href"))), 1, limit)
