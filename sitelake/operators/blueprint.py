"""Whole-page and whole-site documents assembled from the section columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import text as X
from sitelake.functions import urls
from sitelake.operators import elements as E
from sitelake.operators import sections as S

LIST_SECTIONS = tuple(S.BLOCK_ITEM)

# Extractors for self-contained widgets, by section: (elements, texts) columns of a page to an item array.
WIDGETS: dict[str, list[Callable[[], Column]]] = {}


def register_widget(section: str, extract: Callable[[], Column]) -> None:
    """Add a widget extractor; its items are used only where the headings gave the section nothing."""
    if section not in S.ITEM_IDENTITY:
        raise ValueError(f"unknown list section {section}")
    WIDGETS.setdefault(section, []).append(extract)


@contextmanager
def widget(section: str, extract: Callable[[], Column]) -> Iterator[None]:
    """A widget extractor for the blueprints that are built inside the block."""
    register_widget(section, extract)
    try:
        yield
    finally:
        WIDGETS[section].remove(extract)
        if not WIDGETS[section]:
            del WIDGETS[section]


def widget_testimonials() -> Column:
    """Testimonial widgets: quote, author and role from marked descendants."""
    prefix = "elementor-testimonial"

    def part(widget: Column, name: str) -> Column:
        return E.first_element(E.descendants(widget), lambda e: E.has_class(e, f"{prefix}__{name}"))

    widgets = F.filter("elements", lambda e: E.has_class(e, prefix))
    items = F.transform(widgets, lambda w: F.struct(
        E.spaced_text(part(w, "text")).alias("quote"), E.joined_text(part(w, "name")).alias("author"), E.joined_text(part(w, "title")).alias("role"),
    ))
    return F.filter(items, lambda i: i["quote"] != "")


register_widget("testimonials", widget_testimonials)


def with_asset_paths(pages: DataFrame, assets: DataFrame | None, site: Column) -> DataFrame:
    """Add `asset_paths`: reference as written on this page to the stored path of the downloaded asset.

    Only references travel to the assets and back as one small map per page, which is the hashed side of the last join. Pages that are
    bucketed by `page_id` (`sources.pages.bucketed_pages`) stay where they are; others are dealt out by it once. References without
    an asset are absent, so a path is never invented.
    """
    empty = F.create_map().cast("map<string,string>")
    if assets is None:
        return pages.withColumn("asset_paths", empty)
    refs = F.array_distinct(F.filter(F.transform("elements", S.reference), lambda r: r.isNotNull()))
    wanted = pages.select("page_id", "url", site.alias("site"), F.explode(refs).alias("ref")).select(
        "page_id", "ref", "site", urls.resolve_url("url", "ref").alias("original_url")
    )
    # Last record wins for a repeated URL; the map holds one entry per reference of the page.
    stored = assets.groupBy("site", "original_url").agg(F.max_by("storage_path", "seq").alias("storage_path"))
    found = wanted.join(stored, ["site", "original_url"]).groupBy("page_id").agg(
        F.map_from_entries(F.collect_list(F.struct("ref", "storage_path"))).alias("_paths")
    )
    return pages.join(found.hint("shuffle_hash"), "page_id", "left").withColumn("asset_paths", F.coalesce("_paths", empty)).drop("_paths")


def _with_scope_sections(df: DataFrame, blocks: str, prefix: str, gallery: bool, keep_repeats: bool) -> DataFrame:
    """Add `prefix + key` for every section built from the keyed blocks of one scope."""
    b = F.col(blocks)
    single = {f"{prefix}about": S.about(b), f"{prefix}cta_section": S.call_to_action(b), f"{prefix}contact": S.contact(b),
              f"{prefix}additional_sections": S.additional_sections(b, keep_repeats)}
    lists = {f"{prefix}{key}": (S.list_items(b, key), S.item_identity(key)) for key in LIST_SECTIONS}
    lists[f"{prefix}gallery_portfolio"] = (S.gallery(b, gallery), lambda i: i["image"])
    return E.keep_first(E.computed_once(df, single), lists)


SECTION_KEYS = ("about", "cta_section", "contact", *LIST_SECTIONS, "gallery_portfolio", "additional_sections")


def is_empty_section(key: str, section: Column) -> Column:
    if key in ("about", "cta_section"):
        return (section["heading"] == "") & (section["body"] == "")
    if key == "contact":
        return (section["email"] == "") & (section["phone"] == "") & (section["address"] == "")
    return F.size(section) == 0


def fill_empty(primary: dict[str, Column], secondary: dict[str, Column]) -> dict[str, Column]:
    """Secondary fills a section only where the primary is empty; additional sections concatenate."""
    merged = {}
    for key, first in primary.items():
        if key == "additional_sections":
            merged[key] = F.concat(first, secondary[key])
        else:
            merged[key] = F.when(is_empty_section(key, first), secondary[key]).otherwise(first)
    return merged


def page_blueprints(
    pages: DataFrame, assets: DataFrame | None = None, gallery: bool = False, keep_repeats: bool = False
) -> DataFrame:
    """One row per page: `sections` struct, `all_images`, navigation and the columns site assembly needs.

    Shuffle-free apart from the optional asset lookup.
    """
    base = E.with_scopes(with_asset_paths(E.with_elements(pages), assets, urls.authority("url")))
    blocks = S.with_blocks(S.with_blocks(base, "main_scope", "main_blocks"), "footer_scope", "footer_blocks")
    extras = {
        "_title": E.page_title(), "_footer": E.footer(), "navigation": E.navigation(), "_fallback": E.contact_fallback_text(),
        "site_name_guess": E.site_name_guess(), "css_text": E.css_text(), "favicon": favicon(), "logo": logo(), "_images": element_images(),
        **{f"_i_{k}": F.concat(*[w() for w in fns]) for k, fns in WIDGETS.items()},
    }
    # What needs elements and texts is done here: each later step copies its row, and those two are most of it.
    small = E.computed_once(blocks, extras).select("page_id", "url", "main_blocks", "footer_blocks", *extras)
    main = S.with_absorbed(S.with_hero_split(small, "main_blocks"), "body_blocks", "body_keyed")
    foot = main.withColumn("footer_body", F.filter("footer_blocks", lambda b: b["block_no"] > 0))
    foot = S.with_absorbed(foot, "footer_body", "footer_keyed").drop("main_blocks", "footer_blocks", "body_blocks", "footer_body")
    main_sections = _with_scope_sections(foot, "body_keyed", "_m_", gallery, keep_repeats).drop("body_keyed")
    both = _with_scope_sections(main_sections, "footer_keyed", "_f_", gallery, keep_repeats).drop("footer_keyed")
    wide = E.computed_once(both, {"_hero": S.hero(F.col("_title"))}).drop("hero_blocks")
    wide = E.keep_first(wide, {
        "all_images": (F.col("_images"), lambda i: i["path"]), **{f"_w_{k}": (F.col(f"_i_{k}"), S.item_identity(k)) for k in WIDGETS}})
    primary = {k: F.col(f"_m_{k}") for k in SECTION_KEYS}
    for key in WIDGETS:
        primary[key] = F.when(F.size(primary[key]) == 0, F.col(f"_w_{key}")).otherwise(primary[key])
    merged = E.computed_once(wide, {f"_s_{k}": c for k, c in fill_empty(primary, {k: F.col(f"_f_{k}") for k in SECTION_KEYS}).items()})
    reach = F.col("_s_contact")
    filled = reach.withField("email", F.when(reach["email"] == "", X.first_email("_fallback")).otherwise(reach["email"])).withField(
        "phone", F.when(reach["phone"] == "", X.first_phone("_fallback")).otherwise(reach["phone"])
    )
    sections = F.struct(
        F.col("_hero").alias("hero"), F.col("_footer").alias("footer"),
        *[(filled if k == "contact" else F.col(f"_s_{k}")).alias(k) for k in SECTION_KEYS],
    )
    return merged.select(
        "page_id", "url", sections.alias("sections"), "all_images", "navigation", "site_name_guess", "css_text", "favicon", "logo")


def element_images() -> Column:
    """Stored path and alt of every image of a page, repeats kept."""
    images = F.transform(F.filter("elements", E.by_tag("img")), lambda e: F.struct(S.stored_path(e).alias("path"), E.attr_or_empty(e, "alt").alias("alt")))
    return F.filter(images, lambda i: i["path"].isNotNull())


def with_all_images(pages: DataFrame) -> DataFrame:
    """Add `all_images`: every resolved image once per stored path, first alt kept."""
    return E.keep_first(pages, {"all_images": (element_images(), lambda i: i["path"])})


def favicon() -> Column:
    """Stored icon with the largest declared area; the earlier one wins a tie."""
    icons = F.filter("elements", lambda e: (e["tag"] == "link") & E.attr(e, "href").isNotNull() & F.lower(E.attr_or_empty(e, "rel")).contains("icon"))

    def area(sizes: Column) -> Column:
        w, h = (F.regexp_extract(sizes, r"^(\d+)x(\d+)", g).try_cast("long") for g in (1, 2))
        return F.coalesce(w * h, F.lit(0))

    ranked = F.transform(icons, lambda e: F.struct(
        (-area(E.attr_or_empty(e, "sizes"))).alias("rank"), e["node_no"].alias("node_no"),
        S.stored_path(e).alias("path")))
    return F.array_min(F.filter(ranked, lambda r: r["path"].isNotNull()))["path"]


def logo() -> Column:
    """Image that calls itself a logo, else the first header or navigation image; only if stored."""
    images = F.filter("elements", E.by_tag("img"))
    named = F.filter(images, lambda e: F.lower(F.concat_ws(" ", *[E.attr_or_empty(e, a) for a in ("alt", "class", "id", "src")])).contains("logo"))
    named_path = F.try_element_at(F.filter(F.transform(named, S.stored_path), lambda p: p.isNotNull()), F.lit(1))
    top = F.coalesce(E.first_element(F.col("elements"), E.by_tag("header")), E.first_element(F.col("elements"), E.by_tag("nav")))
    return F.coalesce(named_path, S.stored_path(E.first_element(E.descendants(top), E.by_tag("img"))))


def _list(values: Column, render: Callable[[Column], Column]) -> Column:
    return F.transform(values, render)


def _line(condition: Column, text: Column) -> Column:
    """One line when the condition holds, none otherwise."""
    return F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def covered_digest() -> Column:
    """Plain-text lines of everything captured on a page, in a fixed order."""
    s, nav = F.col("sections"), F.col("navigation")
    hero, about, cta, foot, contact = s["hero"], s["about"], s["cta_section"], s["footer"], s["contact"]

    def labels(links: Column) -> Column:
        return F.array_join(F.transform(links, lambda a: a["label"]), ", ")

    has_contact = (contact["email"] != "") | (contact["phone"] != "") | (contact["address"] != "")
    lines = F.concat(
        _line(F.size(nav) > 0, _cat("Nav links: ", labels(nav))),
        _line(hero["headline"] != "", _cat("Hero headline: ", hero["headline"])),
        _line(hero["subheadline"] != "", _cat("Hero subheadline: ", hero["subheadline"])),
        _line(about["body"] != "", _cat("About: ", about["body"])),
        _list(s["services_features"], lambda i: _cat("Service: ", i["title"], " -- ", i["description"])),
        _list(s["faq"], lambda i: _cat("FAQ: ", i["question"], " -- ", i["answer"])),
        _line((cta["body"] != "") | (cta["heading"] != ""), _cat("CTA: ", cta["heading"], " ", cta["body"])),
        _line(foot["copyright_text"] != "", _cat("Footer copyright: ", foot["copyright_text"])),
        _line(F.size(foot["links"]) > 0, _cat("Footer links: ", labels(foot["links"]))),
        _list(s["testimonials"], lambda i: _cat("Testimonial: ", i["quote"], " -- ", i["author"])),
        _list(s["team"], lambda i: _cat("Team: ", i["name"], " -- ", i["bio"])),
        _list(s["pricing"], lambda i: _cat("Pricing: ", i["plan"], " ", i["price"], " ", F.array_join(i["features"], ", "))),
        _list(s["stats_social_proof"], lambda i: _cat("Stat: ", i["number"], " ", i["label"])),
        _list(s["credentials_awards"], lambda i: _cat("Credential: ", i["name"])),
        _line(has_contact, _cat("Contact: ", contact["email"], " ", contact["phone"], " ", contact["address"], " ", contact["hours"])),
        _list(s["blog_news"], lambda i: _cat("Blog: ", i["title"], " -- ", i["excerpt"])),
        _list(s["additional_sections"], lambda i: _cat("Additional (", i["key"], "): ", i["title"], " -- ", i["body"], " ", F.array_join(i["items"], " "))),
    )
    return F.when(F.size(lines) == 0, "(nothing captured yet for this page)").otherwise(F.array_join(lines, "\n"))


def page_summary() -> Column:
    """Short summary of a page, used when its siblings are reviewed."""
    s = F.col("sections")
    lines = F.concat(
        F.array(_cat("Page: ", F.col("url"))),
        _line(s["hero"]["headline"] != "", _cat("Hero: ", s["hero"]["headline"])),
        _line(s["about"]["body"] != "", _cat("About: ", F.left(s["about"]["body"], F.lit(200)))),
        F.array(_cat("Contact info found: ", F.when((s["contact"]["email"] != "") | (s["contact"]["phone"] != ""), "yes").otherwise("no"))),
    )
    return F.array_join(lines, "\n")


def _section(title: str, has: Column, *lines: Column) -> Column:
    body = F.concat(F.array(F.lit(f"### {title}")), *lines, F.array(F.lit("")))
    return F.when(has, body).otherwise(F.array().cast("array<string>"))


def _optional(value: Column, *parts: Column | str) -> Column:
    return F.when(value != "", _cat(*parts)).otherwise("")


def section_lines(s: Column) -> Column:
    """Markdown lines of one page's sections."""
    hero, about, cta, foot, c = s["hero"], s["about"], s["cta_section"], s["footer"], s["contact"]

    def many(key: str, title: str, render: Callable[[Column], Column]) -> Column:
        return _section(title, F.size(s[key]) > 0, F.transform(s[key], render))

    return F.concat(
        _section("Hero", (hero["headline"] != "") | (hero["subheadline"] != ""),
                 _line(hero["headline"] != "", _cat("Headline: ", hero["headline"])),
                 _line(hero["subheadline"] != "", _cat("Subheading: ", hero["subheadline"])),
                 _line(hero["cta_text"] != "", _cat("CTA: ", hero["cta_text"], " (", hero["cta_href"], ")"))),
        _section("About", (about["heading"] != "") | (about["body"] != ""),
                 _line(about["heading"] != "", _cat("**", about["heading"], "**")), _line(about["body"] != "", about["body"])),
        many("services_features", "Services / Features", lambda i: _cat("- **", i["title"], "**", _optional(i["description"], ": ", i["description"]))),
        many("faq", "FAQ", lambda i: _cat("- **", i["question"], "** ", i["answer"])),
        _section("Call To Action", (cta["heading"] != "") | (cta["body"] != ""),
                 _line(cta["heading"] != "", _cat("**", cta["heading"], "**")), _line(cta["body"] != "", cta["body"]),
                 _line(cta["cta_text"] != "", _cat("CTA: ", cta["cta_text"], " (", cta["cta_href"], ")"))),
        many("testimonials", "Testimonials", lambda i: _cat('- "', i["quote"], '"', _optional(i["author"], " -- ", i["author"]))),
        many("team", "Team", lambda i: _cat("- **", i["name"], "**", _optional(i["role"], " (", i["role"], ")"), _optional(i["bio"], ": ", i["bio"]))),
        many("pricing", "Pricing", lambda i: _cat("- **", i["plan"], "**", _optional(i["price"], " (", i["price"], ")"), ": ", F.array_join(i["features"], ", "))),
        many("stats_social_proof", "By The Numbers", lambda i: _cat("- ", i["number"], " ", i["label"])),
        many("credentials_awards", "Credentials / Awards", lambda i: _cat("- ", i["name"])),
        many("blog_news", "Blog / News", lambda i: _cat("- **", i["title"], "**", _optional(i["excerpt"], ": ", i["excerpt"]))),
        _section("Contact", (c["email"] != "") | (c["phone"] != "") | (c["address"] != ""),
                 *[_line(c[k] != "", _cat(f"- {k.title()}: ", c[k])) for k in ("email", "phone", "address", "hours")]),
        many("gallery_portfolio", "Gallery", lambda i: F.when(i["caption"] != "", _cat("- ", i["caption"])).otherwise("- (image, no caption)")),
        F.flatten(F.transform(s["additional_sections"], lambda x: F.concat(
            F.array(_cat("### ", x["title"])), _line(x["body"] != "", x["body"]), F.transform(x["items"], lambda i: _cat("- ", i)), F.array(F.lit(""))))),
        _section("Footer", (F.size(foot["links"]) > 0) | (F.size(foot["social_links"]) > 0) | (foot["copyright_text"] != ""),
                 F.transform(foot["links"], lambda a: _cat("- ", a["label"], " (", a["href"], ")")),
                 F.transform(foot["social_links"], lambda a: _cat("- ", a["platform"], ": ", a["url"])),
                 _line(foot["copyright_text"] != "", foot["copyright_text"])),
    )


# Fixed values.
DEFAULT_SITE_NAME = "Untitled Business"
DEFAULT_FONTS = {"heading": "Inter", "body": "Inter"}
_PLAIN_SCALAR = r"^(?!(?i:y|n|yes|no|on|off|true|false|null)$)[A-Za-z](?:[A-Za-z0-9 _./()&+\-]*[A-Za-z0-9_./()&+\-])?$"


def yaml_scalar(value: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(value.isNull(), "null").when(value.rlike(_PLAIN_SCALAR), value).otherwise(quoted)


def design_document() -> Column:
    """Front matter and markdown of a site row (`meta`, `navigation`, `pages`)."""
    meta, nav = F.col("meta"), F.col("navigation")
    front = F.concat(
        F.array(
            _cat("site_name: ", yaml_scalar(meta["site_name"])), F.lit("colors:"),
            *[_cat(f"  {k}: ", yaml_scalar(meta["colors"][k])) for k in ("primary", "secondary", "accent")],
            _cat("logo: ", yaml_scalar(meta["logo"])), F.lit("fonts:"),
            *[_cat(f"  {k}: ", yaml_scalar(meta["fonts"][k])) for k in ("heading", "body")],
        ),
        *[_line(meta[k] != "", _cat(f"{k}: ", yaml_scalar(meta[k]))) for k in ("tone", "tagline")],
    )
    menu = F.when(F.size(nav) > 0, F.concat(
        F.array(F.lit("## Navigation")), F.transform(nav, lambda a: _cat("- ", a["label"], " (", a["href"], ")")), F.array(F.lit(""))
    )).otherwise(F.array().cast("array<string>"))
    body = F.flatten(F.transform("pages", lambda p, i: F.concat(
        F.array(_cat("## ", F.when(i == 0, "Home Page").otherwise(p["page_url"]))), section_lines(p["sections"]))))
    text = F.regexp_replace(F.array_join(F.concat(menu, body), "\n"), r"^\s+|\s+$", "")
    return _cat("---\n", F.array_join(front, "\n"), "\n---\n\n", text, "\n")


def site_blueprints(pages: DataFrame, palettes: DataFrame, assets: DataFrame | None = None, part_pages: int = 20) -> DataFrame:
    """One document per site, or part of `part_pages` pages of a larger one: meta of the home page, its navigation, pages in order.

    `pages` is `page_blueprints` with `site` and `page_no`. Every part carries the meta and navigation of the site.
    """
    from sitelake.operators.linkgraph import with_part

    kept = with_part(pages, part_pages)
    entry = F.struct("page_no", F.col("url").alias("page_url"), "sections", "all_images")
    home = F.struct("site_name_guess", "navigation", "logo", "favicon")
    grouped = kept.groupBy("site", "part").agg(F.array_sort(F.collect_list(F.col("page_no"))).alias("_order"),
                                               F.map_from_entries(F.collect_list(F.struct(F.col("page_no"), entry))).alias("_by_no"))
    homes = kept.groupBy("site").agg(F.min_by(home, "page_no").alias("h"))
    colored = grouped.join(homes, "site").join(palettes.select("site", "colors"), "site", "left")
    logo = F.col("h.logo")
    if assets is not None:
        images = assets.filter("asset_type = 'image'").groupBy("site").agg(F.min_by("storage_path", "seq").alias("_first_image"))
        colored = colored.join(images, "site", "left")
        logo = F.coalesce(logo, "_first_image")
    meta = F.struct(
        F.when(F.coalesce("h.site_name_guess", F.lit("")) != "", F.col("h.site_name_guess")).otherwise(DEFAULT_SITE_NAME).alias("site_name"),
        F.lit("").alias("tagline"), logo.alias("logo"), F.col("colors"), F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_FONTS.items()]).alias("fonts"),
        F.lit("").alias("tone"), F.col("h.favicon").alias("favicon"), F.lit("").alias("site_category"),
    )
    ordered = F.transform("_order", lambda n: F.element_at(F.col("_by_no"), n))
    return colored.select("site", "part", meta.alias("meta"), F.col("h.navigation").alias("navigation"), ordered.alias("pages"))
