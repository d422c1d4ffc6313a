"""Heading blocks and typed sections of a page, as columns over its element arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import text as X
from sitelake.functions import urls
from sitelake.operators import elements as E

# Checked in this order, first match wins.
SECTION_KEYWORDS = {
    "about": ("about", "who we are", "our story", "our mission", "why choose us"),
    "services_features": ("service", "feature", "what we do", "solution", "offering"),
    "faq": ("faq", "frequently asked", "question"),
    "cta_section": ("get started", "ready to", "book now", "sign up", "join us"),
    "testimonials": ("testimonial", "review", "what our client", "customer stor"),
    "team": ("team", "our staff", "meet the", "founder"),
    "pricing": ("pricing", "plans", "package"),
    "stats_social_proof": ("by the numbers", "years of experience", "clients served"),
    "credentials_awards": ("award", "certified", "accredited", "as seen in", "partner"),
    "blog_news": ("blog", "news", "latest", "article"),
    "gallery_portfolio": ("gallery", "portfolio", "our work", "project"),
    "contact": ("contact", "get in touch", "visit us", "location"),
}
HERO_WORDS = ("hero", "banner", "jumbotron")
BUTTON_WORDS = ("btn", "button", "cta")
FROM_TEXT_SECTIONS = ("services_features", "faq")
MIN_LEAF_WORDS = 5


def _any_word(haystack: Column, words: tuple[str, ...]) -> Column:
    match = F.lit(False)
    for word in words:
        match = match | haystack.contains(word)
    return match


def _paragraphs(block_elements: Column) -> Column:
    """`p` texts first, then prose in childless div/span of at least five words; both in page order."""
    paragraphs = F.filter(F.transform(F.filter(block_elements, E.by_tag("p")), E.spaced_text), lambda t: t != "")
    leaves = F.transform(F.filter(block_elements, lambda e: e["tag"].isin("div", "span") & (e["child_count"] == 0)), E.spaced_text)
    prose = F.filter(leaves, lambda t: (t != "") & (F.size(F.split(t, r"(?U)\s+")) >= MIN_LEAF_WORDS))
    return F.concat(paragraphs, prose)


def _links(block_elements: Column) -> Column:
    return F.transform(
        F.filter(block_elements, E.by_tag("a")),
        lambda e: F.struct(
            E.joined_text(e).alias("label"), E.attr_or_empty(e, "href").alias("href"),
            _any_word(F.lower(F.concat_ws(" ", E.attr_or_empty(e, "class"), E.attr_or_empty(e, "id"))), BUTTON_WORDS).alias("styled"),
        ),
    )


def reference(element: Column) -> Column:
    """Asset reference of an image or link element as written; null for other elements and empty values."""
    raw = F.when(element["tag"] == "img", E.attr(element, "src")).when(element["tag"] == "link", E.attr(element, "href"))
    return F.when(raw != "", raw)


def stored_path(element: Column) -> Column:
    return F.try_element_at(F.col("asset_paths"), reference(element))


def _images(block_elements: Column) -> Column:
    return F.transform(
        F.filter(block_elements, E.by_tag("img")),
        lambda e: F.struct(
            E.attr_or_empty(e, "alt").alias("alt"),
            stored_path(e).alias("path"),
        ),
    )


def with_blocks(pages: DataFrame, scope: str, name: str) -> DataFrame:
    """Add `name`: heading-anchored blocks below a scope; block 0 is what precedes the first heading.

    Needs `url`, `elements`, `texts`, `asset_paths` and the scope column.
    """
    heads, cuts = f"_{name}_heads", f"_{name}_cuts"
    span = F.col(scope)
    found = E.computed_once(pages, {heads: F.filter(E.descendants(span), E.by_tag("h1", "h2", "h3"))})
    count = F.size(F.col(heads))

    def cut(k: Column) -> Column:
        head = F.try_element_at(F.col(heads), F.when(k > 0, k))
        start = F.when(k == 0, F.coalesce(span["node_no"], F.lit(0))).otherwise(head["node_no"]) + 1
        end = F.when(k == count, F.coalesce(span["end_no"], F.lit(0))).otherwise(F.try_element_at(F.col(heads), k + 1)["node_no"] - 1)
        return F.struct(k.alias("block_no"), head.alias("head"), F.slice(F.col("elements"), start, F.greatest(end - start + 1, F.lit(0))).alias("els"))

    sliced = E.computed_once(found, {cuts: F.transform(F.sequence(F.lit(0), count), cut)})
    blocks = F.transform(
        F.col(cuts),
        lambda c: F.struct(
            c["block_no"].alias("block_no"),
            F.when(c["block_no"] > 0, E.joined_text(c["head"])).alias("heading"),
            F.substring(c["head"]["tag"], 2, 1).cast("int").alias("level"),
            F.lower(F.concat_ws(" ", E.joined_text(c["head"]), c["head"]["parent_key"])).alias("haystack"),
            _paragraphs(c["els"]).alias("paragraphs"),
            F.filter(F.transform(F.filter(c["els"], E.by_tag("li")), E.spaced_text), lambda t: t != "").alias("items"),
            _links(c["els"]).alias("links"),
            _images(c["els"]).alias("images"),
        ),
    )
    return E.computed_once(sliced, {name: blocks}).drop(heads, cuts)


def section_key(block: Column) -> Column:
    """First section whose keywords occur in the haystack; a call to action holding contact data is a contact."""
    key = F.coalesce(*[F.when(_any_word(block["haystack"], words), F.lit(k)) for k, words in SECTION_KEYWORDS.items()])
    body = F.array_join(block["paragraphs"], " ")
    is_contact = (X.first_email(body) != "") | (X.first_phone(body) != "")
    return F.when((key == "cta_section") & is_contact, "contact").otherwise(key)


def looks_like_hero(block: Column, no_h1: Column) -> Column:
    return (block["level"] == 1) | no_h1 | _any_word(block["haystack"], HERO_WORDS)


def with_hero_split(pages: DataFrame, blocks: str) -> DataFrame:
    """Add `hero_blocks` and `body_blocks`: the opening block, plus the first heading when it is the hero."""
    all_blocks = F.col(blocks)
    headed = F.filter(all_blocks, lambda b: b["block_no"] > 0)
    no_h1 = ~F.exists(headed, lambda b: b["level"] == 1)
    first = F.try_element_at(headed, F.lit(1))
    taken = F.when(first.isNotNull() & looks_like_hero(first, no_h1), F.lit(1)).otherwise(F.lit(0))
    split = E.computed_once(pages, {"_hero_count": taken})
    return E.computed_once(split, {
        "hero_blocks": F.filter(all_blocks, lambda b: b["block_no"] <= F.col("_hero_count")),
        "body_blocks": F.filter(all_blocks, lambda b: b["block_no"] > F.col("_hero_count")),
    }).drop("_hero_count")


def with_absorbed(pages: DataFrame, blocks: str, name: str) -> DataFrame:
    """Add `name`: blocks with their section and parent. A classified block takes the deeper unclassified
    blocks right after it, until a classified block or one at its own level or above."""
    keyed, parents = f"_{name}_keyed", f"_{name}_parents"
    classified = E.computed_once(pages, {
        keyed: F.transform(blocks, lambda b: b.withField("section", F.when(b["block_no"] > 0, section_key(b))))
    })
    seed = F.struct(F.lit(None).cast("int").alias("parent"), F.lit(None).cast("int").alias("level"), F.array().cast("array<int>").alias("parents"))

    def step(acc, b):
        inside = b["section"].isNull() & acc["parent"].isNotNull() & (b["level"] > acc["level"])
        opens = b["section"].isNotNull()
        return F.struct(
            F.when(opens, b["block_no"]).when(inside, acc["parent"]).alias("parent"),
            F.when(opens, b["level"]).when(inside, acc["level"]).alias("level"),
            F.concat(acc["parents"], F.array(F.when(inside, acc["parent"]))).alias("parents"),
        )

    traced = E.computed_once(classified, {parents: F.aggregate(keyed, seed, step)["parents"]})
    zipped = F.zip_with(keyed, parents, lambda b, p: b.withField("parent", p))
    return E.computed_once(traced, {name: zipped}).drop(keyed, parents)


def button_link(links: Column) -> Column:
    """Best call to action: the first usable link styled as a button, else the first usable link."""
    usable = F.filter(links, lambda a: urls.is_action_href(a["href"]))
    return F.coalesce(E.first_element(usable, lambda a: a["styled"]), F.try_element_at(usable, F.lit(1)))


def _first_path(images: Column) -> Column:
    return F.try_element_at(images, F.lit(1))["path"]


def _body(block: Column) -> Column:
    return F.array_join(block["paragraphs"], " ")


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def hero(title: Column | None = None) -> Column:
    """Headline and so on of the hero blocks; the title of the page stands in for a missing headline."""
    blocks = F.col("hero_blocks")
    headings = F.filter(F.transform(blocks, lambda b: b["heading"]), lambda h: h.isNotNull() & (h != ""))
    paragraphs = F.flatten(F.transform(blocks, lambda b: b["paragraphs"]))
    cta = button_link(F.flatten(F.transform(blocks, lambda b: b["links"])))
    images = F.flatten(F.transform(blocks, lambda b: b["images"]))
    return F.struct(
        F.coalesce(F.try_element_at(headings, F.lit(1)), E.page_title() if title is None else title).alias("headline"),
        _or_empty(F.try_element_at(paragraphs, F.lit(1))).alias("subheadline"),
        _or_empty(cta["label"]).alias("cta_text"), _or_empty(cta["href"]).alias("cta_href"), _first_path(images).alias("background_image"),
    )


def _entries(blocks: Column, key: str) -> Column:
    return F.filter(blocks, lambda b: b["section"] == key)


def _children(blocks: Column, parent: Column) -> Column:
    return F.filter(blocks, lambda b: b["parent"] == parent["block_no"])


def about(blocks: Column) -> Column:
    entry = F.try_element_at(_entries(blocks, "about"), F.lit(1))
    family = F.concat(F.array(entry), _children(blocks, entry))
    own, all_images = entry["images"], F.flatten(F.transform(family, lambda b: b["images"]))
    return F.struct(
        _or_empty(entry["heading"]).alias("heading"),
        F.when(entry.isNull(), F.lit("")).otherwise(F.array_join(F.flatten(F.transform(family, lambda b: b["paragraphs"])), " ")).alias("body"),
        F.when(F.size(own) > 0, _first_path(own)).otherwise(_first_path(all_images)).alias("image"),
    )


def call_to_action(blocks: Column) -> Column:
    entry = F.try_element_at(_entries(blocks, "cta_section"), F.lit(1))
    link = button_link(entry["links"])
    return F.struct(
        _or_empty(entry["heading"]).alias("heading"), _or_empty(_body(entry)).alias("body"),
        _or_empty(link["label"]).alias("cta_text"), _or_empty(link["href"]).alias("cta_href"),
    )


def contact(blocks: Column) -> Column:
    entry = F.try_element_at(_entries(blocks, "contact"), F.lit(1))
    family = F.concat(F.array(entry), _children(blocks, entry))
    words = F.array_join(F.flatten(F.transform(family, lambda b: b["paragraphs"])), " ")
    return F.struct(
        F.lit("").alias("address"), _or_empty(X.first_email(words)).alias("email"), _or_empty(X.first_phone(words)).alias("phone"),
        F.lit("").alias("hours"),
    )


def _service(title: Column, body: Column, image: Column) -> Column:
    return F.struct(title.alias("title"), body.alias("description"), image.alias("icon_image"))


def _question(question: Column, answer: Column) -> Column:
    return F.struct(question.alias("question"), answer.alias("answer"))


def _title(b: Column) -> Column:
    return _or_empty(b["heading"])


# Item built from a whole block, by section.
BLOCK_ITEM: dict[str, Callable[[Column], Column]] = {
    "services_features": lambda b: _service(_title(b), _body(b), _first_path(b["images"])),
    "faq": lambda b: _question(_title(b), _body(b)),
    "testimonials": lambda b: F.struct(
        F.when(_body(b) != "", _body(b)).otherwise(_title(b)).alias("quote"), F.lit("").alias("author"), F.lit("").alias("role")),
    "team": lambda b: F.struct(_title(b).alias("name"), F.lit("").alias("role"), _body(b).alias("bio"), _first_path(b["images"]).alias("photo")),
    "pricing": lambda b: F.struct(_title(b).alias("plan"), F.lit("").alias("price"), b["items"].alias("features")),
    "stats_social_proof": lambda b: F.struct(_title(b).alias("number"), _body(b).alias("label")),
    "credentials_awards": lambda b: F.struct(_title(b).alias("name"), _first_path(b["images"]).alias("badge_image")),
    "blog_news": lambda b: F.struct(_title(b).alias("title"), _body(b).alias("excerpt"), F.lit("").alias("date")),
}
TEXT_ITEM: dict[str, Callable[[Column], Column]] = {
    "services_features": lambda t: _service(F.left(t, F.lit(60)), t, F.lit(None).cast("string")),
    "faq": lambda t: _question(X.split_question(t)["question"], X.split_question(t)["answer"]),
}
# Fields that identify an item: all but the image ones.
ITEM_IDENTITY: dict[str, tuple[str, ...]] = {
    "services_features": ("title", "description"), "faq": ("question", "answer"), "testimonials": ("quote", "author", "role"),
    "team": ("name", "role", "bio"), "pricing": ("plan", "price", "features"), "stats_social_proof": ("number", "label"),
    "credentials_awards": ("name",), "blog_news": ("title", "excerpt", "date"),
}


def item_identity(section: str) -> Callable[[Column], Column]:
    """Identity of a list item: its non-image fields, trimmed and lower-cased."""
    return lambda item: F.concat_ws("\u0001", *[F.lower(F.trim(item[f].cast("string"))) for f in ITEM_IDENTITY[section]])


def list_items(blocks: Column, section: str) -> Column:
    """Items of a list section: child blocks, else its list entries, else (mandatory sections) the block itself."""
    from_block = BLOCK_ITEM[section]

    def of(entry: Column) -> Column:
        children = _children(blocks, entry)
        nested = F.transform(children, from_block)
        if section not in FROM_TEXT_SECTIONS:
            return nested
        own = F.when(F.size(entry["items"]) > 0, F.transform(entry["items"], TEXT_ITEM[section])).otherwise(F.array(from_block(entry)))
        return F.when(F.size(children) > 0, nested).otherwise(own)

    return F.flatten(F.transform(_entries(blocks, section), of))


def additional_sections(blocks: Column, keep_repeats: bool = False) -> Column:
    """Headed blocks that are neither classified nor absorbed and hold any content.

    With `keep_repeats`, second and later about, call-to-action and contact blocks are kept here too.
    """
    loose = F.filter(blocks, lambda b: b["section"].isNull() & b["parent"].isNull() & (F.coalesce(b["heading"], F.lit("")) != ""))
    if keep_repeats:
        single = ("about", "cta_section", "contact")
        later = F.filter(blocks, lambda b: b["section"].isin(*single) & (
            F.array_position(F.transform(blocks, lambda o: F.coalesce(o["section"], F.lit(""))), b["section"]) - 1
            + F.try_element_at(blocks, F.lit(1))["block_no"] < b["block_no"]))
        loose = F.array_sort(F.concat(loose, later), lambda a, b: a["block_no"] - b["block_no"])
    full = F.filter(loose, lambda b: (F.size(b["paragraphs"]) > 0) | (F.size(b["items"]) > 0) | F.exists(b["images"], lambda i: i["path"].isNotNull()))
    return F.transform(full, lambda b: F.struct(
        X.slugify(b["heading"]).alias("key"), b["heading"].alias("title"), _body(b).alias("body"), b["items"].alias("items"),
        F.filter(F.transform(b["images"], lambda i: i["path"]), lambda p: p.isNotNull()).alias("images"),
    ))


def gallery(blocks: Column, collect: bool = True) -> Column:
    """Images of gallery blocks and their children, repeats kept; `collect=False` leaves it empty, as the reference does."""
    entries = _entries(blocks, "gallery_portfolio")
    images = F.flatten(F.transform(entries, lambda e: F.flatten(F.transform(F.concat(F.array(e), _children(blocks, e)), lambda b: b["images"]))))
    found = F.filter(images, lambda i: i["path"].isNotNull() & F.lit(collect))
    return F.transform(found, lambda i: F.struct(i["path"].alias("image"), i["alt"].alias("caption")))
