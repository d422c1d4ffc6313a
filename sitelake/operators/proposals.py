"""Reviewed content merged under fixed rules: proposals are a table, nothing they invent gets through."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import text as X
from sitelake.operators.skew import first_n_per_key

# Fixed values.
GAPS_PER_PAGE = 5
QUOTE_LENGTH = (15, 600)
PROPOSAL = (
    "page_url string, hero struct<headline:string,subheadline:string,cta_text:string,cta_href:string>, about struct<heading:string,body:string>, "
    "services array<struct<title:string,description:string>>, faq array<struct<question:string,answer:string>>, "
    "cta struct<heading:string,body:string,cta_text:string,cta_href:string>, "
    "additional array<struct<key:string,title:string,body:string,items:array<string>>>"
)
GAP_PROPOSAL = "page_url string, pos int, quote string, title string, category string"


def prefer(proposed: Column, base: Column) -> Column:
    """A non-empty proposal wins, otherwise the base stays."""
    return F.coalesce(F.when(proposed != "", proposed), base)


def merge_fields(base: DataFrame, proposals: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Merge the allow-listed text columns; every other column keeps the base."""
    offered = proposals.select(key, *[F.col(f).alias(f"_p_{f}") for f in fields])
    joined = base.join(offered, key, "left")
    return joined.withColumns({f: prefer(F.col(f"_p_{f}"), F.col(f)) for f in fields}).drop(*[f"_p_{f}" for f in fields])


def replace_list(proposed: Column, base: Column) -> Column:
    """No list keeps the base; an empty list drops everything; any other list replaces it."""
    return F.when(proposed.isNull(), base).otherwise(proposed)


def carry_icons(services: Column, base: Column) -> Column:
    """Proposed services with the icon of the base item of the same title (the last one), else of the same
    position when the count is unchanged."""

    def icon(item: Column, i: Column) -> Column:
        same = F.filter(base, lambda b: F.lower(F.trim(b["title"])) == F.lower(F.trim(item["title"])))
        by_title = F.try_element_at(same, F.lit(-1))["icon_image"]
        by_place = F.when(F.size(services) == F.size(base), F.try_element_at(base, i + 1)["icon_image"])
        return F.coalesce(by_title, by_place)

    return F.transform(services, lambda s, i: F.struct(
        F.coalesce(s["title"], F.lit("")).alias("title"), F.coalesce(s["description"], F.lit("")).alias("description"), icon(s, i).alias("icon_image")))


def known_sections(proposed: Column, base: Column) -> Column:
    """Proposed additional sections whose key exists in the base; images always come from the base."""

    def original(item: Column) -> Column:
        return F.try_element_at(F.filter(base, lambda b: b["key"] == item["key"]), F.lit(-1))

    kept = F.filter(proposed, lambda p: F.exists(base, lambda b: b["key"] == p["key"]))
    return F.transform(kept, lambda p: F.struct(
        p["key"].alias("key"), prefer(p["title"], original(p)["title"]).alias("title"), F.coalesce(p["body"], F.lit("")).alias("body"),
        F.coalesce(p["items"], F.array().cast("array<string>")).alias("items"), original(p)["images"].alias("images")))


def invented_sections(proposed: Column, base: Column) -> Column:
    """Keys offered without a base section, for the audit."""
    return F.transform(F.filter(proposed, lambda p: ~F.exists(base, lambda b: b["key"] == p["key"])), lambda p: p["key"])


def merge_reviews(pages: DataFrame, proposals: DataFrame) -> DataFrame:
    """Apply `PROPOSAL` rows to page blueprints (`url`, `sections`): five reviewed sections, all else untouched."""
    offered = proposals.select(F.col("page_url").alias("url"), F.struct("hero", "about", "services", "faq", "cta", "additional").alias("_p"))
    joined = pages.join(offered, "url", "left")
    s, p = F.col("sections"), F.col("_p")

    def texts(base: Column, proposed: Column, fields: Sequence[str]) -> Column:
        for f in fields:
            base = base.withField(f, prefer(proposed[f], base[f]))
        return base

    links = ("cta_text", "cta_href")
    merged = (
        s.withField("hero", texts(s["hero"], p["hero"], ("headline", "subheadline", *links)))
        .withField("about", texts(s["about"], p["about"], ("heading", "body")))
        .withField("cta_section", texts(s["cta_section"], p["cta"], ("heading", "body", *links)))
        .withField("services_features", F.when(p["services"].isNull(), s["services_features"]).otherwise(carry_icons(p["services"], s["services_features"])))
        .withField("faq", replace_list(p["faq"], s["faq"]))
        .withField("additional_sections", F.when(p["additional"].isNull(), s["additional_sections"]).otherwise(
            known_sections(p["additional"], s["additional_sections"])))
    )
    return joined.withColumn("sections", merged).drop("_p")


def verified_gaps(gaps: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """First five gap proposals per page whose quote really occurs in that page's text.

    The limit comes before the check, as in the reference, and bounds what each page sends into the join.
    """
    first = first_n_per_key(gaps, [key], [F.col("pos")], GAPS_PER_PAGE).drop("rank")
    quoted = first.withColumn("body", X.collapse_whitespace("quote"))
    sized = quoted.filter(F.length("body").between(*QUOTE_LENGTH))
    checked = sized.join(texts.select(key, "text"), key).filter(F.contains("text", "body"))
    title = F.trim(F.when(F.coalesce("title", F.lit("")) == "", "Additional Content").otherwise(F.col("title")))
    category = F.trim(F.coalesce("category", F.lit("")))
    shown = F.when(category != "", F.concat(title, F.lit(" ("), category, F.lit(")"))).otherwise(title)
    return checked.select(key, "pos", title.alias("label"), shown.alias("title"), "body")


def unique_gap_keys(gaps: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Give each verified gap a key of its own: `gap-` and slug, numbered from 2 past every key in use.

    A page has at most five gaps here, so the ordered fold works on a tiny list; `existing` has one `keys`
    array per page.
    """
    listed = gaps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("gap-"), X.slugify("label")).alias("base")))).alias("g"))
    joined = listed.join(existing.select(key, "keys"), key, "left")
    used = F.coalesce("keys", F.array().cast("array<string>"))
    seed = F.struct(used.alias("used"), F.array().cast("array<struct<pos:bigint,key:string>>").alias("out"))

    def step(acc, gap):
        tries = F.transform(F.sequence(F.lit(1), F.size(acc["used"]) + 1), lambda i: F.when(i == 1, gap["base"]).otherwise(
            F.concat(gap["base"], F.lit("-"), i.cast("string"))))
        free = F.element_at(F.filter(tries, lambda t: ~F.array_contains(acc["used"], t)), 1)
        return F.struct(
            F.concat(acc["used"], F.array(free)).alias("used"),
            F.concat(acc["out"], F.array(F.struct(gap["pos"].cast("long").alias("pos"), free.alias("key")))).alias("out"))

    return joined.select(key, F.inline(F.aggregate("g", seed, step)["out"]))


def append_sections(existing: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """Existing rows followed by the verified ones, with the order made explicit."""
    return existing.withColumn("source_order", F.lit(0)).unionByName(added.withColumn("source_order", F.lit(1)))


def pages_in_order(pages: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Only the listed page positions, numbered in list order."""
    wanted = F.array_position(F.array(*[F.lit(i) for i in indices]), F.col("page_no"))
    return pages.filter(F.col("page_no").isin(*indices)).withColumn("place", wanted)
