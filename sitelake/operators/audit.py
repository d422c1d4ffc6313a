"""Quality audits of generated sites: alt texts, share tags, hidden classes and reveal gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import text as X
from sitelake.operators import elements as E
from sitelake.operators.skew import running_sums

# Fixed values.
HIDDEN_DECLARATION = r"opacity\s*:\s*0(?:\.0*)?\s*;|visibility\s*:\s*hidden\s*;"
SIMPLE_CLASS_RULE = r"(?<![.\w-])\.([A-Za-z0-9_-]+)\s*\{([^{}]*)\}"
SCRIPT_EVENT = (
    r"""classList\.(?:add|toggle)\(\s*['"]([A-Za-z0-9_-]+)['"]|querySelector(?:All)?\(\s*['"]\.([A-Za-z0-9_-]+)"""
)
REACH = 3000
OVERRIDE = "{opacity:1 !important;visibility:visible !important;transform:none !important}"


def missing_alt(pages: DataFrame) -> DataFrame:
    """Images without a usable alt text and the text to use instead. Needs `elements`."""
    bad = F.filter("elements", lambda e: (e["tag"] == "img") & (F.trim(E.attr_or_empty(e, "alt")) == ""))
    rows = pages.select("page_id", F.posexplode(bad).alias("pos", "e"))
    src = E.attr_or_empty(F.col("e"), "src")
    return rows.select("page_id", "pos", src.alias("src"), X.fallback_alt_text(src).alias("alt"))


def share_tags(file: Column, site_name: Column, logo: Column) -> Column:
    """Share tags a page lacks: nothing when it has no head or already names a share title; blanks are skipped."""
    elements = F.col("elements")
    has_head = F.exists(elements, lambda e: e["tag"] == "head")
    has_title = F.exists(elements, lambda e: (e["tag"] == "meta") & (E.attr_or_empty(e, "property") == "og:title"))
    title_tag = E.first_element(elements, E.by_tag("title"))
    title = F.when(title_tag.isNotNull(), E.joined_text(title_tag)).otherwise(F.coalesce(site_name, F.lit("")))
    description = F.coalesce(E.meta_content("name", "description"), F.lit(""))
    image = F.when(F.coalesce(logo, F.lit("")) != "", F.concat(F.lit("images/"), F.element_at(F.split(logo, "/"), -1))).otherwise("")
    tags = [("og:type", F.lit("website")), ("og:title", title), ("og:description", description), ("og:image", image), ("og:url", file)]
    wanted = F.array(*[F.struct(F.lit(name).alias("property"), value.alias("content")) for name, value in tags])
    none = F.array().cast("array<struct<property:string,content:string>>")
    return F.when(has_head & ~has_title, F.filter(wanted, lambda t: t["content"] != "")).otherwise(none)


def hidden_classes(css_files: DataFrame) -> DataFrame:
    """Classes that a standalone rule hides, per style file."""
    names, bodies = (F.regexp_extract_all("body", F.lit(SIMPLE_CLASS_RULE), F.lit(g)) for g in (1, 2))
    rules = F.filter(F.arrays_zip(names.alias("name"), bodies.alias("rule")), lambda r: r["rule"].rlike(HIDDEN_DECLARATION))
    classes = F.array_distinct(F.transform(rules, lambda r: r["name"]))
    return css_files.select("site", "file", F.explode(classes).alias("hidden"))


def _events(body: Column) -> Column:
    """`(at, added, queried)` of every class event in a script; offsets come from the text between matches."""
    added, queried = (F.regexp_extract_all(body, F.lit(SCRIPT_EVENT), F.lit(g)) for g in (1, 2))
    matches = F.regexp_extract_all(body, F.lit(SCRIPT_EVENT), F.lit(0))
    gaps = F.transform(F.split(body, SCRIPT_EVENT, -1), F.length)
    hits = F.arrays_zip(F.transform(matches, F.length).alias("len"), F.slice(gaps, 1, F.size(matches)).alias("gap"), added.alias("added"), queried.alias("queried"))
    event = "array<struct<at:int,added:string,queried:string>>"
    seed = F.struct(F.lit(0).alias("at"), F.array().cast(event).alias("out"))

    def step(acc, hit):
        at = acc["at"] + hit["gap"]
        return F.struct(
            (at + hit["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(at.alias("at"), hit["added"].alias("added"), hit["queried"].alias("queried")))).alias("out"),
        )

    return F.aggregate(hits, seed, step)["out"]


def name_slice(column: str) -> Column:
    """Slice of a file name, not decreasing in name order: its first eight letters. Numbered names spread over their upper digits."""
    return F.substring(column, 1, 8)


def script_events(scripts: DataFrame) -> DataFrame:
    """Class events with their offset in the site's scripts joined in file order."""
    sized = scripts.withColumn("_size", F.length("body") + 1)
    # Names slice the running offset, so a site with very many scripts is no single group.
    placed = running_sums(sized, ["site"], ["file"], {"_end": F.col("_size")}, name_slice("file"))
    rows = placed.select("site", (F.col("_end") - F.col("_size")).alias("base"), F.explode(_events(F.col("body"))).alias("e"))
    return rows.select("site", (F.col("base") + F.col("e.at")).alias("at"), "e.added", "e.queried")


def reveal_pairs(scripts: DataFrame, hidden: DataFrame) -> DataFrame:
    """Each added class with the nearest hidden class queried at most 3000 characters before it.

    A bounded as-of join: both sides meet on the offset range, so a row only meets the few events that fit
    into two ranges of script text.
    """
    events = script_events(scripts)
    queries = events.filter("queried <> ''").select("site", F.col("queried").alias("hidden"), F.col("at").alias("q_at")).join(hidden, ["site", "hidden"])
    reach = queries.withColumn("range", F.explode(F.array(F.floor(F.col("q_at") / REACH), F.floor(F.col("q_at") / REACH) + 1)))
    adds = events.filter("added <> ''").select("site", "added", "at", F.floor(F.col("at") / REACH).alias("range"))
    near = adds.join(reach, ["site", "range"]).filter((F.col("q_at") < F.col("at")) & (F.col("at") - F.col("q_at") <= REACH))
    best = near.groupBy("site", "file", "at", "added").agg(F.max_by("hidden", "q_at").alias("hidden"))
    return best.filter("hidden <> added").select("site", "file", "hidden", F.col("added").alias("reveal")).distinct()


def reveal_gaps(pairs: DataFrame, css_files: DataFrame) -> DataFrame:
    """Pairs no selector of their style file combines, with the rule that closes the gap."""
    selectors = css_files.select("site", "file", F.regexp_extract_all("body", F.lit(r"([^{}]+)\{"), F.lit(1)).alias("selectors"))
    a, b = F.concat(F.lit("."), "hidden"), F.concat(F.lit("."), "reveal")
    open_pairs = pairs.join(selectors, ["site", "file"]).filter(~F.exists("selectors", lambda s: s.contains(a) & s.contains(b)))
    return open_pairs.select("site", "file", "hidden", "reveal", F.concat(a, b, F.lit(OVERRIDE)).alias("fix"))


def audit_report(pages: DataFrame, gaps: DataFrame, palettes: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Per site: images without alt, pages without share tags, low-contrast pairs and reveal fixes.

    `pages` carries `site`, `file` and `elements`; `palettes` carries `site` and `warnings`; `sitemaps` the sites that have one.
    """
    per_page = pages.select(
        "site",
        F.size(F.filter("elements", lambda e: (e["tag"] == "img") & (F.trim(E.attr_or_empty(e, "alt")) == ""))).alias("no_alt"),
        (F.size(share_tags(F.col("file"), F.lit(""), F.lit(""))) > 0).alias("no_tags"),
    )
    counts = per_page.groupBy("site").agg(F.count("*").alias("files"), F.sum("no_alt").alias("alt_added"), F.count_if("no_tags").alias("tags_added"))
    fixes = gaps.groupBy("site").agg(F.count("*").alias("reveal_fixes"))
    joined = counts.join(fixes, "site", "left").join(palettes.select("site", F.size("warnings").alias("contrast_warnings")), "site", "left")
    joined = joined.join(sitemaps.select("site", F.lit(True).alias("sitemap_written")).distinct(), "site", "left")
    return joined.select(
        "site", "files", "alt_added", "tags_added", F.coalesce("reveal_fixes", F.lit(0)).alias("reveal_fixes"),
        F.coalesce("contrast_warnings", F.lit(0)).alias("contrast_warnings"), F.coalesce("sitemap_written", F.lit(False)).alias("sitemap_written"),
    )


def failure_signatures(trace: DataFrame, limit: int = 5) -> DataFrame:
    """Failures per (run, signature), whether the run was given up on, and at which event.

    Only the fifth failure of a signature matters for the abort, so five rows per group leave each task.
    """
    from sitelake.operators.skew import first_n_per_key

    totals = trace.groupBy("run", "signature").agg(F.count("*").alias("failures"))
    fifth = first_n_per_key(trace, ["run", "signature"], [F.col("seq")], limit).filter(F.col("rank") == limit)
    joined = totals.join(fifth.select("run", "signature", F.col("seq").alias("aborted_at")), ["run", "signature"], "left")
    return joined.withColumn("aborted", F.col("aborted_at").isNotNull())
