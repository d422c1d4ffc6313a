"""Link edges, bounded site discovery, page numbering and site admission."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.functions import status, urls
from sitelake.operators import elements as E
from sitelake.operators.skew import number_segment, position_per_key, running_sums
from sitelake.session import cut_lineage

# Fixed values.
MAX_PAGES = 20


def link_edges(pages: DataFrame) -> DataFrame:
    """Same-origin links as `(site, src, dst, pos)`, repeats kept; no shuffle."""
    flat = E.with_elements(pages).select(
        urls.authority("url").alias("site"), urls.normalize_url("url").alias("src"), E.page_links().alias("targets")
    )
    return flat.select("site", "src", F.posexplode("targets").alias("pos", "dst"))


def discover(edges: DataFrame, starts: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Breadth-first discovery from each site's start page; a site over the cap is rejected whole.

    Returns one row per page of accepted sites (`site, url, page_no, level`) in discovery order and one
    row with a null url per rejected site. Every level adds a page to each live site, so there are at most
    `max_pages` rounds. A level is written once, as the pages it adds to the sites that are still live: a site
    without new pages, or over the cap, is in no later level, so what is written grows with the pages found.
    """
    links = edges.groupBy("site", "src", "dst").agg(F.min("pos").alias("pos"))
    links = cut_lineage(links.filter("src <> dst"))
    first = starts.select("site", F.col("start").alias("url")).distinct()
    levels = [cut_lineage(first.select("site", "url", F.lit(0).alias("page_no"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("seen")))]
    rejected: list[DataFrame] = []
    none = F.lit(None)
    for level in range(1, max_pages + 1):
        frontier = levels[-1].select("site", F.col("url").alias("src"), "page_no", "seen")
        live = frontier.groupBy("site").agg(F.max("seen").alias("seen"))
        reached = frontier.drop("seen").join(links, ["site", "src"]).groupBy("site", F.col("dst").alias("url")).agg(F.min(F.struct("page_no", "pos")).alias("via"))
        # Only pages of sites that reached something are looked at again: at most `max_pages` of each.
        known = reduce(DataFrame.unionByName, [old.select("site", "url") for old in levels]).join(live.select("site"), "site", "left_semi")
        fresh = reached.join(known, ["site", "url"], "left_anti").join(live, "site")
        sizes = fresh.groupBy("site").agg((F.count("*") + F.max("seen")).alias("total"))
        room = fresh.join(sizes.filter(F.col("total") <= max_pages), "site")
        # At most `max_pages` rows per site are left here, so the window is small.
        number = F.row_number().over(Window.partitionBy("site").orderBy("via")) + F.col("seen") - 1
        added = room.select("site", "url", number.cast("int").alias("page_no"), F.lit(level).alias("level"), F.col("total").alias("seen"))
        over = sizes.filter(F.col("total") > max_pages).select(
            "site", none.cast("string").alias("url"), none.cast("int").alias("page_no"), none.cast("int").alias("level"), F.col("total").alias("seen"))
        step = cut_lineage(added.unionByName(over))
        if step.isEmpty():
            break
        levels.append(step.filter("url is not null"))
        rejected.append(step.filter("url is null").select("site"))
    if not rejected:
        return levels[0].drop("seen").withColumn("accepted", F.lit(True))
    refused = reduce(DataFrame.unionByName, rejected)
    accepted = reduce(DataFrame.unionByName, levels).drop("seen").join(refused, "site", "left_anti").withColumn("accepted", F.lit(True))
    return accepted.unionByName(
        refused.select("site", none.cast("string").alias("url"), none.cast("int").alias("page_no"), none.cast("int").alias("level"), F.lit(False).alias("accepted"))
    )


def page_file(page_no: Column, suffix: str = ".html") -> Column:
    return F.concat(F.when(page_no == 0, "index").otherwise(F.concat(F.lit("page-"), page_no.cast("string"))), F.lit(suffix))


def numbered_pages(pages: DataFrame, site: Column, width: int = 1_000_000) -> DataFrame:
    """Position of each page within its site in id order, and its file name; tolerates a huge site."""
    rows = position_per_key(pages.withColumn("site", site), ["site"], ["page_id"], number_segment("page_id", width), "_n")
    return rows.withColumn("page_no", (F.col("_n") - 1).cast("int")).drop("_n").withColumn("file", page_file(F.col("page_no")))


def with_part(pages: DataFrame, part_pages: int = MAX_PAGES) -> DataFrame:
    """`part`: pages of a site in runs of `part_pages`. A site that discovery accepts is one part; documents of a larger one
    are built part by part, so that no list grows with the site and no page is left out."""
    return pages.withColumn("part", F.floor(F.col("page_no") / part_pages).cast("int"))


def robots_rules(body: Column) -> Column:
    """Groups of a robots file as an array of `(agents, rules)`, in file order."""
    rule = "array<struct<allow:boolean,path:string>>"
    group = f"array<struct<agents:array<string>,rules:{rule}>>"
    lines = F.transform(F.split(body, r"\r\n|\r|\n"), lambda line: F.trim(F.regexp_replace(line, "#.*$", "")))
    # A blank line ends the group, a closing one is added so the last group is always emitted.
    closed = F.concat(lines, F.array(F.lit("")))
    no_agents, no_rules = F.array().cast("array<string>"), F.array().cast(rule)
    seed = F.struct(F.lit("none").alias("at"), no_agents.alias("agents"), no_rules.alias("rules"), F.array().cast(group).alias("groups"))

    def step(acc, line):
        name = F.lower(F.trim(F.substring_index(line, ":", 1)))
        value = F.trim(F.regexp_replace(line, "^[^:]*:", ""))
        is_agent = line.contains(":") & (name == "user-agent")
        is_rule = line.contains(":") & name.isin("allow", "disallow") & (acc["at"] != "none")
        ends = ((line == "") & (acc["at"] == "rules")) | (is_agent & (acc["at"] == "rules"))
        drops = (line == "") & (acc["at"] == "agents")
        fresh = ends | drops
        agents = F.when(fresh, no_agents).otherwise(acc["agents"])
        rules = F.when(fresh, no_rules).otherwise(acc["rules"])
        # An empty disallow allows everything.
        entry = F.struct(((name == "allow") | (value == "")).alias("allow"), value.alias("path"))
        finished = F.array(F.struct(acc["agents"].alias("agents"), acc["rules"].alias("rules")))
        return F.struct(
            F.when(is_agent, "agents").when(is_rule, "rules").when(fresh, "none").otherwise(acc["at"]).alias("at"),
            F.when(is_agent, F.concat(agents, F.array(F.lower(value)))).otherwise(agents).alias("agents"),
            F.when(is_rule, F.concat(rules, F.array(entry))).otherwise(rules).alias("rules"),
            F.when(ends, F.concat(acc["groups"], finished)).otherwise(acc["groups"]).alias("groups"),
        )

    return F.aggregate(closed, seed, step)["groups"]


def robots_verdicts(robots: DataFrame) -> DataFrame:
    """Whether the agent may fetch `path`: by status first, else the first matching rule of its group."""
    parsed = robots.withColumns({"groups": robots_rules(F.coalesce("body", F.lit(""))), "who": F.lower(F.substring_index("agent", "/", 1))})
    named = F.filter("groups", lambda g: F.exists(g["agents"], lambda a: (a != "*") & F.col("who").contains(a)))
    general = F.filter("groups", lambda g: F.array_contains(g["agents"], "*"))
    group = F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(general, F.lit(1)))
    target = F.when(F.coalesce("path", F.lit("")) == "", "/").otherwise(F.col("path"))
    hits = F.filter(group["rules"], lambda r: (r["path"] == "*") | F.startswith(target, r["path"]))
    by_rule = F.coalesce(F.try_element_at(hits, F.lit(1))["allow"], F.lit(True))
    code = F.col("status")
    allowed = F.when(code.isNull(), True).when(code.isin(401, 403), False).when(code >= 400, True).otherwise(by_rule)
    return parsed.select("site", allowed.alias("allowed"))


def login_walls(pages: DataFrame) -> DataFrame:
    """Pages whose final address looks like a sign-in and that hold a password field."""
    suspect = pages.filter(status.looks_like_login_url(F.col("final_url")))
    return E.with_elements(suspect).filter(E.has_password_field()).drop("elements", "texts")


def admission_report(sites: DataFrame, robots: DataFrame, fetches: DataFrame, walls: DataFrame, discovered: DataFrame) -> DataFrame:
    """One verdict per site: the first failing reason of robots, fetch, login wall and page cap, else accepted."""
    first_failure = fetches.filter("status >= 400").groupBy("site").agg(F.min_by("status", "fetch_no").alias("bad_status"))
    walled = walls.select("site", F.lit(True).alias("walled")).distinct()
    capped = discovered.filter("not accepted").select("site", F.lit(True).alias("capped")).distinct()
    joined = sites.join(robots, "site", "left").join(first_failure, "site", "left").join(walled, "site", "left").join(capped, "site", "left")
    reason = F.coalesce(
        F.when(~F.coalesce("allowed", F.lit(True)), status.ROBOTS_MESSAGE),
        status.fetch_message(F.col("bad_status")),
        F.when(F.col("walled"), status.LOGIN_MESSAGE),
        F.when(F.col("capped"), "page cap exceeded"),
    )
    verdict = F.when(reason.isNull(), "accepted").when(
        F.col("capped") & F.coalesce("allowed", F.lit(True)) & F.col("bad_status").isNull() & F.col("walled").isNull(), "rejected"
    ).otherwise("failed")
    return joined.select("site", verdict.alias("verdict"), reason.alias("reason"))


def distinct_assets(assets: DataFrame) -> DataFrame:
    """One row per stored path: values of the last record, in the position the path was first seen."""
    rest = [c for c in assets.columns if c not in ("site", "storage_path")]
    merged = assets.groupBy("site", "storage_path").agg(F.max_by(F.struct(*rest), "seq").alias("r"), F.min("seq").alias("first_seen"))
    return merged.select("site", "storage_path", "r.*", "first_seen")


def site_digest(pages: DataFrame, part_pages: int = 1_000, gap: str = "\n\n", slice_pages: int = 256, copies: int = 64) -> DataFrame:
    """For each page the summaries of all other pages of its site, in page order.

    The text of a site is put together once, from the texts of runs of `part_pages` pages. A page's own summary is left out of it by
    place: running lengths, summed by run and then over the runs of a site, say where it begins. So a page meets one text, not the
    summaries of its site one by one; a null summary counts as empty. Every `slice_pages` pages of a site get a copy of its text, so
    that the digests of a large site are written by many tasks; a site with more than `copies` such runs deals them over that many
    copies, so what is moved grows with the texts, not with their squares. Lengths are in bytes, which cut a text without reading it.
    """
    between = gap.encode()
    rows = pages.select("page_id", "site", "page_no", F.coalesce("summary", F.lit("")).alias("summary")).withColumns(
        {"part": F.floor(F.col("page_no") / part_pages).cast("long"), "size": F.octet_length("summary").cast("long") + len(between)})
    parts = rows.groupBy("site", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "summary"))), lambda p: p["summary"]), gap).alias("text"),
        F.max("page_no").alias("last_no"))
    in_runs = lambda c: F.floor(c / slice_pages).cast("long")
    in_slices = lambda run: F.pmod(run, F.lit(copies))
    whole = parts.groupBy("site").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), gap).cast("binary").alias("whole"),
        F.min("part").alias("low"), F.max("last_no").alias("high"))
    low = in_runs(F.col("low") * part_pages)
    runs = F.sequence(low, F.least(in_runs(F.col("high")), low + (copies - 1)))
    copied = whole.select("site", F.explode(F.transform(runs, in_slices)).alias("slice"), "whole")
    placed = running_sums(rows, ["site"], ["page_no"], {"upto": F.col("size")}, F.col("part")).withColumn("slice", in_slices(in_runs(F.col("page_no"))))
    begin = F.col("upto") - F.col("size")
    before, after = F.expr(f"substring(whole, 1, cast(upto - size - {len(between)} as int))"), F.expr("substring(whole, cast(upto + 1 as int))")
    first, last = begin == 0, F.col("upto") >= F.octet_length("whole") + len(between)
    text = F.when(first & last, F.lit(b"(single-page site, no other pages)")).when(first, after).when(last, before).otherwise(F.concat(before, F.lit(between), after))
    # Merged by slice: with a copied table the pages would stay in the few tasks they were read by.
    return placed.join(copied.hint("merge"), ["site", "slice"]).select("page_id", "site", text.cast("string").alias("digest"))


def page_batches(pages: DataFrame, size: int = 4) -> DataFrame:
    """Remaining pages in batches of `size`, with the home page repeated as context in each batch."""
    rows = pages
    rest = rows.filter("page_no > 0").withColumn("batch_no", F.floor((F.col("page_no") - 1) / size).cast("int"))
    batches = rest.select("site", "batch_no").distinct()
    home = rows.filter("page_no = 0").join(batches, "site")
    columns = ["site", "batch_no", "page_no", "page_id", "file"]
    return rest.select(*columns).unionByName(home.select(*columns))


def briefs(pages: DataFrame, images: DataFrame, documents: DataFrame | None = None, part_pages: int = MAX_PAGES) -> DataFrame:
    """One text per site, or part of a large one: file map, page list, document and sorted image list with a fixed line when there is none.

    `documents` has site, part and document, the design document of those pages; a part without one has none in its brief.
    """
    kept = with_part(pages, part_pages)
    lines = kept.groupBy("site", "part").agg(F.array_sort(F.collect_list(F.struct("page_no", "url", "file"))).alias("p"))
    names = kept.select("site").distinct().join(images.select("site", "name").distinct(), "site").groupBy("site").agg(
        F.array_sort(F.collect_list("name")).alias("names")
    )
    joined = lines.join(names, "site", "left")
    joined = joined.withColumn("document", F.lit(None).cast("string")) if documents is None else joined.join(documents, ["site", "part"], "left")
    image_list = F.when(F.coalesce(F.size("names"), F.lit(0)) <= 0, "(no images available)").otherwise(
        F.array_join(F.transform("names", lambda n: F.concat(F.lit("- images/"), n)), "\n")
    )
    file_map = F.array_join(F.transform("p", lambda x: F.concat(x["url"], F.lit(" -> "), x["file"])), "\n")
    page_list = F.array_join(F.transform("p", lambda x: F.concat(F.lit("- "), x["file"])), "\n")
    return joined.select("site", "part", F.concat_ws("\n\n", file_map, page_list, "document", image_list).alias("brief"))
