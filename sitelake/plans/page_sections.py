"""Section extraction queries: on real pages, and on document lines read as headings and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.functions import urls
from sitelake.operators import audit, blueprint as B, elements as E, linkgraph as G, palette, sections as S
from sitelake.plans.pages_and_links import SQL_PAGE_REACH, numbered, page_discovery, pages, unescape
from sitelake.plans.registry import query, table
from sitelake.plans.urls_and_text import SQL_EMAIL, SQL_HOST, SQL_PHONE, SQL_PREFIX
from sitelake.sources import documents as D
from sitelake.sources.pages import bucketed_pages

WORDS = ("our-team", "faq list", "pricing", "get started", "contact us", "about us", "misc", "row", "services", "hero", "latest")
SQL_RULES = ", ".join(f"({i}, '{k}', '{w}')" for i, (k, ws) in enumerate(S.SECTION_KEYWORDS.items()) for w in ws)
SQL_BLOCKS = rf"""
  lines as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from (
      select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from documents) t),
  els as (select *, len(string_split(line, ' ')) <= 4 as is_head, 1 + length(line) % 3 as lvl, list_extract({list(WORDS)}, 1 + length(line) % 11) as pk from lines),
  cut as (select *, sum(is_head::int) over (partition by doc_id order by i) as b from els),
  heads as (select doc_id, 0 as b, null as heading, null as level, '' as hay from (select distinct doc_id from documents)
      union all select doc_id, b, line, lvl, lower(line || ' ' || pk) from cut where is_head),
  bodies as (select doc_id, b, string_agg(line, ' ' order by i) as body, count(*) as n, arg_min(line, i) as first_line from cut where not is_head group by all),
  blk as (select h.doc_id, cast(h.b as int) as block_no, heading, cast(level as int) as level, hay, coalesce(body, '') as body, coalesce(n, 0) as n, first_line
      from heads h left join bodies p on p.doc_id = h.doc_id and p.b = h.b),
  hits as (select doc_id, block_no, arg_min(key, ord) as k from blk join (values {SQL_RULES}) r(ord, key, word) on contains(hay, word) where block_no > 0 group by all),
  keyed as (select blk.*, case when k = 'cta_section' and (regexp_matches(body, '{SQL_EMAIL}') or regexp_matches(body, '{SQL_PHONE}')) then 'contact' else k end as section
      from blk left join hits using (doc_id, block_no)),
  hero as (select doc_id, max(case when block_no = 1 and (level = 1 or contains(hay, 'hero') or contains(hay, 'banner') or contains(hay, 'jumbotron')
      or not has_h1) then 1 else 0 end) as taken from (select *, bool_or(coalesce(level = 1, false)) over (partition by doc_id) as has_h1 from keyed) t group by 1),
  body as (select keyed.* from keyed join hero using (doc_id) where block_no > taken),
  runs as (select *, max(case when section is not null then block_no end) over (partition by doc_id order by block_no) as cand from body),
  fam as (select r.*, case when r.section is null and min(r.level) filter (where r.section is null) over (partition by r.doc_id, r.cand order by r.block_no) > p.level
      then r.cand end as parent from runs r left join body p on p.doc_id = r.doc_id and p.block_no = r.cand)
"""


def document_pages(spark, sf_dir):
    """Documents as pages: short lines are headings, the others paragraphs, below one body element."""
    lines = F.filter(F.transform(F.split("text", "\n"), F.trim), lambda t: t != "")
    docs = E.computed_once(table(spark, sf_dir, "documents"), {"lines": lines}).select("doc_id", "lines")
    none = F.create_map().cast("map<string,string>")

    def element(number, end, parent, depth, tag, first, count, key):
        return F.struct(
            number.alias("node_no"), end.alias("end_no"), parent.cast("int").alias("parent_no"), F.lit(depth).alias("depth"), tag.alias("tag"),
            none.alias("attrs"), F.lit(0).alias("child_count"), first.alias("first_text"), count.alias("text_count"), key.alias("parent_key"))

    count = F.size("lines")
    root = element(F.lit(1), count + 1, F.lit(None), 0, F.lit("body"), F.lit(1), count, F.lit(""))
    words = F.array(*[F.lit(w) for w in WORDS])

    def of_line(line, i):
        tag = F.when(F.size(F.split(line, " ")) <= 4, F.concat(F.lit("h"), (F.length(line) % 3 + 1).cast("string"))).otherwise("p")
        return element(i + 2, i + 2, F.lit(1), 1, tag, i + 1, F.lit(1), F.element_at(words, F.length(line) % 11 + 1))

    built = docs.select(
        "doc_id", F.lit("https://doc.test/").alias("url"), none.alias("asset_paths"),
        F.transform("lines", lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("hidden"))).alias("texts"),
        F.concat(F.array(root), F.transform("lines", of_line)).alias("elements"),
    )
    once = E.computed_once(built, {"texts": F.col("texts"), "elements": F.col("elements")})
    scoped = E.computed_once(once, {"main_scope": F.try_element_at("elements", F.lit(1))})
    return S.with_absorbed(S.with_hero_split(S.with_blocks(scoped, "main_scope", "blocks"), "blocks"), "body_blocks", "keyed")


@query(
    "heading_blocks", "X3", "X4",
    sql=f"with {SQL_BLOCKS} select doc_id, block_no, heading, level, cast(n as int) as paragraphs, md5(body) as digest from blk",
)
def heading_blocks(spark, sf_dir):
    rows = document_pages(spark, sf_dir).select("doc_id", F.explode("blocks").alias("b"))
    return rows.select(
        "doc_id", "b.block_no", "b.heading", "b.level", F.size("b.paragraphs").alias("paragraphs"), F.md5(F.array_join("b.paragraphs", " ")).alias("digest")
    )


@query("section_classes", "X6", sql=f"with {SQL_BLOCKS} select doc_id, block_no, section from keyed where block_no > 0")
def section_classes(spark, sf_dir):
    rows = document_pages(spark, sf_dir).select("doc_id", F.explode("blocks").alias("b")).filter("b.block_no > 0")
    return rows.select("doc_id", "b.block_no", S.section_key(F.col("b")).alias("section"))


@query("absorbed_blocks", "X9", sql=f"with {SQL_BLOCKS} select doc_id, block_no, section, cast(parent as int) as parent from fam")
def absorbed_blocks(spark, sf_dir):
    rows = document_pages(spark, sf_dir).select("doc_id", F.explode("keyed").alias("b"))
    return rows.select("doc_id", "b.block_no", "b.section", "b.parent")


@query(
    "hero_sections", "X7",
    sql=f"""with {SQL_BLOCKS} select doc_id, coalesce(max(heading) filter (where block_no = 1), '') as headline, coalesce(arg_min(first_line, block_no), '') as subheadline
      from keyed join hero using (doc_id) where block_no <= taken group by doc_id""",
)
def hero_sections(spark, sf_dir):
    rows = document_pages(spark, sf_dir).select("doc_id", S.hero().alias("h"))
    return rows.select("doc_id", "h.headline", "h.subheadline")


@query(
    "about_sections", "X12",
    sql=f"""with {SQL_BLOCKS}, a as (select doc_id, min(block_no) as a_no from fam where section = 'about' group by 1)
      select f.doc_id, max(heading) filter (where block_no = a_no) as heading, md5(coalesce(string_agg(body, ' ' order by block_no) filter (where body <> ''), '')) as digest
      from fam f join a using (doc_id) where block_no = a_no or parent = a_no group by f.doc_id""",
)
def about_sections(spark, sf_dir):
    rows = document_pages(spark, sf_dir).filter(F.exists("keyed", lambda b: b["section"] == "about")).select("doc_id", S.about(F.col("keyed")).alias("a"))
    return rows.select("doc_id", "a.heading", F.md5("a.body").alias("digest"))


@query(
    "service_items", "X10", "X11",
    sql=f"""with {SQL_BLOCKS}, e as (select doc_id, block_no from fam where section = 'services_features'),
      c as (select e.doc_id, e.block_no as entry, f.block_no, heading, body from e join fam f on f.doc_id = e.doc_id and f.parent = e.block_no),
      i as (select doc_id, block_no, heading, body from c union all
        select f.doc_id, f.block_no, heading, body from fam f join e on e.doc_id = f.doc_id and e.block_no = f.block_no
          where not exists (select 1 from c where c.doc_id = f.doc_id and c.entry = f.block_no))
      select doc_id, heading as title, body as description from i
        qualify row_number() over (partition by doc_id, lower(trim(heading)), lower(trim(body)) order by block_no) = 1""",
)
def service_items(spark, sf_dir):
    key = "services_features"
    rows = E.keep_first(document_pages(spark, sf_dir), {"items": (S.list_items(F.col("keyed"), key), S.item_identity(key))})
    return rows.select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.title", "i.description")


@query(
    "additional_sections", "X13",
    sql=f"""with {SQL_BLOCKS} select doc_id, heading as title, md5(body) as digest,
        case when trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') = '' then 'section' else trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') end as key
      from fam where section is null and parent is null and block_no > 0 and n > 0""",
)
def additional_sections(spark, sf_dir):
    rows = document_pages(spark, sf_dir).select("doc_id", F.explode(S.additional_sections(F.col("keyed"))).alias("a"))
    return rows.select("doc_id", "a.title", F.md5("a.body").alias("digest"), "a.key")


@query(
    "list_items", "X5",
    sql=rf"""select page_id, unnest(list_filter(list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1), lambda l: {unescape("l")}),
        lambda l: l <> '')) as item from pages""",
)
def list_items(spark, sf_dir):
    base = E.with_scopes(E.with_elements(pages(spark, sf_dir))).withColumn("asset_paths", F.create_map().cast("map<string,string>"))
    blocks = S.with_blocks(base, "main_scope", "blocks")
    return blocks.select("page_id", F.explode(F.flatten(F.transform("blocks", lambda b: b["items"]))).alias("item"))


@query(
    "page_heroes", "X7", "X8",
    sql=f"""select page_id, trim({unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) as headline, {unescape("regexp_extract(html, '<a href=.([^>]*).>', 1)")} as cta_href from pages""",
)
def page_heroes(spark, sf_dir):
    base = E.with_scopes(E.with_elements(pages(spark, sf_dir))).withColumn("asset_paths", F.create_map().cast("map<string,string>"))
    hero = S.with_hero_split(S.with_blocks(base, "main_scope", "blocks"), "blocks").select("page_id", S.hero().alias("h"))
    return hero.select("page_id", "h.headline", "h.cta_href")


# The given pages carry no images or links to assets: each page gets a head with references derived from its id.
def references():
    """Head and images that are added to every page."""
    n = F.col("page_id").cast("string")
    return F.concat(
        F.lit('<head><link rel="icon" sizes="16x16" href="/i16.ico"><link rel="shortcut icon" sizes="32x32" href="i32.ico"><link rel="preload" as="font" href="/f.bin">'
              '<link rel="stylesheet" href="/fonts/a.woff2"></head><body><img src="/img/'), n, F.lit('.png" alt="pic '), n,
        F.lit('"><img src="/img/'), n, F.lit('.png"><img src="logo-'), n, F.lit('.svg" class="site-logo"><img src="/none.png">'))


def decorated(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "url", F.concat(references(), F.regexp_extract("html", "(?s)<nav>.*$", 0)).alias("html"))


def illustrated(spark, sf_dir):
    """Whole pages with the added references in front of their navigation."""
    before, rest = F.regexp_extract("html", "(?s)^(.*?)<nav>", 1), F.regexp_extract("html", "(?s)<nav>.*$", 0)
    return pages(spark, sf_dir).select("page_id", "url", F.concat(before, F.regexp_replace(references(), "</?(head|body)>", ""), rest).alias("html"))


def stored_assets(spark, sf_dir):
    """Derived asset table: page images with an even id, all logos, and the icons of every site."""
    refs = E.with_elements(decorated(spark, sf_dir)).select("page_id", urls.authority("url").alias("site"), F.posexplode(E.asset_references()).alias("pos", "a"))
    kept = refs.filter("(a.asset_type <> 'image' or page_id % 2 = 0 or a.url like '%logo%') and a.url not like '%none.png'")
    return kept.select(
        "site", F.col("a.url").alias("original_url"), "a.asset_type", F.concat_ws("/", "a.asset_type", urls.asset_file_name("a.url")).alias("storage_path"),
        (F.col("page_id") * 100 + F.col("pos")).alias("seq"))


SQL_REFS = rf"""refs as (select page_id, site, x.u as url, x.t as asset_type, x.alt as alt from (
    select page_id, site, unnest([{{'u': o || '/img/' || page_id || '.png', 't': 'image', 'alt': 'pic ' || page_id}}, {{'u': o || '/img/' || page_id || '.png', 't': 'image', 'alt': ''}},
      {{'u': o || d || 'logo-' || page_id || '.svg', 't': 'image', 'alt': ''}}, {{'u': o || '/none.png', 't': 'image', 'alt': ''}}, {{'u': o || '/i16.ico', 't': 'icon', 'alt': ''}},
      {{'u': o || d || 'i32.ico', 't': 'icon', 'alt': ''}}, {{'u': o || '/f.bin', 't': 'font', 'alt': ''}}, {{'u': o || '/fonts/a.woff2', 't': 'font', 'alt': ''}}]) as x
    from (select page_id, {SQL_HOST} as site, regexp_extract(url, '{SQL_PREFIX}', 0) as o,
        case when p = '' then '/' else regexp_extract(p, '^(.*/)?', 0) end as d
      from (select page_id, url, regexp_extract(url, '{SQL_PREFIX}([^?#]*)', 1) as p from pages) a) b) c)"""
SQL_STORED = "asset_type || '/' || left(sha1(url), 8) || '-' || list_extract(string_split(url, '/'), -1)"


@query("asset_references", "P12", sql=f"with {SQL_REFS} select page_id, url, asset_type from refs")
def asset_references(spark, sf_dir):
    rows = E.with_elements(decorated(spark, sf_dir)).select("page_id", F.explode(E.asset_references()).alias("a"))
    return rows.select("page_id", "a.url", "a.asset_type")


def with_paths(spark, sf_dir):
    return B.with_asset_paths(E.with_elements(bucketed_pages(decorated(spark, sf_dir))), stored_assets(spark, sf_dir), urls.authority("url"))


@query(
    "page_images", "J1", "J2",
    sql=f"""with {SQL_REFS} select page_id, {SQL_STORED} as path, max(alt) as alt from refs
      where asset_type = 'image' and not contains(url, 'none.png') and (page_id % 2 = 0 or contains(url, 'logo')) group by all""",
)
def page_images(spark, sf_dir):
    return B.with_all_images(with_paths(spark, sf_dir)).select("page_id", F.explode("all_images").alias("i")).select("page_id", "i.path", "i.alt")


@query(
    "logos_and_favicons", "W7", "W8",
    sql=f"""with {SQL_REFS} select page_id, max({SQL_STORED}) filter (where contains(url, 'logo-')) as logo, max({SQL_STORED}) filter (where contains(url, 'i32.ico')) as favicon
      from refs group by page_id""",
)
def logos_and_favicons(spark, sf_dir):
    return with_paths(spark, sf_dir).select("page_id", B.logo().alias("logo"), B.favicon().alias("favicon"))


@query(
    "image_paths", "J1",
    sql="""select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when p_partkey is not null then 'img/' || p_partkey end as path
      from lineitem left join (select * from part where p_size < 20) p on p_partkey = l_partkey""",
)
def image_paths(spark, sf_dir):
    stored = table(spark, sf_dir, "part").filter("p_size < 20").select(
        F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("img/"), F.col("p_partkey").cast("string")).alias("path"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(stored, "l_partkey", "left")


def blueprints(spark, sf_dir):
    """Blueprints with images, logos and icons from the derived assets, galleries included."""
    return B.page_blueprints(bucketed_pages(illustrated(spark, sf_dir)), stored_assets(spark, sf_dir), gallery=True)


@query("page_blueprints", "X20", "X2", "X8", "X14", "X16", "X17", "X18", "X19", "M3", "F1")
def page_blueprints(spark, sf_dir):
    return blueprints(spark, sf_dir).select("page_id", "url", F.to_json("sections").alias("sections"), F.size("navigation").alias("nav_links"))


@query(
    "blueprint_assets", "X20", "X7", "J1", "J2", "W7", "W8",
    sql=f"""with {SQL_REFS}, found as (select page_id, {SQL_STORED} as path, url from refs
          where asset_type in ('image', 'icon') and not contains(url, 'none.png') and (asset_type = 'icon' or page_id % 2 = 0 or contains(url, 'logo')))
      select page_id, max(path) filter (where contains(url, 'logo-')) as logo, max(path) filter (where contains(url, 'i32.ico')) as favicon,
        string_agg(distinct path, ' ' order by path) filter (where starts_with(path, 'image/')) as images,
        any_value(trim({unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")})) as headline
      from found join (select page_id, html from pages) h using (page_id) group by page_id""",
)
def blueprint_assets(spark, sf_dir):
    """Logo, icon, images and headline as whole blueprints have them."""
    images = F.array_join(F.array_sort(F.transform("all_images", lambda i: i["path"])), " ")
    return blueprints(spark, sf_dir).select("page_id", "logo", "favicon", images.alias("images"), "sections.hero.headline")


def team_widgets():
    """Members of a marked team box, as a plug-in would mark them."""

    def part(box, name):
        return E.joined_text(E.first_element(E.descendants(box), lambda e: E.has_class(e, f"x-team__{name}")))

    boxes = F.filter("elements", lambda e: E.has_class(e, "x-team"))
    return F.transform(boxes, lambda b: F.struct(
        part(b, "name").alias("name"), part(b, "role").alias("role"), F.lit("").alias("bio"), F.lit(None).cast("string").alias("photo")))


@query(
    "widget_teams", "F1", "X18",
    sql="select page_id, 'Ann ' || page_id || ' (lead), Bob ' || page_id % 7 || ' (cook)' as team from pages",
)
def widget_teams(spark, sf_dir):
    """A second widget extractor over pages with team boxes, of which one is there twice."""
    number, other = F.col("page_id").cast("string"), (F.col("page_id") % 7).cast("string")

    def box(name, role):
        return F.concat(F.lit('<div class="x-team"><b class="x-team__name">'), *name, F.lit(f'</b> <i class="x-team__role">{role}</i></div>'))

    ann, bob = box((F.lit("Ann "), number), "lead"), box((F.lit("Bob "), other), "cook")
    rows = pages(spark, sf_dir).select("page_id", "url", F.concat(F.regexp_extract("html", "(?s)^(.*)</body>", 1), ann, bob, ann, F.lit("</body></html>")).alias("html"))
    with B.widget("team", team_widgets):
        found = B.page_blueprints(rows)
    members = F.transform("sections.team", lambda m: F.concat(m["name"], F.lit(" ("), m["role"], F.lit(")")))
    return found.select("page_id", F.array_join(members, ", ").alias("team"))


@query("covered_digests", "A16")
def covered_digests(spark, sf_dir):
    return blueprints(spark, sf_dir).select("page_id", B.covered_digest().alias("digest"))


def site_rows(spark, sf_dir):
    from sitelake.plans.palette_and_audit import pixels

    page_numbers = numbered(spark, sf_dir).select("page_id", "site", "page_no")
    joined = blueprints(spark, sf_dir).join(page_numbers, "page_id")
    css = palette.css_palettes(joined.filter("page_no = 0"), ["site"])
    # Colours of the picture of the first page of a site, where its style text has none.
    pictures = palette.image_palettes(pixels(spark, sf_dir).join(page_numbers.filter("page_no = 0"), F.col("vec_id") == F.col("page_id")), "site")
    colors = palette.with_palette(page_numbers.select("site").distinct(), css, pictures)
    return B.site_blueprints(joined, colors)


@query("site_blueprints", "X20", "S3", "A14")
def site_blueprints(spark, sf_dir):
    return site_rows(spark, sf_dir).select("site", "part", "meta.site_name", F.size("pages").alias("pages"), F.to_json(F.struct("meta", "navigation", "pages")).alias("document"))


@query("design_documents", "A18", "S4")
def design_documents(spark, sf_dir):
    return site_rows(spark, sf_dir).select(F.col("site").alias("host"), "part", B.design_document().alias("design_md"))


@query("blueprint_round_trip", "S3")
def blueprint_round_trip(spark, sf_dir):
    stored = site_rows(spark, sf_dir).select("site", "part", F.to_json(F.struct("meta", "pages")).alias("document"))
    return D.parse_blueprints(stored).select("site", "part", "blueprint.meta.site_name", F.size("blueprint.navigation").alias("nav_links"), F.size("blueprint.pages").alias("pages"))


SQL_ROBOTS = rf"""robots as (select site, case k when 2 then true when 3 then true when 4 then false when 0 then true when 1 then starts_with(p, '/en/') else starts_with(p, '/en/') end as allowed
    from (select {SQL_HOST} as site, arg_min(page_id, page_id) % 6 as k, arg_min(regexp_extract(url, '{SQL_PREFIX}([^?#]*)', 1), page_id) as p from pages group by 1) t)"""
SQL_WALLS = f"""walls as (select page_id, site, final_url from (select page_id, {SQL_HOST} as site, url || case when page_id % 9 = 0 then '/SignIn' else '' end as final_url from pages) t
    where regexp_matches(lower(final_url), 'login|signin|sign-in|log-in') and page_id % 18 = 0)"""


@query("robots_verdicts", "G4", sql=f"with {SQL_ROBOTS} select * from robots")
def robots_verdicts(spark, sf_dir):
    return G.robots_verdicts(robots(spark, sf_dir))


def robots(spark, sf_dir):
    """Robots files derived from the page table: status and rules vary with the page id."""
    k = F.col("page_id") % 6
    site_path = F.regexp_replace(urls.path("url"), "/[^/]*$", "/")
    body = F.concat(
        F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/\nDisallow: "),
        F.when(k == 0, F.lit("")).when(k == 1, "/").otherwise(site_path), F.lit("\n"))
    first = pages(spark, sf_dir).groupBy(urls.authority("url").alias("site")).agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("p"))
    rows = first.select("site", "p.*")
    status = F.when(k == 2, F.lit(None).cast("int")).when(k == 3, 404).when(k == 4, 403).otherwise(200)
    return rows.select("site", status.alias("status"), body.alias("body"), F.lit("SiteBot/1.0").alias("agent"), urls.path("url").alias("path"))


@query("login_walls", "P15", sql=f"with {SQL_WALLS} select * from walls")
def login_walls(spark, sf_dir):
    return G.login_walls(walled(spark, sf_dir)).select("page_id", "site", "final_url")


def walled(spark, sf_dir):
    suspect = F.col("page_id") % 9 == 0
    field = F.when(F.col("page_id") % 18 == 0, '<form><input type="password"></form>').otherwise("")
    return pages(spark, sf_dir).select(
        "page_id", urls.authority("url").alias("site"), F.concat("url", F.when(suspect, "/SignIn").otherwise("")).alias("final_url"),
        F.concat("html", field).alias("html"))


@query(
    "site_admission", "G5",
    sql=f"""with recursive {SQL_PAGE_REACH}, {SQL_ROBOTS}, {SQL_WALLS},
      s as (select {SQL_HOST} as site, bool_or(page_id % 40 = 1) as bad, any_value(not accepted) as big from pages join found on found.site = {SQL_HOST} group by 1),
      r as (select s.site, case when not allowed then 'robots.txt disallows crawling this site' when bad then 'This site''s server returned an error. Please try again later.'
          when s.site in (select site from walls) then 'This site appears to require a login and can''t be crawled.' when big then 'page cap exceeded' end as reason
        from s join robots using (site))
      select site, case when reason is null then 'accepted' when reason = 'page cap exceeded' then 'rejected' else 'failed' end as verdict, reason from r""",
)
def site_admission(spark, sf_dir):
    corpus = pages(spark, sf_dir)
    sites = corpus.select(urls.authority("url").alias("site")).distinct()
    fetches = corpus.select(
        urls.authority("url").alias("site"), F.col("page_id").alias("fetch_no"), F.when(F.col("page_id") % 40 == 1, 503).otherwise(200).alias("status"))
    found = page_discovery(spark, sf_dir)
    return G.admission_report(sites, G.robots_verdicts(robots(spark, sf_dir)), fetches, G.login_walls(walled(spark, sf_dir)), found)


@query(
    "share_tags", "A20",
    sql=rf"""select page_id, x.property, x.content from (select page_id, unnest([{{'property': 'og:type', 'content': 'website'}},
        {{'property': 'og:title', 'content': case when page_id % 3 = 0 then {SQL_HOST} else trim({unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) end}},
        {{'property': 'og:description', 'content': case when page_id % 2 = 0 then 'About ' || {SQL_HOST} else '' end}},
        {{'property': 'og:image', 'content': case when page_id % 5 > 0 then 'images/logo-' || page_id || '.svg' else '' end}},
        {{'property': 'og:url', 'content': 'page-' || page_id || '.html'}}]) as x from pages) t
      where x.content <> ''""",
)
def share_tags(spark, sf_dir):
    """Share tags of pages of which some have no title, some a description and most a logo."""
    number, site = F.col("page_id").cast("string"), urls.authority("url")
    about = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<meta name="description" content="About '), site, F.lit('">'))).otherwise("")
    untitled = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "<title>[^<]*</title>", "")).otherwise(F.col("html"))
    rows = pages(spark, sf_dir).select("page_id", "url", F.concat(F.regexp_extract(untitled, "(?s)^(.*?<head[^>]*>)", 1), about, F.regexp_replace(untitled, "(?s)^.*?<head[^>]*>", "")).alias("html"))
    logo = F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("image/logo-"), number, F.lit(".svg"))).otherwise("")
    tags = audit.share_tags(F.concat(F.lit("page-"), number, F.lit(".html")), site, logo)
    rows = E.with_elements(rows).select("page_id", F.explode(tags).alias("t"))
    return rows.select("page_id", "t.property", "t.content")
