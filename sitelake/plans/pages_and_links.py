"""Element, link and site queries over the page corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitelake.functions import text, urls
from sitelake.operators import elements as E, linkgraph as G
from sitelake.plans.registry import query, table
from sitelake.plans.urls_and_text import SQL_HOST, SQL_NORMAL, SQL_SPACE
from sitelake.session import checkpoint_folder
from sitelake.sources import documents as D, packages as K, pages as C, tables as T

# Entities used by the given pages.
SQL_UNESCAPE = (
    "replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')"
)


def unescape(expression: str) -> str:
    return SQL_UNESCAPE.format(expression)


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def numbered(spark, sf_dir):
    return G.numbered_pages(pages(spark, sf_dir).select("page_id", "url"), urls.authority("url"))


SQL_NUMBERED = f"""numbered as (select page_id, url, site, cast(n - 1 as int) as page_no, case when n = 1 then 'index' else 'page-' || (n - 1) end || '.html' as file,
    count(*) over (partition by site) as size
  from (select page_id, url, {SQL_HOST} as site, row_number() over (partition by {SQL_HOST} order by page_id) as n from pages) t)"""


@query(
    "element_counts", "X1", "F3",
    sql="""select page_id, tag, count(*) as n from (select page_id, unnest(regexp_extract_all(
        regexp_replace(html, '<script>.*?</script>', '<script>', 'gs'), '<([a-z][a-z0-9]*)', 1)) as tag from pages) t
      where tag not in ('html', 'body') group by all""",
)
def element_counts(spark, sf_dir):
    rows = E.with_elements(pages(spark, sf_dir).select("page_id", "html")).select("page_id", F.explode("elements").alias("e"))
    return rows.filter("e.tag not in ('html', 'body')").groupBy("page_id", F.col("e.tag").alias("tag")).agg(F.count("*").alias("n"))


@query(
    "page_visible_text", "P7", "X1",
    sql=rf"""select page_id, length(t) as n, md5(case when length(t) > 12000 then left(t, 6000) || ' ...[truncated]... ' || right(t, 6000) else t end) as digest
      from (select page_id, trim(regexp_replace({unescape("regexp_replace(regexp_replace(html, '<!--.*?-->|<script>.*?</script>|<style>.*?</style>', ' ', 'gs'), '<[^>]*>', ' ', 'g')")},
        '{SQL_SPACE}', ' ', 'g')) as t from pages) p""",
)
def page_visible_text(spark, sf_dir):
    whole = E.with_elements(pages(spark, sf_dir)).select("page_id", E.collapsed_text().alias("t"))
    return whole.select("page_id", F.length("t").cast("long").alias("n"), F.md5(text.clip_middle("t")).alias("digest"))


@query(
    "site_names", "P11", "X1",
    sql=rf"""select page_id, trim(regexp_extract(title, '^[^|\-–]*', 0)) as site_name
      from (select page_id, {unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")} as title from pages) t""",
)
def site_names(spark, sf_dir):
    return E.with_elements(pages(spark, sf_dir)).select("page_id", E.site_name_guess().alias("site_name"))


@query(
    "page_navigation", "X15", "X2",
    sql=rf"""select page_id, pos, label, href from (select page_id, unnest(labels) as label, unnest(hrefs) as href, unnest(range(0, len(hrefs))) as pos
      from (select page_id, list_transform(regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1), lambda l: {unescape("l")}) as labels,
          list_transform(regexp_extract_all(nav, '<a href="([^"]*)"', 1), lambda l: {unescape("l")}) as hrefs
        from (select page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') as nav from pages) a) b) c where label <> ''""",
)
def page_navigation(spark, sf_dir):
    links = E.with_scopes(E.with_elements(pages(spark, sf_dir))).select("page_id", F.posexplode(E.navigation()).alias("pos", "link"))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), "link.label", "link.href")


@query(
    "copyright_lines", "P10", "X16",
    sql=rf"""select page_id, trim(regexp_extract({unescape("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")}, '(?i)(©|copyright)[^.]{{0,80}}', 0)) as line from pages""",
)
def copyright_lines(spark, sf_dir):
    return E.with_scopes(E.with_elements(pages(spark, sf_dir))).select("page_id", E.footer()["copyright_text"].alias("line"))


@query(
    "home_css", "A15",
    sql="""select page_id, array_to_string(regexp_extract_all(html, '<style>(.*?)</style>', 1, 's'), chr(10)) as css from pages""",
)
def home_css(spark, sf_dir):
    return E.with_elements(pages(spark, sf_dir)).select("page_id", E.css_text().alias("css"))


@query(
    "link_edges", "G1", "P1", "P3", "P4",
    sql=rf"""select {SQL_HOST} as site, {SQL_NORMAL} as src, regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) || rtrim(regexp_extract(href, '^[^?#]*', 0), '/') as dst, count(*) as n
      from (select url, unnest(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda l: {unescape("l")})) as href from pages) t group by all""",
)
def link_edges(spark, sf_dir):
    return G.link_edges(pages(spark, sf_dir)).groupBy("site", "src", "dst").agg(F.count("*").alias("n"))


@query(
    "host_summary", "G1", "S1", "P1",
    sql=rf"""with l as (select {SQL_HOST} as site, page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as hrefs from pages)
      select site, count(*) as pages, cast(sum(len(hrefs)) as bigint) as links, count(distinct {SQL_NORMAL}) as addresses from l group by site""",
)
def host_summary(spark, sf_dir):
    flat = pages(spark, sf_dir).select(
        urls.authority("url").alias("site"), urls.normalize_url("url").alias("address"),
        F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("hrefs"),
    )
    # Two additive levels instead of a distinct over a possibly huge site.
    per_address = flat.groupBy("site", "address").agg(F.count("*").alias("pages"), F.sum("hrefs").alias("links"))
    return per_address.groupBy("site").agg(F.sum("pages").alias("pages"), F.sum("links").alias("links"), F.count("*").alias("addresses"))


GRAPH = """select 's' || cast(l_orderkey % 97 as varchar(5)) as site, cast(l_partkey % 25 as varchar(5)) as src,
    cast(l_partkey % 25 + 1 + l_suppkey % 3 as varchar(5)) as dst, l_linenumber as pos
  from {lineitem} where l_partkey % 25 < 3 + l_orderkey % 97 % 30"""
SQL_GRAPH = f"e as ({GRAPH.replace('{lineitem}', 'lineitem')}), r as (select distinct site, '0' as node from e union select e.site, e.dst from r join e on e.site = r.site and e.src = r.node)"


@query(
    "site_discovery", "G2",
    sql=f"""with recursive {SQL_GRAPH} select site, count(*) <= 20 as accepted, case when count(*) <= 20 then count(*) else 0 end as pages from r group by site""",
)
def site_discovery(spark, sf_dir):
    edges = spark.sql(GRAPH, lineitem=table(spark, sf_dir, "lineitem"))
    starts = edges.select("site", F.lit("0").alias("start")).distinct()
    found = G.discover(edges, starts)
    return found.groupBy("site").agg(F.bool_and("accepted").alias("accepted"), F.count("url").alias("pages"))


SQL_PAGE_REACH = rf"""edges as (select distinct {SQL_HOST} as site, {SQL_NORMAL} as src, regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) || rtrim(regexp_extract(href, '^[^?#]*', 0), '/') as dst
      from (select url, unnest(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda l: {unescape("l")})) as href from pages) t),
  homes as (select {SQL_HOST} as site, arg_min({SQL_NORMAL}, page_id) as node from pages group by 1),
  reach as (select site, node from homes union select r.site, e.dst from reach r join edges e on e.site = r.site and e.src = r.node),
  found as (select site, count(*) <= 20 as accepted, case when count(*) <= 20 then count(*) else 0 end as pages from reach group by site)"""


@query("page_discovery", "G2", "G1", sql=f"with recursive {SQL_PAGE_REACH} select * from found")
def page_discovery(spark, sf_dir):
    """Discovery over the links of the page corpus, from the first page of every site."""
    corpus = pages(spark, sf_dir)
    starts = corpus.groupBy(urls.authority("url").alias("site")).agg(F.min_by(urls.normalize_url("url"), "page_id").alias("start"))
    found = G.discover(G.link_edges(corpus), starts)
    return found.groupBy("site").agg(F.bool_and("accepted").alias("accepted"), F.count("url").alias("pages"))


@query("page_numbers", "G3", sql=f"with {SQL_NUMBERED} select page_id, site, page_no, file from numbered")
def page_numbers(spark, sf_dir):
    return numbered(spark, sf_dir).select("page_id", "site", "page_no", "file")


@query(
    "asset_records", "G6",
    sql="""select lang as site, source as storage_path, arg_max(doc_id, doc_id) as seq, arg_max(n_chars, doc_id) as n_chars, min(doc_id) as first_seen
      from documents group by lang, source""",
)
def asset_records(spark, sf_dir):
    assets = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("site"), F.col("source").alias("storage_path"), F.col("doc_id").alias("seq"), "n_chars"
    )
    return G.distinct_assets(assets)


@query(
    "site_digests", "A17",
    sql=f"""with {SQL_NUMBERED}
      select a.page_id, a.site, coalesce(string_agg('Page: ' || b.url, chr(10) || chr(10) order by b.page_no), '(single-page site, no other pages)') as digest
      from numbered a left join numbered b on b.site = a.site and b.page_no <> a.page_no group by a.page_id, a.site""",
)
def site_digests(spark, sf_dir):
    rows = numbered(spark, sf_dir).withColumn("summary", F.concat(F.lit("Page: "), "url"))
    return G.site_digest(rows)


@query(
    "page_batches", "W13",
    sql=f"""with {SQL_NUMBERED}, s as (select * from numbered),
      b as (select site, cast(floor((page_no - 1) / 4) as int) as batch_no, page_no, page_id, file from s where page_no > 0)
      select * from b union all select distinct s.site, b.batch_no, s.page_no, s.page_id, s.file from s join b on b.site = s.site where s.page_no = 0""",
)
def page_batches(spark, sf_dir):
    return G.page_batches(numbered(spark, sf_dir))


@query(
    "site_briefs", "A28",
    sql=f"""with {SQL_NUMBERED}, s as (select *, cast(page_no // 20 as int) as part from numbered),
      i as (select distinct site, 'img-' || page_id % 3 || '.png' as name from s where page_id % 2 = 0),
      il as (select site, string_agg('- images/' || name, chr(10) order by name) as t from i group by site)
      select s.site, s.part, string_agg(url || ' -> ' || file, chr(10) order by page_no) || chr(10) || chr(10) || string_agg('- ' || file, chr(10) order by page_no)
        || chr(10) || chr(10) || coalesce('# ' || arg_min(title, page_no) filter (where page_id % 3 > 0) || chr(10) || chr(10), '')
        || coalesce(max(t), '(no images available)') as brief
      from s left join il on il.site = s.site join (select page_id, trim({unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) as title from pages) h using (page_id)
      group by s.site, s.part""",
)
def site_briefs(spark, sf_dir):
    rows = numbered(spark, sf_dir)
    images = rows.filter("page_id % 2 = 0").select("site", F.concat(F.lit("img-"), (F.col("page_id") % 3).cast("string"), F.lit(".png")).alias("name"))
    # The title of the first page of each part that has a document.
    titled = E.with_elements(pages(spark, sf_dir).filter("page_id % 3 > 0")).select("page_id", E.joined_text(E.first_element(F.col("elements"), E.by_tag("title"))).alias("title"))
    titled = titled.join(rows.select("page_id", "site", "page_no"), "page_id")
    documents = G.with_part(titled).groupBy("site", "part").agg(F.concat(F.lit("# "), F.min_by("title", "page_no")).alias("document"))
    return G.briefs(rows, images, documents)


@query(
    "sitemaps", "S5",
    sql=f"""with {SQL_NUMBERED} select site, cast(page_no // 50000 as int) as part, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10)
        || string_agg('  <url><loc>https://REPLACE-WITH-YOUR-DOMAIN.com/' || file || '</loc></url>', chr(10) order by file) || chr(10) || '</urlset>' || chr(10) as sitemap
      from numbered group by all""",
)
def sitemaps(spark, sf_dir):
    return D.sitemaps(numbered(spark, sf_dir))


@query(
    "package_files", "S6",
    sql=rf"""select site, path from (select {SQL_HOST} as site, unnest([regexp_extract(url, '://[^/]*/([^?#]*)', 1) || '/index.html', 'x/_debug_trace_' || page_id || '.json',
        'blueprint.json', 'a/blueprint.json', 'assets/blueprint.json.txt', 'p' || page_id || '/style.css']) as path from pages) t
      where not regexp_matches(path, '(^|/)(_debug_trace[^/]*\.json|blueprint\.json)$') group by all""",
)
def package_files(spark, sf_dir):
    rest = F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1)
    number = F.col("page_id").cast("string")
    paths = F.array(
        F.concat(rest, F.lit("/index.html")), F.concat(F.lit("x/_debug_trace_"), number, F.lit(".json")), F.lit("blueprint.json"),
        F.lit("a/blueprint.json"), F.lit("assets/blueprint.json.txt"), F.concat(F.lit("p"), number, F.lit("/style.css")),
    )
    listing = pages(spark, sf_dir).select(urls.authority("url").alias("site"), F.explode(paths).alias("path"))
    return K.packaged(listing).distinct()


@query(
    "crawl_manifests", "S2",
    sql=f"""with {SQL_NUMBERED} select site as project_id, page_no, url, 200 as http_status, 'pages/' || file as storage_path from numbered""",
)
def crawl_manifests(spark, sf_dir):
    """Manifests of every site, in parts of a thousand pages, written as JSON files and read back with the manifest schema."""
    page = F.struct("page_no", "url", F.lit(200).alias("http_status"), F.concat(F.lit("pages/"), "file").alias("storage_path"))
    manifests = G.with_part(numbered(spark, sf_dir), 1_000).groupBy("site", "part").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    folder = f"{checkpoint_folder(spark)}/manifests-{uuid.uuid4().hex}"
    manifests.select(F.col("site").alias("project_id"), F.col("pages")[0]["page_no"].alias("first_page"), "pages").write.json(folder)
    # One JSON document per line here; manifests crawled as single files use `read_manifests`.
    read = C.read_manifests(spark, folder, multi_line=False)
    return C.manifest_pages(read)


@query(
    "application_tables", "S10",
    sql="select cast(o_orderkey as varchar) as id, cast(o_custkey as varchar) as user_id, o_orderstatus as status, cast(o_orderdate as date) as day from orders where o_orderstatus = 'F'",
)
def application_tables(spark, sf_dir):
    """Orders stored as a projects table and scanned with the declared schema; the filter reaches the files."""
    text = "string"
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast(text).alias("id"), F.col("o_custkey").cast(text).alias("user_id"), F.lit("").alias("source_url"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    root = f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/projects")
    return T.read_table(spark, root, "projects").filter("status = 'F'").select("id", "user_id", "status", F.col("created_at").cast("date").alias("day"))
