"""Projection and filter queries: URLs, text rules, codecs and status maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.functions import money, status, text, urls
from sitelake.plans.registry import query, table
from sitelake.plans.standins import standin, with_standins

# Shared pieces of the SQL checks.
SQL_PREFIX = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"
SQL_HOST = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
SQL_PATH = rf"rtrim(regexp_extract(url, '{SQL_PREFIX}([^?#]*)', 1), '/')"
SQL_NORMAL = (
    r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || '://' || "
    rf"{SQL_HOST} || case when {SQL_PATH} = '' then '/' else {SQL_PATH} end"
)
SQL_SPACE = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SQL_EMAIL = r"[\p{L}\p{M}\p{Nd}_.\-]+@[\p{L}\p{M}\p{Nd}_.\-]+\.[\p{L}\p{M}\p{Nd}_]+"
SQL_PHONE = (
    r"(\+?\p{Nd}{1,2}[\s\x{A0}]?)?\(?\p{Nd}{3}\)?[\s\x{A0}.-]?\p{Nd}{3}[\s\x{A0}.-]?\p{Nd}{4}"
)

HREFS_SQL = """
    select event_id as id, case event_id % 10
        when 0 then '#top' when 1 then 'mailto:u' || cast(user_id as varchar(20)) || '@example.com'
        when 2 then '/p/' || cast(user_id as varchar(20)) when 3 then ' javascript:void(0)' when 4 then ''
        when 5 then 'https://www.Facebook.com/p' || cast(user_id as varchar(20)) when 6 then 'tel:555-0100'
        when 7 then '#' when 8 then 'https://example.org/about?x=' || cast(user_id as varchar(20))
        else 'JavaScript:go()' end as href
    from {events}"""


def hrefs(spark, sf_dir):
    return spark.sql(HREFS_SQL, events=table(spark, sf_dir, "events"))


HREFS = HREFS_SQL.replace("{events}", "events")


@query("url_normalise", "P1", "S1", sql=f"select page_id, {SQL_NORMAL} as normalized from pages")
def url_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url("url").alias("normalized"))


@query(
    "link_resolve", "P2",
    sql=r"""
    select page_id, href, regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) || href as absolute
    from (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages) t""",
)
def link_resolve(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href")
    )
    return links.select("page_id", "href", urls.resolve_url("url", "href").alias("absolute"))


@query(
    "crawlable_links", "P3",
    sql=f"""
    select id, href from ({HREFS}) t
    where trim(href) <> '' and not regexp_matches(trim(href), '^(#|mailto:|tel:|javascript:)')""",
)
def crawlable_links(spark, sf_dir):
    return hrefs(spark, sf_dir).filter(urls.is_crawlable_href("href"))


@query(
    "same_origin_links", "P4",
    sql=f"""
    select page_id, candidate, {SQL_HOST} = regexp_extract(candidate, '//([^/?#]*)', 1) as same_origin
    from (select page_id, url, 'https://' || case when page_id % 2 = 0 then {SQL_HOST} else upper({SQL_HOST}) end || '/x' as candidate
          from pages) t""",
)
def same_origin_links(spark, sf_dir):
    host = urls.authority("url")
    candidate = F.concat(F.lit("https://"), F.when(F.col("page_id") % 2 == 0, host).otherwise(F.upper(host)), F.lit("/x"))
    pages = table(spark, sf_dir, "pages").withColumn("candidate", candidate)
    return pages.select("page_id", "candidate", urls.same_origin("url", "candidate").alias("same_origin"))


@query(
    "navigation_links", "P5",
    sql=f"""
    select id, href from ({HREFS}) t
    where trim(href) <> '' and not regexp_matches(lower(trim(href)), '^(tel:|mailto:|javascript:)')
      and not regexp_matches(lower(href),
        'facebook\\.com|instagram\\.com|twitter\\.com|x\\.com|linkedin\\.com|youtube\\.com|tiktok\\.com|pinterest\\.com')""",
)
def navigation_links(spark, sf_dir):
    return hrefs(spark, sf_dir).filter(urls.is_nav_href("href"))


@query(
    "action_links", "P6",
    sql=f"""
    select id, href from ({HREFS}) t
    where trim(href) not in ('', '#') and not starts_with(lower(trim(href)), 'javascript:')""",
)
def action_links(spark, sf_dir):
    return hrefs(spark, sf_dir).filter(urls.is_action_href("href"))


@query(
    "visible_text_clip", "P7",
    sql=rf"""
    select doc_id, length(t) as n, md5(case when length(t) > 12000
        then left(t, 6000) || ' ...[truncated]... ' || right(t, 6000) else t end) as digest
    from (select doc_id, trim(regexp_replace(text, '{SQL_SPACE}', ' ', 'g')) as t from documents) d""",
)
def visible_text_clip(spark, sf_dir):
    flat = table(spark, sf_dir, "documents").select("doc_id", text.collapse_whitespace("text").alias("t"))
    return flat.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(text.clip_middle("t")).alias("digest"))


@query(
    "slugs", "P8",
    sql="""
    select kind, id, case when slug = '' then 'section' else slug end as slug from (
      select kind, id, trim(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '-') as slug from (
        select 'part' as kind, p_partkey as id, p_name || ' & ' || p_brand as raw from part
        union all select 'document', doc_id, text from documents) a) b""",
)
def slugs(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.concat_ws(" & ", "p_name", "p_brand").alias("raw")
    )
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    return parts.unionByName(docs).select("kind", "id", text.slugify("raw").alias("slug"))


@query(
    "contact_details", "P9",
    sql=rf"""
    select doc_id, email, phone from (
      select doc_id, regexp_extract(text, '{SQL_EMAIL}', 0) as email, trim(regexp_extract(text, '{SQL_PHONE}', 0)) as phone
      from documents) t where email <> '' or phone <> ''""",
)
def contact_details(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(
        "doc_id", text.first_email("text").alias("email"), text.first_phone("text").alias("phone")
    )
    return found.filter("email <> '' or phone <> ''")


@query(
    "asset_names", "P13",
    sql=f"""
    select page_id, left(sha1(url), 8) || '-' || case when {SQL_PATH} = '' then 'asset'
        else list_extract(string_split({SQL_PATH}, '/'), -1) end as name from pages""",
)
def asset_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.asset_file_name("url").alias("name"))


@query(
    "fetch_messages", "P14",
    sql="""
    select event_id, code, case
        when code < 400 then null
        when code in (401, 403) then 'This site blocked automated access to this page. It may have bot-protection enabled that prevents crawling, even though nothing else appears to be wrong with the site.'
        when code = 404 then 'This page could not be found. Please double-check the URL and try again.'
        when code between 500 and 599 then 'This site''s server returned an error. Please try again later.'
        else 'This site returned an unexpected error (HTTP ' || code || ').' end as message
    from (select event_id, 200 + event_id * 7 % 420 as code from events) t""",
)
def fetch_messages(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", (200 + F.col("event_id") * 7 % 420).alias("code"))
    return log.withColumn("message", status.fetch_message(F.col("code")))


PATHS_SQL = """
    select p_partkey as id, case p_partkey % 7 when 0 then 'images/' || p_name when 1 then '../' || p_name when 2 then '/etc/' || p_name
        when 3 then 'a/../' || p_name when 4 then 'a/../../' || p_name when 5 then './b//c/../../..' else 'a/b/../../..' end as rel
    from {part}"""


@query(
    "safe_paths", "P16",
    sql=f"""
    select id, rel, not starts_with(rel, '/') and
        list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))) >= 0 as inside
    from (select id, rel, list_transform(string_split(rel, '/'),
            lambda p: case when p in ('', '.') then 0 when p = '..' then -1 else 1 end) as steps
          from ({PATHS_SQL.replace("{part}", "part")}) p) s""",
)
def safe_paths(spark, sf_dir):
    paths = spark.sql(PATHS_SQL, part=table(spark, sf_dir, "part"))
    return paths.withColumn("inside", urls.stays_inside_root("rel"))


@query(
    "asset_token_rewrite", "P17",
    sql="""
    select p_partkey, regexp_replace(regexp_replace(doc, '(href|src)="([^"?]*\\?[^"]*)"', '\\1="\\2&preview_token=t1"', 'g'),
        '(href|src)="([^"?]+)"', '\\1="\\2?preview_token=t1"', 'g') as html
    from (select p_partkey, '<link href="' || p_name || '.css"><img src="images/' || p_partkey || '.png?v=' || p_size || '">' as doc
          from part) t""",
)
def asset_token_rewrite(spark, sf_dir):
    doc = F.concat(
        F.lit('<link href="'), "p_name", F.lit('.css"><img src="images/'), "p_partkey", F.lit(".png?v="), "p_size", F.lit('">')
    )
    return table(spark, sf_dir, "part").select("p_partkey", urls.add_asset_token(doc, "t1").alias("html"))


@query(
    "money_parsing", "P18",
    sql="""
    select o_orderkey, raw, cents, case when cents is not null then printf('%d.%02d', cents // 100, cents % 100) end as shown
    from (select o_orderkey, raw, case when c = floor(c) then cast(c as bigint) end as cents
      from (select o_orderkey, raw, try_cast(raw as decimal(24, 8)) * 100 as c
        from (select o_orderkey, case o_orderkey % 6 when 0 then cast(o_orderkey as varchar) || '.345' when 1 then 'n/a'
                when 2 then cast(o_orderkey as varchar) else cast(o_totalprice as varchar) end as raw from orders) a) b) c""",
)
def money_parsing(spark, sf_dir):
    kind = F.col("o_orderkey") % 6
    raw = (
        F.when(kind == 0, F.concat(F.col("o_orderkey").cast("string"), F.lit(".345")))
        .when(kind == 1, "n/a").when(kind == 2, F.col("o_orderkey").cast("string")).otherwise(F.col("o_totalprice").cast("string"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return orders.withColumn("cents", money.to_cents("raw")).withColumn("shown", F.when(F.col("cents").isNotNull(), money.format_amount("cents")))


@query(
    "question_split", "P19",
    sql="""
    select doc_id, case when pos > 0 then trim(substr(t, 1, pos - 1)) || '?' else t end as question,
        md5(case when pos > 0 then trim(substr(t, pos + 1)) else '' end) as answer_digest, left(t, 60) as short_title
    from (select doc_id, t, strpos(t, '?') as pos from (select doc_id, replace(text, ',', '?') as t from documents) a) b""",
)
def question_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(","), F.lit("?")).alias("t"))
    parts = docs.withColumn("qa", text.split_question("t"))
    return parts.select(
        "doc_id", "qa.question", F.md5("qa.answer").alias("answer_digest"), F.left("t", F.lit(60)).alias("short_title")
    )


@query(
    "alt_text_fallback", "P20",
    sql=r"""
    select p_partkey, case when t = '' then 'Image' else t end as alt from (
      select p_partkey, array_to_string(list_transform(list_filter(string_split_regex(
          regexp_replace(regexp_replace(stem, '^[0-9a-f]{6,8}-', ''), '-\d+x\d+$', ''), '[-_]+'),
          lambda w: w <> '' and not regexp_matches(w, '^\d+$')), lambda w: upper(w[1]) || lower(w[2:])), ' ') as t
      from (select p_partkey, case when p_partkey % 5 = 0 then left(md5(p_name), 8) || '-' || p_partkey || '-300x200'
              else left(md5(p_name), 8) || '-' || replace(p_name, ' ', '_') || '-' || p_size || '-300x200' end as stem from part) a) b""",
)
def alt_text_fallback(spark, sf_dir):
    tail = F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey").cast("string")).otherwise(
        F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size").cast("string"))
    )
    src = F.concat(F.lit("images/"), F.left(F.md5("p_name"), F.lit(8)), F.lit("-"), tail, F.lit("-300x200.png"))
    return table(spark, sf_dir, "part").select("p_partkey", text.fallback_alt_text(src).alias("alt"))


@query(
    "template_names", "P21",
    sql=r"""
    select p_partkey, name, category || '_' || name || '_prompt.txt' as filename,
        case when strpos(name, '_') > 0 then left(name, strpos(name, '_') - 1) else name end as inferred,
        array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(name, '(?i:_prompt)$', ''), '[_-]+'), lambda w: w <> ''),
            lambda w: upper(w[1]) || w[2:]), ' ') as label
    from (select p_partkey, lower(p_type) as category,
            case when regexp_full_match(stripped, '[A-Za-z0-9_-]{1,64}') then stripped end as name
          from (select p_partkey, p_type, regexp_replace(trim(case p_partkey % 3 when 0 then p_name || '.txt'
                  when 1 then replace(p_name, ' ', '_') || '_prompt.TXT' else ' ' || replace(p_name, ' ', '-') || ' ' end), '\.(?i:txt)$', '')
                  as stripped from part) a) b""",
)
def template_names(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    raw = (
        F.when(kind == 0, F.concat("p_name", F.lit(".txt")))
        .when(kind == 1, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_prompt.TXT")))
        .otherwise(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" ")))
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("category"), text.template_name(raw).alias("name"))
    return parts.select(
        "p_partkey", "name", text.template_file_name("category", "name").alias("filename"),
        text.template_category("name").alias("inferred"), text.template_label("name").alias("label"),
    )


@query(
    "download_keys", "P22",
    sql="""
    select p_partkey, key, case when starts_with(key, prefix) and substr(key, length(prefix) + 1) <> ''
        then substr(key, length(prefix) + 1) end as tier
    from (select p_partkey, 'download_spend:' || p_partkey || ':' || case when p_size % 5 = 0 then '' else p_type end as key,
            'download_spend:' || (p_partkey + case when p_size % 7 = 0 then 1 else 0 end) || ':' as prefix from part) t""",
)
def download_keys(spark, sf_dir):
    tier = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type"))
    parts = table(spark, sf_dir, "part").withColumn("key", text.download_key("p_partkey", tier))
    asked = F.col("p_partkey") + F.when(F.col("p_size") % 7 == 0, 1).otherwise(0)
    return parts.select("p_partkey", "key", text.tier_of_download_key("key", asked).alias("tier"))


STATUS_LIST = "pending crawling crawled extracting_blueprint blueprint_ready generating awaiting_cost_approval ready failed rejected other".split()


@query(
    "status_stages", "P23",
    sql="""
    select o_orderkey, case k when 0 then 'crawling' when 1 then 'crawling' when 2 then 'extracting' when 3 then 'extracting'
        when 4 then 'generating' when 5 then 'generating' when 6 then 'awaiting_approval' when 7 then 'ready'
        when 8 then 'error' when 9 then 'error' else 'crawling' end as stage,
        case when k in (0, 1, 10) then 33 when k in (2, 3, 6) then 67 when k in (4, 5, 7) then 100 else 0 end as percent,
        k in (7, 8, 9) as terminal
    from (select o_orderkey, o_orderkey % 11 as k from orders) t""",
)
def status_stages(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(s) for s in STATUS_LIST]), (F.col("o_orderkey") % 11 + 1).cast("int"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("status"))
    s = F.col("status")
    return orders.select(
        "o_orderkey", status.stage_of(s).alias("stage"), status.stage_percent(s).alias("percent"), status.is_terminal(s).alias("terminal")
    )


@query(
    "recent_events", "P25", "S9",
    sql="""
    select cast(ts as date) as day, event_type, count(*) as n from events
    where ts >= timestamp '2024-01-31 00:00:00' - interval 7 day group by all""",
)
def recent_events(spark, sf_dir):
    from sitelake.operators.costs import since

    recent = table(spark, sf_dir, "events").filter(since("ts", "2024-01-31", 7))
    return recent.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(
    "search_users", "P26",
    sql=with_standins("users", "select id, email from users where email ilike '%ER#0000001%' and segment = 'BUILDING'"),
)
def search_users(spark, sf_dir):
    wanted = text.search_filter("email", " ER#0000001 ") & (F.col("segment") == "BUILDING")
    return standin(spark, sf_dir, "users").filter(wanted).select("id", "email")


@query(
    "failure_messages", "P27",
    sql="""
    select event_id, case when k % 9 < 6 then 'detail ' || k else 'Something went wrong.' end as message
    from (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_type = 'error') t""",
)
def failure_messages(spark, sf_dir):
    kinds = [*status.SHOWN_KINDS, "KeyError", "OSError", "ValueError"]
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("k") % 9 + 1).cast("int"))
    message = status.shown_message(kind, F.concat(F.lit("detail "), F.col("k").cast("string")), "Something went wrong.")
    return errors.select("event_id", message.alias("message"))


@query(
    "row_rules", "P28",
    sql="""
    select id, rule from (
      select id, unnest([case when length(trim(name)) not between 1 and 64 then 'name_length' end,
        case when credits < 1 then 'credits_minimum' end, case when price < 1 then 'price_minimum' end,
        case when cost < 1 then 'download_cost_minimum' end]) as rule
      from (select p_partkey as id, case when p_size % 9 = 0 then '  ' when p_size % 10 = 0 then repeat(p_name, 12) else p_name end as name,
              p_size - 3 as credits, p_size % 4 as price, p_size % 6 as cost from part) a) b where rule is not null""",
)
def row_rules(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(size % 9 == 0, "  ").when(size % 10 == 0, F.repeat("p_name", F.lit(12))).otherwise(F.col("p_name")).alias("name"),
        (size - 3).alias("credits"), (size % 4).alias("price"), (size % 6).alias("cost"),
    )
    rules = {
        "name_length": ~F.length(F.trim("name")).between(1, 64),
        "credits_minimum": F.col("credits") < 1,
        "price_minimum": F.col("price") < 1,
        "download_cost_minimum": F.col("cost") < 1,
    }
    return rows.select("id", F.explode(status.broken_rules(rules)).alias("rule"))
