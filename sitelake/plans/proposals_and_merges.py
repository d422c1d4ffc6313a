"""Proposal verification and guarded-merge queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.functions import text as X
from sitelake.operators import proposals as R
from sitelake.plans.pages_and_links import SQL_NUMBERED, numbered
from sitelake.plans.registry import query, table
from sitelake.plans.urls_and_text import SQL_SPACE

LINES = """select doc_id, lang, source, filter(transform(split(text, '\\n'), x -> trim(x)), x -> x <> '') as ls, text from {documents}"""
SQL_LINES = """d as (select doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls, text from documents)"""
SQL_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-')"


def lines(spark, sf_dir):
    return spark.sql(LINES, documents=table(spark, sf_dir, "documents"))


SQL_GAPS = f"""{SQL_LINES},
  t as (select doc_id, trim(regexp_replace(text, '{SQL_SPACE}', ' ', 'g')) as t from documents),
  g as (select doc_id, unnest(range(1, len(ls) + 1)) as pos, unnest(ls) as line from d),
  p as (select doc_id, pos, case pos % 3 when 0 then replace(line, ' ', '  ') when 1 then line else reverse(line) end as quote,
      case when pos % 4 = 0 then '' else 'Note ' || pos % 2 end as title, case when pos % 2 = 0 then 'hours' end as category from g where pos <= 5),
  v as (select p.*, trim(regexp_replace(quote, '{SQL_SPACE}', ' ', 'g')) as body, case when title = '' then 'Additional Content' else title end as label from p),
  ok as (select v.* from v join t using (doc_id) where length(body) between 15 and 600 and contains(t.t, body))"""


def gaps(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", F.posexplode("ls").alias("i", "line"))
    pos = (F.col("i") + 1).cast("long")
    quote = F.when(pos % 3 == 0, F.replace("line", F.lit(" "), F.lit("  "))).when(pos % 3 == 1, F.col("line")).otherwise(F.reverse("line"))
    return rows.select(
        "doc_id", pos.alias("pos"), quote.alias("quote"), F.when(pos % 4 == 0, "").otherwise(F.concat(F.lit("Note "), (pos % 2).cast("string"))).alias("title"),
        F.when(pos % 2 == 0, "hours").alias("category"))


def verified(spark, sf_dir):
    # Quotes are looked up in the whole text; clipping it is for model prompts.
    texts = table(spark, sf_dir, "documents").select("doc_id", X.collapse_whitespace("text").alias("text"))
    return R.verified_gaps(gaps(spark, sf_dir), texts, "doc_id")


@query(
    "verified_quotes", "J15", "F4",
    sql=f"""with {SQL_GAPS} select doc_id, pos, case when category is not null then label || ' (' || category || ')' else label end as title, body from ok""",
)
def verified_quotes(spark, sf_dir):
    return verified(spark, sf_dir).select("doc_id", "pos", "title", "body")


@query(
    "gap_keys", "W11",
    sql=f"""with recursive {SQL_GAPS},
      b as (select doc_id, pos, 'gap-' || {SQL_SLUG.format('label')} as base, row_number() over (partition by doc_id order by pos) as n from ok),
      f as (select doc_id, 0::bigint as n, case when doc_id % 2 = 0 then ['gap-note-1', 'gap-note-1-2'] else ['misc'] end as used, null::bigint as pos, null::varchar as key from (select distinct doc_id from b) x
        union all
        select f.doc_id, b.n, list_append(f.used, k.key), b.pos, k.key from f join b on b.doc_id = f.doc_id and b.n = f.n + 1,
          lateral (select case when not list_contains(f.used, b.base) then b.base when not list_contains(f.used, b.base || '-2') then b.base || '-2'
            when not list_contains(f.used, b.base || '-3') then b.base || '-3' when not list_contains(f.used, b.base || '-4') then b.base || '-4'
            else b.base || '-5' end as key) k)
      select doc_id, pos, key from f where n > 0""",
)
def gap_keys(spark, sf_dir):
    existing = table(spark, sf_dir, "documents").select("doc_id", F.expr(
        "if(doc_id % 2 = 0, array('gap-note-1', 'gap-note-1-2'), array('misc'))").alias("keys"))
    return R.unique_gap_keys(verified(spark, sf_dir), existing, "doc_id")


@query(
    "field_merge", "M1",
    sql=f"""with {SQL_LINES}, b as (select doc_id, coalesce(ls[1], '') as headline, source as subheadline, 'img' || doc_id as image from d)
      select doc_id, case when doc_id % 3 = 2 then 'New ' || doc_id else headline end as headline,
        case when doc_id % 5 in (0, 1) and doc_id % 3 <> 0 then 'Sub ' || doc_id else subheadline end as subheadline, image from b""",
)
def field_merge(spark, sf_dir):
    docs = lines(spark, sf_dir)
    base = docs.select("doc_id", F.coalesce(F.try_element_at("ls", F.lit(1)), F.lit("")).alias("headline"), F.col("source").alias("subheadline"),
                       F.concat(F.lit("img"), F.col("doc_id").cast("string")).alias("image"))
    number = F.col("doc_id").cast("string")
    offered = docs.filter("doc_id % 3 <> 0").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 2, F.concat(F.lit("New "), number)).otherwise("").alias("headline"),
        F.when(F.col("doc_id") % 5 < 2, F.concat(F.lit("Sub "), number)).alias("subheadline"), F.lit("evil.png").alias("image"))
    return R.merge_fields(base, offered, "doc_id", ["headline", "subheadline"])


@query(
    "list_replace", "M2",
    sql=f"""with {SQL_LINES} select doc_id, case doc_id % 4 when 1 then 0 when 2 then least(len(ls), 2) else len(ls) end as n,
        md5(array_to_string(case doc_id % 4 when 1 then [] when 2 then ls[1:2] else ls end, '|')) as digest from d""",
)
def list_replace(spark, sf_dir):
    docs = lines(spark, sf_dir)
    offered = docs.filter("doc_id % 4 <> 3").select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.array().cast("array<string>")).when(
        F.col("doc_id") % 4 == 2, F.slice("ls", 1, 2)).alias("p"))
    merged = docs.join(offered, "doc_id", "left").select("doc_id", R.replace_list(F.col("p"), F.col("ls")).alias("m"))
    return merged.select("doc_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join("m", "|")).alias("digest"))


@query(
    "section_fill", "M3",
    sql="""select doc_id, case when lang = 'en' then '' else lang end as about, coalesce(nullif(case when lang = 'en' then '' else lang end, ''), source) as merged from documents""",
)
def section_fill(spark, sf_dir):
    from sitelake.operators.blueprint import fill_empty

    def section(body):
        return F.struct(F.lit("").alias("heading"), body.alias("body"))

    docs = table(spark, sf_dir, "documents").withColumn("first", section(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")))).withColumn(
        "second", section(F.col("source")))
    merged = fill_empty({"about": F.col("first")}, {"about": F.col("second")})["about"]
    return docs.select("doc_id", F.col("first.body").alias("about"), merged["body"].alias("merged"))


SQL_ITEMS = f"""{SQL_LINES}, base as (select doc_id, unnest(range(1, len(ls) + 1)) as pos, left(unnest(ls), 8) as title, len(ls) as n from d),
  prop as (select doc_id, pos, case when pos % 4 = 0 then 'renamed' else '  ' || lower(title) end as title, n - case when doc_id % 2 = 0 then 1 else 0 end as n
    from base where not (doc_id % 2 = 0 and pos = n))"""


def items(spark, sf_dir):
    docs = lines(spark, sf_dir)
    base = F.transform("ls", lambda line, i: F.struct(
        F.left(line, F.lit(8)).alias("title"), F.lit("").alias("description"), F.concat(F.lit("i"), (i + 1).cast("string")).alias("icon_image")))
    offered = F.transform(F.slice("ls", 1, F.size("ls") - F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0)), lambda line, i: F.struct(
        F.when((i + 1) % 4 == 0, "renamed").otherwise(F.concat(F.lit("  "), F.lower(F.left(line, F.lit(8))))).alias("title"), F.lit("").alias("description")))
    return docs.filter("size(ls) > 1").select("doc_id", base.alias("base"), offered.alias("offered"))


@query(
    "icon_carry_over", "J17",
    sql=f"""with {SQL_ITEMS}, m as (select p.doc_id, p.pos, max(b.pos) as hit from prop p left join base b on b.doc_id = p.doc_id and lower(trim(b.title)) = lower(trim(p.title)) group by all)
      select p.doc_id, p.pos, case when hit is not null then 'i' || hit when p.n = b.n then 'i' || p.pos end as icon
      from prop p join m using (doc_id, pos) join base b using (doc_id, pos) where b.n > 1""",
)
def icon_carry_over(spark, sf_dir):
    from sitelake.operators.elements import computed_once

    both = computed_once(items(spark, sf_dir), {"base": F.col("base"), "offered": F.col("offered")})
    rows = both.select("doc_id", F.posexplode(R.carry_icons(F.col("offered"), F.col("base"))).alias("i", "s"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), F.col("s.icon_image").alias("icon"))


@query(
    "known_sections", "J16",
    sql="""select doc_id, key, case when doc_id % 3 = 0 then 'T ' || source else 'New' end as title, 'img-' || source as image
      from (select doc_id, source, case when doc_id % 2 = 0 then source else 'invented' end as key from documents) t where key = source""",
)
def known_sections(spark, sf_dir):
    base = F.array(F.struct(
        F.col("source").alias("key"), F.concat(F.lit("T "), "source").alias("title"), F.lit("b").alias("body"),
        F.array(F.concat(F.lit("img-"), "source")).alias("images")))
    offered = F.array(F.struct(
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("invented").alias("key"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("New").alias("title"),
        F.lit("p").alias("body"), F.lit(None).cast("array<string>").alias("items")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(R.known_sections(offered, base)).alias("s"))
    return rows.select("doc_id", "s.key", "s.title", F.element_at("s.images", 1).alias("image"))


@query(
    "appended_sections", "U2", "M3",
    sql=f"""with {SQL_GAPS} select doc_id, -1 as pos, source as title, 0 as source_order from documents
      union all select doc_id, pos, case when category is not null then label || ' (' || category || ')' else label end, 1 from ok""",
)
def appended_sections(spark, sf_dir):
    existing = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).cast("long").alias("pos"), F.col("source").alias("title"))
    return R.append_sections(existing, verified(spark, sf_dir).select("doc_id", "pos", "title"), "doc_id")


@query(
    "page_subset", "U3",
    sql=f"with {SQL_NUMBERED} select page_id, site, case page_no when 3 then 1 when 0 then 2 else 3 end as place from numbered where page_no in (3, 0, 2)",
)
def page_subset(spark, sf_dir):
    return R.pages_in_order(numbered(spark, sf_dir), [3, 0, 2]).select("page_id", "site", F.col("place").cast("int").alias("place"))


@query("reviewed_blueprints", "M1", "M2", "J16", "J17", "F4")
def reviewed_blueprints(spark, sf_dir):
    from sitelake.plans.page_sections import blueprints

    pages = blueprints(spark, sf_dir)
    offered = table(spark, sf_dir, "pages").select(F.col("url").alias("page_url"), F.expr("""from_json(
        concat('{"hero":{"headline":"Reviewed ', page_id, '","subheadline":""},"services":[],"additional":[{"key":"invented","title":"x"}]}'),
        'hero struct<headline:string,subheadline:string,cta_text:string,cta_href:string>, about struct<heading:string,body:string>,
         services array<struct<title:string,description:string>>, faq array<struct<question:string,answer:string>>,
         cta struct<heading:string,body:string,cta_text:string,cta_href:string>,
         additional array<struct<key:string,title:string,body:string,items:array<string>>>')""").alias("p"), "page_id").groupBy("page_url").agg(F.max_by("p", "page_id").alias("p")).select("page_url", "p.*")
    merged = R.merge_reviews(pages, offered)
    return merged.select("page_id", "sections.hero.headline", F.size("sections.services_features").alias("services"), F.size("sections.additional_sections").alias("additional"))
