"""Template, setting, font and message queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.operators import settings as S
from sitelake.plans.palette_and_audit import sql_luminance, sql_ratio
from sitelake.plans.registry import query, table
from sitelake.plans.standins import standin, with_standins
from sitelake.plans.urls_and_text import SQL_EMAIL, SQL_HOST, SQL_NORMAL, SQL_PHONE

CATEGORY = "split_part(filename, '_', 1)"
SQL_ACTIVE = "with_more act as (select filename from templates where filename not in (select filename from template_rows where not is_active))\n"
BOTH = "templates template_rows"


def active(spark, sf_dir):
    return S.active_templates(standin(spark, sf_dir, "templates"), standin(spark, sf_dir, "template_rows"))


@query(
    "template_catalogue", "J12",
    sql=with_standins(BOTH, f"select filename, coalesce(r.category, {CATEGORY.replace('filename', 't.filename')}) as category, coalesce(r.is_active, true) as is_active from templates t left join template_rows r using (filename)"),
)
def template_catalogue(spark, sf_dir):
    return S.template_catalogue(standin(spark, sf_dir, "templates"), standin(spark, sf_dir, "template_rows"))


@query("active_templates", "J13", sql=with_standins(BOTH, SQL_ACTIVE + "select * from act"))
def active_templates(spark, sf_dir):
    return active(spark, sf_dir)


@query("active_categories", "A27", sql=with_standins(BOTH, SQL_ACTIVE + f"select distinct {CATEGORY} as category from act"))
def active_categories(spark, sf_dir):
    return S.active_categories(active(spark, sf_dir))


@query("templates_of_category", "J14", sql=with_standins(BOTH, SQL_ACTIVE + f"select filename from act where lower({CATEGORY}) = 'blue'"))
def templates_of_category(spark, sf_dir):
    return S.narrow_to_category(active(spark, sf_dir), "BLUE")


@query("templates_of_unknown_category", "J14", sql=with_standins(BOTH, SQL_ACTIVE + "select filename from act"))
def templates_of_unknown_category(spark, sf_dir):
    return S.narrow_to_category(active(spark, sf_dir), "nothing-like-it")


@query(
    "template_choice", "W12",
    sql=with_standins(BOTH, SQL_ACTIVE + """, n as (select filename, row_number() over (order by filename) - 1 as draw, count(*) over () as total from act)
      select o_orderkey as run_id, case when o_orderkey % 50 = 0 then 'override.txt' else filename end as template
      from orders join n on n.draw = ('0x' || left(md5('seed1' || o_orderkey), 8))::bigint % n.total"""),
)
def template_choice(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 50 == 0, "override.txt").alias("override"))
    return S.choose_templates(runs, active(spark, sf_dir), "seed1")


DEFAULTS = {"Brand#1": 1.5, "Brand#2": 0.5, "Brand#99": 4.0, "Brand#5": 9.0}


@query(
    "setting_values", "J11",
    sql="""with s as (select p_brand as key, case when p_brand = 'Brand#2' then 0.0 else max(p_retailprice) end as value from part group by p_brand)
      select d.key, coalesce(s.value, d.v) as value from (values ('Brand#1', 1.5::double), ('Brand#2', 0.5), ('Brand#99', 4.0), ('Brand#5', 9.0)) d(key, v) left join s using (key)""",
)
def setting_values(spark, sf_dir):
    stored = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.max("p_retailprice").alias("value"))
    return S.setting_values(stored.withColumn("value", F.when(F.col("key") == "Brand#2", 0.0).otherwise(F.col("value"))), DEFAULTS)


@query(
    "model_overrides", "J11",
    sql="""select p_partkey, coalesce(case when p_size % 3 = 0 then p_brand when p_size % 3 = 1 then '' end, 'base') as tier_model,
        coalesce(nullif(case when p_size % 3 = 0 then p_brand when p_size % 3 = 1 then '' end, ''), 'base') as vision_model from part""",
)
def model_overrides(spark, sf_dir):
    chosen = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, "")
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.model_or_default(chosen, "base").alias("tier_model"), S.model_or_default(chosen, "base", True).alias("vision_model"))


@query(
    "setting_upsert", "M5",
    sql="""with a as (select 'k' || p_partkey % 120 as key, p_retailprice as value, timestamp '2023-01-01' as ts, p_partkey as id from part
        union all select 'k' || cast(json_extract_string(props, '$.k') as bigint), value, ts, event_id from events)
      select key, value, ts, id from a qualify row_number() over (partition by key order by ts desc, id desc) = 1""",
)
def setting_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "part").select(
        F.concat(F.lit("k"), (F.col("p_partkey") % 120).cast("string")).alias("key"), F.col("p_retailprice").alias("value"),
        F.expr("timestamp_ntz'2023-01-01'").alias("ts"), F.col("p_partkey").alias("id"))
    updates = table(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("key"), "value", "ts", F.col("event_id").alias("id"))
    return S.upsert(base, updates, "key", ["ts", "id"])


FONTS = "array('inter tight', ' Open Sans ', 'Pawtastic', '', null, 'ROBOTO', 'baloo 2')"
SQL_FONTS = "['inter tight', ' Open Sans ', 'Pawtastic', '', null, 'ROBOTO', 'baloo 2']"
SQL_CANON = "case lower(trim({0})) when 'inter tight' then 'Inter Tight' when 'open sans' then 'Open Sans' when 'roboto' then 'Roboto' when 'baloo 2' then 'Baloo 2' end"


@query("font_names", "J18", sql=f"select p_partkey, coalesce({SQL_CANON.format('f')}, 'Inter') as font from (select p_partkey, {SQL_FONTS}[1 + p_partkey % 7] as f from part) t")
def font_names(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", F.expr(f"element_at({FONTS}, cast(1 + p_partkey % 7 as int))").alias("f"))
    return named.select("p_partkey", S.normalize_font(F.col("f"), F.lit(S.DEFAULT_BODY_FONT)).alias("font"))


@query(
    "site_meta_merge", "M4", "J18",
    sql=f"""with b as (select p_partkey as site, p_name as site_name, '' as tagline, p_type as tone, {SQL_FONTS}[1 + p_size % 7] as f, p_brand from part),
      p as (select p_partkey as site, case when p_size % 2 = 0 then '' else 'New ' || p_name end as n, 'Tag' as t, null as tone, {SQL_FONTS}[1 + p_partkey % 7] as f from part where p_partkey % 3 <> 0)
      select site, coalesce(nullif(p.n, ''), site_name) as site_name, coalesce(p.t, tagline) as tagline, b.tone, b.p_brand as site_category,
        coalesce({SQL_CANON.format('p.f')}, {SQL_CANON.format('b.f')}, 'Inter Tight') as heading_font, coalesce({SQL_CANON.format('p.f')}, {SQL_CANON.format('b.f')}, 'Inter') as body_font
      from b left join p using (site)""",
)
def site_meta_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part")

    def font(column: str):
        return F.expr(f"element_at({FONTS}, cast(1 + {column} % 7 as int))")

    base = part.select(F.col("p_partkey").alias("site"), F.col("p_name").alias("site_name"), F.lit("").alias("tagline"), F.col("p_type").alias("tone"),
                       F.col("p_brand").alias("site_category"), font("p_size").alias("heading_font"), font("p_size").alias("body_font"))
    offered = part.filter("p_partkey % 3 <> 0").select(
        F.col("p_partkey").alias("site"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("New "), "p_name")).alias("site_name"),
        F.lit("Tag").alias("tagline"), F.lit(None).cast("string").alias("tone"), F.lit("").alias("site_category"),
        font("p_partkey").alias("heading_font"), font("p_partkey").alias("body_font"))
    return S.merge_meta(base, offered, "site")


@query(
    "compact_messages", "P24",
    sql="""select conv_id, turn, role, case when role = 'assistant' and length(text) > 300 and turn < max(turn) over (partition by conv_id) and not starts_with(text, '(compacted')
        then '(compacted -- ' || length(text) || ' chars previously returned here; call the tool again if you need the current content)' else text end as text from conversations""",
)
def compact_messages(spark, sf_dir):
    return S.compact_messages(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "assistant")


@query(
    "column_functions", "F2", "P8", "P9", "P18", "A21",
    sql="""select p_partkey, case when s = '' then 'section' else s end as slug, cents from (
      select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as s, cast(round(p_retailprice * 100) as bigint) as cents from part) t""",
)
def column_functions(spark, sf_dir):
    from sitelake.functions.sql import register_functions

    register_functions(spark)
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "site_slugify(p_name) as slug", "site_to_cents(cast(p_retailprice as string)) as cents")


@query(
    "address_functions", "F2", "P1",
    sql=f"""select page_id, {SQL_HOST} as authority, {SQL_NORMAL} as address from pages""",
)
def address_functions(spark, sf_dir):
    from sitelake.functions.sql import register_functions

    register_functions(spark)
    return table(spark, sf_dir, "pages").selectExpr("page_id", "site_authority(url) as authority", "site_normalize_url(url) as address")


@query(
    "contact_functions", "F2", "P9",
    sql=rf"""select doc_id, regexp_extract(text, '{SQL_EMAIL}', 0) as email, trim(regexp_extract(text, '{SQL_PHONE}', 0)) as phone from documents""",
)
def contact_functions(spark, sf_dir):
    from sitelake.functions.sql import register_functions

    register_functions(spark)
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "site_first_email(text) as email", "site_first_phone(text) as phone")


SQL_TONES = "t as (select p_partkey, printf('#%02x%02x%02x', (p_partkey % 256)::int, (p_size * 5 % 256)::int, (p_partkey * 7 % 256)::int) as x, '#f0f4f8' as y from part)"


@query("contrast_functions", "F2", "A21", sql=f"with {SQL_TONES} select p_partkey, round({sql_luminance('x')}, 6) as luminance, round({sql_ratio('x', 'y')}, 6) as contrast from t")
def contrast_functions(spark, sf_dir):
    from sitelake.functions.sql import register_functions

    register_functions(spark)
    tone = "format_string('#%02x%02x%02x', cast(p_partkey % 256 as int), cast(p_size * 5 % 256 as int), cast(p_partkey * 7 % 256 as int))"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{tone} as x")
    return rows.selectExpr("p_partkey", "round(site_luminance(x), 6) as luminance", "round(site_contrast(x, '#f0f4f8'), 6) as contrast")


@query(
    "element_table_function", "F3", "X1",
    sql="""select tag, count(*) as n from (select unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '<script>', 'gs'), '<([a-z][a-z0-9]*)', 1)) as tag from pages) t
      where tag not in ('html', 'body') group by tag""",
)
def element_table_function(spark, sf_dir):
    from sitelake.functions.sql import register_functions

    register_functions(spark)
    pages = table(spark, sf_dir, "pages")
    return spark.sql("""select tag, count(*) as n from page_elements(table(select page_id, html from {pages}), '')
        where tag not in ('html', 'body') group by tag""", pages=pages)
