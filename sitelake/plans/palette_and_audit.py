"""Palette, contrast and quality-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.functions import color as C, urls
from sitelake.operators import audit, elements as E, palette as P
from sitelake.plans.page_sections import decorated
from sitelake.plans.pages_and_links import numbered
from sitelake.plans.registry import query, table
from sitelake.plans.urls_and_text import SQL_HOST
from sitelake.sources import documents as D

STYLES = """select p_brand as site, p_partkey, 'a{{color:#' || left(md5(p_name), 6) || '}} b{{color:#' || upper(left(md5(p_type), 3)) || '}} c{{background:rgb('
    || cast(p_partkey % 300 as varchar(5)) || ', ' || cast(p_size * 5 as varchar(5)) || ',' || cast(p_partkey % 90 as varchar(5)) || ')}}' as css from {part}"""


def styles(spark, sf_dir, part=None):
    return spark.sql(STYLES, part=part if part is not None else table(spark, sf_dir, "part"))


SQL_HOST_PARTS = f"host_parts as (select part.* exclude (p_brand), {SQL_HOST} as p_brand from part join pages on page_id = p_partkey % 50)"


def host_parts(spark, sf_dir):
    """The part table with page hosts as brands, so that styles and scripts derived from it belong to the sites of the page corpus."""
    hosts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), urls.authority("url").alias("host"))
    part = table(spark, sf_dir, "part")
    return part.join(hosts, F.col("k") == F.col("p_partkey") % 50).withColumn("p_brand", F.col("host")).select(*part.columns)


def sql_channel(c: str, i: int) -> str:
    return f"('0x' || substr({c}, {2 + 2 * i}, 2))::int / 255.0"


SQL_VIVID = f"""(select c as color, greatest(r, g, b) as hi, least(r, g, b) as lo from (select c, {sql_channel('c', 0)} as r, {sql_channel('c', 1)} as g, {sql_channel('c', 2)} as b
    from (select distinct color as c from lit) d) e)"""
SQL_VIVID_CTE = f"""vivid as (select color from {SQL_VIVID} v where (hi + lo) / 2 between 0.08 and 0.92 and
      case when hi = lo then 0 when (hi + lo) / 2 <= 0.5 then (hi - lo) / (hi + lo) else (hi - lo) / (2.0 - hi - lo) end >= 0.15)"""
SQL_ROLES = """top as (select site, max(color) filter (where rn = 1) as c1, max(color) filter (where rn = 2) as c2, max(color) filter (where rn = 3) as c3 from ranked group by site),
  pal as (select site, c1 as "primary", coalesce(c2, c1) as secondary, coalesce(c3, c2, c1) as accent from top)"""
SQL_PALETTE = f"""lit as (
    select p_brand as site, 0 as kind, '#' || left(md5(p_name), 6) as color, 0 as pos from part
    union all select p_brand, 0, regexp_replace('#' || left(md5(p_type), 3), '([0-9a-f])', '\\1\\1', 'g'), 1 from part
    union all select p_brand, 1, printf('#%02x%02x%02x', p_partkey % 300, p_size * 5, p_partkey % 90), 0 from part where p_partkey % 300 <= 255 and p_size * 5 <= 255),
  {SQL_VIVID_CTE},
  counted as (select site, color, count(*) as n, min((kind, pos)) as f from lit group by all),
  ranked as (select c.*, row_number() over (partition by site order by n desc, f, color) as rn from counted c join vivid using (color)),
  {SQL_ROLES}"""


def sql_luminance(c: str) -> str:
    parts = []
    for weight, i in ((0.2126, 0), (0.7152, 1), (0.0722, 2)):
        v = f"({sql_channel(c, i)})"
        parts.append(f"{weight} * case when {v} <= 0.03928 then {v} / 12.92 else pow(({v} + 0.055) / 1.055, 2.4) end")
    return "(" + " + ".join(parts) + ")"


def sql_ratio(a: str, b: str) -> str:
    return f"(greatest({sql_luminance(a)}, {sql_luminance(b)}) + 0.05) / (least({sql_luminance(a)}, {sql_luminance(b)}) + 0.05)"


def ordered_palettes(spark, sf_dir):
    return P.css_palettes(styles(spark, sf_dir), ["site"], "css")


@query("brand_palettes", "A12", sql=f"with recursive {SQL_PALETTE} select * from pal")
def brand_palettes(spark, sf_dir):
    return ordered_palettes(spark, sf_dir)


SQL_HISTOGRAM = """hist as (select vec_id as site, printf('#%02x%02x%02x', cast(floor((least(greatest(embedding[i], -0.5), 0.5) + 0.5) * 255) as int),
      cast(floor((least(greatest(embedding[i + 1], -0.5), 0.5) + 0.5) * 255) as int), cast(floor((least(greatest(embedding[i + 2], -0.5), 0.5) + 0.5) * 255) as int)) as color,
      1 + i * 7 % 50 as n from embeddings, (select unnest([1, 4, 7, 10, 13, 16, 19, 22, 25, 28, 31, 34, 37, 40, 43, 46, 49, 52, 55, 58, 61, 62]) as i) s),
  lit as (select * from hist),
  counted as (select site, color, sum(n) as n from hist group by all),
  {vivid},
  common as (select *, row_number() over (partition by site order by n desc, color) as place from counted),
  ranked as (select c.site, c.color, row_number() over (partition by site order by place) as rn from common c join vivid using (color) where place <= 8),
  {roles}""".format(vivid=SQL_VIVID_CTE, roles=SQL_ROLES)


@query("image_palettes", "A13", sql=f'with recursive {SQL_HISTOGRAM} select site as vec_id, "primary", secondary, accent from pal')
def image_palettes(spark, sf_dir):
    return P.image_palettes(pixels(spark, sf_dir), "vec_id")


def pixels(spark, sf_dir):
    """All components of the embeddings, three at a time, read as counted colours."""
    starts = F.explode(F.array(*[F.lit(i) for i in (*range(1, 62, 3), 62)])).alias("i")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", starts)

    def level(offset: int):
        # In single precision, as the components are: a double would cut some products at another whole number.
        v, half, steps = F.element_at("embedding", F.col("i") + offset), F.lit(0.5).cast("float"), F.lit(255).cast("float")
        return F.floor((F.least(F.greatest(v, -half), half) + half) * steps)

    return rows.select("vec_id", level(0).alias("r"), level(1).alias("g"), level(2).alias("b"), (1 + F.col("i") * 7 % 50).alias("n"))


@query(
    "palette_fallback", "A14",
    sql=f"""with recursive {SQL_PALETTE}, w as (select distinct p_brand as site from part),
      img as (select p_brand as site, '#102030' as c from part where p_brand in ('Brand#3', 'Brand#4') group by 1)
      select w.site, coalesce(case when w.site not in ('Brand#3', 'Brand#5') then pal."primary" end, img.c, '#333333') as "primary",
        coalesce(case when w.site not in ('Brand#3', 'Brand#5') then pal.accent end, img.c, '#0066cc') as accent
      from w left join pal on pal.site = w.site left join img on img.site = w.site""",
)
def palette_fallback(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    css = ordered_palettes(spark, sf_dir).filter("site not in ('Brand#3', 'Brand#5')")
    one = F.lit("#102030")
    image = part.filter("p_brand in ('Brand#3', 'Brand#4')").select(F.col("p_brand").alias("site")).distinct().select(
        "site", one.alias("primary"), one.alias("secondary"), one.alias("accent"))
    sites = part.select(F.col("p_brand").alias("site")).distinct()
    return P.with_palette(sites, css, image).select("site", "colors.primary", "colors.accent")


@query(
    "contrast_audit", "A21",
    sql=f"""with recursive {SQL_PALETTE}, pairs as (
        select site, 'primary text on secondary background' as label, "primary" as x, secondary as y from pal
        union all select site, 'accent on secondary background', accent, secondary from pal union all select site, 'primary on accent', "primary", accent from pal)
      select site, label, round({sql_ratio('x', 'y')}, 6) as ratio, {sql_ratio('x', 'y')} < 4.5 as low from pairs""",
)
def contrast_audit(spark, sf_dir):
    colors = F.struct("primary", "secondary", "accent")
    rows = ordered_palettes(spark, sf_dir).select("site", F.explode(P.contrast_pairs(colors)).alias("p"))
    return rows.select("site", "p.label", F.round("p.ratio", 6).alias("ratio"), (F.col("p.ratio") < C.CONTRAST_MINIMUM).alias("low"))


def style_files(spark, sf_dir, part=None):
    """Style and script files per brand, with class names, gaps and order derived from the part table."""
    n, size = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.lit("r"), (size % 5).cast("string"))
    state = F.concat(F.lit("is-on"), (n % 4).cast("string"))
    css = F.concat(
        F.lit("."), name, F.when(size % 3 == 0, "{opacity:0;}").when(size % 3 == 1, "{ visibility : hidden ; }").otherwise("{opacity:0.5;}"),
        F.when(n % 7 == 0, F.concat(F.lit(" ."), name, F.lit("."), state, F.lit("{opacity:1}"))).otherwise(""))
    js = F.concat(
        F.lit("document.querySelectorAll('."), name, F.lit("');"), F.repeat(F.lit(" "), size * 120), F.lit("el.classList."),
        F.when(n % 2 == 0, "add").otherwise("toggle"), F.lit("('"), state, F.lit("');"))
    rows = (part if part is not None else table(spark, sf_dir, "part")).select(
        F.col("p_brand").alias("site"), F.explode(F.array(
            F.struct(F.format_string("s%03d.css", n % 3).alias("file"), F.lit("css").alias("kind"), css.alias("body"), n.alias("n")),
            F.struct(F.format_string("j%09d.js", n).alias("file"), F.lit("js").alias("kind"), js.alias("body"), n.alias("n")))).alias("f")).select("site", "f.*")
    # Three style files per brand, each the rules of a third of the parts.
    sheets = rows.filter("kind = 'css'").groupBy("site", "file").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "body"))), lambda r: r["body"]), "\n").alias("body"))
    return sheets, rows.filter("kind = 'js'").select("site", "file", "body")


SQL_STYLE = """rules as (select p_brand as site, printf('s%03d.css', p_partkey % 3) as file, 'r' || p_size % 5 as name, p_size % 3 < 2 as hides,
      case when p_partkey % 7 = 0 then 'is-on' || p_partkey % 4 end as combined from part),
  hidden as (select distinct site, file, name as hidden from rules where hides),
  js as (select p_brand as site, p_partkey, 'r' || p_size % 5 as q, 'is-on' || p_partkey % 4 as a, p_size * 120 as gap,
      length('document.querySelectorAll(''.r0'');') + p_size * 120 + length('el.classList.') + case when p_partkey % 2 = 0 then 3 else 6 end + length('(''is-on0'');') + 1 as len from part),
  placed as (select *, sum(len) over (partition by site order by p_partkey) - len as base from js),
  ev as (select site, base + 9 as pos, q, null::varchar as a from placed union all select site, base + length('document.querySelectorAll(''.r0'');') + gap + 3, null::varchar, a from placed),
  best as (select e.site, h.file, e.pos, e.a, arg_max(h.hidden, q.pos) as hidden from ev e join ev q on q.site = e.site and q.q is not null and q.pos < e.pos and e.pos - q.pos <= 3000
      join hidden h on h.site = e.site and h.hidden = q.q where e.a is not null group by all),
  pairs as (select distinct site, file, hidden, a as reveal from best where hidden <> a)
"""


@query("hidden_classes", "A22", sql=f"with {SQL_STYLE} select * from hidden")
def hidden_classes(spark, sf_dir):
    return audit.hidden_classes(style_files(spark, sf_dir)[0])


@query("reveal_pairs", "J19", sql=f"with {SQL_STYLE} select * from pairs")
def reveal_pairs(spark, sf_dir):
    sheets, scripts = style_files(spark, sf_dir)
    return audit.reveal_pairs(scripts, audit.hidden_classes(sheets))


@query(
    "reveal_gaps", "J20",
    sql=f"""with {SQL_STYLE} select site, file, hidden, reveal, '.' || hidden || '.' || reveal || '{{opacity:1 !important;visibility:visible !important;transform:none !important}}' as fix
      from pairs p where not exists (select 1 from rules r where r.site = p.site and r.file = p.file and r.name = p.hidden and r.combined = p.reveal)""",
)
def reveal_gaps(spark, sf_dir):
    sheets, scripts = style_files(spark, sf_dir)
    return audit.reveal_gaps(audit.reveal_pairs(scripts, audit.hidden_classes(sheets)), sheets)


@query(
    "quality_report", "A19",
    sql=f"""with recursive {SQL_HOST_PARTS}, {SQL_STYLE.replace('from part', 'from host_parts')}, {SQL_PALETTE.replace('from part', 'from host_parts')},
      gaps as (select site, count(*) as n from pairs p where not exists (select 1 from rules r where r.site = p.site and r.file = p.file and r.name = p.hidden and r.combined = p.reveal) group by site),
      tones as (select site, "primary" as x, secondary as y from pal union all select site, accent, secondary from pal union all select site, "primary", accent from pal),
      low as (select site, count(*) as n from tones where {sql_ratio('x', 'y')} < 4.5 group by site),
      f as (select site, count(*) as files, count(*) * 3 as alt_added, count(*) as tags_added from (select {SQL_HOST} as site from pages) t group by site)
      select f.*, coalesce(gaps.n, 0)::int as reveal_fixes, coalesce(low.n, 0)::int as contrast_warnings,
        f.site in (select {SQL_HOST} from pages group by 1 having count(*) > 1) as sitemap_written
      from f left join gaps on gaps.site = f.site left join low on low.site = f.site""",
)
def quality_report(spark, sf_dir):
    files = numbered(spark, sf_dir).select("page_id", "site", "file")
    pages = E.with_elements(decorated(spark, sf_dir)).join(files, "page_id")
    part = host_parts(spark, sf_dir)
    sheets, scripts = style_files(spark, sf_dir, part)
    gaps = audit.reveal_gaps(audit.reveal_pairs(scripts, audit.hidden_classes(sheets)), sheets)
    pairs = P.css_palettes(styles(spark, sf_dir, part), ["site"], "css").select("site", F.explode(P.contrast_pairs(F.struct("primary", "secondary", "accent"))).alias("p"))
    warnings = pairs.filter(F.col("p.ratio") < C.CONTRAST_MINIMUM).groupBy("site").agg(F.collect_list("p.label").alias("warnings"))  # at most three
    # Sitemaps are written for sites of several pages.
    several = numbered(spark, sf_dir).join(files.groupBy("site").agg(F.count("*").alias("n")).filter("n > 1"), "site", "left_semi")
    report = audit.audit_report(pages, gaps, warnings, D.sitemaps(several))
    return report.withColumns({c: F.col(c).cast("int") for c in ("reveal_fixes", "contrast_warnings")})


@query(
    "alt_text_fixes", "P20", "A19",
    sql="""select page_id, unnest(range(0, 3)) as pos, unnest(['Image', 'Logo', 'None']) as alt from pages""",
)
def alt_text_fixes(spark, sf_dir):
    fixes = audit.missing_alt(E.with_elements(decorated(spark, sf_dir)))
    return fixes.select("page_id", F.col("pos").cast("long").alias("pos"), "alt")


@query(
    "failure_signatures", "A23",
    sql="""with t as (select user_id as run, 'sig' || cast(json_extract_string(props, '$.k') as bigint) % 3 as signature, event_id as seq from events where event_type = 'error'),
      n as (select *, row_number() over (partition by run, signature order by seq) as rn from t)
      select run, signature, count(*) as failures, max(seq) filter (where rn = 5) as aborted_at, count(*) >= 5 as aborted from n group by all""",
)
def failure_signatures(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long") % 3
    trace = table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.col("user_id").alias("run"), F.concat(F.lit("sig"), k.cast("string")).alias("signature"), F.col("event_id").alias("seq"))
    return audit.failure_signatures(trace)
