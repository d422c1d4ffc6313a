"""Job, project and queue queries."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelake.operators import analytics, costs, jobs as J, ledger as L
from sitelake.operators.skew import first_n_per_key
from sitelake.plans.costs_and_usage import TIERS, SQL_COSTED, costed_usage
from sitelake.plans.registry import query, table
from sitelake.plans.standins import standin, with_standins
from sitelake.session import Steps, checkpoint_folder

SQL_NEWEST = """with_more newest as (select * from jobs where scope = 'preview'
    qualify row_number() over (partition by project_id, tier order by created_at desc, id desc) = 1)
"""
SQL_TIERS = "(values ('basic', 1), ('pro', 2)) t(tier, sort_order)"
SNAPSHOTS = """select cast(l_orderkey as varchar(20)) || '-' || cast(l_partkey as varchar(20)) || '-' || cast(l_linenumber as varchar(20))
      || '-' || cast(l_suppkey as varchar(20)) as id,
    l_orderkey as project_id, l_linenumber as page_count,
    case when l_returnflag <> 'R' then cast(l_shipdate as date) end as finished_at from {lineitem}"""


def jobs(spark, sf_dir):
    return standin(spark, sf_dir, "jobs")


def snapshots(spark, sf_dir):
    return spark.sql(SNAPSHOTS, lineitem=table(spark, sf_dir, "lineitem"))


@query("newest_previews", "W1", sql=with_standins("jobs", SQL_NEWEST + "select project_id, tier, id, overall_status, failure_reason from newest"))
def newest_previews(spark, sf_dir):
    return J.preview_outcomes(jobs(spark, sf_dir))


@query(
    "latest_tiers", "W2",
    sql=with_standins("jobs", "select project_id, tier as latest_tier from jobs qualify row_number() over (partition by project_id order by created_at desc, id desc) = 1"),
)
def latest_tiers(spark, sf_dir):
    return J.latest_tier(jobs(spark, sf_dir))


@query(
    "projects_of_tier", "W3",
    sql=with_standins("jobs projects", """with_more l as (select project_id, tier from jobs
        qualify row_number() over (partition by project_id order by created_at desc, id desc) = 1)
        select id, source_url from projects where id in (select project_id from l where tier = 'pro')"""),
)
def projects_of_tier(spark, sf_dir):
    return J.projects_with_tier(standin(spark, sf_dir, "projects"), jobs(spark, sf_dir), "pro").select("id", "source_url")


@query(
    "projects_ever_of_tier", "W3",
    sql=with_standins("jobs projects", "select id, source_url from projects where id in (select project_id from jobs where tier = 'pro')"),
)
def projects_ever_of_tier(spark, sf_dir):
    return J.projects_with_tier(standin(spark, sf_dir, "projects"), jobs(spark, sf_dir), "pro", latest_only=False).select("id", "source_url")


@query(
    "finished_outputs", "W4",
    sql=with_standins("jobs outputs", f"""with_more good as (select j.*, template_used from jobs j join outputs o on o.job_id = j.id
        where scope = 'preview' and overall_status = 'succeeded'
        qualify row_number() over (partition by project_id, tier order by created_at desc, id desc) = 1)
        select project_id, g.tier, id, template_used, cast(coalesce(sort_order - 1, 2) as int) as display_position
        from good g left join {SQL_TIERS} on t.tier = g.tier"""),
)
def finished_outputs(spark, sf_dir):
    return J.finished_outputs(jobs(spark, sf_dir), standin(spark, sf_dir, "outputs"), TIERS)


SQL_PAGES = f"""pc as (select project_id, page_count from ({SNAPSHOTS.replace('{lineitem}', 'lineitem')}) s
    qualify row_number() over (partition by project_id order by finished_at desc nulls first, id desc) = 1),
  fs as (select project_id, tier, id, overall_status from jobs where scope = 'full_site'
    qualify row_number() over (partition by project_id, tier order by created_at desc, id desc) = 1)"""


@query("latest_page_counts", "W5", sql=with_standins("jobs", f"with_more {SQL_PAGES} select project_id, page_count from pc"))
def latest_page_counts(spark, sf_dir):
    return J.latest_page_count(snapshots(spark, sf_dir))


@query("latest_full_site_jobs", "W5", sql=with_standins("jobs", f"with_more {SQL_PAGES} select * from fs"))
def latest_full_site_jobs(spark, sf_dir):
    return J.latest_full_site_job(jobs(spark, sf_dir))


@query(
    "download_plans", "L16",
    sql=with_standins("jobs projects", f"""with_more {SQL_PAGES}
        select p.id as project_id, coalesce(page_count, 1) as page_count, case when coalesce(page_count, 1) <= 1 then 'fast_path'
            when overall_status is null then 'start_build' when overall_status = 'running' then 'already_building'
            when overall_status = 'succeeded' then 'fast_path' else 'start_build' end as plan
        from projects p left join pc on pc.project_id = p.id left join fs on fs.project_id = p.id and fs.tier = 'pro'"""),
)
def download_plans(spark, sf_dir):
    return J.download_plans(standin(spark, sf_dir, "projects"), snapshots(spark, sf_dir), jobs(spark, sf_dir), "pro")


@query(
    "blueprint_versions", "W6",
    sql="""select o_orderkey as id, o_custkey as project_id,
        row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version,
        lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) is null as is_current from orders""",
)
def blueprint_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created_at")
    )
    return J.versions(rows).select("id", "project_id", "version", "is_current")


@query(
    "first_proposals", "W9",
    sql="""select l_orderkey, l_partkey, l_suppkey, cast(rn as int) as rank from (select *, row_number() over (
        partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem) t where rn <= 5""",
)
def first_proposals(spark, sf_dir):
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return first_n_per_key(rows, ["l_orderkey"], order, 5).drop("l_linenumber")


@query(
    "queue_backlog", "W14",
    sql=with_standins("queued_jobs", "select id, row_number() over (order by created_at, id) as backlog_position from queued_jobs where status = 'queued'"),
)
def queue_backlog(spark, sf_dir):
    return J.queue_order(standin(spark, sf_dir, "queued_jobs")).select("id", "backlog_position")


@query(
    "queue_timing", "W14",
    sql=with_standins("queued_jobs", """select task_name, count(*) as jobs, round(avg((started_at - created_at) * 86400), 6) as avg_wait,
        quantile_cont((started_at - created_at) * 86400, 0.5) as median_wait, round(avg((finished_at - started_at) * 86400), 6) as avg_run,
        quantile_cont((finished_at - started_at) * 86400, 0.95) as p95_run from queued_jobs group by task_name"""),
)
def queue_timing(spark, sf_dir):
    return J.queue_timing(standin(spark, sf_dir, "queued_jobs"))


@query(
    "project_status", "L12",
    sql=with_standins("jobs projects", SQL_NEWEST + f"""select p.id as project_id, case
            when count(*) filter (where n.overall_status in ('succeeded', 'failed')) < 2 then 'generating'
            when bool_or(coalesce(n.overall_status = 'succeeded', false)) then 'ready' else 'failed' end as status
        from projects p, {SQL_TIERS} left join newest n on n.project_id = p.id and n.tier = t.tier group by p.id"""),
)
def project_status(spark, sf_dir):
    return J.project_status(standin(spark, sf_dir, "projects"), jobs(spark, sf_dir), TIERS)


@query(
    "tiers_settled", "U1",
    sql=with_standins("jobs", SQL_NEWEST + """select project_id, count(distinct tier) filter (
        where tier in ('basic', 'pro') and overall_status in ('succeeded', 'failed')) = 2 as covered from newest group by project_id"""),
)
def tiers_settled(spark, sf_dir):
    return J.all_tiers_settled(jobs(spark, sf_dir), TIERS)


@query(
    "tier_lists", "L13",
    sql=with_standins("jobs", SQL_NEWEST + f"""select project_id,
        coalesce(string_agg(n.tier || ':' || failure_reason, ',' order by sort_order) filter (where overall_status = 'failed'), '') as failed_tiers,
        coalesce(string_agg(n.tier, ',' order by sort_order) filter (where overall_status = 'running'), '') as running_tiers
        from newest n join {SQL_TIERS} on t.tier = n.tier group by project_id"""),
)
def tier_lists(spark, sf_dir):
    return J.tier_lists(jobs(spark, sf_dir), TIERS)


@query(
    "retryable_tiers", "L18",
    sql=with_standins("jobs", SQL_NEWEST + "select project_id, tier, failure_reason from newest where overall_status = 'failed' and tier in ('basic', 'pro')"),
)
def retryable_tiers(spark, sf_dir):
    return J.retryable(jobs(spark, sf_dir), TIERS)


@query(
    "missing_output_files", "J21",
    sql=with_standins("outputs", """with_more files as (select job_id, unnest(case when iterations % 3 = 0 then ['index.html', 'style.css']
            when iterations % 3 = 1 then ['index.html', 'script.js'] else ['script.js'] end) as file from outputs)
        select o.job_id, r.file from outputs o, (values ('index.html'), ('style.css')) r(file)
        where not exists (select 1 from files f where f.job_id = o.job_id and f.file = r.file)"""),
)
def missing_output_files(spark, sf_dir):
    outputs = standin(spark, sf_dir, "outputs")
    written = F.expr("""case iterations % 3 when 0 then array('index.html', 'style.css') when 1 then array('index.html', 'script.js')
        else array('script.js') end""")
    files = outputs.select("job_id", F.explode(written).alias("file"))
    return J.missing_files(outputs, files, ["index.html", "style.css"])


SQL_LISTING = """with_more l as (select project_id, tier as latest_tier from jobs
    qualify row_number() over (partition by project_id order by created_at desc, id desc) = 1),
  listing as (select p.id, u.email, p.status, p.source_url, p.created_at, latest_tier from projects p join users u on u.id = p.user_id
    left join l on l.project_id = p.id)"""


@query(
    "project_listing", "J7", "P26", "T1",
    sql=with_standins("projects users jobs", SQL_LISTING + """, f as (select * from listing where status = 'ready' and source_url ilike '%SITE-1%')
        select *, (select count(*) from f) as total from f order by created_at desc, id limit 50 offset 50"""),
)
def project_listing(spark, sf_dir):
    from sitelake.functions.text import search_filter

    # Filters sit on the project columns, so they run before both joins.
    wanted = standin(spark, sf_dir, "projects").filter((F.col("status") == "ready") & search_filter("source_url", "SITE-1"))
    listing = J.project_listing(wanted, standin(spark, sf_dir, "users"), jobs(spark, sf_dir))
    shown = listing.select("id", "email", "status", "source_url", "created_at", "latest_tier")
    return analytics.page_of(shown, [F.desc("created_at"), F.asc("id")], page=2, size=50)


@query(
    "project_detail", "J23",
    sql=with_standins("projects users jobs outputs usage pricing", SQL_COSTED + """, c as (select job_id, round(sum(cost_usd), 6) as cost_usd from costed group by 1),
        b as (select project_id, arg_max(id, (finished_at, id)) as blueprint_id, count(*) as blueprint_version from (select id, project_id, finished_at from (""" + SNAPSHOTS.replace("{lineitem}", "lineitem") + """) s where finished_at is not null) t group by 1),
        paid as (select user_id, project_id, string_agg(distinct tier, ',' order by tier) as paid_tiers from (
            select l_suppkey % 5 + o_custkey - o_custkey % 5 as user_id, l_orderkey as project_id, case l_linenumber % 3 when 0 then 'basic' when 1 then 'pro' else 'premium' end as tier
            from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'A') t group by 1, 2)
        select p.id as project_id, p.user_id, p.source_url, p.status, u.email, b.blueprint_id, b.blueprint_version, paid.paid_tiers,
            j.id as job_id, j.tier, j.overall_status, j.created_at as job_created_at, o.template_used, c.cost_usd
        from projects p join users u on u.id = p.user_id left join jobs j on j.project_id = p.id left join outputs o on o.job_id = j.id
        left join c on c.job_id = j.id left join b on b.project_id = p.id left join paid on paid.user_id = p.user_id and paid.project_id = p.id"""),
)
def project_detail(spark, sf_dir):
    steps = Steps(spark, "job-costs")  # written, so that the disk does not hold what usage was moved by beside what jobs are moved by
    costs = steps.write("costs", costed_usage(spark, sf_dir).select("job_id", "cost_usd"))
    per_job = costs.groupBy("job_id").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    blueprints = snapshots(spark, sf_dir).filter("finished_at is not null").select("id", "project_id", F.col("finished_at").alias("created_at"))
    # Download charges of wallets, of which some are not the owner's: those never show.
    bought = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    tier = F.when(F.col("l_linenumber") % 3 == 0, "basic").when(F.col("l_linenumber") % 3 == 1, "pro").otherwise("premium")
    owner = F.col("l_suppkey") % 5 + F.col("o_custkey") - F.col("o_custkey") % 5
    ledger = bought.select(
        F.lit("download_spend").alias("reason"), F.concat_ws(":", F.lit("download_spend"), "l_orderkey", tier).alias("idempotency_key"),
        F.col("l_orderkey").alias("related_project_id"), owner.alias("wallet_id"))
    wallets = standin(spark, sf_dir, "users").select(F.col("id").alias("wallet_id"), F.col("id").alias("user_id"))
    detail = J.project_detail(
        standin(spark, sf_dir, "projects"), standin(spark, sf_dir, "users"), jobs(spark, sf_dir), standin(spark, sf_dir, "outputs"), per_job,
        J.current_versions(blueprints), L.paid_tiers(ledger, wallets),
    )
    steps.drop("costs")
    return detail


@query(
    "project_page_deep", "T1",
    sql=with_standins("projects", "select id, user_id, status, created_at from projects order by created_at desc, id limit 50 offset 2450"),
)
def project_page_deep(spark, sf_dir):
    """Page 50 of all projects, from a listing kept in ranges."""
    order = [F.desc("created_at"), F.asc("id")]
    rows = standin(spark, sf_dir, "projects").select("id", "user_id", "status", "created_at")
    return analytics.Listing(rows, order, f"{checkpoint_folder(spark)}/listing-{uuid.uuid4().hex}").page(50, 50)


@query(
    "project_page_next", "T1",
    sql=with_standins("projects", """select id, user_id, status, created_at from projects where created_at < date '1996-06-01'
        or (created_at = date '1996-06-01' and id > 1000) order by created_at desc, id limit 50"""),
)
def project_page_next(spark, sf_dir):
    """The page after a known row."""
    rows = standin(spark, sf_dir, "projects").select("id", "user_id", "status", "created_at")
    return analytics.page_after(rows, [("created_at", False), ("id", True)], (datetime.date(1996, 6, 1), 1000), 50)


@query(
    "queue_timing_sketches", "W14",
    sql=with_standins("queued_jobs", """with_more w as (select task_name, cast((started_at - created_at) * 86400 as bigint) as v from queued_jobs where started_at is not null),
      r as (select task_name, list_sort(list(v)) as vs, len(list(v)) as n from w group by 1)
      select task_name, n as waits, vs[greatest(1, ceil((0.5 - 0.02) * n)::int)] as least, vs[least(n, ceil((0.5 + 0.02) * n)::int)] as greatest, true as within from r"""),
)
def queue_timing_sketches(spark, sf_dir):
    """Median waits from sketches by task and day, and whether they lie within the stated error of the exact ranks."""
    jobs = standin(spark, sf_dir, "queued_jobs")
    median = J.sketched_quantiles(J.wait_sketches(jobs), [0.5]).select("task_name", "waits", F.col("quantiles")[0].alias("median"))
    n = F.col("waits")
    ranks = [F.greatest(F.lit(1), F.ceil(F.round((0.5 - J.SKETCH_ERROR) * n, 6))), F.least(n, F.ceil(F.round((0.5 + J.SKETCH_ERROR) * n, 6)))]
    waits = jobs.filter("started_at is not null").groupBy("task_name", J.wait_seconds().alias("v")).agg(F.count("*").alias("m"))
    upto = waits.withColumn("upto", F.sum("m").over(Window.partitionBy("task_name").orderBy("v"))).join(median, "task_name")
    exact = upto.groupBy("task_name", "waits", "median").agg(*(
        F.min(F.when(F.col("upto") >= r, F.col("v"))).alias(name) for name, r in zip(("least", "greatest"), ranks)))
    return exact.select("task_name", "waits", "least", "greatest", F.col("median").between(F.col("least"), F.col("greatest")).alias("within"))
