"""Cost, usage and estimate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.operators import analytics, costs
from sitelake.operators.costs import Tier
from sitelake.plans.registry import query, table
from sitelake.plans.standins import standin, with_standins

TIERS = (
    Tier("basic", "Basic", 1, True, "Brand#1", 1),
    Tier("pro", "Pro", 2, True, "Brand#3", 2),
    Tier("premium", "Premium", 3, False, "Brand#7", 3),
)
AS_OF = "2001-08-01"

SQL_COSTED = """with_more costed as (
    select u.*, (prompt_tokens * coalesce(prompt_price_per_1m, 0.0) + completion_tokens * coalesce(completion_price_per_1m, 0.0)) / 1000000.0 as cost_usd
    from usage u left join pricing using (model_name))
"""
SQL_SUMS = """cast(sum(prompt_tokens) as bigint) as prompt_tokens, cast(sum(completion_tokens) as bigint) as completion_tokens,
    round(sum(cost_usd), 6) as cost_usd, count(*) as calls"""


def costed_usage(spark, sf_dir):
    return costs.with_cost(standin(spark, sf_dir, "usage"), standin(spark, sf_dir, "pricing"))


def in_range(df, days, column="created_at"):
    return df.filter(costs.since(column, AS_OF, days, "date"))


@query(
    "pricing_overlay", "J3",
    sql="""
    with seed as (select p_brand as model_name, cast(min(p_size) as double) as pp, cast(max(p_size) as double) as cp
                  from part where p_size < 30 and p_brand <> 'Brand#3' group by p_brand),
         over_rows as (select p_brand as model_name, cast(max(p_size) as double) as pp, case when p_brand <> 'Brand#9' then 7.0::double end as cp
                  from part where p_brand not in ('Brand#1', 'Brand#2') group by p_brand)
    select coalesce(o.model_name, s.model_name) as model_name, case when o.model_name is not null then o.pp else s.pp end as prompt_price_per_1m,
        case when o.model_name is not null then o.cp else s.cp end as completion_price_per_1m
    from seed s full join over_rows o on s.model_name = o.model_name""",
)
def pricing_overlay(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "model_name")
    seed = part.filter("p_size < 30 and model_name <> 'Brand#3'").groupBy("model_name").agg(
        F.min("p_size").cast("double").alias("prompt_price_per_1m"), F.max("p_size").cast("double").alias("completion_price_per_1m")
    )
    override = part.filter("model_name not in ('Brand#1', 'Brand#2')").groupBy("model_name").agg(
        F.max("p_size").cast("double").alias("prompt_price_per_1m")
    ).withColumn("completion_price_per_1m", F.when(F.col("model_name") != "Brand#9", F.lit(7.0)))
    return costs.overlay_pricing(seed, override)


@query(
    "usage_costs", "J4", "S7",
    sql=with_standins("usage pricing", SQL_COSTED + "select id, model_name, round(cost_usd, 9) as cost_usd from costed"),
)
def usage_costs(spark, sf_dir):
    return costed_usage(spark, sf_dir).select("id", "model_name", F.round("cost_usd", 9).alias("cost_usd"))


@query(
    "unpriced_models", "J5",
    sql=with_standins("usage pricing", "select distinct model_name from usage where model_name not in (select model_name from pricing)"),
)
def unpriced_models(spark, sf_dir):
    return costs.unpriced_models(standin(spark, sf_dir, "usage"), standin(spark, sf_dir, "pricing"))


@query(
    "cost_by_model", "A1",
    sql=with_standins(
        "usage pricing", SQL_COSTED + f"""select model_name, {SQL_SUMS} from costed
        where created_at >= date '{AS_OF}' - 365 group by model_name""",
    ),
)
def cost_by_model(spark, sf_dir):
    return costs.cost_by(in_range(costed_usage(spark, sf_dir), 365), "model_name").orderBy(F.desc("cost_usd"), "model_name")


@query(
    "cost_by_user", "A2", "T1",
    sql=with_standins(
        "usage pricing users", SQL_COSTED + f""", totals as (select user_id, email, {SQL_SUMS} from costed join users u on u.id = user_id
        where costed.created_at >= date '{AS_OF}' - 365 group by all)
        select *, (select count(*) from totals) as total from totals order by cost_usd desc, user_id limit 25 offset 25""",
    ),
)
def cost_by_user(spark, sf_dir):
    users = standin(spark, sf_dir, "users").select(F.col("id").alias("user_id"), "email")
    # Summed before the e-mail is looked up: the join sees one row per user.
    totals = costs.cost_by(in_range(costed_usage(spark, sf_dir), 365), "user_id").join(users, "user_id")
    return analytics.page_of(totals, [F.desc("cost_usd"), F.asc("user_id")], page=2, size=25)


@query(
    "cost_by_project", "A3", "T1",
    sql=with_standins(
        "usage pricing projects", SQL_COSTED + f""", totals as (select project_id, source_url, {SQL_SUMS} from costed join projects p on p.id = project_id
        where costed.created_at >= date '{AS_OF}' - 300 group by all)
        select *, (select count(*) from totals) as total from totals order by cost_usd desc, project_id limit 40""",
    ),
)
def cost_by_project(spark, sf_dir):
    projects = standin(spark, sf_dir, "projects").select(F.col("id").alias("project_id"), "source_url")
    totals = costs.cost_by(in_range(costed_usage(spark, sf_dir), 300), "project_id").join(projects, "project_id")
    return analytics.page_of(totals, [F.desc("cost_usd"), F.asc("project_id")], page=1, size=40)


@query(
    "usage_by_job", "A4",
    sql=with_standins(
        "usage pricing", SQL_COSTED + """, per_model as (select project_id, model_name, min(struct_pack(created_at, id)) as f, sum(cost_usd) as c
          from costed group by all)
        select project_id as job_id, string_agg(model_name, ',' order by f, model_name) as models, round(sum(c), 6) as cost_usd from per_model group by 1""",
    ),
)
def usage_by_job(spark, sf_dir):
    # One usage row per job in the given tables, so the project stands in as the job here.
    return costs.usage_by_job(costed_usage(spark, sf_dir).withColumn("job_id", F.col("project_id")))


@query(
    "overview", "A5",
    sql=with_standins(
        "users projects usage pricing jobs purchases", SQL_COSTED + f"""
        , r as (select date '{AS_OF}' - 365 as since)
        select u.*, p.*, j.*, c.*, v.*, round(v.revenue_usd_in_range - c.ai_cost_usd_in_range, 6) as net_margin_usd_in_range from
        (select count(*) as users_total, count(*) filter (where created_at >= since) as users_new_in_range,
            cast(sum(balance) as bigint) as credits_outstanding from users, r) u,
        (select count(*) as projects_total, count(*) filter (where created_at >= since) as projects_in_range from projects, r) p,
        (select round(100.0 * count(*) filter (where overall_status = 'succeeded' and created_at >= since)
            / nullif(count(*) filter (where overall_status in ('succeeded', 'failed') and created_at >= since), 0), 1) as generation_success_rate_pct,
            count(*) filter (where overall_status = 'running') as active_jobs_running from jobs, r) j,
        (select round(coalesce(sum(cost_usd) filter (where created_at >= since), 0), 6) as ai_cost_usd_in_range,
            round(coalesce(sum(cost_usd), 0), 6) as ai_cost_usd_all_time from costed, r) c,
        (select coalesce(sum(amount_usd_cents) filter (where created_at >= since), 0) / 100.0 as revenue_usd_in_range,
            coalesce(sum(amount_usd_cents), 0) / 100.0 as revenue_usd_all_time
            from purchases, r where status = 'completed' and source <> 'mock') v""",
    ),
)
def overview(spark, sf_dir):
    return analytics.overview(
        standin(spark, sf_dir, "users"), standin(spark, sf_dir, "projects"), standin(spark, sf_dir, "jobs"),
        costed_usage(spark, sf_dir), standin(spark, sf_dir, "purchases"), AS_OF, 365,
    )


@query(
    "revenue_breakdown", "A6",
    sql=with_standins(
        "purchases", f"""select
        sum(case when created_at >= date '{AS_OF}' - 365 then amount_usd_cents else 0 end) / 100.0 as revenue_usd_in_range,
        sum(amount_usd_cents) / 100.0 as revenue_usd_all_time,
        sum(case when created_at >= date '{AS_OF}' - 365 and source = 'paypal' then amount_usd_cents else 0 end) / 100.0 as paypal_revenue_usd_in_range,
        sum(case when created_at >= date '{AS_OF}' - 365 and source = 'manual_admin' then amount_usd_cents else 0 end) / 100.0 as manual_revenue_usd_in_range,
        count(*) filter (where created_at >= date '{AS_OF}' - 365) as purchase_count_in_range
        from purchases where status = 'completed' and source <> 'mock'""",
    ),
)
def revenue_breakdown(spark, sf_dir):
    return analytics.revenue_breakdown(standin(spark, sf_dir, "purchases"), AS_OF, 365)


@query(
    "success_rate", "A7",
    sql=with_standins(
        "jobs", f"""select tier, round(100.0 * count(*) filter (where overall_status = 'succeeded') / count(*), 1) as success_rate_pct
        from jobs where overall_status in ('succeeded', 'failed') and created_at >= date '{AS_OF}' - 365 group by tier""",
    ),
)
def success_rate(spark, sf_dir):
    jobs = in_range(standin(spark, sf_dir, "jobs"), 365)
    return jobs.groupBy("tier").agg(analytics.success_rate_pct().alias("success_rate_pct")).filter("success_rate_pct is not null")


@query(
    "payment_tiles", "A8",
    sql=with_standins(
        "purchases", f"""select count(*) filter (where status = 'completed' and created_at >= date '{AS_OF}' - 365) as purchases_in_range,
        count(*) filter (where status = 'pending') as pending_purchases,
        count(*) filter (where status = 'refunded' and refunded_at >= date '{AS_OF}' - 365) as refunds_in_range,
        count(distinct user_id) filter (where status = 'completed') as paying_users from purchases where source = 'paypal'""",
    ),
)
def payment_tiles(spark, sf_dir):
    return analytics.payment_tiles(standin(spark, sf_dir, "purchases"), AS_OF, 365)


@query(
    "projects_per_user", "A9",
    sql=with_standins("projects", "select user_id, count(*) as projects from projects group by user_id"),
)
def projects_per_user(spark, sf_dir):
    return standin(spark, sf_dir, "projects").groupBy("user_id").agg(F.count("*").alias("projects"))


SQL_SAMPLES = """
    sizes as (select l_orderkey as project_id, sum(l_partkey % 9000) - 900 as design_chars from lineitem group by 1),
    ranked as (select u.*, j.tier, o.iterations, row_number() over (partition by model_name, tier order by u.created_at desc, u.id desc) as rn
        from usage u join jobs j on j.id = u.job_id join outputs o on o.job_id = u.job_id where purpose = 'generation'),
    samples as (select r.*, design_chars from ranked r left join sizes s using (project_id) where rn <= 20 and prompt_tokens > 0 and design_chars > 0)
"""
SQL_CALIBRATION = """, calib as (
    select model_name, tier, count(*) as samples, case when count(*) >= 3 then avg(design_chars / prompt_tokens) else 4.0 end as chars_per_token,
        case when count(*) >= 3 then greatest(cast(round_even(avg(iterations), 0) as bigint), 1) else 3 end as iterations,
        case when count(*) >= 3 then greatest(cast(round_even(avg(completion_tokens), 0) as bigint), 1) else 6000 end as completion_tokens,
        count(*) >= 3 as calibrated from samples group by model_name, tier)
"""
SQL_ESTIMATE = SQL_CALIBRATION + """, fan as (
    select doc_id as site_id, n_chars, tier, model_name from documents, (values ('basic', 'Brand#1'), ('pro', 'Brand#3')) t(tier, model_name)),
  est as (select site_id, f.tier, f.model_name,
        cast(round_even(n_chars / coalesce(chars_per_token, 4.0), 0) as bigint) * least(coalesce(iterations, 3), 5) as prompt_tokens,
        coalesce(c.completion_tokens, 6000) as completion_tokens
    from fan f left join calib c on c.tier = f.tier and c.model_name = f.model_name),
  priced as (select site_id, tier, prompt_tokens, completion_tokens,
        (prompt_tokens * coalesce(prompt_price_per_1m, 0) + completion_tokens * coalesce(completion_price_per_1m, 0)) / 1000000.0 as cost_usd
    from est left join pricing using (model_name)),
  sites as (select site_id, round(sum(cost_usd), 6) as cost_usd, count(*) as tiers from priced group by site_id)
"""
SAMPLE_TABLES = "usage jobs outputs pricing"


def samples(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("project_id")).agg(
        (F.sum(F.col("l_partkey") % 9000) - 900).alias("design_chars")
    )
    return costs.recent_samples(standin(spark, sf_dir, "usage"), standin(spark, sf_dir, "jobs"), standin(spark, sf_dir, "outputs"), sizes)


def estimates(spark, sf_dir):
    sites = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("site_id"), F.col("n_chars").alias("design_chars"))
    return costs.tier_estimates(sites, TIERS, costs.calibration(samples(spark, sf_dir)), standin(spark, sf_dir, "pricing"), 5)


@query(
    "calibration_samples", "J9", "W10",
    sql=with_standins(SAMPLE_TABLES, f"with_more {SQL_SAMPLES} select id, model_name, tier, cast(rn as int) as rank, iterations, cast(design_chars as bigint) as design_chars from samples"),
)
def calibration_samples(spark, sf_dir):
    return samples(spark, sf_dir).select("id", "model_name", "tier", "rank", "iterations", "design_chars")


@query(
    "calibration", "A10",
    sql=with_standins(
        SAMPLE_TABLES, f"with_more {SQL_SAMPLES} {SQL_CALIBRATION} select model_name, tier, samples, round(chars_per_token, 6) as chars_per_token, iterations, completion_tokens, calibrated from calib",
    ),
)
def calibration(spark, sf_dir):
    return costs.calibration(samples(spark, sf_dir)).withColumn("chars_per_token", F.round("chars_per_token", 6))


@query(
    "tier_estimates", "A11",
    sql=with_standins(SAMPLE_TABLES, f"with_more {SQL_SAMPLES} {SQL_ESTIMATE} select site_id, tier, prompt_tokens, completion_tokens, round(cost_usd, 6) as cost_usd from priced"),
)
def tier_estimates(spark, sf_dir):
    return estimates(spark, sf_dir).select("site_id", "tier", "prompt_tokens", "completion_tokens", F.round("cost_usd", 6).alias("cost_usd"))


@query(
    "site_estimates", "A11",
    sql=with_standins(SAMPLE_TABLES, f"with_more {SQL_SAMPLES} {SQL_ESTIMATE} select * from sites"),
)
def site_estimates(spark, sf_dir):
    return costs.site_estimates(estimates(spark, sf_dir))


@query(
    "cost_gate", "L14",
    sql=with_standins(
        SAMPLE_TABLES, f"""with_more {SQL_SAMPLES} {SQL_ESTIMATE}
        select site_id, 'awaiting_cost_approval' as status, 'basic,pro' as tier from sites where cost_usd > 1.0
        union all select site_id, 'generating', unnest(['basic', 'pro']) from sites where not cost_usd > 1.0""",
    ),
)
def cost_gate(spark, sf_dir):
    return costs.cost_gate(costs.site_estimates(estimates(spark, sf_dir)), TIERS, 1.0)


@query(
    "credit_shortfall", "L15",
    sql=with_standins(
        "users projects", """with_more spent as (select o_orderkey as id, o_custkey, o_totalprice / 1000 as cost from orders)
        select s.id, cast(ceil(cost / 0.5) as bigint) as required_credits,
            greatest(0, cast(ceil(cost / 0.5) as bigint) - u.balance) as shortfall_credits from spent s join users u on u.id = s.o_custkey""",
    ),
)
def credit_shortfall(spark, sf_dir):
    wallets = standin(spark, sf_dir, "users").select(F.col("id").alias("o_custkey"), "balance")
    spent = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), "o_custkey", (F.col("o_totalprice") / 1000).alias("cost_usd")
    )
    return costs.gate_info(spent.join(wallets, "o_custkey"), 0.5).select("id", "required_credits", "shortfall_credits")


@query(
    "run_token_totals", "A24",
    sql="""
    select conv_id as run, cast(sum(case when role = 'assistant' then 0 else length(text) end) as bigint) as prompt_tokens,
        cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as completion_tokens, count(*) as calls
    from conversations group by conv_id""",
)
def run_token_totals(spark, sf_dir):
    size = F.length("text").cast("long")
    answer = F.col("role") == "assistant"
    calls = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run"), F.when(answer, 0).otherwise(size).alias("prompt_tokens"),
        F.when(answer, size).otherwise(0).alias("completion_tokens"),
    )
    return costs.run_totals(calls, "run")
