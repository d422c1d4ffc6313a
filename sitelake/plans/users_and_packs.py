"""User, identity and credit-pack queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.operators import accounts as A, analytics
from sitelake.plans.costs_and_usage import TIERS
from sitelake.plans.registry import query, table
from sitelake.plans.standins import standin, with_standins


def wallets_of(users):
    return users.filter("id % 5 <> 0").select(F.col("id").alias("user_id"), "balance")


@query(
    "user_listing", "J8", "T1",
    sql=with_standins("users projects", """with_more f as (select u.id, u.email, case when u.id % 5 <> 0 then u.balance else 0 end as balance,
            coalesce(n, 0) as projects, u.created_at
          from users u left join (select user_id, count(*) as n from projects group by 1) c on c.user_id = u.id where u.email ilike '%#00000%')
        select *, (select count(*) from f) as total from f order by created_at desc, id limit 25"""),
)
def user_listing(spark, sf_dir):
    users = standin(spark, sf_dir, "users")
    wanted = users.filter(F.col("email").ilike("%#00000%")).select("id", "email", "created_at")
    listing = A.user_listing(wanted, wallets_of(users), standin(spark, sf_dir, "projects"))
    return analytics.page_of(listing, [F.desc("created_at"), F.asc("id")], page=1, size=25)


@query(
    "user_detail", "J24",
    sql=with_standins("users projects purchases ledger", """
        select u.id as user_id, u.email, u.balance, kind, ref, amount, day from users u join (
          select wallet_id as user_id, 'ledger' as kind, id::varchar as ref, amount, created_at::date as day from ledger
          union all select user_id, 'purchase', id::varchar, credits_granted, created_at from purchases
          union all select user_id, 'project', id::varchar, null, created_at from projects
            qualify row_number() over (partition by user_id order by created_at desc, id desc) <= 100) r on r.user_id = u.id"""),
)
def user_detail(spark, sf_dir):
    ledger = standin(spark, sf_dir, "ledger").withColumn("user_id", F.col("wallet_id"))
    return A.user_detail(standin(spark, sf_dir, "users"), ledger, standin(spark, sf_dir, "purchases"), standin(spark, sf_dir, "projects"))


CLAIMS = """select c_custkey as claim_id, 'google' as provider, 'sub-' || cast(c_custkey as varchar(20)) as subject, c_custkey % 7 <> 0 as verified,
    case when c_custkey % 4 = 0 then 'new' || cast(cast(floor(c_custkey / 8) as bigint) as varchar(20)) || '@example.com' else lower(c_name) end as email from {customer}"""


@query(
    "identity_linking", "J25",
    sql=f"""with claims as ({CLAIMS.replace('{customer}', 'customer')}),
      ids as (select 'sub-' || c_custkey as subject, c_custkey as user_id from customer where c_custkey % 3 = 0),
      m as (select c.*, i.user_id as s, u.c_custkey as e, coalesce(i.user_id, u.c_custkey) as user_id from claims c
        left join ids i using (subject) left join customer u on lower(u.c_name) = c.email),
      d as (select *, case when not verified then 'rejected_unverified' when user_id is not null and user_id % 11 = 0 then 'rejected_inactive'
        when s is not null then 'signed_in' when e is not null then 'linked_by_email' else 'created' end as action from m)
    select claim_id, email, action, user_id, null::bigint as amount from d where action <> 'created'
    union all select min(claim_id), email, a, null, case when a = 'signup_grant' then 3 end from d, (values ('created'), ('signup_grant')) x(a)
      where action = 'created' group by email, a""",
)
def identity_linking(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    claims = spark.sql(CLAIMS, customer=customer)
    users = standin(spark, sf_dir, "users").select("id", "email", (F.col("id") % 11 != 0).alias("is_active"))
    identities = customer.filter("c_custkey % 3 = 0").select(
        F.lit("google").alias("provider"), F.concat(F.lit("sub-"), F.col("c_custkey").cast("string")).alias("subject"), F.col("c_custkey").alias("user_id")
    )
    return A.link_identities(claims, identities, users)


@query("packs_on_sale", "T2", sql=with_standins("packs", "select id, credits, price_usd_cents, sort_order from packs where is_active order by sort_order, price_usd_cents, id"))
def packs_on_sale(spark, sf_dir):
    return A.display_order(standin(spark, sf_dir, "packs")).select("id", "credits", "price_usd_cents", "sort_order")


@query(
    "pack_value_sheet", "J26",
    sql=with_standins("packs", """select id, tier, round(price_usd_cents / credits, 4) as cents_per_credit, cast(floor(credits / cost) as bigint) as downloads,
        price_usd_cents < 500 as is_small from packs, (values ('basic', 1), ('pro', 2)) t(tier, cost) where floor(credits / cost) > 0"""),
)
def pack_value_sheet(spark, sf_dir):
    return A.pack_value_sheet(standin(spark, sf_dir, "packs"), TIERS)


@query(
    "best_value_packs", "W15",
    sql=with_standins("packs", """select storefront, case when count(*) >= 2 then arg_min(id, (price_usd_cents / credits, sort_order, price_usd_cents, id)) end as best_pack
        from packs where is_active group by storefront"""),
)
def best_value_packs(spark, sf_dir):
    return A.best_value_pack(standin(spark, sf_dir, "packs").filter("is_active"), "storefront")


@query(
    "covering_packs", "W16",
    sql=with_standins("packs", """with_more sale as (select * from packs where is_active),
      req as (select o_orderkey as request_id, cast(ceil(o_totalprice / 9000) as bigint) as need, o_custkey as asked from orders),
      needs as (select need, (select arg_min(id, (credits, sort_order, price_usd_cents, id)) from sale s where s.credits >= n.need) as c from (select distinct need from req) n)
      select request_id, r.need, coalesce(s.id, c, (select arg_min(id, (-credits, sort_order, price_usd_cents, id)) from sale)) as pack_id
      from req r join needs n on n.need = r.need left join sale s on s.id = r.asked"""),
)
def covering_packs(spark, sf_dir):
    sale = standin(spark, sf_dir, "packs").filter("is_active")
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.ceil(F.col("o_totalprice") / 9000).alias("need"), F.col("o_custkey").alias("asked_pack")
    )
    return A.covering_pack(requests, sale, width=10)


@query(
    "approvals", "L17",
    sql=with_standins("users", """with_more g as (select o_orderkey as project_id, greatest(0, cast(ceil(o_totalprice / 100 / 2.0) as bigint) - balance) as lack
        from orders join users u on u.id = o_custkey where o_orderstatus = 'O')
      select project_id, 'generating' as status, unnest(['basic', 'pro']) as tier from g where lack = 0
      union all select project_id, 'awaiting_cost_approval', null from g where lack > 0"""),
)
def approvals(spark, sf_dir):
    gated = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("id"), (F.col("o_totalprice") / 100).alias("cost_usd")
    ).join(standin(spark, sf_dir, "users").select("id", "balance"), "id")
    return A.approvals(gated, TIERS, 2.0)


@query(
    "submission_checks", "L17", "S9",
    sql=with_standins("users", """select event_id, user_id, case when user_id % 5 <> 0 then balance else 0 end >= 1 as allowed
        from events join users u on u.id = user_id where event_type = 'signup'"""),
)
def submission_checks(spark, sf_dir):
    submissions = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", "user_id")
    return A.submittable(submissions, wallets_of(standin(spark, sf_dir, "users"))).select("event_id", "user_id", "allowed")
