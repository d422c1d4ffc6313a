"""Ledger queries over the event stream read as credit transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.operators import ledger as L
from sitelake.plans.registry import query, table
from sitelake.plans.standins import standin, with_standins

# A key is used up by its first accepted row, over all wallets. Every round folds the wallets, in steps that decide the next row of
# each at once, over the rows up to the one that the round before found; enough rounds for these tables.
ROUNDS = 8


def _round(k: int) -> str:
    upto = (
        "select idempotency_key, min((created_at, id)) as upto from ledger where idempotency_key is not null group by 1" if k == 0 else
        f"select idempotency_key, min((created_at, id)) as upto from fold{k - 1} where accepted and idempotency_key is not null group by 1"
    )
    return f"""upto{k} as materialized ({upto}),
  seq{k} as materialized (select l.wallet_id, l.id, l.amount, l.created_at, l.idempotency_key, row_number() over (partition by wallet_id order by created_at, id) as n
    from ledger l left join upto{k} u on u.idempotency_key = l.idempotency_key where u.upto is null or (l.created_at, l.id) <= u.upto),
  fold{k} as (select *, amount >= 0 as accepted, greatest(amount, 0) as balance from seq{k} where n = 1
    union all
    select s.*, s.amount >= 0 or f.balance + s.amount >= 0,
        case when s.amount >= 0 or f.balance + s.amount >= 0 then f.balance + s.amount else f.balance end
    from fold{k} f join seq{k} s on s.wallet_id = f.wallet_id and s.n = f.n + 1)"""


SQL_FOLD = "with_more " + ", ".join(_round(k) for k in range(ROUNDS)) + f", fold as (select wallet_id, id, amount, accepted, balance from fold{ROUNDS - 1})\n"
SQL_CLEAN = SQL_FOLD + ", clean as (select * from ledger where id in (select id from fold where accepted))\n"


def clean(spark, sf_dir):
    return L.standing(standin(spark, sf_dir, "ledger"))


@query("idempotent_ledger", "L1", sql=with_standins("ledger", SQL_CLEAN + "select id, wallet_id, amount, idempotency_key from clean"))
def idempotent_ledger(spark, sf_dir):
    return clean(spark, sf_dir).select("id", "wallet_id", "amount", "idempotency_key")


@query("spend_admission", "L2", sql=with_standins("ledger", SQL_FOLD + "select wallet_id, id, amount, accepted, balance from fold"))
def spend_admission(spark, sf_dir):
    return L.decide(standin(spark, sf_dir, "ledger"))


@query(
    "running_balances", "L3",
    sql=with_standins("ledger", SQL_CLEAN + """select wallet_id, id, cast(sum(amount) over (partition by wallet_id order by created_at, id) as bigint) as balance from clean"""),
)
def running_balances(spark, sf_dir):
    return L.running_balances(clean(spark, sf_dir)).select("wallet_id", "id", "balance")


@query(
    "balance_drift", "L4",
    sql=with_standins("ledger users", SQL_CLEAN + """, s as (select wallet_id, cast(sum(amount) as bigint) as b from clean group by 1)
        select coalesce(s.wallet_id, u.id) as wallet_id, coalesce(u.balance, 0) as cached_balance, coalesce(b, 0) as ledger_balance
        from users u full join s on s.wallet_id = u.id where coalesce(u.balance, 0) <> coalesce(b, 0)"""),
)
def balance_drift(spark, sf_dir):
    return L.balance_drift(standin(spark, sf_dir, "users"), clean(spark, sf_dir))


ADJUST = """select event_id as id, user_id as wallet_id, ts as created_at, cast(case when event_type in ('click', 'error') then -floor(value) else floor(value) end as bigint) as amount,
    case when event_id % 13 = 0 then '  ' else 'note ' || cast(event_id as varchar(20)) end as note from {events}"""


@query(
    "signed_adjustments", "L5",
    sql=f"""with recursive req as (select * from ({ADJUST.replace('{events}', 'events')}) t where trim(note) <> '' and amount <> 0),
    seq as (select *, row_number() over (partition by wallet_id order by created_at, id) as n from req),
    fold as (select wallet_id, id, amount, note, n, amount >= 0 as accepted, greatest(amount, 0) as balance from seq where n = 1
      union all select s.wallet_id, s.id, s.amount, s.note, s.n, f.balance + s.amount >= 0,
        case when f.balance + s.amount >= 0 then f.balance + s.amount else f.balance end
      from fold f join seq s on s.wallet_id = f.wallet_id and s.n = f.n + 1)
    select wallet_id, 'purchase' as row_kind, amount as credits, 0 as amount_usd_cents, note, null as idempotency_key from fold where accepted
    union all select wallet_id, 'ledger', amount, null, null, 'admin_adjustment:' || id from fold where accepted""",
)
def signed_adjustments(spark, sf_dir):
    requests = L.noted(spark.sql(ADJUST, events=table(spark, sf_dir, "events")))
    return L.adjustment_rows(L.admit(requests), requests)


BUSY = """select event_id as id, case when event_id % 3 = 0 then -1 else user_id end as wallet_id, ts as created_at,
    cast(case when event_type in ('click', 'error', 'view') then -floor(value) else floor(value) end as bigint) as amount from {events}"""


@query(
    "busy_wallet_admission", "L2",
    sql=f"""with recursive req as ({BUSY.replace('{events}', 'events')}),
    seq as materialized (select *, row_number() over (partition by wallet_id order by created_at, id) as n from req),
    fold as (select wallet_id, id, amount, n, amount >= 0 as accepted, greatest(amount, 0) as balance from seq where n = 1
      union all select s.wallet_id, s.id, s.amount, s.n, s.amount >= 0 or f.balance + s.amount >= 0,
        case when s.amount >= 0 or f.balance + s.amount >= 0 then f.balance + s.amount else f.balance end
      from fold f join seq s on s.wallet_id = f.wallet_id and s.n = f.n + 1)
    select wallet_id, id, amount, accepted, balance from fold""",
)
def busy_wallet_admission(spark, sf_dir):
    """Admission where one wallet has a third of all rows, in slices of 500."""
    return L.admit(spark.sql(BUSY, events=table(spark, sf_dir, "events")), slice_rows=500)


@query(
    "missing_signup_grants", "L6",
    sql=with_standins("ledger users", """select id as user_id, 3 as amount, 'signup_grant:' || id as idempotency_key from users
        where 'signup_grant:' || id not in (select idempotency_key from ledger where reason = 'signup_grant')"""),
)
def missing_signup_grants(spark, sf_dir):
    return L.missing_signup_grants(standin(spark, sf_dir, "users"), standin(spark, sf_dir, "ledger"))


@query(
    "missing_purchase_grants", "L6",
    sql=with_standins("ledger purchases", """select id, user_id, credits_granted as amount, 'purchase:' || id as idempotency_key from purchases
        where status = 'completed' and credits_granted > 0 and 'purchase:' || id not in (select idempotency_key from ledger where idempotency_key is not null)"""),
)
def missing_purchase_grants(spark, sf_dir):
    return L.missing_purchase_grants(standin(spark, sf_dir, "purchases"), standin(spark, sf_dir, "ledger"))


@query(
    "refund_claw_backs", "L7",
    sql=with_standins("purchases users", """with_more bal as (select id as wallet_id, balance as b from users),
      req as (select p.id, p.user_id as wallet_id, credits_granted, row_number() over (partition by p.user_id order by refunded_at, p.id) as n
        from purchases p where status = 'refunded' and credits_granted > 0),
      fold as (select r.id, r.wallet_id, r.credits_granted, n, greatest(least(credits_granted, b), 0) as taken, b - greatest(least(credits_granted, b), 0) as rest
          from req r join bal using (wallet_id) where n = 1
        union all select r.id, r.wallet_id, r.credits_granted, r.n, greatest(least(r.credits_granted, f.rest), 0), f.rest - greatest(least(r.credits_granted, f.rest), 0)
          from fold f join req r on r.wallet_id = f.wallet_id and r.n = f.n + 1)
      select id, wallet_id, credits_granted, taken as taken_back from fold where taken > 0"""),
)
def refund_claw_backs(spark, sf_dir):
    # The cached balance of each user stands in as one opening ledger row.
    opening = standin(spark, sf_dir, "users").select(
        "id", F.col("id").alias("wallet_id"), F.col("balance").alias("amount"), F.lit(None).cast("string").alias("idempotency_key")
    )
    return L.claw_backs(standin(spark, sf_dir, "purchases"), opening)


@query(
    "paid_tiers", "J22",
    sql=with_standins("ledger", """with_more c as (select wallet_id, related_project_id, substr(idempotency_key, length('download_spend:' || related_project_id || ':') + 1) as tier
        from ledger where reason = 'download_spend' and starts_with(idempotency_key, 'download_spend:' || related_project_id || ':'))
      select wallet_id + 1000 as user_id, related_project_id as project_id, string_agg(distinct tier, ',' order by tier) as tiers from c where tier <> '' group by all"""),
)
def paid_tiers(spark, sf_dir):
    ledger = standin(spark, sf_dir, "ledger")
    wallets = ledger.select("wallet_id", (F.col("wallet_id") + 1000).alias("user_id")).distinct()
    return L.paid_tiers(ledger, wallets)


@query(
    "download_charges", "A25",
    sql=with_standins("ledger", """select related_project_id as project_id, case id % 4 when 0 then 'basic' when 1 then 'pro' else 'premium' end as tier,
        -amount as credits, created_at, id from ledger where reason = 'download_spend' and id % 4 <> 3"""),
)
def download_charges(spark, sf_dir):
    return L.download_charges(standin(spark, sf_dir, "ledger"))
