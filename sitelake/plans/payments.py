"""Purchase and payment-event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelake.operators import analytics, payments as P
from sitelake.plans.registry import query, table
from sitelake.plans.standins import standin, with_standins

EVENTS = """
    select event_id, ts, event_type, case k
        when 0 then '{{"id":"ORD-' || x || '"}}'
        when 1 then '{{"id":"CAP-' || x || '","status":"completed","amount":{{"value":"' || paid || '","currency_code":"' || cur
             || '"}},"supplementary_data":{{"related_ids":{{"order_id":"ORD-' || x || '"}}}}}}'
        when 2 then '{{"id":"CAP-' || x || '","status":"' || st || '","amount":{{"value":"' || paid || '","currency_code":"USD"}},"custom_id":"' || x || '"}}'
        when 3 then '{{"id":"REF-' || x || '","links":[{{"rel":"self","href":"https://pay.example/v2/x"}},{{"rel":"up","href":"https://pay.example/v2/payments/captures/CAP-' || x || '"}}]}}'
        when 4 then '{{"id":"CAP-' || x || '","custom_id":"' || x || '","links":[{{"rel":"up","href":"https://pay.example/none"}}]}}'
        else '{{"note":1}}' end as resource
    from (select event_id, ts, event_id % 6 as k, cast(o_orderkey as varchar(20)) as x,
            case when event_id % 5 = 0 then '1.00' when event_id % 7 = 0 then 'abc' else cast(o_totalprice as varchar(20)) end as paid,
            case when event_id % 11 = 0 then 'EUR' else 'USD' end as cur,
            case event_id % 4 when 0 then 'COMPLETED' when 1 then 'PENDING' when 2 then 'REFUNDED' else 'DECLINED' end as st,
            case event_id % 6 when 0 then 'CHECKOUT.ORDER.APPROVED' when 1 then 'PAYMENT.CAPTURE.COMPLETED' when 2 then 'PAYMENT.CAPTURE.DENIED'
              when 3 then 'PAYMENT.CAPTURE.REFUNDED' when 4 then 'PAYMENT.CAPTURE.REVERSED' else 'BILLING.PLAN.CREATED' end as event_type
          from {events} join {orders} on o_orderkey = cast(floor(event_id / 13) as bigint) * 3 + event_id % 3) t"""
ORDERS = """
    select 'ORD-' || cast(o_orderkey as varchar(20)) as order_id, case o_orderkey % 8
        when 0 then '{{"status":"CREATED","purchase_units":[{{}}]}}'
        when 1 then '{{"status":"APPROVED"}}' when 2 then '{{"status":"VOIDED","purchase_units":null}}'
        when 3 then '{{"status":"COMPLETED","purchase_units":[{{"payments":{{"captures":[]}}}},{{"payments":{{"captures":[{{"id":"CAP-1","status":"COMPLETED","amount":{{"value":"'
            || cast(o_totalprice as varchar(20)) || '","currency_code":"USD"}}}}]}}}}]}}'
        when 4 then '{{"status":"COMPLETED","purchase_units":[{{"payments":{{"captures":[{{"id":"CAP-2","status":"partially_refunded"}}]}}}}]}}'
        when 5 then '{{"status":"COMPLETED","purchase_units":[{{"payments":{{"captures":[{{"id":"CAP-3","status":"COMPLETED","amount":{{"value":"2.5","currency_code":"USD"}}}}]}}}}]}}'
        else '{{"status":"odd"}}' end as payload
    from {orders} where o_orderkey % 8 <> 7"""


def sql_of(text: str) -> str:
    return text.format(events="events", orders="orders")


def provider_events(spark, sf_dir):
    return spark.sql(EVENTS, events=table(spark, sf_dir, "events"), orders=table(spark, sf_dir, "orders"))


def provider_orders(spark, sf_dir):
    return spark.sql(ORDERS, orders=table(spark, sf_dir, "orders"))


SQL_EVENTS = f"with_more ev as ({sql_of(EVENTS)}), po as ({sql_of(ORDERS)})"
SQL_RESOLVED = SQL_EVENTS + """,
  cand as (
    select event_id, 1 as pr, 'order' as kind, resource->>'$.id' as key from ev where event_type = 'CHECKOUT.ORDER.APPROVED'
    union all select event_id, 1, 'order', resource->>'$.supplementary_data.related_ids.order_id' from ev where event_type in ('PAYMENT.CAPTURE.COMPLETED', 'PAYMENT.CAPTURE.DENIED')
    union all select event_id, 2, 'id', resource->>'$.custom_id' from ev where event_type in ('PAYMENT.CAPTURE.COMPLETED', 'PAYMENT.CAPTURE.DENIED')
    union all select event_id, 1, 'capture', regexp_extract(resource, '/captures/([^"/]+)"', 1) from ev where event_type in ('PAYMENT.CAPTURE.REFUNDED', 'PAYMENT.CAPTURE.REVERSED')
    union all select event_id, 2, 'capture', resource->>'$.id' from ev where event_type in ('PAYMENT.CAPTURE.REFUNDED', 'PAYMENT.CAPTURE.REVERSED')
    union all select event_id, 3, 'id', resource->>'$.custom_id' from ev where event_type in ('PAYMENT.CAPTURE.REFUNDED', 'PAYMENT.CAPTURE.REVERSED')),
  known as (select 'order' as kind, paypal_order_id as key, id from purchases where source <> 'manual_admin'
    union all select 'id', id::varchar, id from purchases where source <> 'manual_admin'
    union all select 'capture', paypal_capture_id, id from purchases),
  res as (select event_id, arg_min(id, pr) as purchase_id from cand join known using (kind, key) group by 1)
"""


def sql_capture(prefix: str, id_: str, status: str, value: str, currency: str, cents: str) -> str:
    ok_amount = f"coalesce(try_cast({value} as decimal(24, 8)) * 100 = {cents}, false)"
    return f"""case when coalesce({id_}, '') = '' then 'pending' when {status} = 'COMPLETED' and coalesce({currency}, '') = 'USD' and {ok_amount} then 'completed'
        when {status} = 'COMPLETED' then 'failed' when {status} = 'PENDING' then 'pending' when {status} in ('REFUNDED', 'PARTIALLY_REFUNDED') then 'refunded' else 'failed' end as {prefix}outcome,
      case when coalesce({id_}, '') = '' then 'PayPal has not captured this order yet'
        when {status} = 'COMPLETED' and coalesce({currency}, '') <> 'USD' then 'captured in ' || coalesce({currency}, 'None') || ', expected USD'
        when {status} = 'COMPLETED' and not {ok_amount} then 'captured ' || coalesce({value}, 'None') || ', expected ' || printf('%d.%02d', {cents} // 100, {cents} % 100)
        when {status} = 'COMPLETED' then null when {status} = 'PENDING' then 'PayPal is still processing this payment'
        when {status} in ('REFUNDED', 'PARTIALLY_REFUNDED') then 'capture is ' || {status}
        else 'capture status ' || case when {status} = '' then 'unknown' else {status} end end as {prefix}reason"""


SQL_OUTCOMES = SQL_RESOLVED + f""",
  flat as (select res.purchase_id, ev.event_id, ev.ts, ev.event_type, p.credits_granted, p.amount_usd_cents as cents, resource->>'$.id' as cid,
      upper(coalesce(resource->>'$.status', '')) as st, resource->>'$.amount.value' as val, resource->>'$.amount.currency_code' as cur
    from res join ev using (event_id) join purchases p on p.id = res.purchase_id),
  judged as (select *, {sql_capture('c_', 'cid', 'st', 'val', 'cur', 'cents')} from flat),
  outc as (select purchase_id, event_id, ts, credits_granted, case when event_type in ('PAYMENT.CAPTURE.REFUNDED', 'PAYMENT.CAPTURE.REVERSED') then 'refund_event'
      when event_type = 'CHECKOUT.ORDER.APPROVED' then 'none' else c_outcome end as effect,
      case when event_type in ('PAYMENT.CAPTURE.COMPLETED', 'PAYMENT.CAPTURE.DENIED') then c_reason end as reason from judged)
"""


@query(
    "purchase_view", "J6", "T1",
    sql=with_standins("purchases users packs", """with_more f as (select p.id, p.status, p.source, p.amount_usd_cents, p.created_at, u.email as buyer_email, k.name as pack_name,
          a.email as resolved_by_email from purchases p join users u on u.id = p.user_id left join packs k on k.id = p.credit_pack_id
          left join users a on a.id = p.resolved_by_admin_id where p.status = 'refunded' and p.source <> 'mock' and u.email ilike '%#0000001%')
        select *, (select count(*) from f) as total from f order by created_at desc, id limit 25"""),
)
def purchase_view(spark, sf_dir):
    from sitelake.functions.text import search_filter

    view = P.purchase_view(P.listed(standin(spark, sf_dir, "purchases"), status="refunded"), standin(spark, sf_dir, "users"), standin(spark, sf_dir, "packs"))
    shown = view.filter(search_filter("buyer_email", "#0000001")).select(
        "id", "status", "source", "amount_usd_cents", "created_at", "buyer_email", "pack_name", "resolved_by_email"
    )
    return analytics.page_of(shown, [F.desc("created_at"), F.asc("id")], page=1, size=25)


@query(
    "payment_event_actions", "S8",
    sql=with_standins("users", SQL_EVENTS + """select event_id, case when event_type = 'CHECKOUT.ORDER.APPROVED' then 'order'
        when event_type in ('PAYMENT.CAPTURE.COMPLETED', 'PAYMENT.CAPTURE.DENIED') then 'capture'
        when event_type in ('PAYMENT.CAPTURE.REFUNDED', 'PAYMENT.CAPTURE.REVERSED') then 'refund' else 'ignored: ' || event_type end as action,
        resource->>'$.id' as resource_id from ev"""),
)
def payment_event_actions(spark, sf_dir):
    return P.parsed(provider_events(spark, sf_dir)).select("event_id", "action", F.col("r.id").alias("resource_id"))


@query("payment_event_purchases", "J10", sql=with_standins("purchases", SQL_RESOLVED + "select * from res"))
def payment_event_purchases(spark, sf_dir):
    return P.resolve_events(provider_events(spark, sf_dir), standin(spark, sf_dir, "purchases"))


@query("payment_event_outcomes", "L8", "J10", sql=with_standins("purchases", SQL_OUTCOMES + "select purchase_id, event_id, effect, reason from outc"))
def payment_event_outcomes(spark, sf_dir):
    return P.event_outcomes(provider_events(spark, sf_dir), standin(spark, sf_dir, "purchases")).select("purchase_id", "event_id", "effect", "reason")


@query(
    "purchase_lifecycle", "L9",
    sql=with_standins("purchases", SQL_OUTCOMES + """,
      seq as (select *, row_number() over (partition by purchase_id order by ts, event_id) as n, count(*) over (partition by purchase_id) as events from outc),
      fold as (select purchase_id, 0 as n, 'pending' as status, 0::bigint as credits_granted, null::timestamp as refunded_at, max(events) as events from seq group by 1
        union all
        select s.purchase_id, s.n, case when s.effect = 'refund_event' then 'refunded' when f.status in ('completed', 'refunded') or s.effect in ('none', 'pending') then f.status
              else s.effect end,
            case when s.effect = 'completed' and f.status in ('pending', 'failed') then s.credits_granted else f.credits_granted end,
            case when s.effect = 'refund_event' or (s.effect = 'refunded' and f.status in ('pending', 'failed')) then coalesce(f.refunded_at, s.ts) else f.refunded_at end,
            f.events
        from fold f join seq s on s.purchase_id = f.purchase_id and s.n = f.n + 1)
      select purchase_id, events, status, credits_granted, refunded_at from fold where n = events"""),
)
def purchase_lifecycle(spark, sf_dir):
    return P.lifecycle(P.event_outcomes(provider_events(spark, sf_dir), standin(spark, sf_dir, "purchases")))


SQL_RECON = SQL_EVENTS + f""",
  j as (select p.id, p.source, p.created_at, p.status, p.amount_usd_cents as cents, po.order_id, upper(coalesce(payload->>'$.status', '')) as os,
      regexp_extract(payload, '"id":"([^"]*)"', 1) as cid, upper(regexp_extract(payload, '"id":"[^"]*","status":"([^"]*)"', 1)) as st,
      payload->>'$.purchase_units[#-1].payments.captures[0].amount.value' as val, payload->>'$.purchase_units[#-1].payments.captures[0].amount.currency_code' as cur
    from purchases p left join po on po.order_id = p.paypal_order_id),
  k as (select *, {sql_capture('c_', 'cid', 'st', 'val', 'cur', 'cents')}, coalesce(cid, '') <> '' as has from j),
  rec as (select id, source, created_at, status as old_status,
      case when status = 'refunded' then 'refunded' when order_id is null and status = 'completed' then 'completed' when order_id is null then 'failed'
        when status = 'completed' and st in ('REFUNDED', 'PARTIALLY_REFUNDED') then 'refunded' when status = 'completed' then 'completed'
        when has then c_outcome when os = 'VOIDED' then 'failed' else 'pending' end as new_status,
      case when status = 'refunded' then 'Already marked refunded' when order_id is null and status = 'completed' then 'PayPal no longer has this order'
        when order_id is null then 'PayPal no longer has this order (it expired without payment)'
        when status = 'completed' and st in ('REFUNDED', 'PARTIALLY_REFUNDED') then 'Refund found by admin re-check (capture ' || st || '); credits not taken back yet'
        when status = 'completed' then 'Still paid at PayPal' when has then c_reason when os = 'APPROVED' then 'approved, capture due'
        when os = 'VOIDED' then 'PayPal voided this order' when os = 'CREATED' then 'The buyer never approved this payment'
        else 'PayPal order status ' || os end as reason,
      status not in ('refunded', 'completed') and (order_id is null or (not has and os in ('VOIDED', 'CREATED'))) as never_approved from k)
"""


def reconciled(spark, sf_dir):
    return P.reconcile(standin(spark, sf_dir, "purchases"), provider_orders(spark, sf_dir))


@query("provider_reconciliation", "L10", "L8", sql=with_standins("purchases", SQL_RECON + "select id, old_status, new_status, reason, never_approved from rec"))
def provider_reconciliation(spark, sf_dir):
    return reconciled(spark, sf_dir).select("id", "old_status", "new_status", "reason", "never_approved")


@query(
    "stale_checkouts", "L11",
    sql=with_standins("purchases", SQL_RECON + """select id, new_status from rec where source <> 'manual_admin' and old_status = 'pending'
        and created_at <= timestamp '1999-06-01 00:00:00' - interval 24 hour and never_approved"""),
)
def stale_checkouts(spark, sf_dir):
    return P.stale_checkouts(reconciled(spark, sf_dir), "1999-06-01").select("id", "new_status")


CLAWED = """select 'refund_clawback:' || cast(o_orderkey as varchar(20)) as idempotency_key, -cast(floor(o_totalprice / 2000) as bigint) as amount
    from {orders} where o_orderstatus = 'P' and o_orderkey % 3 = 0"""


@query(
    "purchase_actions", "A26",
    sql=with_standins("purchases", f"""with_more c as ({CLAWED.replace('{orders}', 'orders')})
      select p.id, coalesce(-c.amount, 0) as credits_taken_back, source <> 'manual_admin' and status in ('pending', 'failed', 'completed') as can_recheck,
        status = 'refunded' and coalesce(-c.amount, 0) = 0 as can_take_back,
        source <> 'manual_admin' and status = 'pending' and created_at <= timestamp '1999-06-01' - interval 24 hour as can_mark_failed
      from purchases p left join c on c.idempotency_key = 'refund_clawback:' || p.id"""),
)
def purchase_actions(spark, sf_dir):
    ledger = spark.sql(CLAWED, orders=table(spark, sf_dir, "orders"))
    return P.purchase_actions(standin(spark, sf_dir, "purchases"), ledger, "1999-06-01")
