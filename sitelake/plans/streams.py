"""Stream queries: batch twins of the windowed streams, and the stateful streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sitelake.operators import elements as E
from sitelake.operators.blueprint import page_blueprints
from sitelake.plans.costs_and_usage import SQL_COSTED
from sitelake.plans.ledger_and_wallets import SQL_FOLD
from sitelake.plans.pages_and_links import unescape
from sitelake.plans.payments import SQL_OUTCOMES, provider_events
from sitelake.operators import payments as P
from sitelake.plans.registry import query, table
from sitelake.plans.standins import STANDINS, standin, with_standins
from sitelake.session import checkpoint_folder
from sitelake.streaming import run, state, submissions as W


def ntz(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


@query(
    "submission_rate_limit", "R1", "S9",
    sql="""select time_bucket(interval 1 minute, ts) as minute, client, n from (select time_bucket(interval 1 minute, ts) as ts, user_id % 3 as client, count(*) as n
      from events group by all) t where n > 1""",
)
def submission_rate_limit(spark, sf_dir):
    rows = W.event_time(table(spark, sf_dir, "events")).select("ts", (F.col("user_id") % 3).alias("client"))
    return W.over_limit(rows, 1).select(ntz("minute"), "client", "n")


@query("streamed_rate_limit", "R1",
    sql="""select minute, client, n from (select time_bucket(interval 1 minute, ts) as minute, user_id % 3 as client, count(*) as n from events group by all) t where n > 1""")
def streamed_rate_limit(spark, sf_dir):
    """The rate limit as a stream in update mode, over submissions that arrive out of order."""
    rows = W.event_time(table(spark, sf_dir, "events")).select("ts", (F.col("user_id") % 3).alias("client"))
    stream = run.landed(rows, 3, F.xxhash64("ts", "client"))
    return run.drain_updates(W.over_limit(stream, 1, lateness="400 days"), ["minute", "client"]).select(ntz("minute"), "client", "n")


@query("streamed_model_cost", "R5",
    sql=with_standins("usage pricing", SQL_COSTED + """, daily as (select created_at as day, model_name, sum(cost_usd) as c from costed group by all)
      select d.day - o as start, model_name, round(sum(c), 6) as cost_usd from daily d, (select unnest(range(0, 7))::int as o) s group by all"""))
def streamed_model_cost(spark, sf_dir):
    """Rolling cost as a stream in update mode, over usage rows that arrive out of order."""
    from sitelake.plans.costs_and_usage import costed_usage

    costed = costed_usage(spark, sf_dir).select(F.col("created_at").cast("timestamp").alias("ts"), "model_name", "cost_usd")
    stream = run.landed(costed, 3, F.xxhash64("ts", "cost_usd"))
    found = run.drain_updates(W.rolling_cost(stream, 7, lateness="9999 days"), ["start", "model_name"])
    return found.select(F.col("start").cast("date").alias("start"), "model_name", "cost_usd")


DELIVERIES = "event_id % 3 = 0"


@query("first_deliveries", "R2", "S8", sql="select event_id, event_type, value from events")
def first_deliveries(spark, sf_dir):
    events = W.event_time(run.table_stream(spark, sf_dir, "events"))
    # Every third event arrives twice.
    again = F.explode(F.when(F.expr(DELIVERIES), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("attempt")
    delivered = events.select("event_id", "event_type", "value", "ts", again)
    return run.drain(W.first_deliveries(delivered, lateness="40 days").select("event_id", "event_type", "value"))


@query("streamed_spend_admission", "R3", sql=with_standins("ledger", SQL_FOLD + "select wallet_id, id, amount, accepted, balance from fold"))
def streamed_spend_admission(spark, sf_dir):
    ledger = W.event_time(spark.sql(STANDINS["ledger"], events=run.table_stream(spark, sf_dir, "events")), "created_at")
    base = f"{checkpoint_folder(spark)}/admission-{uuid.uuid4().hex}"
    return run.admit_batches(ledger, base).select("wallet_id", "id", "amount", "accepted", "balance")


@query(
    "streamed_purchase_lifecycle", "R4",
    sql=with_standins("purchases", SQL_OUTCOMES + """,
      seq as (select *, row_number() over (partition by purchase_id order by ts, event_id) as n, count(*) over (partition by purchase_id) as events from outc),
      fold as (select purchase_id, 0 as n, 'pending' as status, 0::bigint as credits_granted, max(events) as events from seq group by 1
        union all
        select s.purchase_id, s.n, case when s.effect = 'refund_event' then 'refunded' when f.status in ('completed', 'refunded') or s.effect in ('none', 'pending') then f.status
              else s.effect end,
            case when s.effect = 'completed' and f.status in ('pending', 'failed') then s.credits_granted else f.credits_granted end, f.events
        from fold f join seq s on s.purchase_id = f.purchase_id and s.n = f.n + 1)
      select purchase_id, events, status, credits_granted from fold where n = events"""),
)
def streamed_purchase_lifecycle(spark, sf_dir):
    return lifecycle(spark, sf_dir).select("purchase_id", "events", "status", "credits_granted")


def lifecycle(spark, sf_dir):
    outcomes = W.event_time(P.event_outcomes(provider_events(spark, sf_dir), standin(spark, sf_dir, "purchases")))
    # The outcomes are written as a table first, so the stream reads files like a landing zone.
    landing = f"{checkpoint_folder(spark)}/landing-{uuid.uuid4().hex}"
    outcomes.write.parquet(landing)
    return run.drain_updates(state.lifecycle_updates(spark.readStream.schema(outcomes.schema).parquet(landing)), ["purchase_id"])


@query(
    "streamed_stale_purchases", "R4", "L11",
    sql=with_standins("purchases", SQL_OUTCOMES + """,
      p as (select purchase_id, min(ts) as first_ts, count(*) as events, bool_and(effect in ('none', 'pending')) as waiting from outc group by 1)
      select purchase_id, 'pending' as status, events from p where waiting and first_ts + interval 24 hour <= (select max(ts) from outc) - interval 1 hour"""),
)
def streamed_stale_purchases(spark, sf_dir):
    """Purchases still pending a day after their first event, by the clock of the stream."""
    return state.stale(lifecycle(spark, sf_dir)).select("purchase_id", "status", "events")


@query(
    "rolling_model_cost", "R5",
    sql=with_standins("usage pricing", SQL_COSTED + """, daily as (select created_at as day, model_name, sum(cost_usd) as c from costed group by all)
      select d.day - o as start, model_name, round(sum(c), 6) as cost_usd from daily d, (select unnest(range(0, 7))::int as o) s group by all"""),
)
def rolling_model_cost(spark, sf_dir):
    from sitelake.plans.costs_and_usage import costed_usage

    costed = costed_usage(spark, sf_dir).select(F.col("created_at").cast("timestamp").alias("ts"), "model_name", "cost_usd")
    return W.rolling_cost(costed, 7).select(F.col("start").cast("date").alias("start"), "model_name", "cost_usd")


@query(
    "streamed_blueprints", "R6", "X20", "X7", "X15",
    sql=rf"""select page_id, trim({unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}) as headline, {unescape("regexp_extract(html, '<a href=.([^>]*).>', 1)")} as cta_href,
        cast(len(list_filter(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="[^"]*">([^<]*)</a>', 1), lambda l: l <> '')) as int) as links
      from pages""",
)
def streamed_blueprints(spark, sf_dir):
    """Whole blueprints of new pages, micro-batch by micro-batch."""
    base = f"{checkpoint_folder(spark)}/blueprints-{uuid.uuid4().hex}"

    def extract(batch):
        return page_blueprints(batch).select("page_id", "sections.hero.headline", "sections.hero.cta_href", F.size("navigation").alias("links"))

    run.extract_pages(run.table_stream(spark, sf_dir, "pages"), f"{base}/out", f"{base}/state", extract).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("page_id", "headline", "cta_href", "links")


@query(
    "streamed_page_elements", "R6",
    sql="""select page_id, count(*) as elements from (select page_id, unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '<script>', 'gs'),
        '<([a-z][a-z0-9]*)', 1)) as tag from pages) t group by page_id""",
)
def streamed_page_elements(spark, sf_dir):
    base = f"{checkpoint_folder(spark)}/pages-{uuid.uuid4().hex}"

    def count_elements(batch):
        return E.with_elements(batch).select("page_id", F.size("elements").cast("long").alias("elements"))

    run.extract_pages(run.table_stream(spark, sf_dir, "pages"), f"{base}/out", f"{base}/state", count_elements).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("page_id", "elements")
