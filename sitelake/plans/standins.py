"""Application tables derived from the given tables.

Each stand-in is one SELECT in the dialect both engines share, so a query and its SQL check read
the same rows; the operators under test are written separately on each side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sitelake.plans.registry import table

STANDINS: dict[str, str] = {
    "users": """
        select c_custkey as id, lower(c_name) as email, cast(floor(c_acctbal) as bigint) as balance,
               c_mktsegment as segment, date '1995-01-01' + cast(c_custkey % 2400 as int) as created_at
        from {customer}""",
    "projects": """
        select o_orderkey as id, o_custkey as user_id,
               'https://site-' || cast(o_custkey as varchar(20)) || '.example.com/p' || cast(o_orderkey as varchar(20)) as source_url,
               case o_orderstatus when 'F' then 'ready' when 'O' then 'generating' else 'failed' end as status,
               cast(o_orderdate as date) as created_at
        from {orders}""",
    "purchases": """
        select o_orderkey as id, o_custkey as user_id, cast(round(o_totalprice * 100) as bigint) as amount_usd_cents,
               cast(floor(o_totalprice / 1000) as bigint) as credits_granted,
               case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'refunded' end as status,
               case o_orderpriority when '5-LOW' then 'mock' when '4-NOT SPECIFIED' then 'manual_admin' else 'paypal' end as source,
               'ORD-' || cast(o_orderkey as varchar(20)) as paypal_order_id,
               case when o_orderstatus <> 'O' then 'CAP-' || cast(o_orderkey as varchar(20)) end as paypal_capture_id,
               case when o_orderpriority <> '4-NOT SPECIFIED' then o_orderkey % 31 end as credit_pack_id,
               case when o_orderstatus = 'P' then o_custkey % 7 end as resolved_by_admin_id,
               cast(o_orderdate as date) as created_at,
               case when o_orderstatus = 'P' then cast(o_orderdate as date) + 3 end as refunded_at
        from {orders}""",
    "jobs": """
        select cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(5)) || '-' || cast(l_partkey as varchar(20))
                 || '-' || cast(l_suppkey as varchar(20)) as id,
               l_orderkey as project_id,
               case l_linenumber % 3 when 0 then 'basic' when 1 then 'pro' else 'premium' end as tier,
               case when l_linestatus = 'F' then 'preview' else 'full_site' end as scope,
               case l_returnflag when 'R' then 'running' when 'A' then 'succeeded' else 'failed' end as overall_status,
               case when l_returnflag = 'N' then 'reason ' || cast(l_suppkey as varchar(20)) end as failure_reason,
               cast(l_shipdate as date) as created_at,
               case when l_returnflag <> 'R' then cast(l_shipdate as date) + cast(l_quantity as int) end as finished_at
        from {lineitem}""",
    "outputs": """
        select cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(5)) || '-' || cast(l_partkey as varchar(20))
                 || '-' || cast(l_suppkey as varchar(20)) as job_id,
               'template-' || cast(l_suppkey % 9 as varchar(20)) as template_used, l_linenumber as iterations
        from {lineitem} where l_returnflag <> 'R'""",
    "usage": """
        select cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(5)) || '-' || cast(l_partkey as varchar(20))
                 || '-' || cast(l_suppkey as varchar(20)) as id,
               cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(5)) || '-' || cast(l_partkey as varchar(20))
                 || '-' || cast(l_suppkey as varchar(20)) as job_id,
               l_orderkey as project_id, o_custkey as user_id, p_brand as model_name,
               case when l_linestatus = 'F' then 'generation' else 'blueprint_extraction' end as purpose,
               cast(l_quantity * 100 as bigint) as prompt_tokens, cast(floor(l_extendedprice) as bigint) as completion_tokens,
               cast(l_shipdate as date) as created_at
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey""",
    "pricing": """
        select p_brand as model_name, cast(max(p_size) as double) as prompt_price_per_1m,
               cast(max(p_size) * 3 + min(p_size) as double) as completion_price_per_1m
        from {part} where p_brand <> 'Brand#7' group by p_brand""",
    "packs": """
        select p_partkey as id, p_name as name, p_type as storefront, cast(p_size as bigint) as credits,
               cast(round(p_retailprice * 100) as bigint) as price_usd_cents, p_partkey % 11 <> 0 as is_active,
               cast(p_partkey % 97 as int) as sort_order
        from {part}""",
    "ledger": """
        select event_id as id, user_id as wallet_id,
               cast(case event_type when 'signup' then 3 when 'purchase' then floor(value) when 'error' then floor(value)
                    when 'view' then -1 else -floor(value) end as bigint) as amount,
               case event_type when 'signup' then 'signup_grant' when 'purchase' then 'purchase' when 'error' then 'purchase'
                    when 'view' then 'generation_spend' else 'download_spend' end as reason,
               case event_type when 'signup' then 'signup_grant:' || cast(user_id as varchar(20))
                    when 'purchase' then 'purchase:' || cast(event_id as varchar(20))
                    when 'error' then 'purchase:' || cast(event_id - 1 as varchar(20))
                    when 'click' then 'download_spend:' || cast(event_id % 400 as varchar(20)) || ':' ||
                         case event_id % 4 when 0 then 'basic' when 1 then 'pro' when 2 then 'premium' else '' end
                    end as idempotency_key,
               case when event_type = 'click' then event_id % 400 end as related_project_id,
               ts as created_at
        from {events}""",
    "templates": """
        select replace(p_name, ' ', '_') || '_' || cast(p_partkey as varchar(20)) || '_prompt.txt' as filename
        from {part}""",
    "template_rows": """
        select replace(p_name, ' ', '_') || '_' || cast(p_partkey as varchar(20)) || '_prompt.txt' as filename,
               lower(p_type) as category, p_size % 2 = 0 as is_active
        from {part} where p_partkey % 3 <> 0""",
    "queued_jobs": """
        select l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 100 as id,
               case l_linenumber % 3 when 0 then 'crawl' when 1 then 'blueprint' else 'generate' end as task_name,
               case l_returnflag when 'N' then 'queued' when 'R' then 'running' else 'done' end as status,
               cast(o_orderdate as date) as created_at,
               case when l_returnflag <> 'N' then cast(l_shipdate as date) end as started_at,
               case when l_returnflag = 'A' then cast(l_shipdate as date) + cast(l_quantity as int) end as finished_at
        from {lineitem} join {orders} on l_orderkey = o_orderkey""",
}

_SLOT = re.compile(r"\{(\w+)\}")


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = STANDINS[name]
    sources = {t: table(spark, sf_dir, t) for t in set(_SLOT.findall(text))}
    return spark.sql(text, **sources)


def with_standins(names: str, body: str) -> str:
    """DuckDB text: the named stand-ins as common table expressions in front of `body`."""
    ctes = ",\n".join(f"{n} as ({_SLOT.sub(lambda m: m.group(1), STANDINS[n])})" for n in names.split())
    joiner = "," if body.lstrip().lower().startswith("with_more ") else ""
    rest = body.lstrip()[len("with_more "):] if joiner else body
    return f"with recursive {ctes}{joiner}\n{rest}"
