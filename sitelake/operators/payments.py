"""Purchases and payment events: resolution, validation, lifecycle and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelake.functions.money import format_amount, to_cents

# Fixed values.
CURRENCY = "USD"
GATEWAY_SOURCES = ("paypal", "mock")
MIN_AGE_HOURS = 24
NEVER_APPROVED_STATUSES = ("CREATED", "SAVED", "PAYER_ACTION_REQUIRED")
CAPTURE_EVENTS = ("PAYMENT.CAPTURE.COMPLETED", "PAYMENT.CAPTURE.PENDING", "PAYMENT.CAPTURE.DENIED")
REFUND_EVENTS = ("PAYMENT.CAPTURE.REFUNDED", "PAYMENT.CAPTURE.REVERSED")
APPROVED_EVENT = "CHECKOUT.ORDER.APPROVED"
CLAW_BACK_PREFIX = "refund_clawback:"

_AMOUNT = T.StructType([T.StructField("value", T.StringType()), T.StructField("currency_code", T.StringType())])
_CAPTURE = T.StructType([T.StructField("id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("amount", _AMOUNT)])
RESOURCE = T.StructType([
    *_CAPTURE.fields,
    T.StructField("custom_id", T.StringType()),
    T.StructField("supplementary_data", T.StructType([
        T.StructField("related_ids", T.StructType([T.StructField("order_id", T.StringType())]))])),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField("rel", T.StringType()), T.StructField("href", T.StringType())]))),
])
ORDER = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("purchase_units", T.ArrayType(T.StructType([
        T.StructField("payments", T.StructType([T.StructField("captures", T.ArrayType(_CAPTURE))]))]))),
])


def purchase_view(purchases: DataFrame, users: DataFrame, packs: DataFrame) -> DataFrame:
    """Purchases with buyer, pack name and resolving admin."""
    buyer = users.select(F.col("id").alias("user_id"), F.col("email").alias("buyer_email"))
    pack = packs.select(F.col("id").alias("credit_pack_id"), F.col("name").alias("pack_name"))
    admin = users.select(F.col("id").alias("resolved_by_admin_id"), F.col("email").alias("resolved_by_email"))
    return purchases.join(buyer, "user_id").join(pack, "credit_pack_id", "left").join(admin, "resolved_by_admin_id", "left")


def listed(purchases: DataFrame, status: str | None = None, source: str | None = None, include_test: bool = False) -> DataFrame:
    """Listing filters; test purchases stay hidden unless asked for by source or flag."""
    df = purchases.filter(F.col("status") == status) if status else purchases
    if source:
        return df.filter(F.col("source") == source)
    return df if include_test else df.filter("source <> 'mock'")


def event_action(event_type: Column) -> Column:
    """What the engine does with an event type; anything unknown is kept as ignored."""
    return (
        F.when(event_type == APPROVED_EVENT, "order")
        .when(event_type.isin(*CAPTURE_EVENTS), "capture")
        .when(event_type.isin(*REFUND_EVENTS), "refund")
        .otherwise(F.concat(F.lit("ignored: "), F.when(F.coalesce(event_type, F.lit("")) == "", "no event_type").otherwise(event_type)))
    )


def parsed(events: DataFrame) -> DataFrame:
    return events.withColumns({"r": F.from_json("resource", RESOURCE), "action": event_action(F.col("event_type"))})


def _linked_capture(links: Column) -> Column:
    ups = F.filter(links, lambda x: (x["rel"] == "up") & x["href"].contains("/captures/"))
    href = F.regexp_replace(F.try_element_at(ups, F.lit(1))["href"], "/+$", "")
    return F.element_at(F.split(href, "/"), -1)


def resolve_events(events: DataFrame, purchases: DataFrame) -> DataFrame:
    """Purchase of each event: candidate keys in order of trust, joined by equality, best one kept."""
    order_id, capture_id, custom = F.col("r.supplementary_data.related_ids.order_id"), F.col("r.id"), F.col("r.custom_id")

    def candidate(priority: int, kind: str, key: Column) -> Column:
        return F.struct(F.lit(priority).alias("priority"), F.lit(kind).alias("kind"), key.alias("key"))

    keys = (
        F.when(F.col("action") == "order", F.array(candidate(1, "order", capture_id)))
        .when(F.col("action") == "capture", F.array(candidate(1, "order", order_id), candidate(2, "id", custom)))
        .when(F.col("action") == "refund", F.array(
            candidate(1, "capture", _linked_capture(F.col("r.links"))), candidate(2, "capture", capture_id), candidate(3, "id", custom)))
    )
    asked = parsed(events).select("event_id", F.explode(keys).alias("c")).select("event_id", "c.*").filter("key is not null")
    gateway = purchases.filter(F.col("source").isin(*GATEWAY_SOURCES))

    def lookup(df: DataFrame, kind: str, column: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("key"), F.col("id").alias("purchase_id"))

    known = lookup(gateway, "order", "paypal_order_id").unionByName(lookup(gateway, "id", "id")).unionByName(
        lookup(purchases, "capture", "paypal_capture_id")
    )
    found = asked.join(known, ["kind", "key"])
    return found.groupBy("event_id").agg(F.min_by("purchase_id", "priority").alias("purchase_id"))


def first_capture(order: Column) -> Column:
    """First capture of the first purchase unit that has any, when it carries an id."""
    lists = F.transform(order["purchase_units"], lambda u: F.coalesce(u["payments"]["captures"], F.array().cast(T.ArrayType(_CAPTURE))))
    capture = F.try_element_at(F.flatten(lists), F.lit(1))
    return F.when(F.coalesce(capture["id"], F.lit("")) != "", capture)


def capture_status(capture: Column, expected_cents: Column) -> tuple[Column, Column]:
    """Outcome and reason of a capture against the price snapshotted on our side."""
    status = F.upper(F.coalesce(capture["status"], F.lit("")))
    value, currency = capture["amount"]["value"], capture["amount"]["currency_code"]
    done, right_currency = status == "COMPLETED", F.coalesce(currency == CURRENCY, F.lit(False))
    right_amount = F.coalesce(to_cents(value) == expected_cents, F.lit(False))
    refunded = status.isin("REFUNDED", "PARTIALLY_REFUNDED")
    outcome = (
        F.when(capture.isNull(), "pending")
        .when(done & right_currency & right_amount, "completed")
        .when(done, "failed").when(status == "PENDING", "pending").when(refunded, "refunded").otherwise("failed")
    )
    none = F.lit("None")
    reason = (
        F.when(capture.isNull(), "PayPal has not captured this order yet")
        .when(done & ~right_currency, F.concat(F.lit("captured in "), F.coalesce(currency, none), F.lit(f", expected {CURRENCY}")))
        .when(done & ~right_amount, F.concat(F.lit("captured "), F.coalesce(value, none), F.lit(", expected "), format_amount(expected_cents)))
        .when(done, F.lit(None).cast("string"))
        .when(status == "PENDING", "PayPal is still processing this payment")
        .when(refunded, F.concat(F.lit("capture is "), status))
        .otherwise(F.concat(F.lit("capture status "), F.when(status == "", "unknown").otherwise(status)))
    )
    return outcome, reason


def event_outcomes(events: DataFrame, purchases: DataFrame) -> DataFrame:
    """Resolved events with the state change each asks for."""
    amounts = purchases.select(F.col("id").alias("purchase_id"), "amount_usd_cents", "credits_granted")
    resolved = parsed(events).select("event_id", "ts", "action", "r").join(resolve_events(events, purchases), "event_id")
    capture = F.when(F.coalesce(F.col("r.id"), F.lit("")) != "", F.struct("r.id", "r.status", "r.amount"))
    outcome, reason = capture_status(capture, F.col("amount_usd_cents"))
    effect = F.when(F.col("action") == "refund", "refund_event").when(F.col("action") == "capture", outcome).otherwise("none")
    return resolved.join(amounts, "purchase_id").select(
        "purchase_id", "event_id", "ts", "credits_granted", effect.alias("effect"), F.when(F.col("action") == "capture", reason).alias("reason")
    )


def lifecycle(outcomes: DataFrame, *more: Column) -> DataFrame:
    """Final state of each purchase after its events, starting from pending; `more` are further named aggregates of its events.

    Completed and refunded absorb later captures, so only the earliest event of each kind matters: the
    whole fold is one partially aggregated group-by, however many deliveries a purchase has.
    """
    when = F.struct("ts", "event_id")

    def earliest(effect: str) -> Column:
        return F.min(F.when(F.col("effect") == effect, when)).alias(effect)

    kinds = [earliest(k) for k in ("completed", "refunded", "refund_event", "failed")]
    marks = outcomes.groupBy("purchase_id").agg(*kinds, F.max("credits_granted").alias("credits"), F.count("*").alias("events"), *[F.struct(*more).alias("_more")] * bool(more))
    settled = F.least("completed", "refunded", "refund_event")
    by_capture = F.when(F.col("refunded") == settled, F.col("refunded.ts"))
    granted = F.coalesce(F.col("completed") == settled, F.lit(False))
    status = (
        F.when(F.col("refund_event").isNotNull(), "refunded")
        .when(granted, "completed")
        .when(F.col("refunded").isNotNull(), "refunded")
        .when(F.col("failed").isNotNull(), "failed")
        .otherwise("pending")
    )
    return marks.select(
        "purchase_id", "events", status.alias("status"),
        F.when(granted, F.col("credits")).otherwise(0).alias("credits_granted"),
        F.least(F.col("refund_event.ts"), by_capture).alias("refunded_at"), *["_more.*"] * bool(more),
    )


def reconcile(purchases: DataFrame, provider_orders: DataFrame) -> DataFrame:
    """Local purchase state against the provider's snapshot of its order; a missing order has expired."""
    snapshot = provider_orders.select(
        F.col("order_id").alias("paypal_order_id"), F.from_json("payload", ORDER).alias("o")
    ).withColumn("known", F.lit(True))
    joined = purchases.join(snapshot, "paypal_order_id", "left").withColumn("c", first_capture(F.col("o")))
    state, known = F.col("status"), F.coalesce("known", F.lit(False))
    order_status = F.upper(F.coalesce("o.status", F.lit("")))
    outcome, reason = capture_status(F.col("c"), F.col("amount_usd_cents"))
    capture_refunded = F.upper(F.coalesce("c.status", F.lit(""))).isin("REFUNDED", "PARTIALLY_REFUNDED")
    never = order_status.isin(*NEVER_APPROVED_STATUSES)
    has_capture = F.col("c").isNotNull()
    cases = [
        (state == "refunded", F.lit("refunded"), F.lit("Already marked refunded"), False),
        (~known & (state == "completed"), F.lit("completed"), F.lit("PayPal no longer has this order"), False),
        (~known, F.lit("failed"), F.lit("PayPal no longer has this order (it expired without payment)"), True),
        ((state == "completed") & capture_refunded, F.lit("refunded"), F.concat(
            F.lit("Refund found by admin re-check (capture "), F.upper("c.status"), F.lit("); credits not taken back yet")), False),
        (state == "completed", F.lit("completed"), F.lit("Still paid at PayPal"), False),
        (has_capture, outcome, reason, False),
        # The reference captures at this point; without a network call the order stays pending and is due.
        (order_status == "APPROVED", F.lit("pending"), F.lit("approved, capture due"), False),
        (order_status == "VOIDED", F.lit("failed"), F.lit("PayPal voided this order"), True),
        (never, F.lit("pending"), F.lit("The buyer never approved this payment"), True),
    ]
    new_status, why, flag = F, F, F
    for condition, s, r, n in cases:
        new_status, why, flag = new_status.when(condition, s), why.when(condition, r), flag.when(condition, F.lit(n))
    fallback = F.concat(F.lit("PayPal order status "), F.when(order_status == "", "unknown").otherwise(order_status))
    return joined.select(
        "id", "source", "created_at", state.alias("old_status"), new_status.otherwise("pending").alias("new_status"),
        why.otherwise(fallback).alias("reason"), flag.otherwise(F.lit(False)).alias("never_approved"),
    )


def stale_checkouts(reconciled: DataFrame, as_of: str) -> DataFrame:
    """Pending gateway purchases at least a day old that the provider says were never approved."""
    old = F.col("created_at").cast("timestamp") <= F.expr(f"timestamp'{as_of}' - interval {MIN_AGE_HOURS} hours")
    return reconciled.filter(F.col("source").isin(*GATEWAY_SOURCES) & (F.col("old_status") == "pending") & old & F.col("never_approved"))


def purchase_actions(purchases: DataFrame, ledger: DataFrame, as_of: str) -> DataFrame:
    """Credits already taken back per purchase and the three actions still open to an admin."""
    keys = ledger.filter(F.startswith(F.col("idempotency_key"), F.lit(CLAW_BACK_PREFIX))).groupBy("idempotency_key").agg(
        F.sum(-F.col("amount")).alias("taken")
    )
    joined = purchases.withColumn("idempotency_key", F.concat(F.lit(CLAW_BACK_PREFIX), F.col("id").cast("string"))).join(
        keys, "idempotency_key", "left"
    )
    taken = F.coalesce("taken", F.lit(0))
    gateway = F.col("source").isin(*GATEWAY_SOURCES) & (F.coalesce("paypal_order_id", F.lit("")) != "")
    old = F.col("created_at").isNull() | (
        F.col("created_at").cast("timestamp") <= F.expr(f"timestamp'{as_of}' - interval {MIN_AGE_HOURS} hours")
    )
    return joined.select(
        "id", taken.alias("credits_taken_back"),
        (gateway & F.col("status").isin("pending", "failed", "completed")).alias("can_recheck"),
        ((F.col("status") == "refunded") & (taken == 0)).alias("can_take_back"),
        (gateway & (F.col("status") == "pending") & old).alias("can_mark_failed"),
    )
