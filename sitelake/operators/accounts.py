"""Users, identities and credit packs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelake.operators.costs import Tier, enabled, gate_info, tier_array
from sitelake.operators.ledger import SIGNUP_GRANT
from sitelake.operators.skew import first_n_per_key

# Fixed values.
SMALL_PACK_CENTS = 500
DETAIL_PROJECTS = 100


def user_listing(users: DataFrame, wallets: DataFrame, projects: DataFrame) -> DataFrame:
    """Users with wallet balance and project count, zero where there is none."""
    counts = projects.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("projects"))
    joined = users.join(wallets.select(F.col("user_id").alias("id"), "balance"), "id", "left").join(counts, "id", "left")
    return joined.withColumns({"balance": F.coalesce("balance", F.lit(0)), "projects": F.coalesce("projects", F.lit(0))})


def user_detail(users: DataFrame, ledger: DataFrame, purchases: DataFrame, projects: DataFrame) -> DataFrame:
    """Everything shown about a user as flat rows: all ledger rows and purchases, the newest 100 projects."""
    newest = first_n_per_key(projects, ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], DETAIL_PROJECTS)

    def part(df: DataFrame, kind: str, amount: str) -> DataFrame:
        return df.select("user_id", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("ref"),
                         F.expr(amount).cast("long").alias("amount"), F.col("created_at").cast("date").alias("day"))

    rows = part(ledger, "ledger", "amount").unionByName(part(purchases, "purchase", "credits_granted")).unionByName(
        part(newest, "project", "null")
    )
    return users.select(F.col("id").alias("user_id"), "email", "balance").join(rows, "user_id")


def link_identities(claims: DataFrame, identities: DataFrame, users: DataFrame) -> DataFrame:
    """Outcome of each verified sign-in: known identity, known e-mail, or a new account with its grant.

    New accounts produce two rows (user and grant); an e-mail claimed twice creates one account.
    """
    known = identities.select("provider", "subject", F.col("user_id").alias("by_subject"))
    mails = users.select("email", F.col("id").alias("by_email"))
    active = users.select(F.col("id").alias("user_id"), "is_active")
    matched = claims.join(known, ["provider", "subject"], "left").join(mails, "email", "left").withColumn(
        "user_id", F.coalesce("by_subject", "by_email")
    ).join(active, "user_id", "left")
    action = (
        F.when(~F.col("verified"), "rejected_unverified")
        .when(F.col("user_id").isNotNull() & ~F.col("is_active"), "rejected_inactive")
        .when(F.col("by_subject").isNotNull(), "signed_in")
        .when(F.col("by_email").isNotNull(), "linked_by_email")
        .otherwise("created")
    )
    decided = matched.withColumn("action", action)
    none = F.lit(None).cast("long")
    old = decided.filter("action <> 'created'").select("claim_id", "email", "action", "user_id", none.alias("amount"))
    fresh = decided.filter("action = 'created'").groupBy("email").agg(F.min("claim_id").alias("claim_id"))
    grown = fresh.withColumn("action", F.explode(F.array(F.lit("created"), F.lit("signup_grant"))))
    amount = F.when(F.col("action") == "signup_grant", F.lit(SIGNUP_GRANT).cast("long"))
    return old.unionByName(grown.select("claim_id", "email", "action", none.alias("user_id"), amount.alias("amount")))


def display_order(packs: DataFrame) -> DataFrame:
    return packs.filter("is_active").orderBy("sort_order", "price_usd_cents", "id")


def pack_value_sheet(packs: DataFrame, tiers: Sequence[Tier]) -> DataFrame:
    """Each pack against every enabled tier: cents per credit and whole downloads it buys."""
    rows = packs.withColumn("t", F.explode(tier_array(enabled(tiers))))
    downloads = F.floor(F.col("credits") / F.col("t.download_cost"))
    return rows.select(
        "id", "t.tier", F.round(F.col("price_usd_cents") / F.col("credits"), 4).alias("cents_per_credit"),
        downloads.alias("downloads"), (F.col("price_usd_cents") < SMALL_PACK_CENTS).alias("is_small"),
    ).filter("downloads > 0")


def best_value_pack(packs: DataFrame, *catalogue: str) -> DataFrame:
    """Lowest price per credit in each catalogue of at least two packs; the first in display order wins ties."""
    rank = F.struct(F.col("price_usd_cents") / F.col("credits"), "sort_order", "price_usd_cents", "id")
    return packs.groupBy(*catalogue).agg(F.when(F.count("*") >= 2, F.min_by("id", rank)).alias("best_pack"))


def covering_pack(requests: DataFrame, packs: DataFrame, width: int = 1000) -> DataFrame:
    """Smallest pack whose credits cover `need`, else the largest pack; an explicit pack on sale wins.

    A keyless as-of lookup without pairing requests with packs: distinct needs and pack sizes are laid
    on one axis, cut into ranges of `width` credits; each range is scanned on its own and one row per
    range carries the next pack size downwards.
    """
    display = F.struct("sort_order", "price_usd_cents", "id")
    sizes = packs.groupBy(F.col("credits").alias("at")).agg(F.min_by("id", display).alias("pack"))
    needs = requests.select(F.col("need").alias("at")).distinct().withColumn("pack", F.lit(None).cast("long"))
    axis = sizes.withColumn("is_need", F.lit(False)).unionByName(needs.withColumn("is_need", F.lit(True)))
    axis = axis.withColumn("range", F.floor(F.col("at") / width))
    # Walking down the axis, a pack of the same size comes before the need it covers.
    inside = Window.partitionBy("range").orderBy(F.desc("at"), F.asc("is_need")).rowsBetween(Window.unboundedPreceding, 0)
    near = axis.withColumn("near", F.last("pack", ignorenulls=True).over(inside))
    smallest = axis.groupBy("range").agg(F.min_by("pack", F.when(~F.col("is_need"), F.col("at"))).alias("pack"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    carry = smallest.select("range", F.last("pack", ignorenulls=True).over(above).alias("far"))
    covered = near.filter("is_need").join(carry, "range").select(F.col("at").alias("need"), F.coalesce("near", "far").alias("covering"))
    largest = packs.agg(F.min_by("id", F.struct(-F.col("credits"), display))).scalar()
    on_sale = packs.select(F.col("id").alias("asked_pack"), F.lit(True).alias("on_sale"))
    chosen = requests.join(covered, "need").join(on_sale, "asked_pack", "left")
    pack = F.when(F.col("on_sale"), F.col("asked_pack")).otherwise(F.coalesce("covering", largest))
    return chosen.select("request_id", "need", pack.alias("pack_id"))


def approvals(gated: DataFrame, tiers: Sequence[Tier], usd_per_credit: float) -> DataFrame:
    """Gated projects whose owner can pay start one row per snapshotted tier; the others stay pending."""
    priced = gate_info(gated, usd_per_credit)
    keys = F.array(*[F.lit(t.key) for t in enabled(tiers)])
    go = priced.filter("shortfall_credits = 0").select("project_id", F.lit("generating").alias("status"), F.explode(keys).alias("tier"))
    wait = priced.filter("shortfall_credits > 0").select(
        "project_id", F.lit("awaiting_cost_approval").alias("status"), F.lit(None).cast("string").alias("tier")
    )
    return go.unionByName(wait)


def submittable(submissions: DataFrame, wallets: DataFrame) -> DataFrame:
    """Submissions marked by whether the client's balance holds at least one credit."""
    joined = submissions.join(wallets.select("user_id", "balance"), "user_id", "left")
    return joined.withColumn("allowed", F.coalesce("balance", F.lit(0)) >= 1)
