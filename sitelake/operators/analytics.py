"""Overview figures and paged listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.operators.costs import since


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int, with_total: bool = True) -> DataFrame:
    """One page in the given order and, unless left out, the row count before paging.

    For a page or two of a listing that is asked once: the sort keeps only the first `page * size` rows per task, the count is a
    scalar subquery. `Listing` serves deep pages.
    """
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.withColumn("total", df.agg(F.count("*")).scalar()) if with_total else rows


class Listing:
    """A listing kept in ranges of its order, for any page at the cost of the ranges it lies in.

    Rows are sorted once into about equal ranges and written below `folder`, a folder per range; the row counts of the ranges, a
    number for each, say in which a page begins. Reading a page touches only those folders, however deep it is.
    """

    def __init__(self, df: DataFrame, order: Sequence[Column], folder: str, ranges: int | None = None):
        spark = df.sparkSession
        self.order, self.columns = list(order), df.columns
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy("_range").parquet(folder)
        self.rows = spark.read.schema(dealt.schema).parquet(folder)
        self.sizes = sorted((r["_range"], r["n"]) for r in self.rows.groupBy("_range").agg(F.count("*").alias("n")).collect())
        self.total = sum(n for _, n in self.sizes)

    def page(self, number: int, size: int) -> DataFrame:
        """Page `number` (from 1) of `size` rows; empty beyond the end."""
        begin, touched, skipped, seen = (number - 1) * size, [], 0, 0
        for name, n in self.sizes:
            if seen + n <= begin:
                skipped += n
            elif seen < begin + size:
                touched.append(name)
            seen += n
        rows = self.rows.filter(F.col("_range").isin(touched)) if touched else self.rows.limit(0)
        return rows.orderBy(*self.order).offset(begin - skipped).limit(size).select(*self.columns)


def page_after(df: DataFrame, keys: Sequence[tuple[str, bool]], last: Sequence | None, size: int) -> DataFrame:
    """The `size` rows that follow the row with the key values `last` (the first rows for None): paging without counting.

    `keys` are (column, ascending) without nulls, together unique. The seek is a filter that reaches the files, and the sort keeps
    `size` rows per task.
    """
    order = [F.asc(c) if up else F.desc(c) for c, up in keys]
    if last is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (c, up), value in zip(keys, last):
            beyond = beyond | (equal & ((F.col(c) > F.lit(value)) if up else (F.col(c) < F.lit(value))))
            equal = equal & (F.col(c) == F.lit(value))
        name, up = keys[0]
        df = df.filter((F.col(name) >= F.lit(last[0])) if up else (F.col(name) <= F.lit(last[0]))).filter(beyond)
    return df.orderBy(*order).limit(size)


def success_rate_pct(in_scope: Column | None = None) -> Column:
    """Succeeded share of settled jobs in percent, one decimal; null when nothing has settled."""
    scope = F.lit(True) if in_scope is None else in_scope
    good = F.count_if(scope & (F.col("overall_status") == "succeeded"))
    settled = F.count_if(scope & F.col("overall_status").isin("succeeded", "failed"))
    return F.round(F.try_divide(100.0 * good, settled), 1)


def overview(
    users: DataFrame, projects: DataFrame, jobs: DataFrame, costed: DataFrame, purchases: DataFrame, as_of: str, days: int
) -> DataFrame:
    """Twelve headline figures, one pass per table; the single-row results meet as scalar subqueries."""
    recent = since("created_at", as_of, days, "date")

    def dollars(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("amount_usd_cents"))), F.lit(0)) / 100

    user_row = users.agg(
        F.count("*").alias("users_total"), F.count_if(recent).alias("users_new_in_range"), F.sum("balance").alias("credits_outstanding")
    )
    project_row = projects.agg(F.struct(F.count("*").alias("projects_total"), F.count_if(recent).alias("projects_in_range")))
    job_row = jobs.agg(
        F.struct(
            success_rate_pct(recent).alias("generation_success_rate_pct"),
            F.count_if(F.col("overall_status") == "running").alias("active_jobs_running"),
        )
    )
    cost_row = costed.agg(
        F.struct(
            F.round(F.coalesce(F.sum(F.when(recent, F.col("cost_usd"))), F.lit(0.0)), 6).alias("ai_cost_usd_in_range"),
            F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("ai_cost_usd_all_time"),
        )
    )
    money_row = purchases.filter("status = 'completed' and source <> 'mock'").agg(
        F.struct(dollars(recent).alias("revenue_usd_in_range"), dollars(F.lit(True)).alias("revenue_usd_all_time"))
    )
    combined = user_row.select("*", *[row.scalar().alias(n) for n, row in
                                      (("p", project_row), ("j", job_row), ("c", cost_row), ("m", money_row))])
    flat = combined.select("users_total", "users_new_in_range", "credits_outstanding", "p.*", "j.*", "c.*", "m.*")
    return flat.withColumn("net_margin_usd_in_range", F.round(F.col("revenue_usd_in_range") - F.col("ai_cost_usd_in_range"), 6))


def revenue_breakdown(purchases: DataFrame, as_of: str, days: int) -> DataFrame:
    recent = since("created_at", as_of, days, "date")
    cents = F.col("amount_usd_cents")

    def dollars(condition: Column) -> Column:
        return F.sum(F.when(condition, cents).otherwise(0)) / 100

    real = purchases.filter("status = 'completed' and source <> 'mock'")
    return real.agg(
        dollars(recent).alias("revenue_usd_in_range"),
        dollars(F.lit(True)).alias("revenue_usd_all_time"),
        dollars(recent & (F.col("source") == "paypal")).alias("paypal_revenue_usd_in_range"),
        dollars(recent & (F.col("source") == "manual_admin")).alias("manual_revenue_usd_in_range"),
        F.count_if(recent).alias("purchase_count_in_range"),
    )


def payment_tiles(purchases: DataFrame, as_of: str, days: int, approximate: bool = False) -> DataFrame:
    """Gateway purchase counts; `approximate` trades exact payer counts for a fixed-size sketch."""
    done = F.col("status") == "completed"
    payer = F.when(done, F.col("user_id"))
    return purchases.filter("source = 'paypal'").agg(
        F.count_if(done & since("created_at", as_of, days, "date")).alias("purchases_in_range"),
        F.count_if(F.col("status") == "pending").alias("pending_purchases"),
        F.count_if((F.col("status") == "refunded") & since("refunded_at", as_of, days, "date")).alias("refunds_in_range"),
        (F.approx_count_distinct(payer) if approximate else F.count_distinct(payer)).alias("paying_users"),
    )
