"""Generation jobs: newest attempts, project status, versions, queue timing and download plans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.operators.costs import Tier, enabled, tier_array
from sitelake.operators.skew import newest_per_key, position_per_key, time_segment
from sitelake.session import Steps

RECENCY = ["created_at", "id"]


def preview_outcomes(jobs: DataFrame) -> DataFrame:
    """Newest preview job per (project, tier)."""
    previews = jobs.filter("scope = 'preview'")
    return newest_per_key(previews, ["project_id", "tier"], RECENCY, ["id", "overall_status", "failure_reason"])


def latest_tier(jobs: DataFrame) -> DataFrame:
    """Tier of each project's newest job of any scope."""
    return newest_per_key(jobs, ["project_id"], RECENCY, ["tier"]).withColumnRenamed("tier", "latest_tier")


def projects_with_tier(projects: DataFrame, jobs: DataFrame, tier: str, latest_only: bool = True) -> DataFrame:
    """Projects whose newest job used the tier, or (`latest_only=False`) that ever had a job of it."""
    matching = latest_tier(jobs).filter(F.col("latest_tier") == tier) if latest_only else jobs.filter(F.col("tier") == tier)
    return projects.join(matching.select(F.col("project_id").alias("id")), "id", "left_semi")


def finished_outputs(jobs: DataFrame, outputs: DataFrame, tiers: Sequence[Tier]) -> DataFrame:
    """Newest succeeded preview with an output per (project, tier), with its display position."""
    good = jobs.filter("scope = 'preview' and overall_status = 'succeeded'").join(
        outputs.select(F.col("job_id").alias("id"), "template_used"), "id"
    )
    newest = newest_per_key(good, ["project_id", "tier"], RECENCY, ["id", "template_used"])
    shown = enabled(tiers)
    position = F.coalesce(*[F.when(F.col("tier") == t.key, F.lit(i)) for i, t in enumerate(shown)], F.lit(len(shown)))
    return newest.withColumn("display_position", position)


def latest_page_count(snapshots: DataFrame) -> DataFrame:
    """Page count of the snapshot finished last; unfinished snapshots sort first, as in the source database."""
    order = F.struct(F.col("finished_at").isNull(), "finished_at", "id")
    return snapshots.groupBy("project_id").agg(F.max_by("page_count", order).alias("page_count"))


def latest_full_site_job(jobs: DataFrame, keys: Sequence[str] = ("project_id", "tier")) -> DataFrame:
    return newest_per_key(jobs.filter("scope = 'full_site'"), keys, RECENCY, ["id", "overall_status"])


def download_plan(page_count: Column, full_site_status: Column) -> Column:
    return (
        F.when(page_count <= 1, "fast_path")
        .when(full_site_status == "running", "already_building")
        .when(full_site_status == "succeeded", "fast_path")
        .otherwise("start_build")
    )


def download_plans(projects: DataFrame, snapshots: DataFrame, jobs: DataFrame, tier: str) -> DataFrame:
    full = latest_full_site_job(jobs.filter(F.col("tier") == tier), ["project_id"]).select("project_id", "overall_status")
    joined = projects.select(F.col("id").alias("project_id")).join(latest_page_count(snapshots), "project_id", "left").join(
        full, "project_id", "left"
    )
    pages = F.coalesce("page_count", F.lit(1))
    return joined.select("project_id", pages.alias("page_count"), download_plan(pages, F.col("overall_status")).alias("plan"))


def versions(blueprints: DataFrame, seconds: int = 30 * 86_400) -> DataFrame:
    """Version number per project in time order, and a mark on the newest row."""
    numbered = position_per_key(blueprints, ["project_id"], ["created_at", "id"], time_segment("created_at", seconds), "version")
    newest = blueprints.groupBy("project_id").agg(F.count("*").alias("_last"))
    return numbered.join(newest, "project_id").withColumn("is_current", F.col("version") == F.col("_last")).drop("_last")


def current_versions(blueprints: DataFrame) -> DataFrame:
    """The newest rows of `versions` alone: their number is the count of the project's rows, so nothing is numbered or sorted."""
    newest = blueprints.groupBy("project_id").agg(F.max(F.struct("created_at", "id")).alias("_newest"), F.count("*").alias("version"))
    return newest.select("project_id", "_newest.id", "_newest.created_at", "version", F.lit(True).alias("is_current"))


def project_status(projects: DataFrame, jobs: DataFrame, tiers: Sequence[Tier]) -> DataFrame:
    """Status from the newest preview of each enabled tier; disabled tiers never count.

    Only counts are needed: a tier settles at most once per project after `preview_outcomes`.
    """
    keys = [t.key for t in enabled(tiers)]
    settled = preview_outcomes(jobs).filter(F.col("tier").isin(*keys) if keys else F.lit(False)).groupBy("project_id").agg(
        F.count_if(F.col("overall_status").isin("succeeded", "failed")).alias("settled"),
        F.count_if(F.col("overall_status") == "succeeded").alias("succeeded"),
    )
    joined = projects.select(F.col("id").alias("project_id")).join(settled, "project_id", "left")
    status = (
        F.when(F.coalesce("settled", F.lit(0)) < len(keys), "generating")
        .when(F.coalesce("succeeded", F.lit(0)) > 0, "ready")
        .otherwise("failed")
    )
    return joined.select("project_id", status.alias("status"))


def all_tiers_settled(jobs: DataFrame, tiers: Sequence[Tier]) -> DataFrame:
    """Coverage test: is every enabled tier among the project's settled tiers?"""
    wanted = F.array(*[F.lit(t.key) for t in enabled(tiers)]).cast("array<string>")
    done = F.collect_set(F.when(F.col("overall_status").isin("succeeded", "failed"), F.col("tier")))
    return preview_outcomes(jobs).groupBy("project_id").agg((F.size(F.array_except(wanted, done)) == 0).alias("covered"))


def tier_lists(jobs: DataFrame, tiers: Sequence[Tier]) -> DataFrame:
    """Failed tiers with reasons and running tiers per project, in display order.

    The collected lists hold at most one entry per configured tier.
    """
    shown = enabled(tiers)
    order = F.coalesce(*[F.when(F.col("tier") == t.key, F.lit(t.sort_order)) for t in shown])
    rows = preview_outcomes(jobs).withColumn("_order", order).filter("_order is not null")
    failed = F.when(
        F.col("overall_status") == "failed", F.struct("_order", F.concat_ws(":", "tier", "failure_reason").alias("text"))
    )
    running = F.when(F.col("overall_status") == "running", F.struct("_order", F.col("tier").alias("text")))

    def listed(entry: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), ",")

    return rows.groupBy("project_id").agg(listed(failed).alias("failed_tiers"), listed(running).alias("running_tiers"))


def retryable(jobs: DataFrame, tiers: Sequence[Tier]) -> DataFrame:
    """Enabled tiers whose newest preview failed."""
    keys = [t.key for t in enabled(tiers)]
    failed = preview_outcomes(jobs).filter(F.col("overall_status") == "failed")
    return failed.filter(F.col("tier").isin(*keys)).select("project_id", "tier", "failure_reason")


def missing_files(jobs: DataFrame, files: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required output files a job has not written. The required names are a short literal list."""
    wanted = jobs.select("job_id", F.explode(F.array(*[F.lit(name) for name in required])).alias("file"))
    return wanted.join(files.select("job_id", "file"), ["job_id", "file"], "left_anti")


def queue_order(queue: DataFrame, seconds: int = 30 * 86_400) -> DataFrame:
    """Claim position of every queued row, without sorting the queue in one task."""
    waiting = queue.filter("status = 'queued'")
    return position_per_key(waiting, [], ["created_at", "id"], time_segment("created_at", seconds), "backlog_position")


def _seconds(later: str, earlier: str) -> Column:
    return F.unix_timestamp(F.col(later).cast("timestamp")) - F.unix_timestamp(F.col(earlier).cast("timestamp"))


def wait_seconds() -> Column:
    return _seconds("started_at", "created_at")


def queue_timing(queue: DataFrame) -> DataFrame:
    """Waits and run times in whole seconds by task. Exact percentiles keep a count per distinct second, no more than the longest
    wait has, and are combined before the shuffle."""
    wait, run = wait_seconds(), _seconds("finished_at", "started_at")
    return queue.groupBy("task_name").agg(
        F.count("*").alias("jobs"),
        F.round(F.avg(wait), 6).alias("avg_wait"), F.percentile(wait, F.lit(0.5)).alias("median_wait"),
        F.round(F.avg(run), 6).alias("avg_run"), F.percentile(run, F.lit(0.95)).alias("p95_run"),
    )


#: Size of a sketch and the rank error that quantiles from it keep to, also after merging (with 99 % confidence 0.013 at this size).
SKETCH_SIZE, SKETCH_ERROR = 200, 0.02


def wait_sketches(queue: DataFrame) -> DataFrame:
    """Quantile sketches of the waits by task and day (task_name, day, waits, sketch): a few kilobytes each, whatever the day held.

    Days are kept as they close; any span of them is answered by merging, without the rows.
    """
    day = F.col("created_at").cast("date").alias("day")
    started = queue.filter("started_at is not null").select("task_name", day, wait_seconds().cast("long").alias("wait"))
    return started.groupBy("task_name", "day").agg(F.count("*").alias("waits"), F.kll_sketch_agg_bigint("wait", F.lit(SKETCH_SIZE)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, at: Sequence[float]) -> DataFrame:
    """task_name, waits, quantiles (an array, in the order of `at`) over the given days; ranks are within SKETCH_ERROR of those asked."""
    merged = sketches.groupBy("task_name").agg(F.sum("waits").alias("waits"), F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_SIZE)).alias("sketch"))
    return merged.select("task_name", "waits", F.array(*(F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)) for q in at)).alias("quantiles"))


def project_listing(projects: DataFrame, users: DataFrame, jobs: DataFrame) -> DataFrame:
    """Projects with owner e-mail and latest tier."""
    owners = users.select(F.col("id").alias("user_id"), "email")
    tiers = latest_tier(jobs).withColumnRenamed("project_id", "id")
    return projects.join(owners, "user_id").join(tiers, "id", "left")


def project_detail(
    projects: DataFrame, users: DataFrame, jobs: DataFrame, outputs: DataFrame, job_costs: DataFrame, versions: DataFrame, paid: DataFrame, passes: int = 2
) -> DataFrame:
    """One row per (project, job) with owner, current blueprint, the owner's paid tiers, output and cost.

    Rows stay flat so a project may own any number of jobs. `versions` is what `versions` or `current_versions` gives, `paid` what `ledger.paid_tiers` gives.
    Jobs with output and cost are written first, by `passes` shares of the jobs, then projects with what they have once, so that the disk
    holds little of what was moved by job, by owner and by project at a time.
    """
    steps = Steps(projects.sparkSession, "project-detail")
    runs = jobs.select(F.col("id").alias("job_id"), "project_id", "tier", "overall_status", F.col("created_at").alias("job_created_at"))
    shares = []
    for i in range(passes):
        share = F.pmod(F.hash("job_id"), F.lit(passes)) == i
        joined = runs.filter(share).join(outputs.select("job_id", "template_used").filter(share), "job_id", "left").join(job_costs.filter(share), "job_id", "left")
        shares.append(steps.write(f"details-{i}", joined))
        del joined  # what a share was moved by is let go before the next
    details = reduce(DataFrame.unionByName, shares)
    heads = projects.select(F.col("id").alias("project_id"), "user_id", "source_url", "status").join(
        users.select(F.col("id").alias("user_id"), "email"), "user_id"
    )
    current = versions.filter("is_current").select("project_id", F.col("id").alias("blueprint_id"), F.col("version").alias("blueprint_version"))
    # By owner and project first: what follows then moves heads by project once.
    heads = heads.join(paid.withColumnRenamed("tiers", "paid_tiers"), ["user_id", "project_id"], "left").join(current, "project_id", "left")
    heads = steps.write("heads", heads)
    return heads.join(details, "project_id", "left")


def tier_rows(df: DataFrame, tiers: Sequence[Tier]) -> DataFrame:
    return df.withColumn("t", F.explode(tier_array(enabled(tiers)))).select("*", "t.*").drop("t")
