"""Faults that only showed on larger tables: folders of files, open references, parts of sites, single precision, long wallets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.functions.html import _flatten
from sitelake.operators import jobs as J, ledger as L
from sitelake.plans import load_all
from sitelake.plans.palette_and_audit import pixels
from sitelake.streaming import run, state

PAGE = '<html><head><title>A &amp; B&amp</title></head><body><nav><a href="/x">X</a></nav><h1>A &amp; B&amp</h1></body></html>'


def test_a_table_in_several_files_streams_like_one_file(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://s.test/{i}", PAGE) for i in range(6)], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    pages.write.parquet(str(tmp_path / "other.parquet"))
    assert run.drain(run.table_stream(spark, str(tmp_path), "pages")).count() == 6
    for name in ("streamed_blueprints", "streamed_page_elements"):
        assert load_all()[name].build(spark, str(tmp_path)).count() == 6


def test_named_references_need_their_semicolon():
    page = _flatten('<p title="a&amp b &lt;">x &amp; y&amp</p><script>a &&b &amp c</script>&#65 &am &amp')
    assert [t["text"] for t in page["texts"]] == ["x & y&amp", "a &&b &amp c", "A &am &amp"]
    assert dict(page["elements"][1]["attrs"]) == {"title": "a&amp b <"}


def test_manifests_in_parts_keep_the_page_numbers_of_the_site(spark, tmp_path):
    pages = spark.range(2_300).select(F.col("id").alias("page_id"), F.format_string("https://s.test/%d", "id").alias("url"), F.lit("").alias("html"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    rows = load_all()["crawl_manifests"].build(spark, str(tmp_path)).select("page_no", "url").collect()
    assert sorted(rows) == [(i, f"https://s.test/{i}") for i in range(2_300)]


def test_colour_levels_are_cut_in_single_precision(spark, tmp_path):
    near = (np.arange(256, dtype=np.float32) / np.float32(255)) - np.float32(0.5)
    values = np.concatenate([near, np.nextafter(near, np.float32(1)), np.nextafter(near, np.float32(-1))]).reshape(-1, 64)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))

    def levels(v, half, steps):
        return np.floor((np.clip(v, -half, half) + half) * steps).astype(int)

    want = levels(values, np.float32(0.5), np.float32(255))
    starts = [*range(1, 62, 3), 62]
    assert (want != levels(values.astype(float), 0.5, 255.0))[:, [i - 1 for i in starts]].any()
    got = {(r["vec_id"], r["n"] - 1): r["r"] for r in pixels(spark, str(tmp_path)).collect()}
    assert got == {(v, i * 7 % 50): want[v][i - 1] for v in range(len(values)) for i in starts}


@pytest.mark.parametrize("seed", range(5))
def test_summaries_of_a_long_wallet_hold_no_more_pieces_than_its_largest_debit(seed):
    rng = np.random.default_rng(seed)
    amounts = [int(a) for a in rng.integers(-40, 45, 3_000)]
    low, runs = 0, []
    for at in range(0, 3_000, 100):
        run_of = amounts[at : at + 100]
        runs.append((low, L.transfer_pieces(run_of, low, 40)))
        for a in run_of:
            low = max(low + a, 0)
    whole = reduce(lambda x, y: L.then(x, y, 40), [r for _, r in runs])
    assert all(len(starts) <= 40 for _, (starts, _) in runs) and len(whole[0]) <= 40
    for begin in range(40):
        balance = begin
        for at, (first, (starts, shifts)) in enumerate(runs):
            assert first <= balance < first + 40
            now = balance + shifts[np.searchsorted(starts, balance, side="right") - 1]
            for a in amounts[100 * at : 100 * at + 100]:
                balance += a if a >= 0 or balance + a >= 0 else 0
            assert balance == now
        assert balance == begin + whole[1][np.searchsorted(whole[0], begin, side="right") - 1]


def test_lifecycle_and_stale_purchases_of_a_stream_call_no_python_for_each(spark, tmp_path):
    rows = [(p, 10 * p + i, i * hours, effect) for p, hours, effects in ((1, 1, "none pending"), (2, 1, "failed completed"), (3, 1, "completed refund_event"), (4, 40, "none none"))
            for i, effect in enumerate(effects.split())]
    events = spark.createDataFrame(rows, "purchase_id long, event_id long, h long, effect string").select(
        "purchase_id", "event_id", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "effect", F.lit(7).cast("long").alias("credits_granted"))
    updates = state.lifecycle_updates(run.landed(events, 2, F.col("event_id")))
    assert "transformWithState" not in updates._jdf.queryExecution().analyzed().toString()
    found = run.drain_updates(updates, ["purchase_id"])
    assert sorted(tuple(r) for r in found.select("purchase_id", "status", "credits_granted", "events").collect()) == [
        (1, "pending", 0, 2), (2, "completed", 7, 2), (3, "refunded", 7, 2), (4, "pending", 0, 2)]
    assert sorted(r["purchase_id"] for r in state.stale(found).collect()) == [1, 4]


def test_project_detail_keeps_what_moves_by_job_and_by_project_apart(spark):
    projects = spark.createDataFrame([(1, 7, "u1", "ready"), (2, 7, "u2", "failed"), (3, 8, "u3", "ready"), (4, 9, "u4", "ready")], "id long, user_id long, source_url string, status string")
    users = spark.createDataFrame([(7, "a@x"), (8, "b@x")], "id long, email string")
    jobs = spark.createDataFrame([("j1", 1, "pro", "succeeded", "d1"), ("j2", 1, "basic", "failed", "d2"), ("j3", 3, "pro", "running", "d3"), ("j4", 5, "pro", "failed", "d4")],
        "id string, project_id long, tier string, overall_status string, created_at string")
    outputs = spark.createDataFrame([("j1", "t1"), ("j1", "t2"), ("j4", "t3"), ("j9", "t4")], "job_id string, template_used string")
    costs = spark.createDataFrame([("j1", 0.5), ("j3", 0.25)], "job_id string, cost_usd double")
    blueprints = spark.createDataFrame([("b1", 1, 1), ("b2", 1, 2), ("b3", 4, 1)], "id string, project_id long, created_at int")
    paid = spark.createDataFrame([(7, 1, "basic,pro"), (8, 1, "premium")], "user_id long, project_id long, tiers string")
    found = J.project_detail(projects, users, jobs, outputs, costs, J.current_versions(blueprints), paid)
    columns = "project_id user_id source_url status email blueprint_id blueprint_version paid_tiers job_id tier overall_status job_created_at template_used cost_usd".split()
    first = (1, 7, "u1", "ready", "a@x", "b2", 2, "basic,pro")
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted([
        (*first, "j1", "pro", "succeeded", "d1", "t1", 0.5), (*first, "j1", "pro", "succeeded", "d1", "t2", 0.5), (*first, "j2", "basic", "failed", "d2", None, None),
        (2, 7, "u2", "failed", "a@x", None, None, None, *[None] * 6), (3, 8, "u3", "ready", "b@x", None, None, None, "j3", "pro", "running", "d3", None, 0.25)], key=str)
    # Only projects and jobs are left to meet; what each has was joined in steps that are over.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
