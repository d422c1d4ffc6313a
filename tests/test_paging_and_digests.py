from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelake.functions import urls
from sitelake.functions.sql import register_functions
from sitelake.operators import analytics, blueprint as B, elements as E, jobs as J, linkgraph as G
from sitelake.sources.pages import bucketed_pages


def listing(spark, n=500):
    rng = random.Random(8)
    rows = [(rng.randint(1, 40), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "score int, id int").repartition(5)


def test_every_page_of_a_listing(spark, tmp_path):
    rows, df = listing(spark)
    wanted = sorted(rows, key=lambda r: (-r[0], r[1]))
    kept = analytics.Listing(df, [F.desc("score"), F.asc("id")], str(tmp_path / "l"), ranges=6)
    assert kept.total == len(rows) and len(kept.sizes) > 3
    for number in (1, 2, 7, 8, 9):
        assert [tuple(r) for r in kept.page(number, 64).collect()] == wanted[(number - 1) * 64 : number * 64]
    assert analytics.Listing(df.limit(0), [F.asc("id")], str(tmp_path / "e")).page(1, 10).count() == 0


def test_deep_page_reads_its_ranges_only(spark, tmp_path):
    _, df = listing(spark)
    kept = analytics.Listing(df, [F.desc("score"), F.asc("id")], str(tmp_path / "l"), ranges=6)
    plan = kept.page(8, 64)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_pages_one_after_the_other(spark):
    rows, df = listing(spark, 90)
    wanted, seen, last = sorted(rows, key=lambda r: (-r[0], r[1])), [], None
    while True:
        page = [tuple(r) for r in analytics.page_after(df, [("score", False), ("id", True)], last, 40).collect()]
        if not page:
            break
        seen += page
        last = page[-1]
    assert seen == wanted


@pytest.mark.parametrize("part_pages", [1, 3, 1_000])
def test_digest_of_all_other_pages(spark, part_pages):
    sites = {"a": ["one", "two", None, "ünf", "", "six", "seven"], "b": ["alone"], "c": ["", ""]}
    rows = [(f"{s}{i}", s, i, t) for s, texts in sites.items() for i, t in enumerate(texts)]
    found = {r.page_id: r.digest for r in G.site_digest(spark.createDataFrame(rows, "page_id string, site string, page_no int, summary string"), part_pages).collect()}
    for s, texts in sites.items():
        for i in range(len(texts)):
            others = [t or "" for j, t in enumerate(texts) if j != i]
            assert found[f"{s}{i}"] == ("\n\n".join(others) if others else "(single-page site, no other pages)")


@pytest.mark.parametrize("part_pages", [3, 1_000])
def test_digests_of_a_large_site_are_dealt_over_tasks(spark, part_pages):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        texts = [f"ü{i}" for i in range(200)]
        rows = spark.createDataFrame([(i, "s", i, t) for i, t in enumerate(texts)], "page_id long, site string, page_no int, summary string")
        found = G.site_digest(rows, part_pages, **({"slice_pages": 10} if "slice_pages" in G.site_digest.__code__.co_varnames else {}))
        held = found.select("page_id", "digest", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert {r.page_id: r.digest for r in held} == {i: "\n\n".join(texts[:i] + texts[i + 1 :]) for i in range(200)}
    assert len({r.task for r in held}) > 3


def test_texts_of_large_sites_are_copied_a_bounded_number_of_times(spark):
    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(500).selectExpr("id as page_id", "if(id < 480, 'large', 'small') as site", "cast(if(id < 480, id, id - 480) as int) as page_no", "concat('ü', id) as summary")
        digests = G.site_digest(rows, 100, slice_pages=2)
        found = {r.page_id: r.digest for r in digests.collect()}
        made = [n.metrics().apply("numOutputRows").value() for n in nodes(digests._jdf.queryExecution().executedPlan()) if n.nodeName() == "Generate"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for part in (range(480), range(480, 500)):
        assert all(found[i] == "\n\n".join(f"ü{j}" for j in part if j != i) for i in part)
    assert made == [64 + 10]  # 250 before: one for every two pages


def test_page_bodies_stay_in_their_buckets(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, f"https://s.example/p{i}", f'<body><img src="/i{i}.png"><p>Text {i}</p></body>') for i in range(30)]
        pages = bucketed_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
        assets = spark.createDataFrame([("s.example", f"https://s.example/i{i}.png", f"image/{i}.png", i) for i in range(0, 30, 2)], "site string, original_url string, storage_path string, seq long")
        found = B.with_asset_paths(E.with_elements(pages), assets, urls.authority("url"))
        assert {r.page_id: dict(r.asset_paths) for r in found.select("page_id", "asset_paths").collect()} == {i: ({f"/i{i}.png": f"image/{i}.png"} if i % 2 == 0 else {}) for i in range(30)}
        plan = found._jdf.queryExecution().executedPlan()
        moved = [line for line in plan.toString().split("\n") if "Exchange hashpartitioning" in line]
        assert moved and all("html" not in line and "elements" not in line for line in moved)
        # What is below an exchange never carries bodies: those are read from buckets.
        assert "Bucketed: true" in plan.toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketches_of_days_merge(spark):
    rng = random.Random(3)
    rows = [("t", 86_400 * rng.randint(0, 9), rng.randint(1, 50_000)) for _ in range(4_000)]
    queue = spark.createDataFrame(rows, "task_name string, at long, wait long").select(
        "task_name", F.timestamp_seconds("at").alias("created_at"), F.timestamp_seconds(F.col("at") + F.col("wait")).alias("started_at"))
    sketches = J.wait_sketches(queue)
    assert sketches.count() == 10 and sketches.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    found = J.sketched_quantiles(sketches, [0.5, 0.95]).first()
    waits = sorted(w for _, _, w in rows)
    for q, value in zip((0.5, 0.95), found.quantiles):
        assert waits[int(max(0, q - J.SKETCH_ERROR) * 4_000)] <= value <= waits[min(3_999, int((q + J.SKETCH_ERROR) * 4_000))]


def test_elements_of_named_tags(spark):
    register_functions(spark)
    pages = spark.createDataFrame([(1, "<body><p>a</p><img src=x><p>b</p></body>"), (2, None), (3, "")], "page_id long, html string")
    rows = spark.sql("select page_id, tag, attrs from page_elements(table(select page_id, html from {pages}), 'p IMG')", pages=pages).collect()
    assert Counter((r.page_id, r.tag) for r in rows) == {(1, "p"): 2, (1, "img"): 1} and any(r.attrs == {"src": "x"} for r in rows)


def test_widget_for_some_blueprints(spark):
    def boxes():
        return F.transform(F.filter("elements", lambda e: E.has_class(e, "box")), lambda e: F.struct(
            E.joined_text(e).alias("name"), F.lit("").alias("role"), F.lit("").alias("bio"), F.lit(None).cast("string").alias("photo")))

    pages = spark.createDataFrame([(1, "https://s.example/", "<body><h1>Hi</h1><p class=box>Ann</p></body>")], "page_id long, url string, html string")
    with B.widget("team", boxes):
        found = B.page_blueprints(pages)
    assert "team" not in B.WIDGETS
    assert [m.name for m in found.select("sections.team").first()[0]] == ["Ann"]
    assert B.page_blueprints(pages).select(F.size("sections.team")).first()[0] == 0
