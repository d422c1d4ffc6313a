from __future__ import annotations

import json

from pyspark.sql import functions as F

from sitelake import schemas
from sitelake.operators import costs, proposals as R
from sitelake.sources import documents as D, packages as K, pages as C, tables as T
from sitelake.streaming import submissions as W


def test_manifest_html_tree_and_package_listing(spark, tmp_path):
    site = tmp_path / "site"
    (site / "pages").mkdir(parents=True)
    (site / "pages" / "index.html").write_text("<html>é</html>", encoding="utf-8")
    (site / "blueprint.json").write_text("{}")
    (site / "pages" / "_debug_trace_1.json").write_text("{}")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "good.json").write_text(json.dumps({"project_id": "p", "pages": [{"url": "u", "http_status": 200, "storage_path": "s", "extra": 1}], "assets": []}, indent=1))
    (tmp_path / "m" / "bad.json").write_text('{"project_id": ')
    manifests = C.read_manifests(spark, str(tmp_path / "m"))
    assert sorted(r["_corrupt"] is None for r in manifests.collect()) == [False, True]
    assert [tuple(r) for r in C.manifest_pages(manifests).collect()] == [("p", 0, "u", 200, "s")]
    assert [r["html"] for r in C.read_html_tree(spark, str(site)).collect()] == ["<html>é</html>"]
    listed = K.packaged(K.read_package_listing(spark, str(site)))
    assert [r["path"] for r in listed.collect()] == ["pages/index.html"]


def test_documents_are_completed_and_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([('{"meta":{"site_name":"A","unknown":1},"pages":[{"page_url":"u","sections":{"faq":[{"question":"q"}]}}]}',)], "document string")
    done = D.parse_blueprints(raw).withColumn("host", F.lit("a.test"))
    row = done.first()["blueprint"]
    assert (row["meta"]["tagline"], row["meta"]["logo"], row["navigation"]) == ("", None, [])
    assert row["pages"][0]["sections"]["faq"][0]["answer"] == "" and row["pages"][0]["sections"]["hero"]["background_image"] is None
    D.write_blueprints(done, str(tmp_path / "b"))
    assert D.read_blueprints(spark, str(tmp_path / "b")).first()["blueprint"] == row


def test_usage_append_prices_once(spark, tmp_path):
    pricing = spark.createDataFrame(list(costs.SEED_PRICES), "model_name string, prompt_price_per_1m double, completion_price_per_1m double")
    usage = spark.createDataFrame([("1", "openai/gpt-4o-mini", 1_000_000, 1_000_000), ("2", "unknown", 5, 5)], "id string, model_name string, prompt_tokens long, completion_tokens long")
    for _ in range(2):
        T.append_usage(usage, pricing, str(tmp_path / "usage"))
    got = spark.read.parquet(str(tmp_path / "usage")).groupBy("id").agg(F.count("*").alias("n"), F.max("cost_estimate_usd").alias("c")).orderBy("id").collect()
    assert [(r["n"], round(r["c"], 6)) for r in got] == [(2, 0.75), (2, 0.0)]


def test_payment_events_are_read_with_the_declared_schema(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"event_id":"1","event_type":"X","resource":"{\\"id\\":\\"C\\"}","ts":"2024-01-01T00:00:00Z","more":2}\n')
    assert T.read_payment_events(spark, str(tmp_path)).first()["resource"] == '{"id":"C"}'
    assert T.stream_payment_events(spark, str(tmp_path)).isStreaming


def memory_rows(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_windowed_streams_equal_their_batch_forms(spark, tmp_path):
    rows = spark.range(4000).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 7 % 9000).alias("ts"), (F.col("id") % 5).alias("client"),
                                    F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model_name"), (F.col("id") % 10 / 4).alias("cost_usd"))
    rows.write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    limited = memory_rows(W.over_limit(stream, 2), "limited", "complete")
    assert sorted(map(tuple, limited.collect())) == sorted(map(tuple, W.over_limit(batch, 2).collect()))
    rolled = memory_rows(W.rolling_cost(stream, 7), "rolled", "complete")
    assert sorted(map(tuple, rolled.collect())) == sorted(map(tuple, W.rolling_cost(batch, 7).collect()))


def test_invented_content_is_dropped(spark):
    base = spark.sql("""select 'u' as url, named_struct('hero', named_struct('headline', 'H', 'subheadline', '', 'cta_text', '', 'cta_href', '', 'background_image', 'bg.png'),
        'about', named_struct('heading', '', 'body', 'B', 'image', 'a.png'), 'services_features', array(named_struct('title', 'Cut', 'description', '', 'icon_image', 'c.png')),
        'faq', array(named_struct('question', 'q', 'answer', 'a')), 'cta_section', named_struct('heading', '', 'body', '', 'cta_text', '', 'cta_href', ''),
        'additional_sections', array(named_struct('key', 'k', 'title', 'T', 'body', '', 'items', array('x'), 'images', array('i.png')))) as sections""")
    offer = ('{"page_url":"u","hero":{"headline":"New","background_image":"evil"},"services":[{"title":" CUT ","description":"d"},{"title":"x"}],"faq":[],'
             '"additional":[{"key":"k","body":"b"},{"key":"fake","title":"F"}]}')
    proposals = spark.createDataFrame([(offer,)], "j string").select(F.from_json("j", R.PROPOSAL).alias("p")).select("p.*")
    s = R.merge_reviews(base, proposals).first()["sections"]
    assert (s["hero"]["headline"], s["hero"]["background_image"], s["about"]["body"], s["about"]["image"]) == ("New", "bg.png", "B", "a.png")
    assert [(i["title"], i["icon_image"]) for i in s["services_features"]] == [(" CUT ", "c.png"), ("x", None)]
    assert s["faq"] == [] and [(a["key"], a["title"], a["body"], a["images"]) for a in s["additional_sections"]] == [("k", "T", "b", ["i.png"])]


def test_tables_have_schemas():
    assert {"users", "ledger", "purchases", "usage", "queued_jobs"} <= set(schemas.APP_TABLES)


def test_landed_rows_use_all_cores(spark):
    from sitelake.streaming import run

    stream = run.landed(spark.range(10_000), 3, F.xxhash64("id"))
    seen = []
    query = stream.writeStream.foreachBatch(lambda batch, _: seen.append((batch.count(), batch.select(F.input_file_name()).distinct().count()))).trigger(availableNow=True)
    query.start().awaitTermination()
    assert len(seen) <= 3 and sum(n for n, _ in seen) == 10_000
    assert max(files for _, files in seen) > 1 or spark.sparkContext.defaultParallelism == 1


def test_current_versions(spark):
    from sitelake.operators import jobs as J

    rows = [(1, "a", "2020-01-01"), (1, "c", "2020-03-01"), (1, "b", "2020-03-01"), (2, "z", "2021-01-01"), (3, "n", None)]
    blueprints = spark.createDataFrame(rows, "project_id bigint, id string, created_at string").selectExpr("project_id", "id", "to_date(created_at) as created_at").where("project_id < 3")
    columns = ["project_id", "id", "created_at", "version", "is_current"]
    current = J.current_versions(blueprints)
    assert sorted(current.select(*columns).collect()) == sorted(J.versions(blueprints).where("is_current").select(*columns).collect())
    assert "Window" not in current._jdf.queryExecution().optimizedPlan().toString()
