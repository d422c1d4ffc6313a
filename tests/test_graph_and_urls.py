from __future__ import annotations

import random
from collections import deque
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from sitelake.functions import money, text, urls
from sitelake.operators import linkgraph as G
from sitelake.operators.skew import running_sums, time_segment


def crawl(links, start, cap):
    queued, order, todo = {start}, [start], deque([start])
    while todo:
        for target in links.get(todo.popleft(), []):
            if target not in queued:
                queued.add(target)
                order.append(target)
                todo.append(target)
    return order if len(order) <= cap else None


def run_discovery(spark, graphs, cap):
    rows = [(site, src, dst, pos) for site, links in graphs.items() for src, targets in links.items() for pos, dst in enumerate(targets)]
    edges = spark.createDataFrame(rows, "site string, src string, dst string, pos int")
    starts = spark.createDataFrame([(site, "0") for site in graphs], "site string, start string")
    found = {}
    for r in G.discover(edges, starts, cap).collect():
        found.setdefault(r["site"], []).append((r["page_no"], r["url"], r["accepted"]))
    return {s: [u for _, u, _ in sorted(v)] if all(a for *_, a in v) else None for s, v in found.items()}


def test_discovery_order_matches_a_queue(spark):
    rng = random.Random(2)
    graphs = {f"s{i}": {str(n): [str(rng.randrange(rng.randint(3, 14))) for _ in range(rng.randint(1, 4))] for n in range(14)} for i in range(12)}
    got = run_discovery(spark, graphs, 8)
    assert got == {s: crawl(links, "0", 8) for s, links in graphs.items()}
    assert None in got.values() and any(got.values())


@pytest.mark.parametrize("cap", [1, 3, 5])
def test_page_cap_boundary(spark, cap):
    def chain(n):
        return {str(i): [str(i + 1)] if i + 1 < n else ["0"] for i in range(n)}

    got = run_discovery(spark, {"at": chain(cap), "past": chain(cap + 1)}, cap)
    assert got["at"] == [str(i) for i in range(cap)] and got["past"] is None


ROBOTS = [
    (None, "", "/x", True), (404, "", "/x", True), (403, "", "/x", False), (401, "", "/x", False), (500, "User-agent: *\nDisallow: /", "/x", True),
    (200, "User-agent: *\nDisallow: /private", "/private/a", False), (200, "User-agent: *\nDisallow: /private", "/open", True),
    (200, "User-agent: SiteBot\nDisallow: /\n\nUser-agent: *\nDisallow:", "/", False), (200, "User-agent: *\nDisallow:", "/", True),
    (200, "User-agent: *\nAllow: /a/b\nDisallow: /a", "/a/b/c", True), (200, "User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", False),
    (200, "User-agent: *\n\nDisallow: /", "/x", True), (200, "# note\nUser-agent: a\nUser-agent: sitebot # me\nDisallow: /x\n", "/x", False),
]


def test_robots_verdicts(spark):
    rows = [(str(i), code, body, "SiteBot/1.0", path) for i, (code, body, path, _) in enumerate(ROBOTS)]
    df = spark.createDataFrame(rows, "site string, status int, body string, agent string, path string")
    got = {int(r["site"]): r["allowed"] for r in G.robots_verdicts(df).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(ROBOTS)}


def test_link_resolution_matches_the_standard_library(spark):
    bases = ["https://a.test/x/y/page?q=1#f", "http://a.test", "https://a.test/dir/"]
    hrefs = ["", "z", "/z", "../z", "../../../z", "./z?k=1", "//b.test/q", "?k=2", "#top", "mailto:a@b.test", "https://c.test/a/../b", "a/./b/../c", "..", "."]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string").withColumn("u", urls.resolve_url("b", "h"))
    for r in df.collect():
        assert r["u"] == urljoin(r["b"], r["h"]), (r["b"], r["h"])


def test_asset_token_leaves_absolute_references(spark):
    html = '<a href="https://x.test"><a href="/r"><a href="#t"><a href="mailto:a@b"><link href="s.css"><img src="i.png?v=1"><img src="data:x">'
    css = "a{background:url(img.png)} b{background:url('i.png?x=1')} c{background:url(https://x.test/y)} d{background:url(data:z)}"
    row = spark.range(1).select(urls.add_asset_token(F.lit(html), "t").alias("h"), urls.add_asset_token(F.lit(css), "t", css=True).alias("c")).first()
    assert row["h"] == html.replace("s.css", "s.css?preview_token=t").replace("?v=1", "?v=1&preview_token=t")
    assert row["c"] == css.replace("img.png", "img.png?preview_token=t").replace("?x=1", "?x=1&preview_token=t")


def test_money_and_labels(spark):
    df = spark.createDataFrame([("5.00",), ("0.01",), ("5",), ("5.001",), ("abc",), (None,)], "v string")
    assert [r[0] for r in df.select(money.to_cents("v")).collect()] == [500, 1, 500, None, None, None]
    src = F.explode(F.array(*[F.lit(v) for v in ("a/ab12cd34-team-photo-300x200.jpg", "x/123.png", "o'neil_pub.png")]))
    names = spark.range(1).select(src.alias("s")).select(text.fallback_alt_text("s"))
    assert [r[0] for r in names.collect()] == ["Team Photo", "Image", "O'Neil Pub"]


def test_running_sums_equal_a_plain_window_on_a_hot_key(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 11 - 5).alias("v"),
                                  F.timestamp_seconds(F.col("id") * 37 % 90000).alias("at"))
    df.createOrReplaceTempView("hot")
    plain = spark.sql("select id, sum(v) over (partition by k order by at, id) as s from hot")
    ours = running_sums(df, ["k"], ["at", "id"], {"s": F.col("v")}, time_segment("at", 3600)).select("id", "s")
    assert ours.exceptAll(plain).count() == 0 and plain.exceptAll(ours).count() == 0
