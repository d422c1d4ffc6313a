from __future__ import annotations

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from sitelake.operators import audit, jobs as J
from sitelake.plans.costs_and_usage import TIERS

CSS = ".reveal{opacity:0; transform:none} .card .x{opacity:0;} .hide { visibility: hidden; } .ok.reveal2{opacity:0;} .half{opacity:0.5;}"
JS = "document.querySelectorAll('.reveal').forEach(e=>e.classList.add('is-visible'));\nq.querySelector('.hide');" + " " * 3100 + "x.classList.toggle('late');"


def brute_pairs(js, hidden):
    queries = [(m.start(), m.group(1)) for m in re.finditer(r"""querySelector(?:All)?\(\s*['"]\.([A-Za-z0-9_-]+)""", js)]
    pairs = set()
    for add in re.finditer(r"""classList\.(?:add|toggle)\(\s*['"]([A-Za-z0-9_-]+)['"]""", js):
        near = [c for at, c in queries if at < add.start() and add.start() - at <= 3000 and c in hidden]
        if near and near[-1] != add.group(1):
            pairs.add((near[-1], add.group(1)))
    return pairs


def test_reveal_gap_is_found_and_closed(spark):
    css = spark.createDataFrame([("a", "style.css", CSS), ("b", "style.css", CSS + " .is-visible.reveal{opacity:1}")], "site string, file string, body string")
    js = spark.createDataFrame([(s, f"{n}.js", part) for s in "ab" for n, part in zip("ab", JS.split("\n"))], "site string, file string, body string")
    hidden = audit.hidden_classes(css)
    names = {r["hidden"] for r in hidden.filter("site = 'a'").collect()}
    assert {"reveal", "hide"} <= names and "half" not in names
    pairs = audit.reveal_pairs(js, hidden)
    assert {(r["hidden"], r["reveal"]) for r in pairs.filter("site = 'a'").collect()} == brute_pairs(JS, names)
    gaps = audit.reveal_gaps(pairs, css).collect()
    assert [(r["site"], r["hidden"], r["reveal"]) for r in gaps] == [("a", "reveal", "is-visible")]


def test_no_enabled_tier_means_failed_and_newest_attempt_wins(spark):
    projects = spark.createDataFrame([(1,), (2,)], "id long")
    jobs = spark.createDataFrame(
        [("j1", 1, "basic", "preview", "failed", "old", "2024-01-01"), ("j2", 1, "basic", "preview", "succeeded", None, "2024-01-02"),
         ("j3", 1, "pro", "preview", "failed", "new", "2024-01-03"), ("j4", 2, "basic", "preview", "running", None, "2024-01-01")],
        "id string, project_id long, tier string, scope string, overall_status string, failure_reason string, created_at string")
    assert {r["project_id"]: r["status"] for r in J.project_status(projects, jobs, TIERS).collect()} == {1: "ready", 2: "generating"}
    assert {r["status"] for r in J.project_status(projects, jobs, ()).collect()} == {"failed"}
    assert [tuple(r) for r in J.retryable(jobs, TIERS).collect()] == [(1, "pro", "new")]


def test_every_query_is_named_once_and_most_have_a_check():
    built, checks = entry_module.queries(), entry_module.oracle_sql()
    assert set(checks) <= set(built) and len(checks) > 0.9 * len(built)


def test_entry_runs(spark):
    rows = entry_module.entry(spark)
    assert rows.columns == ["site", "pages", "links", "addresses"]
    assert rows.agg(F.sum("pages")).first()[0] > 0
