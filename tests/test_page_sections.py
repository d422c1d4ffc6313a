from __future__ import annotations

import pytest

from sitelake.operators.blueprint import page_blueprints

# A boatyard: a menu in a header, the lead block after a side note, an unclosed paragraph, services nested one level down.
BOATYARD = """<!doctype html><html><head><title>Quay &amp; Tide Boatyard - Moorings</title></head><body><header><nav><ul><li><a href="/moorings">Moorings</a>
<li><a href="/slipway">Slipway</a></ul></nav></header><main><div><h1>Berths on the north quay</h1><p>Deep water at every tide.<a class="button" href="/berths/ask">Ask for a berth</a></div>
<div><h2>What we do</h2><div><h3>Hull repair</h3><p>Planks and seams.</p></div><div><h3>Winter storage</h3><p>Dry sheds.</p></div></div>
<div><h2>Our story</h2><p>Three families since 1931.</p></div></main><footer><p>&copy; 2021 Quay and Tide Ltd</p><div><a href="https://instagram.com/quaytide">pictures</a>
<a href="/harbour-rules">Harbour rules</a></div><p>Radio room: 020 7946 0991, desk@quaytide.test</p></footer></body></html>"""
NO_H1 = "<html><body><main><h2>Larch Lane Potters</h2><p>Wheel and kiln.</p><h2>Where the clay comes from</h2><p>A pit in the valley.</p></main></body></html>"
BUTTONS = "<html><body><main><h1>Hi</h1><a class='btn' href='javascript:void(0)'>Menu</a><a href='tel:5551234'>Call</a></main></body></html>"
# A joinery: items repeat with other case and blanks, under a wrapper; the questions stand in a numbered list.
REPEATS = """<html><body><main><header><h1>Oak room joinery</h1></header><section><h2>What we do</h2><div><h3>Stairs</h3><p>Straight and spiral.</p></div>
<div><h3> STAIRS</h3><p>straight AND spiral.</p></div><div><h3>Window frames</h3><p>Sash.</p></div></section>
<section><h2>Frequently asked questions</h2><ol><li>Do you deliver? By van on Fridays</li><li>Timber sources</li></ol></section></main></body></html>"""
PROSE = """<html><body><main><h1>X</h1><h2>Why choose us</h2><div>we have many good reasons here</div><div>too short</div>
<div><b>not</b> a leaf because of its inner element</div></main></body></html>"""
WIDGET = """<html><body><main><h1>X</h1></main>""" + 2 * """<div class="elementor-testimonial"><div class="elementor-testimonial__text">Great work</div>
<span class="elementor-testimonial__name">Ann</span></div><div class="elementor-testimonial"><div class="elementor-testimonial__text">Fast</div>
<span class="elementor-testimonial__name">Bob</span><span class="elementor-testimonial__title">CEO</span></div>""" + "</body></html>"
MEGA = """<html><body><main><h1>X</h1>{}</main><footer class="site-footer"><img src="/l.png"><h3>About</h3><p>Footer about text.</p>
<h3>Contact</h3><p>x@y.test</p></footer></body></html>"""
IMAGES = """<html><head><link rel="icon" sizes="16x16" href="/a.ico"><link rel="apple-touch-icon" sizes="180x180" href="b.png"></head><body><main><h1>X</h1>
<img src="/one.png" alt="One"><img src="two.png"><img src="/one.png" alt="Again"><img src="/gone.png"><img src="/logo.png" alt="Our Logo">
<h2>Our work</h2><img src="/one.png" alt="g"></main></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    sources = [BOATYARD, NO_H1, BUTTONS, REPEATS, PROSE, WIDGET, MEGA.format(""), MEGA.format("<h2>About us</h2><p>Main about.</p>"), IMAGES]
    rows = [(i, f"https://site{i}.test/dir/page", html) for i, html in enumerate(sources)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assets = spark.createDataFrame(
        [("site8.test", f"https://site8.test{u}", p, i) for i, (u, p) in enumerate(
            [("/one.png", "img/1.png"), ("/dir/two.png", "img/2.png"), ("/logo.png", "img/l.png"), ("/a.ico", "ic/a"), ("/dir/b.png", "ic/b")])],
        "site string, original_url string, storage_path string, seq long")
    return {r["page_id"]: r for r in page_blueprints(df, assets, gallery=True).collect()}


def test_boatyard_page(pages):
    row, s = pages[0], pages[0]["sections"]
    assert (s["hero"]["headline"], s["hero"]["cta_text"], s["hero"]["cta_href"]) == ("Berths on the north quay", "Ask for a berth", "/berths/ask")
    assert s["hero"]["subheadline"].startswith("Deep water at every tide.") and s["hero"]["background_image"] is None
    assert {i["title"]: i["description"] for i in s["services_features"]} == {"Hull repair": "Planks and seams.", "Winter storage": "Dry sheds."}
    assert s["about"]["body"] == "Three families since 1931."
    assert {n["href"] for n in row["navigation"]} == {"/moorings", "/slipway"}
    assert {n["platform"] for n in s["footer"]["social_links"]} == {"instagram"} and {n["href"] for n in s["footer"]["links"]} == {"/harbour-rules"}
    assert "2021 Quay and Tide" in s["footer"]["copyright_text"] and s["contact"]["email"] == "desk@quaytide.test"
    assert row["site_name_guess"].startswith("Quay & Tide")


def test_first_h2_is_hero_without_h1_and_unknown_heading_is_kept(pages):
    s = pages[1]["sections"]
    assert s["hero"]["headline"] == "Larch Lane Potters"
    assert [(a["key"], a["title"], a["body"]) for a in s["additional_sections"]] == [("where-the-clay-comes-from", "Where the clay comes from", "A pit in the valley.")]


def test_script_button_is_skipped_and_phone_button_kept(pages):
    assert (pages[2]["sections"]["hero"]["cta_text"], pages[2]["sections"]["hero"]["cta_href"]) == ("Call", "tel:5551234")


def test_items_differing_in_case_are_one_and_lists_hold_questions(pages):
    s = pages[3]["sections"]
    assert [i["title"] for i in s["services_features"]] == ["Stairs", "Window frames"]
    assert {i["question"]: i["answer"] for i in s["faq"]} == {"Do you deliver?": "By van on Fridays", "Timber sources": ""}


def test_prose_in_leaf_div(pages):
    assert pages[4]["sections"]["about"]["body"] == "we have many good reasons here"


def test_widget_testimonials_are_deduplicated(pages):
    assert [(i["quote"], i["author"], i["role"]) for i in pages[5]["sections"]["testimonials"]] == [("Great work", "Ann", ""), ("Fast", "Bob", "CEO")]


def test_footer_sections_fill_only_empty_ones(pages):
    assert pages[6]["sections"]["about"]["body"] == "Footer about text."
    assert pages[7]["sections"]["about"]["body"] == "Main about."
    assert pages[7]["sections"]["contact"]["email"] == "x@y.test"


def test_images_logo_favicon_gallery(pages):
    row = pages[8]
    assert [(i["path"], i["alt"]) for i in row["all_images"]] == [("img/1.png", "One"), ("img/2.png", ""), ("img/l.png", "Our Logo")]
    assert (row["logo"], row["favicon"]) == ("img/l.png", "ic/b")
    assert [(g["image"], g["caption"]) for g in row["sections"]["gallery_portfolio"]] == [("img/1.png", "g")]
    assert row["sections"]["hero"]["background_image"] == "img/1.png"


def test_repeated_single_sections_are_kept_on_request(spark):
    html = ("<html><body><main><h1>X</h1><h2>About us</h2><p>first</p><h2>Map</h2><p>m</p><h2>Our story</h2><p>second</p>"
            "<h2>Services</h2><ul><li>a</li></ul></main></body></html>")
    df = spark.createDataFrame([(1, "https://a.test/", html)], "page_id long, url string, html string")
    plain = page_blueprints(df).first()["sections"]
    kept = page_blueprints(df, keep_repeats=True).first()["sections"]
    assert [a["title"] for a in plain["additional_sections"]] == ["Map"] and plain["about"]["body"] == "first"
    assert [a["title"] for a in kept["additional_sections"]] == ["Map", "Our story"] and kept["about"]["body"] == "first"


def test_flattened_pages_are_held_piece_by_piece():
    import tracemalloc

    import pyarrow as pa

    from sitelake.functions.html import FLAT_PAGE, _flatten, flatten_html
    from pyspark.sql.pandas.types import to_arrow_type

    page = "<main>" + "<p class='x'>one <b>two</b></p>" * 50 + "<p hidden>last"
    html = pa.array([page, None, ""] * 200)
    expected = pa.array([_flatten(h) for h in html.to_pylist()], type=to_arrow_type(FLAT_PAGE))
    peaks = []
    for n in (60, 600):
        tracemalloc.start()
        found = flatten_html.func(html.slice(0, n))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found.equals(expected.slice(0, n))
    assert peaks[1] < 2 * peaks[0]  # Python objects of a few pages, however many there are


def test_blueprint_steps_leave_elements_behind(spark):
    from sitelake.operators.blueprint import page_blueprints

    pages = spark.createDataFrame([(1, "http://a.b/", "<h1>x</h1>")], "page_id bigint, url string, html string")
    node, carried, steps = page_blueprints(pages)._jdf.queryExecution().optimizedPlan(), 0, 0
    while node.children().size():  # a plan without joins
        node = node.children().head()
        if node.nodeName() == "Generate":
            steps += 1
            carried += "elements#" in node.output().mkString(" ")
    assert steps > 15 and carried <= 12
