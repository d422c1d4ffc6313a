"""Archives and main text of pages, with nulls, empty pages, repeated rows and markup of several kinds."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
from collections import Counter

from sitelake.llm import warc, wrappers

SCHEMA = "page_id bigint, url string, html string, record_id string, host string"
PAGES = [
    (5, "http://a.example/x y", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://c.example/", None), (4, "http://c.example/2", ""),
    (7, "http://d.example/", "é\r\n\r\nWARC/1.0\r\n\r\nhttp://x 0 0 text/html 5\n" * 3), (None, "http://e.example/", "<p>one</p>"), (8, "http://f.example/", "\x00\x01 long " * 60_000), (2, "http://b.example/", "<p>one</p>"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "h") for r in rows], SCHEMA)


def brute(rows):
    first = {}
    for i, _, h in rows:
        key = (i is None, i or 0)
        first[h or ""] = min(first.get(h or "", key), key)
    out, done = Counter(), set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[i, len(data), digest, "revisit" if digest in done else "response", first[h or ""][1] if digest in done else None] += 1
        done.add(digest)
    return out


def test_round_trip_of_both_versions(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    for version in (1, 2):
        found = warc.archive_round_trip(frame(spark, PAGES).coalesce(1), version=version).collect()
        assert Counter(tuple(r)[:5] for r in found) == brute(PAGES)
        assert all(r.valid and r.date == "2025-01-01T00:00:00Z" for r in found)
    assert warc.archive_round_trip(frame(spark, PAGES[:0])).count() == 0


def test_foreign_archive(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\nContent-Type: text/plain\n\nhello\n"
    about = b"2 0 someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    records = [
        b"filedesc://x.arc 1.2.3.4 19990102030405 text/plain 200 - - 0 x.arc %d\n" % len(about) + about,
        b"http://old.example/a b 1.2.3.4 199901020304 text/plain 200 - - 10 x.arc %d\n" % len(http) + http,
        b"dns:old.example 1.2.3.4 19990102030406 text/dns 200 - - 99 x.arc 4\nabcd",
        b"http://cut.example/ 1.2.3.4 19990102030407 text/plain 200 - - 99 x.arc 400\nHTTP/1.0 200 OK\n\ncut",
    ]
    (tmp_path / "x.arc.gz").write_bytes(b"".join(gzip.compress(r + b"\n") for r in records))
    rows = {r.target: r for r in warc.convert_arc(spark, str(tmp_path)).collect()}
    assert [rows[k].warc_type for k in ("filedesc://x.arc", "http://old.example/a b", "dns:old.example")] == ["warcinfo", "response", "resource"]
    page = rows["http://old.example/a b"]
    assert bytes(page.payload) == b"hello\n" and page.date == "1999-01-02T03:04:00Z" and page.record_id.startswith("urn:uuid:") and not page.truncated
    assert rows["http://cut.example/"].truncated and bytes(rows["http://cut.example/"].payload) == b"cut\n"[:3] + b"\n"
    again = {r.target: r.record_id for r in warc.convert_arc(spark, str(tmp_path)).collect()}
    assert again == {k: r.record_id for k, r in rows.items()}


def site_page(k: int) -> str:
    return (
        f"<!doctype html><html><head><title>T{k}</title><style>p{{}}</style></head><body><header class='site-header'><a href='/'>Shop</a></header>"
        f"<div id='cookie-notice'>We use cookies {k}</div><ul class=menu><li><a href=/a>A{k}</a></li><li><a href=/b>B</a></ul>"
        f"<div class='layout'><div class='text'><h1>Title  {k} &amp; more</h1><p>First <b>bold</b>er\n text {k}<p>Second&nbsp;{k} <!-- no --> é<br>line"
        + "".join(f"<p>More {k} {j}</p>" for j in range(k % 3))
        + f"<div class='share'>Share {k}</div><div class='note-row'>Call us any time</div></div><div class='sidebar'>Side {k}</div></div>"
        f"<section id='comments'><p>Reader {k} says no</p></section><form><p>Your name</p></form><footer>&copy; {k}</footer><script>var a='<p>x</p>';</script></body></html>"
    )


def test_main_text_by_wrapper(spark):
    rows = [(k, f"https://one.example/{k}", site_page(k)) for k in range(12)]
    rows += [(100, "https://two.example/", "<body><nav>menu</nav><article><h1>Only</h1><p>a &lt; b</p></article><aside>x</aside>"), (101, None, None), (102, "x", ""), (103, "https://one.example/z", "plain words"), rows[0]]
    found = wrappers.extract_main_text(frame(spark, rows)).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by = {r.page_id: r.text for r in found}
    for k in range(12):
        more = "".join(f" More {k} {j}" for j in range(k % 3))
        assert by[k] == f"Title {k} & more First bolder text {k} Second {k} é line{more}"
    assert by[100] == "Only a < b" and by[101] == by[102] == "" and by[103] == "plain words"
    assert wrappers.extract_main_text(frame(spark, [])).count() == 0


def test_simple_tree_matching():
    a, b = (wrappers.parse_shape(s) for s in ("body(div(p,ul(li)),p)", "body(h1,div(ul(li)),table,p)"))
    assert wrappers.match(a, b, {}) == 5
    root = wrappers.tree_of("<div><p>a<p>b<ul><li>x<li>y</ul></div><p>c")
    assert wrappers.shape_of(root) == "body(div(p,ul(li)),p)" and root.size == 6


def test_pages_do_not_share_the_verdict_of_one(spark):
    page = "<div class=article><p>{}</p></div><div class=note><p>Same note</p></div>"
    rows = [(k, f"https://one.example/{k}", page.format(f"Text {k} of its own")) for k in range(8)]
    empty = (100, "https://one.example/e", page.format(""))
    for order in ([empty, *rows], [*rows, empty]):
        found = wrappers.extract_main_text(frame(spark, order).coalesce(1)).collect()
        assert {r.page_id: r.text for r in found} == {100: "Same note"} | {k: f"Text {k} of its own" for k in range(8)}


def test_wrapper_of_all_shapes_of_a_host(spark, monkeypatch):
    make = {"p": "<p>{}</p>", "h2": "<h2>{}</h2>", "ul": "<ul><li>{}</li></ul>", "table": "<table><tr><td>{}</td></tr></table>"}
    orders = [o for o in itertools.product(make, repeat=4) if all(a != b for a, b in zip(o, o[1:]))]
    rows, wanted = [], {}
    for k, order in enumerate(orders[:90]):
        often = k < 50
        for j in range(2 if often else 1):
            i = 2 * k + j
            words = [f"w{i}x{n}" for n in range(4)]
            lead = "Lead" if often else f"Lead {i}"
            rule = "" if often else "<div class=rule>Rules of the house</div>"
            body = "".join(make[t].format(w) for t, w in zip(order, words))
            rows.append((i, f"https://one.example/{i}", f"<article><div class=lead>{lead}</div>{body}{rule}</article>"))
            wanted[i] = " ".join([lead, *words])
    for size in (48, 7):
        monkeypatch.setattr(wrappers, "MERGED", size, raising=False)
        found = wrappers.extract_main_text(frame(spark, rows)).collect()
        assert {r.page_id: r.text for r in found} == wanted


def test_copies_of_a_page_are_not_template(spark):
    page = "<nav>Menu {0}</nav>{2}<article><h1>Title {1}</h1><p>Text {1}</p>{3}<div class=rule>Rules of the house</div></article>"
    rows = [(k, f"https://one.example/{k}", page.format(k, k, "", "")) for k in range(70)]
    lists = {"x": "<ul><li>Item of all copies</li></ul>", "y": "<table><tr><td>Cell of near copies</td></tr></table>"}
    rows += [(100 + k, f"https://one.example/x{k}", page.format(k, "x", f"<aside>{k}</aside>" * (k % 2), lists["x"])) for k in range(30)]
    rows += [(200 + k, f"https://one.example/y{k}", page.format(k, f"y{k}", "", lists["y"])) for k in range(6)]
    by = {r.page_id: r.text for r in wrappers.extract_main_text(frame(spark, rows)).collect()}
    assert all(by[k] == f"Title {k} Text {k}" for k in range(70))
    assert all(by[100 + k] == "Title x Text x Item of all copies" for k in range(30))
    assert all(by[200 + k] == f"Title y{k} Text y{k} Cell of near copies" for k in range(6))


def test_blocks_of_any_depth(spark):
    deep = lambda n, text: "<div>" * n + text + "</div>" * n
    page = "<body><div class=page><article><p>First {0}</p>{1}<p>Last {0}</p></article></div><footer>Foot {0}</footer></body>"
    rows = [(k, f"https://one.example/{k}", page.format(k, deep(n, f"<nav>Menu {k}</nav><p>Inner {k}</p>"))) for k, n in enumerate([1, 46, 60, 60, 60, 60, 60, 3_000, 3_000])]
    found = wrappers.extract_main_text(frame(spark, rows)).collect()
    assert {r.page_id: r.text for r in found} == {k: f"First {k} Inner {k} Last {k}" for k in range(len(rows))}
