"""Personal data and filter interactions against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from sitelake.llm.anchors import BASE, Reader, personal_data, span_digests
from sitelake.llm.interactions import document_cells, interaction_audit, prefix_cells

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in found.split("."))
    if kind == "card":
        odd = [int(d) for d in digits[::-1]]
        return 14 <= len(digits) <= 19 and (sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute_base(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if passes(k, m.group())]
    return [(BASE[i], a, b) for a, i, b in sorted(found)]


TEXTS = [
    "a.b@mail2.example.com ### 227.5.221.1, and 4532015112830366$$$ or +1 (771) 555-1655.", "x@y@z.de a@b.c@d.e 1.2.3.4.5.6.7.8 1.2.300.4.5.6.7",
    "4532-0151 1283 0366 4532015112830366 4532015112830366", "000.0255.1.1 +49-30.(12) 3456789-- +1x +12 +1 2", "@ @@ + :: :// 1", "é@ü.de naïve@example.org",
    "7" * 6_000 + ".1.2.3 " + "0" * 6_000 + ".1.2.3", "(" * 500 + "+1" + " " * 5_000 + "x", "a" * 70_000 + "@b.c", "+1+2+3 5551234567 +1-555-123-4567+1-555-123-4567",
]


def test_base_spans_are_the_patterns_matches():
    rng = random.Random(3)
    alphabets = ("a.@-1", "0123456789 -", "12.  ", "+1(). -5x", "a1.@+ -é()", "4:ab.@1 /+[]\"é", "iban DE1234567890 :", "@@.a+%")
    made = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(1_500)]
    for text in TEXTS + made:
        assert [s for s in Reader(text).read() if s[0] in BASE] == brute_base(text), text


@pytest.mark.parametrize(("text", "span"), [
    ("IBAN: DE89 3704 0044 0532 0130 00 und", ("iban", "DE89 3704 0044 0532 0130 00")), ("iban no. DE89370400440532013000", ("iban", "DE89370400440532013000")),
    ("SSN: 123-45-6789.", ("ssn", "123-45-6789")), ("ssh://bob:pw@host/x", ("login", "bob:pw")), ("to jörg@müller.de, x", ("mail", "jörg@müller.de")),
    ("a.b (at) ex [dot] com", ("mail", "a.b (at) ex [dot] com")), ("from 2001:db8::ff00:42:8329 to", ("ip6", "2001:db8::ff00:42:8329")),
    ('"john doe"@ex.com', ("mail", '"john doe"@ex.com')), ("Account No. 12345678", ("account", "12345678")),
])
def test_added_spans(text, span):
    assert [(k, text[a:b]) for k, a, b in Reader(text).read() if k not in BASE] == [span]


@pytest.mark.parametrize("text", [
    "IBAN DE88 3704 0044 0532 0130 00", "ssn 666-45-6789", "http://host/a@b:c", "std::vector<int> a::b", "the account of 1999 days", "look (at) this", "x@y", "kontext 12345678",
])
def test_nothing_added(text):
    assert [s for s in Reader(text).read() if s[0] not in BASE] == []


def test_personal_data_on_rows(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, ""])] + [(1, TEXTS[1]), (1, TEXTS[1]), (None, TEXTS[0])]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id bigint, text string, spans string, start int").repartition(4)
    found = span_digests(personal_data(docs)).collect()
    digest = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    wanted = Counter()
    for i, t in rows:
        base = brute_base(t or "")
        counts = Counter(k for k, _, _ in base)
        wanted[(i, *(counts[k] for k in BASE), hashlib.sha256(digest(base).encode()).hexdigest(), digest(Reader(t or "").read()))] += 1
    assert Counter(map(tuple, found)) == wanted
    masked = {r.doc_id: r.masked_text for r in personal_data(docs, mask=True).where("doc_id in (0, 10)").collect()}
    assert masked == {0: "<email> ### <ip>, and <card>$$$ or <phone>.", 10: ""}
    assert personal_data(docs.limit(0)).count() == 0


def brute_audit(docs, labels):
    first, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if x == 1 else set()
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {c for c, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > first[t],
        )) if bad}
        parts[s or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                early = sum(f in r[0] and bool(r[0] & set(order[:step])) for r in rows)
                total[f] += len(gone)
                out[(part, "".join(order), step + 1)] = [len(left), len(gone), early, sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_interaction_audit(spark):
    rng = random.Random(5)
    long = " ".join(f"w{i}" for i in range(250))
    kinds = [long, "few words", "AB " * 300, "ab " * 220, long + " $", long.upper(), "x #", "", None, long + " end"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(kinds), rng.choice(["a", None, "", "b"])) for _ in range(300)] + [(5, long, "a")] * 3 + [(-1, long, "c")]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    given = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, source string, mask int, n int").repartition(3)
    marks = spark.createDataFrame([(*m, "x") for m in labels], "doc_id bigint, quality int, toxic int, part string")
    audit = interaction_audit(document_cells(given, marks))
    assert dict(audit.dtypes)["step"] == "int" and {t for c, t in audit.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    rows = audit.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(rows) == len(found) and found == brute_audit(docs, labels)
    assert interaction_audit(document_cells(given.limit(0), marks.limit(0))).count() == 0


def test_orders_of_other_filters(spark):
    assert prefix_cells(spark, "XYZ").where("step = 3").select("prefix").distinct().count() == 6
    cells = spark.createDataFrame([("p", 3, 10, 1, 0), ("p", 1, 5, 0, 0)], "part string, mask int, n bigint, n_good bigint, n_toxic bigint")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in interaction_audit(cells, "XY").collect()}
    assert got == {("XY", 1): (0, 15, 20), ("XY", 2): (0, 0, 10), ("YX", 1): (5, 10, 10), ("YX", 2): (0, 5, 20)}
    with pytest.raises(ValueError):
        prefix_cells(spark, "AA")
