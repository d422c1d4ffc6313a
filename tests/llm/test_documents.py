"""Operators over documents against plain brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sitelake.llm import bpe, imatch, jaccard, katz, mixing, quality, suffixes, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row bigint, component string, a string"
WORDS = [f"{a}{b}" for a in "ba de ki lo mu na po ri su te".split() for b in "n r s x y".split()]


def words_of(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()


def sample():
    """Texts with copies, near copies, shared passages, repeats within, empty, null, blank, very long, and rows with strange ids."""
    rng = random.Random(7)
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, passage = make(300), make(120)
    near = []
    for _ in range(12):
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        near.append(" ".join(w))
    texts = [make(rng.randint(1, 200)) for _ in range(40)] + [base] * 5 + near + [make(30) + " " + passage + " " + make(30) for _ in range(4)]
    texts += ["", None, " \t\n", "One two", "ONE  two", "ab " * 900, make(6_000), "É" * 450 + make(3), "É" * 450 + make(4), "a\x1cb don't <|endoftext|> naïve 한국 ½ x" * 3]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[5]), (None, texts[5]), (-7, texts[9])]


ROWS = sample()


@pytest.fixture(scope="module")
def docs(spark):
    sources = [None, "b", "a", "ü", "z"]
    full = [(i, t, "xx", sources[(i or 0) % 5], len(t or ""), 0.5, 1, "c", "a") for i, t in ROWS]
    return spark.createDataFrame(full, SCHEMA).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, width, num, den):
    sets = []
    for i, t in rows:
        w = words_of(t)
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
        sets.append(s)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and rows[x][0] is not None and rows[y][0] is not None and den * both >= num * len(sets[x] | sets[y]):
                parent[find(x)] = find(y)
    least = defaultdict(lambda: 1 << 60)
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least[find(x)], i)
    return Counter((i, len(s), None if i is None else least[find(x)]) for x, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, docs, width, num):
    found = jaccard.jaccard_components(docs, width=width, num=num).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, found.collect())) == brute_components(ROWS, width, num, 100)


def test_jaccard_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION_ROWS", 4)
    monkeypatch.setattr(jaccard, "REGION_SHINGLES", 900)
    found = jaccard.jaccard_components(docs, width=4, num=85).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, found.collect())) == brute_components(ROWS, 4, 85, 100)
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_bins_never_part_links():
    rng = random.Random(3)
    words = jaccard.WordHashes()
    for n in (20, 400, 3_000):
        x = [rng.choice(WORDS) for _ in range(n)]
        y = list(x)
        for _ in range(max(1, n // 60)):
            y[rng.randrange(n)] = rng.choice(WORDS)
        s, t = (jaccard.shingles(" ".join(v), 4, words) for v in (x, y))
        if jaccard.linked([s, t], 85, 100):
            import numpy as np

            assert jaccard.may_link(len(s), len(t), *(np.frombuffer(jaccard.bins(v), np.uint8) for v in (s, t)), 85, 100)


def brute_repeats(rows, length, keep_first):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    data = [(t or "").encode() for _, t in rows]
    places = defaultdict(list)
    for k in order:
        for s in range(len(data[k]) - length + 1):
            places[data[k][s : s + length]].append((k, s))
    cover = [bytearray(len(d)) for d in data]
    for found in places.values():
        first = found[0]
        for k, s in found:
            same = rows[k] == rows[first[0]] and s == first[1]
            if (not same) if keep_first else len(found) > 1:
                cover[k][s : s + length] = b"\1" * length
    out = Counter()
    for (i, _), d, c in zip(rows, data, cover):
        kept = bytes(x for x, y in zip(d, c) if not y)
        out[i, len(d), sum(c), sum(1 for j in range(len(c)) if c[j] and not (j and c[j - 1])), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats(spark, docs, keep_first, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_RUNS", 4)  # groups in blocks
    # Rows without id have no order among themselves; the brute force keeps to those with one.
    rows = [r for r in ROWS if r[0] is not None]
    found = suffixes.remove_repeats(docs.where("doc_id is not null"), keep_first=keep_first, texts=False)
    assert Counter(map(tuple, found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == brute_repeats(rows, 400, keep_first)


def test_repeats_as_texts(spark, docs):
    found = suffixes.remove_repeats(docs, carry=["lang", "row"]).collect()
    assert len(found) == len(ROWS) and all(r.lang == "xx" and r.row == 1 for r in found)
    texts = {i: t or "" for i, t in ROWS}
    for r in found:
        data = texts[r.doc_id].encode()
        gone = [(s.start, s.end) for s in r.spans]
        kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)]))
        assert kept.decode() == r.kept_text and len(data) - len(kept) == r.n_removed
    assert suffixes.remove_repeats(empty(spark)).count() == 0


def brute_report(rows, length):
    return Counter({(i, n): c for (i, _, n, _, _), c in brute_repeats(rows, length, False).items()})


def test_repeats_too_short_to_go_are_reported(spark, docs):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    passage = words(55)  # 274 bytes
    rows = [(1, f"{words(80)} {passage} {words(80)}"), (2, f"{words(30)} {passage}"), (3, words(200)), (4, words(5)), (5, None), (6, words(120))]
    rows += [(7, f"{words(9)} {rows[5][1]}"), (8, f"{passage[:150]} {words(60)}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in suffixes.remove_repeats(df, keep_first=False, texts=False, report=200).collect()}
    assert [found[i].n_removed > 0 for i in range(1, 9)] == [i in (6, 7) for i in range(1, 9)]
    assert [found[i].n_repeated > 0 for i in range(1, 9)] == [i in (1, 2, 6, 7) for i in range(1, 9)]
    assert found[1].n_repeated >= 274 and found[7].n_repeated >= found[7].n_removed
    assert Counter((i, r.n_repeated) for i, r in found.items()) == brute_report(rows, 200)

    rows = [r for r in ROWS if r[0] is not None]
    got = suffixes.remove_repeats(docs.where("doc_id is not null"), keep_first=True, texts=False, report=200)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = got.select(*columns, "n_repeated").collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_repeats(rows, 400, True)
    assert Counter((r.doc_id, r.n_repeated) for r in got) == brute_report(rows, 200)
    with pytest.raises(ValueError):
        suffixes.remove_repeats(docs, report=401)
    assert suffixes.remove_repeats(empty(spark), report=200).count() == 0


def brute_katz(rows):
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    tokens = [(i, [*words_of(t), b" E"]) for i, t in rows]
    one, two, after = Counter(), Counter(), Counter()
    for i, w in tokens:
        if train(i):
            h = [b" B", *w[:-1]]
            one.update(w)
            two.update(zip(h, w))
            after.update(h)
    total, types = sum(one.values()), len(one)
    d1, d2 = (katz.discounts([sum(v == r for v in c.values()) for r in range(1, 7)]) for c in (one, two))
    left = sum(v * (1 - d1[v - 1]) for v in one.values() if v <= 5)

    def p(w):
        return (d1[one[w] - 1] if one[w] <= 5 else 1) * one[w] / total if w in one else left / total

    followers = defaultdict(dict)
    for (h, w), c in two.items():
        followers[h][w] = c
    weight, scale = {}, {}
    for h, ws in followers.items():
        mass = sum(c * (1 - d2[c - 1]) for c in ws.values() if c <= 5)
        scale[h] = after[h] if mass else after[h] + 1
        weight[h] = (mass or 1) / scale[h] / (1 - sum(map(p, ws)))
        whole = sum((d2[c - 1] if c <= 5 else 1) * c / scale[h] for c in ws.values()) + weight[h] * (sum(p(w) for w in one if w not in ws) + left / total)
        assert math.isclose(whole, 1, rel_tol=1e-9)
    out = []
    for i, w in tokens:
        score = 0.0
        for h, x in zip([b" B", *w], w):
            c = followers.get(h, {}).get(x, 0)
            score += math.log10((d2[c - 1] if c <= 5 else 1) * c / scale[h] if c else weight.get(h, 1) * p(x))
        base = sum(math.log10((one[x] + 1) / (total + types + 1)) for x in w)
        out.append((i, not train(i), len(w), sum(x in one for x in w), total, round(base, 6), round(score, 6)))
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_katz(spark, docs, small, monkeypatch):
    if small:  # many blocks and buckets, and frequent histories in several buckets
        monkeypatch.setattr(katz, "BLOCK_BYTES", 9_000)
        monkeypatch.setattr(katz, "BUCKET_BYTES", 4_000)
    found = katz.katz_scores(docs).collect()
    assert Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in found) == brute_katz(ROWS)


def test_katz_without_rows(spark):
    assert katz.katz_scores(empty(spark)).count() == 0
    held_out = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = katz.katz_scores(spark.createDataFrame([(held_out, "x y")], "doc_id bigint, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_mixing(spark, docs):
    rows = mixing.mix(docs, block_words=4).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs, block_words=4).collect()), key=str)
    sizes = defaultdict(int)
    for (i, t) in ROWS:
        sizes[[None, "b", "a", "ü", "z"][(i or 0) % 5]] += len(words_of(t))
    weight = {"a": 3, "b": 1, "z": 2, "ü": 3, None: 1}
    wanted, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (wanted - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(rows) == len(ROWS) and all(abs(taken[s] - target[s]) <= 4 * 4 for s in target)
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(docs.where("text is null or trim(text) = ''")).where("taken = 0").count() == docs.where("text is null or trim(text) = ''").count()


def test_schedule_is_even(spark, docs):
    targets = mixing.source_targets(mixing.sized(docs)).cache()
    slots = mixing.schedule(targets, 2).orderBy("slot").collect()
    share = {r.source_no: r.target for r in targets.collect()}
    total, seen = sum(share.values()), Counter()
    for n, s in enumerate(slots, 1):
        assert s.block == seen[s.source_no]
        seen[s.source_no] += 1
        assert all(abs(seen[k] - n * v / total) < 6 for k, v in share.items())


def test_bpe_against_the_library(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    wanted = Counter()
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        wanted[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    lexicon = bpe.build_lexicon(docs, path, least=1)
    for name in (lexicon, None):
        assert Counter(map(tuple, bpe.encode(docs, path, name, digests=True).collect())) == wanted
    model = bpe.BpeModel(path)
    rng = random.Random(1)
    for _ in range(2_000):
        text = "".join(rng.choice("abcdef'strelv ÀéΣßİ<|endoftext|>́\x1c\x85!#12\n가漢") for _ in range(rng.randint(0, 90)))
        assert model.encode(text) == library.encode(text, add_special_tokens=False).ids
    back = Counter(map(tuple, bpe.decode(bpe.encode(docs, path), path).collect()))
    assert back == Counter((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in ROWS)
    assert bpe.encode(empty(spark), path).count() == 0


def test_lexicon_is_minimal_and_whole(tmp_path):
    words = {w + e: [i, i + 1] for i, w in enumerate(WORDS) for e in ("", "ing", "ings", "ed")}
    bpe.compile_lexicon(words, str(tmp_path / "lexicon"))
    lexicon = bpe.Lexicon(str(tmp_path / "lexicon"))
    assert all(lexicon.find(w) == ids for w, ids in words.items())
    assert all(lexicon.find(w) is None for w in ("", "i", "banin", "zz", "baninge"))
    assert len(lexicon.finals) < 60  # endings are shared: hundreds of states otherwise
    bpe.compile_lexicon({}, str(tmp_path / "none"))
    assert bpe.Lexicon(str(tmp_path / "none")).find("x") is None


def test_quality(spark, docs):
    rows = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert quality.quality(docs).count() == len(ROWS) and quality.quality(empty(spark)).count() == 0
    for i, t in ROWS:
        w, lines = (t or "").encode().split(), [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        windows = Counter(zip(*(w[k:] for k in range(5))))
        covered = {k + o for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for o in range(5)}
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(covered))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.kept and r.base_failed)


def test_quality_bands_are_learnt(spark):
    import base64

    import numpy as np
    import zstandard

    rng = random.Random(4)
    prose = [" ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(150, 420))) for _ in range(160)]
    symbols = [" ".join(w + rng.choice(["###", "&&&", "***", "%%%"]) for w in t.split()) for t in prose[:6]]
    noise = base64.b85encode(hashlib.shake_256(b"y").digest(6_000)).decode()
    texts = prose + symbols + [" ".join(noise[k : k + 19] for k in range(0, 3_000, 19)), None, "", "w x y z"]
    docs = spark.createDataFrame([(i, t, 1.0, "v") for i, t in enumerate(texts)], "doc_id bigint, text string, ratio double, band string")
    found = quality.quality(docs)
    rows = {r.doc_id: r for r in found.collect()}
    packer = zstandard.ZstdCompressor(level=3)
    size = lambda t: len(t.encode())
    ratio = lambda t: size(t) / len(packer.compress(t.encode()))
    chunks = lambda t: [512 / len(packer.compress(t.encode()[i : i + 512])) for i in range(0, size(t) - 511, 512)]
    bands, every = defaultdict(list), []
    for i, t in enumerate(texts):
        if t and not rows[i].base_failed:
            bands[math.floor(2 * math.log2(size(t)))].append(math.floor(ratio(t) * 100))
            every += [math.floor(c * 100) for c in chunks(t)]

    def limits(values, up, down):
        low, middle, high = ((np.percentile(values, q) + 0.5) / 100 for q in (25, 50, 75))
        return middle - down * max(middle - low, 0.01) / 0.6745, middle + up * max(high - middle, 0.01) / 0.6745

    low, high = limits(every, 2.5, 3.75)
    for i, t in enumerate(texts):
        band = bands[math.floor(2 * math.log2(size(t)))] if t else []
        least, most = limits(band, 3.0, 4.5) if len(band) >= quality.FEWEST else quality.WIDE
        bad = sum(not low <= c <= high for c in chunks(t or ""))
        want = "base" if rows[i].base_failed else "repetitive" if ratio(t) > most else "incompressible" if ratio(t) < least else "chunks" if bad > len(chunks(t)) / 3 else "kept"
        assert (rows[i].verdict, rows[i].n_bad_chunks, rows[i].kept) == (want, bad, want == "kept")
    assert all(not rows[i].kept for i in range(160, 170)) and sum(rows[i].kept for i in range(160)) >= 155
    assert {(r.band, r.verdict): r.n for r in quality.band_report(found).collect()} == Counter((r.band, r.verdict) for r in rows.values())


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["vilebad", "vilebadly", "grotmonger"]))
        rows.append((i, " ".join(x + ("." if k % 9 == 8 else "") for k, x in enumerate(w)), "c"))
        if i % 2:
            labels.append((i, toxic))
    labels += [(5, None), (None, 1), labels[0]]
    docs = spark.createDataFrame([*rows, (None, "so vilebad. kind words", "c"), (1_000, "", "c"), (1_001, None, "c"), rows[0]], "doc_id bigint, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train_toxicity(docs, marks)
    found = toxicity.score_toxicity(docs, model).collect()
    assert len(found) == len(rows) + 4
    by = {r.doc_id: r for r in found}
    truth = {i: any(x in t for x in ("vilebad", "grotmonger")) for i, t, _ in rows}
    assert sum(by[i].predicted == truth[i] for i in truth if by[i].held_out) > 0.97 * sum(by[i].held_out for i in truth)
    assert all(0 <= r.score <= 1 for r in found) and by[1_000].score == by[1_001].score == 0
    assert [(s.start, s.end) for s in by[None].offending] == [(0, 11)] and not by[None].held_out
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    # Labels of held-out rows play no part.
    turned = spark.createDataFrame([(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels], "doc_id bigint, toxic int")
    assert toxicity.train_toxicity(docs, turned) == model
    assert toxicity.harmless(docs, model).columns == docs.columns
    nothing = toxicity.train_toxicity(docs, marks.where("false"))
    assert toxicity.score_toxicity(docs, nothing).where("score > 0").count() == 0


def brute_fingerprint(text, lexicon):
    import xxhash

    whole = (1 << 64) - 1

    def mix(h):
        h = h * 0x9E3779B97F4A7C15 & whole
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & whole
        return h ^ h >> 32

    words = {w for w in "".join(c if not c.isascii() or c.isalnum() else " " for c in text.translate({c: c + 32 for c in range(65, 91)})).split(" ") if w}
    hashes = {xxhash.xxh3_64_intdigest(w.encode()) for w in words}
    terms = sorted(hashes & lexicon or hashes)
    level = max(0, round(math.log2(max(1, len(terms)) / 2)))
    out = []
    for bits in (level, level + 1):
        subsets = [[t for t in terms if mix(t ^ xxhash.xxh3_64_intdigest(b"subset", seed=r)) % (1 << bits) == 0] for r in range(32)]
        out.append([f"{mix(sum(mix(t + i * 0x9E3779B97F4A7C15 & whole) for i, t in enumerate(s)) & whole) >> 40:06x}" if s else "-" for s in subsets])
    return level, *out


def test_fingerprints_like_brute_force(spark, docs):
    lexicon = imatch.band_lexicon(docs)
    counts = Counter(w for _, t in ROWS for w in set(imatch.terms_of(t or "")))
    assert len(lexicon) == sum(2 <= n <= 0.05 * len(ROWS) for n in counts.values())
    known = imatch._Known(lexicon)
    for _, t in ROWS:
        assert imatch.fingerprint(t or "", known) == brute_fingerprint(t or "", set(lexicon.tolist()))


def test_imatch(spark, docs):
    rows = [r for r in ROWS if r[0] is not None and r[0] != ROWS[3][0]]
    given = docs.where(f"doc_id is not null and doc_id <> {ROWS[3][0]}")
    lexicon = imatch.band_lexicon(given)
    found = {r.doc_id: r for r in imatch.edited_fingerprints(given, lexicon).collect()}
    order = sorted(rows)
    for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + u[:cut]
        r = found[i]
        assert (r.n_chars, r.next_id, r.edited_sha256) == (len(t), j, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.fingerprint != found[j].fingerprint or r.near_next == 1
    prints = defaultdict(set)
    for r in imatch.fingerprints(docs, lexicon).collect():
        prints[dict(ROWS)[r.doc_id]].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in found.values() if r.n_chars > 600 and r.n_chars < 5_000]
    assert sum(r.near_edited for r in long) > 2 * sum(r.near_next for r in long if r.near_next < 0.4)
    assert imatch.edited_fingerprints(docs, lexicon).count() == len(ROWS)
    one = imatch.edited_fingerprints(docs.limit(1), lexicon).first()
    assert one.near_next == 1 and imatch.edited_fingerprints(empty(spark), lexicon).count() == 0


def brute_katz_orders(rows, order):
    """Scores by (id, text) from a plain recursion over orders; histories begin with the mark before a text."""
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    counts = [Counter() for _ in range(order + 1)]
    after = [defaultdict(dict) for _ in range(order + 1)]
    texts = [(i, t, [b" B", *words_of(t), b" E"]) for i, t in rows]
    for i, _, w in texts:
        if train(i):
            for k in range(1, order + 1):
                counts[k].update(tuple(w[j - k + 1 : j + 1]) for j in range(max(1, k - 1), len(w)))
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            after[k][g[:-1]][g[-1]] = c
    d = [None] + [katz.discounts([sum(v == r for v in counts[k].values()) for r in range(1, 7)]) for k in range(1, order + 1)]
    off = lambda k, c: d[k][c - 1] * c if c <= 5 else c
    total = sum(counts[1].values())
    left = sum(c - off(1, c) for c in counts[1].values())
    weights = {}

    def p(h, w):
        if not h:
            return off(1, counts[1][w,]) / total if (w,) in counts[1] else left / total
        k = len(h) + 1
        seen = after[k].get(h)
        if not seen:
            return p(h[1:], w)
        if h not in weights:
            mass = sum(c - off(k, c) for c in seen.values())
            scale = sum(seen.values()) + (not mass)
            weights[h] = scale, (mass or 1) / scale / (1 - sum(p(h[1:], v) for v in seen))
        scale, weight = weights[h]
        return off(k, seen[w]) / scale if w in seen else weight * p(h[1:], w)

    words = [g[0] for g in counts[1]]
    for h in list(after[order])[:20]:
        assert math.isclose(sum(p(h, w) for w in words) + p(h, b"not a word"), 1, rel_tol=1e-9)
    return Counter((i, round(sum(math.log10(p(tuple(w[max(0, j - order + 1) : j]), w[j])) for j in range(1, len(w))), 6)) for i, _, w in texts)


@pytest.mark.parametrize("order", [1, 3])
def test_katz_orders(spark, docs, order, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(katz, "BUCKET_BYTES", 20_000)  # frequent histories go to several buckets
    found = katz.katz_scores(docs, order=order).collect()
    assert Counter((r[0], round(r[6], 6)) for r in found) == brute_katz_orders(ROWS, order)


def test_katz_query_keeps_its_tables(spark, docs, tmp_path, monkeypatch):
    """The query scores from a stored table of pairs."""
    kept = []
    write = katz.Steps.write
    monkeypatch.setattr(katz.Steps, "write", lambda self, name, df: kept.append((name, write(self, name, df))) or kept[-1][1])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    from sitelake.llm import queries

    rows = queries.QUERIES["op3_katz_backoff"](spark, str(tmp_path))
    tables = {name: table for name, table in kept if name.startswith("grams")}
    assert sorted(tables) == ["grams2"] and all(t.where("h is null").count() > 0 for t in tables.values())
    assert Counter((r[0], round(r[6], 6)) for r in rows.collect()) == brute_katz_orders(ROWS, 2)
