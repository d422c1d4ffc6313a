"""Main text of web pages by wrapper induction: page trees of one host are aligned, and slots of the common tree become content.

Pages are read into trees of blocks, and a tree into its shape: the labels of its nodes, with repeated neighbours taken as one. For
each host the shapes are counted over all its pages, with the text behind every node: how much, how much of it linked, and whether it
is always the same. The wrapper of a host begins as its most frequent shape; all others are aligned with it by simple tree matching and
add what it lacks, in groups of shapes first and then in groups of what those give, until one wrapper is left. Nodes with the same text on all pages are template, as are the menus, notices, adverts and the like that labels
and link shares tell; the varying slots below the main node are content. Each page is then aligned with the wrapper of its host.
"""

from __future__ import annotations

import html as html_module
import json
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.llm.common import arrow_schema, slim
from sitelake.llm.tables import Steps

#: About so many shapes of a host, and then wrappers of such groups, are merged at a time.
MERGED = 48
#: Figures of a wrapper's node.
FIGURES = ("contents", "chars", "linked", "low", "high")
#: Pages of different content that must agree on a text before it counts as template, their least share of those with the varying block
#: around it, and the linked share from which a list or block is a menu.
SAME_PAGES, SAME_SHARE, LINKED = 5, 0.1, 0.6

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select button audio video canvas".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
BAD_TAGS = frozenset("nav footer aside form dialog menu fieldset head".split())
HEADER_TAGS = frozenset(["header"])
MAIN_TAGS = frozenset(["article", "main"])
BAD_NAMES = re.compile(
    r"(?:^|[\s_.-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|side-?bar\w*|menus?|nav\w*|breadcrumbs?|"
    r"footer\w*|shar(?:e|ing)\w*|social\w*|related\w*|recommend\w*|comments?|commentlist|respond|disqus|newsletter|subscri\w+|sign-?up|login|search\w*|pagination|pager|"
    r"tool-?bar|widgets?|toc|skip\w*|legal|copyright|navigation|contentinfo|complementary)(?=$|[\s_.-])", re.I,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_.-])(?:header|masthead|top-?bar|banner)(?=$|[\s_.-])", re.I)


#: Signs that part the labels of a shape.
PLAIN = str.maketrans("(),", "___")


class Node:
    __slots__ = ("label", "tag", "names", "items", "linked", "shape", "size", "runs")

    def __init__(self, tag: str, names: str):
        self.tag, self.names = tag, names
        self.label = (f"{tag}.{names}" if names else tag).translate(PLAIN)
        self.items: list = []
        self.linked = 0
        self.shape, self.size, self.runs = 0, 1, []


def tree_of(page: str) -> Node:
    """The block tree of a page, of any depth. Inline marks without a name are passed over; what scripts, styles and the like hold is left out."""
    root = Node("body", "")
    stack = [root]
    links = at = 0
    end_of: dict[str, re.Pattern] = {}
    open_: Counter = Counter()  # elements on the stack by tag

    def close(i: int) -> None:
        for node in stack[i:]:
            open_[node.tag] -= 1
        del stack[i:]

    def text(s: str) -> None:
        if s:
            s = html_module.unescape(s) if "&" in s else s
            stack[-1].items.append(s)
            if links:
                stack[-1].linked += len(s)

    while True:
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m.group(1):
            tag = m.group(1).lower()
            if tag == "a":
                links = max(0, links - 1)
            if tag in ("body", "html"):
                continue
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        tag = (m.group(2) or m.group(4) or "").lower()
        if not tag:
            continue
        attributes = m.group(3) or m.group(5) or ""
        if tag in RAW and not attributes.endswith("/"):
            pattern = end_of.get(tag) or end_of.setdefault(tag, re.compile(f"</{tag}\\b[^>]*>", re.I))
            end = pattern.search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style", "textarea", "title"):
                at = len(page)
            stack[-1].items.append(" ") if tag not in ("button", "svg", "math") else None
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].items.append(" ")
            continue
        if tag in ("html", "body"):
            continue
        names = " ".join(sorted({re.sub(r"\d+", "#", w) for f in NAMED.finditer(attributes) for w in (f.group(2) or f.group(3) or f.group(4) or "").lower().split()})) if "=" in attributes else ""
        if tag == "a":
            links += not attributes.endswith("/")
            continue
        if tag in INLINE and not (names and BAD_NAMES.search(names)):
            continue
        if tag not in INLINE:
            if tag in CLOSES:
                ends, scope = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1) if any(open_[t] for t in ends) else ():
                    if stack[i].tag in ends:
                        close(i)
                    elif stack[i].tag in scope:
                        break
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if attributes.endswith("/"):
            continue
        node = Node(tag, names)
        stack[-1].items.append(node)
        stack.append(node)
        open_[tag] += 1
    return root


def shape_of(root: Node) -> str:
    """Label and the shapes of children, a run of equal ones as one; sets `shape` (a number, equal for equal shapes of the page), `size`
    (nodes of the shape) and `runs` (the first child of each run) below."""
    order, stack = [], [root]
    while stack:
        order.append(stack.pop())
        stack.extend(i for i in order[-1].items if i.__class__ is Node)
    known: dict[tuple, int] = {}
    for node in reversed(order):  # children before their parents
        last = None
        for child in node.items:
            if child.__class__ is Node and child.shape != last:
                last = child.shape
                node.runs.append(child)
                node.size += child.size
        node.shape = known.setdefault((node.label, *(c.shape for c in node.runs)), len(known))
    parts: list[str] = []
    todo: list = [root]
    while todo:
        node = todo.pop()
        if node.__class__ is str:
            parts.append(node)
            continue
        parts.append(node.label)
        if node.runs:
            parts.append("(")
            todo.append(")")
            for k, child in enumerate(reversed(node.runs)):
                todo += [",", child] if k else [child]
    return "".join(parts)


def numbered(root: Node) -> Iterator[tuple[Node, int]]:
    """Nodes with the number of their place in the shape, in page order."""
    todo = [(root, 0)]
    while todo:
        node, number = todo.pop()
        yield node, number
        at, last, kids = number + 1, None, []
        for child in node.items:
            if child.__class__ is Node:
                if last is not None and child.shape != last.shape:
                    at += last.size
                last = child
                kids.append((child, at))
        todo.extend(reversed(kids))


def parse_shape(shape: str) -> dict:
    """The tree of a shape: label, kids and the number of each node in the order of the text."""
    count = 0

    def make(label: str) -> dict:
        nonlocal count
        count += 1
        return {"label": label, "kids": [], "at": count - 1}

    stack: list[dict] = []
    root = last = None
    for m in re.finditer(r"[^(),]+|[(),]", shape):
        t = m.group()
        if t == "(":
            stack.append(last)
        elif t == ")":
            last = stack.pop()
        elif t != ",":
            last = make(t)
            if stack:
                stack[-1]["kids"].append(last)
            else:
                root = last
    return root


def match(a: dict, b: dict, memo: dict) -> int:
    """Simple tree matching: nodes of the largest common ordered tree below two nodes of one label; 0 for different labels."""
    if a["label"] != b["label"]:
        return 0
    if not a["kids"] or not b["kids"]:
        return 1
    todo = [] if (id(a), id(b)) in memo else [(a, b)]
    while todo:  # pairs below a pair come first
        x, y = todo[-1]
        known = (id(x), id(y)) in memo
        below = [] if known else [
            (i, j) for i in x["kids"] if i["kids"] for j in y["kids"] if j["kids"] and i["label"] == j["label"] and (id(i), id(j)) not in memo
        ]
        if below:
            todo += below
            continue
        todo.pop()
        if not known:
            memo[id(x), id(y)] = 1 + _table(x["kids"], y["kids"], memo)[-1][-1]
    return memo[id(a), id(b)]


def _table(x: list[dict], y: list[dict], memo: dict) -> list[list[int]]:
    rows = [[0] * (len(y) + 1)]
    for a in x:
        row = [0]
        for j, b in enumerate(y):
            row.append(max(rows[-1][j + 1], row[j], rows[-1][j] + match(a, b, memo)))
        rows.append(row)
    return rows


def aligned_kids(a: dict, b: dict, memo: dict) -> list[tuple[dict | None, dict | None]]:
    """Children of two matched nodes in common order: pairs, or one of them alone."""
    x, y = a["kids"], b["kids"]
    t = _table(x, y, memo)
    i, j, out = len(x), len(y), []
    while i or j:
        m = match(x[i - 1], y[j - 1], memo) if i and j else 0
        if m and t[i][j] == t[i - 1][j - 1] + m:
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
        elif j and (not i or t[i][j] == t[i][j - 1]):
            j -= 1
            out.append((None, y[j]))
        else:
            i -= 1
            out.append((x[i], None))
    return out[::-1]


def merge(wrapper: dict, other: dict, memo: dict) -> None:
    """Add a shape with its figures to the wrapper."""
    todo = [(wrapper, other)]
    while todo:
        w, o = todo.pop()
        for k in ("contents", "chars", "linked"):
            w[k] += o[k]
        w["low"], w["high"] = min(w["low"], o["low"]), max(w["high"], o["high"])
        pairs = aligned_kids(w, o, memo)
        todo += [(mine, theirs) for mine, theirs in pairs if mine and theirs]
        w["kids"] = [mine or theirs for mine, theirs in pairs]


def is_bad(label: str, inside_main: bool) -> bool:
    tag, _, names = label.partition(".")
    if tag in BAD_TAGS or (tag in HEADER_TAGS and not inside_main):
        return True
    return bool(names) and bool(BAD_NAMES.search(names) or (not inside_main and HEADER_NAMES.search(names)))


def judge(root: dict) -> dict:
    """Mark every node of a wrapper with figures: `keep` for content.

    A text is template if it is the same on all pages with its node, and these are of several contents: copies of one page agree on
    all of it, and say nothing. What few of the pages with the nearest varying block around it have may be a passage of near copies,
    and stays.
    """

    def template(n: dict) -> bool:
        return n["same"] and n["chars"] > 0

    def menu(n: dict) -> bool:
        return n["label"].split(".")[0] not in ("p", "h1", "h2", "h3", "blockquote") and n["below"] > 0 and n["linked_below"] > LINKED * n["below"]

    def mains(n: dict) -> Iterator[dict]:
        todo = [n]
        while todo:
            n = todo.pop()
            if not n["bad"]:
                if n["label"].split(".")[0] in MAIN_TAGS:
                    yield n
                else:
                    todo.extend(reversed(n["kids"]))

    order = list(_all(root))
    for n in reversed(order):  # kids before their parents
        n["fixed"] = n["low"] == n["high"] and all(k["fixed"] for k in n["kids"])
    root["main"], root["around"] = False, 0
    for n in order:
        n["same"] = n["low"] == n["high"] and n["contents"] >= max(SAME_PAGES, SAME_SHARE * n["around"])
        n["main"] = n["main"] or n["label"].split(".")[0] in MAIN_TAGS
        n["bad"] = is_bad(n["label"], n["main"])
        for k in n["kids"]:
            k["main"], k["around"] = n["main"], n["around"] if n["fixed"] else n["contents"]
    for n in reversed(order):
        n["below"] = n["chars"] + sum(k["below"] for k in n["kids"])
        n["linked_below"] = n["linked"] + sum(k["linked_below"] for k in n["kids"])
        n["good"] = 0 if n["bad"] or menu(n) else (0 if template(n) else n["chars"]) + sum(k["good"] for k in n["kids"])
    found = [n for n in mains(root) if n["good"] > 0]
    inner = [m for n in found for k in n["kids"] for m in mains(k) if m["good"] >= 0.5 * n["good"]]  # an article within main
    chosen = inner or found
    if not chosen:
        best = root
        while best["good"] > 0:
            top = max(best["kids"], key=lambda k: k["good"], default=None)
            if not top or top["good"] < 0.75 * best["good"] or top["label"].split(".")[0] in ("p", "li", "blockquote"):
                break
            best = top
        chosen = [best]
    varies = any(n["low"] != n["high"] for c in chosen for n in _all(c))

    tops = {id(c) for c in chosen}
    root["inside"], root["ok"] = False, True
    for n in order:
        n["inside"] = n["inside"] or id(n) in tops
        n["ok"] = n["ok"] and not n["bad"] and not menu(n)
        n["keep"] = n["inside"] and n["ok"] and not (varies and template(n))
        for k in n["kids"]:
            k["inside"], k["ok"] = n["inside"], n["ok"]
    return root


def _all(n: dict) -> Iterator[dict]:
    stack = [n]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(n["kids"]))


def own_text(node: Node) -> str:
    return " ".join("".join(i if i.__class__ is str else " " for i in node.items).split())


def figures(root: Node) -> list[list[int]]:
    """For each node of the shape: characters, linked characters, hash of the texts in page order."""
    out = [[0, 0, 0] for _ in range(root.size)]
    for node, number in numbered(root):
        text = own_text(node)
        if text:
            f = out[number]
            f[0] += len(text)
            f[1] += min(node.linked, len(text))
            f[2] = xxhash.xxh3_64_intdigest(text, seed=f[2] & 0xFFFFFFFF) >> 1
    return out


def with_figures(shape: str, nodes: list[tuple]) -> dict:
    """Tree of a shape with the figures of its nodes by number."""
    root = parse_shape(shape)
    for n in _all(root):
        n.update(zip(FIGURES, nodes[n["at"]]))
    return root


def pack(root: dict, *keys: str) -> str:
    """A tree as JSON: its nodes in the order of the text, each with label, number of kids and the named values."""
    return json.dumps([[n["label"], len(n["kids"]), *(n[k] for k in keys)] for n in _all(root)], separators=(",", ":"), ensure_ascii=False)


def unpack(data: str, *keys: str) -> dict:
    top: dict = {"kids": []}
    waiting = [[top, 1]]
    for label, kids, *values in json.loads(data):
        n = {"label": label, "kids": [], **dict(zip(keys, values))}
        waiting[-1][0]["kids"].append(n)
        waiting[-1][1] -= 1
        waiting.append([n, kids])
        while waiting and not waiting[-1][1]:
            waiting.pop()
    return top["kids"][0]


def merged(trees: list[dict]) -> dict:
    """One wrapper with the figures of all, the first as its beginning; the root of every tree is the body."""
    for other in trees[1:]:
        merge(trees[0], other, {})
    return trees[0]


def aligned_numbers(shape: str, wrapper: dict) -> list[bool]:
    """Which nodes of a shape are content by alignment with a wrapper, whatever their texts.

    A node the wrapper lacks is content if its parent is and its label speaks for it.
    """
    root = parse_shape(shape)
    keep = [False] * sum(1 for _ in _all(root))
    memo: dict = {}
    todo: list = [(wrapper, root, True)] if wrapper["label"] == root["label"] else []
    while todo:
        w, n, ok = todo.pop()
        keep[n["at"]] = ok = w["keep"] if w else ok and not is_bad(n["label"], True)
        todo += [(mine, theirs, ok) for mine, theirs in aligned_kids(w, n, memo) if theirs] if w else [(None, k, ok) for k in n["kids"]]
    return keep


def own_numbers(shape: str, own: list[list[int]]) -> list[bool]:
    """Which nodes of a page's shape are content by its own tree."""
    keep = [False] * len(own)
    for n in _all(judge(with_figures(shape, [(1, c, linked, h, h) for c, linked, h in own]))):
        keep[n["at"]] = n["keep"]
    return keep


def content_hash(shape: str, own: list[list[int]]) -> int:
    """The same for pages of the same content by their own trees, whatever is around it."""
    kept = [h for keep, (_, _, h) in zip(own_numbers(shape, own), own) if keep and h]
    return xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8) for h in kept)) >> 1


def kept_numbers(shape: str, aligned: list[bool] | None, own: list[list[int]]) -> list[bool]:
    """Which nodes of a page's shape are content: a page whose aligned content has no text, or without a wrapper, is judged by its own tree."""
    if aligned and any(k and o[0] for k, o in zip(aligned, own)):
        return aligned
    return own_numbers(shape, own)


def page_text(root: Node, keep: list[bool]) -> str:
    """Texts of the content nodes in page order; blocks are parted by one blank, white space within them is one blank."""
    numbers = {id(node): number for node, number in numbered(root)}
    parts: list[str] = []

    todo: list = [root]
    while todo:
        node = todo.pop()
        if node.__class__ is str:
            parts.append(node)
            continue
        kept = keep[numbers[id(node)]]
        if node.tag not in INLINE:
            parts.append(" ")
            todo.append(" ")
        todo.extend(i for i in reversed(node.items) if kept or i.__class__ is Node)
    return " ".join("".join(parts).split())


def host_column() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_wrappers(pages: DataFrame, steps: Steps) -> DataFrame:
    """host and wrapper, from the shapes of all pages (host, html).

    Pages of one content are counted once, with the first of their shapes by hash.
    """
    ddl = "host string, shape string, at int, pages bigint, chars bigint, linked bigint, low bigint, high bigint"
    out = arrow_schema(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[list[int]]] = {}
        contents: set[tuple[str, str, int]] = set()

        def flush() -> pa.RecordBatch:
            rows = [(h, s, i, *f) for (h, s), nodes in held.items() for i, f in enumerate(nodes)]
            rows += [(h, s, -1, 0, 0, 0, c, c) for h, s, c in contents]
            held.clear()
            contents.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                root = tree_of(page or "")
                shape = shape_of(root)
                own = figures(root)
                contents.add((host, shape, content_hash(shape, own)))
                known = held.get((host, shape))
                if known is None:
                    held[host, shape] = [[1, c, linked, h, h] for c, linked, h in own]
                else:
                    for f, (c, linked, h) in zip(known, own):
                        f[0] += 1
                        f[1] += c
                        f[2] += linked
                        f[3], f[4] = min(f[3], h), max(f[4], h)
            if len(held) > 5_000 or len(contents) > 50_000:
                yield flush()
        if held:
            yield flush()

    counted = steps.write("counted", pages.select("host", "html").mapInArrow(count, ddl))
    shape_id = F.xxhash64("shape").alias("shape_id")
    owners = counted.where("at < 0").select("host", F.col("low").alias("content"), shape_id).groupBy("host", "content").agg(F.min("shape_id").alias("shape_id"))
    contents_of = owners.groupBy("host", "shape_id").agg(F.count("*").alias("contents"))
    nodes = counted.where("at >= 0").groupBy("host", "shape", "at").agg(
        F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    shapes = nodes.groupBy("host", "shape").agg(
        F.max("pages").alias("n"), F.sort_array(F.collect_list(F.struct("at", "chars", "linked", "low", "high"))).alias("nodes")  # of one shape
    )
    shapes = shapes.withColumn("shape_id", shape_id).join(contents_of, ["host", "shape_id"], "left").select("host", "n", "shape", "nodes", F.coalesce("contents", F.lit(0)).alias("contents"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [
                pack(with_figures(shape, [(contents, *(n[k] for k in FIGURES[1:])) for n in nodes_]), *FIGURES)
                for shape, nodes_, contents in zip(*(batch.column(c).to_pylist() for c in ("shape", "nodes", "contents")))
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "n", "shape")), pa.array(trees, pa.string())], names=["host", "n", "shape", "tree"])

    trees = merged_by_host(steps.write("trees-0", shapes.mapInArrow(plant, "host string, n bigint, shape string, tree string")), steps)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pack(judge(unpack(tree, *FIGURES)), "keep") for tree in batch.column("tree").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string())], names=["host", "wrapper"])

    return steps.write("wrappers", trees.mapInArrow(make, "host string, wrapper string"))


def merged_by_host(trees: DataFrame, steps: Steps) -> DataFrame:
    """One tree of each host from all its trees (host, n, shape, tree), the most frequent of a group first.

    Groups are dealt by a hash of the shape that a tree began with, so a host of many shapes is spread out, and a rerun merges alike.
    """
    ddl = "host string, n bigint, shape string, tree string"
    out = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, group in zip(batch.column("host").to_pylist(), batch.column("trees").to_pylist()):
                tree = pack(merged([unpack(t["tree"], *FIGURES) for t in group]), *FIGURES) if len(group) > 1 else group[0]["tree"]
                rows.append((host, -group[0]["order"], group[0]["shape"], tree))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    done = 0
    while True:
        counts = trees.groupBy("host").agg(F.count("*").alias("rows"))
        if (counts.agg(F.max("rows")).first()[0] or 0) <= 1:
            return trees
        group = F.pmod(F.xxhash64(F.lit(done), "shape"), F.ceil(F.col("rows") / MERGED))
        groups = trees.join(counts, "host").withColumn("group", group).groupBy("host", "group").agg(
            F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "shape", "tree"))).alias("trees")  # about MERGED
        )
        trees = steps.write(f"trees-{done + 1}", groups.select("host", "trees").mapInArrow(run, ddl))
        steps.drop(f"trees-{done}")
        done += 1


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (main text, empty if none) and n_chars (code points) of each row.

    Pages without a host in their url form a host of their own. Null and empty html give an empty text. A host's only page, and a page
    unlike all others of its host, is judged by its own tree. Repeated rows give repeated rows; null ids and urls stay null; other
    columns are left out. A wrapper is a few kilobytes; html is shuffled only where wrappers of all hosts are too large to broadcast.
    """
    steps = Steps(pages.sparkSession, "wrappers")
    rows = slim(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host_column())
    wrappers = host_wrappers(rows, steps)
    ddl = "page_id bigint, url string, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: OrderedDict[str, dict] = OrderedDict()
        aligned: dict[tuple[str, str], list[bool]] = {}  # by host and shape alone: what depends on a page's texts is not held
        for batch in batches:
            texts = []
            for host, wrapper, page in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "html"))):
                root = tree_of(page or "")
                shape, own = shape_of(root), figures(root)
                if wrapper is not None and (host, shape) not in aligned:
                    if host not in loaded:
                        if len(loaded) > 500:
                            loaded.clear()
                        loaded[host] = unpack(wrapper, "keep")
                    if len(aligned) > 5_000:
                        aligned.clear()
                    aligned[host, shape] = aligned_numbers(shape, loaded[host])
                keep = kept_numbers(shape, aligned[host, shape] if wrapper is not None else None, own)
                texts.append(page_text(root, keep))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.join(wrappers, "host", "left").select("page_id", "url", "host", "wrapper", "html").mapInArrow(run, ddl)
