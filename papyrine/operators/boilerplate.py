"""Learning what the pages of a site share, as a relational plan.

Each page gives its candidate blocks once (distinct by content), among them the
paragraphs, items and headings outside ``main`` and ``article``; blocks are counted
over distinct pages per site. A block is boilerplate if it is on at least
max(2, ceil(ratio * pages of the site)) pages, or on 2 where a pattern (a Python regular
expression, without case) matches its text. Its selector (tag with sorted classes, or
id) is learned when every block of the site that it selects is boilerplate; else the
block's HTML is. Blocks that lie in a learned block wherever they are are left out, as
they go with it.

Pages are parsed once. What travels is a hash of each block, made bottom-up from the
hashes of what it holds, so nested blocks cost no more than flat ones; HTML is written
only for learned blocks, from one page of each. Counting is a partial aggregation, so a
site with a third of all pages is combined on the map side first.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.operators import dom
from papyrine.operators.extract import SKIPPED, collapse
from papyrine.plans.session import cut_lineage

RATIO = 0.5
_SPACE = re.compile(r"[^\S\xa0]+")  # a non-breaking space is a sign of its own in HTML
LEAST_PAGES = 2
#: Pages from which the HTML of learned blocks is taken are broadcast up to this many (keys and a few hashes each), joined by shuffle beyond.
BROADCAST_PAGES = 100_000
#: Inside these, repeated paragraphs, items and headings are content.
_ROOTS = frozenset(("main", "article"))
_SMALL = frozenset("p li dd dt".split()) | frozenset(dom.HEADINGS)
_CANDIDATES = dom.ENDS_PARAGRAPH - _SMALL - frozenset(("hr",)) - _ROOTS


def selector_of(n: dom.Node) -> str:
    """Tag with id, or with its sorted classes; the bare tag if it has neither."""
    word = re.compile(r"[A-Za-z_][\w-]*")
    if word.fullmatch(n.attrs.get("id", "")):
        return f"{n.tag}#{n.attrs['id']}"
    return n.tag + "".join(f".{c}" for c in sorted(set(n.classes())) if word.fullmatch(c))


def _hash(head: str, inner: bytes = b"") -> bytes:
    raw = head.encode("utf-8", "surrogatepass")
    return xxhash.xxh3_64_digest(b"%d %b%b" % (len(raw), raw, inner))


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


def hashes_of(root: dom.Node) -> tuple[dict[int, bytes], set[int]]:
    """The hash of each node's content, white space collapsed, and the nodes with text."""
    made: dict[int, bytes] = {}
    full: set[int] = set()
    for n in reversed(list(root.walk())):
        if n.tag == "#text":
            made[id(n)] = _hash("# " + _SPACE.sub(" ", n.text))
            if n.text.strip():
                full.add(id(n.parent))
            continue
        if id(n) in full:
            full.add(id(n.parent))
        head = "#comment " + _SPACE.sub(" ", n.text) if n.tag == "#comment" else n.tag + "".join(f' {k}="{_SPACE.sub(" ", v)}"' for k, v in n.attrs.items())
        made[id(n)] = _hash(head, b"".join([made[id(c)] for c in n.children]))
    return made, full


def _spans(root: dom.Node, named: re.Pattern | None) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Where the pattern matches in the text of the page, and the span of that text each node has."""
    if named is None:
        return [], {}
    text, size, blank = [], 0, True
    spans: dict[int, tuple[int, int]] = {}
    stack: list[tuple[dom.Node, int]] = [(root, -1)]
    while stack:
        n, start = stack.pop()
        if start >= 0:
            spans[id(n)] = (start, size)
        elif n.tag == "#text":
            part = _SPACE.sub(" ", n.text)
            part = part[1:] if blank and part[:1] == " " else part
            if part:
                text.append(part)
                size, blank = size + len(part), part[-1] == " "
        else:
            stack.append((n, size))
            stack.extend((c, -1) for c in reversed(n.children))
    whole = "".join(text)
    return [x for m in named.finditer(whole) for x in m.span()], spans


def _holds(matches: list[int], span: tuple[int, int] | None) -> bool:
    """Whether a whole match lies in the span; starts and ends of matches alternate and rise."""
    if not matches or span is None:
        return False
    k = bisect_left(matches, span[0])
    k += k % 2
    return k < len(matches) and matches[k + 1] <= span[1]


def blocks_of(html: str, named: re.Pattern | None = None) -> list[dict]:
    """Distinct candidate blocks of a page and their places: hash, selector, whether the pattern matches its text, the
    candidate around it and the nearest one around it that the pattern matches (0 where there is none).

    What is in a block is on every page that has the block. So a block lies in a learned
    one exactly if one of these two is learned, and no other ancestor need be known.
    A selector that also selects paragraphs or items inside the article has a row that is ``kept``, so that it is not learned.
    """
    root = dom.parse(html, fragment=False)
    made, full = hashes_of(root)
    matches, spans = _spans(root, named)
    out: dict[tuple[int, int, int], dict] = {}
    stack: list[tuple[dom.Node, int, int, bool]] = [(c, 0, 0, False) for c in reversed(root.children)]
    while stack:
        n, parent, within, inside = stack.pop()
        if n.tag[0] == "#" or n.tag in SKIPPED:
            continue
        inside = inside or n.tag in _ROOTS
        if (n.tag in _CANDIDATES or n.tag in _SMALL and not inside) and id(n) in full:
            key, hit = _number(made[id(n)]), _holds(matches, spans.get(id(n)))
            out.setdefault((key, parent, within), {"block": key, "selector": selector_of(n), "kept": False, "named": hit, "parent": parent, "within": within})
            parent, within = key, key if hit else within
        elif n.tag in _SMALL and inside and re.search("[.#]", selector := selector_of(n)):
            key = _number(_hash("kept " + selector))
            out.setdefault((key, 0, 0), {"block": key, "selector": selector, "kept": True, "named": False, "parent": 0, "within": 0})
        stack.extend((c, parent, within, inside) for c in reversed(n.children))
    return list(out.values())


def sources_of(html: str, wanted: set[int]) -> list[tuple[int, str]]:
    """Hash and HTML, white space collapsed, of the wanted blocks of a page."""
    root = dom.parse(html, fragment=False)
    made, _ = hashes_of(root)
    found = {_number(made[id(n)]): n for n in root.elements() if _number(made[id(n)]) in wanted}
    return [(k, collapse(dom.serialize(n, own=True))) for k, n in found.items()]


def page_blocks(pages: DataFrame, site: str = "site_id", page: str = "page_id", html: str = "html", patterns: tuple[str, ...] = ()) -> DataFrame:
    """``site, page, block, selector, kept, named, parent, within`` of every page with HTML: hashes and selectors only."""
    kinds = {k: pages.schema[k].dataType.simpleString() for k in (site, page)}
    struct = pa.struct([("block", pa.int64()), ("selector", pa.string()), ("kept", pa.bool_()), ("named", pa.bool_()), ("parent", pa.int64()), ("within", pa.int64())])
    named = re.compile("|".join(f"(?:{p})" for p in patterns), re.I) if patterns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [blocks_of(x, named) for x in b.column(2).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([x for f in found for x in f], struct)], names=["site", "page", "x"])

    own = pages.filter(F.col(html).isNotNull()).select(site, page, html)
    made = own.mapInArrow(run, f"site {kinds[site]}, page {kinds[page]}, x struct<block bigint, selector string, kept boolean, named boolean, parent bigint, within bigint>")
    return made.select("site", "page", "x.*")


def _sources(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``site, block, html`` of the blocks named in ``site, page, blocks``."""
    kind = pages.schema["site"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sources_of(x, set(w)) for x, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            keys, texts = ([x[k] for f in found for x in f] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["site", "block", "html"])

    wanted = cut_lineage(wanted)
    few = wanted.limit(BROADCAST_PAGES + 1).count() <= BROADCAST_PAGES
    return pages.join(F.broadcast(wanted) if few else wanted, ["site", "page"]).select("site", "html", "blocks").mapInArrow(run, f"site {kind}, block bigint, html string").dropDuplicates(["site", "block"])


def learn(blocks: DataFrame, own: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``site, css_selectors_to_remove, html_to_remove`` from the blocks of ``page_blocks``, stored or collected from a stream, and the pages ``site, page, html`` they are of."""
    sizes = own.groupBy("site").agg(F.count_distinct("page").alias("pages"))
    seen = blocks.groupBy("site", "block").agg(F.count_distinct("page").alias("on"), F.min("page").alias("page"), F.first("selector").alias("selector"), F.max("kept").alias("kept"), F.max("named").alias("named"))
    needed = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("pages") * ratio))
    shared = ~F.col("kept") & ((F.col("on") >= needed) | (F.col("named") & (F.col("on") >= LEAST_PAGES)))
    marked = seen.join(sizes, "site").select("site", "block", "page", "selector", shared.alias("shared"))
    # blocks on one page only matter for their selectors: one row for each
    whole = marked.groupBy("site", "selector").agg(F.min("shared").alias("all_shared"), F.max("shared").alias("any"), F.collect_list(F.when(F.col("shared"), F.struct("block", "page"))).alias("blocks")).filter("any")
    shared = cut_lineage(whole.select("site", "selector", "all_shared", F.explode("blocks").alias("x")).select("site", "selector", "all_shared", "x.*"))
    # a block that is inside another shared one wherever it is goes with it
    key, place = ["site", "block"], ["site", "block", "parent", "within"]
    places = blocks.select(place).join(shared.select(key), key, "left_semi").distinct()
    inner = places.withColumn("over", F.explode(F.array("parent", "within"))).join(shared.select("site", F.col("block").alias("over")), ["site", "over"], "left_semi").select(place).distinct()
    outer = cut_lineage(shared.join(places.join(inner, place, "left_anti"), key, "left_semi"))
    usable = F.col("all_shared") & F.col("selector").rlike(r"[.#]")
    wanted = outer.filter(~usable).groupBy("site", "page").agg(F.collect_set("block").alias("blocks"))
    named = outer.filter(usable).select("site", "selector", F.lit(None).cast("string").alias("html"))
    listed = _sources(own, wanted).select("site", F.lit(None).cast("string").alias("selector"), "html")
    lists = named.unionByName(listed).groupBy("site").agg(F.array_sort(F.collect_set("selector")).alias("css_selectors_to_remove"), F.array_sort(F.collect_set("html")).alias("html_to_remove"))
    none = F.array().cast("array<string>")
    out = sizes.join(lists, "site", "left")
    return out.select("site", F.coalesce("css_selectors_to_remove", none).alias("css_selectors_to_remove"), F.coalesce("html_to_remove", none).alias("html_to_remove"))


def extract_dom_removals(pages: DataFrame, patterns: tuple[str, ...] = (), ratio: float = RATIO, site: str = "site_id", page: str = "page_id", html: str = "html") -> DataFrame:
    """``site, css_selectors_to_remove, html_to_remove`` of every site with HTML, both sorted; empty arrays where nothing is shared. Pages without site or key are left out."""
    own = pages.filter(F.col(html).isNotNull() & F.col(site).isNotNull() & F.col(page).isNotNull()).select(F.col(site).alias("site"), F.col(page).alias("page"), F.col(html).alias("html"))
    blocks = cut_lineage(page_blocks(own, "site", "page", "html", patterns))  # pages are parsed once
    return learn(blocks, own, ratio).withColumnRenamed("site", site)
