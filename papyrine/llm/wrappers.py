"""Wrapper induction: the template of a host's pages and the slots its content is in.

A text is a candidate of the template if enough pages of the host (``SHARED`` of them,
two at least) have it at the same path of tags; all pages are counted. A page's
candidates with their ancestors are its frame. The frames of a host grow into one tree:
each is aligned with the tree so far by simple tree matching (the largest order-keeping
match of equal nodes, children against children) and adds the nodes that match none, so
optional furniture and other layouts have their place beside the rest. Every node has
the number of pages that came to it; those with enough are the template. A last
alignment gives each page its slots: the texts of its nodes that match no template node.

Equal frames are one row with a count. They grow in ``BUCKETS`` parts by hash and the
parts then into one, so a host with a third of all pages is no single task, and the
order is the same wherever rows lie. Results: pages without HTML have no row; a host of
one page has no template, all its text is in slots; a page stored twice counts once.
"""

from __future__ import annotations

import json
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.hosts import host_of
from papyrine.operators import dom
from papyrine.operators.extract import SKIPPED, collapse
from papyrine.plans.session import cut_lineage

#: Share of a host's pages that makes a text part of the template, and the least number of them.
SHARED, LEAST_PAGES = 0.02, 2
#: Parts in which the frames of a host grow.
BUCKETS = 64
#: What all hosts share, and all templates, are broadcast up to this size.
BROADCAST_BYTES = 32_000_000
_SIGNS = re.compile("[^0-9a-z]+")
#: Nodes and texts of templates that a worker keeps loaded.
KEPT_NODES = 500_000
#: Cells of a table that are kept at once; of a larger one only some rows are, and the others made again, which changes no result.
WIDEST = 250_000
#: Weights of subtree pairs remembered; the memory is emptied when full, which changes no result.
REMEMBERED = 200_000


def key_of(text: str) -> str:
    """The text by which nodes are compared: case, accents and spacing make no difference."""
    if text.isascii():
        return _SIGNS.sub("", text.lower()) or text
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKD", text).casefold())) or text


class Tree:
    """Elements with text, in document order, with their own text and children."""

    def __init__(self, html: str):
        self.tags: list[str] = []
        self.texts: list[str] = []
        self.keys: list[str] = []
        self.children: list[list[int]] = []
        root = dom.parse(html, fragment=False)
        stack: list[tuple[dom.Node, int]] = [(c, -1) for c in reversed(root.children)]
        self.roots: list[int] = []
        while stack:
            n, up = stack.pop()
            if n.tag[0] == "#" or n.tag in SKIPPED:
                continue
            me = len(self.tags)
            self.tags.append(n.tag)
            parts = [c.text for c in n.children if c.tag == "#text"]
            text = collapse(" ".join(parts)) if parts else ""
            self.texts.append(text)
            self.keys.append(key_of(text) if text else "")
            self.children.append([])
            (self.children[up] if up >= 0 else self.roots).append(me)
            if n.children:
                stack.extend([(c, me) for c in reversed(n.children) if c.tag != "#text"])


class Matcher:
    """Simple tree matching of one tree with others; weights of pairs of subtrees are remembered from one to the next."""

    def __init__(self, a: Tree | Frame):
        self.ids: dict[tuple, int] = {}
        self.codes: dict[str, int] = {"": 0}
        self.whole: list[float] = []  # weight of a subtree and its equal, which no other pair exceeds
        self.known: dict[tuple[int, int], float] = {}
        self.a = a
        self.read_a = self.read(a)

    def read(self, t: Tree | Frame) -> tuple[list[int], list[int], list[int], int]:
        """Kinds of subtrees, codes of tags and of texts (0 for none), and the depth."""
        ids, whole, codes = self.ids, self.whole, self.codes
        kinds = [0] * len(t.tags)
        depth = [1] * len(t.tags)
        for i in range(len(t.tags) - 1, -1, -1):
            children = t.children[i]
            own = tuple([kinds[c] for c in children])
            kind = kinds[i] = ids.setdefault((t.tags[i], t.keys[i], own), len(ids))
            if kind == len(whole):
                whole.append(1 + (0.5 if t.keys[i] else 0) + sum([whole[k] for k in own]))
            if children:
                depth[i] += max([depth[c] for c in children])
        return kinds, [codes.setdefault(x, len(codes)) for x in t.tags], [codes.setdefault(x, len(codes)) for x in t.keys], max(depth, default=0)

    def match(self, b: Tree | Frame) -> dict[int, int]:
        """Nodes of the tree and the nodes of ``b`` they match: exact for lists of any width."""
        a, whole, known, none = self.a, self.whole, self.known, 0
        ka, ta, sa, deep = self.read_a
        kb, tb, sb, _ = self.read(b)
        arrays: list = []

        def trim(xs: list[int], ys: list[int]) -> tuple[int, int]:
            """Lengths of the equal start and of the equal end: matching them is best."""
            n, k, e = min(len(xs), len(ys)), 0, 0
            while k < n and ka[xs[k]] == kb[ys[k]]:
                k += 1
            while e < n - k and ka[xs[-1 - e]] == kb[ys[-1 - e]]:
                e += 1
            return k, e

        def pair(x: int, y: int) -> float:
            if ta[x] != tb[y]:
                return 0
            if ka[x] == kb[y]:
                return whole[ka[x]]
            weight = 1.5 if sa[x] == sb[y] != none else 1
            if not a.children[x] or not b.children[y]:
                return weight
            if (found := known.get((ka[x], kb[y]))) is None:
                xs, ys = a.children[x], b.children[y]
                k, e = trim(xs, ys)
                found = weight + sum([whole[ka[x]] for x in (*xs[:k], *xs[len(xs) - e :])])
                row, ys = [0] * (len(ys) - k - e + 1), ys[k : len(ys) - e]
                if ys:
                    for z in xs[k : len(xs) - e]:
                        row = after(row, z, ys)
                    found += float(row[-1])
                if len(known) >= REMEMBERED:
                    known.clear()
                known[ka[x], kb[y]] = found
            return found

        def after(row, x: int, ys: list[int]):
            """The next row of the table: best weights of the list up to ``x`` with each start of ``ys``."""
            if len(ys) < 64:
                out = [0]
                for j, y in enumerate(ys):
                    out.append(max(row[j + 1], out[j], row[j] + pair(x, y)))
                return out
            if not arrays:
                arrays[:] = np.array(tb, int), np.array([-1 if s == none else s for s in sb], int), np.array([bool(c) for c in b.children], bool)
            tags, keys, inner = arrays
            at = np.array(ys)
            same = tags[at] == ta[x]
            w = np.where(same, np.where(keys[at] == sa[x], 1.5, 1.0), 0.0)
            if a.children[x]:
                for j in np.flatnonzero(same & inner[at]):
                    w[j] = pair(x, ys[j])
            row = np.asarray(row, float)
            return np.concatenate([[0.0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))])

        out: dict[int, int] = {}
        stack = [(a.roots, b.roots)]
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, limit + 3 * deep))
        try:
            while stack:
                xs, ys = stack.pop()
                if not xs or not ys:
                    continue
                k, e = trim(xs, ys)
                pairs = [*zip(xs[:k], ys[:k]), *zip(xs[len(xs) - e :], ys[len(ys) - e :])]
                xs, ys = xs[k : len(xs) - e], ys[k : len(ys) - e]
                # every row of the table, or of a large one each ``gap``-th; those between are made again
                gap = 1 if len(xs) * len(ys) <= WIDEST else math.isqrt(len(xs)) + 1
                i, j, row = len(xs), len(ys), [0] * (len(ys) + 1)
                kept, made = {0: row}, {}
                for n, x in enumerate(xs if ys else (), 1):
                    row = after(row, x, ys)
                    if n % gap == 0:
                        kept[n] = row
                while i and j:
                    if gap > 1 and (i not in made or i - 1 not in made):
                        n = (i - 1) // gap * gap
                        made = {n: kept[n]}
                        for m in range(n + 1, i + 1):
                            made[m] = after(made[m - 1], xs[m - 1], ys)
                    rows = made if gap > 1 else kept
                    if rows[i][j] == rows[i - 1][j]:
                        i -= 1
                    elif rows[i][j] == rows[i][j - 1]:
                        j -= 1
                    else:
                        pairs.append((xs[i - 1], ys[j - 1]))
                        i, j = i - 1, j - 1
                for x, y in pairs:
                    out[x] = y
                    stack.append((a.children[x], b.children[y]))
        finally:
            sys.setrecursionlimit(limit)
        return out


def tree_match(a: Tree | Frame, b: Tree | Frame) -> dict[int, int]:
    """Nodes of ``a`` and the nodes of ``b`` they match, by simple tree matching."""
    return Matcher(a).match(b)


def _pages(pages: DataFrame) -> DataFrame:
    one = pages.filter("html IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.max("html").alias("html"), F.max(host_of(F.col("url"))).alias("host"))
    return one.withColumn("host", F.coalesce("host", F.lit("")))


def _signs(t: Tree) -> list[int | None]:
    """A hash of each node's path of tags and text; none without text."""
    paths, out = [0] * len(t.tags), [None] * len(t.tags)
    stack = [(x, 0) for x in t.roots]
    while stack:
        x, above = stack.pop()
        paths[x] = xxhash.xxh3_64_intdigest(t.tags[x], above)
        if t.keys[x]:
            out[x] = xxhash.xxh3_64_intdigest(t.keys[x], paths[x]) - (1 << 63)
        stack.extend((c, paths[x]) for c in t.children[x])
    return out


class Frame:
    """A tree of candidates and their ancestors; candidates have their hash as tag and key, other nodes no key."""

    def __init__(self):
        self.tags: list[str] = []
        self.keys: list[str] = []
        self.children: list[list[int]] = []
        self.pages: list[int] = []
        self.roots: list[int] = []

    def new(self, tag: str, key: str) -> int:
        self.tags.append(tag)
        self.keys.append(key)
        self.children.append([])
        self.pages.append(0)
        return len(self.tags) - 1

    def grow(self, other: Frame, times: int | None = None) -> None:
        """Take in another frame, of ``times`` pages; with none named, its own numbers count."""
        at = {y: x for x, y in tree_match(self, other).items()}
        stack = [(-1, -1)]
        while stack:
            x, y = stack.pop()
            old = iter(self.roots if x < 0 else self.children[x])
            merged = []
            for c in other.roots if y < 0 else other.children[y]:
                if c in at:
                    for o in old:
                        merged.append(o)
                        if o == at[c]:
                            break
                else:
                    at[c] = self.new(other.tags[c], other.keys[c])
                    merged.append(at[c])
                self.pages[at[c]] += other.pages[c] if times is None else times
                stack.append((at[c], c))
            merged.extend(old)
            if x < 0:
                self.roots = merged
            else:
                self.children[x] = merged

    def dump(self) -> str:
        rows, stack = [], [(x, -1) for x in reversed(self.roots)]
        while stack:
            x, up = stack.pop()
            stack.extend((c, len(rows)) for c in reversed(self.children[x]))
            rows.append((up, self.keys[x] and int(self.keys[x]) or self.tags[x], self.pages[x]))
        return json.dumps(rows, separators=(",", ":"))

    @staticmethod
    def load(text: str) -> Frame:
        out = Frame()
        for up, name, pages in json.loads(text):
            x = out.new(str(name), str(name) if isinstance(name, int) else "")
            out.pages[x] = pages
            (out.roots if up < 0 else out.children[up]).append(x)
        return out


def _frame(ups: list[int], tags: list[str], signs: list[int | None], held: set[int]) -> tuple[Frame, list[int]]:
    """The frame of a page, and the page's node of each of its nodes."""
    kept = [s in held for s in signs]
    for i in range(len(ups) - 1, -1, -1):
        if kept[i] and ups[i] >= 0:
            kept[ups[i]] = True
    out, nodes, at = Frame(), [], {}
    for i, up in enumerate(ups):
        if kept[i]:
            key = str(signs[i]) if signs[i] in held else ""
            at[i] = out.new(key or tags[i], key)
            (out.children[at[up]] if up >= 0 else out.roots).append(at[i])
            nodes.append(i)
    return out, nodes


def _packed(x: list) -> bytes:
    raw = json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(4, "big") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(x: bytes) -> list:
    return json.loads(pa.decompress(x[4:], int.from_bytes(x[:4], "big"), "zstd", asbytes=True).decode("utf-8", "surrogatepass"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's tree, packed, so that it is parsed once: nodes (parent, tag, sign) and own texts."""
    for b in batches:
        nodes, texts = [], []
        for html in b.column(2).to_pylist():
            t = Tree(html)
            ups = [-1] * len(t.tags)
            for x, cs in enumerate(t.children):
                for c in cs:
                    ups[c] = x
            nodes.append(_packed([ups, t.tags, _signs(t)]))
            texts.append(_packed(t.texts))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(texts, pa.binary())], names=["page_id", "host", "nodes", "texts"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Host and sign, with the pages of the batch that have it."""
    for b in batches:
        seen: Counter[tuple[str, int]] = Counter()
        for host, nodes in zip(*(b.column(k).to_pylist() for k in range(2))):
            seen.update((host, s) for s in set(_unpacked(nodes)[2]) if s is not None)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.string()), pa.array([s for _, s in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["host", "sign", "on"])


class _Kept(dict):
    """What was made for each host, forgotten when it becomes large, which changes no result."""

    def __init__(self) -> None:
        super().__init__()
        self.size = 0

    def make(self, host: str, make):
        if host not in self:
            value, size = make()
            if self.size > KEPT_NODES:
                self.clear()
                self.size = 0
            self[host] = value
            self.size += size
        return self[host]


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = _Kept()
    for b in batches:
        hosts, nodes, signs = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        out = []
        for i, (host, packed) in enumerate(zip(hosts, nodes)):
            held = sets.make(host, lambda i=i: ((x := set(signs[i].as_py())), len(x)))
            out.append(_frame(*_unpacked(packed), held)[0].dump())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["host", "frame"])


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, part, frame`` of sorted rows ``host, part, frame, times``: one row per host and part."""
    at, tree = None, Frame()
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int32()), pa.array([tree.dump()], pa.string())], names=["host", "part", "frame"])
    for b in batches:
        for host, part, frame, times in zip(*(b.column(k).to_pylist() for k in range(4))):
            if at != (host, part):
                if at:
                    yield row()
                at, tree = (host, part), Frame()
            tree.grow(Frame.load(frame), times)
    if at:
        yield row()


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees = _Kept()

    def loaded(text: str) -> tuple[tuple[Matcher, set[int]], int]:
        t = Frame.load(text)
        return (Matcher(t), {int(k) for k in t.keys if k}), len(t.tags)

    for b in batches:
        out = []
        hosts, packed, texts, needs = (b.column(k).to_pylist() for k in (1, 2, 3, 5))
        for i, (host, need) in enumerate(zip(hosts, needs)):
            gone: set[int] = set()
            if need is not None:
                matcher, held = trees.make(host, lambda i=i: loaded(b.column(4)[i].as_py()))
                own, nodes = _frame(*_unpacked(packed[i]), held)
                whole = matcher.a
                gone = {nodes[y] for x, y in matcher.match(own).items() if whole.keys[x] and whole.pages[x] >= need}
                if len(matcher.ids) > REMEMBERED:
                    trees.pop(host)
            out.append([t for j, t in enumerate(_unpacked(texts[i])) if t and j not in gone])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["page_id", "slots"])


def _small(df: DataFrame, size: Column) -> DataFrame:
    """Broadcast if its rows have at most ``BROADCAST_BYTES`` in all, or else joined by shuffle."""
    held = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).head().n
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def _sorted(df: DataFrame) -> DataFrame:
    return df.repartition("host", "part").sortWithinPartitions("host", "part", F.xxhash64("frame"), "frame").select("host", "part", "frame", "times")


def page_slots(pages: DataFrame) -> DataFrame:
    """``page_id, slots``: the texts of each page that are no part of its host's template, in order."""
    own = cut_lineage(_pages(pages).select("page_id", "host", "html").mapInArrow(_parsed, "page_id bigint, host string, nodes binary, texts binary"))
    needed = own.groupBy("host").agg(F.greatest(F.lit(LEAST_PAGES), F.ceil(F.count(F.lit(1)) * SHARED)).cast("bigint").alias("needed"))
    seen = own.select("host", "nodes").mapInArrow(_texts, "host string, sign bigint, on bigint").groupBy("host", "sign").agg(F.sum("on").alias("on"))
    shared = seen.filter(F.col("on") >= LEAST_PAGES).join(needed, "host").filter(F.col("on") >= F.col("needed"))
    shared = cut_lineage(shared.groupBy("host").agg(F.first("needed").alias("needed"), F.array_sort(F.collect_list("sign")).alias("signs")))  # two branches read it
    shared = _small(shared, F.size("signs") * 8)
    frames = own.join(shared, "host").select("host", "nodes", "signs").mapInArrow(_frames, "host string, frame string")
    equal = frames.groupBy("host", "frame").agg(F.count(F.lit(1)).alias("times"))
    parts = _sorted(equal.withColumn("part", F.pmod(F.xxhash64("frame"), F.lit(BUCKETS)).cast("int"))).mapInArrow(_grown, "host string, part int, frame string")
    whole = parts.withColumns({"times": F.lit(None).cast("bigint"), "at": F.col("part"), "part": F.lit(0)}).repartition("host").sortWithinPartitions("host", "at").select("host", "part", "frame", "times")
    template = cut_lineage(whole.mapInArrow(_grown, "host string, part int, frame string").join(shared.select("host", "needed"), "host").select("host", F.col("frame").alias("template"), "needed"))
    made = own.join(_small(template, F.length("template")), "host", "left").select("page_id", "host", "nodes", "texts", "template", "needed")
    return made.mapInArrow(_slots, "page_id bigint, slots array<string>")
