"""The main body of pages, by a linear-chain conditional random field over leaf blocks.

The blocks of a page are the lines of its content. Each is aligned, in reading order,
with a leaf block of the page's DOM by its letters, which gives it ancestor tags and
classes; text features (signs, lengths, separators, place, words of short lines) hold
for every line, also where a page has no HTML. Two labels, main body and furniture;
decoding is Viterbi over the non-blank lines of a content.

Blocks are found by hashes of their letters, which are spans of the letters of the page,
so a page costs time in proportion to its length, however deep it is.

Training labels come from the pages themselves: blocks under ``main``/``article`` or a
site's content selectors are main body, those under ``nav``, ``aside``, ``footer``,
``dialog`` or a site's selectors to remove are furniture, all others stay open (the
likelihood sums over them). Each training page is read twice, with and without its DOM
features, so the field also learns to decide by text. It is fitted on the ``SAMPLE``
pages of least hash: the documented bound of the fit.

Results: a null content has no lines; blank lines are never labelled; a content whose
page or HTML is missing is decided by its text; a page stored twice counts once; with
no labelled page at all, every line is main body.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.hashing import Sums, points_of
from papyrine.operators import dom

SAMPLE = 1200
SIZE = 1 << 16
STEPS = 120
PENALTY = 0.05

MAIN_TAGS = frozenset(("main", "article"))
FURNITURE_TAGS = frozenset(("nav", "aside", "footer", "dialog"))
_UNREAD = frozenset(("head", "script", "style", "#comment"))
_LEAF = frozenset("p a li h1 h2 h3 h4 h5 h6 td th dt dd pre blockquote figcaption caption summary".split())
_INLINE = frozenset("a abbr b bdi bdo br cite code em font i img kbd mark q s small span strong sub sup u wbr".split())
_DIGIT = re.compile(r"\d")
_MARKUP = re.compile(r"<[^<>]*>|\]\([^()\s]*\)")
_WORD = re.compile(r"[^\W\d_]+")
_NOTHING = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")  # shows nothing, hides words
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s")


def letters(text: str) -> str:
    return "".join(filter(str.isalpha, unicodedata.normalize("NFKD", text).casefold()))


class Place:
    """An ancestor of blocks, with the ancestors above it."""

    __slots__ = ("up", "tag", "classes", "first", "total")

    def __init__(self, up: Place | None, tag: str, classes: tuple[str, ...]):
        self.up, self.tag, self.classes, self.total = up, tag, classes, None
        self.first: Place = up.first if up else self

    def path(self) -> list[Place]:
        """The ancestors from the innermost on."""
        out, at = [], self
        while at:
            out.append(at)
            at = at.up
        return out

    def names(self) -> list[str]:
        """Features of this ancestor alone."""
        out = [f"tag:{self.tag}"]
        for c in self.classes:
            out += [f"cls:{_stem(c)}", f"tagcls:{self.tag}.{_stem(c)}"]
        return out

    def score(self, weights: np.ndarray) -> float:
        """Sum of the weights of all ancestors, kept for blocks in the same place."""
        open_, at = [], self
        while at and at.total is None:
            open_.append(at)
            at = at.up
        total = at.total if at else 0.0
        for at in reversed(open_):
            total = at.total = total + float(weights[[feature(x) for x in at.names()]].sum())
        return total


Block = tuple[str, Place | None]


def hashes_of(keys: list[str]) -> np.ndarray:
    """Hash of each string, as ``Sums`` gives for an equal span of any text."""
    ends = np.cumsum([len(k) for k in keys])
    return Sums(points_of("".join(keys))).spans(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def leaf_blocks(page: str) -> tuple[np.ndarray, list[Block]]:
    """Hashes of the letters of a page's blocks and links, and their (tag, place), in the order in which they end.

    The letters of a block are one span of the letters of the page, so none is copied upwards.
    """
    spans: list[tuple[int, int]] = []
    blocks: list[Block] = []
    pieces: list[str] = []
    size = 0
    stack: list[tuple[dom.Node, Place | None, int]] = [(c, None, -1) for c in reversed(dom.parse(page, fragment=False).children)]
    while stack:
        n, place, start = stack.pop()
        tag = n.tag
        if start >= 0:
            if size > start:
                spans.append((start, size))
                blocks.append((tag, place))
        elif tag == "#text":
            pieces.append(letters(n.text))
            size += len(pieces[-1])
        elif tag not in _UNREAD:
            inline = tag in _INLINE
            inner = place if inline or tag in ("html", "body") else Place(place, tag, tuple([*n.attrs.get("class", "").split(), *n.attrs.get("id", "").split()]))
            if tag == "a" or not inline:
                stack.append((n, place if inline or tag in _LEAF else inner, size))
            stack.extend((c, inner, -1) for c in reversed(n.children))
    if not spans:
        return np.zeros(0, np.uint64), []
    bounds = np.array(spans)
    return Sums(points_of("".join(pieces))).spans(bounds[:, 0], bounds[:, 1]), blocks


def align(lines: list[str], page: str | None) -> list[Block | None]:
    """(tag, place) of the block each line comes from; later blocks for later lines where there is a choice."""
    if not page or not lines:
        return [None] * len(lines)
    keys, blocks = leaf_blocks(page)
    places: dict[int, tuple[list[int], list[int], list[int]]] = {}  # of all blocks, of links, of others
    for i, key in enumerate(keys.tolist()):
        found = places.setdefault(key, ([], [], []))
        found[0].append(i)
        found[1 if blocks[i][0] == "a" else 2].append(i)
    whole = [letters(x) for x in lines]
    bare = [letters(_MARKUP.sub("", x)) if "<" in x or "](" in x else "" for x in lines]
    sums = hashes_of([*whole, *bare]).tolist()
    out: list[Block | None] = []
    at = -1
    for k, line in enumerate(lines):
        found = places.get(sums[k]) if whole[k] else None
        found = found or (places.get(sums[len(lines) + k]) if bare[k] else None)
        if not found:
            out.append(None)
            continue
        own = found[0] if _ITEM.match(line) else found[2] or found[1]
        j = bisect_right(own, at)
        i = own[j if j < len(own) else 0]
        if blocks[i][0] != "a":
            at = max(at, i)
        out.append(blocks[i])
    return out


def _stem(name: str) -> str:
    return name.lower().split("-")[0].rstrip("0123456789") + ("#" if name.split("-")[0][-1:].isdigit() else "") if not re.fullmatch(r"[a-z]\d", name.split("-")[0]) else name.split("-")[0]


@lru_cache(maxsize=1 << 16)
def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % SIZE


def text_features(line: str, at: int, of: int, shorts: tuple[bool, bool]) -> list[str]:
    """Names of a line's features that need no DOM."""
    if not line.isascii():
        line = _NOTHING.sub("", line)
    bare = line.strip().strip("*_>\u200b\u2060\ufeff ")
    words = _WORD.findall(bare.casefold())
    n, size = len(words), len(bare)
    out = [
        "bias",
        f"n:{min(n, 4) if n < 5 else 5 + min(n // 4, 8)}",
        f"end:{unicodedata.category(bare[-1]) + (bare[-1] if not bare[-1].isalnum() else '') if bare else ''}",
        f"first:{unicodedata.category(bare[0]) + (bare[0] if not bare[0].isalnum() else '') if bare else ''}",
        f"from:{min(at, 5)}",
        f"to:{min(of - 1 - at, 7)}",
        f"shorts:{shorts}:{n <= 8}",
    ]
    stops = sum(bare.count(x) for x in ".!?。")
    out.append(f"stops:{min(stops, 4)}:{n > 12}")
    for sign, name in (("·", "dot"), (" | ", "bar"), ("](", "link"), ("»", "right"), (" > ", "more"), (" / ", "slash"), ("©", "copy"), ("—", "dash"), (":", "colon"), ("@", "at"), ("…", "more…"), ("```", "fence"), ("http", "url"), ("![", "image"), ("\\", "tex"), ("{", "brace"), ("<", "tag"), ("»", "q")):
        if sign in bare:
            out.append(f"has:{name}:{min(bare.count(sign), 4)}")
    head = line.lstrip("\u200b\u2060\ufeff \t")[:3]
    if head[:1] in "#*->|•=" or _ITEM.match(line):
        out.append(f"head:{head[:1] if not head[:1].isdigit() else '1.'}:{n <= 12}")
    if bare[:1] == "#" or head[:1] == "#":
        out.append("heading")
    if size and not n:
        out.append(f"signs:{_DIGIT.search(bare) is not None}")
    if words and bare.isupper():
        out.append("upper")
    if size and len(_DIGIT.findall(bare)) * 3 > size:
        out.append("digits")
    parts = bare.split()
    capitals = len([1 for w in parts if w[:1].isupper()])
    out.append(f"caps:{min(10, 10 * capitals // max(1, len(parts)))}:{n <= 12}")
    if n <= 24:
        folded = [unicodedata.normalize("NFKC", w) for w in words]
        out += [f"w:{w}" for w in folded]
        out += [f"p:{a} {b}" for a, b in zip(folded, folded[1:])]
        if folded:
            out.append(f"fw:{folded[0]}")
    return out


def dom_features(block: Block | None) -> list[str]:
    """Names of the features a line has from its own block."""
    if block is None:
        return ["dom:none"]
    tag, place = block
    return [f"leaf:{tag}", *(x for p in (place.path() if place else []) for x in p.names())]


def near_features(blocks: list[Block | None]) -> list[list[str]]:
    """Features that a line without a block has from the nearest blocks before and after it."""

    def nearest(order) -> list[Block | None]:
        out, last = [None] * len(blocks), None
        for k in order:
            out[k] = last
            last = blocks[k] or last
        return out

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))

    def names(k: int) -> list[str]:
        out = []
        for j, near in enumerate((before[k], after[k])):
            if near is not None:
                first = near[1].first if near[1] else None
                out.append(f"near{j}:{first.tag if first else ''}:{_stem(first.classes[0]) if first and first.classes else ''}")
        return out

    return [[] if b is not None else names(k) for k, b in enumerate(blocks)]


def rows_of(content: str, page: str | None) -> tuple[list[int], list[list[int]], list[Block | None]]:
    """Line numbers (from 1) of the non-blank lines, their text feature ids, and their blocks."""
    numbered = [(i, x) for i, x in enumerate(content.split("\n"), 1) if x.strip()]
    lines = [x for _, x in numbered]
    short = [len(x) < 90 for x in lines]
    text = []
    for k, line in enumerate(lines):
        shorts = (k > 0 and short[k - 1], k + 1 < len(lines) and short[k + 1])
        text.append([feature(x) for x in text_features(line, k, len(lines), shorts)])
    return [i for i, _ in numbered], text, align(lines, page)


def dom_ids(blocks: list[Block | None]) -> list[list[int]]:
    """DOM feature ids of each line."""
    return [[feature(x) for x in (*dom_features(b), *near)] for b, near in zip(blocks, near_features(blocks))]


def selects(selector: str, path: list[Place]) -> bool:
    """Whether a simple selector (tag, .class, #id, tag.class) matches one of the ancestors."""
    tag, _, rest = re.sub(r"[.#]", "\0", selector.strip(), count=1).partition("\0")
    wanted = set(re.split(r"[.#]", rest)) - {""}
    return bool(tag or wanted) and not re.search(r"[\s>+~:\[]", selector.strip()) and any((not tag or p.tag == tag.lower()) and wanted <= set(p.classes) for p in path)


def label(block: Block | None, keep: list[str], drop: list[str]) -> int:
    """1 furniture, 0 main body, -1 open."""
    if block is None:
        return -1
    path = block[1].path() if block[1] else []
    tags = {p.tag for p in path}
    if tags & FURNITURE_TAGS:
        return 1
    if tags & MAIN_TAGS or any(selects(s, path) for s in keep):
        return 0
    return 1 if any(selects(s, path) for s in drop) else -1


class Field:
    """Weights of the chain: furniture against main body per feature, and the transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def frame(self, spark: SparkSession) -> DataFrame:
        """``kind, at, value``: the weights that are not 0 and the moves, to be written and read again instead of fitting anew."""
        used = np.flatnonzero(self.weights)
        rows = [("weight", int(i), float(self.weights[i])) for i in used] + [("move", i, float(x)) for i, x in enumerate(self.moves.ravel())]
        return spark.createDataFrame(rows, "kind string, at int, value double")

    @staticmethod
    def of(frame: DataFrame) -> Field:
        """The field of a frame; it has at most ``SIZE`` weights."""
        weights, moves = np.zeros(SIZE), np.zeros(4)
        for r in frame.collect():
            (weights if r.kind == "weight" else moves)[r["at"]] = r.value
        return Field(weights, moves.reshape(2, 2))

    def scores(self, features: list[list[int]]) -> np.ndarray:
        ends = np.cumsum([len(f) for f in features])
        flat = np.concatenate([[0.0], np.cumsum(self.weights[np.fromiter((x for f in features for x in f), dtype=np.int64, count=int(ends[-1]))])])
        return flat[ends] - flat[np.concatenate([[0], ends[:-1]])]

    def dom_scores(self, blocks: list[Block | None]) -> np.ndarray:
        """Scores of ``dom_ids``, each ancestor added up once."""
        near = [sum(float(self.weights[feature(x)]) for x in names) for names in near_features(blocks)]
        none = float(self.weights[feature("dom:none")])
        own = [none if b is None else float(self.weights[feature(f"leaf:{b[0]}")]) + (b[1].score(self.weights) if b[1] else 0.0) for b in blocks]
        return np.array(own) + np.array(near)

    def decode(self, scores: list[float]) -> list[int]:
        """The most likely labels of one content."""
        (mm, mf), (fm, ff) = self.moves.tolist()
        a, b, back = 0.0, scores[0], []
        for s in scores[1:]:
            am, bm, af, bf = a + mm, b + fm, a + mf, b + ff
            back.append((0 if am >= bm else 1, 0 if af > bf else 1))
            a, b = max(am, bm), max(af, bf) + s
        out = [0 if a >= b else 1]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def _chains(unary: np.ndarray, live: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-partition sum, marginals and expected transitions of padded chains (documents, lines, 2), the longest first."""
    docs, length, _ = unary.shape
    at = live.sum(axis=0).tolist()  # documents that reach each line are the first ones
    ahead = unary.copy()
    lse = lambda x, axis: np.logaddexp(np.take(x, 0, axis), np.take(x, 1, axis))
    for t in range(1, length):
        n = at[t]
        ahead[:n, t] += lse(ahead[:n, t - 1, :, None] + moves[None], 1)
    last = live.sum(axis=1) - 1
    z = lse(ahead[np.arange(docs), last], 1)
    back = np.zeros_like(unary)
    pairs = np.zeros((2, 2))
    for t in range(length - 2, -1, -1):
        n = at[t + 1]
        inner = unary[:n, t + 1] + back[:n, t + 1]
        pairs += np.exp(ahead[:n, t, :, None] + moves[None] + inner[:, None, :] - z[:n, None, None]).sum(axis=0)
        back[:n, t] = lse(moves[None] + inner[:, None, :], 2)
    marginal = np.exp(np.where(live[..., None], ahead + back - z[:, None, None], -np.inf))
    return float(z.sum()), marginal, pairs


def train(pages: list[tuple[list[list[int]], list[int]]], steps: int = STEPS) -> Field:
    """The field that maximises the penalised likelihood of the labels known, by Adam on the whole sample."""
    pages = sorted((p for p in pages if p[0] and any(x >= 0 for x in p[1])), key=lambda p: -len(p[0]))
    weights, moves = np.zeros(SIZE), np.zeros((2, 2))
    if not pages:
        weights[:] = -1.0
        return Field(weights, moves)
    docs, length = len(pages), max(len(f) for f, _ in pages)
    live = np.zeros((docs, length), bool)
    known = np.full((docs, length), -1)
    for d, (f, y) in enumerate(pages):
        live[d, : len(f)] = True
        known[d, : len(f)] = y
    flat = np.fromiter((x for f, _ in pages for r in f for x in r), dtype=np.int64)
    row = np.repeat(np.arange(int(live.sum())), [len(r) for f, _ in pages for r in f])
    used, flat = np.unique(flat, return_inverse=True)
    own = np.zeros(len(used))
    shut = np.zeros((docs, length, 2))
    shut[..., 0][known == 1] = -1e9
    shut[..., 1][known == 0] = -1e9
    state = [np.zeros(len(used)), np.zeros(len(used)), np.zeros((2, 2)), np.zeros((2, 2))]
    for k in range(1, steps + 1):
        unary = np.zeros((docs, length, 2))
        unary[live, 1] = np.bincount(row, own[flat], minlength=int(live.sum()))
        _, free, pairs_free = _chains(unary, live, moves)
        _, held, pairs_held = _chains(unary + shut, live, moves)
        slope = np.bincount(flat, (held - free)[live][:, 1][row], minlength=len(used)) - PENALTY * own
        turn = pairs_held - pairs_free - PENALTY * moves
        for i, (value, grad) in enumerate(((own, slope), (moves, turn))):
            m, v = state[2 * i], state[2 * i + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += 0.12 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    weights[used] = own
    return Field(weights, moves)


def _least(df: DataFrame, key: str, most: int) -> list:
    """The keys of least hash: only keys travel, a bounded number from each partition."""
    rows = df.select(key).distinct().select(F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(most).collect()
    return [r[key] for r in rows]


def fit(contents: DataFrame, pages: DataFrame, options: DataFrame, removals: DataFrame, sample: int = SAMPLE) -> Field:
    """The field, fitted on at most ``sample`` labelled contents."""
    ids = _least(contents.filter("content IS NOT NULL AND content_id IS NOT NULL"), "content_id", sample)
    own = contents.filter(F.col("content_id").isin(ids)).select("content_id", "page_id", "site_id", "content").collect()
    page_ids, site_ids = sorted({r.page_id for r in own if r.page_id is not None}), sorted({r.site_id for r in own if r.site_id is not None})
    html = {r.page_id: r.html for r in pages.filter(F.col("page_id").isin(page_ids)).select("page_id", "html").collect()}
    keep = {r.site_id: r.content_selectors or [] for r in options.filter(F.col("site_id").isin(site_ids)).select("site_id", "content_selectors").collect()}
    drop = {r.site_id: r.css_selectors_to_remove or [] for r in removals.filter(F.col("site_id").isin(site_ids)).select("site_id", "css_selectors_to_remove").collect()}
    read = []
    for r in sorted({r.content_id: r for r in own}.values(), key=lambda r: r.content_id):
        _, text, blocks = rows_of(r.content, html.get(r.page_id))
        y = [label(b, [s for s in keep.get(r.site_id, []) if s], [s for s in drop.get(r.site_id, []) if s]) for b in blocks]
        if any(x >= 0 for x in y):
            read += [([t + d for t, d in zip(text, dom_ids(blocks))], y), (text, y)]
    return train(read)


def labelled(contents: DataFrame, pages: DataFrame, field: Field) -> DataFrame:
    """``content_id, furniture`` (line numbers) and ``content``, the main body alone, of each row with content."""
    html = pages.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("html").alias("html"))
    both = contents.filter(F.col("content").isNotNull()).select("content_id", "page_id", "content").join(html, "page_id", "left").select("content_id", "content", "html")
    shared = contents.sparkSession.sparkContext.broadcast(field)  # SIZE weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            gone, kept = [], []
            for content, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                numbers, text, blocks = rows_of(content, page)
                if not numbers:
                    gone.append([])
                    kept.append(content)
                    continue
                scores = own.scores(text) + own.dom_scores(blocks) if page else own.scores(text)
                out = {i for i, y in zip(numbers, own.decode(scores.tolist())) if y}
                gone.append(sorted(out))
                kept.append("\n".join(x for i, x in enumerate(content.split("\n"), 1) if i not in out))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=["content_id", "furniture", "content"])

    return both.mapInArrow(run, "content_id bigint, furniture array<int>, content string")
