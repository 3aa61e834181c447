"""Splitting oversized texts at natural boundaries by packing a structure tree.

The text is parsed into a tree of half-open spans: sections by heading, then blocks
(paragraphs, lists, tables, quotes, fenced code, markup blocks), then list items or
lines, sentences, words, and at last single characters with their marks. A node that
fits is never opened. Pieces of an opened node are merged with their siblings, bottom
up and in reading order, while they fit, so a cut always falls on the highest boundary
there is. Each piece but the first begins with the last ``overlap`` characters of the
one before it.

Size is that of breadcrumb, an empty line and text; a run of white space counts as
one character and as none at both ends.

Results: a null text has no piece and is not oversized; an empty or blank text that
fits is one piece; a null max_length is 2048, as is one below 1; a null overlap is 0.
An overlap is held to half the room for text. A breadcrumb that leaves less than half
the limit gives up its outermost headings until it does, and then its first
characters. Rows of a repeated key are one row. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 2048
#: The options table is broadcast only up to this many rows.
BROADCAST_OPTIONS = 100_000

_HEADING = re.compile(r"(?m)^(?:(#{1,6})[ \t]|(={2,6})[^=\n][^\n]*=[ \t]*$|[ \t]*<h([1-6])[ >]|[ \t]*\\(part|chapter|section|subsection|subsubsection|paragraph)\b)")
_LATEX_LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)")
_ITEM = re.compile(r"^[ \t]*(?:[-*+•·][ \t]|\d{1,9}[.)][ \t]|[*#:;]+[ \t]|\\item\b|<li\b)")
_TABLE = re.compile(r"^[ \t]*(?:\||\{\||\|\}|<t[rdh]\b)")
_QUOTE = re.compile(r"^[ \t]*>")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])\s*")
_WORD = re.compile(r"\s+")

Span = tuple[int, int]


def size(text: str) -> int:
    """Code points, every run of white space as one, none at the ends."""
    return len(" ".join(text.split()))


class Measure:
    """Sizes of spans of one text in constant time."""

    def __init__(self, text: str):
        blank = [c.isspace() for c in text]
        before = [True, *blank[:-1]] if blank else []
        self.total = [0, *accumulate(0 if b and p else 1 for b, p in zip(blank, before))]
        self.solid = [0, *accumulate(0 if b else 1 for b in blank)]
        n, self.next, self.last = len(text), [0] * (len(text) + 1), [0] * (len(text) + 1)
        at = n
        for i in range(n - 1, -1, -1):
            at = at if blank[i] else i
            self.next[i] = at
        self.next[n] = n
        at = 0
        for i in range(n):
            at = at if blank[i] else i + 1
            self.last[i + 1] = at

    def __call__(self, a: int, b: int) -> int:
        if self.solid[b] == self.solid[a]:
            return 0
        a, b = self.next[a], self.last[b]
        # counts from the first solid character on, which itself counts
        return self.total[b] - self.total[a]


def _cut(span: Span, places: list[int]) -> list[Span]:
    ends = [p for p in places if span[0] < p < span[1]]
    return [(a, b) for a, b in zip([span[0], *ends], [*ends, span[1]]) if a < b]


def lines_of(text: str, span: Span) -> list[Span]:
    """Line spans, each with its line feed."""
    at, out = span[0], []
    while at < span[1]:
        to = text.find("\n", at, span[1])
        to = span[1] if to < 0 else to + 1
        out.append((at, to))
        at = to
    return out


def fenced(text: str) -> list[Span]:
    """Spans of fenced code; an unclosed fence holds to the end."""
    out, mark, began = [], "", 0
    for a, b in lines_of(text, (0, len(text))):
        m = _FENCE.match(text[a:b])
        if not mark and m:
            mark, began = m[1], a
        elif mark and m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not text[a:b].strip(" \t\n" + mark[0]):
            out.append((began, b))
            mark = ""
    return [*out, (began, len(text))] if mark else out


def fence_at(code: list[Span], at: int) -> int | None:
    """The number of the fenced code that holds a place."""
    k = bisect_right(code, at, key=lambda s: s[0]) - 1
    return k if k >= 0 and at < code[k][1] else None


def sections(text: str, span: Span, code: list[Span], level: int = 0) -> list[Span]:
    """The preface and the sections of the highest heading level in the span below ``level``."""
    found = []
    for m in _HEADING.finditer(text, *span):
        if fence_at(code, m.start()) is None:
            rank = len(m[1]) if m[1] else len(m[2]) if m[2] else int(m[3]) if m[3] else _LATEX_LEVEL[m[4]]
            found.append((rank, m.start()))
    inner = [(r, p) for r, p in found if p > span[0]]
    if not inner:
        return [span]
    top = min(r for r, _ in inner)
    return _cut(span, [p for r, p in inner if r == top])


def blocks(text: str, span: Span, code: list[Span]) -> list[Span]:
    """Runs of lines of one kind, with the blank lines after them; fenced code is one block."""
    out: list[Span] = []
    last, blank = None, False
    for a, b in lines_of(text, span):
        line = text[a:b]
        held = fence_at(code, a)
        kind = ("code", held) if held is not None else "list" if _ITEM.match(line) else "table" if _TABLE.match(line) else "quote" if _QUOTE.match(line) else "text"
        empty = held is None and not line.strip()
        if out and (empty or (kind == last and (not blank or kind == "list" or held is not None)) or (last == "list" and kind == "text" and line[:1] in " \t")):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
            last = kind
        blank = empty
    return out


def items(text: str, span: Span, code: list[Span]) -> list[Span]:
    """List items of the least indent, or else lines."""
    own = lines_of(text, span)
    starts = [(len(text[a:b]) - len(text[a:b].lstrip()), a) for a, b in own if _ITEM.match(text[a:b])]
    if len(starts) > 1:
        least = min(i for i, _ in starts)
        inner = _cut(span, [a for i, a in starts if i == least])
        if len(inner) > 1:
            return inner
    return own


def sentences(text: str, span: Span, code: list[Span]) -> list[Span]:
    return _cut(span, [m.end() for m in _SENTENCE.finditer(text, *span)])


def words(text: str, span: Span, code: list[Span]) -> list[Span]:
    return _cut(span, [m.end() for m in _WORD.finditer(text, *span)])


def characters(text: str, span: Span, code: list[Span]) -> list[Span]:
    """Single characters, with marks and joiners left on what they follow."""
    return _cut(span, [i for i in range(span[0] + 1, span[1]) if not (unicodedata.combining(text[i]) or text[i] in "\u200d\ufe0f" or text[i - 1] == "\u200d" or "\U0001f3fb" <= text[i] <= "\U0001f3ff")])


LEVELS: tuple[Callable[[str, Span, list[Span]], list[Span]], ...] = (sections, blocks, items, sentences, words, characters)


def pack(text: str, room: int, measure: Measure) -> list[Span]:
    """Spans in order, each within ``room``; a character with its marks is the least there is."""
    code = fenced(text)

    def opened(span: Span, level: int) -> list[Span]:
        if measure(*span) <= room:
            return [span]
        if level == len(LEVELS):
            return _hard(span)
        parts = LEVELS[level](text, span, code)
        if len(parts) == 1:
            return opened(span, level + 1)
        again = level if LEVELS[level] in (sections, items) else level + 1
        merged: list[Span] = []
        for part in parts:
            for unit in opened(part, again):
                if merged and measure(merged[-1][0], unit[1]) <= room:
                    merged[-1] = (merged[-1][0], unit[1])
                else:
                    merged.append(unit)
        return merged

    def _hard(span: Span) -> list[Span]:
        out, a = [], span[0]
        while a < span[1]:
            out.append((a, min(a + room, span[1])))
            a += room
        return out

    return opened((0, len(text)), 0)


def filled(text: str, spans: list[Span], room: int, overlap: int, measure: Measure) -> list[Span]:
    """The first span of at least ``overlap`` characters: a shorter one takes from the next up to the highest boundary that suffices."""
    if len(spans) < 2 or spans[0][1] >= overlap:
        return spans
    (a, b), rest, code = spans[1], spans[2:], fenced(text)
    for level in (blocks, items, sentences, words, characters):
        ends = [e for _, e in level(text, (a, b), code) if overlap <= e and measure(0, e) <= room]
        if ends:
            return [(0, ends[-1]), *([(ends[-1], b)] if ends[-1] < b else []), *rest]
    return spans


def shorten(breadcrumb: str, limit: int) -> str:
    """The breadcrumb in at most half the limit, two characters left at least: without its outermost headings, then without its first characters."""
    most = max(0, min(limit // 2, limit - 2))
    while size(breadcrumb) > most and " > " in breadcrumb:
        breadcrumb = breadcrumb.split(" > ", 1)[1]
    return breadcrumb if size(breadcrumb) <= most else breadcrumb[len(breadcrumb) - most :] if most else ""


def split(text: str, limit: int, overlap: int = 0, breadcrumb: str = "") -> list[tuple[str, int, int]]:
    """(breadcrumb, start, end) of the pieces of a text; ends and starts of neighbours overlap."""
    whole = size(f"{breadcrumb}\n\n{text}" if breadcrumb.strip() else text)
    if whole <= limit:
        return [(breadcrumb, 0, len(text))]
    crumb = shorten(breadcrumb, limit)
    room = max(1, limit - (size(crumb) + 1 if crumb.strip() else 0))
    overlap = min(max(0, overlap), room // 2)
    measure = Measure(text)
    if measure(0, len(text)) <= room:
        return [(crumb, 0, len(text))]
    spans = filled(text, pack(text, room - overlap, measure), room - overlap, overlap, measure)
    return [(crumb, max(0, a - overlap) if k else a, b) for k, (a, b) in enumerate(spans)]


def with_limits(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """Chunks with ``limit_chars`` and ``overlap_chars`` of their option; unknown options have the defaults."""
    own = options.groupBy("option_id").agg(F.max("max_length").alias("m"), F.max("overlap").alias("o"))
    if own.limit(BROADCAST_OPTIONS + 1).count() <= BROADCAST_OPTIONS:
        own = F.broadcast(own)
    limit = F.when(F.col("m") >= 1, F.col("m")).otherwise(MAX_LENGTH).cast("int")
    return chunks.join(own, "option_id", "left").withColumns({"limit_chars": limit, "overlap_chars": F.coalesce("o", F.lit(0)).cast("int")})


def pieces(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """``chunk_id, oversized, piece_no, breadcrumb, text, span_start, span_end, size`` of every chunk with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, crumb, text, limit, overlap in zip(*(c.to_pylist() for c in b.columns)):
                if text is None:
                    continue
                crumb = crumb or ""
                made = split(text, limit, overlap, crumb)
                over = made != [(crumb, 0, len(text))]  # packing left the chunk as it is only if it fits
                for no, (head, a, z) in enumerate(made):
                    part = text[a:z]
                    rows.append((key, over, no, head, part, a, z, size(f"{head}\n\n{part}" if head.strip() else part)))
            names = ["chunk_id", "oversized", "piece_no", "breadcrumb", "text", "span_start", "span_end", "size"]
            types = [pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    own = with_limits(chunks.select("chunk_id", "option_id", "breadcrumb", "text"), options).select("chunk_id", "breadcrumb", "text", "limit_chars", "overlap_chars")
    return own.mapInArrow(run, "chunk_id bigint, oversized boolean, piece_no int, breadcrumb string, text string, span_start int, span_end int, size int")
