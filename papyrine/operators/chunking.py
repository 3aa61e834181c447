"""Heading-aware chunking of Markdown.

Phase 1 gives one chunk per paragraph block under its heading path. Phase 2 merges
neighbours of equal breadcrumb while the first is below ``min_length`` and both fit
``max_length``. Phase 3 (the default, and phase 0) merges sections into their parents
from below under the same rule, writing the child's heading line again. The text
before the first heading is never merged with others. A block longer than
``max_length`` stays whole. Lengths are those of breadcrumb, empty line and text, with
runs of white space as one character.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.space import collapse

MIN_LENGTH = 512
MAX_LENGTH = 2048
BLANK = "\u200b"
SCHEMA = "array<struct<level int, header string, headers array<string>, breadcrumb string, text string, length int>>"

_HEADING = re.compile(r"(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"[ \t]*(```+|~~~+)")


@dataclass(frozen=True)
class ChunkOptions:
    min_length: int | None = None
    max_length: int | None = None
    phase: int | None = None
    title: str | None = None


@dataclass
class Chunk:
    level: int
    header: str | None
    headers: list[str | None]
    breadcrumb: str
    text: str
    length: int = 0


def count_length(text: str) -> int:
    """Characters, runs of white space as one, none at the ends."""
    return len(collapse(text))


def length_of(c: Column) -> Column:
    """``count_length`` as a native Column."""
    return F.length(F.btrim(F.regexp_replace(c, r"(?U)\s++", " ")))


@dataclass
class _Section:
    level: int
    header: str | None
    headers: list[str | None]
    line: str = ""
    blocks: list[str] = field(default_factory=list)
    children: list[_Section] = field(default_factory=list)


def _sections(text: str, title: str | None) -> list[_Section]:
    """Sections in order of appearance, the preface first."""
    base = [title] if title else []
    out = [_Section(0, title, list(base))]
    path: list[str | None] = []
    block: list[str] = []
    fence = ""

    def end() -> None:
        if any(x.strip() for x in block):
            out[-1].blocks.append("\n".join(block).strip("\n").rstrip())
        block.clear()

    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        m = _FENCE.match(line)
        if fence:
            block.append(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = ""
                end()
            continue
        if m:
            if block and not any(x.strip() for x in block):
                block.clear()
            fence = m[1]
            block.append(line)
            continue
        if h := _HEADING.match(line):
            end()
            level = len(h[1])
            path = [*path[: level - 1], *[None] * (level - 1 - len(path)), h[2]]
            out.append(_Section(level, h[2], [*base, *path], line.strip()))
        elif not line.strip():
            end()
        else:
            block.append(line)
    end()
    return out


def _crumb(s: _Section, titled: bool) -> str:
    own = s.headers[1:] if titled and s.level else s.headers
    return " > ".join(h for h in own if h)


def _made(s: _Section, titled: bool, text: str) -> Chunk:
    crumb = _crumb(s, titled)
    return Chunk(s.level, s.header, list(s.headers), crumb, text, count_length(f"{crumb}\n\n{text}" if crumb else text))


def _merge(a: Chunk, text: str) -> Chunk:
    joined = f"{a.text}\n\n{text}"
    return Chunk(a.level, a.header, a.headers, a.breadcrumb, joined, count_length(f"{a.breadcrumb}\n\n{joined}" if a.breadcrumb else joined))


def chunk(text: str, options: ChunkOptions = ChunkOptions()) -> list[Chunk]:
    """Chunks in order. A text that is not blank has at least one, even if it is headings alone."""
    out = _chunk(text, options)
    if out or not text.strip():
        return out
    out = _chunk(f"{text}\n\n{BLANK}", options)
    for c in out:
        c.text = c.text.removesuffix(BLANK).rstrip("\n")
        c.length = count_length(f"{c.breadcrumb}\n\n{c.text}" if c.breadcrumb else c.text)
    return out


def _chunk(text: str, o: ChunkOptions) -> list[Chunk]:
    least = MIN_LENGTH if o.min_length is None else max(0, o.min_length)
    most = MAX_LENGTH if o.max_length is None else max(1, o.max_length)
    phase = 3 if not o.phase else o.phase
    titled = bool(o.title)
    sections = _sections(text, o.title)
    first = [(s, [_made(s, titled, b) for b in s.blocks]) for s in sections]
    if phase == 1:
        return [c for _, cs in first for c in cs]
    flat: list[Chunk] = []
    for c in (c for _, cs in first for c in cs):
        if flat and flat[-1].breadcrumb == c.breadcrumb and flat[-1].level == c.level and flat[-1].length < least and (new := _merge(flat[-1], c.text)).length <= most:
            flat[-1] = new
        else:
            flat.append(c)
    if phase == 2:
        return flat
    return _absorb(flat, least, most)


def _absorb(flat: list[Chunk], least: int, most: int) -> list[Chunk]:
    """Chunks of deeper levels into the chunk before them that their heading path continues, deepest first."""
    for level in range(6, 1, -1):
        out: list[Chunk] = []
        for c in flat:
            up = out[-1] if out else None
            if up is not None and c.level == level and 0 < up.level < level and c.headers[: len(up.headers)] == up.headers and (up.length < least or c.length < least):
                line = "#" * c.level + " " + (c.header or "")
                if (new := _merge(up, f"{line}\n\n{c.text}")).length <= most:
                    out[-1] = new
                    continue
            if up is not None and c.level == up.level == level and c.headers == up.headers and up.length < least and (new := _merge(up, c.text)).length <= most:
                out[-1] = new
                continue
            out.append(c)
        flat = out
    return flat


def _rows(cs: list[Chunk]) -> list[dict]:
    return [{"level": c.level, "header": c.header, "headers": c.headers, "breadcrumb": c.breadcrumb, "text": c.text, "length": c.length} for c in cs]


_ARROW = pa.list_(pa.struct([("level", pa.int32()), ("header", pa.string()), ("headers", pa.list_(pa.string())), ("breadcrumb", pa.string()), ("text", pa.string()), ("length", pa.int32())]))


def chunk_markdown(text: Column, options: ChunkOptions | Column = ChunkOptions()) -> Column:
    """``array<struct<level, header, headers, breadcrumb, text, length>>``; null stays null, blank gives no chunk. Options are one object or a struct Column."""
    if isinstance(options, ChunkOptions):

        @F.arrow_udf(SCHEMA)
        def run(v: pa.Array) -> pa.Array:
            return pa.array([None if x is None else _rows(chunk(x, options)) for x in v.to_pylist()], _ARROW)

        return run(text)

    @F.arrow_udf(SCHEMA)
    def each(v: pa.Array, o: pa.Array) -> pa.Array:
        made = (ChunkOptions(**{k: (y or {}).get(k) for k in ("min_length", "max_length", "phase", "title")}) for y in o.to_pylist())
        return pa.array([None if x is None else _rows(chunk(x, y)) for x, y in zip(v.to_pylist(), made)], _ARROW)

    return each(text, options)


def chunks_of(df: DataFrame, key: str, text: str, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """``key, seq, level, header, headers, breadcrumb, text, length``: one row per chunk."""
    each = df.select(F.col(key), F.posexplode(chunk_markdown(F.col(text), options)).alias("seq", "x"))
    return each.select(key, "seq", "x.*")
