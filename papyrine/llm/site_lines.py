"""Lines repeated across the documents of one site, by content-defined chunks.

A content is read as one stream of letters (no case, accents, width, digits, signs or
line ends). Chunks end where the rolling hash of ``GRAM`` letters is the least of some
``window`` neighbouring ones, for each window of ``WINDOWS``; a chunk reaches to the end
of the letters hashed at its end. Whatever stands around it, a line of ``LETTERS``
letters holds a whole chunk of the least window, since GRAM + 2 * window - 1 <= LETTERS,
and longer lines hold longer ones. Distinct contents are counted per site and chunk;
chunks of ``CONTENTS`` contents are cut. A line is read off the cut if the longest chunk
whose place its own letters decide is cut. The exact check that follows counts
whole lines of what was read off, since lines of other letters can share a chunk.

Results: a null content has no lines; a line with fewer than ``LETTERS`` letters never
counts; a row stored twice counts once; a content without host in its canonical URL
belongs to the host of its page's URL, and one without either to the site ''.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions.hosts import host_of
from papyrine.llm.hashing import Sums, mixed, points_of
from papyrine.plans.session import cut_lineage

LETTERS = 15
CONTENTS = 5
GRAM = 4
#: Neighbouring hashes of which a cut has the least, from the least window to the largest; gaps between cuts stay below 256.
WINDOWS = (6, 18)

_OTHERS = re.compile(r"(?:(?!\n)[\W\d_])+")


def letters_of(text: str) -> str:
    """Its letters and line feeds, without case, accents and width."""
    return _OTHERS.sub("", unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold()))


def with_site(contents: DataFrame, pages: DataFrame) -> DataFrame:
    """``site, content_id, content``: only rows whose canonical URL names no host are joined with pages."""
    named = contents.filter(F.col("content").isNotNull() & F.col("content_id").isNotNull()).select("content_id", "page_id", "content", F.coalesce(host_of(F.col("canonical_url")), F.lit("")).alias("site"))
    hosts = pages.groupBy("page_id").agg(F.max(host_of(F.col("url"))).alias("page_host"))
    rest = named.filter("site = ''").drop("site").join(hosts, "page_id", "left").withColumn("site", F.coalesce("page_host", F.lit("")))
    cols = ["site", "content_id", "content"]
    return named.filter("site <> ''").select(cols).unionByName(rest.select(cols))


class Stream:
    """The letters of a batch of contents, and where contents and lines begin and end in them."""

    def __init__(self, texts: list[str]):
        folded = [letters_of(t) for t in texts]
        points = points_of("\n".join(folded) + "\n")
        feeds = points == 10
        self.points = points[~feeds]
        self.line_ends = np.cumsum(~feeds)[feeds]
        self.line_starts = np.concatenate([[0], self.line_ends[:-1]])
        sizes = np.array([f.count("\n") + 1 for f in folded])
        self.row = np.repeat(np.arange(len(folded)), sizes)  # of each line
        self.line_no = np.arange(len(self.row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        self.ends = self.line_ends[np.cumsum(sizes) - 1]
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.sums = Sums(self.points)


def least_places(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each start, the place of the least of ``window`` hashes, the last one of equal ones."""
    least, at, size = hashes, np.arange(len(hashes)), 1
    while size < window:
        step = min(size, window - size)
        later = least[step:] <= least[:-step]
        least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
        size += step
    return at


def chunks_of(stream: Stream, seeds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a window: the least place of each start, the cuts, and the chunk ids with the contents they lie in.

    Chunk i lies between cuts i and i + 1. An id has the gap between its cuts in its highest byte, so a longer chunk has a greater id.
    """
    places = np.arange(max(0, len(stream.points) - GRAM + 1))
    hashes = stream.sums.spans(places, places + GRAM)
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none
    at = least_places(hashes, window)
    own = np.searchsorted(stream.ends, np.arange(len(at)), side="right")  # content of each start
    inside = np.arange(len(at)) + window + GRAM - 1 <= stream.ends[own]
    least = np.zeros(len(hashes), bool)
    least[at[inside]] = True
    cuts = np.flatnonzero(least)
    content = np.searchsorted(stream.ends, cuts, side="right")
    begin, end = cuts[:-1], cuts[1:]
    known = mixed(stream.sums.spans(begin, end + GRAM) ^ seeds[content[:-1]] ^ np.uint64(window)) >> np.uint64(8)  # chunks of two windows differ
    ids = known | ((end - begin).astype(np.uint64) << np.uint64(56))
    ids[content[:-1] != content[1:]] = 0  # no chunk goes on in the next content
    return at, cuts, ids, content[:-1]


def seeds_of(sites: list[str]) -> np.ndarray:
    """One number a site, so equal chunks of two sites differ."""
    known = {s: hash_text(s) for s in set(sites)}
    return np.array([known[s] for s in sites], dtype=np.uint64)


def content_chunks(texts: list[str], sites: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different chunks of a batch, and in how many of its contents each is."""
    stream, seeds = Stream(texts), seeds_of(sites)
    made = [chunks_of(stream, seeds, window)[2:] for window in WINDOWS]
    ids, content = (np.concatenate(x) for x in zip(*made))
    order = np.argsort(ids, kind="stable")  # contents of one chunk stay in order, window by window
    order = order[np.searchsorted(ids[order], 1) :]  # 0 is no chunk
    ids, content = ids[order], content[order]
    if not len(ids):
        return ids, content
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    other = first | np.concatenate([[True], content[1:] != content[:-1]])
    return ids[first], np.add.reduceat(other.astype(np.int64), np.flatnonzero(first))


def line_chunks(texts: list[str], sites: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with enough letters of a batch: row, line number, the longest chunk whose place the line decides, and the hash of the whole line."""
    stream, seeds = Stream(texts), seeds_of(sites)
    long = np.flatnonzero(stream.line_ends - stream.line_starts >= LETTERS)
    starts, ends = stream.line_starts[long], stream.line_ends[long]
    best = np.zeros(len(long), np.uint64)
    for window in WINDOWS:
        at, cuts, ids, _ = chunks_of(stream, seeds, window)
        fits = np.flatnonzero(ends - starts >= GRAM + 2 * window - 1)
        if not len(fits):
            continue
        first = np.searchsorted(cuts, at[starts[fits]])
        last = np.searchsorted(cuts, at[ends[fits] - GRAM - window + 1])
        ranges = np.stack([first, last], axis=1).ravel()
        best[fits] = np.maximum(best[fits], np.maximum.reduceat(np.concatenate([ids, np.zeros(2, np.uint64)]), ranges)[::2])
    return stream.row[long], stream.line_no[long], best, stream.sums.spans(starts, ends)


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def _columns(b: pa.RecordBatch) -> tuple[list[str], list[str]]:
    return b.column(2).to_pylist(), b.column(0).to_pylist()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            ids, contents = content_chunks(*_columns(b))
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(contents.astype(np.int64))], names=["chunk", "contents"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            row, line_no, chunk, line = line_chunks(*_columns(b))
            at = pa.array(row.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(line_no.astype(np.int32)), pa.array(chunk.view(np.int64)), pa.array(line.view(np.int64))],
                names=["site", "content_id", "line_no", "chunk", "line"],
            )


def lines_of_cut_chunks(own: DataFrame, least: int = CONTENTS) -> DataFrame:
    """``site, content_id, line_no, line`` of lines read off the chunks that at least ``least`` contents of their site share; ``line`` is the hash of its letters."""
    # a row stored twice counts twice here, which may cut a chunk too many; the exact check counts it once
    cut = own.mapInArrow(_chunks, "chunk bigint, contents bigint").groupBy("chunk").agg(F.sum("contents").alias("contents")).filter(F.col("contents") >= least).select("chunk")
    return own.mapInArrow(_lines, "site string, content_id bigint, line_no int, chunk bigint, line bigint").join(cut, "chunk").select("site", "content_id", "line_no", "line")


def repeated_lines(contents: DataFrame, pages: DataFrame, least: int = CONTENTS) -> DataFrame:
    """``site, content_id, line_no, line``: lines that recur in at least ``least`` contents of their site; ``line`` is the hash of its letters."""
    near = cut_lineage(lines_of_cut_chunks(with_site(contents, pages), least))
    counts = near.groupBy("site", "line").agg(F.count_distinct("content_id").alias("contents")).filter(F.col("contents") >= least)
    return near.join(counts, ["site", "line"]).groupBy("content_id", "line_no").agg(F.first("site").alias("site"), F.first("line").alias("line"), F.first("contents").alias("contents"))


def site_list(contents: DataFrame, found: DataFrame) -> DataFrame:
    """``site, line, contents``: the list of repeated lines per site, each as its least stored form."""
    numbered = contents.filter(F.col("content").isNotNull()).groupBy("content_id").agg(F.first("content").alias("content"))
    texts = found.groupBy("content_id", "site").agg(F.collect_list(F.struct("line_no", "line", "contents")).alias("own")).join(numbered, "content_id")
    each = texts.withColumn("rows", F.split("content", "\n", -1)).select("site", F.explode("own").alias("x"), "rows")
    return each.groupBy("site", F.col("x.line").alias("key")).agg(F.min(F.trim(F.element_at("rows", F.col("x.line_no")))).alias("line"), F.first("x.contents").alias("contents")).drop("key")


def without_lines(contents: DataFrame, found: DataFrame) -> DataFrame:
    """``content_id, content`` of every row, with the found lines cut; null stays null."""
    gone = found.groupBy("content_id").agg(F.collect_set("line_no").alias("gone"))
    numbered = F.transform(F.split("content", "\n", -1), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    kept = F.filter(numbered, lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), x["no"]))
    return contents.select("content_id", "content").join(gone, "content_id", "left").select("content_id", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("content"))
