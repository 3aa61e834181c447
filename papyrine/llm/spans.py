"""Long exact spans shared between records: seed on winnowed anchors, extend both ways.

A window is ``length`` consecutive code points. Each window is owned by one of the
``length // 2``-grams inside it, the one of least hash (the rightmost on a tie), so
windows that are equal have equal owners at equal places: no shared window lacks a
shared anchor. All windows a gram owns form its region.

1. Seeds: an occurrence of an anchor whose whole region recurs in another record is
   covered without looking at any text.
2. Extension: where an anchor recurs but regions differ (the ends of a match), each
   window of the region is compared by its own hash with those of the other regions
   of the same anchor. One occurrence stands for all equal regions, so no pairs are
   formed, whatever the number of copies; every step is a plain aggregation or an
   equi-join that AQE can split on a hot key.
3. Windows found are merged into maximal spans.

Equality is judged by a 64-bit anchor hash and a 64-bit text hash of another family
together. Results: null and short texts have no span, nor have rows without key; repeated rows of one key are
one record and share nothing with themselves; very long texts are cut into blocks
of windows, which changes no result; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.hashing import Sums
from papyrine.plans.session import cut_lineage

LENGTH = 300
#: Code points hashed at a time by a worker; bounds its memory, not the text.
BLOCK = 1 << 19
_LOW = np.uint64((1 << 24) - 1)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram of code points, from one running sum."""
    starts = np.arange(len(points) - k + 1)
    return Sums(points).spans(starts, starts + k)


def owners(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes, the place of the least one, the rightmost on a tie."""
    n = len(hashes)
    places = np.arange(n, dtype=np.uint64)
    keys = (hashes & ~_LOW) | (_LOW - (places & _LOW))
    rows = -(-n // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:n] = keys
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - w + 1], ahead[w - 1 : n])
    return (_LOW - (least & _LOW)).astype(np.int64)


def _blocks(texts: list[str | None], length: int) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (row, first window, text piece) of about BLOCK code points; pieces overlap by length - 1."""
    held, size = [], 0
    for row, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        for at in range(0, len(t) - length + 1, BLOCK):
            piece = t[at : at + BLOCK + length - 1]
            if size and size + len(piece) > BLOCK + length:
                yield held
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
    if held:
        yield held


def regions(texts: list[str | None], length: int = LENGTH) -> tuple[list[np.ndarray], ...]:
    """Row, first window, windows, anchor and region hash of each anchor's region."""
    k = length // 2
    w = length - k + 1
    found: list[list[np.ndarray]] = [[] for _ in range(5)]
    for block in _blocks(texts, length):
        joined = "".join(x[2] for x in block).encode("utf-32-le")
        points = np.frombuffer(joined, dtype=np.uint32)
        hashes = gram_hashes(points, k)
        own = owners(hashes, w)
        sizes = np.array([len(x[2]) for x in block])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        owner_of = np.repeat(np.arange(len(block)), sizes)[: len(own)]
        offset = np.arange(len(own)) - starts[owner_of]
        valid = offset <= sizes[owner_of] - length
        change = np.flatnonzero(valid & np.concatenate([[True], (own[1:] != own[:-1]) | ~valid[:-1] | (owner_of[1:] != owner_of[:-1])]))
        ends = np.concatenate([change[1:], [len(own)]])
        last_valid = (starts + sizes - length + 1)[owner_of[change]]
        n = np.minimum(ends, last_valid) - change
        view = memoryview(joined)
        digest = xxhash.xxh3_64_intdigest
        region = np.fromiter((digest(view[4 * a : 4 * (a + m - 1 + length)]) for a, m in zip(change.tolist(), n.tolist())), dtype=np.uint64, count=len(change))
        base = np.array([x[1] for x in block])
        rows = np.array([x[0] for x in block])
        for to, x in zip(found, (rows[owner_of[change]], offset[change] + base[owner_of[change]], n, hashes[own[change]].view(np.int64), region.view(np.int64))):
            to.append(x)
    return tuple(found)


def _seed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, n, anchor, region = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in regions(b.column(1).to_pylist(), length))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row.astype(np.int64))), pa.array(anchor), pa.array(region), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["id", "anchor", "region", "at", "n"],
            )

    return run


def _extend(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            ids, anchors, asks, ats, hashes = [], [], [], [], []
            for i, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                view = memoryview(text.encode("utf-32-le"))
                for x in wanted:
                    ids.append(i)
                    anchors.append(x["anchor"])
                    asks.append(x["ask"])
                    ats.append(x["at"])
                    hashes.append(np.fromiter((digest(view[4 * p : 4 * (p + length)]) for p in range(x["at"], x["at"] + x["n"])), dtype=np.uint64, count=x["n"]).view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, hashes)], dtype=np.int32))
            flat = pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), pa.array(anchors, pa.int64()), pa.array(asks, pa.bool_()), pa.array(ats, pa.int32()), pa.ListArray.from_arrays(ends, flat)],
                names=["id", "anchor", "ask", "at", "hashes"],
            )

    return run


def shared_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``key, span_start, span_end``: the maximal stretches of each text covered by windows that another record holds too."""
    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter((F.length("text") >= length) & F.col("id").isNotNull())
    seen = texts.mapInArrow(_seed(length), f"id {kind}, anchor bigint, region bigint, at int, n int")

    classes = seen.groupBy("anchor", "region").agg(F.min(F.struct("id", "at", "n")).alias("first"), F.max("id").alias("last"))
    classes = classes.withColumn("single", F.col("first.id") == F.col("last"))
    anchors = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("single").alias("open"))
    # a recurring anchor, or none: anchors of one region in one record end here
    known = cut_lineage(classes.join(anchors.filter("kinds > 1 OR NOT open"), "anchor"))

    # 1. every occurrence of a region that two records hold; those of single regions are asked about
    asked = seen.join(known.select("anchor", "region", "single"), ["anchor", "region"])
    asked = cut_lineage(asked.select("id", "anchor", "at", "n", "single"))
    whole = asked.filter(~F.col("single")).select("id", F.col("at").alias("lo"), (F.col("at") + F.col("n") - 1 + length).alias("hi"))

    # 2. ends of matches: windows against windows of the same anchor
    telling = known.filter(~F.col("single") & F.col("open")).select("first.id", "anchor", "first.at", "first.n", F.lit(False).alias("ask"))
    asking = asked.filter("single").select("id", "anchor", "at", "n", F.lit(True).alias("ask"))
    wanted = asking.unionByName(telling).groupBy("id").agg(F.collect_list(F.struct("anchor", "at", "n", "ask")).alias("wanted"))
    one = texts.join(wanted, "id").select("id", "text", "wanted")
    windows = cut_lineage(one.mapInArrow(_extend(length), f"id {kind}, anchor bigint, ask boolean, at int, hashes array<bigint>"))
    each = windows.select("id", "anchor", "ask", "at", F.posexplode("hashes").alias("step", "hash"))
    common = each.groupBy("anchor", "hash").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a <> z").select("anchor", "hash")
    parts = each.filter("ask").join(common, ["anchor", "hash"]).select("id", (F.col("at") + F.col("step")).alias("lo"), (F.col("at") + F.col("step") + length).alias("hi"))

    # 3. union of overlapping and adjoining windows, within one record
    order = Window.partitionBy("id").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = (reach.isNull() | (F.col("lo") > reach)).cast("int")
    runs = whole.unionByName(parts).withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("id", "run").agg(F.min("lo").alias("span_start"), F.max("hi").alias("span_end")).select(F.col("id").alias(key), "span_start", "span_end")


def shared_share(df: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, shared_chars, shared_share`` of every record; 0 where nothing is shared or the text is null."""
    own = df.groupBy(key).agg(F.coalesce(F.max(F.length(text)), F.lit(0)).cast("bigint").alias("n_chars"))
    got = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).cast("bigint").alias("shared_chars"))
    both = own.join(got, key, "left").na.fill(0, ["shared_chars"])
    return both.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
