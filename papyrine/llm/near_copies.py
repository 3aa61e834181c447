"""Near copies of records with small edits, insertions or reordering.

Similarity is the share of all different word trigrams of two records that both hold.

Records of equal trigram sets are one representative; all that follows is done on these.

1. Candidates: of each record the ``SAMPLE`` trigrams of least hash. Records of
   similarity 0.5 share half of these on average, never (4 standard deviations of a
   draw without return) fewer than ``shared_least``; so each needs only its rarest
   ones, up to the last of which such a partner must hold one (prefix filter). The
   trigrams left out are the commonest. Trigrams of one record end here. Records that
   still need a trigram of more than ``REFINED`` records, since a site's furniture is a
   large part of them, are asked again among themselves with all their trigrams, where
   the rarer half, plus one, must hold a shared one without any doubt.
2. Bit-sliced comparison: the records of one trigram lie in blocks, sorted, each with
   ``BITS`` one-bit min-hashes. Plane b holds bit b of all records of a block; a plane
   XOR itself shifted by o compares every record with the o-th after it at once.
   Differences are added by carry-save adders into bit-sliced counters, and an offset
   is abandoned once every counter of the block exceeds the radius. Large trigram
   groups are divided into pairs of sub-blocks on several tasks, losing no pair.
3. Exact check of the pairs left, on their whole trigram sets.

Results: a null content is no record, nor is one without key (keys are integers); a record of fewer than 50 words is in no pair;
repeated keys are one record; an empty table gives no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.hashing import Sums, alnum_table, mixed, points_of
from papyrine.plans.session import cut_lineage

SHINGLE = 3
LEAST_WORDS = 50
SIMILARITY = 0.5
SAMPLE = 64
BITS = 256
#: A sampled trigram that more records need is not compared for; those records are asked again with all their trigrams.
REFINED = 32
#: Records of a sub-block; a trigram with more records is divided.
SUB_BLOCK = 1024
#: Ids of representatives and of records to be checked are broadcast up to this many (8 and 24 bytes each), joined by shuffle beyond.
BROADCAST_IDS = 500_000


def shared_least(k: int, size: int, similarity: float = SIMILARITY) -> int:
    """Trigrams that the samples of a record of ``size`` trigrams, ``k`` of them sampled, and of a similar one share at least, four standard deviations below the mean.

    The larger of the two has at most size / similarity trigrams; its sample is a draw from these without return.
    """
    most = size / similarity
    spread = math.sqrt(k * similarity * (1 - similarity) * max(0.0, most - k) / max(1.0, most - 1))
    return max(1, math.floor(k * similarity - 4 * spread))


def radius(similarity: float = SIMILARITY) -> int:
    """Bits in which the sketches of such records differ at most, four standard deviations above the mean."""
    p = (1 - similarity) / 2
    return math.ceil(BITS * p + 4 * math.sqrt(BITS * p * (1 - p)))


def word_grams(texts: list[str], shingle: int = SHINGLE, least_words: int = LEAST_WORDS) -> list[np.ndarray | None]:
    """Sorted hashes of the different word n-grams of each text; None for texts of too few words."""
    points = points_of("\n".join(t.lower() for t in texts) + "\n")
    inside = alnum_table()[points]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = Sums(points).spans(start, end)
    bounds = np.searchsorted(start, np.cumsum([len(t.lower()) + 1 for t in texts]))
    out: list[np.ndarray | None] = []
    at = 0
    for to in bounds.tolist():
        w = words[at:to]
        at = to
        if len(w) < max(least_words, shingle):
            out.append(None)
            continue
        g = w[: len(w) - shingle + 1].copy()
        for j in range(1, shingle):
            g = mixed(g * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - shingle + 1 + j])
        out.append(np.unique(g))
    return out


def sketch(grams: np.ndarray) -> bytes:
    """``BITS`` one-bit min-hashes."""
    k = np.arange(1, BITS + 1, dtype=np.uint64)
    factors = (mixed(k * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)).astype(np.uint32)
    low = (grams >> np.uint64(16)).astype(np.uint32) ^ grams.astype(np.uint32)
    products = np.multiply.outer(factors, low)
    least = products.min(axis=1)
    return np.packbits(((least ^ (least >> np.uint32(7)) ^ (least >> np.uint32(13))) & np.uint32(1)).astype(bool)).tobytes()


def planes(sketches: list[bytes]) -> list[int]:
    """Bit planes: integer b holds bit b of every sketch, the first record lowest."""
    grid = np.unpackbits(np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1), axis=1)
    packed = np.packbits(np.ascontiguousarray(grid.T), axis=1, bitorder="little")
    return [int.from_bytes(r.tobytes(), "little") for r in packed]


def within(slices: list[int], offset: int, lanes: int, limit: int) -> int:
    """Of the lanes, those whose record differs from the one ``offset`` later in at most ``limit`` bits."""
    counters: list[int] = []  # counters[j] holds bit j of each lane's count
    live = lanes
    for done, p in enumerate(slices, 1):
        carry = (p ^ (p >> offset)) & live
        j = 0
        while carry:
            if j == len(counters):
                counters.append(0)
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
            j += 1
        if done % 32 == 0:
            live &= ~above(counters, limit)
            if not live:
                return 0
    return live & ~above(counters, limit)


def above(counters: list[int], limit: int) -> int:
    """Lanes whose bit-sliced count exceeds ``limit``."""
    more, equal = 0, -1
    for j in range(max(len(counters), limit.bit_length()) - 1, -1, -1):
        c = counters[j] if j < len(counters) else 0
        if limit >> j & 1:
            equal &= c
        else:
            more |= equal & c
            equal &= ~c
    return more


def close_pairs(groups: list, sketches: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Positions of records of one group, of a block sorted by group, that are within the limit."""
    slices = planes(sketches)
    n = len(groups)
    ends = np.searchsorted(np.flatnonzero([a != b for a, b in zip(groups, groups[1:])]), np.arange(n))
    last = np.concatenate([np.flatnonzero([a != b for a, b in zip(groups, groups[1:])]), [n - 1]])[ends]
    room = last - np.arange(n)  # records of the same group that follow
    for offset in range(1, int(room.max()) + 1):
        lanes = int.from_bytes(np.packbits(room >= offset, bitorder="little").tobytes(), "little")
        hit = within(slices, offset, lanes, limit)
        while hit:
            low = hit & -hit
            i = low.bit_length() - 1
            yield i, i + offset
            hit ^= low


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, sample, sketches, sets, prefix = [], [], [], [], []
        for i, g in enumerate(word_grams(b.column(1).to_pylist()) if b.num_rows else []):
            if g is not None:
                keep.append(i)
                order = mixed(g ^ np.uint64(0x5851F42D4C957F2D))
                sample.append((np.sort(order)[:SAMPLE] if len(g) > SAMPLE else order).view(np.int64))
                sketches.append(sketch(g))
                sets.append(xxhash.xxh3_128_digest(g.tobytes()))
                prefix.append(len(sample[-1]) - shared_least(len(sample[-1]), len(g)) + 1)
        ends = pa.array(np.cumsum([0, *map(len, sample)], dtype=np.int32))
        flat = pa.array(np.concatenate(sample) if sample else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary()), pa.array(prefix, pa.int32()), pa.ListArray.from_arrays(ends, flat), pa.array(sketches, pa.binary())], names=["id", "set", "prefix", "sample", "sketch"]
        )


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [(i, g.view(np.int64)) for i, g in enumerate(word_grams(b.column(1).to_pylist()) if b.num_rows else []) if g is not None]
        ends = pa.array(np.cumsum([0, *(len(g) for _, g in got)], dtype=np.int32))
        flat = pa.array(np.concatenate([g for _, g in got]) if got else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in got], pa.int64())), pa.ListArray.from_arrays(ends, flat)], names=["id", "grams"])


def _compare(limit: int, most: int = 8192):
    def done(groups: list, ids: list, sketches: list) -> pa.RecordBatch:
        pairs = [(ids[i], ids[j]) for i, j in close_pairs(groups, sketches, limit)] if len(ids) > 1 else []
        found = np.unique(np.sort(np.array([p for p in pairs if p[0] != p[1]], dtype=np.int64).reshape(-1, 2), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list = []
        ids: list = []
        sketches: list = []
        for b in batches:
            for g, i, s in zip(zip(*(b.column(k).to_pylist() for k in range(3))), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if len(groups) >= most and g != groups[-1]:
                    yield done(groups, ids, sketches)
                    groups, ids, sketches = [], [], []
                groups.append(g)
                ids.append(i)
                sketches.append(s)
        if groups:
            yield done(groups, ids, sketches)

    return run


def _own(df: DataFrame, key: str, title: str, text: str) -> DataFrame:
    return df.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.col(text)).alias("text"))


def _small(ids: DataFrame) -> DataFrame:
    """Broadcast if it has at most ``BROADCAST_IDS`` rows, or else joined by shuffle."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _rarest(each: DataFrame, sizes: DataFrame) -> DataFrame:
    """``id, gram``: of ``id, gram`` the rarest that another record has too, up to the ``prefix`` of ``id, prefix, k``."""
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    mine = each.join(counts, "gram").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("n", "gram"))).alias("grams")).join(sizes, "id")
    # grams of one record come first in the order by rarity and use up the prefix
    free = F.col("prefix") - (F.col("k") - F.size("grams"))
    return mine.filter(free > 0).select("id", F.explode(F.slice("grams", F.lit(1), free)).alias("x")).select("id", F.col("x.gram").alias("gram"))


def _placed(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``gram, i, j, id``: the members of groups in pairs of sub-blocks; groups of the same members are taken once."""
    once = groups.groupBy("n", "members").agg(F.min("gram").alias("gram"))
    parts = F.ceil(F.col("n") / SUB_BLOCK).cast("int")
    placed = kept.join(once, "gram").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return placed.select("gram", "id", "part", others.alias("other")).select("gram", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id")


def _groups(kept: DataFrame) -> DataFrame:
    return kept.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")).filter("n > 1")


def candidate_blocks(features: DataFrame, own: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``gram, i, j, id, sketch``: representatives that hold a trigram both need, in pairs of sub-blocks."""
    kind = own.schema["id"].dataType.simpleString()
    kept = cut_lineage(_rarest(features.select("id", F.explode("sample").alias("gram")), features.select("id", "prefix", F.size("sample").alias("k")).distinct()))
    groups = cut_lineage(_groups(kept))
    placed = _placed(kept, groups.filter(F.col("n") <= REFINED))
    # a pair that shares only trigrams of large groups is in them with both records: these are asked again with all their trigrams
    crowded = cut_lineage(kept.join(groups.filter(F.col("n") > REFINED).select("gram"), "gram").select("id").distinct())
    whole = cut_lineage(own.join(_small(crowded), "id", "left_semi").mapInArrow(_grams, f"id {kind}, grams array<bigint>").dropDuplicates(["id"]))
    prefix = F.size("grams") - F.ceil(F.size("grams") * F.lit(similarity)) + 1
    again = cut_lineage(_rarest(whole.select("id", F.explode("grams").alias("gram")), whole.select("id", prefix.alias("prefix"), F.size("grams").alias("k"))))
    placed = placed.unionByName(_placed(again, _groups(again)))
    return placed.join(features.select("id", "sketch").distinct(), "id").select("gram", "i", "j", "id", "sketch")


def similar_classes(df: DataFrame, key: str = "content_id", title: str = "title", text: str = "content", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """``id, class`` of every record, the class being the least key of equal trigram sets; and ``a, b, similarity`` of all pairs of classes at or above the similarity."""
    kind = df.schema[key].dataType.simpleString()
    own = _own(df, key, title, text)
    every = cut_lineage(own.mapInArrow(_sample, f"id {kind}, set binary, prefix int, sample array<bigint>, sketch binary"))
    least = every.groupBy("set").agg(F.min("id").alias("class"))
    classes = cut_lineage(every.select("id", "set").join(least, "set").groupBy("id").agg(F.min(F.struct("class", "set")).alias("x")).select("id", "x.*"))  # a key stored twice is one record
    members = classes.select("id", "class")
    kept = _small(classes.filter("id = class").select("id", "set"))
    features = every.join(kept, ["id", "set"], "left_semi")  # rows of one key are equal here

    # 1. candidates, 2. bit-sliced comparison
    blocks = candidate_blocks(features, own, similarity).repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j", "id")
    near = cut_lineage(blocks.mapInArrow(_compare(radius(similarity)), f"a {kind}, b {kind}").distinct())

    # 3. exact similarity
    ids = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    sets = own.join(_small(ids), "id", "left_semi").mapInArrow(_grams, f"id {kind}, grams array<bigint>").dropDuplicates(["id"])
    sets = cut_lineage(sets)
    both = near.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    value = shared / (F.size("ga") + F.size("gb") - shared)
    return members, both.select("a", "b", value.alias("similarity")).filter(F.col("similarity") >= similarity)


def similar_pairs(df: DataFrame, key: str = "content_id", title: str = "title", text: str = "content", similarity: float = SIMILARITY) -> DataFrame:
    """``a, b, similarity``: all pairs of different keys at or above the similarity, classes expanded."""
    members, pairs = similar_classes(df, key, title, text, similarity)
    pairs = cut_lineage(pairs)
    of = lambda side: members.select(F.col("class").alias(side), F.col("id").alias(f"id_{side}"))
    between = pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "similarity")
    inside = of("a").join(of("b"), F.col("a") == F.col("b")).filter("id_a < id_b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(1.0).alias("similarity"))
    return between.unionByName(inside)


def linked_classes(df: DataFrame, key: str = "content_id", title: str = "title", text: str = "content", similarity: float = SIMILARITY) -> DataFrame:
    """``id, class, links``: every record of enough words once, with its class of equal wording and the number of records similar to it, no pair expanded."""
    members, pairs = similar_classes(df, key, title, text, similarity)
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("class", "other")
    others = both.join(sizes.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("size").alias("others"))
    counted = sizes.join(others, "class", "left").select("class", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(counted, "class").select("id", "class", "links")
