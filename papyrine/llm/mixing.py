"""Mixing sources to target shares by Sainte-Laguë apportionment of token blocks.

The size of the mix is the largest at which every source that has tokens can
reach its share within ``max_repeats`` (or ``total_tokens``, if smaller). Shares of
sources without tokens go to the others in proportion, since no mix can hold
them; the report lists them with 0. Blocks of ``block_tokens`` are apportioned to
sources, then each source's quota to its shards, both by highest quotients
n / (2k + 1). In a shard the records, in an order seeded by a hash of their key,
form the blocks; the quota's blocks are taken whole, in whole records, and a
quota beyond one pass repeats every record first.

Defined results: a null source or key, a source without target, and records of 0 tokens
are not used; a null share counts as 0 and a null max_repeats as 1; a source
listed twice in the targets has its shares added and its repeats maximised; an
empty table gives an empty mix. Repeated keys are one record.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.tokenizing import count_tokens
from papyrine.plans.session import cut_lineage

#: More targets than this are refused: the apportionment to sources runs in the driver.
MOST_TARGETS = 100_000


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients w / (2k + 1), ties to the earlier entry, none beyond its cap.

    The divisor is found by bisection, so the work does not grow with ``seats``.
    """
    import heapq

    n = len(weights)
    caps = [seats] * n if caps is None else caps
    seats = min(seats, sum(c for w, c in zip(weights, caps) if w > 0))
    w = [Fraction(x) if x > 0 else Fraction(0) for x in weights]
    if not seats or not any(w):
        return [0] * n
    unit = math.lcm(*{x.denominator for x in w})
    whole = [x.numerator * (unit // x.denominator) for x in w]  # the weights as whole numbers of 1 / unit

    def given(price: Fraction) -> list[int]:  # quotients above the price
        num, den = price.numerator * unit, price.denominator
        return [min(c, max(0, -((num - x * den) // (2 * num)))) if x else 0 for x, c in zip(whole, caps)]

    low, high = min(x for x in w if x) / (4 * seats + 4), max(w) * 2
    for _ in range(200):
        mid = (low + high) / 2
        got = sum(given(mid))
        if got > seats:
            low = mid
        else:
            high = mid
            if seats - got <= n:
                break
        mid = mid.limit_denominator(10**30)
    seatsof = given(high)
    left = seats - sum(seatsof)
    heap = [(-w[i] / (2 * seatsof[i] + 1), i) for i in range(n) if w[i] and seatsof[i] < caps[i]]
    heapq.heapify(heap)
    while left and heap:
        _, i = heapq.heappop(heap)
        seatsof[i] += 1
        left -= 1
        if seatsof[i] < caps[i]:
            heapq.heappush(heap, (-w[i] / (2 * seatsof[i] + 1), i))
    return [int(x) for x in seatsof]


def plan_quotas(targets: list[tuple[str, float, int, int]], block_tokens: int, total_tokens: int | None = None) -> dict[str, int]:
    """Blocks of each source, from (source, share, max_repeats, tokens)."""
    live = [t for t in targets if t[1] > 0 and t[3] > 0 and t[2] > 0]
    whole = sum(t[1] for t in live)
    if not live:
        return {}
    total = min(t[3] * t[2] / (t[1] / whole) for t in live)
    total = min(total, total_tokens) if total_tokens is not None else total
    caps = [-(-t[3] * t[2] // block_tokens) for t in live]
    return dict(zip([t[0] for t in live], sainte_lague([t[1] for t in live], int(total // block_tokens), caps)))


def sizes(documents: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens`` of each record, materialised once: both the totals and the selection read it."""
    counted = count_tokens(documents.filter(F.col("source").isNotNull() & F.col("doc_id").isNotNull()), ["doc_id", "source"])
    return cut_lineage(counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")).filter("n_tokens > 0"))


def _targets(mix_targets: DataFrame) -> DataFrame:
    t = mix_targets.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    return t.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def mix(sized: DataFrame, mix_targets: DataFrame, block_tokens: int = 256, shard_tokens: int = 1 << 26, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """``doc_id, source, shard, block, copy, n_tokens``: one row per use of a record."""
    spark = sized.sparkSession
    targets = _targets(mix_targets)
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    known = targets.join(totals, "source", "left").limit(MOST_TARGETS + 1).collect()
    if len(known) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} sources in the targets")
    rows = sorted((r.source, r.target_share, r.max_repeats, r.tokens or 0) for r in known)
    quotas = plan_quotas(rows, block_tokens, total_tokens)
    plan = spark.createDataFrame([(s, int(q), int(m)) for s, _, m, _ in rows if (q := quotas.get(s, 0))], "source string, quota bigint, repeats int")
    shards = max(1, -(-sum(r[3] for r in rows) // shard_tokens))

    own = sized.join(F.broadcast(plan), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)).cast("int"))
    per = own.groupBy("source", "shard").agg(F.sum("n_tokens").alias("held"), F.first("quota").alias("quota"), F.first("repeats").alias("repeats"))

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        caps = [int(-(-h * r // block_tokens)) for h, r in zip(pdf.held, pdf.repeats)]
        return pdf.assign(blocks=sainte_lague(pdf.held.tolist(), int(pdf.quota.iloc[0]), caps))[["source", "shard", "held", "blocks", "repeats"]]

    quota = per.groupBy("source").applyInPandas(spread, "source string, shard int, held bigint, blocks bigint, repeats int")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = own.select("doc_id", "source", "shard", "n_tokens").join(quota, ["source", "shard"]).withColumn("before", F.coalesce(before, F.lit(0)))
    wanted = F.col("blocks") * block_tokens
    passes = F.floor(wanted / F.col("held"))
    more = (F.col("before") + F.col("n_tokens") / 2 <= wanted - passes * F.col("held")).cast("int")
    used = placed.withColumn("copies", F.least(passes + more, F.col("repeats")).cast("int")).filter("copies > 0")
    return used.select("doc_id", "source", "shard", F.floor(F.col("before") / block_tokens).alias("block"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "n_tokens")


def shares(mixed: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """``source, target_share, reached_share, tokens, uses, most_copies`` of every target."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("copy").alias("most_copies"))
    joined = _targets(mix_targets).join(got, "source", "left").na.fill(0, ["tokens", "uses", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per target, at most MOST_TARGETS
    share = F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0)
    return joined.select("source", "target_share", share.alias("reached_share"), "tokens", "uses", "most_copies")
