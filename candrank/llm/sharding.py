"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Equal texts form a group that is not divided. A partial partition is a row of loads, one per
shard. Differencing takes the two partial partitions of the largest spread and adds them in
opposite order, until one is left. Blocks of groups are differenced in parallel; their
results are partial partitions themselves and are differenced again, so the number of
levels grows with the logarithm of the groups and no task holds more than a block.

Defined results: a null text has no bytes and forms a group with the empty texts; null and
repeated ids are rows like others; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candrank.llm.common import blocks_for, text_of, written

BLOCK_GROUPS = 20_000
BLOCK_PARTIALS = 1_024


def difference(states: list[list[int]]) -> list[list[int]]:
    """For each partial partition, the final slot of each of its slots."""
    k = len(states[0])
    loads, up, heap = [], [], []
    first = [sorted(range(k), key=lambda s, x=x: -x[s]) for x in states]
    for i, x in enumerate(states):
        loads.append([x[s] for s in first[i]])
        up.append(None)
        heap.append((loads[i][-1] - loads[i][0], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = [x + y for x, y in zip(loads[a], reversed(loads[b]), strict=True)]
        order = sorted(range(k), key=lambda p, both=both: -both[p])
        to = [0] * k
        for new, old in enumerate(order):
            to[old] = new
        c = len(loads)
        loads.append([both[p] for p in order])
        loads[a] = loads[b] = None
        up[a], up[b] = (c, to), (c, to[::-1])
        up.append(None)
        heapq.heappush(heap, (loads[c][-1] - loads[c][0], c))
    final = [None] * len(up)
    final[-1] = list(range(k))
    for i in range(len(up) - 2, -1, -1):
        parent, to = up[i]
        final[i] = [final[parent][t] for t in to]
    out = []
    for i, order in enumerate(first):
        slots = [0] * k
        for position, slot in enumerate(order):
            slots[slot] = final[i][position]
        out.append(slots)
    return out


def _groups_to_shards(
    groups: DataFrame, shards: int, block_groups: int, block_partials: int
) -> DataFrame:
    """(digest, shard) from (digest, weight)."""

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        slots = difference([[int(w)] + [0] * (shards - 1) for w in pdf["weight"]])
        return pdf.assign(slot=[s[0] for s in slots])

    def upper(pdf: pd.DataFrame) -> pd.DataFrame:
        states = {b: [0] * shards for b in sorted(set(pdf["block"]))}
        for b, s, w in zip(pdf["block"], pdf["slot"], pdf["weight"], strict=True):
            states[b][s] = int(w)
        slots = difference(list(states.values()))
        return pd.DataFrame(
            [
                (int(pdf["above"].iloc[0]), int(b), s, to[s], states[b][s])
                for b, to in zip(states, slots, strict=True)
                for s in range(shards)
            ],
            columns=["above", "block", "slot", "next", "weight"],
        )

    blocks = blocks_for(groups.count(), block_groups)
    dealt = written(
        groups.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(local, "digest binary, weight long, block long, slot int"),
        "partials",
    )
    loads = dealt.groupBy("block", "slot").agg(F.sum("weight").alias("weight"))
    placed = dealt.select("digest", "block", "slot")
    while True:
        blocks = blocks_for(blocks, block_partials)
        step = written(
            loads.withColumn("above", F.pmod("block", F.lit(blocks)))
            .groupBy("above")
            .applyInPandas(upper, "above long, block long, slot int, next int, weight long"),
            "partials",
        )
        placed = placed.join(step.select("block", "slot", "above", "next"), ["block", "slot"]).select(
            "digest", F.col("above").alias("block"), F.col("next").alias("slot")
        )
        if blocks == 1:
            return placed.select("digest", F.col("slot").alias("shard"))
        loads = step.groupBy(F.col("above").alias("block"), F.col("next").alias("slot")).agg(
            F.sum("weight").alias("weight")
        )


def numbered(rows: DataFrame, within: str, n: int, *order: str, each: int = 20_000) -> DataFrame:
    """``slot``: a gapless number from 0 within each value of ``within``.

    Rows are numbered in buckets; a bucket starts where the counts of those before it end, so
    that a value with most of the rows is not one task.
    """
    buckets = blocks_for(n, each, 256)
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    starts = (
        dealt.groupBy(within, "__b")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            F.col(within).alias("__w"),
            F.col("__b").alias("__c"),
            (
                F.sum("__n").over(Window.partitionBy(within).orderBy("__b")) - F.col("__n")
            ).alias("__at"),
        )
    )
    own = F.row_number().over(Window.partitionBy(within, "__b").orderBy(*order))
    return (
        dealt.withColumn("__own", own)
        .join(starts, F.col(within).eqNullSafe(F.col("__w")) & (F.col("__b") == F.col("__c")))
        .withColumn("slot", F.col("__at") + F.col("__own") - 1)
        .drop("__b", "__c", "__w", "__at", "__own")
    )


def shard(
    docs: DataFrame,
    shards: int = 16,
    block_groups: int = BLOCK_GROUPS,
    block_partials: int = BLOCK_PARTIALS,
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot; sizes of shards nearly equal."""
    text = text_of()
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        ),
        "sizes",
    )
    groups = rows.groupBy("digest").agg(F.sum("size").alias("weight"))
    placed = _groups_to_shards(groups, shards, block_groups, block_partials)
    dealt = rows.join(placed, "digest").drop("digest")
    return numbered(dealt, "shard", rows.count(), "doc_id", "text_crc32")
