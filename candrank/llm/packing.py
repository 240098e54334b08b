"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Documents become token ids (with an end id) and are cut into pieces of at most ``capacity``
only where they are longer. Pieces are dealt to regions of bounded size. A region is evolved
by several islands: an individual is a list of whole bins; a crossover injects the best-filled
bins of one parent into the other, drops the bins that hold the same pieces again, and
best-fits the displaced pieces. Between epochs the islands of a region send their best
individual to the next island. What the best individual of a region fills well is final; the
pieces of its other bins are dealt anew to regions of the next round, until one region is left
or a round leaves more than ``STALLED`` of its pieces. Pieces are dealt by a number of the row, so
any number of equal rows fills no region.

Defined results: a null or empty text is one piece of the end id; repeated rows are packed
as rows of their own; null ids stay null; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank.llm.common import blocks_for, trimmed, written
from candrank.llm.tokens import WordPieces

CAPACITY = 2048
REGION = 4_096
ISLANDS = 2
EPOCHS = 2
INDIVIDUALS = 4
FILLED = 0.998
STALLED = 0.9
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordPieces(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            # The row of each piece, and its numbers.
            rows: list[int] = []
            numbers: list[tuple[int, int, int, int]] = []
            for row, text in enumerate(batch.column(1)):
                ids = words.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    own = ids[4 * at : 4 * min(n, at + capacity)]
                    rows.append(row)
                    numbers.append((k, at, len(own) // 4, zlib.crc32(own)))
            columns = np.array(numbers, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(columns[0].astype(np.int32)),
                    *(pa.array(np.ascontiguousarray(c)) for c in columns[1:]),
                ],
                names=_COLUMNS,
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(lambda batches: trimmed(cut(batches)), _PIECE)


def longest_first(lengths: list[int], items: list[int]) -> list[int]:
    return sorted(items, key=lambda i: -lengths[i])


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], capacity: int) -> None:
    """Put each item, in this order, where it leaves the least room; else open a bin."""
    room = []
    for b, held in enumerate(bins):
        left = capacity - sum(lengths[i] for i in held)
        if left:
            room.append((left, b))
    room.sort()
    for i in items:
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        left -= lengths[i]
        if left:
            insort(room, (left, b))


def fitness(lengths: list[int], bins: list[list[int]], capacity: int) -> float:
    """Mean squared fill; higher for fewer bins and, among those, for fuller ones."""
    return sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(
    lengths: list[int],
    mother: list[list[int]],
    father: list[list[int]],
    capacity: int,
    rng: random.Random,
) -> list[list[int]]:
    """The mother's bins with a share of the father's best-filled ones injected whole."""
    ranked = sorted(father, key=lambda b: -sum(lengths[i] for i in b))
    share = rng.uniform(0.2, 0.6)
    injected = ranked[: max(1, int(share * len(ranked)))]
    inside = {i for b in injected for i in b}
    child, displaced = [list(b) for b in injected], []
    for b in mother:
        if inside.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    best_fit(lengths, longest_first(lengths, displaced), child, capacity)
    return child


def mutated(
    lengths: list[int], bins: list[list[int]], capacity: int, rng: random.Random
) -> list[list[int]]:
    """The worst-filled bins and a few others dissolved and fitted again."""
    ranked = sorted(bins, key=lambda b: -sum(lengths[i] for i in b))
    cut = max(0, len(ranked) - max(2, len(ranked) // 20))
    child, loose = [list(b) for b in ranked[:cut]], [i for b in ranked[cut:] for i in b]
    for _ in range(min(3, len(child) - 1)):
        loose += child.pop(rng.randrange(len(child)))
    best_fit(lengths, longest_first(lengths, loose), child, capacity)
    return child


def evolve(
    lengths: list[int],
    elites: list[list[list[int]]],
    capacity: int,
    seed: int,
    individuals: int = INDIVIDUALS,
) -> list[list[int]]:
    """The best of a population that starts from the elites, after a generation each."""
    rng = random.Random(seed)
    population = [[list(b) for b in e] for e in elites]
    while len(population) < individuals:
        # The first by length alone, the others by lengths with noise.
        noise = 0.0 if not population else rng.uniform(0.02, 0.15)
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i] * (1 - noise * rng.random()))
        bins: list[list[int]] = []
        best_fit(lengths, order, bins, capacity)
        population.append(bins)
    score = [fitness(lengths, p, capacity) for p in population]
    for _ in range(individuals):
        a, b = rng.sample(range(len(population)), 2)
        child = mutated(
            lengths, crossover(lengths, population[a], population[b], capacity, rng), capacity, rng
        )
        got = fitness(lengths, child, capacity)
        worst = min(range(len(score)), key=score.__getitem__)
        if got > score[worst]:
            population[worst], score[worst] = child, got
    return population[max(range(len(score)), key=score.__getitem__)]


def _flat(bins: list[list[int]], n: int) -> np.ndarray:
    """The bin of each piece."""
    found = np.zeros(n, np.int32)
    for b, held in enumerate(bins):
        found[held] = b
    return found


def _bins(found: np.ndarray) -> list[list[int]]:
    order = np.argsort(found, kind="stable")
    cuts = np.flatnonzero(np.diff(found[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(found) else []


_ISLAND = "region long, island int, pieces binary, elite binary"
_RECORD = np.dtype(
    [("doc_id", "i8"), ("null", "u1"), ("piece", "i4"), ("start", "i8"), ("length", "i8"), ("crc", "u4")]
)


def dealt(rows: DataFrame, regions: int, level: int) -> DataFrame:
    """``rows`` of a written table with ``region``: equally many each, whatever they hold."""
    number = F.monotonically_increasing_id()
    return rows.withColumn("region", F.pmod(F.xxhash64(number, F.lit(level)), F.lit(regions)))


def _pack_round(rows: DataFrame, n: int, wide: int, level: int, capacity: int) -> DataFrame:
    """Rows with ``bin`` and ``filled`` (the tokens in that bin), by region."""
    regions = blocks_for(n, wide)

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        """A region as one row for each of its islands, with a first elite each."""
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=False)
        held = np.zeros(len(pdf), _RECORD)
        held["doc_id"], held["null"] = pdf["doc_id"].fillna(0).astype("int64"), pdf["doc_id"].isna()
        held["piece"], held["start"] = pdf["piece"], pdf["start"]
        held["length"], held["crc"] = pdf["length"], pdf["ids_crc32"]
        lengths, region = held["length"].tolist(), int(pdf["region"].iloc[0])
        rows = []
        for island in range(ISLANDS):
            best = evolve(lengths, [], capacity, hash((region, island, level)))
            rows.append((region, island, held.tobytes(), _flat(best, len(held)).tobytes()))
        return pd.DataFrame(rows, columns=["region", "island", "pieces", "elite"])

    def migrate(epoch: int):
        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            """Each island goes on from its own elite and that of the island before it."""
            pdf = pdf.sort_values("island")
            held = np.frombuffer(pdf["pieces"].iloc[0], _RECORD)
            lengths = held["length"].tolist()
            elites = [_bins(np.frombuffer(e, np.int32)) for e in pdf["elite"]]
            region, out = int(pdf["region"].iloc[0]), []
            for island in range(len(elites)):
                best = evolve(
                    lengths,
                    [elites[island], elites[island - 1]],
                    capacity,
                    hash((region, island, level, epoch)),
                )
                out.append(_flat(best, len(held)).tobytes())
            return pdf.assign(elite=out)

        return step

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        """The fittest island's bins, as rows."""
        held = np.frombuffer(pdf["pieces"].iloc[0], _RECORD)
        lengths = held["length"].tolist()
        islands = [_bins(np.frombuffer(e, np.int32)) for e in pdf.sort_values("island")["elite"]]
        bins = max(islands, key=lambda b: fitness(lengths, b, capacity))
        number, offset = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        filled, region = np.zeros(len(held), np.int64), int(pdf["region"].iloc[0])
        for b, own in enumerate(bins):
            ends = np.cumsum(held["length"][own])
            number[own], filled[own] = b, ends[-1]
            offset[own] = ends - held["length"][own]
        return pd.DataFrame(
            {
                "doc_id": pd.Series(held["doc_id"]).astype("Int64").mask(held["null"] == 1),
                "piece": held["piece"],
                "start": held["start"],
                "length": held["length"],
                "ids_crc32": held["crc"].astype("int64"),
                "sequence_id": (level << 56) + (region << 16) + number,
                "offset": offset,
                "filled": filled,
            }
        )

    islands = dealt(rows, regions, level).groupBy("region").applyInPandas(found, _ISLAND)
    for epoch in range(1, EPOCHS):
        islands = islands.groupBy("region").applyInPandas(migrate(epoch), _ISLAND)
    return islands.groupBy("region").applyInPandas(
        best, _PIECE + ", sequence_id long, offset long, filled long"
    )


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    region: int = REGION,
) -> DataFrame:
    """One row per piece with its sequence_id and its offset there."""
    cut = written(pieces(docs, vocabulary, capacity, end_id), "pieces")
    left, done, level, before = cut, None, 1, None
    while True:
        n = left.count()
        if done is not None and n == 0:
            break
        packed = written(_pack_round(left, n, region, level, capacity), "packed")
        last = n <= region or (before is not None and n > STALLED * before)
        final = packed if last else packed.filter(F.col("filled") >= FILLED * capacity)
        done = final if done is None else done.unionByName(final)
        if last:
            break
        before, level = n, level + 1
        left = packed.filter(F.col("filled") < FILLED * capacity).select(*_COLUMNS)
    return done.drop("filled")
