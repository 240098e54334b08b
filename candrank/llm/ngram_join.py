"""Jaccard join of documents on their word n-grams by rare-first prefixes.

A document's set is its distinct word shingles; equal sets are one node. All shingles are
counted over all documents into a table of ``COUNTERS`` counters, whose size does not
depend on the corpus; the order of shingles is rarest counter first, then by hash. It is the same total order
for all sets, so prefixes lose no pair whatever the counters hold.

Two sets that are similar enough share a shingle of their prefixes. Nodes of a prefix shingle
are compared by length, by position (at the first shingle that two prefixes share, what is left
of the shorter rest must be enough) and by suffix (counts of the shingles between common pivots
bound the intersection). Pairs left are verified once each, on the full sets.

First all nodes of a shingle meet one hub, the set with the most copies. The links found give
classes. A shingle whose nodes are then in one class needs nothing more. Of the others, those with
up to ``SMALL`` nodes give their pairs between classes; the larger ones are dealt to blocks,
a task for each pair of blocks, where pairs between classes are filtered and verified in place
and a class is joined to another once. So no link between classes is missed and no group is
in one task or written out as all its pairs.

Defined results: no words: an empty set, linked with nothing, its own component; fewer words than a
shingle has: the whole sequence is one shingle; repeated rows share their node; a null doc_id takes
part but is never a component's id, so a component of null ids has a null id; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank.llm.common import FOLD, blocks_for, text_of, written
from candrank.llm.near_dedup import components
from candrank.plans.joins import fits

WORDS = 4
PERCENT = 85
#: Counters of shingles; a byte each where they are broadcast.
COUNTERS = 1 << 22
CHUNK = 1 << 16
#: Ranges between common pivots, counted per set.
CELLS = 32
#: Shingles of up to so many nodes give all their pairs between classes.
SMALL = 32
#: Nodes of a block.
BLOCK = 512
#: Pairs of a hub that one task verifies.
HUB = 4096
#: Words that are hashed together.
PART = 100_000
#: Prefix shingles of a bucket, and places of one shingle that each batch brings to its bucket.
ENTRIES = 250_000
HELD = 8
_SET = "doc_id long, digest binary, n_shingles int, prefix array<long>, cells array<smallint>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """64-bit hashes of words, of a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = found
        return found


class Grams:
    """Sorted distinct 64-bit hashes of the shingles of texts, many texts at a time."""

    def __init__(self, words: int = WORDS):
        self._n = words
        self._known = _Words()
        self._weights = np.random.default_rng(41).integers(1, 2**63, words, dtype=np.uint64) | np.uint64(1)

    def __call__(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        held: list[list[bytes]] = []
        size = 0
        for raw in texts:
            held.append((raw or b"").translate(FOLD).split())
            size += len(held[-1])
            if size >= PART:
                yield from self._hashed(held)
                held, size = [], 0
        yield from self._hashed(held)

    def _rolled(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of ``n`` words from each place on; a number of words is part of its hash."""
        total = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
        for i in range(n):
            total = _mixed(total + h[i : len(h) - n + 1 + i] * self._weights[i])
        return total

    def _hashed(self, held: list[list[bytes]]) -> Iterator[np.ndarray]:
        sizes = [len(words) for words in held]
        h = np.fromiter(map(self._known.__getitem__, chain.from_iterable(held)), np.uint64, sum(sizes))
        every = self._rolled(h, self._n) if len(h) >= self._n else h[:0]
        start = 0
        for size in sizes:
            if size >= self._n:
                own = np.sort(every[start : start + size - self._n + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            else:
                yield self._rolled(h[start : start + size], size) if size else h[:0]
            start += size


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else b""


# -- bounds, in whole numbers ---------------------------------------------------------------
def least_size(size, percent: int):
    """The smallest set that a set of this size can be linked with."""
    return -(-(size * percent) // 100)


def prefix_size(size, percent: int):
    return size - least_size(size, percent) + 1


def least_shared(total, percent: int):
    """Shingles that two sets of ``total`` shingles together must share."""
    return -(-(total * percent) // (100 + percent))


def _least_shared(a: str, b: str, percent: int) -> Column:
    return F.expr(f"(({a} + {b}) * {percent} + {99 + percent}) div {100 + percent}")


def _positioned(percent: int) -> Column:
    """Length and position leave a pair at a shingle that could be the first both share."""
    lengths = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    rest = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    return lengths & (rest >= _least_shared("size_a", "size_b", percent))


# -- counting and sets -----------------------------------------------------------------------
def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))


def _values(column: pa.Array) -> Iterator[bytes | None]:
    return (value.as_py() for value in column)


def levels(docs: DataFrame, words: int = WORDS, counters: int = COUNTERS) -> np.ndarray:
    """A byte per counter: the logarithm of how many documents' shingles fell on it."""
    chunk = min(CHUNK, counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, count = Grams(words), np.zeros(counters, np.uint32)
        for batch in batches:
            for own in grams(_values(batch.column(0))):
                # Shingles of one set are distinct, but some can share a counter.
                np.add.at(count, (own & np.uint64(counters - 1)).astype(np.int64), np.uint32(1))
        parts = [zlib.compress(count[at : at + chunk].tobytes(), 1) for at in range(0, counters, chunk)]
        used = [i for i in range(len(parts)) if count[i * chunk : (i + 1) * chunk].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([parts[i] for i in used], pa.binary())], names=["chunk", "counts"]
        )

    def summed(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(chunk, np.uint64)
        for table in tables:
            for value in _values(table.column("counts")):
                total += np.frombuffer(zlib.decompress(value), np.uint32)
        level = np.minimum(255, np.round(8 * np.log2(total + 1.0))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()])], names=["chunk", "level"]
        )

    counted = _texts(docs).select("text").mapInArrow(run, "chunk int, counts binary")
    out = np.zeros(counters, np.uint8)
    for row in counted.groupBy("chunk").applyInArrow(summed, "chunk int, level binary").collect():
        out[row.chunk * chunk : (row.chunk + 1) * chunk] = np.frombuffer(row.level, np.uint8)
    return out


def ordered(own: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The shingles rarest first, as numbers that sort that way: eight bits level, the rest hash."""
    rare = level[(own & np.uint64(len(level) - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((rare << np.uint64(56)) | (own >> np.uint64(8)))


def sets(docs: DataFrame, level: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, a digest of its set, the set's size, its prefix and its counts by range."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, table = Grams(words), shared.value
        for batch in batches:
            digests, sizes, prefixes, cells = [], [], [], []
            for own in grams(_values(batch.column(1))):
                digests.append(digest(own))
                sizes.append(len(own))
                cell = np.bincount((own >> np.uint64(59)).astype(np.int64), minlength=CELLS)
                cells.append(np.minimum(cell, 32_767).astype(np.int16))
                few = prefix_size(len(own), percent) if len(own) else 0
                prefixes.append(ordered(own, table)[:few].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(cells, pa.list_(pa.int16())),
                ],
                names=["doc_id", "digest", "n_shingles", "prefix", "cells"],
            )

    return _texts(docs).mapInArrow(run, _SET)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(n, own) of the wanted nodes (n, digest, first_id), made again from their texts."""
    wanted = written(wanted, "wanted")
    ids = wanted.select(F.col("first_id").alias("doc_id")).filter("doc_id is not null")
    # Ids of a measured size come to the texts; beyond it the texts are dealt by id.
    ids = F.broadcast(ids) if fits(ids) else ids
    texts = _texts(docs)
    read = texts.join(ids, "doc_id", "left_semi").union(texts.filter("doc_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(words)
        for batch in batches:
            own = list(grams(_values(batch.column(0))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([digest(x) for x in own], pa.binary()),
                    pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64())),
                ],
                names=["digest", "own"],
            )

    # An id can have other texts too, so sets are found by their digest; they move once.
    found = read.select("text").mapInArrow(run, "digest binary, own array<long>").dropDuplicates(["digest"])
    return found.join(wanted.select("digest", "n"), "digest").select("n", "own")


# -- prefix groups --------------------------------------------------------------------------
_FIELDS = (("gram", np.uint64), ("n", np.int64), ("size", np.int32), ("at", np.int32), ("copies", np.int32))


def _planes(values: np.ndarray) -> bytes:
    """Differences of neighbours, the bytes of equal weight together, which Spark compresses well."""
    apart = np.diff(values, prepend=values.dtype.type(0))
    return apart.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    apart = np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind).reshape(-1)
    return np.cumsum(apart, dtype=kind)


def prefix_groups(nodes: DataFrame, entries: int = ENTRIES, held: int = HELD) -> DataFrame:
    """(gram, n, size, at, copies): the places of prefix shingles that two nodes or more have.

    Places travel packed, by buckets of shingles. Of a shingle that is frequent in a batch only
    ``held`` places go to its bucket; they show that it is shared, so its further places are dealt
    by their nodes and need no bucket.
    """
    if held < 2:
        raise ValueError("one place does not show that a shingle is shared")
    total = nodes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    buckets = np.uint64(blocks_for(total, entries))
    names = [name for name, _ in _FIELDS]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, size, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            lists = batch.column(3)
            count = lists.value_lengths().to_numpy(zero_copy_only=False)
            gram = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(len(n)), count)
            at = np.arange(len(gram)) - np.repeat(np.cumsum(count) - count, count)
            order = np.argsort(gram, kind="stable")
            gram, owner, at = gram[order], owner[order], at[order]
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
            turn = np.arange(len(gram)) - np.repeat(first, np.diff(np.append(first, len(gram))))
            over = turn >= held
            to = (_mixed(np.where(over, n[owner].view(np.uint64), gram)) % buckets).astype(np.int64)
            order = np.lexsort((over, to))
            key = to[order] * 2 + over[order]
            ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
            columns = [gram, n[owner], size[owner].astype(np.int32), at.astype(np.int32), copies[owner].astype(np.int32)]
            columns = [c[order] for c in columns]
            out: list[list] = [[] for _ in range(2 + len(names))]
            start = 0
            for end in ends if len(key) else ():
                out[0].append(int(key[start]) // 2)
                out[1].append(bool(key[start] % 2))
                for into, c in zip(out[2:], columns, strict=True):
                    into.append(_planes(c[start:end]))
                start = int(end)
            kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * len(names)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["bucket", "over", *names]
            )

    def grouped(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in _FIELDS]
        for table in tables:
            over = table.column("over").to_pylist()
            packed = [table.column(name).to_pylist() for name in names]
            for i, further in enumerate(over):
                read = [_from_planes(p[i], kind) for p, (_, kind) in zip(packed, _FIELDS, strict=True)]
                if further:
                    yield _places(read)
                else:
                    for into, x in zip(parts, read, strict=True):
                        into.append(x)
        if parts[0]:
            columns = [np.concatenate(x) for x in parts]
            order = np.argsort(columns[0], kind="stable")
            gram = columns[0][order]
            same = gram[1:] == gram[:-1]
            shared = np.append(False, same) | np.append(same, False)
            yield _places([c[order][shared] for c in columns])

    packed = nodes.select("n", "size", F.least("copies", F.lit(2**31 - 1)).cast("int").alias("copies"), "prefix")
    fields = ", ".join(f"{name} binary" for name in names)
    return (
        packed.mapInArrow(pack, f"bucket long, over boolean, {fields}")
        .groupBy("bucket")
        .applyInArrow(grouped, "gram long, n long, size int, at int, copies int")
    )


def _places(columns: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in _FIELDS])


# -- pairs --------------------------------------------------------------------------------
def _suffixed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b, least) that the counts between pivots leave."""
    a, b = (
        nodes.select(F.col("n").alias(s), F.col("size").alias(f"size_{s}"), F.col("cells").alias(f"cells_{s}"))
        for s in "ab"
    )
    apart = sum(F.abs(F.col("cells_a")[i].cast("int") - F.col("cells_b")[i].cast("int")) for i in range(CELLS))
    least = _least_shared("size_a", "size_b", percent)
    left = pairs.join(a, "a").join(b, "b").withColumn("least", least)
    return left.filter(apart <= F.col("size_a") + F.col("size_b") - 2 * F.col("least")).select("a", "b", "least")


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets share ``least``; a hub ``a`` is dealt to several tasks."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("parts"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    hubs = parts.join(whole.withColumnRenamed("n", "a"), "a").select("a", part, F.col("own").alias("own_a"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    return (
        dealt.join(whole.select(F.col("n").alias("b"), F.col("own").alias("own_b")), "b")
        .join(hubs, ["a", "part"])
        .filter(F.size(F.array_intersect("own_a", "own_b")) >= F.col("least"))
        .select("a", "b")
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("n")).union(pairs.select("b"))


def _across(large: DataFrame, nodes: DataFrame, whole: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between classes within large prefix groups (gram, k, n, size, at, c)."""
    blocks = F.ceil(F.col("k") / block).cast("int")
    home = F.pmod(F.xxhash64("n"), blocks).cast("int")
    ids = written(large.select("n").distinct(), "large-nodes")
    ids = F.broadcast(ids) if fits(ids) else ids
    nodes, whole = nodes.join(ids, "n", "left_semi"), whole.join(ids, "n", "left_semi")
    met = (
        large.withColumns({"home": home, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        .withColumns({"x": F.least("home", "other"), "y": F.greatest("home", "other")})
        .select("gram", "x", "y", "home", "n", "c", "size", "at")
        .join(nodes.select("n", "prefix", "cells"), "n")
        .join(whole, "n")
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        n, size, at = (pdf[c].to_numpy() for c in ("n", "size", "at"))
        names, c = np.unique(pdf["c"].to_numpy(), return_inverse=True)
        root = np.arange(len(names))
        # Within a block all pairs, between two blocks those with an end in either.
        home, within = pdf["home"].to_numpy(), pdf["x"].iloc[0] == pdf["y"].iloc[0]
        cells = np.stack(pdf["cells"].to_numpy()).astype(np.int32)
        prefix, own = pdf["prefix"].to_numpy(), pdf["own"].to_numpy()

        def index(lists):
            flat, owner = np.concatenate(lists), np.repeat(np.arange(len(n)), [len(x) for x in lists])
            order = np.argsort(flat, kind="stable")
            return flat[order], owner[order]

        def holders(flat, owner, wanted):
            low, high = np.searchsorted(flat, wanted), np.searchsorted(flat, wanted, "right")
            count = high - low
            place = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
            return owner[place]

        prefixes, wholes, found = index(prefix), None, []
        most = np.bincount(c).argmax()
        for i in range(len(n)):
            if c[i] == most and (c[i + 1 :] == most).all():
                continue
            left = (root[c] != root[c[i]]) & (np.arange(len(n)) > i)
            if not within:
                left &= home != home[i]
            left &= np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * percent
            least = least_shared(size + size[i], percent)
            left &= np.minimum(size - at, size[i] - at[i]) >= least
            if not left.any():
                continue
            # A pair is looked at where its prefixes share their first shingle, so once.
            left[holders(*prefixes, prefix[i][: at[i]])] = False
            near = np.flatnonzero(left)
            near = near[np.abs(cells[near] - cells[i]).sum(axis=1) <= size[near] + size[i] - 2 * least[near]]
            if not len(near):
                continue
            wholes = wholes or index(own)
            both = np.bincount(holders(*wholes, own[i]), minlength=len(n))
            for j in near[both[near] >= least[near]]:
                if root[c[i]] != root[c[j]]:
                    found.append((n[i], n[j]))
                    root[root == root[c[j]]] = root[c[i]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return met.groupBy("gram", "x", "y").applyInPandas(search, "a long, b long").distinct()


def join(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    small: int = SMALL,
    block: int = BLOCK,
    counters: int = COUNTERS,
    entries: int = ENTRIES,
) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    own = written(sets(docs, levels(docs, words, counters), words, percent), "gram-sets")
    # Numbers are given once, in what is written.
    nodes = written(
        own.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("size"),
            F.first("prefix").alias("prefix"),
            F.first("cells").alias("cells"),
        )
        .withColumn("n", F.monotonically_increasing_id()),
        "gram-nodes",
    )
    places = written(prefix_groups(nodes, entries), "prefix-places")
    # The hub's size, place and number come with the group.
    best = F.max_by(F.struct("n", "size", "at"), F.struct("copies", -F.col("n"))).alias("hub")
    groups = places.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), best)
    met = written(places.join(groups, "gram").select("gram", "k", "hub", "n", "size", "at"), "prefix-groups")
    star = (
        met.filter("n <> hub.n")
        .select(
            F.col("hub.n").alias("a"),
            F.col("n").alias("b"),
            F.col("hub.size").alias("size_a"),
            F.col("size").alias("size_b"),
            F.col("hub.at").alias("at_a"),
            F.col("at").alias("at_b"),
        )
        .filter(_positioned(percent))
        .select("a", "b")
        .distinct()
    )
    star = written(_suffixed(star, nodes, percent), "star")
    named = nodes.select("n", "digest", "first_id")
    first = written(full_sets(docs, named.join(_ends(star).distinct(), "n", "left_semi"), words), "star-sets")
    links = written(_verified(star, first), "star-links")
    labels = components(links)

    # Groups whose nodes are in several classes are looked at once more.
    classed = met.drop("hub").join(labels, "n", "left").withColumn("c", F.coalesce("c", "n"))
    mixed = classed.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
    open_ = written(classed.join(mixed.select("gram"), "gram", "left_semi"), "mixed-groups")
    few, large = open_.filter(F.col("k") <= small), open_.filter(F.col("k") > small)
    a, b = (few.select("gram", *[F.col(x).alias(f"{x}_{s}") for x in ("n", "size", "at", "c")]) for s in "ab")
    pairs = (
        a.join(b, "gram")
        .filter((F.col("n_a") < F.col("n_b")) & (F.col("c_a") != F.col("c_b")) & _positioned(percent))
        .select(F.col("n_a").alias("a"), F.col("n_b").alias("b"))
        .distinct()
    )
    pairs = written(_suffixed(pairs, nodes, percent), "pairs")
    ends = _ends(pairs).union(large.select("n")).distinct()
    whole = written(full_sets(docs, named.join(ends, "n", "left_semi"), words), "pair-sets")
    more = written(_verified(pairs, whole).union(_across(large, nodes, whole, percent, block)), "more-links")
    if more.limit(1).count():
        labels = components(links.union(more))

    to = written(
        nodes.join(labels, "n", "left").select("digest", "first_id", F.coalesce("c", "n").alias("c")), "classes"
    )
    ids = to.groupBy("c").agg(F.min("first_id").alias("component_id"))
    home = to.join(ids, "c").select("digest", "component_id")
    return own.select("doc_id", "digest", "n_shingles").join(home, "digest", "left").select(
        "doc_id",
        F.col("n_shingles").cast("long").alias("n_shingles"),
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
