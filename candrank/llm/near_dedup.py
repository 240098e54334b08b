"""Near-duplicates by odd sketches over MinHash samples, confirmed on full sets.

A document's set is its distinct word shingles. Equal sets are one node. MinHash samples of a
set give band keys; nodes that share a band key are candidates. The samples are folded into a
parity bitmap, an odd sketch, whose XOR with another counts the samples in which two sets
differ; candidates whose estimate is far below the threshold go no further. The rest is
confirmed on the full sets.

Nodes of a band are linked as a star to its smallest node, and in bands of up to ``SMALL``
nodes as all pairs. A larger band whose nodes are then still in several components is looked at
again: the nodes outside its largest component meet all its other nodes, in blocks, and their
sketches and full sets are compared there until one link to each other component is found. So
no link between components is missed, and a band of copies costs one pair per copy.

Defined results: no words: an empty set, linked with nothing; repeated rows of a doc_id with the
same set are one node, and an id with texts of different sets is as many nodes; a null doc_id takes
part but is never a component's id, so a component of null ids has a null id and keeps its rows; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank.llm.common import FOLD, KEY_BYTES, rows_kept, trimmed, written
from candrank.plans.joins import fits

WORDS = 4
PERCENT = 80
BANDS, ROWS = 28, 4
#: Bits of an odd sketch; about half of the bits differ where a third of the samples do.
BITS = 512
#: Estimates of a similarity of 0.8 from 112 samples stay above this but once in 10^6.
LEAST_ESTIMATE = 0.58
#: Bands of up to so many nodes are taken as all pairs.
SMALL = 32
#: Nodes of a larger band that are in one task, besides those that look for links.
BLOCK = 512
_P = 0xFFFFFFFFFFFFFFC5
_SET = (
    "doc_id long, text_key binary, node binary, n_shingles long, bands array<long>, sketch array<long>"
)
#: Numbers of nodes whose documents have no id, or share theirs with another node, begin here.
NO_ID = 2**62


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int = WORDS):
        self._n = words
        self._known: dict[bytes, int] = {}
        rng = np.random.default_rng(20_240_601)
        self._weights = rng.integers(1, 2**63, words, dtype=np.uint64) | np.uint64(1)

    def _hash(self, word: bytes) -> int:
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 400_000:
                self._known.clear()
            found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            self._known[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(FOLD).split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self._hash, words), np.uint64, len(words))
        # A short text is one shingle; the number of its words keeps it from longer ones.
        n = min(self._n, len(h))
        total = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
        for i in range(n):
            total = _mixed(total + h[i : len(h) - n + 1 + i] * self._weights[i])
        return np.unique(total)


def samples(own: np.ndarray, k: int) -> np.ndarray:
    """The k MinHash samples of a set that is not empty."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(1, 2**63, k, dtype=np.uint64)
    least = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        part = own[at : at + 4096, None]
        least = np.minimum(least, ((part ^ b) * a).min(axis=0))
    return least


def odd_sketch(sampled: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The parity of the samples that fall on each bit."""
    place = _mixed(sampled + np.arange(len(sampled), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    odd = np.bincount((place % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else b""


def differing(k: int, percent: float, bits: int = BITS) -> int:
    """The most differing bits that an estimate of at least ``percent`` leaves."""
    return int(bits / 2 * (1 - np.exp(-4 * k * (1 - percent) / bits)))


def sets(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, text_key, a digest of its set, the set's size, band keys and odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingles(words)
        salt = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            out, keys_of_texts = [], []
            for value in batch.column(1):
                raw = (value.as_py() or "").encode().translate(FOLD)
                keys_of_texts.append(hashlib.sha256(raw).digest()[:KEY_BYTES])
                own = shingled(value.as_py())
                if not len(own):
                    out.append((b"", 0, [], []))
                    continue
                sampled = samples(own, bands * rows)
                key = salt.copy()
                for i in range(rows):
                    key = _mixed(key * np.uint64(_P) + sampled[i::rows])
                out.append(
                    (
                        digest(own),
                        len(own),
                        key.view(np.int64),
                        odd_sketch(sampled),
                    )
                )
            node, size, keys, sketch = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(keys_of_texts, pa.binary()),
                    pa.array(node, pa.binary()),
                    pa.array(size, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketch, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "node", "n_shingles", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: trimmed(run(batches)), _SET)


def _near(pairs: DataFrame, nodes: DataFrame, most: int, percent: int) -> DataFrame:
    """The pairs (a, b) of node numbers that sketches and sizes leave."""
    a, b = (
        nodes.select(
            F.col("n").alias(s), F.col("sketch").alias(f"s_{s}"), F.col("n_shingles").alias(f"n_{s}")
        )
        for s in "ab"
    )
    close = _differing_bits("s_a", "s_b") <= most
    # The smaller set must hold the share of the larger that the threshold asks for.
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.join(a, "a").join(b, "b").filter(sizes & close).select("a", "b", "n_a", "n_b")


def _full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(n, own): the full sets of the nodes wanted."""
    wanted = written(
        nodes.join(wanted.distinct(), "n", "left_semi").select("node", "n", "first_id"), "wanted"
    )

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingles(words)
        for batch in batches:
            own = [shingled(t.as_py()) for t in batch.column(0)]
            ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(x) for x in own], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["node", "own"],
            )

    text = docs.select(F.col("doc_id").cast("long").alias("first_id"), "text")
    first = wanted.select("first_id").filter("first_id is not null")
    # Ids of a measured size come to the texts; beyond it the texts are dealt by id.
    first = F.broadcast(first) if fits(first) else first
    read = text.join(first, "first_id", "left_semi").union(text.filter("first_id is null"))
    # A repeated id can have another text, so sets are found by their digest.
    return (
        read.select("text")
        .mapInArrow(lambda batches: trimmed(full(batches)), "node binary, own array<long>")
        .join(wanted.select("node", "n"), "node")
        .dropDuplicates(["n"])
        .select("n", "own")
    )


def _confirmed(near: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    return (
        near.join(whole.select(F.col("n").alias("a"), F.col("own").alias("own_a")), "a")
        .join(whole.select(F.col("n").alias("b"), F.col("own").alias("own_b")), "b")
        .withColumn("both", F.size(F.array_intersect("own_a", "own_b")))
        .filter(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent)
        .select("a", "b")
    )


def _differing_bits(left: str, right: str):
    """The population count of the XOR of two odd sketches."""
    return sum(
        F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(BITS // 64)
    )


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(n, c): the smallest node that each linked node reaches, by alternating stars."""
    edges = written(links.select("a", "b").distinct(), label)
    while True:
        # Large star: neighbours above a node meet the smallest node next to it.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = large.filter("a <> b").distinct()
        # Small star: neighbours below a node meet the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.select(F.col("b").alias("x"), "m")
            .union(joined.select(F.col("a"), "m"))
            .filter("x <> m")
            .distinct()
            .select(F.col("x").alias("a"), F.col("m").alias("b"))
        )
        after = written(small, label)
        # Stars are at rest when every node has one smaller neighbour that is a centre.
        loose = after.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").limit(1).count()
        inner = after.select("b").distinct().join(
            after.select(F.col("a").alias("b")).distinct(), "b", "left_semi"
        )
        if not loose and not inner.limit(1).count():
            return after.select(F.col("a").alias("n"), F.col("b").alias("c"))
        edges = after


def link(docs: DataFrame, **settings) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest reachable doc_id), kept."""
    return _linked(docs, **settings).select("doc_id", "n_shingles", "component_id", "kept")


def _measured(df: DataFrame) -> DataFrame:
    """``df`` as the small side of a join where its measured size allows it."""
    return F.broadcast(df) if fits(df) else df


def _linked(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    small: int = SMALL,
) -> DataFrame:
    """The columns of :func:`link`, the text_key and the number ``c`` of the component."""
    own = written(sets(docs, words, bands, rows), "sets")
    most = differing(bands * rows, LEAST_ESTIMATE)
    distinct = own.filter("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    # A node's number is the id of its first document; of the sets of one id only one has it.
    hashed = F.xxhash64("node")
    shared = (
        own.filter("n_shingles > 0 and doc_id is not null")
        .groupBy(F.col("doc_id").alias("first_id"))
        .agg(F.min(hashed).alias("named"), F.max(hashed).alias("other"))
        .filter("named <> other")
        .drop("other")
    )
    shared = _measured(written(shared, "shared"))
    unnamed = F.pmod(hashed, F.lit(NO_ID)) + F.lit(NO_ID)
    number = F.when(F.col("named").isNull() | (F.col("named") == hashed), F.col("first_id"))
    nodes = written(
        distinct.join(shared, "first_id", "left").withColumn("n", F.coalesce(number, unnamed)).drop("named"),
        "nodes",
    )
    banded = nodes.select("n", F.explode("bands").alias("band"))
    stars = banded.groupBy("band").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("size"))
    met = written(banded.join(stars.filter("size > 1"), "band"), "bands")
    star = met.filter("n <> first").select(F.col("first").alias("a"), F.col("n").alias("b"))
    few = met.filter(F.col("size") <= small).select("band", "n")
    pairs = (
        few.select("band", F.col("n").alias("a"))
        .join(few.select("band", F.col("n").alias("b")), "band")
        .filter("a < b")
        .select("a", "b")
    )
    near = written(_near(star.union(pairs).distinct(), nodes, most, percent), "near")
    large = met.filter(F.col("size") > small).select("band", "n", "size")
    wanted = near.select(F.col("a").alias("n")).union(near.select("b")).union(large.select("n"))
    whole = written(_full_sets(wanted, nodes, docs, words), "full")
    links = written(_confirmed(near, whole, percent), "links")
    labels = components(links)
    more = written(_across(large, labels, nodes, whole, most, percent), "across")
    if more.limit(1).count():
        labels = components(links.union(more))
    # The smallest id of a component can be that of a node with another number.
    odd = nodes.filter((F.col("n") >= NO_ID) & F.col("first_id").isNotNull()).select("n", "first_id")
    lower = (
        odd.join(labels, "n", "left")
        .groupBy(F.coalesce("c", "n").alias("c"))
        .agg(F.min("first_id").alias("low"))
    )
    lower = _measured(written(lower, "lower"))
    to = (
        nodes.join(labels, "n", "left")
        .select("node", F.coalesce("c", "n").alias("c"))
        .join(lower, "c", "left")
        .select("node", "c", F.least(F.when(F.col("c") < NO_ID, F.col("c")), "low").alias("id"))
    )
    return own.join(to, "node", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        "c",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _across(
    large: DataFrame, labels: DataFrame, nodes: DataFrame, whole: DataFrame, most: int, percent: int
) -> DataFrame:
    """Links between nodes of a band that are in different components.

    Only bands with several components are read. Their nodes are dealt to blocks; the nodes
    outside the band's largest component go to every block and look there for one link with
    each other component, the closest by sketch first.
    """
    named = large.join(labels, "n", "left").withColumn("c", F.coalesce("c", "n"))
    mixed = named.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y")
    counts = (
        named.join(mixed.select("band"), "band", "left_semi")
        .groupBy("band", "c")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    top = counts.groupBy("band").agg(F.max_by("c", F.struct("k", "c")).alias("top"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    home = F.pmod(F.xxhash64("n"), blocks).cast("int")
    held = (
        named.join(top, "band")
        .withColumn("seeks", F.col("c") != F.col("top"))
        .withColumn(
            "block",
            F.explode(F.when(F.col("seeks"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(home))),
        )
        .select("band", "block", "n", "c", "seeks")
        .join(nodes.select("n", "sketch"), "n")
        .join(whole, "n")
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = pdf["n"].to_numpy(), pdf["c"].to_numpy()
        sketch = np.stack(pdf["sketch"].to_numpy()).view(np.uint64)
        own, found, joined = pdf["own"].to_numpy(), [], set()
        for x in np.flatnonzero(pdf["seeks"].to_numpy()):
            apart = np.bitwise_count(sketch ^ sketch[x]).sum(axis=1)
            near = np.flatnonzero((apart <= most) & (c != c[x]))
            for y in near[np.argsort(apart[near], kind="stable")]:
                pair = (min(c[x], c[y]), max(c[x], c[y]))
                if pair in joined:
                    continue
                both = len(np.intersect1d(own[x], own[y], assume_unique=True))
                if both * 100 >= (len(own[x]) + len(own[y]) - both) * percent:
                    joined.add(pair)
                    found.append((min(n[x], n[y]), max(n[x], n[y])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return held.groupBy("band", "block").applyInPandas(search, "a long, b long").distinct()


def without_near(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stay with their columns: one of each component with an id.

    Of components without an id, and of texts without words, one row of each id and text stays.
    """
    found = written(_linked(docs, **settings), "linked").filter("kept")
    texts = found.groupBy("doc_id", "text_key", "c").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("doc_id").isNotNull() & F.col("c").isNotNull()
    first = (
        texts.filter(named)
        .groupBy("doc_id", "c")
        .agg(F.min(F.struct("text_key", "n")).alias("one"))
        .select("doc_id", "one.*")
    )
    rest = texts.filter(~named).select("doc_id", "text_key", "n")
    return rows_kept(docs, first.unionByName(rest))
