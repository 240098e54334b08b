"""Ranked lexical search, term at a time with limited accumulators.

The documents are read once: of each its number of terms and the occurrences of the items'
terms are written. Document frequencies, the number of documents and of all terms are
counted over them. Each task then searches its own part in batches, every item by itself:
the item's terms come rarest first, and a document gets an accumulator when a term first
meets it. Once what the remaining terms can add at most is below the k-th largest partial
score, or below the k-th score of earlier batches of the task, no document without an accumulator
can still be among the first k. From there on no accumulators are made, and those there
are get the remaining terms' exact shares. A task returns k rows an item at most, which
meet in two rounds.

Defined results: a null or empty text has no terms and is not counted; a null doc_id ranks
after all others of the same score; repeated rows are documents of their own, repeated
(item_id, text) rows are one item; an item without terms, or whose terms occur nowhere, has no
rows; a null item_id is an item like others; empty tables give no rows; further columns are
not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candrank.llm.common import blocks_for, text_of, written

BEST = 10
#: Bytes of item texts that are searched together; more are further passes over what was read.
ITEM_BYTES = 8 * 1024 * 1024
SALTS = 32
#: Postings of a batch that are looked at together.
POSTINGS = 2_000_000
_NO_ID = np.iinfo(np.int64).max


def _separated() -> bytes:
    """Bytes that no term holds become spaces, A-Z become a-z."""
    table = bytearray(range(256))
    for b in range(128):
        char = chr(b)
        table[b] = ord(char.lower()) if char.isalnum() else 32
    return bytes(table)


TERMS = _separated()


def terms_of(raw: bytes | None) -> list[bytes]:
    """The lower-cased terms of a text in UTF-8; bytes beyond ASCII always belong to one."""
    return (raw or b"").translate(TERMS).split()


class Item:
    """An item's terms by number, each with how often the item holds it."""

    def __init__(self, item_id: int | None, counts: dict[int, int]):
        self.item_id = item_id
        self.counts = counts


def occurrences(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Per document with terms: doc_id, its number of terms, the wanted terms and how often each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = numbers.get
        for batch in batches:
            kept, sizes, found, times = [], [], [], []
            for at, value in enumerate(batch.column(1)):
                words = terms_of(value.as_py())
                if not words:
                    continue
                held = np.array([t for t in map(get, words) if t is not None], np.int32)
                term, tf = np.unique(held, return_counts=True)
                kept.append(at)
                sizes.append(len(words))
                found.append(term.tobytes())
                times.append(tf.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(kept, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.array(found, pa.binary()),
                    pa.array(times, pa.binary()),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return text.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_frequencies(read: DataFrame, size: int) -> dict[int, int]:
    """In how many documents each wanted term occurs; as many rows as there are wanted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column(0):
                df[np.frombuffer(value.as_py(), np.int32)] += 1
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    counted = read.select("terms").mapInArrow(run, "term long, df long")
    return {r.term: r.df for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Postings:
    """The lists of a batch: for each term the places of its documents and their shares."""

    def __init__(self, n, terms, tfs, documents: int, total: int):
        each = [np.frombuffer(t, np.int32) for t in terms]
        owner = np.repeat(np.arange(len(each)), [len(t) for t in each])
        term = np.concatenate([*each, np.zeros(0, np.int32)])
        tf = np.concatenate([*(np.frombuffer(t, np.int32) for t in tfs), np.zeros(0, np.int32)]).astype(np.int64)
        # In Python's own numbers, since a long text of a large corpus leaves 64 bits.
        norm = np.array([25 + 75 * int(x) * documents // total for x in n], np.int64)
        share = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[owner])
        order = np.argsort(term, kind="stable")
        self._owner, self._share = owner[order], share[order]
        self._term, start = np.unique(term[order], return_index=True)
        self._start = np.append(start, len(term))
        self.size = len(each)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self._term, term)
        if at == len(self._term) or self._term[at] != term:
            return self._owner[:0], self._share[:0]
        part = slice(self._start[at], self._start[at + 1])
        return self._owner[part], self._share[part]


def search(postings: Postings, plan: list[tuple[int, int]], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the documents that can be among the first ``k``.

    ``plan``: (term, factor), rarest first. ``floor``: a document needs this score at least.
    """
    lists = [(factor, *postings.of(term)) for term, factor in plan]
    lists = [x for x in lists if x[0] and len(x[1])]
    most = [factor * int(share.max()) for factor, _, share in lists]
    remaining = np.append(np.cumsum(most[::-1])[::-1], 0).astype(np.int64)
    score, held = np.zeros(postings.size, np.int64), np.zeros(postings.size, bool)
    made: list[np.ndarray] = []
    count, creating = 0, True
    for at, (factor, place, share) in enumerate(lists):
        if creating:
            least = floor
            if count >= k:
                partial = score[np.concatenate(made)]
                least = max(least, int(np.partition(partial, count - k)[count - k]))
            # A document of an equal score could still win by its smaller id.
            creating = remaining[at] >= least
        if creating:
            new = place[~held[place]]
            held[new] = True
            made.append(new)
            count += len(new)
        else:
            known = held[place]
            place, share = place[known], share[known]
        score[place] += factor * share
    places = np.concatenate([*made, np.zeros(0, np.int64)]).astype(np.int64)
    return places, score[places]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > k:
        enough = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[enough], ids[enough]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _best(read: DataFrame, items: list[Item], df: dict[int, int], documents: int, total: int, k: int) -> DataFrame:
    """(item_id, item, doc_id, score): each task's first ``k`` of every item."""
    plans = []
    for item in items:
        known = sorted((df[t], t) for t in item.counts if t in df)
        plans.append([(t, item.counts[t] * weight(documents, n)) for n, t in known])
    names = [item.item_id for item in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(plans)
        for batch in batches:
            ids, n, terms, tfs = (batch.column(i) for i in range(4))
            ids = np.array(ids.fill_null(_NO_ID), np.int64)
            n, terms, tfs = n.to_pylist(), terms.to_pylist(), tfs.to_pylist()
            held = np.cumsum([len(t) // 4 for t in terms])
            cuts = np.searchsorted(held, np.arange(POSTINGS, (held[-1] if len(held) else 0) + POSTINGS, POSTINGS))
            start = 0
            for end in dict.fromkeys([*(min(int(c) + 1, len(n)) for c in cuts), len(n)]):
                if end <= start:
                    continue
                postings = Postings(n[start:end], terms[start:end], tfs[start:end], documents, total)
                for i, plan in enumerate(plans):
                    old_score, old_id = best[i]
                    floor = int(old_score[-1]) if len(old_score) == k else 0
                    place, score = search(postings, plan, k, max(floor, 1))
                    place, score = place[score > 0], score[score > 0]
                    if len(score):
                        best[i] = _first(
                            np.concatenate([old_score, score]), np.concatenate([old_id, ids[start:end][place]]), k
                        )
                start = end
        for i, (score, doc) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[i]] * len(score), pa.int64()),
                        pa.array([i] * len(score), pa.int32()),
                        pa.array(doc, mask=doc == _NO_ID),
                        pa.array(score),
                    ],
                    names=["item_id", "item", "doc_id", "score"],
                )

    return read.mapInArrow(run, "item_id long, item int, doc_id long, score long")


def rank_items(docs: DataFrame, items: DataFrame, k: int = BEST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 of each item."""
    spark = docs.sparkSession
    asked = written(
        items.select(F.col("item_id").cast("long").alias("item_id"), text_of().cast("binary").alias("text")).distinct(),
        "items",
    )
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    groups = blocks_for(size, item_bytes)
    dealt = asked.withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    every = None
    for g in range(groups):
        numbers: dict[bytes, int] = {}
        asking = []
        for row in dealt.filter(F.col("g") == g).toLocalIterator():
            counts = Counter(terms_of(bytes(row.text)))
            asking.append(Item(row.item_id, {numbers.setdefault(t, len(numbers)): q for t, q in counts.items()}))
        read = written(occurrences(docs, numbers), "occurrences")
        documents, total = read.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = _best(read, asking, document_frequencies(read, len(numbers)), documents, total, k)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        salted = W.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
        few = found.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= k)
        last = W.partitionBy("item").orderBy(*order)
        best = (
            few.withColumn("rank", F.row_number().over(last))
            .filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score")
        )
        every = best if every is None else every.unionByName(best)
    return every if every is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
