"""Interpolated modified Kneser-Ney bigram model, counted in Spark, and its scores.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end of each text; a text's
first token follows a start. Tasks read texts in blocks and deal each token, with the word before
it, to parts by that word: the word hashes of a block and part travel once, tokens as places in
them. A part counts its bigrams and what follows each word, and is stored, in as many buckets as
there are parts, as sorted arrays: word hashes, bigrams and the places of their tokens. A bigram
lies in one part only, so how many words precede a word is the sum of what the parts count: each
part deals its words by ranges of their hashes, and gets their whole counts back. Then the part
stays where it is; the worker maps its arrays from files, sums the log probabilities for each
document in the part, and only one number for each document and part moves.

A frequent word (``HOT_SHARE`` of a block's tokens or more in the whole corpus) is split over
several parts by the other word of the bigram; its counts are added up from all of them. At most
1 / HOT_SHARE words are so frequent, so their list is small whatever the corpus.

The documents are read three times in the same blocks; each document's token count is carried
along and compared at the end, and a difference stops the job.

Defined results: a null or empty text is one end; null and repeated ids are rows like others, the
crc32 of a null id is that of the empty text; without training documents every probability is
uniform over one unknown word; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank.llm.bpe import restored, squeezed
from candrank.llm.common import FOLD, blocks_for
from candrank.plans.scratch import new_path, written

BLOCK_CHARS = 16_000_000
PART_CHARS = 16_000_000
UNIT = 2.0**24  # of the sums of log10 that parts hand on; whole numbers add up alike in any order
HOT_SHARE = 0.005
SPLIT = 16
ORDER_DISCOUNT = 0.75
_START, _END = b" start", b" end"  # no word holds a space

_GRAMS = "part long, block long, words binary, u binary, w binary, d binary"
_PAIRS = (
    "part long, words binary, w binary, c binary, context binary, stats binary, at binary, d binary, "
    "blocks binary, n1 long, n2 long, n3 long, n4 long, types long, hot array<struct<word:long,n:long,one:long,two:long,more:long>>"
)
_HOT = ("word", "n", "one", "two", "more")
MOST_BUCKETS = 20_000


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = word_hash(word)
        return found


def _packed(values: np.ndarray) -> bytes:
    """64-bit integers by byte planes."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    return zlib.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(np.uint64).ravel()


def _sorted_packed(hashes: np.ndarray) -> bytes:
    return _packed(np.diff(hashes, prepend=np.uint64(0)))


def _sorted_unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob), dtype=np.uint64)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Block:
    """The tokens of some texts as hashes, with the place of their document."""

    def __init__(self):
        self.ids: list = []
        self.sizes: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.chars = 0

    def arrays(self):
        """Token hash, hash of the token before, document, whether it is trained on."""
        w = np.concatenate(self.tokens)
        u = np.empty_like(w)
        u[1:] = w[:-1]
        begins = np.cumsum([0, *self.sizes[:-1]])
        u[begins] = word_hash(_START)
        d = np.repeat(np.arange(len(self.sizes)), self.sizes)
        train = np.repeat([not held_out(i) for i in self.ids], self.sizes)
        return w, u, d, train


def _blocks(
    batches: Iterator[pa.RecordBatch], chars: int, hashed: bool = True
) -> Iterator[tuple[int, Block]]:
    first, hashes, end = TaskContext.get().partitionId() << 32, _Hashes(), word_hash(_END)
    block, number = Block(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            words = (text.as_py() or "").encode().translate(FOLD).split()
            if hashed:
                own = np.empty(len(words) + 1, np.uint64)
                own[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                own[-1] = end
                block.tokens.append(own)
            block.ids.append(doc_id.as_py())
            block.sizes.append(len(words) + 1)
            block.chars += 7 * block.sizes[-1]
            if block.chars >= chars:
                yield first + number, block
                block, number = Block(), number + 1
    if block.ids:
        yield first + number, block


def _edges(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)


def _part_of(key: np.ndarray, other: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part of a word; a hot word's bigrams are spread by the other word."""
    mixed = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    if len(hot):
        salt = ((other * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) % np.uint64(SPLIT)
        mixed = mixed + np.where(np.isin(key, hot), salt * np.uint64(7919), np.uint64(0))
    return (mixed % np.uint64(parts)).astype(np.int64)


def vocabulary(read: DataFrame, block_chars: int, parts: int) -> DataFrame:
    """Per part of the words: the training tokens, the distinct words of them, and its most frequent ones."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for _, block in _blocks(batches, block_chars):
            w, _, _, train = block.arrays()
            own, count = np.unique(w[train], return_counts=True)
            part = (own >> np.uint64(20)) % np.uint64(parts)
            for p in np.unique(part):
                at = part == p
                yield pa.RecordBatch.from_pydict(
                    {"part": [int(p)], "words": [_sorted_packed(own[at])], "counts": [squeezed(count[at])]}
                )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.concatenate([_sorted_unpacked(x) for x in pdf["words"]])
        n = np.concatenate([restored(x) for x in pdf["counts"]]).astype(np.int64)
        own, at = np.unique(w, return_inverse=True)
        total = np.bincount(at, weights=n).astype(np.int64)
        top = np.argsort(-total)[: int(1 / HOT_SHARE)]
        return pd.DataFrame(
            {
                "distinct": [len(own)],
                "tokens": [int(total.sum())],
                "top": [own[top].view(np.int64).tolist()],
                "n": [total[top].tolist()],
            }
        )

    return (
        read.mapInArrow(words, "part long, words binary, counts binary")
        .groupBy("part")
        .applyInPandas(count, "distinct long, tokens long, top array<long>, n array<long>")
    )


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts 1, 2, and 3 or more."""
    if not n1 or not n2:
        return ORDER_DISCOUNT, ORDER_DISCOUNT, ORDER_DISCOUNT
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(float(min(max(d, 0.1), k - 0.05)) for k, d in enumerate(found, 1))


def _stored(parts: DataFrame, buckets: int) -> DataFrame:
    """Written to the shared folder by buckets of the part, so that no later use moves it."""
    spark, name = parts.sparkSession, f"candrank_model_{uuid.uuid4().hex}"
    (
        parts.write.format("parquet")
        .bucketBy(buckets, "part")
        .option("path", new_path(spark, "bigrams"))
        .saveAsTable(name)
    )
    return spark.table(name)


def perplexity_scores(
    docs: DataFrame, block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = blocks_for(size, part_chars, 4)
    tops = written(vocabulary(read, block_chars, parts), "vocabulary")
    total, distinct = (int(x or 0) for x in tops.agg(F.sum("tokens"), F.sum("distinct")).first())
    # At most 1 / HOT_SHARE words have such a share of all tokens, whatever the parts.
    frequent = (
        tops.select(F.explode(F.arrays_zip("top", "n")).alias("w")).filter(F.col("w.n") >= HOT_SHARE * total).collect()
    )
    hot = np.array([r.w.top for r in frequent], np.int64).view(np.uint64)
    start = word_hash(_START)
    hot = np.unique(np.r_[hot, np.uint64(start)])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, block_chars):
            w, u, d, train = block.arrays()
            part = _part_of(u, w, hot, parts)
            order = np.lexsort((u, part))
            d = (d * 2 + train).astype(np.uint32)
            w, u, d, part = w[order], u[order], d[order], part[order].astype(np.int32)
            del order, train
            edges = _edges(part)
            for a, b in zip(edges, [*edges[1:], len(part)], strict=True):
                words, at = np.unique(np.r_[u[a:b], w[a:b]], return_inverse=True)
                at = at.astype(np.int64)
                first = np.diff(at[: b - a], prepend=0)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": [int(part[a])],
                        "block": [number],
                        "words": [_sorted_packed(words)],
                        "u": [squeezed(first)],
                        "w": [squeezed(at[b - a :])],
                        "d": [squeezed(d[a:b])],
                    }
                )

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        us, ws, ds, bs = [], [], [], []
        for k, row in enumerate(pdf.itertuples()):
            words = _sorted_unpacked(row.words)
            us.append(words[np.cumsum(restored(row.u).astype(np.int64))])
            ws.append(words[restored(row.w)])
            ds.append(restored(row.d))
            bs.append(np.full(len(ds[-1]), k, np.uint32))
        u, w, d, b = (np.concatenate(x) for x in (us, ws, ds, bs))
        del us, ws, ds, bs
        order = np.lexsort((w, u))
        u, w, d, b = u[order], w[order], d[order], b[order]
        del order
        begins = np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])]
        edge, pair = np.flatnonzero(begins), np.cumsum(begins, dtype=np.int32) - 1
        c = np.add.reduceat((d & 1).astype(np.int64), edge)
        pu, pw = u[edge], w[edge]
        del u, w
        contexts = _edges(pu)
        context = np.cumsum(np.r_[False, pu[1:] != pu[:-1]])
        stats = np.stack(
            [np.add.reduceat(x, contexts) for x in (c, c == 1, c == 2, c >= 3)], axis=1
        ).astype(np.int64)
        # A hot word's counts here are a share of its counts.
        is_hot = np.isin(pu[contexts], hot)
        hot_stats = np.c_[pu[contexts][is_hot].view(np.int64), stats[is_hot]].tolist()
        names = np.where(is_hot, np.searchsorted(hot, pu[contexts]) + 1, 0)
        words, at = np.unique(pw, return_inverse=True)
        row = (
            int(pdf["part"].iloc[0]),
            _sorted_packed(words),
            squeezed(at),
            squeezed(c),
            squeezed(np.diff(context, prepend=0)),
            squeezed(np.c_[stats, names].ravel()),
            squeezed(np.diff(pair, prepend=0)),
            squeezed(np.stack([d, b]).ravel()),
            pdf["block"].to_numpy(np.int64).tobytes(),
            *(int((c == k).sum()) for k in (1, 2, 3, 4)),
            int((c > 0).sum()),
            [dict(zip(_HOT, x, strict=True)) for x in hot_stats],
        )
        return pd.DataFrame([row], columns=[f.split()[0] for f in _PAIRS.split(", ")])

    buckets = min(parts, MOST_BUCKETS)
    counted = _stored(
        read.mapInArrow(grams, _GRAMS).repartition(buckets, "part").groupBy("part").applyInPandas(count, _PAIRS),
        buckets,
    )
    n1, n2, n3, n4, types = (
        int(x or 0)
        for x in counted.agg(*(F.sum(c) for c in ("n1", "n2", "n3", "n4", "types"))).first()
    )
    # One row for each hot word, at most 1 / HOT_SHARE + 1.
    shares = (
        counted.select(F.explode("hot").alias("h"))
        .groupBy("h.word")
        .agg(*(F.sum(f"h.{c}").alias(c) for c in _HOT[1:]))
        .collect()
    )
    hot_context = np.zeros((len(hot) + 1, 4), np.int64)
    for r in shares:
        at = np.searchsorted(hot, np.array([r.word], np.int64).view(np.uint64))[0]
        hot_context[at + 1] = [r[c] for c in _HOT[1:]]

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A part's words by ranges of their hashes: bigrams that end in each, and tokens."""
        for pdf in batches:
            for row in pdf.itertuples():
                words, at, c = _sorted_unpacked(row.words), restored(row.w), restored(row.c)
                before = np.bincount(at, weights=c > 0, minlength=len(words))
                n = np.bincount(at, weights=c, minlength=len(words))
                del at, c
                where = ((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                starts = _edges(where)
                yield pd.DataFrame(
                    [
                        (row.part, int(where[a]), _sorted_packed(words[a:z]), squeezed(before[a:z]), squeezed(n[a:z]))
                        for a, z in zip(starts, [*starts[1:], len(words)], strict=True)
                    ],
                    columns=["part", "range", "words", "before", "n"],
                )

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        """The whole counts of a range's words, for each part in the order of its words."""
        own = [_sorted_unpacked(x) for x in pdf["words"]]
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        sums = [
            np.bincount(at, weights=np.concatenate([restored(x) for x in pdf[c]]), minlength=len(keys))
            for c in ("before", "n")
        ]
        ends = np.cumsum([len(x) for x in own])
        places = np.split(at, ends[:-1])
        return pd.DataFrame(
            {
                "part": pdf["part"],
                "range": pdf["range"],
                "before": [_packed(sums[0][x].astype(np.int64)) for x in places],
                "n": [_packed(sums[1][x].astype(np.int64)) for x in places],
            }
        )

    whole_counts = (
        counted.select("part", "words", "w", "c")
        .mapInPandas(dealt, "part long, range long, words binary, before binary, n binary")
        .groupBy("range")
        .applyInPandas(added, "part long, range long, before binary, n binary")
    )
    d1, d2, d3 = discounts(n1, n2, n3, n4)

    def score(pdf: pd.DataFrame, wholes: pd.DataFrame) -> pd.DataFrame:
        row = next(pdf.itertuples())
        wholes = wholes.sort_values("range")
        with tempfile.TemporaryDirectory() as folder:

            def mapped(name: str, values: np.ndarray) -> np.ndarray:
                """The array from a file that the worker maps into memory."""
                np.save(os.path.join(folder, name), values)
                return np.load(os.path.join(folder, name), mmap_mode="r")

            words = mapped("words.npy", _sorted_unpacked(row.words))
            before, tokens = (
                mapped(f"{c}.npy", np.concatenate([_unpacked(x) for x in wholes[c]])) for c in ("before", "n")
            )
            if not len(words) == len(before) == len(tokens):
                raise ValueError("a part got the counts of other words")
            w = restored(row.w)
            c = restored(row.c).astype(np.float64)
            lower = (
                np.maximum(before[w].astype(np.float64) - ORDER_DISCOUNT, 0)
                + ORDER_DISCOUNT * distinct / (distinct + 1)
            ) / types if types else np.full(len(c), 1.0)
            stats = restored(row.stats).astype(np.int64).reshape(-1, 5)
            named = stats[:, 4] > 0
            stats[named, :4] = hot_context[stats[named, 4]]
            n = np.maximum(stats[:, 0], 1)
            back = np.where(
                stats[:, 0] > 0, (d1 * stats[:, 1] + d2 * stats[:, 2] + d3 * stats[:, 3]) / n, 1.0
            )
            own = np.cumsum(restored(row.context).astype(np.int32))
            gone = np.select([c >= 3, c == 2, c == 1], [d3, d2, d1], 0.0)
            logs = mapped("logs.npy", np.log10((c - gone) / n[own] + back[own] * lower))
            del stats, n, back, own, gone, lower, c
            base = mapped(
                "base.npy",
                np.log10((tokens.astype(np.float64) + 0.1) / (total + 0.1 * (distinct + 1))),
            )
            pair = np.cumsum(restored(row.at).astype(np.int32), dtype=np.int32)
            d, b = restored(row.d).reshape(2, -1)
            blocks = np.frombuffer(row.blocks, np.int64)
            key = (b.astype(np.int64) << 32) + (d >> 1)
            del d, b
            own, at = np.unique(key, return_inverse=True)
            del key
            sums = [np.bincount(at, weights=logs[pair])]
            ends = w[pair]
            del pair, w
            sums += [
                np.bincount(at, weights=base[ends]),
                np.bincount(at, weights=tokens[ends] > 0),
                np.bincount(at).astype(np.float64),
            ]
            del words, before, tokens, logs, base
        return per_block(blocks[own >> 32], own & 0xFFFFFFFF, sums)

    def per_block(block: np.ndarray, place: np.ndarray, sums: list[np.ndarray]) -> pd.DataFrame:
        """The sums of the documents that occur in a part; never more than its tokens."""
        starts = _edges(block)  # blocks come in order
        out = []
        for a, z in zip(starts, [*starts[1:], len(block)], strict=True):
            logs, base, known, tokens = (x[a:z] for x in sums)
            counts = np.stack([np.diff(place[a:z], prepend=0), np.rint(known), np.rint(tokens)])
            units = [_packed(np.rint(-x * UNIT).astype(np.int64)) for x in (logs, base)]
            out.append((int(block[a]), *units, squeezed(counts.ravel())))
        return pd.DataFrame(out, columns=["block", "logs", "base", "counts"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, block_chars, hashed=False):
            n = len(block.ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * n, pa.int64()),
                    pa.array(range(n), pa.int64()),
                    pa.array(block.ids, pa.int64()),
                    pa.array([held_out(i) for i in block.ids], pa.bool_()),
                    pa.array(block.sizes, pa.int64()),
                ],
                names=["block", "place", "doc_id", "held_out", "n_tokens"],
            )

    def together(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        whole = np.zeros((4, len(own)), np.int64)
        for row in found.itertuples():
            place, known, tokens = restored(row.counts).reshape(3, -1)
            # A place occurs once in a part's row.
            whole[:, np.cumsum(place.astype(np.int64))] += np.stack(
                [_unpacked(row.logs).view(np.int64), _unpacked(row.base).view(np.int64), known, tokens]
            )
        if not np.array_equal(whole[3], own["n_tokens"].to_numpy()):
            raise ValueError("the documents were read in different blocks")
        return pd.DataFrame(
            {
                "doc_id": own["doc_id"].astype("Int64"),
                "held_out": own["held_out"].to_numpy(),
                "n_tokens": own["n_tokens"].to_numpy(),
                "n_known": whole[2],
                "train_tokens": total,
                "base_score": whole[1] / -UNIT,
                "score": whole[0] / -UNIT,
            }
        )

    sums = counted.groupBy("part").cogroup(whole_counts.groupBy("part")).applyInPandas(
        score, "block long, logs binary, base binary, counts binary"
    )
    return (
        read.mapInArrow(documents, "block long, place long, doc_id long, held_out boolean, n_tokens long")
        .groupBy("block")
        .cogroup(sums.groupBy("block"))
        .applyInPandas(
            together,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double",
        )
    )
