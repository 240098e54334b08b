"""Byte-level BPE of whole texts by one shuffle of distinct words, and decoding.

A task reads its documents in blocks of bounded size and turns each text into the positions of
its pre-tokens in the block's list of distinct pre-tokens. Only these lists are dealt out by
word, so a word that is in every text travels once for each block. Each word is encoded once
where its copies meet; the ids go back to the block, meet the positions, and the texts are put
together again. Decoding looks each id up in the table of token bytes.

The block lists and the block positions come from two reads of the documents in the same
splits. Each block carries a checksum of its list on both ways; blocks that differ, as they
could if an input came back in another order, stop the job instead of giving wrong ids.

Defined results: a null or empty text has no tokens; null and repeated ids are rows like
others; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank.llm.tokens import REMEMBERED, pre_tokens, rank_encoding, ranks, spans

BLOCK_CHARS = 7_000_000
#: Parts into which words are dealt by their checksum.
WORD_PARTS = 512

_WORDS = "part long, block long, mark long, words binary, places binary"
_POSITIONS = "block long, mark long, doc_id long, codes binary"
_IDS = "block long, mark long, places binary, counts binary, ids binary"


def squeezed(values: np.ndarray) -> bytes:
    """Integers by byte planes; the high planes are nearly constant."""
    raw = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    return zlib.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def restored(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


class _Spans(dict):
    """The numbers of each span's pre-tokens, which are numbered as they come."""

    def __init__(self, find):
        super().__init__()
        self._find = find
        self.words: dict[str, int] = {}

    def __missing__(self, span: str) -> bytes:
        words = self.words
        found = self[span] = b"".join(
            words.setdefault(w, len(words)).to_bytes(4, "little") for w in pre_tokens(self._find, span)
        )
        return found


class Block:
    """The distinct pre-tokens of some texts, and each text as their numbers where wanted."""

    def __init__(self, pattern, positions: bool):
        self._spans = _Spans(pattern.findall)
        self.words = self._spans.words
        self._positions = positions
        self.rows: list[tuple] = []
        self.texts = self.chars = 0

    def add(self, doc_id, text: str) -> None:
        codes = map(self._spans.__getitem__, spans(text))
        if self._positions:
            self.rows.append((doc_id, squeezed(np.frombuffer(b"".join(codes), "<u4"))))
        else:
            deque(codes, maxlen=0)
        self.texts += 1
        self.chars += len(text)

    def mark(self) -> int:
        """A checksum of the list in its order."""
        return zlib.crc32("\x00".join(self.words).encode("utf-8", "surrogatepass"))


def _blocks(
    batches: Iterator[pa.RecordBatch], pattern: str, chars: int, positions: bool
) -> Iterator[tuple[int, Block]]:
    import regex

    compiled, first = regex.compile(pattern), TaskContext.get().partitionId() << 32
    block, number = Block(compiled, positions), 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            block.add(doc_id.as_py(), text.as_py() or "")
            if block.chars >= chars:
                full, block = block, None
                yield first + number, full
                del full
                block, number = Block(compiled, positions), number + 1
    if block.texts:
        yield first + number, block


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    block_chars: int = BLOCK_CHARS,
    word_parts: int = WORD_PARTS,
) -> DataFrame:
    """Per row: doc_id and ids, little-endian unsigned 32-bit integers in one binary.

    With more distinct words, raise ``word_parts``: a task remembers the words of one part.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, pattern, block_chars, False):
            mark = block.mark()
            raw = [w.encode("utf-8", "surrogatepass") for w in block.words]
            hashed = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
            # The part depends on the word alone, so that equal words meet.
            part = hashed % np.uint32(word_parts)
            order = np.lexsort((hashed, part))
            edges = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0]) if len(raw) else []
            rows = []
            for a, b in zip(edges, [*edges[1:], len(raw)], strict=True):
                own = order[a:b]
                rows.append(
                    (
                        int(part[own[0]]),
                        number,
                        mark,
                        zlib.compress(b"\xff".join(raw[i] for i in own), 1),
                        squeezed(own),
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*rows, strict=True)]
                if rows
                else [pa.array([], t) for t in _types(_WORDS)],
                names=_names(_WORDS),
            )
            # The next block is read before this loop turns, and two are not held at a time.
            del block, raw, hashed, part, order, rows

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches, pattern, block_chars, True):
            mark, n = block.mark(), len(block.rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * n, pa.int64()),
                    pa.array([mark] * n, pa.int64()),
                    pa.array([r[0] for r in block.rows], pa.int64()),
                    pa.array([r[1] for r in block.rows], pa.binary()),
                ],
                names=_names(_POSITIONS),
            )
            del block

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, known, part = rank_encoding(ranks_path, pattern), {}, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    known, part = {}, row["part"]
                if len(known) > REMEMBERED:
                    known = {}
                words = zlib.decompress(row["words"]).split(b"\xff")
                for word in words:
                    if word not in known:
                        known[word] = np.array(
                            one.encode_ordinary(word.decode("utf-8", "surrogatepass")), "<u4"
                        ).tobytes()
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                rows.append(
                    (
                        row["block"],
                        row["mark"],
                        row["places"],
                        squeezed(counts),
                        squeezed(np.frombuffer(b"".join(ids), "<u4")),
                    )
                )
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*rows, strict=True)], names=_names(_IDS)
                )

    def assemble(texts: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({"doc_id": [], "ids": []})
        if len(set(texts["mark"]) | set(lists["mark"])) != 1 and len(lists):
            raise ValueError("the documents were read in different blocks")
        places = np.concatenate([restored(p) for p in lists["places"]] or [np.zeros(0, "<u4")])
        counts = np.concatenate([restored(c) for c in lists["counts"]] or [np.zeros(0, "<u4")])
        ids = np.concatenate([restored(i) for i in lists["ids"]] or [np.zeros(0, "<u4")])
        ends = np.cumsum(counts, dtype=np.int64)
        start, size = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        start[places], size[places] = ends - counts, counts
        out = []
        for blob in texts["codes"]:
            codes = restored(blob)
            n = size[codes]
            shift = np.repeat(start[codes] - (np.cumsum(n) - n), n)
            out.append(ids[shift + np.arange(len(shift))].tobytes())
        return pd.DataFrame({"doc_id": texts["doc_id"].astype("Int64"), "ids": out})

    words = (
        read.mapInArrow(word_lists, _WORDS)
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(encode_words, _IDS)
    )
    return (
        read.mapInArrow(positions, _POSITIONS)
        .groupBy("block")
        .cogroup(words.groupBy("block"))
        .applyInPandas(assemble, "doc_id long, ids binary")
    )


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Per row: doc_id, ids and the bytes they stand for."""

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = {i: token for token, i in ranks(ranks_path).items()}
        for pdf in batches:
            yield pdf.assign(
                doc_id=pdf["doc_id"].astype("Int64"),
                decoded=[
                    b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist()))
                    for x in pdf["ids"]
                ],
            )

    return encoded.mapInPandas(look_up, "doc_id long, ids binary, decoded binary")


def digested(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Per row: n_tokens and the digests of the ids and of the decoded bytes."""
    return decode(encoded, ranks_path).select(
        "doc_id",
        F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(",")]


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return [kinds[f.split()[1]] for f in schema.split(",")]
