"""Exact dedup by a tree-merge of sorted digest runs.

Rows become digests once. Equal digests of one run are reduced before they move. A run is
sorted by digest and kept as segments; in each round the runs exchange segments with the
seven runs of the same family (a binomial exchange with eight partners), every segment
being cut into eight finer digest ranges, so that after a round there are an eighth of the
runs, each segment is as large as before, and no task ever holds a whole run. A merge keeps
the winning identifier, adds the counts, and checks that equal digests have equal lengths
and checksums.

Defined results: a null text counts as empty; a null id loses to any other and is kept
only in a group of null ids; repeated rows of one id count in ``group_size`` and share
``kept``; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank.llm.common import KEY_BYTES, LOWER, UPPER, rows_kept, text_of, written

FAN_BITS = 3
RUN_ROWS = 50_000
_SEGMENT = "run int, slice long, digests binary, checks binary, ids binary, counts binary"
_ITEM = np.dtype([("digest", "V32"), ("check", "u8"), ("id", "i8"), ("n", "i8")])


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, SHA-256 of the normalised text, its length and checksum in one long."""

    text = F.translate(text_of(), UPPER, LOWER)
    check = F.octet_length(text).cast("long").bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(1 << 32) + F.crc32(
        text.cast("binary")
    )
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        check.alias("text_check"),
    )


def _pack(run: int, part: int, items: np.ndarray) -> tuple:
    return (run, part, *(np.ascontiguousarray(items[c]).tobytes() for c in _ITEM.names))


def _unpack(row) -> np.ndarray:
    items = np.empty(len(row.ids) // 8, _ITEM)
    for name, raw in zip(_ITEM.names, (row.digests, row.checks, row.ids, row.counts), strict=True):
        items[name] = np.frombuffer(raw, _ITEM[name])
    return items


def _prefixes(items: np.ndarray) -> np.ndarray:
    """The first 56 bits of each digest."""
    raw = np.frombuffer(items["digest"].tobytes(), np.uint8).reshape(-1, 32)[:, :8]
    return np.ascontiguousarray(raw).view(">u8").ravel().astype(np.uint64) >> np.uint64(8)


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run of the largest id and the count of each digest."""
    items = np.concatenate(runs)
    if not len(items):
        return items
    words = np.frombuffer(items["digest"].tobytes(), ">u8").reshape(-1, 4)
    # The largest id first within a digest; the complement turns the order of all of them.
    order = np.lexsort((~items["id"], words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
    items, words = items[order], words[order]
    first = np.r_[True, (words[1:] != words[:-1]).any(axis=1)]
    group = np.cumsum(first) - 1
    kept = items[first]
    if (items["check"] != kept["check"][group]).any():
        raise ValueError("two different texts have the same digest")
    kept["n"] = np.add.reduceat(items["n"], np.flatnonzero(first))
    return kept


NO_ID = np.iinfo(np.int64).min


def largest_ids(rows: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """(digest, keep_id, group_size) from the rows of :func:`digests`."""
    fan = 1 << FAN_BITS
    n, rounds = rows.count(), 1
    while run_rows * fan**rounds < n:
        rounds += 1

    def to_run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = np.empty(len(pdf), _ITEM)
        items["digest"] = np.frombuffer(b"".join(pdf["digest"]), "V32")
        items["check"], items["id"], items["n"] = pdf["check"], pdf["keep_id"], pdf["n"]
        return pd.DataFrame(
            [_pack(int(pdf["run"].iloc[0]), 0, merge([items]))], columns=_names
        )

    def cut(depth: int):
        """Cut each segment into the ranges of the next round."""

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    items = _unpack(row)
                    part = _prefixes(items) >> np.uint64(56 - FAN_BITS * depth)
                    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                    yield pd.DataFrame(
                        [
                            _pack(row.run >> FAN_BITS, int(part[a]), items[a:b])
                            for a, b in zip(edges, [*edges[1:], len(items)], strict=True)
                        ],
                        columns=_names,
                    )

        return split

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        items = merge([_unpack(row) for row in pdf.itertuples()])
        return pd.DataFrame(
            [_pack(int(pdf["run"].iloc[0]), int(pdf["slice"].iloc[0]), items)], columns=_names
        )

    _names = ["run", "slice", "digests", "checks", "ids", "counts"]
    runs = (
        rows.groupBy(
            # By id and row, so that the rows of one id, or of none, are spread.
            F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(fan**rounds)).cast("int").alias("run"),
            "digest",
            F.col("text_check").alias("check"),
        )
        .agg(
            F.max(F.coalesce("doc_id", F.lit(int(NO_ID)))).alias("keep_id"),
            F.count(F.lit(1)).alias("n"),
        )
        .groupBy("run")
        .applyInPandas(to_run, _SEGMENT)
    )
    for depth in range(1, rounds + 1):
        runs = runs.mapInPandas(cut(depth), _SEGMENT).groupBy("run", "slice").applyInPandas(
            meet, _SEGMENT
        )

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                items = _unpack(row)
                yield pd.DataFrame(
                    {
                        "digest": [x.tobytes() for x in items["digest"]],
                        "keep_id": items["id"],
                        "group_size": items["n"],
                    }
                )

    found = runs.mapInPandas(rows_of, "digest binary, keep_id long, group_size long")
    return found.withColumn(
        "keep_id", F.when(F.col("keep_id") != int(NO_ID), F.col("keep_id"))
    )


def exact_dedup(docs: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs), "digests")
    kept: Column = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(largest_ids(rows, run_rows), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        kept.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one row of each text."""
    found = written(exact_dedup(docs, run_rows), "kept").filter("kept")
    key = F.unhex(F.left("text_sha256", F.lit(2 * KEY_BYTES))).alias("text_key")
    return rows_kept(docs, found.groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n")))
