"""From raw documents to packed sequences: quality, exact copies, near copies, packing.

Each stage reads what the one before it wrote and returns the columns of documents, the last
one the packed pieces. Its result can't be said in SQL, so tests compare the stages with
brute-force versions.

Defined results: a null text counts as empty, null and repeated ids are rows like others, told
apart by their texts; of rows with equal id and text one stays after the exact stage; ties go to the
largest doc_id there and to the smallest in the near stage; without labels of both kinds no
document is rejected; an empty table gives no rows in any stage; further columns pass
through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from candrank.llm.common import table, written
from candrank.llm.exact_dedup import without_copies
from candrank.llm.near_dedup import without_near
from candrank.llm.packing import pack
from candrank.llm.quality import without_rejected


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier rejects."""
    return without_rejected(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near copies the row with the smallest doc_id: five words, 0.8 or more."""
    return without_near(docs, words=5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
