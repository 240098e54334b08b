"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.plans.joins import fits
from candrank.plans.scratch import written

__all__ = ["UPPER", "LOWER", "FOLD", "table", "text_of", "written", "blocks_for", "text_key", "rows_kept", "fresh", "trimmed"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text's digest that are carried beside its id.
KEY_BYTES = 16
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def blocks_for(amount: int, each: int, least: int = 1) -> int:
    """How many blocks of ``each`` hold ``amount``; grows with the data, so blocks do not."""
    return max(least, -(-int(amount) // each))


def text_key(column: str = "text") -> Column:
    """Half of the SHA-256 of the text with A-Z folded; tells apart the texts of one id."""
    return F.substring(F.unhex(F.sha2(F.translate(text_of(column), UPPER, LOWER), 256)), 1, KEY_BYTES)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, longer where ``columns`` has them already, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(rows: Iterator) -> Iterator:
    """The same rows; before and after them what tasks freed goes back to the system.

    Workers outlive their tasks, so that what the allocators keep would add to the next stage.
    """
    _give_back()
    yield from rows
    _give_back()


def rows_kept(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are in ``stays``, one of each.

    ``stays`` has each (doc_id, text_key) once, with the number ``n`` of its rows.
    """
    key, own, its_id, text, n = fresh(docs.columns, "__key", "__own", "__id", "__text", "__n")
    stays = written(stays, "stays").select(
        F.col("doc_id").alias(its_id), F.col("text_key").alias(text), F.col("n").alias(n)
    )
    # A measured few come to the texts; beyond that the texts are dealt by id.
    stays = F.broadcast(stays) if fits(stays) else stays
    chosen = docs.withColumns({key: F.col("doc_id").cast("long"), own: text_key()}).join(
        stays, F.col(key).eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(text))
    )
    once = chosen.filter(F.col(n) == 1).select(docs.columns)
    # Only rows that share an id and a text are compared with each other.
    more = chosen.filter(F.col(n) > 1).dropDuplicates([key, own]).select(docs.columns)
    return once.unionByName(more)
