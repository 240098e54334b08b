"""Candidate file scan, header checks and retention of the raw rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.functions.text import named


class IngestError(Exception):
    """The input cannot be ingested; nothing has been written."""


# One file is one scan task when quoted line breaks are allowed, so large inputs should
# come as many files. Pass multi_line=False to split files that have none.
def _reader(spark: SparkSession, multi_line: bool):
    return (
        spark.read.option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("inferSchema", False)
    )


def check_header(header: list[str] | None, where: str) -> list[str]:
    """Required columns present, none twice; returns the unknown ones in file order.

    Names that differ only in case count as the same, because Spark could not tell them apart.
    """
    if not header:
        raise IngestError(f"{where}: the file has no header row")
    missing = [c for c in C.REQUIRED_COLUMNS if c not in header]
    if missing:
        raise IngestError(f"{where}: required columns {missing} are missing; found {header}")
    lower = [c.lower() for c in header]
    twice = sorted({c for c in header if lower.count(c.lower()) > 1})
    if twice:
        raise IngestError(f"{where}: columns {twice} appear more than once")
    return unknown_columns(header)


def unknown_columns(columns: list[str]) -> list[str]:
    reserved = ("role", "ingest_seq")
    return [c for c in columns if c not in C.KNOWN_COLUMNS and c not in reserved]


def read_candidates(
    spark: SparkSession, path: str, role: str | Column, multi_line: bool = True
) -> DataFrame:
    """All columns as text, in file order, with ``role`` and ``ingest_seq``.

    ``ingest_seq`` is (file, block, row): rows of one block are read in order by one task,
    so the number taken on the scan orders them, and file and block order the rest. It
    does not depend on how Spark packs files into tasks.
    """
    try:
        first = _reader(spark, multi_line).option("header", False).csv(path).head(1)
    except AnalysisException as e:
        raise IngestError(f"{path}: not found") from e
    names = list(first[0]) if first else None
    if names and all(n is None for n in names):
        names = None
    check_header([n or "" for n in names] if names else None, path)
    raw = (
        _reader(spark, multi_line)
        .option("header", True)
        .option("enforceSchema", False)  # a file with another header is an error
        .csv(path)
    )
    seq = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    where = F.lit(role) if isinstance(role, str) else role
    return raw.select(where.alias("role"), seq.alias("ingest_seq"), *map(named, raw.columns))
