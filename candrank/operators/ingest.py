"""Cleansing, the two duplicate policies, resume presence and the ingest summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank.functions.text import named, strip_or_empty, strip_or_null


def _ensure(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    absent = {c: F.lit(None).cast("string") for c in columns if c not in raw.columns}
    return raw.withColumns(absent) if absent else raw


def normalise(raw: DataFrame) -> DataFrame:
    """Strip the columns the state table keeps and drop rows without an id."""
    raw = _ensure(raw, ["source_url", "current_title", "current_company"])
    return raw.select(
        "role",
        strip_or_empty(F.col("candidate_id")).alias("candidate_id"),
        strip_or_empty(F.col("source_url")).alias("source_url"),
        strip_or_null(F.col("current_title")).alias("current_title"),
        strip_or_null(F.col("current_company")).alias("current_company"),
        "ingest_seq",
    ).filter(F.col("candidate_id") != "")


def keep_first(rows: DataFrame) -> DataFrame:
    """First row per (role, candidate_id) in file order; ``duplicates`` counts the others.

    A partial aggregate runs before the shuffle, so a key that fills a third of the input
    sends one row per task.
    """
    payload = [c for c in rows.columns if c not in ("role", "candidate_id")]
    first = rows.groupBy("role", "candidate_id").agg(
        F.min_by(F.struct(*map(named, payload)), "ingest_seq").alias("_first"),
        (F.count(F.lit(1)) - 1).alias("duplicates"),
    )
    return first.select(
        "role", "candidate_id", *[named(c, "_first") for c in payload], "duplicates"
    )


def metadata_keep_last(raw: DataFrame) -> DataFrame:
    """All input columns of the last row per untrimmed id; rows without an id are dropped."""
    payload = [c for c in raw.columns if c not in ("role", "candidate_id")]
    last = (
        raw.filter(F.col("candidate_id") != "")
        .groupBy("role", "candidate_id")
        .agg(F.max_by(F.struct(*map(named, payload)), "ingest_seq").alias("_last"))
    )
    return last.select("role", "candidate_id", *[named(c, "_last") for c in payload])


def metadata_keep_first(raw: DataFrame) -> DataFrame:
    """The stricter lookup: the same trimmed id and the same row the state table took."""
    trimmed = raw.withColumn("candidate_id", strip_or_empty(F.col("candidate_id")))
    return keep_first(trimmed.filter(F.col("candidate_id") != "")).drop("duplicates")


def resume_presence(candidates: DataFrame, present: DataFrame) -> DataFrame:
    """Add ``has_resume``. ``present`` holds one key per file."""
    marked = present.select("role", "candidate_id", F.lit(True).alias("has_resume"))
    return candidates.join(marked, ["role", "candidate_id"], "left").withColumn(
        "has_resume", F.coalesce("has_resume", F.lit(False))
    )


def ingest_summary(candidates: DataFrame) -> DataFrame:
    """Counts per role over deduplicated candidates with ``has_resume``."""
    return candidates.groupBy("role").agg(
        F.count(F.lit(1)).alias("ingested"),
        F.count_if("has_resume").alias("with_resume"),
        F.count_if(~F.col("has_resume")).alias("without_resume"),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates_skipped"),
    )
