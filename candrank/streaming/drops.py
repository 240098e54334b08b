"""Ingest of candidate files as they arrive, with the batch operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candrank import constants as C
from candrank.functions.text import named
from candrank.plans.run import run_ingest
from candrank.sources.candidates import check_header
from candrank.sources.store import Store


def candidate_stream(spark: SparkSession, path: str, columns=C.KNOWN_COLUMNS) -> DataFrame:
    """CSV files under ``<path>/role=<role>/``, all columns as text."""
    check_header(list(columns), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "role")])
    files = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    place = [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ]
    return files.select("role", *place, *map(named, columns))


def _with_sequence(batch: DataFrame, number: int) -> DataFrame:
    """Order of arrival: batch, file, block, then the row number taken on the scan."""
    seq = F.struct(
        F.lit(number).cast("long").alias("batch"),
        F.col("_file").alias("file"),
        F.col("_block").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return batch.withColumn("ingest_seq", seq).drop("_file", "_block")


def ingest_stream(stream: DataFrame, resumes, store: Store, as_of_batch, checkpoint: str):
    """Upsert each arriving batch into the state.

    ``resumes()`` gives the keys that have a file at that moment and ``as_of_batch(n)``
    the batch's clock. A batch that is replayed after a failure upserts the same rows
    again and keeps its raw rows once, which changes nothing.
    """
    origin = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def each(batch: DataFrame, number: int) -> None:
        rows = _with_sequence(batch, number)
        run_ingest(store, rows, resumes(), as_of_batch(number), accumulate=True, batch=f"{origin}.{number:08d}")

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
