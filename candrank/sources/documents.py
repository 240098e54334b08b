"""Score documents kept as one JSON text per candidate."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.functions import variant as V
from candrank.sources.folders import contents, listed

#: Characters from which a document is read in Python; Spark's parser refuses much longer texts.
LONG_CHARS = 4_000_000
_SHORT = "short string, summary string"


def _refused(word: str):
    raise ValueError(word)


def _fields(text: str | None) -> tuple[str | None, str | None]:
    """A long document without its long texts, and its summary; (None, None) if not readable."""
    if text is None:
        return None, None
    try:
        document = json.loads(text, parse_constant=_refused)
        if not isinstance(document, dict):
            return None, None
        summary, recommend = document.get("summary"), document.get("recommend")
        if isinstance(recommend, str | list | dict):
            # Only whether it is empty matters.
            recommend = bool(recommend)
        kept = {k: document[k] for k in ("candidate_id", "weighted_total") if k in document}
        kept |= {"recommend": recommend}
        criteria = document.get("criteria")
        if isinstance(criteria, list):
            kept["criteria"] = [{k: c[k] for k in ("id", "score") if k in c} for c in criteria if isinstance(c, dict)]
        # A lone surrogate is written as a question mark, as in Java.
        summary = summary.encode("utf-8", "replace").decode() if isinstance(summary, str) else None
        return json.dumps(kept), summary
    except (ValueError, RecursionError):
        return None, None


def _parsed(texts: DataFrame) -> DataFrame:
    """Add ``_doc``, the parsed document, and ``_long``, the fields of one read in Python."""

    @F.pandas_udf(_SHORT)
    def shortened(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_fields(x) for x in batch], columns=["short", "summary"], dtype=object)

    document = F.col("document")
    oversized = F.char_length(document) >= LONG_CHARS
    texts = texts.withColumn("_long", shortened(F.when(oversized, document)))
    return V.with_json(texts, "_doc", F.when(oversized, F.col("_long.short")).otherwise(document))


def document_view(texts: DataFrame) -> DataFrame:
    """(role, candidate_id, document) -> the fields ranking reads, without validation.

    Unreadable documents are not in it, see :func:`unreadable_documents`. A missing total is
    0.0, a missing recommendation is false, a missing summary is empty; ``reply_id`` is NULL
    where the id is missing.
    """
    doc = _parsed(texts)

    def part(name: str):
        return V.field(F.col("_doc"), f"$.{name}")

    # The parsed document and the check of it stay in one place, see V.settled.
    readable = F.filter(F.array("_doc"), V.is_object)
    return doc.select("role", "candidate_id", "_long", F.explode(readable).alias("_doc")).select(
        "role",
        "candidate_id",
        V.text(part("candidate_id")).alias("reply_id"),
        F.coalesce(V.number(part("weighted_total")), F.lit(0.0)).alias("weighted_total"),
        V.truthy(part("recommend")).alias("recommend"),
        F.coalesce("_long.summary", V.text(part("summary")), F.lit("")).alias("summary"),
    )


def criteria_view(texts: DataFrame) -> DataFrame:
    """(role, candidate_id, document) -> the criteria and the claimed total, for an audit.

    A score or total that is no number is null, and so are the criteria where the document
    has no list of them. Unreadable documents are left out as in :func:`document_view`.
    """
    doc = F.col("_doc")
    criteria = F.transform(
        # What is no object has neither id nor score; a long document is read without it.
        F.filter(V.items(doc, "$.criteria"), V.is_object),
        lambda c: F.struct(
            V.text(V.field(c, "$.id")).alias("id"), V.number(V.field(c, "$.score")).alias("score")
        ),
    )
    readable = F.filter(F.array("_doc"), V.is_object)
    return _parsed(texts).select("role", "candidate_id", F.explode(readable).alias("_doc")).select(
        "role",
        "candidate_id",
        criteria.alias("criteria"),
        V.number(V.field(doc, "$.weighted_total")).alias("weighted_total"),
    )


def unreadable_documents(texts: DataFrame) -> DataFrame:
    """(role, candidate_id, reason): the documents that :func:`document_view` leaves out."""
    doc = V.settled(_parsed(texts), _kind=V.kind(F.col("_doc")))
    missing: Column = F.when(F.col("document").isNull(), "no document")
    reason = missing.when(F.col("_kind").isNull(), "not one JSON value").otherwise("not a JSON object")
    unread = ~F.coalesce(F.startswith("_kind", F.lit("OBJECT")), F.lit(False))
    return doc.filter(unread).select("role", "candidate_id", reason.alias("reason"))


def read_documents(spark: SparkSession, path: str, role: str) -> DataFrame:
    """``<path>/<candidate_id>.json`` files as (role, candidate_id, document)."""
    found = listed(spark, path, ".json")
    if found is not None:
        name = F.element_at(F.split("path", "/"), -1)
        key = F.left(name, F.length(name) - 5).alias("candidate_id")
        read = contents(found.select(key, "path", "length"))
        document = F.col("content").cast("string").alias("document")
        return read.select(F.lit(role).alias("role"), "candidate_id", document)
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    # The name comes encoded as in a URI, where a plus sign is only a plus sign.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return files.select(
        F.lit(role).alias("role"),
        F.left(name, F.length(name) - 5).alias("candidate_id"),
        F.col("value").alias("document"),
    )
