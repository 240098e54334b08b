"""Resume files: presence, contents, and the ranked bundle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.operators.ranking import with_bundle_names
from candrank.plans.joins import fits
from candrank.plans.scratch import written
from candrank.schemas import KEY
from candrank.sources.candidates import IngestError
from candrank.sources.folders import contents, listed
from candrank.sources.store import Store


#: What opening a file counts for in a scan. At Spark's own 4 MB a task takes 32 small files only,
#: and of a folder of very many the tasks cost ten times what their reading does.
OPEN_COST_BYTES = 64 * 1024
_OPEN_COST = "spark.sql.files.openCostInBytes"


def _files(spark: SparkSession, path: str, pattern: str, **options: str) -> DataFrame:
    """The files listed by a task, or else Spark's listing with their ``content``."""
    found = listed(spark, path, pattern.removeprefix("*"))
    return _spark_files(spark, path, pattern, **options) if found is None else found


def _spark_files(spark: SparkSession, path: str, pattern: str, **options: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).options(**options)
    try:
        return files.load(path)
    except AnalysisException as e:
        raise IngestError(f"{path}: resume folder not found") from e


@contextmanager
def _many_files(spark: SparkSession) -> Iterator[None]:
    """Scans that run within take as many small files to a task as their bytes allow."""
    before = spark.conf.get(_OPEN_COST)
    spark.conf.set(_OPEN_COST, str(OPEN_COST_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_OPEN_COST, before)


def _keyed(files: DataFrame, role: str, suffix: str, *columns: str) -> DataFrame:
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    stem = F.left(name, F.length(name) - len(suffix))
    return files.select(F.lit(role).alias("role"), stem.alias("candidate_id"), *columns)


def resume_presence(spark: SparkSession, path: str, role: str) -> DataFrame:
    """Keys that have a file. Only paths are read, never contents."""
    return _keyed(_files(spark, path, "*.pdf"), role, ".pdf")


def resume_contents(spark: SparkSession, path: str, role: str) -> DataFrame:
    """Keys with file contents. Keep them in a bucketed table and read that afterwards.

    Spark lists the folder, on the driver; ``ResumeScan`` doesn't.
    """
    return _keyed(_spark_files(spark, path, "*.pdf"), role, ".pdf", "content")


def resume_listing(spark: SparkSession, path: str, role: str, files: DataFrame | None = None) -> DataFrame:
    """(role, candidate_id, path, length, modified) of the files there are; contents are not read.

    ``files`` passes on a listed folder, which is not listed again.
    """
    found = _files(spark, path, "*.pdf") if files is None else files
    return _keyed(found, role, ".pdf", "path", "length", F.col("modificationTime").alias("modified"))


def listing_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """``now`` and what is gone since ``before``, with ``change``: new, changed, same or gone.

    A file changed if its length or its time of modification did, later or earlier.
    """
    key = ["role", "candidate_id"]
    old = before.select(*key, F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    both = now.join(old, key, "full")
    same = (F.col("length") == F.col("_length")) & (F.col("modified") == F.col("_modified"))
    change = (
        F.when(F.col("path").isNull(), "gone")
        .when(F.col("_path").isNull(), "new")
        .when(same, "same")
        .otherwise("changed")
    )
    return both.select(*key, F.coalesce("path", "_path").alias("path"), "length", "modified", change.alias("change"))


def changed_contents(
    spark: SparkSession, path: str, changes: DataFrame, files: DataFrame | None = None
) -> DataFrame:
    """(role, candidate_id, content) of new and changed files; see ``resume_listing`` for ``files``.

    Their paths are dealt to tasks, which open no others. In a folder that Spark listed, times and
    lengths no changed file has are pushed to the scan, which does not open the others; among the
    files left, the changed ones are found by their path.
    """
    wanted = changes.filter(F.col("change").isin("new", "changed")).select(*KEY, "path", "length", "modified")
    files = _files(spark, path, "*.pdf") if files is None else files
    if "content" not in files.columns:
        return contents(wanted.drop("modified"), missing_ok=True).filter(F.col("content").isNotNull())
    first, least, most = wanted.agg(F.min("modified"), F.min("length"), F.max("length")).first()
    if first is None:
        files = files.limit(0)
    else:
        due = F.col("modificationTime") >= F.lit(first)
        files = files.filter(due & (F.col("length") >= least) & (F.col("length") <= most))
    keys = wanted.drop("length", "modified")
    keys = F.broadcast(keys) if fits(keys) else keys
    return files.select("path", "content").join(keys, "path").select("role", "candidate_id", "content")


class ResumeScan:
    """A folder's files now, with contents where they are new or changed since the last scan.

    ``resumes`` is what an ingest takes: a key per file, and the contents of changed files only.
    ``done()`` keeps the listing in the store, one for each folder and role. Call it once the
    ingest is through; without it the next scan reads the same files again.
    """

    def __init__(self, store: Store, path: str, role: str):
        self._store = store
        self._name = "listing/" + hashlib.sha256(f"{role}|{path.rstrip('/')}".encode()).hexdigest()[:24]
        # The folder is listed once; a file that goes before it is read has no content.
        files = _files(store.spark, path, "*.pdf", ignoreMissingFiles="true")
        self._now = resume_listing(store.spark, path, role, files)
        by_spark = "content" in files.columns
        if by_spark:
            with _many_files(store.spark):
                self._now = written(self._now, "listing")
        before = store.read(self._name) if store.exists(self._name) else self._now.limit(0)
        self.changes = written(listing_changes(self._now, before), "listing-changes")
        if by_spark:
            with _many_files(store.spark):
                changed = written(changed_contents(store.spark, path, self.changes, files), "changed-contents")
            self.resumes = self._now.select(*KEY).join(changed, list(KEY), "left")
        else:
            # A name is there once, so each key's content is read where the key is, and not joined.
            due = F.when(F.col("change").isin("new", "changed"), F.col("path")).alias("path")
            there = self.changes.filter(F.col("change") != "gone").select(*KEY, due, "length")
            self.resumes = written(contents(there, missing_ok=True), "changed-contents", compression="zstd")

    def done(self) -> None:
        self._store.write(self._name, self._now)


def ranked_bundle(
    top: DataFrame, resumes: DataFrame, max_literals: int = 1000
) -> DataFrame:
    """Contents of the resumes of ranked rows under rank-prefixed names (inner join).

    A short ranking turns into a pushed-down key filter, so a sorted resume table is not
    read in full; a longer one is an ordinary join.
    """
    names = with_bundle_names(top).select("role", "candidate_id", "rank", "file_name")
    keys = top.select("role", "candidate_id").limit(max_literals + 1).collect()
    if len(keys) <= max_literals:
        for name in ("role", "candidate_id"):
            resumes = resumes.filter(F.col(name).isin(sorted({k[name] for k in keys})))
    return resumes.join(names, ["role", "candidate_id"], "inner").select(
        "role", "rank", "file_name", "content"
    )
