"""Folders of very many small files, listed and read by tasks.

Spark's file readers keep the status of every file on the driver and plan their tasks there. Here
one task lists a folder in batches, the listing is a table like any other, and the files it names
are read by tasks that the table's rows are dealt to. The driver sees counts. It holds for folders
of a mounted file system (``file:``), which all executors reach.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.plans.scratch import written

#: Most files, and about the most bytes, that one task reads.
TASK_FILES = 10_000
TASK_BYTES = 64 * 1024 * 1024
#: Rows of a listing, and bytes of contents, that leave a task at a time.
LISTED_ROWS = 10_000
CONTENT_BYTES = 8 * 1024 * 1024
_LISTED = "path string, length long, modified long"


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _may_be_partition(folder: os.DirEntry) -> bool:
    """Whether Spark might take a folder, or one below it, for a partition. It reads no others."""
    if _hidden(folder.name) and not folder.name.startswith(("_metadata", "_common_metadata")):
        return False
    if "=" in folder.name or folder.is_symlink():
        return True
    with os.scandir(folder.path) as inner:
        return any(_may_be_partition(e) for e in inner if e.is_dir())


def _local(spark: SparkSession, path: str) -> str | None:
    """The one folder on a mounted file system that Spark understands ``path`` as, or None."""
    if any(c in path for c in "{}[]*?\\"):
        return None
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = system.makeQualified(hadoop)
    if folder.toUri().getScheme() != "file" or not system.exists(folder) or not system.getFileStatus(folder).isDirectory():
        return None
    return folder.toUri().getPath()


def listed(spark: SparkSession, path: str, suffix: str) -> DataFrame | None:
    """(path, length, modificationTime) of the files in a folder that end in ``suffix``.

    They are those Spark would read: not hidden, not empty, in the folder itself. Where Spark's own
    listing is needed the result is None: on other file systems, for patterns, where there is
    no such folder, and where folders inside may be partitions.
    """
    folder = _local(spark, path)
    if folder is None:
        return None

    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            columns = [list(x) for x in zip(*rows, strict=True)]
            types = (pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["path", "length", "modified"])

        rows, inside = [], False
        with os.scandir(folder) as entries:
            for entry in entries:
                if entry.is_dir():
                    inside = inside or _may_be_partition(entry)
                    continue
                if not entry.name.endswith(suffix) or _hidden(entry.name):
                    continue
                try:
                    entry.name.encode()
                    found = entry.stat()
                except (FileNotFoundError, UnicodeEncodeError):
                    continue  # gone, or under a name that is no text
                if found.st_size:
                    rows.append((f"file:{entry.path}", found.st_size, found.st_mtime_ns // 1_000_000))
                if len(rows) == LISTED_ROWS:
                    yield batch(rows)
                    rows = []
        if inside:
            rows.append((None, None, None))
        if rows:
            yield batch(rows)

    found = written(spark.range(0, 1, 1, 1).mapInArrow(run, _LISTED), "listed")
    if not found.filter(F.col("path").isNull()).isEmpty():
        return None
    return found.select("path", "length", F.timestamp_millis("modified").alias("modificationTime"))


def contents(files: DataFrame, missing_ok: bool = False) -> DataFrame:
    """Read the files of a listing: its other columns and ``content`` instead of (path, length).

    A row without a path has no content, and with ``missing_ok`` neither has a file that went.
    The rows are counted first and dealt to tasks by their paths.
    """
    count, size = files.agg(F.count("path"), F.coalesce(F.sum("length"), F.lit(0))).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-count // TASK_FILES), -(-size // TASK_BYTES), min(count, cores), 1)
    names = [c for c in files.columns if c not in ("path", "length")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*names).schema), "content binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, read = 0, 0, []

            def piece(batch=batch):
                rows = batch.slice(start, len(read))
                arrays = [*(rows.column(n) for n in names), pa.array(read, pa.binary())]
                return pa.RecordBatch.from_arrays(arrays, names=[*names, "content"])

            for path in batch.column("path").to_pylist():
                content = None
                try:
                    if path is not None:
                        with open(path.removeprefix("file:"), "rb", buffering=0) as file:
                            content = file.read()
                except FileNotFoundError:
                    if not missing_ok:
                        raise
                read.append(content)
                size += len(content or b"")
                if size >= CONTENT_BYTES:
                    yield piece()
                    start, size, read = start + len(read), 0, []
            if read:
                yield piece()

    # Rows without a path are dealt by all their columns, else they came to one task.
    dealt = files.repartition(tasks, *files.columns)
    return dealt.select(*names, "path").mapInArrow(run, schema)
