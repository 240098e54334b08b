"""Versioned Parquet tables keyed by (role, candidate_id).

``<root>/<table>/v=<n>`` is written in full and becomes current when Spark's job commit
leaves its ``_SUCCESS`` file; older versions stay for readers that still use them. Appended
rows get a folder of their own, ``v=<n>-<part>``, with its own ``_SUCCESS``: an append that
was interrupted is never seen. A read is the union of a version and its committed parts.

Bucket count and schema are kept beside each version. A store opened with another bucket
count reads and appends in the stored layout, and only new versions take the new one.

With ``buckets`` the tables are hash-bucketed and sorted on the key. Tables with the same
bucket count then join on the key without an exchange, so the wide text and answer tables
are shuffled once, when they are written. A table with appended parts is shuffled where it is
joined, until it is written anew.
Sorting puts one role's rows together, so a filter on ``role`` skips row groups. Without
``buckets`` the tables are partitioned by ``role``; a rebalance splits a large role into
several files and keeps small ones in one.

Raw input may hold any number of rows per key. It is never moved by key, so a repeated id
cannot fill one task.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candrank.functions.text import named
from candrank.schemas import KEY


RAW_TABLES = ("input", "candidates")


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self._aligned: set[str] = set()

    # -- versions ---------------------------------------------------------------------
    def _fs_path(self, path: str):
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def versions(self, table: str) -> list[int]:
        """Committed versions, oldest first."""
        fs, folder = self._fs_path(f"{self.root}/{table}")
        if not fs.exists(folder):
            return []
        found = []
        for entry in fs.listStatus(folder):
            name = entry.getPath().getName()
            if name.startswith("v=") and "-" not in name and self._committed(f"{self.root}/{table}/{name}"):
                found.append(int(name[2:]))
        return sorted(found)

    def _committed(self, path: str) -> bool:
        fs, marker = self._fs_path(f"{path}/_SUCCESS")
        return fs.exists(marker)

    def _parts(self, base: str) -> list[str]:
        """Folders of the rows appended to a version, committed or not."""
        fs, folder = self._fs_path(base.rpartition("/")[0])
        names = [e.getPath().getName() for e in fs.listStatus(folder)]
        prefix = base.rpartition("/")[2] + "-"
        return sorted(f"{base.rpartition('/')[0]}/{n}" for n in names if n.startswith(prefix))

    def appended(self, table: str) -> bool:
        """Whether rows have been added to the current version."""
        base = f"{self.root}/{table}/v={self.versions(table)[-1]:08d}"
        return any(self._committed(p) for p in self._parts(base))

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def _next(self, table: str) -> str:
        """Path of a version number no attempt has used, finished or not."""
        fs, folder = self._fs_path(f"{self.root}/{table}")
        used = [0]
        if fs.exists(folder):
            names = [e.getPath().getName() for e in fs.listStatus(folder)]
            used += [int(n[2:]) for n in names if n.startswith("v=") and "-" not in n]
        return f"{self.root}/{table}/v={max(used) + 1:08d}"

    # -- tables -----------------------------------------------------------------------
    def comes_aligned(self, table: str) -> None:
        """From now on, new versions of ``table`` are written as ``aligned``, see :meth:`write`."""
        self._aligned.add(table)

    def _buckets_for(self, path: str, schema: T.StructType) -> int | None:
        table = path[len(self.root) + 1 :].rpartition("/")[0]
        return self.buckets if set(KEY) <= set(schema.names) and table not in RAW_TABLES else None

    def _name(self, path: str, buckets: int) -> str:
        return "candrank_" + hashlib.sha256(f"{path}|{buckets}".encode()).hexdigest()[:24]

    def write(self, table: str, df: DataFrame, aligned: bool = False) -> DataFrame:
        """Write a new version and return it.

        ``aligned`` says that the rows already come hash-partitioned on the key with the
        bucket count, as the result of a join between bucketed tables does. It only saves
        a shuffle: rows that come otherwise still reach their bucket, in more files.
        """
        path = self._next(table)
        buckets = self._buckets_for(path, df.schema) or None
        # The schema is kept beside the data: an empty version has no file to infer from,
        # and a partition value such as "007" must stay text.
        fs, note = self._fs_path(self._layout_path(path))
        out = fs.create(note, True)
        out.write(json.dumps({"schema": df.schema.jsonValue(), "buckets": buckets}).encode("utf-8"))
        out.close()
        self._save(path, df, aligned or table in self._aligned, buckets)
        return self._open(path, df.schema, buckets)

    def append(self, table: str, df: DataFrame, aligned: bool = False, part: str | None = None) -> DataFrame:
        """Add rows to the current version, or start one. Returns the whole table.

        Rows appended under the name of a ``part`` are added once: where that part is
        committed already, as when a batch is replayed, ``df`` is not computed.
        """
        known = self.versions(table)
        if not known:
            first = self.write(table, df if part is None else df.limit(0), aligned)
            if part is None:
                return first
            known = self.versions(table)
        base = f"{self.root}/{table}/v={known[-1]:08d}"
        schema, buckets = self._layout(base)
        used = self._parts(base)
        numbers = [int(p.rpartition("-")[2]) for p in used if p.rpartition("-")[2].isdigit()]
        named_part = f"{max(numbers, default=0) + 1:06d}" if part is None else f"{part}.part"
        path = f"{base}-{named_part}"
        if not self._committed(path):
            self._save(path, df.select(*map(named, schema.names)), aligned, buckets)
        return self.read(table)

    def append_new(self, table: str, df: DataFrame) -> DataFrame:
        """Append rows whose key the table does not hold yet."""
        if self.exists(table):
            df = df.join(self.read(table).select(*KEY), list(KEY), "left_anti")
        return self.append(table, df)

    def append_run(self, table: str, df: DataFrame, run: str, aligned: bool = False) -> DataFrame:
        """Append ``df`` under the name ``run`` and return the run's rows.

        Rows an interrupted run already committed are returned as they are, and ``df`` is
        not computed then.
        """

        def done(whole: DataFrame) -> DataFrame:
            return whole.filter(F.col("run") == run)

        if self.exists(table) and not done(self.read(table)).isEmpty():
            return done(self.read(table))
        return done(self.append(table, df.withColumn("run", F.lit(run)), aligned))

    def once(self, table: str, df: DataFrame) -> DataFrame:
        """Write ``df`` unless an interrupted run already did; nothing is computed then."""
        return self.read(table) if self.exists(table) else self.write(table, df)

    def once_by(self, table: str, df: DataFrame, column: str) -> DataFrame:
        """Rows in folders by the values of ``column``, kept as a first complete write left them.

        Such a table has no versions and takes no appends.
        """
        path = f"{self.root}/{table}"
        if not self._committed(path):
            df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def once_written(self, table: str) -> bool:
        return self._committed(f"{self.root}/{table}")

    def names(self, folder: str) -> list[str]:
        """The tables in a folder of the store."""
        fs, place = self._fs_path(f"{self.root}/{folder}")
        return sorted(e.getPath().getName() for e in fs.listStatus(place)) if fs.exists(place) else []

    def _save(self, path: str, df: DataFrame, aligned: bool, buckets: int | None) -> None:
        # What an interrupted attempt left under a part's name was never seen.
        mode = "overwrite" if path.endswith(".part") else "errorifexists"
        if buckets:
            placed = df if aligned and buckets == self.buckets else df.repartition(buckets, *KEY)
            (
                placed.write.format("parquet")
                .mode(mode)
                .bucketBy(buckets, *KEY)
                .sortBy(*KEY)
                .option("path", path)
                .saveAsTable(self._name(path, buckets))
            )
        elif "role" in df.columns:
            table = path[len(self.root) + 1 :].rpartition("/")[0]
            placed = df if table in RAW_TABLES else df.hint("rebalance", "role")
            placed.write.mode(mode).partitionBy("role").parquet(path)
        else:
            df.write.mode(mode).parquet(path)

    def _layout_path(self, path: str) -> str:
        return f"{self.root}/_schema{path[len(self.root):]}.json"

    def _layout(self, path: str) -> tuple[T.StructType, int | None]:
        """Schema and bucket count; a note without the count is read without buckets."""
        fs, note = self._fs_path(self._layout_path(path))
        source = fs.open(note)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        found = json.loads(text)
        return T.StructType.fromJson(found.get("schema", found)), found.get("buckets")

    def _open(self, path: str, schema: T.StructType, buckets: int | None) -> DataFrame:
        if not buckets:
            return self.spark.read.schema(schema).parquet(path).select(*map(named, schema.names))
        # Spark 4.1 takes a union of bucketed parts as laid out by key but does not always run it
        # so; groups over it then come in pieces, and outer joins fail. A table of several parts
        # is therefore dealt by key again where a join or a group needs it.
        self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        name = self._name(path, buckets)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join("`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in schema)
            keys = ", ".join(KEY)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS "
                f"LOCATION '{path}'"
            )
        return self.spark.table(name)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        known = self.versions(table)
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"no committed version of {table} under {self.root}")
        base = f"{self.root}/{table}/v={version or known[-1]:08d}"
        schema, buckets = self._layout(base)
        parts = [p for p in self._parts(base) if self._committed(p)]
        return reduce(DataFrame.unionAll, [self._open(p, schema, buckets) for p in (base, *parts)])
