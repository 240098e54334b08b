"""Files under their own names, written where the rows are."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

_WRITTEN = "role string, file_name string, length long"


def _folder(path: str, role: str) -> str:
    """A role's folder, named as a partition of the role would be."""
    return f"{path.rstrip('/')}/role={quote(role, safe=' ')}"


def write_files(files: DataFrame, path: str) -> DataFrame:
    """Write each row (role, file_name, content) as ``<path>/role=<role>/<file_name>``.

    The tasks write through the file system that the path names, so it must be one that all
    executors reach. A file comes into a hidden folder of its attempt first and is then moved, so a task
    that is run again, or twice at a time, leaves whole files only, and tasks that write at a time
    wait for each other in the role's folder for the move alone. A slash in a name is written as
    %2F. What was written is kept under ``<path>/_files``, complete once that has its _SUCCESS,
    and is returned: (role, file_name, length).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        attempt = TaskContext.get().taskAttemptId()
        made = set()
        for batch in batches:
            names, sizes = [], []
            for role, name, content in zip(*batch.columns, strict=True):
                folder, name = _folder(root, role.as_py()), name.as_py().replace("/", "%2F")
                if folder not in made:
                    system.create_dir(f"{folder}/.{attempt}", recursive=True)
                    made.add(folder)
                data = content.as_py() or b""
                with system.open_output_stream(f"{folder}/.{attempt}/{name}") as out:
                    out.write(data)
                system.move(f"{folder}/.{attempt}/{name}", f"{folder}/{name}")
                names.append(name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(sizes, pa.int64())],
                names=["role", "file_name", "length"],
            )
        for folder in made:
            system.delete_dir(f"{folder}/.{attempt}")

    rows = files.select("role", "file_name", "content")
    rows.mapInArrow(run, _WRITTEN).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_files")
    return files.sparkSession.read.schema(_WRITTEN).parquet(f"{path.rstrip('/')}/_files")
