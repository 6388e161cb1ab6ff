"""A data source that writes text files of given names (mask files of K2, poses).

Rows are ``(path, place, line, times)``: lines, each written ``times`` times, in order of ``place``.  ``write_named_files``
brings the rows of a file together and in order.  Tasks
write below a hidden folder of the job, each file under a name of its own attempt until it is whole, so a
task that is run again replaces its files.  The driver moves the finished folders into place when all
tasks are done, and deletes the hidden folder when the job fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LINES = 1 << 16


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFiles(DataSource):
    """``df.write.format("named_files").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedFileWriter:
        return NamedFileWriter(self.options["path"].rstrip("/"), overwrite)


def write_named_files(rows: DataFrame, folder: str) -> None:
    """Files below ``folder`` from ``rows(path, place, line, times)``.  A file is written by one task, row by row;
    a row with ``times`` 0 adds nothing, so a file may be empty."""
    rows.sparkSession.dataSource.register(NamedFiles)
    ready = rows.select("path", "place", "line", F.col("times").cast("bigint").alias("times")).repartition("path").sortWithinPartitions("path", "place")
    ready.write.format(NamedFiles.name()).option("path", folder).mode("overwrite").save()


class NamedFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.hidden = f"{path}/.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.hidden)
        attempt = TaskContext.get().taskAttemptId()
        name, sink, files = None, None, 0

        def close() -> int:
            if sink is None:
                return 0
            sink.close()
            store.move(f"{root}/{name}.{attempt}", f"{root}/{name}")
            return 1

        for batch in iterator:
            for path, text, times in zip(*(batch.column(c).to_pylist() for c in ("path", "line", "times")), strict=True):
                if path != name:
                    files += close()
                    name = path
                    store.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(f"{root}/{name}.{attempt}")
                line = f"{text}\n".encode()
                for done in range(0, times, LINES):
                    sink.write(line * min(LINES, times - done))
        files += close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.hidden)
        _, target = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))  # the few folders named in the paths
        for entry in found:
            place = f"{target}/{entry.base_name}"
            if store.get_file_info(place).type != fs.FileType.NotFound:
                if not self.overwrite:
                    raise FileExistsError(place)
                store.delete_dir(place)
            store.move(entry.path, place)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.hidden)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)
