"""A sink that publishes each batch once: files of tasks first, then one rename, by a Python data source.

Tasks write Parquet files beside the published rows, each attempt under a name of its own. Committing a batch moves the
files of the attempts that count into a folder, which is renamed to batch=<number>. Who reads the path sees whole batches
only. A batch that fails leaves nothing to read; a batch that is repeated finds its folder there and is dropped. Files of
executors that were lost stay aside, unread, until `sweep`. On object stores, where a folder is renamed file by file, the
last step is not atomic; such a path needs a table format.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftline.sources.stored import ship

#: Folders of what is not published; Spark reads no folder whose name begins like this.
WRITING, READY = "_writing", "_ready"


@dataclass
class Written(WriterCommitMessage):
    """The file of one task, None if the task had no rows."""

    file: str | None


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _there(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def write_rows(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """The rows of one task as a file that nobody reads yet."""
    fs, root = _open(path)
    file, out = f"{root}/{WRITING}/{uuid.uuid4().hex}.parquet", None
    try:
        for b in batches:
            if b.num_rows and out is None:
                fs.create_dir(posixpath.dirname(file), recursive=True)
                out = pq.ParquetWriter(file, b.schema, filesystem=fs)
            if b.num_rows:
                out.write_batch(b)
    except BaseException:
        if out is not None:
            out.close()
            fs.delete_file(file)
        raise
    if out is None:
        return Written(None)
    out.close()
    return Written(file)


def discard(path: str, messages: list[WriterCommitMessage | None]) -> None:
    fs, _ = _open(path)
    for m in messages:
        if m is not None and m.file and _there(fs, m.file):
            fs.delete_file(m.file)


def publish(path: str, batch: str, messages: list[WriterCommitMessage | None]) -> bool:
    """Makes the files of a batch readable, all at once; False if the batch was there already."""
    fs, root = _open(path)
    target, ready = f"{root}/batch={batch}", f"{root}/{READY}/{uuid.uuid4().hex}"
    if not _there(fs, target):
        fs.create_dir(ready, recursive=True)
        for m in messages:
            if m is not None and m.file:
                fs.move(m.file, f"{ready}/{posixpath.basename(m.file)}")
        try:
            fs.move(ready, target)
            return True
        except OSError:
            fs.delete_dir(ready)
            if not _there(fs, target):
                raise
    discard(path, messages)
    return False


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str) -> None:
        self.path, self.batch = path, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return write_rows(self.path, iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        publish(self.path, self.batch, messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        discard(self.path, messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return write_rows(self.path, iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        publish(self.path, str(batchId), messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        discard(self.path, messages)


class Published(DataSource):
    """format("published"): rows to option `path`; a batch job is named by option `batch`, a stream's batches by number."""

    @classmethod
    def name(cls) -> str:
        return "published"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("rows are appended, none are replaced")
        return BatchWriter(self.options["path"], self.options.get("batch", uuid.uuid4().hex))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"])


def _register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Published)


def append(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds rows, such as entries of an audit log. A batch whose name is published already adds nothing."""
    _register(rows.sparkSession)
    w = rows.write.format("published").mode("append").option("path", path)
    (w if batch is None else w.option("batch", batch)).save()


def start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream into the sink, each row once, over failures and restarts with the same checkpoint. One stream for a path."""
    _register(rows.sparkSession)
    return rows.writeStream.format("published").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What is published so far."""
    fs, root = _open(path)
    if not _there(fs, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)


def sweep(path: str, older_than: float = 86_400.0) -> int:
    """Deletes files left by lost tasks, untouched for so many seconds; returns how many."""
    fs, root = _open(path)
    left = [i for d in (WRITING, READY) for i in fs.get_file_info(pafs.FileSelector(f"{root}/{d}", recursive=True, allow_not_found=True))]
    old = [i.path for i in left if i.type == pafs.FileType.File and i.mtime.timestamp() < time.time() - older_than]
    for p in old:
        fs.delete_file(p)
    return len(old)
