"""A data source of source files below a folder: ``spark.read.format("source_tree")`` and ``df.write.format("source_tree")``.

Reading gives ``(file, source, byte_length, sha256, status)`` in partitions of some megabytes.  ``file`` is
the path below the folder; line ends become ``\\n``.  Nothing that is wrong with one file fails the job:
``status`` is ``ok``, ``symlink`` (a link, or a file below a linked folder, which is never followed), ``not UTF-8`` or
``unreadable``, and the other columns are null unless it is ok.

Writing takes rows ``(file, source)`` and makes each a file.  Every task writes into a folder of its
own, which takes its place below the target when all have been written, so that a task
that runs again, or a job that fails, leaves nothing that is read.  A null source is an empty
file; a name that is null, absolute, leaves the folder or is written twice by one task fails the job.

The folder must be mounted on the driver and on all executors; other stores go by Spark's own
readers, see ``inputs.read_sources``.

Options: ``path``; ``pattern`` (of file names, default ``*``); ``partition_bytes``.
"""

from __future__ import annotations

import fnmatch
import os
import shutil
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, source string, byte_length long, sha256 string, status string"
PARTITION_BYTES = 16_000_000
WAITING = "_writing-"
#: Bytes of files that are read before a batch is handed on.
_BATCH_BYTES = 2_000_000


def local_path(path: str) -> str:
    """The path of a mounted folder, from a path or a ``file:`` address."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"not a mounted folder: {path}")
    return path


@dataclass
class Files(InputPartition):
    names: list[str]


@dataclass
class Written(WriterCommitMessage):
    folder: str


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = local_path(options["path"])
        self.pattern = options.get("pattern", "*")
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        """Names in sorted order, dealt by size; a linked folder is one name."""
        found = []
        for folder, below, names in os.walk(self.root):
            # What a failed job's last tasks were writing is none of the tree.
            below[:] = sorted(n for n in below if not n.startswith(WAITING))
            names = [n for n in names if fnmatch.fnmatch(n, self.pattern)] + [n for n in below if os.path.islink(os.path.join(folder, n))]
            for n in names:
                at = os.path.join(folder, n)
                found.append((os.path.relpath(at, self.root), 0 if os.path.islink(at) else os.path.getsize(at)))
        parts, size = [Files([])], 0
        for name, n in sorted(found):
            if size + n > self.most and parts[-1].names:
                parts.append(Files([]))
                size = 0
            parts[-1].names.append(name)
            size += n
        return parts

    def _row(self, name: str) -> tuple:
        at = os.path.join(self.root, name)
        try:
            # Checked again where it is read, as the tree may have changed.
            if os.path.realpath(at) != os.path.join(os.path.realpath(self.root), name):
                return name, None, None, None, "symlink"
            with open(at, "rb") as f:
                text = f.read().decode("utf-8").replace("\r\n", "\n")
        except UnicodeDecodeError:
            return name, None, None, None, "not UTF-8"
        except OSError:
            return name, None, None, None, "unreadable"
        data = text.encode()
        return name, text, len(data), sha256(data).hexdigest(), "ok"

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("source", pa.string()), ("byte_length", pa.int64()), ("sha256", pa.string()), ("status", pa.string())])
        rows, size = [], 0
        for name in partition.names:
            rows.append(self._row(name))
            size += rows[-1][2] or 0
            if size > _BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = local_path(options["path"]), overwrite
        self.waiting = os.path.join(self.root, f"{WAITING}{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        folder = os.path.join(self.waiting, f"part-{context.partitionId():05}-{context.taskAttemptId()}")
        os.makedirs(folder)
        for batch in iterator:
            for name, text in zip(batch.column("file").to_pylist(), batch.column("source").to_pylist(), strict=True):
                clean = os.path.normpath(name or "/")
                if os.path.isabs(clean) or clean.split(os.sep)[0] in ("..", "."):
                    raise ValueError(f"not a name below the folder: {name!r}")
                at = os.path.join(folder, clean)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "xb") as f:
                    f.write((text or "").encode())
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m.folder for m in messages if m is not None]
        if self.overwrite:
            for name in os.listdir(self.root) if os.path.isdir(self.root) else []:
                at = os.path.join(self.root, name)
                if at != self.waiting:
                    os.remove(at) if os.path.islink(at) or not os.path.isdir(at) else shutil.rmtree(at)
        run = uuid.uuid4().hex[:8]
        for i, folder in enumerate(sorted(done)):
            # What another attempt of a task has left stays behind and goes with the waiting folder.
            os.rename(folder, os.path.join(self.root, f"{run}-{i:05}"))
        shutil.rmtree(self.waiting, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.waiting, ignore_errors=True)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to ``spark``; its code goes along with plans, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(SourceTree)
