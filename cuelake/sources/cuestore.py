"""Cue files as a data source: planned partitions for reading, a two-phase commit for writing.

Reading gives ``path, size, mtime, content``, one row per file, empty files too.  Writing takes ``name, part_no,
content``, sorted by name and part inside each partition, and makes one file of a name's parts.  Paths may be anything
that pyarrow opens: ``file:``, ``hdfs:`` and object stores.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "cuefiles"
SCHEMA = "path string, size bigint, mtime timestamp, content binary"
#: Bytes and files that one reading task takes, about, and those of a batch.
PARTITION_BYTES = 64 << 20
PARTITION_FILES = 10_000
BATCH_BYTES = 8 << 20
BATCH_FILES = 2000
#: Bytes of a name's key, by which a commit finds a name that two tasks wrote.
KEY_BYTES = 16


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


@dataclass
class _Files(InputPartition):
    """Names by folder, as compressed text: a plan names every file, so it keeps a few bytes of each."""
    folders: list


def _packed(names):
    return zlib.compress("\0".join(names).encode("utf-8", "surrogateescape"))


def _unpacked(names):
    return zlib.decompress(names).decode("utf-8", "surrogateescape").split("\0")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.most_bytes, self.most_files = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("partitionFiles", PARTITION_FILES))

    def partitions(self):
        """Files in order of their names, as many to a task as its bytes allow; hidden ones are left out.

        One folder is listed at a time, so what the driver holds is the largest folder's listing.
        """
        from pyarrow import fs
        store, folder = _open(self.path)
        planned, held, count, todo = [], 0, 0, [folder]
        while todo:
            at, names, inner = todo.pop(), [], []
            found = [(info.base_name, info.path, info.type, info.size) for info in store.get_file_info(fs.FileSelector(at))
                     if info.base_name[:1] not in ("_", ".")]
            for name, path, kind, size in sorted(found):
                if kind == fs.FileType.Directory:
                    inner.append(path)
                if kind != fs.FileType.File:
                    continue
                if not planned or held + size > self.most_bytes or count >= self.most_files:
                    if names:
                        planned[-1].folders.append((at, _packed(names)))
                    planned.append(_Files([]))
                    names, held, count = [], 0, 0
                names.append(name)
                held, count = held + size, count + 1
            if names:
                planned[-1].folders.append((at, _packed(names)))
            todo += inner[::-1]
        return planned or [_Files([])]

    def read(self, partition):
        store, _ = _open(self.path)
        types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
        rows, held = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["path", "size", "mtime", "content"])
        for folder, names in partition.folders:
            for name in _unpacked(names):
                info = store.get_file_info(f"{folder}/{name}")
                with store.open_input_stream(info.path) as stream:
                    rows.append((info.path, info.size, info.mtime_ns // 1000, stream.read()))
                held += info.size
                if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


def _name_key(name: str) -> bytes:
    return hashlib.blake2b(name.encode("utf-8", "surrogateescape"), digest_size=KEY_BYTES).digest()


@dataclass
class _Written(WriterCommitMessage):
    """A task's folder and the keys of its names; the names themselves stay in the folder."""
    folder: str
    keys: bytes


class _Writer(DataSourceWriter):
    """A task writes into a folder of its own attempt; the job's commit moves the files of finished tasks.

    So a file appears whole or not at all, whatever attempts were lost.  A name that two tasks wrote fails the job
    before anything is moved.  With ``folders`` a task's files stay together in a folder that is moved at once.
    """

    def __init__(self, options, overwrite):
        self.path, self.overwrite, self.job = options["path"], overwrite, f"_staging-{uuid.uuid4().hex}"
        self.folders = options.get("folders", "false").lower() == "true"

    def write(self, iterator):
        store, folder = _open(self.path)
        context = TaskContext.get()
        own = f"{folder}/{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(own, recursive=True)
        before, seen, out = None, set(), None
        for row in iterator:
            name, part, content = row["name"], row["part_no"], row["content"]
            if out is None or name != before:
                if name is None or "/" in name or name[:1] in ("", "_", ".") or _name_key(name) in seen:
                    raise ValueError(f"not a new file name: {name!r}; rows must be sorted by name")
                if out is not None:
                    out.close()
                seen.add(_name_key(name))
                out, before, last = store.open_output_stream(f"{own}/{name}"), name, None
            if last is not None and part <= last:
                raise ValueError(f"parts of {name!r} are not in order")
            last = part
            out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        if out is not None:
            out.close()
        return _Written(own, b"".join(seen))

    def commit(self, messages):
        from pyarrow import fs
        store, folder = _open(self.path)
        messages = [m for m in messages if m is not None]
        keys = np.frombuffer(b"".join(m.keys for m in messages), f"V{KEY_BYTES}")
        if len(keys) != len(np.unique(keys)):
            raise ValueError("two tasks wrote files of one name; partition the rows by name")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(folder)):
                if info.type == fs.FileType.File:
                    store.delete_file(info.path)
                elif self.folders and info.base_name[:1] not in ("_", "."):
                    store.delete_dir(info.path)
        for message in messages:
            if self.folders and message.keys:
                store.move(message.folder, f"{folder}/{self.job.removeprefix('_staging-')}-{message.folder.rsplit('/', 1)[1]}")
                continue
            for info in store.get_file_info(fs.FileSelector(message.folder)):
                store.move(info.path, f"{folder}/{info.base_name}")
        self._clean(store, folder)

    def abort(self, messages):
        self._clean(*_open(self.path))

    def _clean(self, store, folder):
        from pyarrow import fs
        if store.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.job}")


class CueFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def read_cue_files(spark: SparkSession, folder: str, **options) -> DataFrame:
    """One row per file with its bytes; ``subtitle_file_guard`` turns them into text."""
    spark.dataSource.register(CueFiles)
    return spark.read.format(FORMAT).options(**options).load(folder)


def write_cue_files(parts: DataFrame, folder: str, name, mode: str = "append", folders: bool = False) -> None:
    """One file per value of ``name`` from rows (part_no, content); ``overwrite`` removes the folder's other files.

    With ``folders`` the files of a task lie in a folder below, so that neither commit nor listing handles all at once.

    A file is one ordered object, so its parts stream through one task, a part at a time.
    """
    parts.sparkSession.dataSource.register(CueFiles)
    rows = parts.select(name.alias("name"), F.col("part_no").cast("long").alias("part_no"), "content")
    (rows.repartition("name").sortWithinPartitions("name", "part_no").write.format(FORMAT)
     .option("folders", str(folders).lower()).mode(mode).save(folder))
