"""Sources and sinks of Spark's own kind: ``.npy`` matrices and a file per note.

Register once with ``register(spark)``; then ``spark.read.format("npy").load(path)`` and
``df.write.format("npy")`` or ``.format("note_files")``.  Files are reached through Arrow
file systems (local and shared folders, object stores); writers put files aside and the driver
moves them into place when all tasks are done, so a failed job leaves nothing.
"""

from __future__ import annotations

import ast
import json
import struct
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

MAGIC = b"\x93NUMPY"
#: rows that a reading task takes, and that a written file holds
ROWS = 65_536


def _located(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (files.LocalFileSystem(), path)


def _listed(path: str, suffix: str) -> tuple[files.FileSystem, list[str]]:
    """The file at a path, or the files of a folder in order of name."""
    where, at = _located(path)
    info = where.get_file_info(at)
    if info.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return where, [at]
    found = where.get_file_info(files.FileSelector(at))
    return where, sorted(f.path for f in found if f.is_file and f.path.endswith(suffix))


def npy_header(stream) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, type, whether columns lie together, and where the data begins."""
    head = stream.read(8)
    if head[:6] != MAGIC:
        raise ValueError("no .npy file")
    wide = head[6] >= 2
    (size,) = struct.unpack("<I" if wide else "<H", stream.read(4 if wide else 2))
    said = ast.literal_eval(stream.read(size).decode("latin-1" if head[6] < 3 else "utf-8"))
    return said["shape"], np.dtype(said["descr"]), said["fortran_order"], (12 if wide else 10) + size


@dataclass
class Rows(InputPartition):
    """Rows of one file, and the number of the first in all files."""

    path: str
    first: int
    count: int
    number: int


class NpyReader(DataSourceReader):
    """Matrices by rows: ``row``, its number over all files, and ``vector``.

    A partition reads its rows at their byte offset and nothing else of the file.
    """

    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rowsperpartition", ROWS))
        if self.rows < 1:
            raise ValueError("rowsPerPartition is at least 1")

    def partitions(self) -> list[Rows]:
        where, paths = _listed(self.path, ".npy")
        out, number = [], 0
        for path in paths:
            with where.open_input_file(path) as stream:
                shape, kind, by_columns, _ = npy_header(stream)
            if len(shape) != 2 or kind.kind not in "fiu" or (by_columns and min(shape) > 1):
                raise ValueError(f"{path} is no matrix of numbers by rows")
            for first in range(0, shape[0], self.rows):
                count = min(self.rows, shape[0] - first)
                out.append(Rows(path, first, count, number + first))
            number += shape[0]
        return out or [Rows("", 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        where, _ = _located(self.path)
        with where.open_input_file(part.path) as stream:
            (_, width), kind, _, begin = npy_header(stream)
            stream.seek(begin + part.first * width * kind.itemsize)
            # about a megabyte at a time
            step = max(1, (1 << 20) // max(1, width * kind.itemsize))
            for at in range(0, part.count, step):
                n = min(step, part.count - at)
                values = np.frombuffer(stream.read(n * width * kind.itemsize), kind).astype(np.float32)
                lists = pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32), values)
                rows = pa.array(np.arange(part.number + at, part.number + at + n))
                yield pa.RecordBatch.from_arrays([rows, lists], ["row", "vector"])


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has put aside, with their names in place."""

    names: list[str]


class _Staged:
    """Files are written to a folder of the job and moved when it commits."""

    suffix = ""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        # made here, where the job is planned: a task that outlives an abort finds it gone and fails
        where, at = _located(self.staging)
        where.create_dir(at, recursive=True)

    def put(self, name: str, data: bytes) -> None:
        where, at = _located(f"{self.staging}/{name}")
        where.create_dir(at.rsplit("/", 1)[0], recursive=False)
        with where.open_output_stream(at, compression=None) as out:
            out.write(data)

    def commit(self, messages: list[Written | None]) -> None:
        where, base = _located(self.path)
        _, staging = _located(self.staging)
        where.create_dir(base, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        # a staged name begins with its task's folder; tasks that failed stay behind and go
        targets = {n: n.rsplit("/", 1)[-1] for n in names}
        if len(set(targets.values())) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        old = [] if not self.overwrite else [
            f.path for f in where.get_file_info(files.FileSelector(base)) if f.is_file and f.path.endswith(self.suffix)
        ]
        kept = {f"{base}/{t}" for t in targets.values()}
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda n: where.move(f"{staging}/{n}", f"{base}/{targets[n]}"), names))
            list(pool.map(where.delete_file, [p for p in old if p not in kept]))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, staging = _located(self.staging)
        for turn in range(5):
            if where.get_file_info(staging).type == files.FileType.NotFound:
                break
            try:
                where.delete_dir(staging)
            except OSError:
                # a task that has not ended yet has just written a file
                if turn == 4:
                    raise
                time.sleep(0.2)


def _task() -> tuple[str, int]:
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId()}-{context.taskAttemptId()}", context.partitionId()


class NpyWriter(_Staged, DataSourceArrowWriter):
    """Files of at most ``rowsPerFile`` rows, named so that their order is that of the rows."""

    suffix = ".npy"

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.rows, self.run = int(options.get("rowsperfile", ROWS)), uuid.uuid4().hex[:8]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        folder, part = _task()
        held: list[np.ndarray] = []
        names: list[str] = []

        def flush(all_: bool) -> None:
            nonlocal held
            rows = np.concatenate(held) if held else np.zeros((0, 0), np.float32)
            while len(rows) >= self.rows or (all_ and len(rows)):
                head, rows = rows[: self.rows], rows[self.rows :]
                name = f"{folder}/part-{part:06d}-{len(names):06d}-{self.run}.npy"
                said = repr({"descr": "<f4", "fortran_order": False, "shape": head.shape}).encode()
                said += b" " * (-(len(said) + 11) % 64) + b"\n"
                self.put(name, MAGIC + b"\x01\x00" + struct.pack("<H", len(said)) + said + head.astype("<f4").tobytes())
                names.append(name)
            held = [rows] if len(rows) else []

        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            if vectors.null_count:
                raise ValueError("a vector is null")
            width = np.diff(vectors.offsets.to_numpy())
            if len(width) and (width != width[0]).any() or held and len(width) and held[0].shape[1] != width[0]:
                raise ValueError("vectors of different lengths")
            held.append(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(batch), -1))
            if sum(map(len, held)) >= self.rows:
                flush(False)
        flush(True)
        return Written(names)


class NoteWriter(_Staged, DataSourceWriter):
    """A file ``<doc_id>.json`` per row ``doc_id, json``, indented."""

    suffix = ".json"

    def write(self, rows: Iterator) -> Written:
        folder, _ = _task()
        names = []
        for row in rows:
            name = str(row["doc_id"])
            if not name or "/" in name or name in (".", "..") or row["doc_id"] is None:
                raise ValueError(f"no file name: {row['doc_id']!r}")
            names.append(f"{folder}/{name}.json")
            self.put(names[-1], json.dumps(json.loads(row["json"]), ensure_ascii=False, indent=4).encode())
        return Written(names)


class Npy(DataSource):
    """``.npy`` matrices: options ``rowsPerPartition`` and ``rowsPerFile``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, overwrite)


class NoteFiles(DataSource):
    """A JSON file per note."""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def schema(self) -> str:
        return "doc_id string, json string"

    def writer(self, schema: StructType, overwrite: bool) -> NoteWriter:
        return NoteWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats ``npy`` and ``note_files`` known to a session."""
    for source in (Npy, NoteFiles):
        spark.dataSource.register(source)
